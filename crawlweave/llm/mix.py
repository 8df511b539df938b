"""Mixing sources to target weights (problem 9).

Tokens are counted once, per source totals give the repetition rate, and every document decides on its copies
alone: floor(rate) of them and one more if the hash of its id falls below the fraction. No shuffle of texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.common import site_key, small, written

#: Fixed value: the published pre-split pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file (base64 token, rank a line); loaded once a Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            known: dict[str, int] = {}
            out = []
            for text in batch.column("text").to_pylist():
                n = known.get(text)
                if n is None:
                    n = known[text] = len(enc.encode_ordinary(text))
                out.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("h1"), batch.column("h2"), pa.array(out, pa.int64())], ["doc_id", "source", "h1", "h2", "tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, h1, h2, tokens) of every document with non-blank text and a source; h1, h2: 128-bit hash of the text."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), site_key(F.col(source_col)).alias("source"), F.col(text_col).alias("text"))
    src = src.where(r"doc_id is not null and source is not null and text rlike '\\S'")
    src = src.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("2"), "text").alias("h2"), "text")
    return src.mapInArrow(_count(tokenizer), "doc_id long, source string, h1 long, h2 long, tokens long")


def _rates(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a target: its tokens and repetition rate. Without a wanted total the mix is as large as the caps allow with all shares met."""
    want = targets.select(site_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("double").alias("max_repeats"))
    want = want.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    have = texts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("texts"))
    both = want.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    room = F.when(F.col("tokens") > 0, F.col("tokens") * F.col("max_repeats") / F.col("target_share"))
    # One row a target; the window holds the target table, not the data.
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(room).over(Window.partitionBy(F.lit(0)))
    rate = F.when(F.col("tokens") > 0, F.least("max_repeats", total * F.col("target_share") / F.col("tokens")))
    return both.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 1, total_tokens: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    `total_tokens`: the wanted size; a source whose cap doesn't allow its share of it gives what it can, and the report tells
    the shares reached. Without it the mix is as large as the caps allow with all shares met.

    Mix: (doc_id, source, copy_no, tokens), a row per copy. Report: (source, target_share, max_repeats, texts, tokens,
    rate, mixed_tokens, share, most_copies), a row per target.
    Sources are compared trimmed and lower-cased. Null or blank texts, null sources and sources without target stay
    out. Of a text that comes under several ids only the one of the least id is used, so that no text exceeds its
    cap. A target without documents gets rate 0 and the others keep their proportions. Same seed, same mix.
    """
    rows = written(token_counts(docs, tokenizer, id_col, text_col, source_col), "tokens")
    wanted = targets.select(site_key(F.col("source")).alias("source")).where("source is not null").distinct()
    own = rows.join(small(wanted), "source", "left_semi")
    first = own.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("t")).select("t.*")
    texts = written(first, "texts")
    rates = written(_rates(texts, targets, total_tokens), "rates")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    whole = F.floor("rate")
    copies = (whole + F.when(unit < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    drawn = texts.join(small(rates.select("source", "rate")), "source").withColumn("copies", copies).where("copies > 0")
    out = drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "tokens").withColumn("copy_no", F.col("copy_no").cast("long"))
    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").cast("long").alias("most_copies"))
    report = rates.join(used, "source", "left").na.fill(0, ["mixed_tokens", "most_copies", "texts"])
    share = F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0))), F.lit(0))
    report = report.select("source", "target_share", F.col("max_repeats").cast("long").alias("max_repeats"), "texts", "tokens", "rate", "mixed_tokens", F.coalesce(share, F.lit(0.0)).alias("share"), "most_copies")
    return out, report

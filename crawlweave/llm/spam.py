"""Keyword-stuffed and link-list pages (problem 3): rank-frequency curves against same-language prose.

A page gives its frequency spectrum (how many words occur how often), about ten rows instead of one a word. SQL
windows turn it into ranks and fit ln(frequency) on ln(rank). Prose pages give, per language and length class, the
usual slope, residual and curve; a page far off on any of them is spam. Sentences tell which pages serve as the
reference of prose, and an exact check afterwards leaves out lists with running text beside them.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.common import written
from crawlweave.llm import prose, residue
from crawlweave.llm.body import map_pages

SCHEMA = residue.SCHEMA + ", lang string, sentences int, spectrum array<struct<freq:int,types:int>>, curve array<double>"
#: Parts of the curve: function words, then the other words by rank 1, 2, 3-4, 5-8, ... , 65 and beyond.
BINS = 9
RANKS = [(0, 1), *((1 << k, 2 << k) for k in range(BINS - 3)), (1 << BINS - 3, None)]
#: Full sentences from which a page counts as prose.
PROSE = 3


def page_row(item, site, url, split):
    rows = [n - 1 for n in sorted([*split.body, *split.closing])]
    ws = [w for n in rows for w in split.words(n)]
    if not ws:
        return ()
    lang = prose.language(" ".join([part for b in split.blocks for part in b.parts]))
    own = prose.SETS.get(lang, prose.STOP)
    counts = Counter(ws)
    others = sorted([n for w, n in counts.items() if w not in own], reverse=True)
    curve = [len(ws) - sum(others), *(sum(others[a:b]) for a, b in RANKS)]
    full = sum(prose.full(split.parts(n), own) for n in rows)
    spectrum = sorted(Counter(counts.values()).items())
    rest = residue.page_row(item, site, url, split)[0]
    return [(*rest[:3], len(ws), *rest[4:], lang, full, spectrum, [c / len(ws) for c in curve])]


SMALL = ["row", "item_id", "lang", "words", "sentences", "curve"]


def page_rows(items: DataFrame, id_col: str = "item_id", url_col: str = "url", domain_col: str = "domain", text_col: str = "raw_content") -> DataFrame:
    """What the curves and `residue_of` need of every page with body; written, with a unique `row`."""
    return written(map_pages(items, page_row, SCHEMA, id_col, url_col, domain_col, text_col).withColumn("row", F.monotonically_increasing_id()), "spectra")


def curves(pages: DataFrame) -> DataFrame:
    """(row, item_id, lang, words, sentences, reference, curve, slope, residual, size): the fitted curve of every page body."""
    points = pages.select("row", F.explode("spectrum").alias("p")).select("row", "p.freq", "p.types")
    w = Window.partitionBy("row").orderBy(F.desc("freq"))
    # All words of one frequency share the ranks after those of higher frequency: their middle stands for them.
    rank = F.sum("types").over(w) - (F.col("types") - 1) / 2
    xy = points.select("row", F.col("types").cast("double").alias("n"), F.log(rank).alias("x"), F.log("freq").alias("y"))
    fit = xy.groupBy("row").agg(
        F.sum("n").alias("n"), F.sum(F.expr("n*x")).alias("sx"), F.sum(F.expr("n*y")).alias("sy"), F.sum(F.expr("n*x*x")).alias("sxx"), F.sum(F.expr("n*x*y")).alias("sxy"), F.sum(F.expr("n*y*y")).alias("syy")
    )
    vx, vy, cxy = F.expr("sxx - sx*sx/n"), F.expr("syy - sy*sy/n"), F.expr("sxy - sx*sy/n")
    slope = F.when(vx > 1e-9, cxy / vx).otherwise(F.lit(0.0))
    fit = fit.select("row", slope.alias("slope"), F.sqrt(F.greatest(F.lit(0.0), vy - F.when(vx > 1e-9, cxy * cxy / vx).otherwise(F.lit(0.0))) / F.col("n")).alias("residual"))
    size = F.floor(F.log2("words")).cast("int")
    prose_like = F.expr(f"sentences >= {PROSE} and not open and filler = 0")
    return pages.select(*SMALL, prose_like.alias("reference")).join(fit, "row").withColumn("size", size)


def spam_scores(items: DataFrame, id_col: str = "item_id", url_col: str = "url", domain_col: str = "domain", text_col: str = "raw_content") -> DataFrame:
    """`curves` with `slope_z`, `residual_z` and `divergence` from prose of the language at comparable length."""
    return scores_of(written(curves(page_rows(items, id_col, url_col, domain_col, text_col)), "curves"))


def scores_of(page: DataFrame, least: int = 20) -> DataFrame:
    """Scores of written `curves`. Where a class has fewer than `least` prose pages the language's, the class's, then all prose stands in."""
    prose_pages = page.where("reference")
    stats = [F.count("*").alias("m"), F.avg("slope").alias("ms"), F.stddev_pop("slope").alias("ss"), F.avg("residual").alias("mr"), F.stddev_pop("residual").alias("sr"), F.array(*[F.avg(F.col("curve")[k]) for k in range(BINS)]).alias("mean")]
    # Languages x length classes (powers of two): a bound that doesn't grow with the data.
    near = prose_pages.groupBy("lang", "size").agg(*stats).where(F.col("m") >= least)
    lang = prose_pages.groupBy("lang").agg(*stats).where(F.col("m") >= least)
    every = prose_pages.groupBy("size").agg(*stats).where(F.col("m") >= least)
    whole = prose_pages.agg(*stats)
    cols = ["ms", "ss", "mr", "sr", "mean"]
    out = page
    for name, ref, keys in (("a", near, ["lang", "size"]), ("b", lang, ["lang"]), ("c", every, ["size"]), ("d", whole.withColumn("one", F.lit(1)), ["one"])):
        ref = ref.select(*keys, F.struct(*cols).alias(f"ref_{name}"))
        out = out.withColumn("one", F.lit(1)).join(F.broadcast(ref), keys, "left").drop("one")
    out = out.withColumn("ref", F.coalesce("ref_a", "ref_b", "ref_c", "ref_d")).drop("ref_a", "ref_b", "ref_c", "ref_d")
    z = lambda v, m, s, least: (F.col(v) - F.col(f"ref.{m}")) / F.greatest(F.col(f"ref.{s}"), F.lit(least))
    part = lambda a, b: F.when(a > 0, a * F.log(a / F.greatest(b, F.lit(0.002)))).otherwise(F.lit(0.0))
    kl = sum((part(F.col("curve")[k], F.col("ref.mean")[k]) for k in range(BINS)), F.lit(0.0))
    return out.select("*", z("slope", "ms", "ss", 0.05).alias("slope_z"), z("residual", "mr", "sr", 0.02).alias("residual_z"), kl.alias("divergence")).drop("ref")


def off_prose(z: float = 6.0, divergence: float = 0.25, spread: float = 10.0):
    """The condition on `scores_of` that a curve is not prose; short texts stray further by chance, as `spread` / words allows for."""
    return (F.abs("slope_z") > z) | (F.abs("residual_z") > z) | (F.col("divergence") > divergence + spread / F.col("words"))


def spam_pages(items: DataFrame, z: float = 6.0, divergence: float = 0.25, spread: float = 10.0, most_sentences: int | None = 1, id_col: str = "item_id", url_col: str = "url", domain_col: str = "domain", text_col: str = "raw_content") -> DataFrame:
    """(item_id) of the pages whose body is keywords, tags or links in place of sentences.

    A page is flagged when its slope or residual lies `z` deviations off same-language prose of its length class, or
    its curve diverges by more than `divergence` + `spread` / words (relative entropy), and `residue` doesn't tell it to be an error
    page, filler or an unfilled template. Of those, pages with more than `most_sentences` full sentences (None: no such check)
    are lists with running text and no spam. Without any prose no page is flagged.
    Null and empty pages and pages without body are never flagged. Rows that come twice give one row.
    """
    pages = page_rows(items, id_col, url_col, domain_col, text_col)
    off = scores_of(written(curves(pages), "curves")).where(off_prose(z, divergence, spread))
    if most_sentences is not None:
        off = off.where(F.col("sentences") <= most_sentences)
    off = written(off.select("row", "item_id"), "off-prose")
    left = residue.residue_of(pages, only=off.select("row")).select("item_id")
    return off.select("item_id").distinct().join(left, "item_id", "left_anti")

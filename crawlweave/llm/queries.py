"""Queries of the training-data operators; the driver adds them when this subpackage is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.functions.common import site_key, table
from crawlweave.llm import body, cuckoo, lines, mix, mojibake, residue, spam, topn, winnow


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "cdr_items"), min_docs=5)


def p1_stripped(spark: SparkSession, d: str) -> DataFrame:
    return lines.strip_repeated_lines(table(spark, d, "cdr_items"), min_docs=5)


def _form_types(spark: SparkSession, d: str) -> DataFrame:
    forms = table(spark, d, "forms")
    return forms.select(site_key(F.col("domain")).alias("domain"), "form_id", "url", F.explode("form").alias("form_type", "probability"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_form_types(spark, d), ["domain", "form_type"], "probability", "url", "form_id", 3).select("domain", "form_type", "form_id")


def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_form_types(spark, d), ["domain", "form_type"], "probability", "url", "form_id", 3)


def p2_skipping(spark: SparkSession, d: str) -> DataFrame:
    return topn.skipping_report(_form_types(spark, d), ["domain", "form_type"], "probability", "url", "form_id", 3)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "cdr_items"))


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(table(spark, d, "cdr_items")).select("item_id", "lang", "words", "sentences", "slope", "residual", "slope_z", "residual_z", "divergence")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    link = cuckoo.seen_before(table(spark, d, "links"), cuckoo.url_key(F.col("url")), "link_id")
    node = cuckoo.seen_before(table(spark, d, "nodes"), cuckoo.url_key(F.col("original_url")), "node_id")
    return link.select(F.lit("link").alias("rec_kind"), "rec_id").unionByName(node.select(F.lit("node").alias("rec_kind"), "rec_id"))


def p4_error_rate(spark: SparkSession, d: str) -> DataFrame:
    link = cuckoo.error_rate(table(spark, d, "links"), cuckoo.url_key(F.col("url")), "link_id")
    node = cuckoo.error_rate(table(spark, d, "nodes"), cuckoo.url_key(F.col("original_url")), "node_id")
    return link.withColumn("rec_kind", F.lit("link")).unionByName(node.withColumn("rec_kind", F.lit("node")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return body.body_lines(table(spark, d, "cdr_items"))


def p5_body(spark: SparkSession, d: str) -> DataFrame:
    return body.body_text(table(spark, d, "cdr_items")).select("item_id", "how", "body")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "cdr_items")).select("item_id")


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "cdr_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return winnow.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return winnow.leaked_items(winnow.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"))


def queries() -> dict:
    own = globals()
    return {k: own[k] for k in own if k[0] == "p" and k[1].isdigit() and callable(own[k])}

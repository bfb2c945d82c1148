"""Queries p7 to p9 for the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from varicohort.llm.mixing import mix
from varicohort.llm.packing import pack
from varicohort.llm.spans import shared_part, shared_spans
from varicohort.llm.tokens import token_sizes
from varicohort.session import can_broadcast, table, written


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "pack_sizes").where("capacity_tokens > 0")  # a fixed table of three rows
    capacities = [r["capacity_tokens"] for r in names.select("capacity_tokens").distinct().collect()]
    if not capacities:
        return spark.createDataFrame([], "pack_name string, capacity int, window string, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint, at bigint")
    placed = pack(token_sizes(table(spark, sf_dir, "documents"), ["doc_id"]), capacities)
    named = names.select("pack_name", F.col("capacity_tokens").alias("capacity"))
    return placed.join(F.broadcast(named) if can_broadcast(named) else named, "capacity").withColumnRenamed("piece_of", "doc_id")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every text, for every capacity of pack_sizes."""
    return _packed(spark, sf_dir).select("pack_name", F.col("window").alias("container"), "doc_id", "piece_no", "token_start", "n_tokens", F.col("at").alias("place"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers and the part of their space that is used."""
    per = _packed(spark, sf_dir).groupBy("pack_name", "capacity", "window").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy("pack_name", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("n_tokens"), (F.sum("used") / (F.count("*") * F.first("capacity"))).alias("fill"))


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every capacity: texts that were placed, and what must be 0: windows over capacity, windows with a gap or an overlap, texts of which a token is missing or twice, texts split without need."""
    placed = written(_packed(spark, sf_dir), "placed")
    per_window = placed.groupBy("pack_name", "capacity", "window").agg(F.sum("n_tokens").alias("used"), F.max(F.col("at") + F.col("n_tokens")).alias("end"), F.min("at").alias("start"))
    windows = per_window.groupBy("pack_name").agg(F.count_if(F.col("end") > F.col("capacity")).alias("n_overfull"), F.count_if((F.col("used") != F.col("end")) | (F.col("start") != 0)).alias("n_gaps"))
    sizes = token_sizes(table(spark, sf_dir, "documents"), ["doc_id"]).withColumnRenamed("n_tokens", "whole")
    per_text = placed.groupBy("pack_name", "capacity", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.countDistinct("piece_no").alias("numbers"), F.min("n_tokens").alias("least"))
    j = per_text.join(sizes, "doc_id", "left")
    texts = j.groupBy("pack_name").agg(F.count("*").alias("n_texts"), F.count_if(F.coalesce((F.col("got") != F.col("whole")) | (F.col("pieces") != F.col("numbers")), F.lit(True))).alias("n_lost"), F.count_if(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("whole") / F.col("capacity")))).alias("n_split"))
    return texts.join(windows, "pack_name")


def _mixture(spark: SparkSession, sf_dir: str, times: float | None = None):
    """The mixture; with ``times`` for a total of so many times the tokens of all documents, else the largest without shortfall."""
    sizes = token_sizes(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    if times is not None:
        sizes = written(sizes, "all-sizes")
    total = None if times is None else int(times * (sizes.agg(F.sum("n_tokens")).first()[0] or 0))
    return mix(sizes, table(spark, sf_dir, "mix_targets"), total)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with slot and number of the copy."""
    return _mixture(spark, sf_dir).chosen


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mixture(spark, sf_dir).shares


def p8_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares when as many tokens are asked for as all documents have: scarce sources stop at their caps."""
    return _mixture(spark, sf_dir, 1.0).shares


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mixture, rule, n) for the mixture without and with binding caps: targets that were reported, and what must be 0.

    Documents repeated beyond the cap or twice under one number; slots of two sources; sources further from what they
    owe than half a document; and, where no cap binds, sources whose share is off by more than a block.
    """
    sizes = written(token_sizes(table(spark, sf_dir, "documents"), ["doc_id"]), "check-sizes")
    longest = F.coalesce(sizes.agg(F.max("n_tokens")).scalar(), F.lit(0))
    out = []
    for times in (None, 1.0):
        m = _mixture(spark, sf_dir, times)
        s = m.shares
        count = lambda df, rule, cond: df.agg(F.count_if(cond).alias("n")).select(F.lit("default" if times is None else "capped").alias("mixture"), F.lit(rule).alias("rule"), "n")  # noqa: E731, B023
        per_doc = m.chosen.groupBy("source", "doc_id").agg(F.count("*").alias("c"), F.countDistinct("copy_no").alias("d"), F.max("copy_no").alias("top"))
        out.append(count(per_doc.join(s.select("source", "max_repeats"), "source"), "over cap", (F.col("c") != F.col("d")) | (F.col("top") > F.col("max_repeats"))))
        out.append(count(m.chosen.groupBy("slot").agg(F.countDistinct("source").alias("c")), "slots of two sources", F.col("c") > 1))
        out.append(count(s, "targets", F.col("max_repeats") > 0))
        owed = F.least("need_tokens", "available_tokens")
        out.append(count(s, "short", F.abs(F.col("n_tokens") - owed) * 2 > longest))
        if times is None:
            all_tokens = s.agg(F.sum("n_tokens")).scalar()
            out.append(count(s, "off", F.abs(F.col("actual_share") - F.col("share_if_available")) * all_tokens > m.block_tokens))
    return reduce(DataFrame.unionByName, out)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents")).distinct()


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is shared with others."""
    d = table(spark, sf_dir, "documents")
    return shared_part(d, shared_spans(d))


QUERIES = {f.__name__: f for f in (p7_packed, p7_fill, p7_check, p8_mix, p8_shares, p8_capped, p8_check, p9_found, p9_shared)}
_SPANS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
w AS (SELECT rid, doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT rid, doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM d)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT rid, doc_id, i - 1 AS i FROM w WHERE h IN (SELECT h FROM r)),
n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM m),
g AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM n),
s AS (SELECT rid, doc_id, CAST(min(i) AS INT) AS span_start, CAST(max(i) + 200 AS INT) AS span_end FROM g GROUP BY rid, doc_id, run)
"""
_TARGETS = "(SELECT count(DISTINCT lower(trim(source))) FROM mix_targets WHERE target_weight > 0 AND max_repeats > 0 AND trim(source) <> '')"
SQL: dict[str, str] = {
    # the rules that any packing and any mixture must keep
    "p7_check": "SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS n_texts, 0::BIGINT AS n_lost, 0::BIGINT AS n_split, 0::BIGINT AS n_overfull, 0::BIGINT AS n_gaps FROM pack_sizes",
    "p8_check": f"SELECT mixture, rule, CAST(CASE rule WHEN 'targets' THEN {_TARGETS} ELSE 0 END AS BIGINT) AS n FROM (VALUES ('default'), ('capped')) m(mixture), (VALUES ('over cap'), ('slots of two sources'), ('targets'), ('short'), ('off')) r(rule) WHERE mixture = 'default' OR rule <> 'off'",
    "p9_found": _SPANS + "SELECT DISTINCT doc_id, span_start, span_end FROM s",
    "p9_shared": _SPANS + """
SELECT o.doc_id, CAST(coalesce(length(o.text), 0) AS BIGINT) AS n_chars, coalesce(p.n, 0) AS n_spans, CAST(coalesce(p.c, 0) AS BIGINT) AS shared_chars, CASE WHEN length(o.text) > 0 THEN coalesce(p.c, 0) / length(o.text) ELSE 0.0 END AS shared_share
FROM documents o LEFT JOIN (SELECT doc_id, count(*) AS n, sum(span_end - span_start) AS c FROM s GROUP BY doc_id) p ON p.doc_id = o.doc_id WHERE o.doc_id IS NOT NULL""",
}

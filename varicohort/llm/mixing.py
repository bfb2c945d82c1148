"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is cut into blocks of equal tokens: its documents in shuffled order, repeated up to the cap, a block for every
``docs_per_block`` documents of mean size. Point i of a golden-ratio sequence, mapped through the cumulative weights, names
the source of slot i; the k-th slot of a source takes its k-th block, until the source has given its share. Every prefix of the
mixture is close to the weights, and every slot holds documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, log2

from pyspark.sql import Column, DataFrame, functions as F

from varicohort.operators.skew import running_total
from varicohort.session import can_broadcast, rows_table, written

GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class Mixture:
    chosen: DataFrame  # slot, source, doc_id, copy_no, n_tokens
    shares: DataFrame  # one row per target, and per source of documents without one
    block_tokens: int


def tidy_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def schedule(spark, n_slots: int, weights: list[tuple[str, float]], chunk: int = 1 << 16) -> DataFrame:
    """(slot, source, k): the source of each slot and the slot's rank within the source, from 0."""
    total = sum(w for _, w in weights)
    point = F.pmod(F.lit(0.5) + F.col("slot") * F.lit(GOLDEN), F.lit(1.0))
    source, upto = None, 0.0
    for name, w in weights:
        upto += w / total
        source = F.when(point < upto, name) if source is None else source.when(point < upto, name)
    source = source.otherwise(weights[-1][0])
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / chunk).alias("__chunk")).select("slot", "__chunk", source.alias("source"), F.lit(1).alias("__one"))
    return running_total(slots, ["source"], "__chunk", ["slot"], "__one", "k").select("slot", "source", "k")


def _tidy_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Weight and cap by source: weights of one source are added, the least cap holds. One number each per source."""
    s = tidy_source(F.col("source")).alias("s")
    rows = targets.where("target_weight > 0 AND max_repeats > 0").groupBy(s).agg(F.sum("target_weight").alias("w"), F.min("max_repeats").alias("c")).where("s IS NOT NULL AND s != ''")
    return {r["s"]: (float(r["w"]), int(r["c"])) for r in rows.collect()}


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, docs_per_block: int = 16, seed: int = 7, docs_per_bucket: int = 50_000) -> Mixture:
    """Choose documents (doc_id, source, n_tokens) so that each target source gives its share of all tokens.

    targets: source, target_weight, max_repeats (a bounded table with one row per source). Sources are compared
    trimmed and in lower case; weights of targets that agree are added, and their least cap holds. Targets with no
    tokens at all cannot contribute: their weight goes to the others in proportion, and the report says so; documents
    of sources without target are not used, and reported with target 0. ``total_tokens`` defaults to the largest total
    at which every source reaches its share within its repeats; if more is asked for, a source stops at its cap and the
    shares reached show it. A document occurs at most max_repeats times; texts of no tokens and null sizes never. The
    last document of a source is taken if most of it lies within the source's need. Repeated rows are documents of
    their own. The report also has need_tokens, what the total asks of a source, and available_tokens, what it could
    give within its cap; the source with the largest need_tokens / available_tokens bounds the mixture.
    """
    spark = sizes.sparkSession
    docs = written(sizes.where("n_tokens > 0").select("doc_id", tidy_source(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")), "mix-sizes")
    asked = _tidy_targets(targets)
    per_source = docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    stock = {r["source"]: (r["t"], r["n"]) for r in per_source.where(F.col("source").isin(list(asked))).collect()}
    usable = [(s, w) for s, (w, _) in sorted(asked.items()) if s in stock]
    weight = sum(w for _, w in usable)
    most = floor(min((stock[s][0] * asked[s][1] * weight / w for s, w in usable), default=0))
    total = most if total_tokens is None else total_tokens
    need = {s: min(floor(total * w / weight), stock[s][0] * asked[s][1]) for s, w in usable}
    copies = {s: min(asked[s][1], ceil(need[s] / stock[s][0])) for s in need}
    n_docs, n_tokens = sum(stock[s][1] for s in need), sum(stock[s][0] for s in need)
    block = max(1, ceil(docs_per_block * n_tokens / n_docs)) if n_docs else 1
    wanted = rows_table(spark, [(s, copies[s], stock[s][0], need[s]) for s in need if copies[s] > 0], "source string, copies int, stock bigint, need bigint")
    wanted = F.broadcast(wanted) if can_broadcast(wanted) else wanted
    # the shuffled order: documents by hash, cut into buckets by the hash's range
    buckets = max(1, ceil(max((n for _, n in stock.values()), default=1) / docs_per_bucket))
    order = docs.join(wanted, "source").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    order = order.withColumn("__h", F.xxhash64(F.lit(seed), "copy_no", "doc_id")).withColumn("__b", F.floor((F.shiftrightunsigned("__h", 33)) * F.lit(buckets) / F.lit(float(1 << 31))).cast("int"))
    order = running_total(order, ["source", "copy_no"], "__b", ["__h", "doc_id", "n_tokens"], "n_tokens", "before")
    order = order.withColumn("start", F.col("before") + (F.col("copy_no") - 1) * F.col("stock")).where(2 * F.col("start") + F.col("n_tokens") <= 2 * F.col("need"))
    cut = written(order.select("source", "doc_id", "copy_no", "n_tokens", F.floor(F.col("start") / F.lit(block)).cast("bigint").alias("block")), "mix-blocks")
    # a document longer than a block leaves blocks empty: the others are numbered through
    held = cut.select("source", "block").distinct().withColumn("__chunk", F.floor(F.col("block") / F.lit(1 << 16))).withColumn("__one", F.lit(1))
    numbered = running_total(held, ["source"], "__chunk", ["block"], "__one", "k").select("source", "block", "k")
    n_blocks = {r["source"]: r["n"] for r in held.groupBy("source").agg(F.count("*").alias("n")).collect()}  # one row a source
    plan = _slots_for(spark, n_blocks, usable)
    chosen = written(cut.join(numbered, ["source", "block"]).join(plan, ["source", "k"]).select("slot", "source", "doc_id", "copy_no", "n_tokens"), "mixture")
    got = chosen.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("copy_no").alias("c"))
    reached = {r["source"]: (r["t"], r["n"], r["c"]) for r in got.collect()}
    all_tokens = sum(t for t, _, _ in reached.values())
    whole = sum(w for w, _ in asked.values())
    rows = []
    for s, (w, cap) in sorted(asked.items()):
        t, n, c = reached.get(s, (0, 0, 0))
        has = stock.get(s, (0, 0))[0]
        rows.append((s, w / whole, w / weight if s in stock else 0.0, t / all_tokens if all_tokens else 0.0, t, n, c, cap, has, floor(total * w / weight) if s in stock else 0, has * cap))
    shares = rows_table(spark, rows, "source string, target_share double, share_if_available double, actual_share double, n_tokens bigint, n_chosen bigint, copies int, max_repeats int, stock_tokens bigint, need_tokens bigint, available_tokens bigint")
    zero = lambda t: F.lit(0).cast(t)
    unasked = per_source.where(F.col("source").isNull() | ~F.col("source").isin(list(asked)))
    unasked = unasked.select("source", *(zero("double").alias(c) for c in ("target_share", "share_if_available", "actual_share")), *(zero("bigint").alias(c) for c in ("n_tokens", "n_chosen")), *(zero("int").alias(c) for c in ("copies", "max_repeats")), F.col("t").alias("stock_tokens"), *(zero("bigint").alias(c) for c in ("need_tokens", "available_tokens")))
    return Mixture(chosen, shares.unionByName(unasked), block)


def _slots_for(spark, n_blocks: dict[str, int], usable: list[tuple[str, float]]) -> DataFrame:
    """(slot, source, k) with exactly the ranks that a source has blocks for; the sequence goes on until all have their slots."""
    limits = [(s, n_blocks[s]) for s, _ in usable if n_blocks.get(s)]
    if not limits:
        return schedule(spark, 0, [("", 1.0)])
    weight = sum(w for _, w in usable)
    # a stretch of the circle gets its share of the points within a few times the logarithm of their number
    n = max(ceil((n_blocks[s] + 2 + 3 * log2(n_blocks[s] + 2)) * weight / w) for s, w in usable if n_blocks.get(s))
    needed = rows_table(spark, limits, "source string, limit bigint")
    needed = F.broadcast(needed) if can_broadcast(needed) else needed
    while True:
        plan = written(schedule(spark, n, usable).join(needed, "source").where(F.col("k") < F.col("limit")).select("slot", "source", "k"), "slots")
        if plan.count() == sum(x for _, x in limits):
            return plan
        n *= 2

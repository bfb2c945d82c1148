"""History of changing attributes: consecutive snapshots are differenced, events become versions with their validity.

``snapshots_from_updates`` lays updates out as the snapshots that they lead through: every period opens with the state that the
period before left (step 0) and goes on in steps, one for each instant at which the key is updated within the period. Only keys
that a period touches have rows in it, as all others carry over unchanged. ``snapshot_changes`` compares every snapshot with the
one before by the null-safe full outer join of ``compare_snapshots``, all pairs in one join, and ``validity`` derives from the
united change events when each version was valid.

No step sees a whole key: steps are numbered within (key, period), and over the periods of a key there is one row each, of
which there are as many as the time axis has periods, whatever the number of updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from varicohort.session import written

PERIOD_US = 3_600 * 1_000_000  # an hour


def snapshots_from_updates(updates: DataFrame, key: str, at: str, order: list[str], old: str, new: str, begun: DataFrame, gone: str | None = None, period_us: int = PERIOD_US) -> DataFrame:
    """Snapshots (key, period, step, value, at, present, last_step, until, first) of each key.

    Several updates of a key at one instant are one step, with the last one's value in ``order``. ``begun`` has one row
    (key, at) per key with the time at which its first state, the first update's ``old``, began; it may lack a key (then
    ``at`` is null). An update with ``gone`` true takes the key out of the snapshots until its next update. Updates whose
    key or time is null are left out, repeated ones change nothing. ``until`` is the time of the next step within the
    period; ``first`` marks the snapshot in which the key begins.
    """
    u = updates.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    u = u.withColumn("__gone", F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).withColumn("period", F.floor(F.col(at) / F.lit(period_us)))
    last, first = F.struct(*order, new, "__gone"), F.struct(*order, old)
    instants = u.groupBy(key, "period", at).agg(F.max(last).alias("l"), F.min(first).getField(old).alias("before"))
    here = Window.partitionBy(key, "period")
    w = here.orderBy(at)
    state = F.struct(F.col("l")[new].alias("value"), (~F.col("l")["__gone"]).alias("present"))
    steps = instants.select(key, "period", F.row_number().over(w).alias("step"), state.alias("s"), at, F.lead(at).over(w).alias("until"), "before", F.max(F.struct(at, state.alias("s"))).over(here)["s"].alias("exit"), F.count("*").over(here).cast("int").alias("last_step"))
    steps = written(steps, "steps")  # read several times
    # one row a period: what it opens with is what the period before left
    opened = steps.where("step = 1").withColumn("left", F.lag("exit").over(Window.partitionBy(key).orderBy("period"))).withColumn("first", F.col("left").isNull())
    opened = opened.withColumnRenamed(at, "next_at").join(begun.select(F.col(key), F.col(at)), key, "left")
    opening = opened.select(
        key, "period", F.lit(0).alias("step"), F.when(F.col("first"), F.col("before")).otherwise(F.col("left.value")).alias("value"), F.when(F.col("first"), F.col(at)).alias(at),
        F.when(F.col("first"), True).otherwise(F.col("left.present")).alias("present"), "last_step", F.col("next_at").alias("until"), "first",
    )
    return opening.unionByName(steps.select(key, "period", "step", "s.value", at, "s.present", "last_step", "until", F.lit(False).alias("first")))


def compare_snapshots(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], at: Column) -> DataFrame:
    """Events (keys, kind, values, at) between snapshots: kind inserted, changed or deleted.

    A null-safe full outer join: keys are compared null-safely and must be unique within a snapshot, as are values, so
    that a change from or to null is a change as well; ``values`` of a deleted key are null. ``at`` may use the columns
    of both sides under the prefixes a_ (before) and b_ (after). Equal values give no event.
    """
    a = before.select(*(F.col(c).alias(f"a_{c}") for c in before.columns), F.lit(True).alias("a_here"))
    b = after.select(*(F.col(c).alias(f"b_{c}") for c in after.columns), F.lit(True).alias("b_here"))
    on = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in keys]
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    kind = F.when(F.col("a_here").isNull(), "inserted").when(F.col("b_here").isNull(), "deleted").when(~same, "changed")
    picked = [F.when(F.col("b_here"), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for c in keys]
    return a.join(b, on, "full_outer").select(*picked, kind.alias("kind"), *(F.col(f"b_{c}").alias(c) for c in values), at.alias("at")).where(F.col("kind").isNotNull())


def snapshot_changes(snapshots: DataFrame, key: str, value: str = "value", at: str = "at") -> DataFrame:
    """The united change events (key, period, step, kind, value, at) of all consecutive snapshots.

    Every snapshot but the last of a period comes before the next step; every one but the opening ones comes after, and
    so does the one in which a key begins, before which there is nothing.
    """
    names = [key, "period", "step", value, at, "until"]
    before = snapshots.where("present AND step < last_step").select(*names).withColumn("step", F.col("step") + 1)
    after = snapshots.where("present AND (step > 0 OR first)").select(*names)
    return compare_snapshots(before, after, [key, "period", "step"], [value], F.when(F.col("b_here"), F.col(f"b_{at}")).otherwise(F.col("a_until"))).withColumnRenamed("at", at)


def validity(events: DataFrame, key: str, at: str = "at") -> DataFrame:
    """Versions (key, value, valid_from, valid_to, inserted): each holds until the key's next event; the last has no end.

    events: key, period, step, kind, value, at. A deletion ends the version before it and begins none; ``inserted``
    marks the versions before which the key was not there. The time of the next event comes from ``lead`` within a
    period, for the last event of a period from ``lead`` over the first times of the key's periods.
    """
    w = Window.partitionBy(key, "period").orderBy("step")
    e = events.withColumn("__next", F.lead(at).over(w)).withColumn("__more", F.lead(F.lit(True)).over(w).isNotNull()).withColumn("__first", F.first(at).over(w))
    last = e.where("NOT __more").withColumn("__next", F.lead("__first").over(Window.partitionBy(key).orderBy("period")))
    both = e.where("__more").unionByName(last).where("kind != 'deleted'")
    return both.select(key, "value", F.col(at).alias("valid_from"), F.col("__next").alias("valid_to"), (F.col("kind") == "inserted").alias("inserted"))

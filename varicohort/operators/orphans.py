"""References to records that do not exist, or not yet, per table and month.

The keys of a reference may be partly null. Rows are grouped by which of them are null (the mask); the rows of each
mask are anti-joined on the columns that they have, as far as the declared match semantics ask for it.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

MATCHES = ("simple", "partial", "full")


def orphans(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str], match: str = "simple", child_at: str | None = None, parent_from: str | None = None) -> DataFrame:
    """The rows of ``child`` whose reference leads nowhere, with all their columns.

    match as in SQL: ``simple``, a null in any key column makes the row fine; ``partial``, the columns that are not
    null must agree with some parent; ``full``, all or none of the columns must be null. All null is always fine.
    With ``child_at`` and ``parent_from`` a parent counts from its time on: it must not be later than the row's own
    time; a parent without time always counted, and for a row without time any parent will do. Parents may be
    repeated: the earliest one counts. Null keys of parents match nothing.
    """
    if match not in MATCHES:
        raise ValueError(f"match is one of {', '.join(MATCHES)}")
    names = [f"__p{i}" for i in range(len(keys))]
    since = F.col(parent_from) if parent_from else F.lit(None).cast("bigint")
    target = parent.select(*(F.col(c).alias(n) for c, n in zip(parent_keys, names)), since.alias("__since"))
    found = []
    for mask in product((False, True), repeat=len(keys)):
        rows = child.where(reduce(lambda a, b: a & b, (F.col(k).isNull() if null else F.col(k).isNotNull() for k, null in zip(keys, mask))))
        if all(mask) or any(mask) and match == "simple":
            continue
        if any(mask) and match == "full":
            found.append(rows)
            continue
        there = [n for n, null in zip(names, mask) if not null]
        # null sorts first: a parent without time is the earliest
        least = target.where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in there))).groupBy(*there).agg(F.when(F.count("*") == F.count("__since"), F.min("__since")).alias("__since"))
        on: Column = reduce(lambda a, b: a & b, (F.col(k) == F.col(n) for k, n in zip([k for k, null in zip(keys, mask) if not null], there)))
        if child_at and parent_from:
            on = on & (F.col(child_at).isNull() | F.col("__since").isNull() | (F.col("__since") <= F.col(child_at)))
        found.append(rows.join(least, on, "left_anti"))
    return reduce(DataFrame.unionByName, found)


def month_of(us: Column) -> Column:
    """``YYYY-MM`` in UTC of microseconds since 1970; ``unknown`` for null."""
    days = F.floor(us / F.lit(86_400_000_000)).cast("int")
    return F.coalesce(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM"), F.lit("unknown"))

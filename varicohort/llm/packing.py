"""Filling containers of fixed capacity: bounded-space online packing.

Every partition keeps a fixed number of open windows per capacity. An item goes into the window in which the least space
is left after it (best fit); if it fits in none, the fullest window is emitted and a new one opened. The windows still
open at the end of the partitions are the leftovers: they are items themselves, packed again with fewer partitions level
by level until one partition is left, so that no step sees more than a bounded share of them.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from varicohort.session import parallelism, written

PLACED = "capacity int, window string, piece_of bigint, piece_no int, token_start bigint, n_tokens bigint, at bigint, leftover boolean"


class Packer:
    """Open windows of one capacity: ``put`` gives the window and offset of an item."""

    def __init__(self, capacity: int, open_windows: int, prefix: str):
        self.capacity, self.most, self.prefix = capacity, open_windows, prefix
        self.free: list[tuple[int, int]] = []  # (space left, window), sorted
        self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        k = bisect.bisect_left(self.free, (size, -1))
        if k == len(self.free):
            if len(self.free) >= self.most:
                self.free.pop(0)  # the fullest is emitted
            space, window, self.made = self.capacity, self.made, self.made + 1
        else:
            space, window = self.free.pop(k)
        if space > size:
            bisect.insort(self.free, (space - size, window))
        return window, self.capacity - space

    def open(self) -> set[int]:
        return {w for _, w in self.free}

    def name(self, window: int) -> str:
        return f"{self.prefix}-{window}"


def _pack_items(capacities: list[int], open_windows: int):
    """Items (doc_id, n_tokens) to places, for all capacities in one go."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packers = {c: Packer(c, open_windows, f"{c}-0-{part}") for c in capacities}
        # a window may still be open when its items have been seen: rows wait until the end, in compact columns
        rows: dict[int, list[tuple]] = {c: [] for c in capacities}
        for b in batches:
            for doc, size in zip(b["doc_id"].tolist(), b["n_tokens"].tolist()):
                for c, p in packers.items():
                    start = piece = 0
                    while True:
                        n = min(size - start, c)
                        w, at = p.put(n)
                        rows[c].append((w, doc, piece, start, n, at))
                        start, piece = start + n, piece + 1
                        if start >= size:
                            break
            for c, p in packers.items():  # windows that are closed by now go out
                still = p.open()
                done = [r for r in rows[c] if r[0] not in still]
                if done:
                    rows[c] = [r for r in rows[c] if r[0] in still]
                    yield _frame(c, p, done, False)
        for c, p in packers.items():
            if rows[c]:
                yield _frame(c, p, rows[c], True)

    return run


def _frame(capacity: int, packer: Packer, rows: list[tuple], leftover: bool) -> pd.DataFrame:
    w, doc, piece, start, n, at = zip(*rows)
    return pd.DataFrame({"capacity": np.int32(capacity), "window": [packer.name(x) for x in w], "piece_of": doc, "piece_no": np.array(piece, np.int32), "token_start": start, "n_tokens": n, "at": at, "leftover": leftover})


def _merge_windows(level: int, open_windows: int, last: bool):
    """Leftover windows (capacity, window, used) to the windows that they are merged into."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packers: dict[int, Packer] = {}
        out: dict[int, list[tuple]] = {}
        for b in batches:
            for c, name, used in zip(b["capacity"].tolist(), b["window"].tolist(), b["used"].tolist()):
                p = packers.setdefault(c, Packer(c, 1 << 60 if last else open_windows, f"{c}-{level}-{part}"))
                out.setdefault(c, []).append((name, used, *p.put(used)))
        for c, rows in out.items():
            p, still = packers[c], packers[c].open()
            name, used, w, at = zip(*rows)
            yield pd.DataFrame({"capacity": np.int32(c), "window": name, "into": [p.name(x) for x in w], "shift": at, "leftover": [x in still and not last for x in w]})

    return run


def pack(sizes: DataFrame, capacities: list[int], open_windows: int = 128, items_per_partition: int = 100_000, windows_per_partition: int = 50_000) -> DataFrame:
    """(capacity, window, piece_of, piece_no, token_start, n_tokens, at): where every item lies in each capacity.

    sizes: doc_id and n_tokens; ``at`` is the offset in the window. An item larger than the capacity is split into
    pieces of the whole capacity and a rest; nothing else is split. Items of size 0 get a place of width 0; null ids
    and repeated rows are items like any other, null sizes are left out. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    if not capacities or min(capacities) <= 0:
        raise ValueError("capacities are positive numbers")
    sizes = written(sizes.where(F.col("n_tokens").isNotNull()).select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")), "sizes")
    n = sizes.count()
    parts = max(1, ceil(n / items_per_partition), min(parallelism(spark), n // 2000))
    # by hash: every partition gets the same mixture of sizes; the order makes the result repeatable
    spread = sizes.repartition(parts, F.xxhash64("doc_id", "n_tokens")).sortWithinPartitions(F.xxhash64("doc_id", "n_tokens"), "doc_id", "n_tokens")
    placed = written(spread.mapInPandas(_pack_items(sorted(set(capacities)), open_windows), PLACED), "packed")
    result = placed.where("not leftover").drop("leftover")
    open_rows = placed.where("leftover").drop("leftover")
    level = 1
    while True:
        windows = open_rows.groupBy("capacity", "window").agg(F.sum("n_tokens").alias("used"))
        windows = written(windows, "leftovers")
        count = windows.count()
        parts = ceil(count / windows_per_partition)
        last = parts <= 1
        # the largest first makes best fit tight
        moved = windows.repartition(max(1, parts), F.xxhash64("window")).sortWithinPartitions("capacity", F.desc("used"), "window").mapInPandas(_merge_windows(level, open_windows, last), "capacity int, window string, `into` string, shift bigint, leftover boolean")
        moved = written(moved, "merged")
        rows = open_rows.join(moved.drop("capacity"), "window").withColumn("at", F.col("at") + F.col("shift")).drop("window", "shift").withColumnRenamed("into", "window")
        result = result.unionByName(rows.where("not leftover").drop("leftover"))
        if last:
            return result
        open_rows, level = written(rows.where("leftover").drop("leftover"), "open"), level + 1

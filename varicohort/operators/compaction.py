"""Many small files into a few well-sized ones, without losing a record or keeping one twice.

The unit of work is a *lot*: all small files whose family (here sample and chromosome) hashes to one slot. Records that
can be equal lie in one family, hence in one lot, so that a single shuffle of the records finds every repeat. Lots, sized in
bytes, are put on a fixed number of shelves by longest-first scheduling with a least-loaded heap; a shelf is one output group, or
``n_sub`` equal ones if the data asks for more groups than shelves. Each group is streamed, sorted, through pyarrow
into files that end when they have ``file_bytes``; repeats go to files of their own, so that nothing is dropped
unseen. Counts and id sums of the written files are compared with the input, and only then is the manifest published by a
rename.

The number of files follows from bytes alone. The driver holds at most ``SLOTS`` loads whatever the input is; the list of
written files is a table. A lot larger than a shelf is cut by content, which keeps equal records together, and a single
record that fills more than a file is spread by its id: its smallest file is then known from an aggregation beforehand.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from varicohort.session import fresh_path, written

REPORT = "part_group int, kind string, path string, rows long, id_sum decimal(38,0), bytes long"
KINDS = ("kept", "repeats")
SLOTS = 16_384
SHELVES = 1_024
ROWS_PER_ROW_GROUP = 131_072
FILE_BYTES = 64 << 20
MOST_TASKS = 32_768
HOT_ON_DRIVER = 100_000


@dataclass(frozen=True)
class Compaction:
    """What a finished run published: the folder, the manifest, the list of files and the two kinds of records."""

    folder: str
    manifest_path: str
    manifest: dict
    files: DataFrame
    kept: DataFrame
    repeats: DataFrame


def longest_first(sizes: dict, n_groups: int) -> dict:
    """Assign items to groups: the largest first, each to the group with the least so far. Ties go by key."""
    heap = [(0, g) for g in range(n_groups)]
    placed = {}
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, g = heapq.heappop(heap)
        placed[key] = g
        heapq.heappush(heap, (load + size, g))
    return placed


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _agree(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Element-wise equality in which null agrees with null, and NaN with NaN."""
    same = pc.fill_null(pc.equal(a, b), False)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    if pa.types.is_floating(a.type):
        both = pc.or_(both, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return pc.or_(same, both).to_numpy(zero_copy_only=False)


class _Files:
    """The files of one group and kind. A file gets its name when it is whole, so a task that runs again replaces equal ones."""

    def __init__(self, where: pafs.FileSystem, base: str, uri: str, kind: str, group: int, attempt: int, id_col: str, file_bytes: int):
        self.fs, self.base, self.uri, self.kind, self.group, self.attempt = where, base, uri, kind, group, attempt
        self.id_col, self.file_bytes = id_col, file_bytes
        self.waiting: list[pa.RecordBatch] = []
        self.n_waiting = self.rows = self.id_sum = self.part = 0
        self.writer: pq.ParquetWriter | None = None
        self.done: list[dict] = []

    def add(self, batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            self.waiting.append(batch)
            self.n_waiting += batch.num_rows
            if self.n_waiting >= ROWS_PER_ROW_GROUP:
                self._flush()

    def _flush(self) -> None:
        if not self.waiting:
            return
        t = pa.Table.from_batches(self.waiting).combine_chunks()
        self.waiting, self.n_waiting = [], 0
        if self.writer is None:
            self.fs.create_dir(f"{self.base}/_parts", recursive=True)
            self.fs.create_dir(f"{self.base}/{self.kind}", recursive=True)
            self.path = f"{self.base}/_parts/{self.kind}-{self.group}-{self.part}-{self.attempt}"
            self.sink = self.fs.open_output_stream(self.path)
            self.writer = pq.ParquetWriter(self.sink, t.schema, compression="zstd")
        self.writer.write_table(t, row_group_size=t.num_rows)
        self.rows += t.num_rows
        self.id_sum += int(pc.sum(t[self.id_col].cast(pa.decimal128(38, 0))).as_py() or 0)
        if self.sink.tell() >= self.file_bytes:
            self._finish()

    def _finish(self) -> None:
        self.writer.close()
        self.sink.close()
        stored = pq.read_metadata(self.path, filesystem=self.fs).num_rows
        if stored != self.rows:
            raise OSError(f"{self.path} holds {stored} rows, {self.rows} were written")
        size, name = self.fs.get_file_info(self.path).size, f"{self.kind}/group-{self.group:07d}-{self.part:04d}.parquet"
        self.fs.move(self.path, f"{self.base}/{name}")
        self.done.append({"part_group": self.group, "kind": self.kind, "path": f"{self.uri}/{name}", "rows": stored, "id_sum": self.id_sum, "bytes": size})
        self.writer, self.rows, self.id_sum, self.part = None, 0, 0, self.part + 1

    def close(self) -> list[dict]:
        self._flush()
        if self.writer is not None:
            self._finish()
        return self.done


class _Group:
    """Tells kept records and repeats of one group apart; the records come sorted by content, then by file."""

    def __init__(self, folder: str, group: int, attempt: int, content: list[str], id_col: str, file_col: str, file_bytes: int):
        where, base = _open(folder)
        self.content, self.id_col, self.file_col, self.group = content, id_col, file_col, group
        self.files = {k: _Files(where, base, folder, k, group, attempt, id_col, file_bytes) for k in KINDS}
        self.last: pa.RecordBatch | None = None
        self.first_file: int | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        if not n:
            return
        given, batch = batch["__first"], batch.drop_columns(["__first"])  # known beforehand for records that are spread
        joined = pa.Table.from_batches([b for b in (self.last, batch) if b is not None]).combine_chunks()
        carried = joined.num_rows - n
        same = np.ones(joined.num_rows - 1, bool)
        for c in self.content:
            col = joined[c].combine_chunks()
            same &= _agree(col[1:], col[:-1])
        starts = np.concatenate([[True], ~same]) if not carried else ~same
        files = batch[self.file_col]
        known = files.is_valid().to_numpy(zero_copy_only=False)
        ids = files.fill_null(0).to_numpy(zero_copy_only=False)
        run = np.cumsum(starts)  # run 0 goes on from the batch before
        heads = np.flatnonzero(starts)
        first = np.zeros(int(run[-1]) + 1, np.int64)
        has = np.zeros(int(run[-1]) + 1, bool)
        first[run[heads]], has[run[heads]] = ids[heads], known[heads]
        if self.first_file is not None:
            first[0], has[0] = self.first_file, True
        repeat = known & has[run] & (ids > first[run])
        told = given.is_valid().to_numpy(zero_copy_only=False)
        if told.any():
            repeat = np.where(told, known & (ids > given.fill_null(0).to_numpy(zero_copy_only=False)), repeat)
        self.first_file = int(first[-1]) if has[-1] else None
        self.last = batch.slice(n - 1, 1)
        self.files["kept"].add(batch.filter(pa.array(~repeat)))
        self.files["repeats"].add(batch.filter(pa.array(repeat)).select([self.id_col, self.file_col]))

    def close(self) -> list[dict]:
        return [r for f in self.files.values() for r in f.close()]


def _stream(folder: str, content: list[str], id_col: str, file_col: str, file_bytes: int):
    def run(batches):
        import decimal

        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        now: _Group | None = None
        done: list[dict] = []
        for batch in batches:
            groups = batch["__group"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(groups)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is None or now.group != int(groups[a]):
                    if now is not None:
                        done += now.close()
                    now = _Group(folder, int(groups[a]), attempt, content, id_col, file_col, file_bytes)
                now.add(batch.slice(a, b - a).drop_columns(["__group"]))
        if now is not None:
            done += now.close()
        for r in done:
            r["id_sum"] = decimal.Decimal(r["id_sum"])
        cols = {f: [r[f] for r in done] for f in ("part_group", "kind", "path", "rows", "id_sum", "bytes")}
        types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types)], names=list(cols))

    return run


def _numbers(values: list[int]) -> Column:
    """An array of numbers as one literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<int>")


def _tell_first(rows: DataFrame, heavy: list[int], content: list[str], file_col: str, rows_per_file: int) -> DataFrame:
    """``__first``, the smallest file of a record that fills more than a file by itself; null for all others.

    Such records lie in ``heavy`` slots; they are counted there, combined before the shuffle. There are fewer of them
    than output files; beyond ``HOT_ON_DRIVER`` they are not broadcast but met by a join whose keys are salted.
    """
    none = F.lit(None).cast(rows.schema[file_col].dataType)
    if not heavy:
        return rows.withColumn("__first", none)
    flags = [0] * SLOTS
    for s in heavy:
        flags[s] = 1
    names = [f"__c{i}" for i in range(len(content))]
    counted = rows.where(F.get(_numbers(flags), F.col("__slot")) == 1).groupBy(*(F.col(c).alias(n) for c, n in zip(content, names))).agg(F.count("*").alias("__n"), F.min(file_col).alias("__first"))
    hot = written(counted.where(F.col("__n") > rows_per_file), "hot-records")
    n_hot, most = hot.agg(F.count("*"), F.max("__n")).first()
    if not n_hot:
        return rows.withColumn("__first", none)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(content, names)))
    if n_hot <= HOT_ON_DRIVER:
        return rows.join(F.broadcast(hot.drop("__n")), same, "left").drop(*names)
    salts = ceil(most / rows_per_file)
    salted = hot.drop("__n").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = F.pmod(F.xxhash64("__id", file_col), F.lit(salts)).cast("int")
    return rows.join(salted, same & (mine == F.col("__salt")), "left").drop(*names, "__salt")


def compact(
    records: DataFrame,
    content: dict[str, Column],
    id_col: str,
    file_col: str,
    family: list[str],
    row_bytes: float | None = None,
    file_bytes: int = FILE_BYTES,
    shelves: int = SHELVES,
) -> Compaction:
    """Consolidate ``records`` (one row per record and the small file it lies in).

    content: name and expression of the columns whose equality (null agrees with null) makes two records the same;
    family: those of them that every file has in common. Of equal records the ones in the file with the smallest id
    are kept, also if that file repeats them; equal ones in files with larger ids go to ``repeats``. A record without
    file id is kept and makes no other one a repeat. An empty table gives an empty manifest; columns of other names
    are not read. ``row_bytes`` is what a record takes in a file (default: the size of the scan over its rows);
    with it, ``file_bytes`` gives the number of groups, and no file is larger by more than a row group.
    """
    spark = records.sparkSession
    rows = records.select(*(e.alias(c) for c, e in content.items()), F.col(id_col).alias("__id"), F.col(file_col))
    rows = rows.withColumn("__slot", F.pmod(F.xxhash64(*family), F.lit(SLOTS)).cast("int"))
    stats = rows.groupBy("__slot").agg(F.count("*").alias("n"), F.sum(F.col("__id").cast("decimal(38,0)")).alias("ids")).collect()  # at most SLOTS rows
    total, ids = sum(r["n"] for r in stats), sum(int(r["ids"] or 0) for r in stats)
    if row_bytes is None or row_bytes <= 0:
        row_bytes = max(1.0, int(str(records._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / max(1, total))
    n_groups = max(1, ceil(total * row_bytes / file_bytes))
    n_shelves = min(n_groups, shelves)
    n_sub = ceil(n_groups / n_shelves)
    loads = {r["__slot"]: r["n"] * row_bytes for r in stats}
    shelf = total * row_bytes / n_shelves
    pieces = {s: ceil(4 * x / shelf) if x > shelf else 1 for s, x in loads.items()}
    placed = longest_first({(s, k): x / pieces[s] for s, x in loads.items() for k in range(pieces[s])}, n_shelves)
    starts, flat = [0] * SLOTS, []
    for s in sorted(pieces):
        starts[s] = len(flat)
        flat += [placed[s, k] for k in range(pieces[s])]
    heavy = [s for s, x in loads.items() if x > max(file_bytes, 2 * total * row_bytes / SLOTS)]
    rows_per_file = max(1, int(file_bytes / row_bytes))
    rows = _tell_first(rows, heavy, list(content), file_col, rows_per_file)
    # equal records stay together, but for those that are spread by their id
    spread = F.when(F.col("__first").isNull(), F.xxhash64(*content)).otherwise(F.xxhash64("__id", F.lit("spread")))
    rows = rows.withColumn("__spread", spread)
    piece = F.pmod(F.col("__spread"), F.get(_numbers([pieces.get(s, 1) for s in range(SLOTS)]), F.col("__slot")).cast("bigint")).cast("int")
    on_shelf = F.get(_numbers(flat), F.get(_numbers(starts), F.col("__slot")) + piece)
    sub = F.pmod(F.shiftrightunsigned("__spread", 20), F.lit(n_sub)).cast("int")
    rows = rows.withColumn("__group", on_shelf * F.lit(n_sub) + sub).drop("__slot", "__spread").withColumnRenamed("__id", id_col)
    folder = fresh_path(spark, "compacted")
    n_tasks = min(n_shelves * n_sub, MOST_TASKS)
    files = written(
        rows.repartitionById(n_tasks, F.pmod(F.col("__group"), F.lit(n_tasks)))
        .sortWithinPartitions("__group", *content, F.col(file_col).asc_nulls_last(), id_col)
        .mapInArrow(_stream(folder, list(content), id_col, file_col, file_bytes), REPORT),
        "compacted-files",
    )
    got = {r["kind"]: r for r in files.groupBy("kind").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("id_sum").alias("ids"), F.sum("bytes").alias("bytes")).collect()}
    if sum(r["rows"] for r in got.values()) != total or sum(int(r["ids"]) for r in got.values()) != ids:
        raise OSError(f"{total} records were read and {sum(r['rows'] for r in got.values())} written; the manifest is not published")
    manifest = {"rows_read": total, "groups": n_shelves * n_sub, "row_bytes": row_bytes, "file_bytes": file_bytes, "files": files.inputFiles()[:1] and files.inputFiles()[0].rpartition("/")[0]}
    for k in KINDS:
        manifest |= {f"{x}_{k}": int(got[k][x]) if k in got else 0 for x in ("rows", "files", "bytes")}
    where, base = _open(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/_manifest.tmp") as f:
        f.write(json.dumps(manifest).encode())
    where.move(f"{base}/_manifest.tmp", f"{base}/manifest.json")

    def read(kind: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{kind}") if kind in got else spark.createDataFrame([], schema)

    kept_schema = records.select(*(e.alias(c) for c, e in content.items()), id_col, file_col).schema
    return Compaction(folder, f"{folder}/manifest.json", manifest, files, read("kept", kept_schema), read("repeats", records.select(id_col, file_col).schema))

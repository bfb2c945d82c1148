"""Session settings, table access and the folder that all executors share."""

from __future__ import annotations

import gzip
import io
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "varicohort", **conf: str) -> SparkSession:
    """A session for tests and the command line; on a cluster use the session that is there."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_setting(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that all executors share (``spark.checkpoint.dir``).

    A temporary folder stands in for it only where the setting is absent and the master is local.
    """
    where = _checkpoint_setting(spark)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="varicohort-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where if "://" in where else "file://" + where


def fresh_path(spark: SparkSession, stem: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def written(df: DataFrame, stem: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, stem)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Removes, at its end, everything that ``fresh_path`` named within it: for results that have been taken by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for p in _SCOPES.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def local_table(df: DataFrame) -> DataFrame:
    """``df`` as a local relation; only for tables whose size was checked."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def write_lines(lines: DataFrame, header: list[str], output, sort: list | None = None) -> None:
    """One text file of ``header`` and the column ``line`` in the order of ``sort``, to a path, a URI or an open text file.

    Parts are sorted and written by the executors to the shared folder; the driver only joins their bytes, in order.
    A path that ends in .gz or .bgz is compressed.
    """
    spark = lines.sparkSession
    with scratch(spark):
        folder = fresh_path(spark, "lines")
        (lines.orderBy(*sort) if sort else lines).select("line").write.text(folder)
        where, base = pafs.FileSystem.from_uri(folder)
        parts = sorted(f.path for f in where.get_file_info(pafs.FileSelector(base)) if f.base_name.startswith("part-"))
        if hasattr(output, "write"):
            output.write("".join(h + "\n" for h in header))
            for p in parts:
                with where.open_input_stream(p) as f, io.TextIOWrapper(f, encoding="utf-8", newline="") as text:
                    shutil.copyfileobj(text, output)
            return
        to, path = pafs.FileSystem.from_uri(output if "://" in output else "file://" + os.path.abspath(output))
        raw = to.open_output_stream(path, compression=None)
        out = gzip.GzipFile(fileobj=raw, mode="wb") if path.endswith((".gz", ".bgz")) else raw
        out.write("".join(h + "\n" for h in header).encode())
        for p in parts:
            with where.open_input_stream(p) as f:
                while block := f.read(1 << 22):
                    out.write(block)
        out.close()
        if out is not raw:
            raw.close()


def parallelism(spark: SparkSession) -> int:
    """Tasks that run at once; a floor for the number of pieces, never a cap."""
    return max(2, spark.sparkContext.defaultParallelism)


def can_broadcast(df: DataFrame, max_bytes: int = 32 << 20) -> bool:
    """True if the optimizer's size estimate proves that ``df`` is small enough to send to every executor."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= max_bytes


def rows_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of Python values as a local relation, whose size the optimizer knows."""
    import pyarrow as pa

    fields = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(fields)
    cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)]
    return spark.createDataFrame(pa.Table.from_arrays(cols, schema=shape))

"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings every job relies on.
CORE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # keep the partial top-k (WindowGroupLimit) for per-source samples of
    # SAMPLE_SIZE rows; the default threshold (1000) would drop it
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(app: str = "millstone", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in CORE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in CORE_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    On a cluster this is ``spark.checkpoint.dir`` as the cluster sets it.
    Only when it is unset (local tests) a fresh scratch folder is created.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="millstone-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base.replace("file:", ""), name) if base.startswith("file:") else f"{base.rstrip('/')}/{name}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: cuts lineage (a lost executor recomputes from the files, not from
    the raw sources) and avoids evaluating expensive expressions per consumer."""
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"millstone/{name}-{uuid.uuid4().hex[:12]}")
    if (made := _MADE.get()) is not None:
        made.append((spark, path))
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_MADE: ContextVar[list | None] = ContextVar("tables that materialize has written", default=None)


def materialize_last(make, name: str):
    """``materialize`` the table that ``make()`` returns and remove the tables that ``make`` has materialized on the way
    to it: nothing reads them again."""
    token = _MADE.set(made := [])
    try:
        df = make()
    finally:
        _MADE.reset(token)
    out = materialize(df, name)
    for spark, path in made:
        drop_path(spark, path)
    return out


@contextmanager
def tables_dropped():
    """Tables that ``materialize`` writes in here are removed at the end: nothing reads them afterwards."""
    token = _MADE.set(made := [])
    try:
        yield
    finally:
        _MADE.reset(token)
        for spark, path in made:
            drop_path(spark, path)


@contextmanager
def shuffles_freed(spark):
    """Jobs in here remove their shuffle files as they end, not when the driver happens to collect its garbage: for
    tables that are written and read back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _file(spark, path: str):
    """(file system, path) of the JVM, for any scheme that Spark can open."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark, path: str) -> bool:
    fs, p = _file(spark, path)
    return bool(fs.exists(p))


def single_file(spark, path: str) -> tuple[str, str] | None:
    """Folder and name of ``path`` if it is one file; ``None`` for a folder, a pattern or nothing."""
    fs, p = _file(spark, path)
    return (p.getParent().toString(), p.getName()) if fs.exists(p) and fs.getFileStatus(p).isFile() else None


def drop_path(spark, path: str) -> None:
    """Remove an intermediate table that this process has written and read for the last time."""
    fs, p = _file(spark, path)
    fs.delete(p, True)


def write_text(spark, path: str, text: str) -> None:
    """Write one small file, replacing it, where any process of the cluster can read it."""
    fs, p = _file(spark, path)
    fs.setWriteChecksum(False)  # no side file that goes stale when another program writes the file anew
    try:
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
    finally:
        fs.setWriteChecksum(True)


def read_text(spark, path: str) -> str | None:
    """The text of one small file, ``None`` when it is absent."""
    return None if not path_exists(spark, path) else bytes(
        spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make ``millstone`` importable in Python workers (Arrow UDFs, grouped
    state functions) by adding a zip of the package to the session."""
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    # a cluster that installs the package on executors (or submits it with
    # --py-files) turns this off
    if spark.conf.get("spark.millstone.shipPackage", "true").lower() == "false":
        _SHIPPED.add(key)
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # the zip is code on the driver; addPyFile serves it to the executors
    out = os.path.join(tempfile.mkdtemp(prefix="millstone-pkg-"), "millstone.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(d, f)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_parallelism(df):
    """Spread a thin input before CPU-bound per-row work (cleaning, encoding).

    A small file with few row groups, or a small table that adaptive
    execution coalesced into a couple of partitions, would leave cores idle.
    Inputs with at least as many partitions as the cluster has cores (any
    large corpus) are returned unchanged: no shuffle of the text."""
    import re

    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # only a plain scan -> filter -> project chain is inspected: for plans
    # with exchanges, asking the partition count would run their stages
    if re.search(r"\b(Aggregate|Join|Window|Repartition\w*|Sort|Expand|GlobalLimit|Generate|Union)\b", plan):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * 2)
    return df

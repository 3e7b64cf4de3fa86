"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings an operator relies on; they are applied to sessions made here and are safe to set at run time.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session, for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pagemill")
    conf = RUNTIME_CONF | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Run-time settings, and the package as a zip for executors that don't have it installed; once a session is enough."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="pagemill-ship-"), "pagemill.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


@contextmanager
def interruptible(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs begun inside, from this thread, can be ended by ``interrupt`` with the tag from any other."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def interrupt(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and read it from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only in local mode, where that is unset, a
    temporary one is made; a cluster without the setting is an error, as no other folder is known to be shared.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
            if not local:
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pagemill-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, most_rows: int = 20_000, most_bytes: int = 8 << 20) -> DataFrame:
    """A broadcast hint when ``df`` is counted to hold at most so many rows and bytes, else ``df`` as it is (a shuffle join)."""
    width = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        if field.dataType.simpleString() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        elif field.dataType.typeName() == "array":
            width = width + F.coalesce(F.size(field.name), F.lit(0)) * 32
    n, size = df.limit(most_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= most_rows and size <= most_bytes else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where the input has fewer partitions than that (a small file), else ``df`` as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

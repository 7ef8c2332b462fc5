"""SparkSession construction and session-level settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: AQE for runtime re-planning (coalescing,
# skew-join splitting, broadcast conversion), UTC for oracle parity, Arrow
# for the few pandas hand-offs, no UI server.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
    # Local runs only: the driver JVM is the executor. Ignored once a JVM is up.
    "spark.driver.memory": "16g",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sqlkiln", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster, pass ``master=None`` so spark-submit decides; locally the
    caller passes ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``.

    Only a local master may go without: it gets a fresh scratch folder. On a
    cluster a missing setting is an error, because executors do not see each
    other's disks.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="sqlkiln-ckpt-", dir=os.environ.get("SQLKILN_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


# Spark's setting to remove a query's shuffle files as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings of a write by ``cut_lineage``. A variant goes as it is: shredded into columns, every
# row of it would be put together again by each reader.
WRITE_CONF = {SHUFFLE_CLEANUP: "true", "spark.sql.variant.inferShreddingSchema": "false"}

# For wide rows of many expressions: the JVM does not compile a method of more than 8,000 bytes, so code
# generated for a whole stage of them would be interpreted. Beyond the limit each operator has its own code.
SHORT_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def cut_lineage(df, tag: str = "table", conf: dict | None = None):
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Used where one intermediate feeds several branches of a plan or a loop: the
    branches then share a columnar scan -- with pruning, pushdown and sizes --
    instead of each recomputing the whole upstream tree, and a lost executor
    re-reads files instead of replaying the lineage. The shuffle files of the
    write are dropped when it ends: nothing reads them after that. ``conf``: more
    settings of this write alone.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sqlkiln-{uuid.uuid4().hex}/{tag}"
    conf = WRITE_CONF | (conf or {})
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df):
    """``df`` as a join side that is never broadcast, nor is the side it meets.

    Spark takes a written table for as large as its compressed files, which hold many
    times that in rows: under the threshold on disk, hundreds of MB in the driver.
    """
    return df.hint("merge")


def still_written(df) -> bool:
    """Whether the files of a ``cut_lineage`` table are still there."""
    files = df.inputFiles()
    if not files:
        return False
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(files[0])
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sqlkiln`` importable in executor Python workers (once per app).

    Jobs that run Python in tasks (``mapInPandas``, pandas UDFs) pickle
    references to this package; executors import it from a zip added with
    ``addPyFile`` -- the runtime form of ``--py-files``.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="sqlkiln-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)

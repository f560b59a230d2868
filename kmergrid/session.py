"""Session helpers: building one, cutting lineage, planner settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: rows a side may have before a broadcast hint is withheld
BROADCAST_ROWS = 2_000_000


def build_session(app: str = "kmergrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def allow_group_limit(spark: SparkSession, rows: int) -> None:
    """Let the planner prune each group to its first ``rows`` before shuffling.

    Spark only plans a group limit for ``row_number() <= n`` while ``n`` is at
    most this threshold; sketches are routinely larger than the default.
    """
    if int(spark.conf.get(GROUP_LIMIT, "1000")) < rows:
        spark.conf.set(GROUP_LIMIT, str(rows))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for materialised intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only a session without
    one (tests, a laptop) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        active = spark.sparkContext._jsc.sc().getCheckpointDir()
        if active.isDefined():
            return active.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="kmergrid-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def materialize(df: DataFrame, label: str = "step", batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Cuts the lineage, survives lost executors, and gives later joins a
    column-pruned scan with a known size.  The shuffle files behind the written
    table are removed with the write, not when the driver happens to collect them.
    ``batch_bytes`` bounds the Arrow batches that Python tasks get, which the task, its
    workers and the executor all hold.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    settings = {CLEANUP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rebalance by ``keys`` when the input is too small to split over all cores.

    A single-row-group file arrives as one task; shuffling raw records is far
    cheaper than hashing them all in one place.  Input of at least one full
    split per core passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * (128 << 20):
        return df
    return df.repartition(2 * cores, *keys)

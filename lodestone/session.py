"""Session settings and lineage truncation."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on, changeable at run time: hot join keys are split even where that
# costs a shuffle, and the number of reduce tasks follows the data instead of a fixed guess.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
# Settings of the application. Checkpointed levels are rows, not parquet: a compact serialiser and
# compression matter, and levels nothing refers to any more are removed.
APPLICATION_CONF = {
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.checkpoint.compress": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def apply_runtime_conf(spark: SparkSession) -> SparkSession:
    """Bring a session someone else made to the settings the operators count on."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "lodestone", shuffle_partitions: int = 8,
                  driver_memory: str = "12g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in (RUNTIME_CONF | APPLICATION_CONF).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_frame(spark: SparkSession, columns: list[str], rows: list[tuple[str, ...]]) -> DataFrame:
    """Strings a caller passed in, as an inline table: its size is known, so joins see how small it is."""
    names = [[f"v{r}_{c}" for c in range(len(columns))] for r in range(len(rows))]
    values = ", ".join("(" + ", ".join(f":{n}" for n in line) + ")" for line in names)
    args = {n: v for line, row in zip(names, rows) for n, v in zip(line, row)}
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})", args=args)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one up only where that is safe.

    A cluster names a shared folder in ``spark.checkpoint.dir``. A machine-local folder is
    used only in local mode, where driver and executors are one process.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        shared = tempfile.mkdtemp(prefix="lodestone-ckpt-")
    context.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

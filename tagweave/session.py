"""Session construction and cluster-safe lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed shuffle bytes of a task.  Rows of tokens and matches take fifty times
#: that in a sort or hash table, so a task stays below half a GB however large the input.
TASK_BYTES = 8 * 1024 * 1024
#: Shuffle partitions before AQE joins small ones up to ``TASK_BYTES``: room for 8 GB a shuffle.
TASKS = 1000

# Settings every plan in this package assumes. Sizes are per task, so they hold
# from local[8] up to a large cluster; AQE re-plans joins and partition counts
# from the real shuffle sizes at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(8 * TASK_BYTES),
    # A scan task's texts become tokens, some twenty times the file's bytes.
    "spark.sql.files.maxPartitionBytes": str(2 * TASK_BYTES),
    # No broadcast from static estimates: they ignore how explode/regex
    # extraction inflate rows, and would pick the wrong side.  Broadcasts come
    # from explicit hints on configuration tables of bounded size, and from
    # AQE, which converts a shuffle join from *measured* shuffle sizes.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    # ... also where few hot keys leave most partitions of the small side empty.
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
    # Later duplicate map keys overwrite earlier ones (settings maps).
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(
    master: str | None = None,
    app_name: str = "tagweave",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the package defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session (e.g. the driver's)."""
    for key, value in DEFAULT_CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    tasks = max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(tasks))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only where unset.

    On a cluster the directory must come from ``spark.checkpoint.dir`` (a shared
    file system).  Only a local-mode session (tests, benchmarks) gets a fresh
    private directory under the system temp folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server resolves spark.checkpoint.dir itself
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative operators need a shared "
            "checkpoint directory on a cluster"
        )
    path = tempfile.mkdtemp(prefix="tagweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to the reliable checkpoint directory (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for tables in the reliable checkpoint directory; nothing is there yet."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_if_exists(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or ``None`` if there is no such path; other failures
    (a broken schema, no access) are raised."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table built inside the JVM (``inline`` of a literal
    array), so scanning it starts no Python worker.  For configuration lists."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def spread(df: DataFrame, factor: int = 4) -> DataFrame:
    """Round-robin ``df`` over ``factor x defaultParallelism`` tasks when its
    scan yields fewer partitions than that.

    A small file written as one row group is decoded by a single task, and
    all CPU-heavy per-document work after it (regex stripping, tokenizing)
    would stay in that task.  At cluster scale the scan already has far more
    splits than cores, so this is a no-op there and adds no shuffle.
    """
    try:
        target = df.sparkSession.sparkContext.defaultParallelism * factor
        narrow = df.rdd.getNumPartitions() < target
    except Exception:  # sessions without RDD access (e.g. Spark Connect): leave as is
        return df
    return df.repartition(target) if narrow else df

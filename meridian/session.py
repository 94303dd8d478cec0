"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Fixed evaluation dates.  Every "CURRENT_DATE" of the source models becomes an
# explicit literal so results are reproducible (TPC-like tables end 2001-08-01,
# the event stream covers January 2024).
AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-31"

# Folders made for local runs whose session names none, by application.
_own_dirs: dict[str, str] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "meridian") -> SparkSession:
    """Session tuned for the analytics workload.

    Master, memory and the number of shuffle partitions are the submitter's
    unless given here; AQE starts from more (``configure``) and merges them.

    AQE coalesces shuffle partitions and splits skewed join partitions at run
    time; broadcast joins are left to Catalyst's size estimate
    (``autoBroadcastJoinThreshold``) and AQE's runtime statistics, so nothing
    whose size grows with the data is ever force-broadcast.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:  # else the submitter's
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.localShuffleReader.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


# A shuffle starts with this many partitions at least, which AQE merges to this size: as
# wide rows of few facts compress about twentyfold, a task then holds some 300 MB of rows
# however large the input is, instead of a fixed share of it.
INITIAL_PARTITIONS = 1000
PARTITION_BYTES = 16 * 1024 * 1024
_SPARKS_OWN = str(64 * 1024 * 1024) + "b"  # what Spark reports when nothing is set

# A scan's task reads this much at most.  Narrow columns unfold more than tenfold in memory, so
# with Spark's own 128 MB a task's rows, sorted by partition or summed, spill to disk in 1 GB.
SCAN_BYTES = 32 * 1024 * 1024
_SPARKS_OWN_SCAN = str(128 * 1024 * 1024) + "b"


def configure(spark: SparkSession) -> SparkSession:
    """Settings every query relies on, applied to an existing session too.

    Sizes the submitter has set are kept.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(initial, None) is None:
        spark.conf.set(initial, str(max(INITIAL_PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    target = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if spark.conf.get(target) == _SPARKS_OWN:
        spark.conf.set(target, str(PARTITION_BYTES))
    scan = "spark.sql.files.maxPartitionBytes"
    if spark.conf.get(scan) == _SPARKS_OWN_SCAN:
        spark.conf.set(scan, str(SCAN_BYTES))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    On a cluster it must be set and is used as is; only in local mode (tests)
    a private folder is created when it is unset.  The same folder backs
    ``DataFrame.checkpoint()`` (set once), stream checkpoints and written
    intermediate tables, under stable paths so restarted jobs find their state.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or _own_dirs.get(spark.sparkContext.applicationId)
    if not configured:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="meridian-ckpt-")  # one machine: local runs and tests only
        _own_dirs[spark.sparkContext.applicationId] = configured
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{configured.rstrip('/')}/rdd")
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A stable path for an intermediate table or stream checkpoint, under the shared folder."""
    return f"{checkpoint_dir(spark)}/meridian/{name}"

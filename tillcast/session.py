"""Spark session with the settings the operators are written for."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for the plans built here: AQE re-plans joins at run
# time (broadcast when a stat table turns out small, split skewed partitions),
# and the session time zone makes date arithmetic match the reference.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the masters are joined one after another on one key: split a hot key even
    # where that costs the next join a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # the feature table is ~200 columns wide: keep its projections in
    # whole-stage codegen instead of the interpreted fallback above 100 fields
    "spark.sql.codegen.maxFields": "400",
    # a generated method above 8,000 bytes of code is never compiled by the JVM: such a
    # stage runs operator by operator, whose code is cut into small methods
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tillcast", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. On a cluster pass ``master=None`` so that the
    submit-time master and configuration win."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode runs every task in the driver JVM
        conf["spark.driver.memory"] = os.environ.get("TILLCAST_DRIVER_MEMORY", "16g")
        # small test tables, CPU-heavy wide rows: favour task count over
        # partition size (on a cluster the scan splits give the parallelism)
        conf.setdefault("spark.sql.files.maxPartitionBytes", "16m")
        conf.setdefault("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def compiled(spark: SparkSession) -> None:
    """Gives a session made elsewhere the limit under which the wide feature
    expressions run as compiled code, if it has none of its own."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name, "65535") == "65535":
        spark.conf.set(name, DEFAULT_CONF[name])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a folder every executor can reach and is
    used as it is. Only in local mode, when it is unset (tests), a scratch
    folder is made; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    cur = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if cur:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(cur)
        return cur
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tillcast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local

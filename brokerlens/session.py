"""Spark session construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from measured shuffle
# sizes (a join side becomes a broadcast only when its materialised size is
# below the threshold, which is the size check), splits skewed partitions
# (one source IP may own a third of all rows), and coalesces small
# partitions after a shuffle.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "brokerlens",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session with the library's settings.

    ``master`` is only for local runs (tests, bench); on a cluster the
    launcher sets it.  ``shuffle_partitions`` should be sized so one
    partition of the largest shuffle fits an executor core's memory; AQE
    then coalesces the tail.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_CKPT: dict = {}


def ensure_checkpoint_dir(spark: SparkSession, local_fallback: bool | None = None) -> str:
    """Point ``SparkContext.checkpoint`` at the cluster's shared folder.

    The folder comes from the session setting ``spark.checkpoint.dir``.
    Only when it is unset *and* a local fallback is allowed is a fresh
    local directory created; by default that is allowed only under a
    ``local`` master (tests, local bench), never on a cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if local_fallback is None:
        local_fallback = spark.sparkContext.master.startswith("local")
    if not path and local_fallback and id(spark.sparkContext) in _LOCAL_CKPT:
        path = _LOCAL_CKPT[id(spark.sparkContext)]
    if not path:
        if not local_fallback:
            raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
        path = tempfile.mkdtemp(prefix="brokerlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        _LOCAL_CKPT[id(spark.sparkContext)] = path
    spark.sparkContext.setCheckpointDir(path)
    return path

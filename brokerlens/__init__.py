"""brokerlens: MQTT message-traffic analytics and DoS detection on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a small
metrics table) built from Spark SQL expressions, so Catalyst can prune,
push down and fuse them.  Thresholds are parameters.
"""

from brokerlens.session import build_session, ensure_checkpoint_dir

__all__ = ["build_session", "ensure_checkpoint_dir"]

"""The ``mqtt`` test projection of the driver's ``events`` table.

This only reshapes ``events`` rows into the message schema; it does none
of the analysis.  The SQL text is shared with the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed text, identical in Spark and DuckDB (fixture F2).
MQTT_FIXTURE_SQL = """SELECT CASE WHEN k = 98 THEN NULL ELSE event_id END AS mqtt_message_id,
       CAST(ts AS TIMESTAMP) AS ts,
       CASE WHEN k = 99 THEN NULL
            ELSE '192.168.' || CAST(user_id % 8 AS STRING) || '.' || CAST(user_id AS STRING) END AS general_ip,
       '08:B6:1F:82:12:' || CAST(10 + user_id % 40 AS STRING) AS general_mac,
       'sensor_' || CAST(user_id % 25 AS STRING) AS general_device_name,
       'iiot/' || event_type || '/' || CAST(k % 10 AS STRING) AS mqtt_topic,
       CASE event_type WHEN 'signup' THEN 'CONNECT' WHEN 'view' THEN 'SUBSCRIBE'
                       WHEN 'click' THEN 'PINGREQ' ELSE 'PUBLISH' END AS mqtt_message_type,
       CASE WHEN k < 5 THEN NULL WHEN k < 8 THEN '' ELSE repeat('x', k % 40) END AS mqtt_message_value,
       k % 3 AS mqtt_qos,
       event_type = 'error' AS mqtt_duplicate,
       k >= 80 AS mqtt_retained,
       value
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e"""


def mqtt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages for the tests and the bench, derived from ``events``."""
    import zlib
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # a private view name per folder, so no view of the caller is replaced
    view = f"brokerlens_events_{zlib.crc32(sf_dir.encode()):08x}"
    events.createOrReplaceTempView(view)
    return spark.sql(MQTT_FIXTURE_SQL.replace("FROM events) e", f"FROM {view}) e"))

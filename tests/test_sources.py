"""CSV ingestion with the explicit schema; malformed fields become null."""

import tempfile

from brokerlens.sources.readers import read_messages
from brokerlens.sources.schema import available_columns, columns_by_type


def test_csv_permissive_keeps_corrupt_record(spark):
    d = tempfile.mkdtemp(prefix="csv-src-", dir="/tmp")
    header = ("@timestamp,general_ip,general_mac,general_device_name,general_full_id,mqtt_topic,mqtt_message_type,"
              "mqtt_message_value,mqtt_message_id,mqtt_qos,mqtt_duplicate,mqtt_retained")
    good = "2026-01-10T14:30:00Z,192.168.1.10,08:B6:1F:82:12:30,sensor_01,x,iiot/a,PUBLISH,\"[1.0, 2.0]\",17,1,true,false"
    bad = "2026-01-10T14:31:00Z,192.168.1.11,08:B6:1F:82:12:31,sensor_02,y,iiot/b,PUBLISH,v,18,high,false,false"
    with open(f"{d}/m.csv", "w") as fh:
        fh.write("\n".join([header, good, bad]) + "\n")
    df = read_messages(spark, f"{d}/m.csv", "csv", keep_corrupt=True)
    rows = {r["mqtt_message_id"]: r for r in df.collect()}
    assert rows[17]["mqtt_qos"] == 1 and rows[17]["mqtt_message_value"] == "[1.0, 2.0]"
    assert rows[17]["_corrupt_record"] is None
    assert rows[18]["mqtt_qos"] is None and rows[18]["_corrupt_record"] is not None
    num, cat = columns_by_type(df)
    assert "mqtt_qos" in num and "general_ip" in cat and "@timestamp" not in cat
    assert available_columns(df, ["mqtt_qos", "nope", "general_ip"]) == ["mqtt_qos", "general_ip"]

import datetime as dt

from pyspark.sql import types as T

MSG = T.StructType([
    T.StructField("mqtt_message_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("general_ip", T.StringType()), T.StructField("general_mac", T.StringType()),
    T.StructField("general_device_name", T.StringType()), T.StructField("mqtt_topic", T.StringType()),
    T.StructField("mqtt_message_type", T.StringType()), T.StructField("mqtt_message_value", T.StringType()),
    T.StructField("mqtt_qos", T.IntegerType()), T.StructField("mqtt_duplicate", T.BooleanType()),
    T.StructField("mqtt_retained", T.BooleanType()),
])

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def msg(i, ip="10.0.0.1", topic="a/b", dup=False, ts=None, mac="m1", dev="d1", mtype="PUBLISH", value="x",
        qos=0, retained=False):
    return (i, ts or T0 + dt.timedelta(seconds=i), ip, mac, dev, topic, mtype, value, qos, dup, retained)


def frame(spark, rows):
    return spark.createDataFrame(rows, MSG)

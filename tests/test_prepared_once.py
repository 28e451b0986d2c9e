"""The model parts are prepared once, and models pass over evenly dealt rows."""

import datetime as dt

from pyspark.sql import functions as F

from brokerlens.operators import models as M
from brokerlens.operators import split as SP
from brokerlens.plans.training import prepared_parts

T0 = dt.datetime(2024, 1, 1)


def labelled(spark, n=2000):
    rows = [(i, T0 + dt.timedelta(minutes=i), None if i % 11 == 0 else float(i % 7), float(i % 5), int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "mqtt_message_id long, ts timestamp, mqtt_qos double, hour double, is_ddos int")


def test_parts_are_read_back_and_hold_every_row(spark):
    df = labelled(spark)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x
    tr, te, feats = prepared_parts(df.withColumn("hour", counted("hour")))
    assert calls.value <= 2000                    # one pass over the labelled messages
    assert tr.count() == 1600 and te.count() == 400 and feats == ["mqtt_qos", "hour"]
    assert calls.value <= 2000
    assert tr.union(te).select("mqtt_message_id").distinct().count() == 2000
    assert tr.where("mqtt_qos IS NULL").count() == 0 and te.where("mqtt_qos IS NULL").count() == 0
    a, b = SP.stratified_split(df)
    ids = lambda d: sorted(r[0] for r in d.select("mqtt_message_id").collect())
    assert (ids(tr), ids(te)) == (ids(a), ids(b)) and a.columns == df.columns


def test_rows_are_dealt_over_the_cores(spark):
    one = labelled(spark, 800).coalesce(1)
    many = M.spread(one)
    assert many.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))

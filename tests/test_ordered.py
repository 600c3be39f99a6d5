import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from ledgerlake.operators.ordered import segment_of, segmented_scan


@pytest.mark.parametrize("grain", ["hour", "day", "month", "year"])
def test_equals_plain_windows_for_any_segment_width(spark, rows, grain):
    draw = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(600):
        key = "hot" if draw.random() < 0.4 else draw.choice("abcde")
        at = start + dt.timedelta(minutes=draw.randrange(200_000))
        data.append((key, at, i, draw.choice([None, None, "x", "y", "z"]), draw.randrange(-50, 50)))
    df = spark.createDataFrame(data, "k string, at timestamp_ntz, id long, v string, n long")
    order = Window.partitionBy("k").orderBy("at", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select(
        "*", F.last("v", True).over(upto).alias("carried"), F.lead("at").over(order).alias("following"),
        F.sum("n").over(upto).alias("total"),
    )
    scanned = segmented_scan(
        df.withColumn("seg", segment_of("at", grain)), ["k"], ["at", "id"], "seg",
        carry={"carried": "v"}, lead={"following": "at"}, running={"total": "n"},
    ).drop("seg")
    assert rows(scanned) == rows(plain)


def test_lead_passes_null_values_on(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5)], "k string, t int, v int").withColumn("seg", F.col("t"))
    found = segmented_scan(df, ["k"], ["t"], "seg", lead={"nxt": "v"}, running={"total": "v"})
    assert rows(found, "t", "nxt", "total") == [(1, 5, 0), (2, None, 5)]

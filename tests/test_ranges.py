import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from ledgerlake.operators import ranges
from ledgerlake.operators.ranges import range_scan


def hot_rows(spark, n=3000):
    """A key with a third of all rows, all on one day, null keys and values, nested columns."""
    draw = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else draw.choice([*"abcdefgh", None])
        at = start + (dt.timedelta(seconds=draw.randrange(3600)) if key == "hot" else dt.timedelta(minutes=draw.randrange(200_000)))
        value = draw.choice([None, None, None, "x", "y", "z"])
        data.append((key, i % 2, at, i, value, (value, i) if value else None, draw.choice([None, -3, 1, 50]), draw.randrange(9) / 4))
    schema = "k string, l int, at timestamp_ntz, id long, v string, s struct<a:string,b:long>, n int, d double"
    return spark.createDataFrame(data, schema).repartition(5)


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (3, 50), (16, 7), (64, 1)])
def test_equals_plain_windows_for_any_partitions(spark, rows, parts, batch):
    df = hot_rows(spark)
    order = Window.partitionBy("k", "l").orderBy("at", "id")
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select(
        "*", F.last("v", True).over(upto).alias("v_now"), F.last("s", True).over(upto).alias("s_now"),
        F.last("s", True).over(earlier).alias("s_before"), F.lead("at").over(order).alias("following"), F.lead("v").over(order).alias("v_next"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("total"), F.sum("d").over(upto).alias("d_total"),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        scanned = range_scan(
            df, ["k", "l"], ["at", "id"], carry={"v_now": "v", "s_now": "s"}, before={"s_before": "s"},
            lead={"following": "at", "v_next": "v"}, running={"total": "n", "d_total": "d"}, parts=parts,
        )
        assert scanned.columns == plain.columns
        assert rows(scanned) == rows(plain)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_key_and_day_is_split(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(ranges, "written", lambda df, label: kept.append(written(df, label)) or kept[-1])
    from ledgerlake.workspace import written

    range_scan(hot_rows(spark, 12_000), ["k"], ["at", "id"], running={"total": "n"}, parts=16).count()
    sizes = sorted(r["count"] for r in kept[0].groupBy("__part").count().collect())
    assert len(sizes) > 8 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_small_and_empty_tables(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5)], "k string, t int, v int")
    found = range_scan(df, ["k"], ["t"], lead={"nxt": "v"}, running={"total": "v"}, parts=4)
    assert rows(found, "t", "nxt", "total") == [(1, 5, 0), (2, None, 5)]
    assert range_scan(df.limit(0), ["k"], ["t"], carry={"now": "v"}).count() == 0
    with pytest.raises(TypeError, match="string"):
        range_scan(df, ["k"], ["t"], running={"x": "k"})

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.operators import silver
from ledgerlake.sources import files, jdbc
from ledgerlake.sources.versions import SchemaMismatch, VersionedTable, version_counts, version_diff


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"))


def people(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.format_string("C-%03d", "id").alias("customer_id"), F.lit("x").alias("email"), (F.col("id") % 3).cast("int").alias("part")
    )


# versions


def test_overwrite_time_travel_and_restore(spark, table, rows):
    table.overwrite(people(spark, 50), partition_by=["part"])
    table.overwrite(table.read().orderBy("customer_id").limit(10))
    assert (table.read().count(), table.read(0).count(), table.current_version()) == (10, 50, 1)
    table.restore(0)
    assert rows(table.read()) == rows(people(spark, 50))
    assert rows(table.history()) == [(0, "OVERWRITE", 50), (1, "OVERWRITE", 10), (2, "RESTORE", 50)]
    assert rows(version_counts(table.history())) == [(0, 50), (1, 10), (2, 50)]
    with pytest.raises(LookupError):
        table.read(7)


def test_append_checks_the_schema_before_writing(spark, table):
    table.overwrite(people(spark, 3))
    bad = people(spark, 1, 9).withColumn("unexpected_field", F.lit("wrong"))
    with pytest.raises(SchemaMismatch, match="unknown column unexpected_field"):
        table.append(bad)
    with pytest.raises(SchemaMismatch, match="column part"):
        table.append(people(spark, 1, 9).withColumn("part", F.lit("text")))
    assert table.current_version() == 0 and table.read().count() == 3
    table.append(people(spark, 2, 9).drop("email"))
    assert table.read().count() == 5 and table.read().filter("email is null").count() == 2
    assert table.read(0).count() == 3


def test_schema_changes_need_the_flag_and_old_versions_keep_theirs(spark, table):
    table.overwrite(people(spark, 3))
    wider = people(spark, 3).withColumn("risk_rating", F.lit("LOW"))
    with pytest.raises(SchemaMismatch):
        table.overwrite(wider)
    table.overwrite(wider, allow_schema_change=True)
    assert table.read().columns[-1] == "risk_rating" and "risk_rating" not in table.read(0).columns


def test_unfinished_write_is_not_seen(spark, table):
    table.overwrite(people(spark, 3))
    half = f"{table.path}/version=1/operation=OVERWRITE"
    people(spark, 99).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(half)
    assert table.read().count() == 3
    table.overwrite(people(spark, 4))
    assert table.read().count() == 4


def test_diff_of_changed_columns(spark, rows):
    before = people(spark, 3)
    after = before.withColumn("note", F.when(F.col("customer_id") == "C-001", F.lit("new")))
    assert rows(version_diff(before, after, "customer_id")) == [("C-001", "changed")]
    assert rows(version_diff(after, before, "customer_id")) == [("C-001", "changed")]
    swapped = spark.createDataFrame([("k", None, "a")], "k string, x string, y string")
    other = spark.createDataFrame([("k", "a", None)], "k string, x string, y string")
    assert rows(version_diff(swapped, other, "k")) == [("k", "changed")]


def test_diff(spark, rows):
    before = people(spark, 4)
    after = people(spark, 5).filter("customer_id <> 'C-000'").withColumn(
        "email", F.when(F.col("customer_id") == "C-002", F.lit(None)).otherwise(F.col("email"))
    )
    assert rows(version_diff(before, after, "customer_id")) == [("C-000", "removed"), ("C-002", "changed"), ("C-004", "added")]


def test_silver_transactions_prune_partitions(spark, table):
    source = spark.range(3000).selectExpr(
        "concat('T', id) as transaction_id", "concat('A', id % 7) as account_id",
        "timestamp_ntz'2025-11-01' + make_dt_interval(cast(id % 150 as int)) as timestamp", "id as amount_cents",
        "'m' as merchant", "'c' as category", "'posted' as status", "timestamp_ntz'2025-11-01' as created_at",
    )
    counts = silver.write_silver("transactions", source, table, dt.datetime(2026, 5, 1))
    assert counts == {"loaded": 3000, "written": 3000, "version": 0}
    found = silver.transactions_between(table.read(), dt.datetime(2025, 12, 15), dt.datetime(2026, 1, 10))
    assert found.count() == source.filter("timestamp >= '2025-12-15' and timestamp < '2026-01-10'").count() == 26 * 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan
    assert len(found.inputFiles()) > 0


# files


def test_change_feed_round_trip_is_sorted(spark, tmp_path, rows):
    feed = spark.createDataFrame(
        [("C-2", dt.datetime(2025, 5, 2, 1, 2, 3, 456789), "1 Oak, Apt \"2\"", "NC", "LOW", "ADDRESS"),
         ("C-1", dt.datetime(2025, 1, 27), None, "GA", "HIGH", "RISK_RATING")],
        schemas.CHANGE_EVENT,
    )
    files.write_changes(feed, str(tmp_path / "c"))
    back = files.read_changes(spark, str(tmp_path / "c"))
    assert rows(back) == rows(feed)
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert text.startswith("customer_id,change_timestamp") and "2025-05-02T01:02:03.456789" in text
    assert text.index("C-1") < text.index("C-2")


def test_malformed_change_fails(spark, tmp_path):
    (tmp_path / "c.csv").write_text("customer_id,change_timestamp,address_line,state_code,risk_rating,change_type\nC-1,yesterday,a,b,c,d\n")
    with pytest.raises(Exception, match="yesterday"):
        files.read_changes(spark, str(tmp_path / "c.csv")).collect()


def test_markdown_and_embedding_folders(spark, tmp_path, rows):
    (tmp_path / "b_doc.md").write_bytes("# T\r\ntext\rmoreé".encode())
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "skip.txt").write_text("no")
    (tmp_path / "abc123.json").write_text(json.dumps([0.5, -0.25]))
    assert rows(files.read_markdown(spark, str(tmp_path))) == [("a", "one"), ("b_doc", "# T\ntext\nmoreé")]
    assert rows(files.read_embedding_store(spark, str(tmp_path))) == [("abc123", [0.5, -0.25])]


# jdbc: options only, no database is started here


def test_jdbc_options():
    connection = jdbc.Connection("jdbc:postgresql://db:5432/bank", "reader", "secret")
    split = jdbc.Split("created_at", "2024-01-01", "2025-01-01", 64)
    assert connection.options()["user"] == "reader" and "secret" not in connection.options()["url"]
    assert split.options() == {
        "partitionColumn": "created_at", "lowerBound": "2024-01-01", "upperBound": "2025-01-01", "numPartitions": "64",
    }
    with pytest.raises(ValueError):
        jdbc.Connection("jdbc:postgresql://u:p@db/bank", "u", "p").options()


def test_versions_have_times(spark, tmp_path):
    import datetime as dt
    import time

    table = VersionedTable(spark, str(tmp_path / "timed"))
    before = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) - dt.timedelta(seconds=2)
    table.overwrite(spark.range(3).toDF("id"))
    time.sleep(1.1)
    between = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    time.sleep(1.1)
    table.overwrite(spark.range(5).toDF("id"))
    history = {r["version"]: r for r in table.timed_history().collect()}
    assert [history[v]["num_rows"] for v in (0, 1)] == [3, 5]
    assert before <= history[0]["committed_at"] <= between <= history[1]["committed_at"]
    assert (table.version_at(before), table.version_at(between), table.version_at(between + dt.timedelta(days=1))) == (None, 0, 1)
    assert table.read(table.version_at(between)).count() == 3

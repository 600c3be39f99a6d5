import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import conversations as c


def text(value):
    return (value, None, None)


def use(name, use_id):
    return (None, (name, json.dumps({"account_id": "A"}), use_id), None)


MESSAGES = [
    ("one", 0, "user", [text("hello")]),
    ("one", 1, "assistant", [text("let me look"), use("get_account_balance", "u1"), use("nonexistent", "u2")]),
    ("two", 0, "user", [text("hi")]),
    ("two", 1, "assistant", [use("get_account_balance", "u3")]),
    ("two", 2, "user", [(None, None, ("u3", "{}", "success"))]),
    ("two", 3, "assistant", [text("done"), text("bye")]),
    ("three", 0, "user", [use("odd", "u4")]),
]
SCHEMA = f"conversation_id string, turn long, role string, content array<{c.BLOCK}>"


@pytest.fixture
def messages(spark):
    return spark.createDataFrame(MESSAGES, SCHEMA)


def test_routing_looks_at_the_last_message(messages, rows):
    assert rows(c.routing(messages), "conversation_id", "last_role", "next_step") == [
        ("one", "assistant", "tools"), ("three", "user", "end"), ("two", "assistant", "end"),
    ]


def test_tool_uses_and_results(spark, messages, rows):
    uses = c.last_tool_uses(messages)
    assert rows(uses, "conversation_id", "name", "toolUseId") == [
        ("one", "get_account_balance", "u1"), ("one", "nonexistent", "u2"),
    ]
    answers = spark.createDataFrame(
        [("one", "u1", "{}", None), ("one", "u2", "{}", "unknown_tool"), ("two", "u3", "{}", None)],
        "conversation_id string, toolUseId string, content string, error string",
    )
    assert rows(c.tool_results(uses, answers).select("conversation_id", "toolResult.*"), "toolUseId", "status") == [
        ("u1", "success"), ("u2", "error"),
    ]


def test_display_text_and_turn_cap(messages, rows):
    assert ("two", 3, "assistant", 1, "bye") in rows(c.display_text(messages))
    assert c.display_text(messages).count() == 5
    assert rows(c.turn_cap(messages, cap=2)) == [("one", 1, False), ("three", 0, False), ("two", 2, True)]
    with pytest.raises(ValueError):
        c.turn_cap(messages, cap=51)


def test_append_continues_the_turns(spark, messages, rows):
    new = spark.createDataFrame(
        [("two", 0, "user", [text("again")]), ("two", 1, "assistant", [text("yes")]), ("new", 0, "user", [text("first")])],
        SCHEMA.replace("turn long", "position long"),
    )
    added = c.append(messages, new)
    assert rows(added.filter("conversation_id in ('two', 'new') and (turn > 3 or conversation_id = 'new')"), "conversation_id", "turn", "role") == [
        ("new", 0, "user"), ("two", 4, "user"), ("two", 5, "assistant"),
    ]
    assert added.count() == len(MESSAGES) + 3


def day(value="2024-01-01"):
    return F.lit(f"{value} 00:00:00").cast("timestamp_ntz")


def stored(spark, sizes, customer="C-1", first=0):
    turns = [(cid, first + t, "user", "x") for cid, n in sizes.items() for t in range(n)]
    messages = c.text_messages(spark.createDataFrame(turns, "conversation_id string, turn long, role string, text string"))
    owners = messages.select("conversation_id", F.lit(customer).alias("customer_id")).distinct()
    return c.headers(messages, owners, day(), day()), messages


def test_long_and_late_conversations_are_whole(spark, rows):
    """1,500 turns are one conversation, and one that begins with turn 1200 is listed."""
    headers, messages = stored(spark, {"long": 1500})
    late, late_messages = stored(spark, {"late": 3}, first=1200)
    both = headers.unionByName(late)
    assert rows(c.recent(both), "conversation_id", "n_messages") == [("late", 3), ("long", 1500)]
    ids = spark.createDataFrame([("long",), ("late",)], "conversation_id string")
    assert rows(c.get(both, ids), "conversation_id", "n_messages") == [("late", 3), ("long", 1500)]
    assert c.messages_of(messages.unionByName(late_messages), ids).count() == 1503
    document = c.document(headers, messages).collect()
    assert len(document) == 1 and [m["turn"] for m in document[0]["messages"]] == list(range(1500))


def test_upsert_sets_creation_once(spark, rows):
    now = dt.datetime(2024, 6, 1)
    headers, messages = stored(spark, {"a": 1500, "b": 2})
    saved, saved_messages = stored(spark, {"a": 1700, "c": 1}, "C-2")
    after = {r["conversation_id"]: r for r in c.upsert(headers, saved, day("2024-06-01")).collect()}
    assert set(after) == {"a", "b", "c"}
    assert after["a"]["created_at"] == dt.datetime(2024, 1, 1) and after["a"]["updated_at"] == now
    assert after["a"]["customer_id"] == "C-2" and after["a"]["n_messages"] == 1700
    assert after["b"]["updated_at"] == dt.datetime(2024, 1, 1) and after["b"]["customer_id"] == "C-1"
    assert after["c"]["created_at"] == now
    replaced = c.replace_messages(messages, saved, saved_messages)
    assert rows(replaced.groupBy("conversation_id").count()) == [("a", 1700), ("b", 2), ("c", 1)]


def test_upsert_may_shorten(spark, rows):
    _, messages = stored(spark, {"a": 1500})
    saved, saved_messages = stored(spark, {"a": 3})
    assert c.replace_messages(messages, saved, saved_messages).count() == 3


def test_recent_and_get(spark, rows):
    headers, _ = stored(spark, {f"k{i:02d}": 1 for i in range(12)})
    assert rows(c.recent(headers), "conversation_id") == [(f"k{i:02d}",) for i in range(10)]
    ids = spark.createDataFrame([("k03",), ("none",)], "conversation_id string")
    assert rows(c.get(headers, ids), "conversation_id") == [("k03",)]


def digests(df):
    line = F.concat("role", F.lit(":"), F.col("content")[0]["text"])
    return {r["conversation_id"]: r["digest"] for r in c.transcript_digests(df, line).collect()}


def test_transcript_digests_are_trees_over_ranges(spark, monkeypatch):
    import hashlib

    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    monkeypatch.setattr(c, "RANGE", 4)
    turns = [(cid, t, "user", f"{cid}{t}") for cid, n in (("a", 3), ("b", 9), ("c", 70)) for t in range(n)]
    turns += [("late", 21, "user", "x"), ("late", 22, "user", "y")]
    made = lambda some: c.text_messages(spark.createDataFrame(some, "conversation_id string, turn long, role string, text string"))
    found = digests(made(turns).repartition(3))

    def plain(lines):
        nodes = {}
        for turn, line in lines:
            nodes.setdefault(turn // 4, []).append(line)
        nodes = {p: sha("\n".join(x)) for p, x in nodes.items()}
        while set(nodes) != {0}:
            above = {}
            for p in sorted(nodes):
                above.setdefault(p // 4, []).append(nodes[p])
            nodes = {p: x[0] if len(x) == 1 else sha("".join(x)) for p, x in above.items()}
        return nodes[0]

    for cid in ("a", "b", "c", "late"):
        assert found[cid] == plain([(t, f"user:{x}") for i, t, _, x in turns if i == cid])
    # a digest does not depend on other conversations, and changes with any line
    assert digests(made([t for t in turns if t[0] == "b"]))["b"] == found["b"]
    other = [(i, t, r, "other" if (i, t) == ("b", 8) else x) for i, t, r, x in turns]
    changed = digests(made(other))
    assert changed["b"] != found["b"] and changed["c"] == found["c"]
    assert digests(made(turns).limit(0)) == {}


def test_a_hot_conversation_is_split_over_tasks(spark):
    turns = spark.range(9000).selectExpr("case when id % 3 = 0 then 'hot' else 'c' || id % 700 end as conversation_id", "id as turn", "'user' as role", "'x' as text")
    line = F.concat("role", F.lit(":"), F.col("content")[0]["text"])
    leaves = c.text_messages(turns).groupBy("conversation_id", F.floor(F.col("turn") / c.RANGE).alias("p")).count()
    assert leaves.agg(F.max("count")).first()[0] <= c.RANGE
    assert c.transcript_digests(c.text_messages(turns), line).count() == turns.select("conversation_id").distinct().count()

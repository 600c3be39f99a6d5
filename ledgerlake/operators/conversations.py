"""Conversations as a header table and a message table.

Messages are rows (conversation_id, turn, role, content) with ``turn`` unique within a conversation
and ``content`` a list of blocks, each holding exactly one of text, toolUse, toolResult. Headers hold
one row per conversation: conversation_id, customer_id, created_at, updated_at, n_messages. Listing and
saving work on headers; messages are joined only where they are asked for, and a conversation may have
any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.operators.spending import latest_per_key

HEADER = ["conversation_id", "customer_id", "created_at", "updated_at", "n_messages"]

# Default and range of the assistant turn cap, default list length.
TURN_CAP_DEFAULT, TURN_CAP_MAX = 10, 50
RECENT_DEFAULT = 10

# Turns of a leaf of a transcript's tree of digests, and children of a node.
RANGE = 64

BLOCK = (
    "struct<text: string, "
    "toolUse: struct<name: string, input: string, toolUseId: string>, "
    "toolResult: struct<toolUseId: string, content: string, status: string>>"
)


def text_messages(turns: DataFrame) -> DataFrame:
    """(conversation_id, turn, role, text) -> messages with one text block."""
    block = F.struct(F.col("text").alias("text"), F.lit(None).alias("toolUse"), F.lit(None).alias("toolResult"))
    return turns.withColumn("content", F.array(block).cast(f"array<{BLOCK}>")).drop("text")


def headers(messages: DataFrame, owners: DataFrame, created_at, updated_at) -> DataFrame:
    """A header per conversation; ``owners`` has (conversation_id, customer_id)."""
    counted = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return counted.join(owners, "conversation_id").withColumns(
        {"created_at": created_at, "updated_at": updated_at}
    ).select(*HEADER)


def document(headers: DataFrame, messages: DataFrame) -> DataFrame:
    """Headers with all their messages nested in turn order, for export of the conversations asked for."""
    nested = messages.groupBy("conversation_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("messages")
    )
    return headers.join(nested, "conversation_id", "left")


def transcript_digests(messages: DataFrame, line: Column) -> DataFrame:
    """(conversation_id, digest): a tree of SHA-256 digests over ranges of turns.

    A leaf is the digest of the lines of ``RANGE`` numbered turns, joined by line ends; a node is that of its up to
    ``RANGE`` children's hex digests, and a single child stands for itself. No task sees more of a conversation
    than one range, and equal transcripts with equal turns, numbered from 0 or more, have equal digests, whatever
    other conversations hold.
    """
    place = F.floor(F.col("turn") / RANGE)
    lines = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    nodes = messages.groupBy("conversation_id", place.alias("place")).agg(lines.alias("lines"))
    nodes = nodes.select("conversation_id", "place", F.sha2(F.array_join("lines.line", "\n"), 256).alias("digest"))
    last, size = messages.agg(F.max("turn")).first()[0] or 0, RANGE
    while size <= last:
        children = F.sort_array(F.collect_list(F.struct("place", "digest")))
        above = nodes.groupBy("conversation_id", F.floor(F.col("place") / RANGE).alias("above")).agg(children.alias("c"))
        whole = F.when(F.size("c") == 1, F.col("c")[0]["digest"]).otherwise(F.sha2(F.array_join("c.digest", ""), 256))
        nodes = above.select("conversation_id", F.col("above").alias("place"), whole.alias("digest"))
        size *= RANGE
    return nodes.select("conversation_id", "digest")


def append(messages: DataFrame, new: DataFrame) -> DataFrame:
    """Add messages after the existing ones; ``new`` has ``position`` 0, 1, ... per conversation."""
    last = messages.groupBy("conversation_id").agg(F.max("turn").alias("last_turn"))
    turn = F.coalesce(F.col("last_turn") + 1, F.lit(0)) + F.col("position")
    placed = new.join(last, "conversation_id", "left").withColumn("turn", turn)
    return messages.unionByName(placed.select(*messages.columns))


def upsert(headers: DataFrame, saved: DataFrame, now) -> DataFrame:
    """Headers after saving the conversations of ``saved`` (conversation_id, customer_id, n_messages).

    ``created_at`` is set on creation only, ``updated_at`` on every save.
    """
    offered = saved.select("conversation_id", F.struct("customer_id", "n_messages").alias("__new"))
    merged = headers.join(offered, "conversation_id", "full_outer")
    new = F.col("__new").isNotNull()
    return merged.select(
        "conversation_id",
        F.when(new, F.col("__new.customer_id")).otherwise(F.col("customer_id")).alias("customer_id"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(new, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(new, F.col("__new.n_messages")).otherwise(F.col("n_messages")).alias("n_messages"),
    )


def replace_messages(messages: DataFrame, saved: DataFrame, saved_messages: DataFrame) -> DataFrame:
    """Messages after a save: those of the saved conversations give way, also to fewer or to none."""
    kept = messages.join(saved.select("conversation_id"), "conversation_id", "left_anti")
    return kept.select(*messages.columns).unionByName(saved_messages.select(*messages.columns))


def get(headers: DataFrame, ids: DataFrame) -> DataFrame:
    """Headers of the requested conversations; unknown ids give no row."""
    return headers.join(ids.select("conversation_id"), "conversation_id", "left_semi")


def messages_of(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages of the requested conversations, as rows."""
    return messages.join(ids.select("conversation_id"), "conversation_id", "left_semi")


def recent(headers: DataFrame, n: int = RECENT_DEFAULT) -> DataFrame:
    """The most recently updated conversations per customer."""
    return latest_per_key(headers, ["customer_id"], "updated_at", "conversation_id", n)


def _last(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(
        F.max_by(F.struct("turn", "role", "content"), "turn").alias("last"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
    )


def routing(messages: DataFrame) -> DataFrame:
    """Where a conversation goes next: ``tools`` when the last assistant message asks for one."""
    asks = F.exists("last.content", lambda block: block["toolUse"].isNotNull())
    return _last(messages).select(
        "conversation_id", F.col("last.turn").alias("last_turn"), F.col("last.role").alias("last_role"),
        F.when((F.col("last.role") == "assistant") & asks, "tools").otherwise("end").alias("next_step"),
    )


def turn_cap(messages: DataFrame, cap: int = TURN_CAP_DEFAULT) -> DataFrame:
    if not 1 <= cap <= TURN_CAP_MAX:
        raise ValueError(f"cap must be between 1 and {TURN_CAP_MAX}")
    return messages.groupBy("conversation_id").agg(
        F.count_if(F.col("role") == "assistant").alias("assistant_turns")
    ).withColumn("capped", F.col("assistant_turns") >= cap)


def last_tool_uses(messages: DataFrame) -> DataFrame:
    """Tool uses in the last message of conversations that end with the assistant."""
    uses = F.filter("last.content", lambda block: block["toolUse"].isNotNull())
    return _last(messages).filter("last.role = 'assistant'").select(
        "conversation_id", F.explode(uses).alias("block")
    ).select("conversation_id", "block.toolUse.*")


def tool_results(uses: DataFrame, answers: DataFrame) -> DataFrame:
    """Result blocks for tool uses; ``answers`` has (conversation_id, toolUseId, content, error)."""
    status = F.when(F.col("error").isNotNull(), "error").otherwise("success")
    return uses.select("conversation_id", "toolUseId").join(answers, ["conversation_id", "toolUseId"]).select(
        "conversation_id", F.struct("toolUseId", "content", status.alias("status")).alias("toolResult")
    )


def display_text(messages: DataFrame) -> DataFrame:
    """The text blocks of every message, one row per block."""
    texts = F.filter("content", lambda block: block["text"].isNotNull())
    return messages.select("conversation_id", "turn", "role", F.posexplode(texts).alias("block_no", "block")).select(
        "conversation_id", "turn", "role", "block_no", "block.text"
    )

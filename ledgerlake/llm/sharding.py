"""Byte-balanced shards by Karmarkar-Karp differencing.

Rows with equal texts form a group that one shard must hold. A partial partition is a vector of shard
sums; differencing repeatedly combines the two partial partitions with the largest spread, the large
sums of one with the small sums of the other. Groups are dealt into buckets by a hash of their text;
a task differences the groups of a bucket, and the driver differences the buckets, of which it sees
the shard sums only. Buckets grow with the square root of the groups, so both levels stay small.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerlake.llm.common import extended, numbered
from ledgerlake.workspace import written

#: Least number of groups that a bucket is meant to hold.
BUCKET_GROUPS = 500
#: Most groups that are differenced on the driver one by one.
HEAVY = 16_000


def difference(vectors: list[list[int]]) -> list[list[int]]:
    """For each vector of sums, the shard of each of its places, so that shard totals are near equal.

    Every place of a vector goes to another shard. Ties are broken by the order of the vectors.
    """
    if not vectors:
        return []
    k = len(vectors[0])
    sums: list[list[int]] = []
    made: list[tuple[int, int, list[int]] | None] = []
    orders = []
    for vector in vectors:
        order = sorted(range(k), key=lambda j: (-vector[j], j))
        orders.append(order)
        sums.append([vector[j] for j in order])
        made.append(None)
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        added = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        order = sorted(range(k), key=lambda j: -added[j])
        made.append((a, b, order))
        sums.append([added[j] for j in order])
        sums[a] = sums[b] = []
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    shards: list[list[int]] = [[]] * len(sums)
    shards[-1] = list(range(k))
    for node in range(len(sums) - 1, len(vectors) - 1, -1):
        a, b, order = made[node]
        mine = [0] * k
        for place, j in enumerate(order):
            mine[j] = shards[node][place]
        shards[a], shards[b], shards[node] = mine, mine[::-1], []
    result = []
    for i, order in enumerate(orders):
        placed = [0] * k
        for place, j in enumerate(order):
            placed[j] = shards[i][place]
        result.append(placed)
    return result


def balanced(groups: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """Rows (``key``, shard) for ``groups`` of distinct keys with whole sizes; totals of shards near equal.

    Groups of more than 1/``HEAVY`` of all bytes, at most ``HEAVY`` of them, are differenced on the
    driver. What they leave uneven is split over every second bucket (over all, if it is much), each of
    which differences its groups against its share. The other buckets stay free to be turned against
    the rest.
    """
    groups = written(groups.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")), "shard-groups")
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    is_heavy = F.col("size") > int(total) // HEAVY
    heavy = groups.where(is_heavy).orderBy(F.desc("size"), "key").collect()
    uneven, heavy_rows = [0] * shards, []
    for row, places in zip(heavy, difference([[int(r["size"])] + [0] * (shards - 1) for r in heavy])):
        uneven[places[0]] += int(row["size"])
        heavy_rows.append((row["key"], places[0]))
    light = int(total) - sum(uneven)
    uneven = [u - min(uneven) for u in uneven]
    buckets = max(1, math.ceil((n - len(heavy)) / max(BUCKET_GROUPS, math.isqrt(n))))
    much = buckets < 4 or 4 * sum(max(uneven) - u for u in uneven) > light
    bound = buckets if much else buckets // 2
    share = [-(-u // bound) for u in uneven]
    bucketed = groups.where(~is_heavy).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "key"], ascending=False)
        start = [share] if part["bucket"].iloc[0] < bound else [[0] * shards]
        dealt = difference(start + [[int(s)] + [0] * (shards - 1) for s in part["size"]])
        shard_of = {place: shard for shard, place in enumerate(dealt[0])}
        return part.assign(part=[shard_of[d[0]] for d in dealt[1:]])

    schema = extended(bucketed.schema, part=IntegerType())
    parts = written(bucketed.groupBy("bucket").applyInPandas(inside, schema), "shard-parts")
    sums: dict[int, list[int]] = {}
    for bucket, place, bytes_ in parts.groupBy("bucket", "part").agg(F.sum("size")).collect():
        sums.setdefault(bucket, [0] * shards)[place] += int(bytes_)
    free = sorted(b for b in sums if b >= bound)
    fixed = [u + sum(sums[b][j] for b in sums if b < bound) for j, u in enumerate(uneven)]
    first, *turned = difference([fixed, *[sums[b] for b in free]])
    shard_of = {place: shard for shard, place in enumerate(first)}
    rows = [(b, j, j) for b in sums if b < bound for j in range(shards)]
    rows += [(b, j, shard_of[place]) for b, places in zip(free, turned) for j, place in enumerate(places)]
    session = groups.sparkSession
    named = session.createDataFrame(rows, "bucket int, part int, shard int")
    alone = session.createDataFrame(heavy_rows, StructType([groups.schema["key"], StructField("shard", IntegerType())]))
    placed = parts.join(named, ["bucket", "part"]).select("key", "shard").union(alone)
    return placed.select(F.col("key").alias(key), "shard")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put each row into one of ``shards`` by bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Equal texts share a shard, and so
    do all null texts. Slots are gapless from 0 in each shard; their order has no meaning. Repeated rows
    have a slot each. text_crc32 of a null text is that of the empty text. ``grown_shard`` is null, as
    the law is ``bytes``. Other columns are not returned; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.sha2("text", 256)).alias("digest"),
    )
    rows = written(rows, "shard-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    placed = rows.join(balanced(groups, "digest", "bytes", shards), "digest").drop("digest")
    numbered_rows = numbered(placed, ["shard"], "slot", "shard-slots")
    return numbered_rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Near duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints are split into two segments of 32 bits. Two fingerprints within ``max_bits`` either have
first segments within ``max_bits // 2`` bits, or second segments within a smaller ball; so each
fingerprint enumerates the small Hamming ball around each of its segments, fetches what the segment
tables hold under those values, and verifies the whole distance.

A segment value with many fingerprints (a large group of near copies) is not fetched pair by pair:
the fingerprints that meet it enumerate their whole 64-bit ball of half the distance instead. Two
fingerprints within the distance share a ball member, and a member is shared by at most 65 of them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from ledgerlake.llm.common import aside, components, extended, utf8
from ledgerlake.workspace import written

SEED = 42
HALF = 32
#: Fingerprints under one segment value beyond which they are met through whole balls.
CROWDED = 32
_CHUNK = 1 << 16


def simhash(text: bytes | None, shingle: int) -> int:
    """Signed 64-bit fingerprint: A-Z lowered, words split at ASCII white space, XXH64 per shingle."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        form = b" ".join([b"%b"] * shingle)
        hashes = [digest(form % s, SEED) for s in zip(*[words[i:] for i in range(shingle)])]
    values = np.array(hashes, dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(values), _CHUNK):
        part = values[begin : begin + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(values)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint of the whole text as a long; other columns are kept.

    Null and empty texts have fingerprint 0. A column of ``docs`` named ``fp`` or ``__bytes`` is replaced.
    """
    kept = [c for c in docs.columns if c not in ("fp", "__bytes")]

    def run(batches):
        for batch in batches:
            fps = [simhash(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps, pa.int64())], names=[*kept, "fp"])

    shape = docs.select(*kept)
    schema = extended(shape.schema, fp=LongType())
    return shape.withColumn("__bytes", utf8()).mapInArrow(run, schema)


def links(fps: DataFrame, max_bits: int, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) that join distinct fingerprints ``fps.fp`` exactly as "within ``max_bits``" does.

    Every returned pair is within ``max_bits`` bits, and fingerprints within ``max_bits`` are connected
    by returned pairs. Crowded values are linked through a shared ball member, in number linear in the
    fingerprints. ``max_bits`` is 1 to 4.
    """
    if not 1 <= max_bits <= 4:
        raise ValueError("max_bits must be 1 to 4")
    radius = max_bits // 2
    second = radius if max_bits % 2 else radius - 1
    halves = [F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))]
    table = fps.select("fp", F.posexplode(F.array(*halves)).alias("segment", "value"))
    counts = table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("only"))
    full = written(counts.where(F.col("n") > crowded).select("segment", "value"), "simhash-crowded")
    balls = [_ball(h, r) for h, r in zip(halves, (radius, second)) if r >= 0]
    probes = fps.select("fp", F.posexplode(F.array(*balls)).alias("segment", "values"))
    probes = probes.select("fp", "segment", F.explode("values").alias("value"))
    # few values have two or more fingerprints; only those need a join that multiplies rows
    single = counts.where("n = 1").select("segment", "value", F.col("only").alias("other"))
    several = _exploded(table).join(counts.where((F.col("n") > 1) & (F.col("n") <= crowded)), ["segment", "value"])
    held = single.union(several.select("segment", "value", F.col("fp").alias("other")))
    marks = full.select("segment", "value", F.lit(None).cast("long").alias("other"))
    met = _exploded(probes).join(held.union(marks), ["segment", "value"])
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    met = met.where(F.col("other").isNull() | ((F.col("fp") != F.col("other")) & near))
    met = written(met.select("fp", "other").distinct(), "simhash-met")
    pairs = met.where("other is not null").select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    dense = met.where("other is null").select("fp")
    return pairs.distinct().union(_through_balls(dense, max_bits))


def _exploded(rows: DataFrame) -> DataFrame:
    """``rows``, never broadcast: Spark sizes a table as it is before an explode, a ball as one value."""
    return rows.hint("merge")


def _through_balls(dense: DataFrame, max_bits: int) -> DataFrame:
    half = (max_bits + 1) // 2
    members = _exploded(dense.select("fp", F.explode(_ball(F.col("fp"), half, 64)).alias("member")))
    if max_bits % 2 == 0:  # sharing a member proves the distance to be at most 2 * half = max_bits
        least = members.groupBy("member").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
        shared = members.join(least.where("a < z"), "member").where("fp > a")
        return shared.select("a", F.col("fp").alias("b")).distinct()
    other = members.select("member", F.col("fp").alias("other"))
    pairs = members.join(other, "member").where("fp < other")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    return pairs.where(near).select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def _ball(value, radius: int, width: int = HALF):
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << i for i in bits) for bits in combinations(range(width), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.lit(signed), lambda m: value.bitwiseXOR(m))


def near_groups(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """The group of each fingerprint of ``prints`` (doc_id, fp): rows (fp, root, component_id).

    ``root`` is the least fingerprint and ``component_id`` the smallest doc_id reachable through links
    of at most ``max_bits`` differing bits; equal fingerprints are linked. Null ids lose against others;
    a group without any id has a null.
    """
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    found = written(components(links(fps, max_bits), "a", "b", "simhash-links"), "simhash-components")
    joined = found.select(F.col("node").alias("fp"), "root").join(fps, "fp")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = found.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    alone = fps.select("fp", "least").join(linked, "fp", "left")
    return alone.select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts share fingerprint zero. Repeated rows stay, each with its component. Other
    columns of ``docs`` are not returned. An empty table gives no rows.
    """
    prints = written(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "simhash-docs")
    groups = near_groups(prints, max_bits)
    joined = prints.join(groups, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest doc_id.

    Of repeated rows with that id one stays (the smallest by text, then any). Rows without an id stay
    only where their whole group has none. All columns are kept.
    """
    prints = written(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "simhash-docs")
    # not broadcast: hashed rows take ten times the files that Spark sizes them by
    named = prints.hint("merge").join(near_groups(prints, max_bits), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = named.groupBy("root").agg(F.min("fp").alias("__fp"), F.min("doc_id").alias("__id"))

    def work(rows: DataFrame) -> DataFrame:
        same = (F.col("fp") == F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("__id"))
        kept = fingerprints(rows, shingle).join(chosen.select("__fp", "__id"), same, "left_semi")
        first = F.row_number().over(Window.partitionBy("fp", "doc_id").orderBy("text"))
        return kept.withColumn("__first", first).where("__first = 1")

    return aside(docs, work)

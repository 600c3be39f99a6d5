"""Document fingerprints: a Merkle tree over sections, paragraphs and spans, in DataFrame functions only.

Sections are parted by empty lines, paragraphs by line ends, and a paragraph is cut into spans of at
most ``SPAN`` code points. A span's node is its MD5, an inner node the MD5 of its children's nodes, and
the root the SHA-256 of the sections' nodes: equal texts have equal roots. The fingerprint shows the
root and, of every node below, eight digits: ``root/section[paragraph(spans)...]...``. Two fingerprints
are compared by their spans, and differing branches tell where an edit is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPAN = 32
#: Bytes of text that a bucket of the order is meant to hold, and the most buckets.
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 16


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """``df`` with the fingerprint of the non-null column ``text`` and its distinct spans.

    Adds ``{prefix}fingerprint`` (string), ``{prefix}spans`` (distinct eight-digit nodes of the spans)
    and ``{prefix}paragraphs`` (nodes of all paragraphs in order).
    """
    spans, inner, outer = f"{prefix}__spans", f"{prefix}__inner", f"{prefix}__outer"
    df = df.withColumn(
        spans,
        F.expr(
            f"transform(split(`{text}`, '\\n\\n'), s -> transform(split(s, '\\n'), "
            f"p -> transform(regexp_extract_all(p, '[^\\n]{{1,{SPAN}}}', 0), x -> md5(x))))"
        ),
    )
    df = df.withColumn(
        inner,
        F.expr(
            f"transform(`{spans}`, s -> transform(s, p -> named_struct('node', md5(concat_ws('', p)), "
            f"'shown', concat_ws('', transform(p, x -> left(x, 8))))))"
        ),
    )
    df = df.withColumn(
        outer,
        F.expr(
            f"transform(`{inner}`, s -> named_struct('node', md5(concat_ws('', s.node)), "
            f"'shown', concat_ws('', transform(s, p -> concat(left(p.node, 8), '(', p.shown, ')')))))"
        ),
    )
    return df.select(
        *[c for c in df.columns if c not in (spans, inner, outer)],
        F.expr(
            f"concat(sha2(concat_ws('', `{outer}`.node), 256), '/', "
            f"concat_ws('', transform(`{outer}`, s -> concat(left(s.node, 8), '[', s.shown, ']'))))"
        ).alias(f"{prefix}fingerprint"),
        F.expr(f"array_distinct(transform(flatten(flatten(`{spans}`)), x -> left(x, 8)))").alias(f"{prefix}spans"),
        F.expr(f"flatten(transform(`{inner}`, s -> s.node))").alias(f"{prefix}paragraphs"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, spans and paragraphs of every whole text; a null text is as an empty one."""
    return with_tree(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")), "__text", "").drop("__text")


def likeness(fingerprint: Column, spans: Column, other_fingerprint: Column, other_spans: Column) -> Column:
    """1 for equal fingerprints, else the shared part of the distinct spans of both (0 to 1)."""
    shared = F.try_divide(F.size(F.array_intersect(spans, other_spans)), F.size(F.array_union(spans, other_spans)))
    return F.when(fingerprint == other_fingerprint, F.lit(1.0)).otherwise(F.coalesce(shared.cast("double"), F.lit(0.0)))


def changed(paragraphs: Column, other: Column) -> Column:
    """Places (from 0) of the paragraphs whose branches differ, up to the longer tree's end."""
    zipped = F.arrays_zip(paragraphs.alias("a"), other.alias("b"))
    marked = F.transform(zipped, lambda p, i: F.when(p["a"].eqNullSafe(p["b"]), F.lit(-1)).otherwise(i))
    return F.filter(marked, lambda i: i >= 0)


def _bucket(bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are not above doc_id, by binary search; rows without an id: 0."""
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(int(b)).cast("long") for b in bounds]) if len(bounds) < 64 else F.lit(bounds).cast("array<bigint>")

    def halve(state, _):
        mid = F.floor((state["low"] + state["high"]) / 2).cast("int")
        below = F.element_at(held, F.least(mid + 1, F.lit(len(bounds)))) <= F.col("doc_id")
        open_ = state["low"] < state["high"]
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(state["low"]).alias("low"),
            F.when(open_ & ~below, mid).otherwise(state["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    found = F.aggregate(steps, start, halve, lambda s: s["low"])
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(found)


def with_next(docs: DataFrame, columns: dict[str, str], make) -> DataFrame:
    """Each row with values of the row after it in descending doc_id; after the last comes the first.

    ``make`` maps the ordered rows (doc_id, text) to a DataFrame with further columns by DataFrame
    operations that keep rows; it is called before ``columns`` (new name: column) are taken from the next
    row. Rows are dealt into buckets by quantiles of the id; each bucket also holds the first rows of the
    next one, so a bucket needs no other. Equal ids are ordered by text, rows without an id come last.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    wanted = int(min(MOST_BUCKETS, max(1, -(-n_bytes // BUCKET_BYTES))))
    shares = [i / wanted for i in range(1, wanted)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * wanted))).first()[0] if shares else []
    bounds = sorted(set(bounds or []))
    dealt = rows.withColumn("__bucket", _bucket(bounds))
    tops = dealt.groupBy("__bucket").agg(F.max("doc_id")).collect()  # at most one row per bucket
    tops = sorted((b, top) for b, top in tops)
    before = [(top, tops[i + 1][0]) if i + 1 < len(tops) else (top, tops[0][0]) for i, (_, top) in enumerate(tops)]
    heads = docs.sparkSession.createDataFrame(before, "top bigint, __at int")
    first = rows.join(F.broadcast(heads), F.col("doc_id").cast("long").eqNullSafe(F.col("top")))
    guests = first.select("doc_id", "text", F.col("__at").alias("__bucket"), F.lit(1).alias("__guest"))
    ordered = dealt.withColumn("__guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("__bucket").orderBy("__guest", F.desc_nulls_last("doc_id"), "text")
    ordered = ordered.withColumn("__next_text", F.lead("text").over(order))
    made = make(ordered)
    for name, column in columns.items():
        made = made.withColumn(name, F.lead(column).over(order))
    return made.where("__guest = 0").withColumnRenamed("__next_text", "next_text").drop("__bucket", "__guest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of an edited text, and their likenesses.

    The edited text is the text whose last third (rounded down) of the code points gives way to as many
    from the start of the next document, by descending doc_id; after the last comes the first. One row
    per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    changed (places of the paragraphs that differ). A null text is as an empty one; of equal ids the one
    with the smaller text is earlier; rows without an id come last. Other columns are not returned.
    """
    found = with_next(
        docs,
        {"next_fingerprint": "fingerprint", "next_spans": "spans"},
        lambda ordered: with_tree(ordered, "text", ""),
    )
    third = F.floor(F.length("text") / 3).cast("int")
    found = found.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    )
    found = with_tree(found, "edited", "edited_")
    edited = likeness(F.col("fingerprint"), F.col("spans"), F.col("edited_fingerprint"), F.col("edited_spans"))
    after = likeness(F.col("fingerprint"), F.col("spans"), F.col("next_fingerprint"), F.col("next_spans"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        edited.alias("near_edited"),
        after.alias("near_next"),
        changed(F.col("paragraphs"), F.col("edited_paragraphs")).alias("changed"),
    )

import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlake.functions.text import strip, tokenize
from ledgerlake.operators import chunking

SLOW = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ODD = st.text(alphabet=" \t\n\x0b\x1c\x85\xa0  　aB1_é#ßЖ中-.", max_size=40)


def chunks(spark, **texts):
    df = spark.createDataFrame(list(texts.items()), "document_name string, text string")
    order = ["document_name", "section_index", "sub_index"]
    return [(r["chunk_id"], r["section_title"], r["content"]) for r in chunking.chunk(df).orderBy(*order).collect()]


@SLOW
@given(texts=st.lists(ODD, min_size=1, max_size=20))
def test_strip_and_tokens_follow_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = df.select("i", strip(F.col("t")).alias("s"), tokenize(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r["s"] for r in found] == [t.strip() for t in texts]
    assert [r["w"] for r in found] == [[w for w in re.findall(r"\w+", t.lower()) if len(w) > 1] for t in texts]


LINES = st.lists(
    st.sampled_from(["## A b", "### C", "# D", "##E", " ## F", "", "  ", "text", "x" * 60, "a ## b", "## ", "#"]), max_size=12
)


@SLOW
@given(documents=st.lists(LINES, min_size=1, max_size=10))
def test_sections_start_at_heading_lines(spark, documents):
    """Sections and numbers against collecting lines one by one."""
    texts = ["\n".join(lines) for lines in documents]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_name string, text string")
    expected = set()
    for name, text in enumerate(texts):
        groups = [[]]
        for line in text.split("\n"):
            if line.startswith("## "):
                groups.append([])
            groups[-1].append(line)
        for index, lines in enumerate(groups):
            whole = "\n".join(lines).strip()
            if whole:
                head, _, rest = whole.partition("\n")
                titled = head.startswith(("## ", "# "))
                title, body = (head.lstrip("#").strip(), rest.strip()) if titled else ("Introduction", whole)
                expected.add((str(name), index, title, body))
    assert {tuple(r) for r in chunking.sections(df).collect()} == expected


@SLOW
@given(parts=st.lists(st.text(alphabet="ab c", min_size=1, max_size=30).map(str.strip).filter(bool), min_size=1, max_size=30))
def test_packing_is_greedy_and_loses_nothing(spark, parts):
    df = spark.createDataFrame([(parts,)], "parts array<string>")
    packed = df.select(chunking.pack(F.col("parts"), limit=40).alias("p")).first()["p"]
    assert [p for text in packed for p in text.split("\n\n")] == parts
    for text, following in zip(packed, [*packed[1:], None], strict=True):
        assert len(text) <= 40 or "\n\n" not in text
        if following is not None:
            assert len(text) + 2 + len(following.split("\n\n")[0]) > 40


@pytest.mark.parametrize("length, kept", [(49, 0), (50, 1), (1500, 1)])
def test_size_bounds(spark, length, kept):
    found = chunks(spark, d="## Title\n" + "x" * length)
    assert [c[0] for c in found] == ["d#1"] * kept


def test_long_sections(spark):
    para = "p" * 700
    found = chunks(spark, d=f"## T\n{para}\n \t\n{para}\n\n\n{para}", e="## T\n" + "x" * 1501, f="y" * 20 + "\n\n" + "x" * 1501)
    assert [(c[0], len(c[2])) for c in found] == [("d#1.0", 1402), ("d#1.1", 700), ("e#1.0", 1501), ("f#0.0", 20), ("f#0.1", 1501)]


def test_titles_numbers_and_names(spark):
    body = "The body of a section is long enough when it has fifty characters."
    found = chunks(
        spark, a=f"## First\n{body}\n### Detail\nmore", b=f"# Name\n\n## Only\n{body}", c=f"{body}\n## Next ##\n{body}", d=f"# Name\n{body}",
    )
    assert found == [
        ("a#1", "First", f"{body}\n### Detail\nmore"), ("b#1", "Only", body), ("c#0", "Introduction", body),
        ("c#1", "Next ##", body), ("d#0", "Name", body),
    ]


def test_counts_and_previews(spark, rows):
    body = "é" * 200
    df = spark.createDataFrame([("a", f"## X\n{body}\n## Y\n{body}"), ("b", body)], "document_name string, text string")
    made = chunking.chunk(df)
    assert rows(chunking.chunk_counts(made)) == [("a", 2), ("b", 1)]
    assert rows(chunking.corpus_totals(made)) == [(3, 2)]
    assert rows(chunking.first_chunks(made)) == [("a", "a#1", "X", "é" * 150, 200), ("b", "b#0", "Introduction", "é" * 150, 200)]


def test_texts_are_split_once_and_not_copied_with_their_chunks(spark):
    """Lambdas evaluate what they are given for every element, and an explode copies every column that is kept."""
    docs = spark.createDataFrame([("a", "one\n\n" * 600), ("b", "two")], "document_name string, text string")
    packed = docs.select(chunking.pack(chunking.paragraphs(F.col("text"))).alias("texts"))
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    plan = chunking.chunk(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    above = plan.split("Generate ")[0]
    assert "content#" in above and "body#" not in above

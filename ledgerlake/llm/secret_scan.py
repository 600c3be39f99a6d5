"""Secrets in texts: fixed patterns, and guess costs of values in a credential context.

The guess cost of a value is that of its cheapest segmentation into words, dates, repeats, sequences,
keyboard walks and brute-force spans, found by dynamic programming over its characters. Values next to
a credential word whose cost is high are secrets that the fixed patterns may not cover.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.common import aside

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # as dropping shorter runs: a run is matched from its first character
_HINTS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "guess")

# credential contexts of the guess scan, wider than the fixed patterns
_CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|pin|credentials?|auth(?:orization)?|login|bearer|secret|token"""
    r"""|(?:api|access|private|client|encryption)[_-]?(?:key|secret)|key)["']?[ \t]*(?:[:=]|=>|\bis\b)[ \t]*["'`]?"""
    r"""([!#-&(-_a-~]{6,})""",
    re.ASCII | re.IGNORECASE,
)
_CONTEXT_HINTS = ("pass", "pwd", "pin", "credential", "auth", "login", "bearer", "secret", "token", "key")

# -- fixed values: frequent parts of chosen passwords
WORDS = (
    "password passwd pass word admin root user login welcome secret token master letmein dragon monkey shadow "
    "sunshine princess football baseball iloveyou love test demo example sample dummy changeme default guest "
    "hello world qwerty azerty abc access super star summer winter spring autumn monday friday january june july "
    "august december server database mysql oracle postgres linux windows system network public private key api "
    "my the you your none null true false string value here insert replace placeholder redacted xxx foo bar baz"
).split()
KEYBOARD_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

#: Guesses, as a power of ten, from which on a value counts as a secret, and characters it must have.
THRESHOLD = 10.0
LEAST_LENGTH = 8

_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_NEXT: dict[str, str] = {}
for _row, _under in zip(KEYBOARD_ROWS, (*KEYBOARD_ROWS[1:], "")):
    for _i, _c in enumerate(_row):
        _near = _row[max(0, _i - 1) : _i] + _row[_i + 1 : _i + 2] + _under[max(0, _i - 1) : _i + 1]
        _NEXT[_c] = _NEXT.get(_c, "") + _near
        for _o in _near:
            _NEXT[_o] = _NEXT.get(_o, "") + _c


def _alphabet(c: str) -> int:
    if c.isdigit():
        return 10
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return 26
    return 33 if c < "\x7f" else 1000


def guess_cost(value: str) -> float:
    """Least number of guesses for ``value``, as a power of ten, over all segmentations.

    Costs of segments add up, with one more choice among kinds per segment after the first. A word
    costs its rank (and a little for capitals or exchanged characters), a date its range of days, a
    repeat its unit and count, a sequence or keyboard walk its start and length, and any other
    character its alphabet. The empty value costs nothing. Time grows linearly with the value, as words
    and dates are short and runs are followed once.
    """
    n = len(value)
    low = value.lower()
    plain = "".join(LEET.get(c, c) for c in low)
    best = [0.0] + [math.inf] * n
    kind = math.log10(5)
    step = [0] * n  # difference to the character before
    run_same, run_step, run_walk = [0] * n, [0] * n, [0] * n  # where the run that ends here begins
    for i in range(1, n):
        step[i] = ord(low[i]) - ord(low[i - 1])
        run_same[i] = run_same[i - 1] if step[i] == 0 else i
        sequence = abs(step[i]) == 1 and low[i].isalnum() and low[i - 1].isalnum()
        run_step[i] = (run_step[i - 1] if i > 1 and step[i] == step[i - 1] else i - 1) if sequence else i
        run_walk[i] = run_walk[i - 1] if low[i] in _NEXT.get(low[i - 1], "") else i
    period = _periods(low)
    for end in range(1, n + 1):
        last = end - 1
        found = best[last] + math.log10(_alphabet(value[last]))
        for size in range(2, min(_LONGEST, end) + 1):
            begin = end - size
            rank = _RANK.get(low[begin:end])
            changed = 0.0
            if rank is None:
                rank, changed = _RANK.get(plain[begin:end]), math.log10(4)
            if rank is not None:
                capitals = math.log10(2) if value[begin:end] != low[begin:end] else 0.0
                found = min(found, best[begin] + _joint(begin, kind) + math.log10(rank + 1) + changed + capitals)
        for size in range(4, min(10, end) + 1):
            begin = end - size
            if value[begin].isdigit() and _DATE.fullmatch(value, begin, end):
                found = min(found, best[begin] + _joint(begin, kind) + math.log10(365 * 120))
        for runs, each in ((run_same, 0.0), (run_step, math.log10(2)), (run_walk, math.log10(4))):
            begin = runs[last]
            size = end - begin
            if size >= 3:
                turns = size if runs is run_walk else 1
                cost = math.log10(_alphabet(value[begin])) + each * turns / 2 + math.log10(size)
                found = min(found, best[begin] + _joint(begin, kind) + cost)
        for width, since in period:
            size = end - since[last]
            if size >= 2 * width:
                begin = since[last]
                unit = best[begin + width] - best[begin]
                found = min(found, best[begin] + _joint(begin, kind) + max(unit, 0.5) + math.log10(size / width))
        best[end] = found
    return best[n]


def _joint(begin: int, kind: float) -> float:
    return kind if begin else 0.0


def _periods(low: str, widths=range(2, 9)) -> list[tuple[int, list[int]]]:
    """For each width, where the longest run that ends at a place and repeats with that width begins."""
    found = []
    for width in widths:
        since = list(range(len(low)))
        for i in range(1, len(low)):
            if i >= width and low[i] == low[i - width]:
                since[i] = min(since[i - 1], i - width)
        if any(i - s + 1 >= 2 * width for i, s in enumerate(since)):
            found.append((width, since))
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind; code points, end exclusive."""
    found = []
    folded = text.lower()
    if any(h in folded for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def guessed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
    """(start, end, cost) of values in a credential context whose guess cost reaches ``threshold``."""
    folded = text.lower()
    if not any(h in folded for h in _CONTEXT_HINTS):
        return []
    found = []
    for match in _CONTEXT.finditer(text):
        begin, end = match.span(1)
        value = match.group(1).rstrip(",;.)]}>\"")
        end = begin + len(value)
        if len(value) < LEAST_LENGTH or value.isalpha() and (value.islower() or value.istitle()):
            continue  # a plain word after the credential word is prose
        cost = guess_cost(value)
        if cost >= threshold:
            found.append((begin, end, cost))
    return found


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``found``: kind, start, end, cost of every span, by start, then kind.

    ``cost`` is the guess cost of the span's text as a power of ten. Spans of kind ``guess`` are values
    whose cost reaches ``threshold`` and that no fixed pattern holds. Offsets are code points of the whole text. Null
    and empty texts have no spans; repeated rows each get theirs. Columns are kept; one named ``found``
    is replaced.
    """
    kept = [c for c in docs.columns if c not in ("found", "__text")]
    shape = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema.fields)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                spans = []
                if text:
                    spans = [(s, e, k, guess_cost(text[s:e])) for s, e, k in base_spans(text)]
                    for s, e, cost in guessed_spans(text, threshold):
                        if not any(b <= s and e <= f for b, f, *_ in spans):  # else it is reported already
                            spans.append((s, e, "guess", cost))
                    spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
                rows.append([{"kind": k, "start": s, "end": e, "cost": c} for s, e, k, c in spans])
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(span))], names=[*kept, "found"])

    result = f"{schema}, found array<struct<kind:string,start:long,end:long,cost:double>>"
    return shape.withColumn("__text", F.col("text")).mapInArrow(run, result)


def report(found: DataFrame) -> DataFrame:
    """Per row of ``scan``: counts of the fixed kinds, base_sha256 and spans."""

    def listed(kinds):
        chosen = F.filter("found", lambda s: s["kind"].isin(*kinds))
        texts = F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.concat_ws(",", texts)

    def number(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in KINDS], F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans")
    )


def redact(docs: DataFrame, threshold: float = THRESHOLD, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping ones by one), n_chars counted anew.

    Texts without a span stay as they are, and so does a null text. All rows and columns are kept.
    """

    def after(done, s):
        cut = F.greatest(s["start"], done["at"])
        text = F.when(s["start"] >= done["at"], F.concat(done["text"], F.substr(done["all"], done["at"] + 1, cut - done["at"]), F.lit(mask)))
        return F.struct(
            text.otherwise(done["text"]).alias("text"), F.greatest(done["at"], s["end"]).alias("at"), done["all"].alias("all")
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"), F.col("text").alias("all"))
    joined = F.aggregate("found", start, after, lambda d: F.concat(d["text"], F.substr(d["all"], d["at"] + 1, F.length(d["all"]).cast("long"))))
    masked = F.when(F.size("found") > 0, joined).otherwise(F.col("text"))

    def work(rows: DataFrame) -> DataFrame:
        result = scan(rows, threshold).withColumn("text", masked)
        if "n_chars" not in rows.columns:
            return result
        counted = F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        return result.withColumn("n_chars", counted)

    return aside(docs, work, ("doc_id", "text", "n_chars"))

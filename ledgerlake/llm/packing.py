"""Packing token sequences: a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The covering program (use every
length as often as it occurs, with the fewest configurations) is solved by multiplicative weights:
lengths that lag behind get a higher price, and a knapsack dynamic program over the capacity prices
all configurations at once. The fractional solution is rounded down, and the few pieces that are left
go by best fit. Only the histogram (at most one row per length) reaches the driver; pieces get their
place by their number among the pieces of their length.

Where lengths are many and mix well, a few rounds from prices that are the volumes end at the volume bound. Where
that leaves a gap, rounds from equal weights of all lengths go on until the fractional solution is within ``GAP``
of the dual bound that the prices give. No plan takes more sequences than best fit alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from ledgerlake.llm.common import extended, numbered, utf8
from ledgerlake.llm.tokens import WordIds, of_worker

CAPACITY = 4_096
#: Of the linear program: rounds, growth of prices, share of each length that it covers, and how far
#: from the best a configuration may be.
ROUNDS = 6
RATE = 0.002
COVERED = 0.95
SLACK = 0.002
NEAR = 0.0003
#: Largest share by which the fractional solution may exceed the dual bound; growth of lagging prices, coarse to
#: fine, and rounds with each.
GAP = 0.005
RATES = {0.3: 200, 0.1: 4_000, 0.03: 7_000, 0.01: 12_000}
#: Work of these rounds in lengths times rounds, so that a histogram of thousands of lengths ends, too.
PRICED = 400_000


# -- pieces


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every whole text: doc_id, piece, start, length, ids.

    ``ids`` are little-endian unsigned 32-bit ids, ``end_id`` after the last. Null and empty texts are
    one piece of the end id alone. Only texts longer than ``capacity`` are cut. Repeated rows give
    repeated pieces; null ids stay null. Other columns are not returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = of_worker(WordIds, tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                made: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        cut = ids[at : at + width]
                        for column, value in zip(made, (doc_id, piece, at // 4, len(cut) // 4, cut)):
                            column.append(value)
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, types)], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids binary"
    return docs.select("doc_id", utf8()).mapInArrow(run, schema)


# -- the linear program, on the histogram alone


def _knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Best total value that fits each capacity."""
    best = np.zeros(capacity + 1)
    gain = value[sizes]
    for c in range(1, capacity + 1):
        n = np.searchsorted(sizes, c, side="right")
        best[c] = max(best[c - 1], (best[c - sizes[:n]] + gain[:n]).max()) if n else best[c - 1]
    return best


def _configuration(first: int, best, value, sizes, free, capacity: int, draws) -> list[int]:
    """``first`` and an optimal filling of the room beside it, traced through the dynamic program.

    Where several lengths continue an optimal filling, one is drawn in proportion to its pieces that
    are still to be covered; it is shorter than optimal only where none of those has pieces.
    """
    room, chosen = capacity - first, [first]
    taken = {first: 1}
    while room > 0 and best[room] > 0:
        n = np.searchsorted(sizes, room, side="right")
        some = sizes[:n]
        weight = np.where(best[room - some] + value[some] >= best[room] - NEAR * capacity, free[some], 0.0)
        for size, k in taken.items():
            if size <= room and free[size] < k + 1:
                weight[np.searchsorted(some, size)] = 0.0
        mass = np.cumsum(weight)
        if mass[-1] < 1e-9:
            return chosen
        size = int(some[np.searchsorted(mass, draws.random() * mass[-1], side="right").clip(0, n - 1)])
        chosen.append(size)
        taken[size] = taken.get(size, 0) + 1
        room -= size
    return chosen


def solve(histogram: np.ndarray, capacity: int = CAPACITY) -> dict[tuple[int, ...], float]:
    """Fractional use of configurations that covers ``COVERED`` of each length of ``histogram``.

    Prices begin at the volumes (the dual of a perfect packing). Each round solves the priced knapsack
    once and covers a share of every length by optimal configurations, lagging lengths first; lengths
    that stay behind rise in price against the others by multiplicative weights. What cannot be covered
    by configurations that are optimal under the prices is left to rounding. Draws have a fixed seed.
    """
    draws = np.random.default_rng(capacity)
    sizes = np.flatnonzero(histogram)
    total = histogram.astype(float)
    covered = np.zeros(capacity + 1)
    value = np.arange(capacity + 1, dtype=float)
    use: dict[tuple[int, ...], float] = {}
    for round_ in range(1, ROUNDS + 1) if len(sizes) else ():
        goal = total * COVERED * round_ / ROUNDS
        best = _knapsack(value, sizes, capacity)
        lag = goal[sizes] - covered[sizes]
        for first in sizes[np.lexsort((-sizes, -np.round(lag / total[sizes], 2)))]:
            first = int(first)
            while (free := goal - covered)[first] > 1e-6:
                chosen = _configuration(first, best, value, sizes, free, capacity, draws)
                worth = value[chosen].sum()
                if worth < best[capacity] * (1 - SLACK):
                    break
                counted = {s: chosen.count(s) for s in chosen}
                step = min(free[s] / k for s, k in counted.items())
                key = tuple(sorted(chosen, reverse=True))
                use[key] = use.get(key, 0.0) + step
                for s, k in counted.items():
                    covered[s] += step * k
        behind = (goal[sizes] - covered[sizes]) / total[sizes]
        value[sizes] *= np.exp(RATE * (behind - behind.mean()))
        value[sizes] *= (sizes * total[sizes]).sum() / (value[sizes] * total[sizes]).sum()
    return use


def _filled(price: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Best total price that fits each capacity, length by length: pieces of one length as running maxima."""
    best = np.zeros(capacity + 1)
    for size, value in zip(sizes.tolist(), price.tolist()):
        rows = -(-(capacity + 1) // size)
        padded = np.full(rows * size, -np.inf)
        padded[: capacity + 1] = best
        paid = np.arange(rows)[:, None] * value
        best = (np.maximum.accumulate(padded.reshape(rows, size) - paid, axis=0) + paid).ravel()[: capacity + 1]
    return np.maximum.accumulate(best)


def _best_configuration(best: np.ndarray, price: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length is in a configuration of the best price."""
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while best[room] > 0:
        n = np.searchsorted(sizes, room, side="right")
        worth = best[room - sizes[:n]] + price[:n]
        i = int(worth.argmax())
        counts[i] += 1
        room -= int(sizes[i])
    return counts


def cover(histogram: np.ndarray, capacity: int = CAPACITY) -> tuple[dict[tuple[int, ...], float], float]:
    """Fractional use of configurations that covers ``histogram``, and a lower bound of any packing of it.

    Prices begin at one for all pieces of a length together. A round takes the configuration of the best price, up
    to a share of the length that it covers most of, and prices fall by the share that is covered. Prices scaled
    so that no configuration is worth more than one sequence bound every packing from below.
    """
    sizes = np.flatnonzero(histogram)
    amount = histogram[sizes].astype(float)
    bound, total, plan_ = float((sizes * amount).sum() / capacity), np.inf, {}
    price, left = 1 / amount, PRICED
    for rate, rounds in RATES.items():
        use: dict[tuple[int, ...], float] = {}
        covered = np.zeros(len(sizes))
        for round_ in range(rounds):
            counts = _best_configuration(_filled(price, sizes, capacity), price, sizes, capacity)
            bound = max(bound, float((amount * price).sum() / (counts * price).sum()))
            held = counts > 0
            step = rate * float((amount[held] / counts[held]).min())
            key = tuple(np.repeat(sizes, counts)[::-1].tolist())
            use[key] = use.get(key, 0.0) + step
            covered += step * counts
            price = price * np.exp(-step * counts / amount)
            price /= (price * amount).sum()
            left -= len(sizes)
            if round_ % 20 == 19 and covered.min() > 0:
                scale = float((covered / amount).min())
                if sum(use.values()) / scale < total:
                    total, plan_ = sum(use.values()) / scale, {k: v / scale for k, v in use.items()}
                if total <= (1 + GAP) * bound or left < 0:
                    return plan_, bound
    return plan_, bound


def best_fit(histogram: np.ndarray, capacity: int = CAPACITY) -> dict[tuple[int, ...], int]:
    """Longest pieces first, each into the fullest sequence that holds it; linear in the lengths used."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # room -> contents -> number
    rooms = np.zeros(capacity + 1, dtype=bool)
    for size in np.flatnonzero(histogram)[::-1]:
        size, left = int(size), int(histogram[size])
        while left:
            fitting = np.flatnonzero(rooms[size:])
            if len(fitting):
                room = int(fitting[0]) + size
                contents, n = bins[room].popitem()
            else:
                room, contents, n = capacity, (), -(-left // (capacity // size))
            many = max(1, min(room // size, left // n if n <= left else 1))
            used = min(n, left // many) or 1
            if n > used and room < capacity:
                bins[room][contents] = n - used
            if room < capacity and not bins[room]:
                rooms[room] = False
            after = room - many * size
            inside = bins.setdefault(after, {})
            key = contents + (size,) * many
            inside[key] = inside.get(key, 0) + used
            rooms[after] = True
            left -= used * many
    total: dict[tuple[int, ...], int] = {}
    for inside in bins.values():
        for contents, n in inside.items():
            total[contents] = total.get(contents, 0) + n
    return total


def _rounded(histogram: np.ndarray, use: dict[tuple[int, ...], float], capacity: int) -> dict[tuple[int, ...], int]:
    """Whole numbers of configurations for exactly the pieces of ``histogram``: rounded down, best fit for the rest."""
    left = histogram.copy()
    done: dict[tuple[int, ...], int] = {}
    for chosen, amount in sorted(use.items(), key=lambda x: (-sum(x[0]), -x[1], x[0])):
        counted = {s: chosen.count(s) for s in chosen}
        n = min([int(amount + 1e-6), *(int(left[s]) // k for s, k in counted.items())])
        if n > 0:
            done[chosen] = done.get(chosen, 0) + n
            for s, k in counted.items():
                left[s] -= n * k
    for chosen, n in best_fit(left, capacity).items():
        done[chosen] = done.get(chosen, 0) + n
    return done


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations that hold exactly the pieces of ``histogram``, in as few as were found."""
    best = _rounded(histogram, solve(histogram, capacity), capacity)
    volume = -(-int((np.arange(len(histogram)) * histogram).sum()) // capacity)
    if sum(best.values()) > (1 + GAP) * volume:
        use, _ = cover(histogram, capacity)
        others = [_rounded(histogram, use, capacity), best_fit(histogram, capacity)]
        best = min([best, *others], key=lambda x: sum(x.values()))
    return sorted(best.items())


# -- places


def pack(cut: DataFrame, capacity: int = CAPACITY, label: str = "packing") -> DataFrame:
    """``cut`` (any columns, with a ``length`` of 1 to ``capacity``) with sequence_id and offset.

    Sequences are gapless from offset 0 and hold at most ``capacity``. An empty table gives no rows;
    equal lengths may take each other's places. A column named sequence_id or offset is replaced.
    """
    kept = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    rows = numbered(cut.select(*kept), ["length"], "__rank", label)
    counted = rows.groupBy("length").agg((F.max("__rank") + 1).alias("n")).collect()
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counted:
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        histogram[length] = n
    places = rows.sparkSession.sparkContext.broadcast(_places(plan(histogram, capacity)))
    at = rows.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            lengths = batch.column(at).to_numpy()
            ranks = batch.column(batch.num_columns - 1).to_numpy()
            sequence = np.zeros(len(lengths), dtype=np.int64)
            offset = np.zeros(len(lengths), dtype=np.int64)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                begins, bases, offsets = table[int(length)]
                run_ = np.searchsorted(begins, ranks[mine], side="right") - 1
                sequence[mine] = bases[run_] + ranks[mine] - begins[run_]
                offset[mine] = offsets[run_]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]
            )

    schema = extended(cut.select(*kept).schema, sequence_id=LongType(), offset=LongType())
    return rows.mapInArrow(run, schema)


def _places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of piece numbers: where a run begins, its first sequence, its offset.

    The size is bounded by the capacity and the number of rounds, not by the pieces.
    """
    runs: dict[int, list[list[int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for chosen, n in planned:
        offset = 0
        for size in chosen:
            mine = runs.setdefault(size, [[], [], []])
            for column, value in zip(mine, (used.get(size, 0), base, offset)):
                column.append(value)
            used[size] = used.get(size, 0) + n
            offset += size
        base += n
    return {size: tuple(np.array(c, dtype=np.int64) for c in columns) for size, columns in runs.items()}

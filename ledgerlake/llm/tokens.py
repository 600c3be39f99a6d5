"""Token ids and counts by public tokenizer files, with words kept between texts.

Both pre-tokenizers used here treat the words of a text one by one, so a text's ids are those of its
words in a row. Each task keeps the ids (or counts) of the words it has met, up to a bound, and asks
the library for new ones only. Plain words with marks behind them are asked for in two parts, as the
pre-tokenizers part them there. Texts with anything but plain spacing, and other words, go to the
library as they are.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np

#: Words that a task keeps before the older half of them is dropped.
KEPT_WORDS = 400_000
#: Words of one request to the library.
REQUEST = 512

# letters of ASCII and Latin-1, then ASCII marks; an apostrophe may begin a contraction, a digit stands alone
_PARTED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def load(path: str):
    """The tokenizer of a ``.json`` file; without a thread pool, as Spark fills the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Kept:
    """Values by key of the last keys asked for; ``make`` gives those of a list of new keys."""

    def __init__(self, make, bound: int = KEPT_WORDS):
        self.make, self.bound = make, bound
        self.now: dict = {}
        self.before: dict = {}

    def hold(self, keys: set) -> dict:
        """Values of all ``keys`` and more; keys not asked for since the last two renewals are dropped."""
        if len(self.now) > self.bound:
            self.now, self.before = {}, self.now
        now, before = self.now, self.before
        new = [k for k in keys if k not in now]
        if before:
            now.update([(k, before[k]) for k in new if k in before])
            new = [k for k in new if k not in before]
        if new:
            now.update(zip(new, self.make(new)))
        return now


#: Stands behind a word as its end; no word part holds this character.
_END = "\x7f"


def byte_table() -> dict[str, int]:
    """Bytes by the printable characters that stand for them in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves; the others follow in order from code point 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def word_ranks(path: str) -> dict[bytes, int] | None:
    """Ids by bytes, with ``_END`` for the end of a word, where ids rank the merges; else None.

    That holds if the ids are those of the bytes, of the bytes at a word's end, and of the merges, in this order:
    the least id is then always the next merge, as bytes join the end of their word before anything else.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if not suffix or any(vocabulary.get(a + b) != 512 + i for i, (a, b) in enumerate(merges)):
        return None
    table, ranks = byte_table(), {}
    for name, i in vocabulary.items():
        if i < 512 + len(merges):
            stem = name.removesuffix(suffix) if i >= 256 else name
            if any(c not in table for c in stem):
                return None
            ranks[bytes(table[c] for c in stem) + (_END.encode() if stem != name else b"")] = i
    return ranks if len(ranks) == 512 + len(merges) and all(len(b) == 1 for b, i in ranks.items() if i < 256) else None


class WordIds:
    """Ids of texts under a tokenizer that lowers case and drops white space."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        ranks = word_ranks(path)
        self.ranked = None
        if ranks:
            import tiktoken

            pattern = f"[^{_END}]+{_END}"
            self.ranked = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.ends = np.zeros(len(ranks), dtype=bool)
            self.ends[[i for b, i in ranks.items() if b.endswith(_END.encode()) and i >= 256]] = True
        self.parts = Kept(self._encode)
        self.words = Kept(self._assemble)

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each part; parts that stand for one pre-token each go to the library as one text."""
        if self.ranked is not None:
            return self._rank(parts)
        found = []
        for begin in range(0, len(parts), REQUEST):
            some = parts[begin : begin + REQUEST]
            coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            word = coded.word_ids
            cuts = [i for i in range(len(word)) if not i or word[i] != word[i - 1]]
            if len(cuts) == len(some):
                ids = array("I", coded.ids).tobytes()
                found += [ids[4 * i : 4 * j] for i, j in zip(cuts, [*cuts[1:], len(word)])]
            else:
                found += self._each(some)
        return found

    def _rank(self, parts: list[str]) -> list[bytes]:
        """Ids of each part by the ranks of its merges; a part is a pre-token of letters or of marks."""
        found = []
        for begin in range(0, len(parts), REQUEST):
            some = parts[begin : begin + REQUEST]
            ids = np.array(self.ranked.encode_ordinary(_END.join(some) + _END), dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            found += [data[i:j] for i, j in zip([0, *cuts], cuts)]
        return found

    def _each(self, texts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", c.ids).tobytes() for c in coded]

    def _assemble(self, words: list[bytes]) -> list[bytes]:
        split = [_PARTED.fullmatch(word.decode()) for word in words]
        pairs = [(m[1].lower(), m[2]) if m else None for m in split]
        parts = self.parts.hold({p for pair in pairs if pair for p in pair if p})
        others = [w.decode() for w, pair in zip(words, pairs) if not pair]
        whole = iter([ids for i in range(0, len(others), REQUEST) for ids in self._each(others[i : i + REQUEST])])
        return [parts[p[0]] + (parts[p[1]] if p[1] else b"") if p else next(whole) for p in pairs]

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        rows = [t.split() if t else [] for t in texts]
        known = self.words.hold(set().union(*rows))
        return [b"".join([known[w] for w in row]) for row in rows]


class TokenCounts:
    """Numbers of tokens under a byte-level tokenizer that puts a space before its word."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.parts = Kept(self._count)
        self.first = Kept(lambda words: self._assemble(words, ""))
        self.later = Kept(lambda words: self._assemble(words, " "))

    def _count(self, parts: list[str]) -> list[int]:
        found = []
        for begin in range(0, len(parts), REQUEST):
            found += map(len, self.tokenizer.encode_batch_fast(parts[begin : begin + REQUEST], add_special_tokens=False))
        return found

    def _assemble(self, words: list[str], before: str) -> list[int]:
        split = []
        for word in words:
            match = _PARTED.fullmatch(word)
            split.append((before + match[1], match[2]) if match else (before + word, ""))
        parts = self.parts.hold({p for pair in split for p in pair})
        return [parts[a] + parts[b] for a, b in split]

    def __call__(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        plain, odd = [], []
        for i, text in enumerate(texts):
            lines = text.split("\n")
            parted = [line.split(" ") for line in lines]
            # single spaces and single line ends between words: each word stands alone
            if "<|" in text or any(line.split() != words for line, words in zip(lines, parted)):
                odd.append(i)
            else:
                plain.append((i, parted))
        first = self.first.hold({line[0] for _, lines in plain for line in lines})
        later = self.later.hold(set().union(*[line[1:] for _, lines in plain for line in lines])).__getitem__
        for i, lines in plain:
            counts[i] = len(lines) - 1 + sum([first[line[0]] + sum(map(later, line[1:])) for line in lines])
        if odd:
            for i, n in zip(odd, self._count([texts[i] for i in odd])):
                counts[i] = n
        return counts


_loaded: dict = {}


def of_worker(kind, path: str):
    """One tokenizer of a kind and file per Python worker, kept from task to task."""
    key = (kind.__name__, path)
    if key not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]


def forget() -> None:
    """Drop the tokenizers and words that this worker keeps; another operator's task needs the memory."""
    _loaded.clear()


def version(path: str) -> str:
    """A digest of a tokenizer file's content and of the library's version."""
    import tokenizers

    with open(path, "rb") as file:
        return f"{zlib.crc32(file.read()):08x}-{os.path.getsize(path)}-{tokenizers.__version__}"

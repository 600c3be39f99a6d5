"""Plain versions of the document operators, for comparison."""

import hashlib
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def contamination(texts, items, window=10):
    """For each text: words, hit words, ids of items with occurring windows."""
    windows = {}
    for item_id, text in items:
        words = WORD.findall(lower(text or ""))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    result = []
    for text in texts:
        words = WORD.findall(lower(text or ""))
        hit, named = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                found = windows.get(tuple(words[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    named |= found
        result.append((len(words), len(hit), named))
    return result


def fingerprint(text, size=3):
    words = SPACED.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fingerprints, bits):
    """For each place the least place that is reachable by links of at most ``bits`` bits."""
    least = list(range(len(fingerprints)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= bits:
                a_top, b_top = top(i), top(j)
                least[max(a_top, b_top)] = min(a_top, b_top)
    return [top(i) for i in range(len(fingerprints))]


def repeats(texts, window):
    """For each text: words, removed words, digest of the kept ones."""
    places = {}
    rows = [SPACED.findall(t or "") for t in texts]
    for r, words in enumerate(rows):
        for i in range(len(words) - window + 1):
            places.setdefault(tuple(words[i : i + window]), []).append((r, i))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for r, i in found:
                gone[r].update(range(i, i + window))
    kept = [" ".join(w for i, w in enumerate(words) if i not in g) for words, g in zip(rows, gone)]
    return [(len(w), len(g), hashlib.sha256(k.encode()).hexdigest()) for w, g, k in zip(rows, gone, kept)]


def base_spans(text):
    """kind:start:end of the fixed secret patterns."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [s for *_, s in sorted(found)]


def pieces(text, tokenizer, capacity=4096):
    """(start, length, crc32) of each piece of a text's ids and the end id."""
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    cuts = [(i, ids[i : i + capacity]) for i in range(0, len(ids), capacity)]
    return [(i, len(c), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in c))) for i, c in cuts]


def byte_repeats(texts, window):
    """For each text: bytes, removed bytes, removed runs, digest of the kept ones."""
    places = {}
    rows = [(t or "").encode() for t in texts]
    for r, data in enumerate(rows):
        for i in range(len(data) - window + 1):
            places.setdefault(data[i : i + window], []).append((r, i))
    gone = [bytearray(len(data) + 1) for data in rows]
    for found in places.values():
        if len(found) > 1:
            for r, i in found:
                gone[r][i : i + window] = b"\1" * window
    result = []
    for data, g in zip(rows, gone):
        kept = bytes(b for b, x in zip(data, g) if not x)
        result.append((len(data), sum(g), bytes(g).count(b"\1\0"), hashlib.sha256(kept).hexdigest()))
    return result


def alignments(texts, ids_a, ids_b, bytes_a, bytes_b):
    """For each text: n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum, from whole texts' ids."""
    rows, holds = [], {}
    for text, a, b in zip(texts, ids_a, ids_b):
        whole = f" {text}".encode()
        if not text or any(b"".join(names[i] for i in ids) != whole for names, ids in ((bytes_a, a), (bytes_b, b))):
            a = b = []
        spans = []
        for names, ids in ((bytes_a, a), (bytes_b, b)):
            ends = [sum(len(names[i]) for i in ids[: k + 1]) for k in range(len(ids))]
            spans.append(list(zip([0, *ends], ends)))
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]
        shown, before = [], 0
        for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            sides = [",".join(str(i) for i, (s, e) in zip(ids, found) if before <= s < cut) for ids, found in zip((a, b), spans)]
            shown.append("|".join(sides))
            before = cut
        for pair in set(links):
            holds[pair] = holds.get(pair, 0) + 1
        rows.append((len(a), len(b), len(shown), hashlib.sha256(";".join(shown).encode()).hexdigest() if a else "", links))
    most = {}
    for (a, _), n in holds.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (n_a, n_b, n, len(links), digest, sum(holds[p] == most[p[0]] for p in links), sum(holds[p] for p in links))
        for n_a, n_b, n, digest, links in rows
    ]

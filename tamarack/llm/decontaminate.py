"""Operator 3: benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are sequences of words (lower case; runs of letters and digits, and each
character of the scripts without spaces in ``UNSPACED``). A text
window matches an item of m words within d = floor(0.2 m) word edits (similarity 0.8 or
more); items of under ``EXACT_WORDS`` words have to occur word for word. Items of under
``MIN_WORDS`` words are looked up by all their words at once, items without a word (punctuation)
as strings; only blank items are passed over.

Random walk: at step j the walk emits the word it stands on and moves on if a random bit
of (j, word) is 1. Walks of two sequences with few edits differ in few steps, so an edit
distance becomes a Hamming distance. A table samples ``SAMPLED`` steps of one walk; windows
that agree with an item in some table are candidates. The number of tables follows from
the target recall and the collision rate of items with d random edits (``plan_tables``).
Candidates are verified by exact edit distance.

Windows begin at every word. Those that can't match are passed over without loss: within d
edits of m words at least m - 2 - 3d three-word strings of a window are the item's (the
q-gram lemma), so windows with fewer strings from the items' set are no candidates.

The benchmark is a query set: it goes to the executors in blocks of at most
``block_words`` words (a bound on what is broadcast); every block meets all texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, ascii_lower, blocks, read_table, utf8

SHARE = 0.2
MIN_WORDS = 5
EXACT_WORDS = 8
SAMPLED = 2
#: Thai and Lao, Myanmar, Khmer, kana and bopomofo, ideographs, half-width kana, further ideographs.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3040, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
#: CJK marks, vertical forms and full-width forms that are punctuation.
MARKS = [(0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030), (0x30FB, 0x30FB), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]
GRAM = 3
MATCHES = "doc_id long, item_id long, edits int, item_words int, start_word int"


def edits_allowed(m: int) -> int:
    return int(SHARE * m + 1e-9) if m >= EXACT_WORDS else 0


def grams_needed(m: int) -> int:
    return m - GRAM + 1 - GRAM * edits_allowed(m)


def inside_words(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to words: ASCII letters and digits and all other
    characters but Latin-1 punctuation (C2 xx), general punctuation (E2 80/81 xx) and ``MARKS``."""
    table = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[a:b] = True
    table[0xC2] = False
    inside = table[data]
    for lead, seconds in ((0xC2, range(0x80, 0xC0)), (0xE2, (0x80, 0x81))):
        at = np.flatnonzero(data[:-1] == lead) if len(data) > 1 else np.zeros(0, np.int64)
        at = at[np.isin(data[at + 1], list(seconds))]
        for k in range(2 if lead == 0xC2 else 3):
            inside[np.minimum(at + k, len(data) - 1)] = False
    at = np.flatnonzero((data == 0xE3) | (data == 0xEF))
    at = at[_among(_code_points(data, at, 3), MARKS)]
    for k in range(3):
        inside[at + k] = False
    return inside


def _code_points(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The characters of ``size`` bytes that begin ``at``."""
    code = (data[at] & (0xFF >> (size + 1))).astype(np.int64)
    for k in range(1, size):
        code = code << 6 | (data[at + k] & 63)
    return code


def _among(code: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(code), bool)
    for a, b in ranges:
        out |= (code >= a) & (code <= b)
    return out


def unspaced(data: np.ndarray) -> np.ndarray:
    """Where characters of scripts without spaces begin and end: each is a word."""
    cuts = []
    for size, lead in ((3, (data >= 0xE0) & (data < 0xF0)), (4, data >= 0xF0)):
        at = np.flatnonzero(lead)
        at = at[_among(_code_points(data, at, size), UNSPACED)]
        cuts += [at, at + size]
    cuts = np.concatenate(cuts)
    return cuts[cuts < len(data)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, inside_words(data), ascii_lower(), unspaced(data))


def walk_keys(windows: np.ndarray, steps: np.ndarray, first: int = 0) -> np.ndarray:
    """Keys (table, window): the words at ``steps[table]`` of that table's walk over each window
    (a row of word hashes, 0 beyond its end). ``first`` is the number of the first table."""
    (n, width), tables = windows.shape, len(steps)
    at = np.zeros((tables, n), np.int64)
    base = np.arange(n) * width
    flat = windows.ravel()
    key = np.zeros((tables, n), np.uint64)
    seeds = (np.arange(first, first + tables, dtype=np.uint64) << np.uint64(32))[:, None]
    for j in range(int(steps.max()) + 1):
        word = np.where(at < width, flat[base + np.minimum(at, width - 1)], np.uint64(0))
        for t in np.flatnonzero((steps == j).any(1)).tolist():
            key[t] = _mix(key[t] * np.uint64(0x9E3779B97F4A7C15) + word[t] + np.uint64(j))
        at += (_mix(word + seeds + np.uint64(j * 0x9E3779B1 + 1)) & np.uint64(1)).astype(np.int64)
    return key


def edit_distances(windows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Row by row: the least number of word edits between the item and a prefix of the window."""
    n, width = windows.shape
    ramp = np.arange(width + 1)
    row = np.broadcast_to(ramp, (n, width + 1)).copy()
    for i in range(items.shape[1]):
        change = row[:, :-1] + (windows != items[:, i, None])
        new = np.minimum(np.concatenate([row[:, :1] + 1, change], axis=1), row + 1)
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row.min(1)


@dataclass
class Class:
    """The items of m words: their hashes, and for each table its sorted keys with the items' places."""

    m: int
    d: int
    ids: np.ndarray
    words: np.ndarray
    tables: list = field(default_factory=list)
    steps: np.ndarray = None  # (table, sample)
    own: np.ndarray = None  # which of the index's strings are of these items

    @property
    def width(self) -> int:
        return self.m + self.d


def plan_tables(c: Class, recall: float, most: int = 400) -> int:
    """Tables that a window with d random edits needs to collide in one of them at the target recall."""
    if not c.d:
        return 1
    rng = np.random.default_rng(c.m)
    base = c.words[rng.integers(0, len(c.words), 64)]
    odd = np.zeros((64, c.width), np.uint64)
    for r, own in enumerate(base):
        out = own.tolist()
        for _ in range(c.d):
            kind, k = rng.integers(0, 3), rng.integers(0, max(len(out), 1))
            if kind == 0:
                out[k : k + 1] = [int(rng.integers(1, 1 << 62))]
            elif kind == 1:
                del out[k]
            else:
                out.insert(k, int(rng.integers(1, 1 << 62)))
        odd[r, : min(len(out), c.width)] = out[: c.width]
    plain = np.zeros((64, c.width), np.uint64)
    plain[:, : c.m] = base
    steps = np.stack([_steps(c, t) for t in range(24)])
    hits = (walk_keys(plain, steps) == walk_keys(odd, steps)).mean(0)
    missed = lambda n: float(np.mean((1 - np.maximum(hits, 1 / 48)) ** n))
    return next((n for n in range(1, most) if missed(n) <= 1 - recall), most)


def _steps(c: Class, table: int) -> np.ndarray:
    return np.sort(np.random.default_rng([c.m, table]).choice(2 * c.m, SAMPLED, replace=False))


@dataclass
class Index:
    classes: list[Class]
    grams: np.ndarray  # sorted
    seen: np.ndarray  # their low bits: a quick test
    bits: int
    short: list[Class]  # of under MIN_WORDS words; one table with the keys of all their words
    marks: list[tuple[int, bytes]]  # items without a word


def grams_of(w: Words) -> np.ndarray:
    """A hash of each word with the two after it; 0 where the row ends before."""
    h = w.hash
    g = np.zeros(len(h), np.uint64)
    if len(h) >= GRAM:
        g[: 1 - GRAM] = _mix(h[:-2] * np.uint64(3) + _mix(h[1:-1] * np.uint64(5) + _mix(h[2:])))
        g[: 1 - GRAM][w.doc[:-2] != w.doc[2:]] = 0
    return g


def build_index(items: list[tuple[int, str]], recall: float) -> Index:
    texts = [t.lower().encode() for _, t in items]
    data = np.frombuffer(b"".join(texts), np.uint8)
    w = words_of(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
    sizes = np.diff(w.first)
    classes, short = [], []
    for m in sorted(set(sizes[(sizes > 0) & (sizes < MIN_WORDS)].tolist())):
        own = np.flatnonzero(sizes == m)
        c = Class(m, 0, np.array([items[i][0] for i in own], np.int64), np.stack([w.hash[w.first[i] : w.first[i + 1]] for i in own]))
        keys = _whole_keys(c.words.T)
        order = np.argsort(keys, kind="stable")
        c.tables.append((keys[order], order))
        short.append(c)
    marks = [(items[i][0], t) for i in np.flatnonzero(sizes == 0).tolist() if (t := items[i][1].lower().strip().encode())]
    for m in sorted(set(sizes[sizes >= MIN_WORDS].tolist())):
        own = np.flatnonzero(sizes == m)
        c = Class(m, edits_allowed(m), np.array([items[i][0] for i in own], np.int64), np.stack([w.hash[w.first[i] : w.first[i + 1]] for i in own]))
        full = np.zeros((len(own), c.width), np.uint64)
        full[:, :m] = c.words
        c.steps = np.stack([_steps(c, t) for t in range(plan_tables(c, recall))])
        for keys in walk_keys(full, c.steps):
            order = np.argsort(keys)
            c.tables.append((keys[order], order))
        classes.append(c)
    every = grams_of(w)
    grams = np.unique(every[(every != 0) & (sizes[w.doc] >= MIN_WORDS)])
    for c in classes:
        c.own = np.isin(grams, every[sizes[w.doc] == c.m])
    bits = max(16, min(26, int(math.log2(len(grams) + 1)) + 7))
    seen = np.zeros(1 << bits, bool)
    seen[_low(grams, bits)] = True
    return Index(classes, grams, seen, bits, short, marks)


def _whole_keys(words) -> np.ndarray:
    """A key of each column of word hashes."""
    key = np.zeros(len(words[0]), np.uint64)
    for word in words:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
    return key


def _low(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams & np.uint64((1 << bits) - 1)).astype(np.int64)


def _verified(c: Class, windows: np.ndarray, starts: np.ndarray, picks: np.ndarray):
    for a in range(0, len(starts), 4096):
        cut = slice(a, a + 4096)
        d = edit_distances(windows[cut], c.words[picks[cut]])
        ok = d <= c.d
        yield starts[cut][ok], c.ids[picks[cut][ok]], d[ok]


def _short_matches(index: Index, w: Words) -> Iterator[tuple[int, int, int, int]]:
    """(row, item_id, start word, item words) of the short items: their first place in each row."""
    for c in index.short:
        n = len(w.hash) - c.m + 1
        if n <= 0:
            continue
        keys, order = c.tables[0]
        key = _whole_keys([w.hash[k : k + n] for k in range(c.m)])
        lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        at = np.flatnonzero((hi > lo) & (w.doc[:n] == w.doc[c.m - 1 :]))
        count = (hi - lo)[at]
        start = np.repeat(at, count)
        pick = order[np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[at], count)]
        same = (w.hash[start[:, None] + np.arange(c.m)] == c.words[pick]).all(1)
        start, pick = start[same], pick[same]
        _, first = np.unique(w.doc[start] * len(c.ids) + pick, return_index=True)
        for s, i in zip(start[first].tolist(), c.ids[pick[first]].tolist(), strict=True):
            yield int(w.doc[s]), i, s - int(w.first[w.doc[s]]), c.m
    text = w.data.tobytes() if index.marks else b""
    for i, mark in index.marks:
        at = text.find(mark)
        while at >= 0:
            row = int(np.searchsorted(w.offsets, at, "right")) - 1
            end = int(w.offsets[row + 1])
            if at + len(mark) <= end:
                yield row, i, int(np.searchsorted(w.start, at)) - int(w.first[row]), 0
            at = text.find(mark, end if at + len(mark) <= end else at + 1)


def find_matches(index: Index, w: Words) -> list[tuple[int, int, int, int, int]]:
    """(row, item_id, edits, item words, start word): the best place of each item in each row."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for doc, i, s, m in _short_matches(index, w):
        best[doc, i] = min((0, s, m), best.get((doc, i), (1 << 30, 0, 0)))
    if len(w.hash) and index.classes:
        _long_matches(index, w, best)
    return [(doc, i, e, m, s) for (doc, i), (e, s, m) in sorted(best.items())]


def _long_matches(index: Index, w: Words, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
    grams = grams_of(w)
    hits = index.seen[_low(grams, index.bits)] & (grams != 0)
    total = np.concatenate([[0], np.cumsum(hits)])
    ends = w.first[1:][w.doc]  # one past the last word of each word's row
    least = min(grams_needed(c.m) for c in index.classes)
    widest = max(c.width for c in index.classes)
    reach = np.minimum(np.arange(len(w.hash)) + widest, ends)
    some = np.flatnonzero(total[reach] - total[:-1] >= least)
    if not len(some):
        return
    # where windows may match: each class counts its own strings there
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, some, 1)
    np.add.at(step, reach[some], -1)
    region = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    place = np.searchsorted(region, some)
    gram = np.minimum(np.searchsorted(index.grams, grams[region]), len(index.grams) - 1)
    met = index.grams[gram] == grams[region]
    for c in index.classes:
        own = np.concatenate([[0], np.cumsum(c.own[gram] & met)])
        width = np.minimum(some + c.width, ends[some]) - some
        at = some[(own[place + width] - own[place] >= grams_needed(c.m)) & (width >= c.m - c.d)]
        most = max(1, (1 << 19) // max(1, len(c.tables)))
        for a in range(0, len(at), most):
            start = at[a : a + most]
            places = start[:, None] + np.arange(c.width)
            windows = np.where(places < ends[start, None], w.hash[np.minimum(places, len(w.hash) - 1)], np.uint64(0))
            pairs = []
            for key, (keys, order) in zip(walk_keys(windows, c.steps), c.tables, strict=True):
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = hi - lo
                if n.any():
                    row = np.repeat(np.arange(len(start)), n)
                    slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                    pairs.append(row * len(c.ids) + order[slot])
            if pairs:
                pairs = np.unique(np.concatenate(pairs))
                row, pick = np.divmod(pairs, len(c.ids))
                for starts, ids, d in _verified(c, windows[row], start[row], pick):
                    for s, i, e in zip(starts.tolist(), ids.tolist(), d.tolist(), strict=True):
                        doc = int(w.doc[s])
                        found = (e, s - int(w.first[doc]), c.m)
                        if found < best.get((doc, i), (1 << 30, 0, 0)):
                            best[doc, i] = found


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in runs of about ``block_words`` words, one at a time on the driver."""
    block, size = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        text = r[1].lower().encode()
        size += max(1, len(words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hash))
        if size >= block_words:
            yield block
            block, size = [], 0
    yield block


def matches(docs: DataFrame, benchmark: DataFrame, recall: float = 0.98, block_words: int = 500_000) -> DataFrame:
    """(doc_id, item_id, edits, item_words, start_word): the items that each text contains, at
    the place with the fewest edits (the first of several). Null texts contain none; repeated
    documents have their own rows; items with equal texts each have theirs."""
    return _per_block(docs, benchmark, recall, block_words, ["doc_id"], False)


def _per_block(docs, benchmark, recall, block_words, keep, flag_only):
    sc, out = docs.sparkSession.sparkContext, None
    for block in item_blocks(benchmark, block_words):
        part = _against(docs, sc.broadcast(build_index(block, recall)), keep, flag_only)
        out = part if flag_only or out is None else out.unionByName(part)
        docs = part if flag_only else docs
    return out


def _against(docs: DataFrame, shared, keep: list[str], flag_only: bool) -> DataFrame:
    rows = docs.select(*keep, F.lower(F.coalesce("text", F.lit(""))).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for batch in blocks(whole, "__text"):
                found = find_matches(index, words_of(*utf8(batch.column("__text"))))
                if flag_only:
                    hit = {f[0] for f in found}
                    clean = pa.array([i for i in range(batch.num_rows) if i not in hit], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(clean) for c in keep], names=keep)
                elif found:
                    row, item, e, m, s = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(item, pa.int64()), *(pa.array(x, pa.int32()) for x in (e, m, s))], names=["doc_id", "item_id", "edits", "item_words", "start_word"])

    return rows.mapInArrow(run, rows.select(*keep).schema if flag_only else MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, recall: float = 0.98, block_words: int = 500_000) -> DataFrame:
    """The rows of docs, with all their columns, whose text contains no item."""
    return _per_block(docs, benchmark, recall, block_words, docs.columns, True)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))

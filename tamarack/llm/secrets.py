"""Operator 7: secret scans with a random forest for false-positive removal.

Candidates in whole texts are (1) values that something names: those assigned to a word that
names a secret, quoted or up to white space, what an authorization header or a login option
carries, passwords of ``scheme://user:password@host``, and every value of a known format
(``KNOWN``: access keys, private keys in PEM, signed tokens of three parts), whatever their length
or characters (``named``), and (2) anywhere else maximal runs of ``[A-Za-z0-9_/+-]`` of 24 bytes or
more, or of 12 or more that are more than words: with a digit, or a capital within a word (``runs``). A candidate's features (``describe``) are its length,
characters and transitions, its coverage by dictionary words, what its document's path looks
like and the words beside it. The dictionary is the ``dictionary_words`` most frequent words of
3 to 16 bytes in any script, counted over all texts. A random forest, trained from labelled
findings, votes; candidates with under half of the votes are dropped as false positives.

Labelled findings come as a table or, where there is none, from planting: values that are
secrets by construction, and values that only look like it (placeholders, numbers, digests,
identifiers, code, words of a sentence), are put into whole texts of the corpus and found again by
the same search (``planted``), so no rule of this module decides a label; the lists that plants are
drawn from have nothing in common with those that features know. At most ``plant_texts`` texts, chosen
by hash, ``findings`` plants and ``per_label`` findings of each label are used; these bounds are the only sampling.
``held_out`` gives precision and recall on plants that took no part in training; a planted secret
that the search doesn't meet counts against recall.

The forest (bounded by its number of trees and depth) goes to the executors as plain arrays,
read from its saved table of nodes, so texts are scored and redacted where they are read. Null
and empty texts have no findings; repeated rows have theirs each; an empty table has none.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, _powers, ascii_lower, blocks, materialize, read_table, utf8, workspace

FEATURES = ["length", "digits", "upper", "symbols", "transitions", "entropy", "dictionary", "hex", "known", "keyword", "assigned", "quoted", "linked", "stand_in", "code", "prose", "test_path", "config_path"]
# Formats of access keys, words that name a secret, what an assignment looks like, and parts of paths.
KNOWN = re.compile(
    rb"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}"
    rb"|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"
)
#: How each of KNOWN's formats begins.
MARKS = [b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"xoxa-", b"xoxb-", b"xoxp-", b"xoxr-", b"xoxs-", b"sk_live_", b"rk_live_", b"sk-", b"AIza", b"eyJ", b"-----BEGIN "]
NAMES = rb"(?:password|passwd|pwd|token|secret|api[_-]?key|auth(?:orization)?|credential|private[_-]?key|access[_-]?key)"
KEYWORD = re.compile(NAMES + rb"\W{0,5}$", re.I)
ASSIGNED = re.compile(rb"[=:]\s{0,2}[\"']?$")
NAMED_BEFORE = re.compile(NAMES + rb"[\"'\])]{0,3}[ \t]{0,40}$", re.I)
OPERATOR = re.compile(rb"(?::=|=>|==|=|:)[ \t]{0,40}(?:(?:bearer|basic|token)[ \t]{1,40})?", re.I)
BEARER = re.compile(rb"(?<![A-Za-z0-9])bearer[ \t]{1,40}([A-Za-z0-9_.~+/=-]{8,})", re.I)
LOGIN = re.compile(rb"(?:(?<=\s)|^)(?:-u|--user)[ =]{1,3}[\"']?[^\s:\"'/]{1,64}:([^\s\"']+)")
QUOTED = re.compile(rb"\"((?:[^\"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)'")
BARE = re.compile(rb"[^\s\"'][^\s]*")
BARE_END = b".,;&)]}>\"'"
USERINFO = re.compile(rb"://[^\s:/@\"'<>?#]*:([^\s/\"'<>?#]+)@")
LINKED = re.compile(rb"(?:://|@|www\.)[^\s]*$")
TEST_PATH, CONFIG_PATH = re.compile("test|example|sample|mock|fixture|spec|demo|doc", re.I), re.compile(r"\.(?:env|ya?ml|json|ini|conf|cfg|properties|toml|pem|key|sh)$|config|settings|deploy", re.I)
STAND_INS = ["changeme", "password", "example", "your_token_here", "YOUR_API_KEY", "xxxxxxxx", "********", "none", "null", "true", "false", "string", "todo", "placeholder", "insert_key_here", "os.environ", "getpass()", "undefined", "secret", "test"]
STAND_IN = re.compile(b"|".join([rb"<.*>|\$\{.*\}|\$\w+|\{\{.*\}\}|(.)\1*", *(re.escape(x.encode()) for x in STAND_INS)]), re.I | re.S)
CODE = re.compile(rb"[A-Za-z_]\w*(?:\.\w+|->\w+|\[[^\]]*\]?|\([^()]*\)?)+")
_RUN = re.compile(rb"[A-Za-z0-9_-]*")
LOOK_BACK = 64
REDACTED = "[SECRET]"
FINDINGS = "doc_id long, start_byte long, n_bytes int, kind string, secret_sha256 string, score double"


def _ranges(pairs) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in pairs:
        table[a : b + 1] = True
    return table


TOKEN = _ranges([(48, 57), (65, 90), (97, 122), (95, 95), (45, 45), (43, 43), (47, 47)])
DIGIT, LETTER = _ranges([(48, 57)]), _ranges([(65, 90), (97, 122), (128, 255)])
_KIND = np.where(DIGIT, 0, np.where(_ranges([(65, 90)]), 1, np.where(_ranges([(97, 122)]), 2, 3)))
_LOWER_HEX, _UPPER_HEX = DIGIT | _ranges([(97, 102)]), DIGIT | _ranges([(65, 70)])


def runs(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of runs of 24 bytes or more, and of 12 or more with a digit, or with a
    capital after a small letter."""
    inside = TOKEN[data]
    odd = DIGIT[data]
    odd[1:] |= (_KIND[data[1:]] == 1) & (_KIND[data[:-1]] == 2)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    long = end - start >= 12
    row_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    out = []
    for a, z in zip(start[long].tolist(), end[long].tolist(), strict=True):
        for row in range(int(row_of(a)), int(row_of(z - 1)) + 1):  # a run never spans two rows
            lo, hi = max(a, int(offsets[row])), min(z, int(offsets[row + 1]))
            if hi - lo >= 24 or (hi - lo >= 12 and (DIGIT[data[lo]] or odd[lo + 1 : hi].any())):
                out.append((row, lo, hi))
    return out


def _places(text: bytes, mark: bytes) -> Iterator[int]:
    at = text.find(mark)
    while at >= 0:
        yield at
        at = text.find(mark, at + 1)


def named(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, start, end) of assigned values, what headers and logins carry, passwords in addresses and values of known formats, whole.
    Where a bare value holds further assignments, its parts between them are listed too, so no value hides another."""
    text, out, bare_end = data.tobytes(), set(), 0

    def place(at: int) -> tuple[int, int, int]:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        return row, int(offsets[row]), int(offsets[row + 1])

    def bare(row: int, a: int, z: int) -> None:
        if size := len(text[a:z].rstrip(BARE_END)):
            out.add((row, a, a + size))

    heads = []  # (where the name begins, row, where the value may begin, end of the row)
    for at in np.flatnonzero((data == 61) | (data == 58)).tolist():
        row, begin, end = place(at)
        if (name := NAMED_BEFORE.search(text[max(begin, at - LOOK_BACK) : at])) and (m := OPERATOR.match(text, at, end)):
            heads.append((max(begin, at - LOOK_BACK) + name.start(), row, m.end(), end))
    for k, (_, row, a, end) in enumerate(heads):
        following = heads[k + 1][0] if k + 1 < len(heads) else len(text)
        if v := QUOTED.match(text, a, end):
            out.add((row, *v.span(1 if v[1] else 2)))
        elif a < bare_end:  # inside the value before
            bare(row, a, max(a, min(bare_end, following)))
        elif v := BARE.match(text, a, end):
            bare_end = v.end()
            bare(row, a, bare_end)
            if a < following < bare_end:
                bare(row, a, following)
    for at in _places(text, b"://"):
        row, begin, end = place(at)
        if at > begin and (m := USERINFO.match(text, at, end)):
            out.add((row, *m.span(1)))
    for pattern in (BEARER, LOGIN):
        for m in pattern.finditer(text):
            row, begin, end = place(m.start(1))
            if m.start() >= begin and m.end(1) <= end:
                out.add((row, *m.span(1)))
    for mark in MARKS:
        passed = 0
        for at in _places(text, mark):
            row, begin, end = place(at)
            if at < passed or (at > begin and mark[:1] != b"-" and (DIGIT | LETTER)[text[at - 1]]):
                continue  # within a run that was tried whole, or within a word
            if m := KNOWN.match(text, at, end):
                out.add((row, *m.span()))
            passed = _RUN.match(text, at + 1).end()  # no later place of the run can do better
    return sorted(out)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The slices end to end with ``gap`` zero bytes after each, and where each begins."""
    size = end - start
    first = np.cumsum(size + gap) - (size + gap)
    out = np.zeros(int((size + gap).sum()), np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(first, size) + inner] = data[np.repeat(start, size) + inner]
    return out, first


def describe(data: np.ndarray, offsets: np.ndarray, found: list[tuple[int, int, int, bool]], paths: list[str | None], dictionary: np.ndarray) -> np.ndarray:
    """FEATURES of candidates (row, start, end, is named), a row each. ``dictionary``: sorted hashes
    of words. A named value has a keyword and is assigned, and is not part of an address."""
    row, start, end, is_named = (np.array(c) for c in zip(*found, strict=True))
    size = end - start
    x = np.zeros((len(row), len(FEATURES)))
    f = {name: x[:, i] for i, name in enumerate(FEATURES)}
    token, first = _joined(data, start, end, 1)
    kinds, owner = _KIND[token], np.repeat(np.arange(len(row)), size + 1)
    inner = np.ones(len(token), bool)
    inner[first + size] = False
    share = lambda mask: np.bincount(owner, mask & inner, len(row)) / size
    f["length"][:] = np.log1p(size)
    for i, name in ((0, "digits"), (1, "upper"), (3, "symbols")):
        f[name][:] = share(kinds == i)
    changes = np.concatenate([kinds[1:] != kinds[:-1], [False]]) & inner & np.concatenate([inner[1:], [False]])
    f["transitions"][:] = np.bincount(owner, changes, len(row)) / np.maximum(size - 1, 1)
    pair, n = np.unique(owner[inner] * 256 + token[inner], return_counts=True)
    p = n / size[pair >> 8]
    f["entropy"][:] = np.bincount(pair >> 8, -p * np.log2(p), len(row))
    low = ascii_lower()[token].astype(np.uint64) + np.uint64(1)
    letter, covered, h = LETTER[token], np.zeros(len(token) + 1, np.int32), np.zeros(len(token), np.uint64)
    whole = np.ones(len(token), bool)  # the window at each place has letters only
    for k, power in enumerate(_powers(16)[: min(16, len(token))]):
        h = h[: len(token) - k] + low[k:] * power
        whole = whole[: len(token) - k] & letter[k:]
        if k >= 2 and len(dictionary):
            at = np.flatnonzero(whole)
            at = at[dictionary[np.minimum(np.searchsorted(dictionary, h[at]), len(dictionary) - 1)] == h[at]]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + k + 1, -1)
    f["dictionary"][:] = share(np.cumsum(covered[:-1]) > 0)
    f["hex"][:] = (share(_LOWER_HEX[token]) == 1) | (share(_UPPER_HEX[token]) == 1)
    lo, hi = np.maximum(start - 40, offsets[row]), np.minimum(end + 40, offsets[row + 1])
    beside, at = _joined(data, np.stack([lo, end], 1).ravel(), np.stack([start, hi], 1).ravel(), 1)
    w = Words(beside, np.append(at[::2], len(beside)), LETTER[beside], ascii_lower())
    if len(dictionary) and len(w.start):
        usual = dictionary[np.minimum(np.searchsorted(dictionary, w.hash), len(dictionary) - 1)] == w.hash
        f["prose"][:] = np.bincount(w.doc, usual, len(row)) / np.maximum(np.bincount(w.doc, minlength=len(row)), 1)
    for i, (r, a, z, own) in enumerate(found):
        before, after = data[max(int(offsets[r]), a - LOOK_BACK) : a].tobytes(), data[z : min(int(offsets[r + 1]), z + 1)].tobytes()
        f["known"][i] = KNOWN.fullmatch(data[a:z].tobytes()) is not None
        f["stand_in"][i] = z - a > 1 and STAND_IN.fullmatch(data[a:z].tobytes()) is not None
        f["code"][i] = CODE.fullmatch(data[a:z].tobytes()[:256]) is not None
        f["keyword"][i] = own or KEYWORD.search(before) is not None
        f["assigned"][i] = own or ASSIGNED.search(before) is not None
        f["quoted"][i] = before[-1:] in (b'"', b"'") and after == before[-1:]
        f["linked"][i] = not own and (LINKED.search(before) is not None or after in (b"@", b"."))
        f["test_path"][i] = bool(paths[r]) and TEST_PATH.search(paths[r]) is not None
        f["config_path"][i] = bool(paths[r]) and CONFIG_PATH.search(paths[r]) is not None
    return x


def dictionary_of(docs: DataFrame, dictionary_words: int = 5000, text: str = "text", least: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the most frequent words (ties by hash) of 3 to 16 bytes, counted over all texts; a rarer word than ``least`` may be a secret itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "__text"):
                data, offsets = utf8(batch.column("__text"))
                w = Words(data, offsets, LETTER[data], ascii_lower())
                size = w.end - w.start
                word, n = np.unique(w.hash[(size >= 3) & (size <= 16)], return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": word.view(np.int64), "n": n.astype(np.int64)})

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).mapInArrow(count, "word long, n long")
    top = rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(dictionary_words).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


# --- labelled findings by planting ---------------------------------------------------------
_ALNUM, _HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
# Names of assigned values and paths.
_KEYS = ["password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "auth", "credential", "private_key", "access_key", "client_secret", "DB_PASSWORD", "auth_token", "API-KEY"]
_PLACEHOLDERS = ["changeit", "dummy", "foobar", "your-password", "my_token", "REPLACE_ME", "replace-with-yours", "not-set", "n/a", "empty", "optional", "required", "redacted", "hidden", "default", "disabled", "enabled", "unknown", "fill-me-in", "TBD", "none-yet", "goes_here", "abc123", "12345"]
_HOLDERS = ["env", "cfg", "conf", "self", "args", "params", "kwargs", "vault", "request.form", "ctx.session", "process.env"]
_PATHS = ["src/app.py", "setup/values.rc", "deep/run.rb", "lib/client.js", "web", "crawl-3", "notes.txt", "main.tf"]
_TEST_PATHS = ["qa/check_login.py", "tutorial/part2.rst", "benchmarks/run.py", "README"]


def _pem(rng: random.Random, some) -> str:
    kind, lines = rng.choice(["", "RSA ", "EC ", "OPENSSH "]), [some(_ALNUM + "+/", 10, 64) for _ in range(rng.randint(1, 20))]
    return "\n".join([f"-----BEGIN {kind}PRIVATE KEY-----", *lines, f"-----END {kind}PRIVATE KEY-----"])


def _plant(rng: random.Random, words: list[str]) -> tuple[str, str, int]:
    """(text before the value and after it joined by a mark, value, label): a secret by construction, or a look-alike."""
    some = lambda letters, a, b: "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))
    word = lambda: rng.choice(words)
    key, quote = rng.choice(_KEYS), rng.choice(['"', "'", ""])
    assigned = f"{key}{rng.choice(['=', ' = ', ': ', ':', ' := ', ' => '])}{quote}\0{quote}"
    if rng.random() < 0.5:
        known = ["AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), "ghp_" + some(_ALNUM, 36, 36), "sk_live_" + some(_ALNUM, 24, 24), "xoxb-" + some("0123456789", 11, 11) + "-" + some(_ALNUM, 24, 24), "AIza" + some(_ALNUM, 35, 35), "eyJ" + ".".join(some(_ALNUM, 16, 60) for _ in range(3)), _pem(rng, some)]
        value = rng.choice([
            some(_HEX, 16, 64), some(_ALNUM, 8, 48), some(_ALNUM + "+/", 20, 60), some(_ALNUM + "!#%^*?~", 6, 20), word()[:12] + some("0123456789", 1, 4), word().title() + rng.choice("!#*?") + some("0123456789", 2, 4), some("abcdefghijklmnopqrstuvwxyz", 1, 20), some(_ALNUM, 1, 7), some("abcdefghijklmnopqrstuvwxyz", 2, 6) + some("abcdefghijklmnopqrstuvwxyz", 6, 14), rng.choice(known),
        ])
        if quote and rng.random() < 0.15:  # a pass phrase
            value = " ".join([*(some("abcdefghijklmnopqrstuvwxyzäéü", 1, 8) for _ in range(rng.randint(1, 4))), rng.choice(["", "!", '\\"é', "7"])]).strip()
        if rng.random() < 0.15:
            return f"{rng.choice(['https', 'redis', 'postgres', 'ftp'])}://{word()}:\0@{word()}.example.net/", re.sub(r"[/\"'<>?#@]", "x", value), 1
        if rng.random() < 0.2:
            return "\0", rng.choice([*known, some(_ALNUM, 32, 64)]), 1
        return assigned, value, 1
    value = rng.random()
    if value < 0.25:
        return assigned, rng.choice(_PLACEHOLDERS), 0
    if value < 0.35:
        holder, name = rng.choice(_HOLDERS), word()[:10]
        return f"{key} = \0", rng.choice([f"{holder}['{name}']", f"{holder}.{name}", f"{holder}.get('{name}')", f"read_{name}()", f"{name}({holder})", f"{holder}[{name}]"]), 0
    if value < 0.5:  # a sentence
        return f"{rng.choice(['the ', 'a ', 'his ', '', 'its '])}{key.lower().replace('_', ' ')}: \0 {word()} {word()}", word(), 0
    if value < 0.55:
        return f"{key}: \0", word(), 0
    digest = f"{rng.choice(['commit', 'sha256', 'digest', 'checksum', 'revision', 'etag', 'id', 'uuid'])} \0"
    number, names = some("0123456789", 12, 24), [word() for _ in range(4)]
    return rng.choice([
        (digest, some(_HEX, 32, 64), 0), (digest, "-".join(some(_HEX, k, k) for k in (8, 4, 4, 4, 12)), 0), ("\0", number, 0), ("\0", f"{number[:3]}-{number[3:7]}-{number[7:12]}", 0), ("mail \0@example.com", f"{names[0]}{number[:9]}", 0),
        ("http://www.example.com/\0.html", f"{'-'.join(names)}-{number[:4]}", 0), ("\0", "".join(n.title() for n in names) + "Handler" + number[:2], 0), ("\0", "_".join(names) + f"_{number[:3]}", 0), ("\0", "".join(names) + "ungskeitschaft", 0), ("\0", f"img_{number[:8]}_{number[8:12]}", 0), ("\0", f"{'/'.join(names)}/{number[:6]}", 0),
    ])


def planted(docs: DataFrame, dictionary: np.ndarray, plant_texts: int = 1500, findings: int = 15_000, text: str = "text") -> DataFrame:
    """(x, label, h): labelled findings. Values are put between words of texts chosen by hash and found
    again; x is null for a secret that isn't."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    rows = docs.where(F.length(text) > 0).select(F.col(text).alias("__text"), F.xxhash64(text).alias("h"))
    n = rows.count()
    near = rows.where(F.pmod("h", F.lit(1 << 20)) < min(1.0, 2 * plant_texts / max(n, 1) + 0.001) * (1 << 20)).dropDuplicates(["h"])
    few = near.orderBy("h").limit(plant_texts)
    plants = -(-findings // max(1, min(n, plant_texts)))  # of each text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans, labels, paths, hs = [], [], [], [], []
            for t, h in zip(batch.column("__text").to_pylist(), batch.column("h").to_pylist(), strict=True):
                rng = random.Random(h)
                words = [x for x in re.findall(r"[^\W\d_]{3,12}", t)] or ["some", "words"]
                for _ in range(plants):
                    around, value, label = _plant(rng, words)
                    at = rng.randint(0, len(t))
                    before, after = around.split("\0")
                    head = (t[max(0, at - 200) : at] + rng.choice([" ", "\n"]) + before).encode()
                    texts.append(head + value.encode() + (after + " " + t[at : at + 200]).encode())
                    spans.append((len(head), len(head) + len(value.encode())))
                    labels.append(float(label))
                    paths.append(rng.choice(_TEST_PATHS if rng.random() < (0.1 if label else 0.4) else _PATHS))
                    hs.append(rng.getrandbits(62))
            data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
            best = {}
            for c in _candidates(data, offsets):  # of each text the candidate that overlaps its value most
                a, z = spans[c[0]][0] + offsets[c[0]], spans[c[0]][1] + offsets[c[0]]
                if (overlap := min(c[2], z) - max(c[1], a)) > 0 and overlap > best.get(c[0], (0,))[0]:
                    best[c[0]] = overlap, c
            rows = sorted(best)
            x = dict(zip(rows, describe(data, offsets, [best[i][1] for i in rows], paths, shared.value).tolist(), strict=True)) if rows else {}
            missed = [i for i in range(len(texts)) if labels[i] and i not in best]  # no features: not found
            rows += missed
            if rows:
                yield pa.RecordBatch.from_pydict({"x": pa.array([x.get(i) for i in rows], pa.list_(pa.float64())), "label": pa.array([labels[i] for i in rows], pa.float64()), "h": pa.array([hs[i] for i in rows], pa.int64())})

    return few.mapInArrow(run, "x array<double>, label double, h long")


@dataclass
class Forest:
    """Trees as arrays: at node i, go to left[i] if x[feature[i]] <= threshold[i], else right[i]; leaves have feature -1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def votes(self, x: np.ndarray) -> np.ndarray:
        """The share of trees that vote for a secret."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (feature[at] >= 0).any():
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += value[at]
        return total / len(self.trees)


def exported(model) -> Forest:
    """A fitted Spark forest, from the table of nodes that saving it writes."""
    spark = SparkSession.getActiveSession()
    path = workspace(spark, "forest")
    model.write().save(path)
    node = "nodeData."
    rows = spark.read.parquet(f"{path}/data").select("treeID", *[F.col(node + c).alias(c) for c in ("id", "prediction", "leftChild", "rightChild")], F.col(node + "split.featureIndex").alias("feature"), F.get(node + "split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    trees = []
    for _, nodes in groupby(sorted(rows.collect(), key=lambda r: (r["treeID"], r["id"])), key=lambda r: r["treeID"]):  # bounded by trees and depth
        nodes = list(nodes)
        leaf = [r["leftChild"] < 0 for r in nodes]
        trees.append((
            np.array([-1 if end else r["feature"] for r, end in zip(nodes, leaf, strict=True)]), np.array([0.0 if end else r["threshold"] for r, end in zip(nodes, leaf, strict=True)]),
            np.array([r["leftChild"] for r in nodes]), np.array([r["rightChild"] for r in nodes]), np.array([r["prediction"] for r in nodes]),
        ))
    return Forest(trees)


def train(findings: DataFrame, per_label: int = 5000, trees: int = 40, depth: int = 8) -> Forest | None:
    """Fit on rows of (x, label, h); None if there aren't findings of both labels. Rows without features take no part."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    findings = findings.where("x is not null")
    counts = {r["label"]: r["count"] for r in findings.where("label in (0, 1)").groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * per_label / n + 0.001))])
    near = findings.where("label in (0, 1)").where(F.pmod(F.col("h"), F.lit(1 << 20)) < share[F.col("label")] * (1 << 20)).dropDuplicates(["h"])
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("h"))).where(F.col("r") <= per_label)
    few = materialize(few.select("x", "label").coalesce(1), "findings").select(array_to_vector("x").alias("features"), "label")
    return exported(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featuresCol="features", labelCol="label").fit(few))


def held_out(findings: DataFrame, forest: Forest) -> tuple[float, float]:
    """(precision, recall) on labelled findings, those without features being missed."""
    secrets = findings.where("label = 1").count()
    rows = findings.where("x is not null").select("x", "label").toArrow()
    y = rows.column("label").to_numpy()
    yes = forest.votes(np.array(rows.column("x").to_pylist())) >= 0.5
    hit = (yes & (y == 1)).sum()
    return hit / max(1, yes.sum()), hit / max(1, secrets)


#: A fifth of the labelled findings is held out of training.
IS_HELD_OUT = "pmod(shiftright(h, 20), 5) = 0"


def fit(docs: DataFrame, labelled: DataFrame | None = None) -> tuple[np.ndarray, Forest | None]:
    """(dictionary, forest) from labelled findings (x, label, h), or from planted ones."""
    dictionary = dictionary_of(docs)
    if labelled is None:
        labelled = materialize(planted(docs, dictionary), "labelled")
    return dictionary, train(labelled.where(f"not ({IS_HELD_OUT})"))


def _candidates(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(row, start, end, is named) of all candidates, each place once."""
    own = named(data, offsets)
    return sorted([(*c, True) for c in own] + [(*c, False) for c in set(runs(data, offsets)).difference(own)])


def _judged(batch: pa.RecordBatch, dictionary: np.ndarray, forest: Forest | None):
    """(row, start, token, features, score) of the findings of a batch, in order; none lies within
    another. Without a forest the known formats and named values are the findings."""
    data, offsets = utf8(batch.column("__text"))
    found = _candidates(data, offsets)
    if not found:
        return []
    x = describe(data, offsets, found, batch.column("__path").to_pylist(), dictionary)
    scores = forest.votes(x) if forest else np.maximum(x[:, FEATURES.index("known")], [c[3] for c in found])
    kept, end = [], {}
    for (row, a, z, _), f, s in sorted(zip(found, x, scores.tolist(), strict=True), key=lambda p: (p[0][0], p[0][1], -p[0][2])):
        if s >= 0.5 and z > end.get(row, 0):
            end[row] = z
            kept.append((row, a - int(offsets[row]), data[a:z].tobytes(), f, s))
    return kept


def _inputs(docs: DataFrame, keep: list[str]) -> DataFrame:
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"), path.alias("__path"))


def scan(docs: DataFrame, model: tuple[np.ndarray, Forest | None]) -> DataFrame:
    """A row a finding: doc_id, place in bytes of the text, kind (``key`` for known formats, else
    ``assigned`` or ``token``), digest of the secret and score. Null and empty texts have none;
    repeated rows have theirs each."""
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "__text"):
                if found := _judged(batch, *shared.value):
                    row, start, token, x, score = zip(*found, strict=True)
                    kind = ["key" if f[FEATURES.index("known")] else "assigned" if f[FEATURES.index("assigned")] else "token" for f in x]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(row)), pa.array(start, pa.int64()), pa.array([len(t) for t in token], pa.int32()), pa.array(kind), pa.array([hashlib.sha256(t).hexdigest() for t in token]), pa.array(score)],
                        names=[c.split()[0] for c in FINDINGS.split(", ")],
                    )

    return _inputs(docs, ["doc_id"]).mapInArrow(run, FINDINGS)


def redact(docs: DataFrame, model: tuple[np.ndarray, Forest | None]) -> DataFrame:
    """docs with each finding in text replaced by ``[SECRET]``; n_chars, where there is one and the
    text changed, is that of the new text. All rows and columns stay; null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "__text"):
                found = _judged(batch, *shared.value)
                columns = {c: batch.column(c) for c in names}
                if found:
                    texts, chars = columns["text"].to_pylist(), columns["n_chars"].to_pylist() if "n_chars" in names else None
                    for row, own in groupby(found, key=lambda f: f[0]):
                        b, parts, last = texts[row].encode(), [], 0
                        for _, start, token, _, _ in own:
                            if start >= last:  # else it goes with the finding that it overlaps
                                parts += [b[last:start], REDACTED.encode()]
                            last = start + len(token)
                        texts[row] = b"".join([*parts, b[last:]]).decode()
                        if chars is not None:
                            chars[row] = len(texts[row])
                    columns["text"] = pa.array(texts, columns["text"].type)
                    if chars is not None:
                        columns["n_chars"] = pa.array(chars, columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return _inputs(docs, names).mapInArrow(run, docs.schema)


def precision_recall(docs: DataFrame) -> tuple[float, float]:
    """On planted findings that took no part in training."""
    dictionary = dictionary_of(docs)
    findings = materialize(planted(docs, dictionary), "labelled")
    return held_out(findings.where(IS_HELD_OUT), train(findings.where(f"not ({IS_HELD_OUT})")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))

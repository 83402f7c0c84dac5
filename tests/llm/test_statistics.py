"""Quality statistics, discriminant and fingerprints against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tamarack.llm import common, fingerprint, quality

TEXTS = [
    "", " \n ", "One two two, three!\nOne two\n\nsame line\nsame line\nsame line", "a", "ÄÖ ü é 中文 42 #tag <b> &amp; x_y", "dup dup dup dup", "word " * 400, "line\n" * 30, "http://a/b?c=1 (x) [y] {z} \"q\" 'r'\t\ttab",
]


def plain_statistics(text):
    data = text.encode()
    table = quality._class_table()
    kinds = Counter(int(table[b]) for b in data)
    inside = lambda b: table[b] in (0, 5, 6, 7) and b > 32
    words, own = [], b""
    lines = [[]]
    for b in data + b" ":
        if inside(b):
            own += bytes([b + 32 if 65 <= b <= 90 else b])
            continue
        if own:
            words.append(own)
            lines[-1].append(own)
            own = b""
        if b == 10:
            lines.append([])
    lines = [tuple(x) for x in lines if x]
    counts, n, size = Counter(words), len(words), len(data)
    again = sum(a == b for a, b in zip(words, words[1:]))
    repeated = len(lines) - len(set(lines))
    return [
        math.log1p(n), math.log1p(size / max(n, 1)), *[math.log1p(1000 * kinds[i] / max(size, 1)) for i in range(1, len(quality.CLASSES) + 1)],
        math.log((len(counts) + 1) / (n + 1)), math.log1p(100 * max(counts.values(), default=0) / max(n, 1)), math.log1p(100 * again / max(n, 1)),
        math.log1p(size / max(len(lines), 1)), math.log1p(100 * repeated / max(len(lines), 1)),
    ]


def test_statistics_are_those_of_a_plain_count():
    raw = [t.encode() for t in TEXTS]
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64))
    assert x.shape == (len(TEXTS), len(quality.FEATURES))
    assert np.allclose(x, [plain_statistics(t) for t in TEXTS])


def test_a_discriminant_is_fitted_as_by_hand(spark):
    rng = np.random.default_rng(4)
    p = len(quality.FEATURES)
    x = rng.normal(size=(300, p)) @ rng.normal(size=(p, p)) * 0.3
    y = (x[:, 0] + rng.normal(size=300) > 0.3).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)] + [([0.0] * p, None), ([9.0] * p, 7)], "x array<double>, label int")
    model = quality.train(rows, 0.2, 0.01)
    spread = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    share = [np.mean(y == c) for c in (0, 1)]
    pooled = share[0] * spread[0] + share[1] * spread[1]
    logs = []
    for c in (0, 1):
        s = 0.8 * spread[c] + 0.2 * pooled + np.diag(0.02 * np.diag(pooled) + 0.01)
        d = x - x[y == c].mean(0)
        logs.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))
    got = quality.score(rows.select("x", F.lit("clash").alias("score"), "label"), model, ["label", "score"])
    assert got.columns == ["label", "score", "predicted"] and dict(got.dtypes)["score"] == "double"


def plain_fingerprint(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text.lower()) if w]
    shingles = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words] if words else []
    least = {}
    for s in shingles:
        h = 42
        for w in s:
            h = xxh64_intdigest(w.encode(), h)
        h -= (h >> 63) << 64
        b = (h >> 57) + 64
        least[b] = min(h, least.get(b, h))
    if not least:
        return ""
    rng = random.Random(42)
    probes = [[rng.randrange(128) for _ in range(64)] for _ in range(128)]
    first = least[min(least)]
    return "".join(f"{least.get(b, next((least[j] for j in probes[b] if j in least), first)) & 15:x}" for b in range(128))


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / 128
    return max(0.0, (same - 1 / 16) / (15 / 16))


def test_fingerprints_edits_and_likeness_by_hand(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 4, 5, 6, 40, 400]))) for _ in range(60)]
    texts += [texts[-1], None, "", "x" * 5000, "Ünï côdé 😀 text 中文 " * 9, " lead\t\ttrail "]
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    own = fingerprint.with_next
    monkeypatch.setattr(fingerprint, "with_next", lambda docs: own(docs, 7))  # many ranges
    got = {r.doc_id: r for r in fingerprint.op10_fingerprint(spark, str(tmp_path)).collect()}
    whole = [t or "" for t in texts]
    assert len(got) == len(texts)
    for i, t in enumerate(whole):
        after, half = whole[(i + 1) % len(whole)], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r, fp = got[3 * i], plain_fingerprint(t)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), fp, plain_fingerprint(edited))
        assert r.near_edited == pytest.approx(plain_likeness(fp, plain_fingerprint(edited))) and r.near_next == pytest.approx(plain_likeness(fp, plain_fingerprint(after)))
    assert common.kept(["a", "a", "score"], ("score",)) == ["a"]

"""The prefix trie against a plain one: dicts of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tamarack.llm import prefix_trie as trie

KIND = "conv_id long, turn long, role string, text string, depth long, seq string"


def plain_trie(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple((own.get(c - (abs(c) % 5 if c > 0 else -(abs(c) % 5)), [])[:h] + s[h:]) if rebuild else s)
    members, children, below = {}, {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], set()).add(c)
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    out = []
    for s in sorted(members, key=len, reverse=True):
        own_children = children.get(s, [])
        saved = (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        below[s] = (sum(below[x][0] for x in own_children) or 1, saved + sum(below[x][1] for x in own_children))
        ends = ",".join(map(str, sorted(c for c in members[s] if len(whole[c]) == len(s))))
        out.append((min(members[s]), len(s), min(members[s[:-1]]) if s else None, len(members[s]), len(own_children), *below[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rows(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def test_trie_of_the_given_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert plain_rows(trie.op12_prefix_trie(spark, sf_dir)) == plain_trie([tuple(r) for r in rows.collect()])


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_of_odd_conversations(spark, rebuild):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bé", "x" * 3000])) for c in range(60) for t in range(rng.choice([1, 2, 3, 5, 8, 13]))]
    rows += [(c, t, "user", "same") for c in (70, 71, 75, 80, 81) for t in range(6)]  # copies
    rows += [(100, t, "user", f"t{t % 3}") for t in range(70)] + [(101, t, "user", f"t{t % 3}") for t in range(90)]  # deep ones
    rows += [(-7, 0, None, None), (-7, None, None, ""), (-7, None, "user", None), (-5, 3, "", ""), (None, 0, "user", "lost"), (90, 1, "user", "tie"), (90, 1, "bot", "tie"), (90, 1, "bot", "tie"), (4611686018427387905, 0, "user", "far")]
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], KIND).repartition(5)
    own = trie.sequences(df)
    assert plain_rows(trie.prefix_trie(trie.rebuilt(own) if rebuild else own)) == plain_trie(rows, rebuild)


def test_trie_without_conversations_or_turns(spark):
    none = spark.createDataFrame([], KIND)
    assert trie.prefix_trie(trie.rebuilt(trie.sequences(none))).collect() == []
    bare = spark.createDataFrame([(4, b""), (2, b"")], "conv_id long, seq binary")
    assert [tuple(r) for r in trie.prefix_trie(bare).collect()] == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]
    one = trie.prefix_trie(trie.sequences(spark.createDataFrame([(3, 0, "user", "é", 0, "")], KIND)))
    assert [tuple(r) for r in one.orderBy("depth").collect()] == [(3, 0, None, 1, 1, 1, 0, hashlib.sha256(b"").hexdigest()), (3, 1, 3, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]


def test_many_ids_of_one_end_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 64)  # in this process; workers keep theirs
    ids = [*range(5, 20_000, 3), -4]
    df = spark.createDataFrame([(b"k", i) for i in ids] + [(b"l", 1)], "end binary, conv_id long").repartition(4)
    got = {bytes(r.end): r.ends_sha256 for r in trie.end_hashes(df).collect()}
    assert got == {b"k": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"l": hashlib.sha256(b"1").hexdigest()}


def test_cuts_name_prefixes_by_their_smallest_member(spark):
    sym = lambda *turns: b"".join(bytes([t]) * trie.SYMBOL for t in turns)
    rows = spark.createDataFrame([(0, 0, sym(1, 2, 3), 2, 5, b"a"), (0, 0, sym(1, 2), 1, 3, b"b"), (0, 0, sym(1, 4, 4), 1, 4, b"c")], "context long, above int, seq binary, n long, least long, end binary")
    upper, lower = trie.cut(rows, 2)
    assert sorted((bytes(r.seq), r.n, r.least, r.end and bytes(r.end)) for r in upper.collect()) == [(sym(1, 2), 3, 3, b"b"), (sym(1, 4), 1, 4, None)]
    assert sorted((r.context, r.above, bytes(r.seq), r.n, r.least) for r in lower.collect()) == [(3, 2, sym(3), 2, 5), (4, 2, sym(4), 1, 4)]
    assert "Python" not in upper._jdf.queryExecution().toString() and lower.where(F.col("above") != 2).count() == 0

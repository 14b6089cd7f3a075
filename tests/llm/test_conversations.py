"""The prefix trie against all prefixes written out."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from laureate.llm import conversations as trie

NONE = hashlib.sha256(b"").hexdigest()


def rebuilt(rows):
    """conv -> its rebuilt turns."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in own.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        family = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = tuple(turns.get(family, [])[:h]) + tuple(turns[c][h:])
    return out


def plain(rows):
    """All nodes by their members."""
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[convs[c][:d]].append(c)
    out = set()
    for prefix, held in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in held if len(convs[c]) == len(prefix))
        out.add((
            held[0], len(prefix), members[prefix[:-1]][0] if prefix else None, len(held),
            len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_bytes", "ends_sha256")
DDL = "conv_id bigint, turn bigint, role string, text string, start int, `a.b` string"


def frame(spark, rows):
    rng = random.Random(0)
    rows = [(*r, 1, "x") for r in rows]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DDL)


def made(seed, convs, most=12, words=3, ids=None):
    rng = random.Random(seed)
    rows = []
    for c in ids or range(convs):
        n = rng.randint(1, most)
        first = rng.choice([None, 0, 5])
        for i in range(n):
            turn = first if i == 0 else 10 + i
            role = rng.choice(["user", "user", None])
            rows.append((c, turn, role, rng.choice(["a", "bé", None, "ccc"][: words + 1])))
    return rows


def same(spark, rows):
    got = trie.prefix_trie(frame(spark, rows)).collect()
    found = [tuple(r[c] for c in COLUMNS) for r in got]
    want = plain(rows)
    assert len(found) == len(want) and set(found) == want
    keys = {r.key: r for r in got}
    assert all((r.parent in keys) == (r.depth > 0) for r in got)


@pytest.mark.parametrize("a,b", [(0, 1), (0, 8), (3, 7), (5, 6), (8, 15), (7, 100)])
def test_two_fattest(a, b):
    def power(x):
        return x & -x

    assert trie.two_fattest(a, b) == max(range(a + 1, b + 1), key=power)


def segment(turns, conv, start=0, first=bytes(16)):
    digests = b"".join(hashlib.md5(t.encode()).digest() for t in turns)
    number = int.from_bytes(first, "big")
    keys = b"".join(map(trie._key, trie.extended(number, digests)))
    sizes = np.array([len(t) for t in turns], dtype=np.int64)
    return trie.Segment(start, first, keys, sizes, 0, (1, 0), conv)


def test_trie_keeps_its_handles_and_finds_exits():
    rng = random.Random(1)
    for _ in range(60):
        texts = [tuple(rng.choices("ab", k=rng.randint(0, 20))) for _ in range(40)]
        texts += [texts[0][:i] for i in range(len(texts[0]))]
        held = [segment(t, i) for i, t in enumerate(texts)]
        grown = trie.ZFastTrie(held[0])
        for i in range(0, len(held), 7):
            grown.insert(held[i : i + 7])
        assert len(grown.handles) == len(grown.nodes)
        assert all(grown.handles[n.handle()] is n for n in grown.nodes)
        # Compacted: at most two nodes a text, and the deepest match equals a scan's.
        assert len(grown.nodes) <= 2 * len(set(texts))
        prefixes = {t[:d] for t in texts for d in range(len(t) + 1)}
        for _ in range(20):
            t = tuple(rng.choices("ab", k=rng.randint(0, 20)))
            s = segment(t, 0)
            found = grown.locate(s, grown.root)
            ends = [n.high for n in grown.nodes if n.high <= s.end and n.of.key(n.high) == s.key(n.high)]
            assert found.high == max(ends, default=0)
        rows = trie.expanded([grown])
        assert rows.num_rows == len(prefixes)
        many = dict(zip(rows["key"].to_pylist(), rows["sum_0"].to_pylist()))
        for t in texts:
            for d in range(1, len(t) + 1):
                key = segment(t, 0).key(d)
                assert many[key] == sum(u[:d] == t[:d] for u in texts)


def test_conversations(spark):
    rows = made(1, 60)
    rows += [(None, 1, "user", "nobody's"), (3, 99, "user", "last"), (3, 99, "user", "last")]
    rows += made(2, 0, ids=[-7, -5, -1, 10**15, 10**15 + 3])
    same(spark, rows)


def test_copies_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 5)
    monkeypatch.setattr(trie, "TOGETHER", 300)
    monkeypatch.setattr(trie, "BATCH", 8)
    monkeypatch.setattr(trie, "CHUNK", 10)
    rows = [(c, i, "user", f"t{i}") for c in range(100, 160) for i in range(3)]
    rows += [(c, i, "user", f"t{i}") for c in (5, 6, 7, 9) for i in range(70)]
    rows += [(8, i, "user", f"t{i % 30}") for i in range(90)]
    rows += [(c, 0, None, None) for c in range(200, 210)]
    same(spark, rows)


def test_a_long_conversation_is_dealt_to_many_tasks(spark):
    df = spark.range(20000).select(
        F.lit(5).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"),
    )
    runs = trie._runs(df, "conv_id", "turn", "role", "text")
    # Runs are numbered by partition, above bit 33.
    sizes = runs.groupBy(F.shiftright("run", 33)).agg(F.sum("n")).collect()
    assert len(sizes) > 1 and max(r[1] for r in sizes) < 15000
    got = trie.prefix_trie(df)
    assert got.count() == 20001 and got.filter("n_children = 0").count() == 1


def test_no_rows(spark):
    got = trie.prefix_trie(spark.createDataFrame([], DDL))
    assert got.count() == 0


def test_query(spark):
    from laureate.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_zfast_trie"](spark, sf)
    names = [c.replace("saved_bytes", "saved_tokens") for c in COLUMNS]
    assert set(map(tuple, got.select(*names).collect())) == plain(rows)


def test_query_equals_sql(spark):
    from laureate.llm.queries import ORACLE, QUERIES
    from tests.compare import assert_same, duck

    sf = "/root/testdata/sf0.01"
    con = duck(sf)
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert assert_same(QUERIES["op13_zfast_trie"](spark, sf), con, ORACLE["op13_zfast_trie"]) > 200

"""Fill-in-the-middle against joined parts, and back."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from laureate.llm import rotation
from tests.compare import assert_same, duck

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain(doc_id, text):
    """n, form, prefix_chars, middle_chars and output by joining units."""
    text = text or ""
    key = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_rotation_exchanges_segments(data, x, y):
    a, cut = sorted((min(x, len(data)), min(y, len(data))))
    held = bytearray(data)
    rotation.rotate(np.frombuffer(held, dtype=np.uint8), a, cut, len(data))
    assert bytes(held) == data[:a] + data[cut:] + data[a:cut]


def test_reversal_in_blocks(monkeypatch):
    monkeypatch.setattr(rotation, "_BLOCK", 3)
    for n in range(30):
        held = bytearray(range(n))
        rotation.reverse(np.frombuffer(held, dtype=np.uint8), 0, n)
        assert bytes(held) == bytes(range(n))[::-1]


@given(st.text(alphabet="ab <>PSM\né日", max_size=30), st.integers(0, 10**6))
@settings(max_examples=400, deadline=None)
def test_one_text(text, doc_id):
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    keys = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    *found, output = rotation._one(text.encode(), keys)
    assert (*found, output.decode()) == plain(doc_id, text)
    assert rotation.restored(output, found[1]).decode() == text


def test_documents(spark):
    rng = random.Random(1)
    texts = [
        "".join(rng.choices(["word", " ", "\n", "é", "日本", "<", "S>", "\t", "  "], k=rng.randint(0, 30)))
        for _ in range(200)
    ]
    long = " ".join(rng.choices(["alpha", "beta", "x" * 70000], k=40)) + "  "
    rows = [(i, t, "f", i) for i, t in enumerate([*texts, None, "", " ", "a <M> b", long, long])]
    rows += [(None, "no id here", "f", -1), (3, texts[3], "f", -2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string, tag int")
    made = rotation.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "tag", *rotation.ADDED]
    got = {r.tag: r for r in rotation.restore(made).collect()}
    assert len(got) == len(rows)
    for doc_id, text, _, tag in rows:
        r = got[tag]
        found = (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)
        assert r.doc_id == doc_id and found == plain(doc_id, text) and r.restored == (text or "")
    forms = {r.form for r in got.values()}
    assert forms == {"plain", "psm", "spm"}
    assert rotation.restore(rotation.fill_in_middle(docs.limit(0))).count() == 0


def test_query_equals_sql(spark):
    from laureate.llm.queries import ORACLE, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert assert_same(QUERIES["op12_block_rotation"](spark, sf), con, ORACLE["op12_block_rotation"])

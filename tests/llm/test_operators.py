"""Each operator against a plain version, with nulls, empty texts, ties and clashing names."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from laureate.llm import language, lines, neardup, packing, privacy, quality, warc
from laureate.llm.common import new_folder
from laureate.llm.decontaminate import contamination
from laureate.llm.neardup import near_duplicates, near_representatives
from laureate.llm.sharding import histogram_sort
from laureate.llm.topk import top_k

COLUMNS = "doc_id bigint, text string, row string, `h.x` int"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, f"r{i}", i) for i, t in enumerate(texts)], COLUMNS)


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def sentences(seed: int, n: int) -> str:
    w = words(seed, n)
    return " ".join(x + ("." if i % 9 == 8 else "") for i, x in enumerate(w))


def test_recursions_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(language, "SEGMENT", 7)
    monkeypatch.setattr(language, "_CLASSES", 11)
    rng, k = np.random.default_rng(0), 3
    model = language.Model(
        rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(11), k).T
    )
    lengths = np.array([1, 5, 7, 8, 30, 14])
    classes = rng.integers(0, 11, lengths.sum())
    found = language._Texts(model, classes, lengths).likelihood()
    starts, moves, emit = language._Texts(model, classes, lengths).expected()
    want = [np.zeros(k), np.zeros((k, k)), np.zeros((11, k))]
    at = 0
    for i, n in enumerate(lengths):
        x, at = classes[at : at + n], at + n
        ahead = [model.start * model.emit[x[0]]]
        for t in range(1, n):
            ahead.append(ahead[-1] @ model.moves * model.emit[x[t]])
        behind = [np.ones(k)]
        for t in range(n - 1, 0, -1):
            behind.insert(0, model.moves @ (model.emit[x[t]] * behind[0]))
        total = ahead[-1].sum()
        assert np.isclose(np.log(total), found[i])
        want[0] += ahead[0] * behind[0] / total
        for t in range(n):
            want[2][x[t]] += ahead[t] * behind[t] / total
            if t:
                joint = ahead[t - 1][:, None] * model.moves * (model.emit[x[t]] * behind[t])
                want[1] += joint / total
    for a, b in zip((starts, moves, emit), want):
        assert np.allclose(a, b)


def test_language_model_counts(spark):
    table = docs(spark, "a b A", None, "b zz", "")
    held = F.col("doc_id") == 2
    got = {r.doc_id: r for r in language.score(table, held, rounds=1).collect()}
    # Training tokens: a, b, a and three ends.
    assert {i: (r.n_tokens, r.n_known, r.train_tokens) for i, r in got.items()} == {
        0: (4, 4, 6), 1: (1, 1, 6), 2: (3, 2, 6), 3: (1, 1, 6),
    }
    assert got[2].held_out and not got[0].held_out
    want = np.log10([1.5 / 8, 0.5 / 8, 3.5 / 8]).sum()
    assert got[2].base_score == pytest.approx(want)
    assert all(r.score < 0 for r in got.values())
    assert language.score(table.limit(0), held, rounds=1).count() == 0


def test_repeated_passages_go(spark):
    passage, own = sentences(1, 60), [sentences(s, 40) for s in range(2, 6)]
    table = docs(
        spark, f"{own[0]}\n{passage}\n{own[1]}", f"{own[2]}\n{passage}", own[3], None, "", passage
    )
    got = {r.doc_id: r for r in lines.dedup_lines(table).collect()}
    assert got[0].text == f"{own[0]}\n{passage}\n{own[1]}"
    assert got[1].text.strip() == own[2] and got[1]["h.x"] == 1 and got[1].row == "r1"
    assert got[2].text == own[3] and got[3].text is None and got[4].text == ""
    assert got[5].text == ""
    left = lines.dedup_lines(table, drop_emptied=True)
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 4]
    assert lines.dedup_lines(table.limit(0)).count() == 0


def test_repeated_passages_go_between_any_neighbours(spark):
    passages = {}
    for n in (1, 2, 3, 4):
        for p in range(5):
            w = words(1000 + 10 * n + p, 56)
            step = 56 // n
            passages[n, p] = " ".join(" ".join(w[i : i + step]) + "." for i in range(0, 56, step))
    texts, own = [], []
    for (n, p), passage in passages.items():
        for copy in range(4):
            seed = 2000 + 100 * n + 20 * p + 2 * copy
            own.append([f"{sentences(s, 26)}." for s in (seed, seed + 1)])
            between = "\n" if copy % 2 else " "
            texts.append(between.join([own[-1][0], passage, own[-1][1]]))
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, *texts)).collect()}
    for i, (before, after) in enumerate(own):
        want = texts[i].split() if i % 4 == 0 else f"{before} {after}".split()
        assert got[i].split() == want


def test_repeated_passages_of_many_short_lines_go_whole(spark):
    passages = ["\n".join(words(3000 + p, 70)) for p in range(12)]
    own = [[sentences(3100 + 4 * p + i, 30) for i in range(4)] for p in range(12)]
    table = docs(
        spark, *[f"{o[0]}\n{p}\n{o[1]}" for p, o in zip(passages, own)],
        *[f"{o[2]}\n{p}\n{o[3]}" for p, o in zip(passages, own)],
    )
    got = {r.doc_id: r.text for r in lines.dedup_lines(table).collect()}
    assert [got[12 + i].split() for i in range(12)] == [f"{o[2]} {o[3]}".split() for o in own]
    assert all(p in got[i] for i, p in enumerate(passages))


def test_repeated_passages_equal_all_runs(spark):
    rng = random.Random(11)
    pool = [" ".join(words(s, rng.randint(1, 24))) for s in range(14)]
    taken = [[rng.choice(pool) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(
        docs(spark, *["\n".join(t) for t in taken])).collect()}
    seen = set()
    for i, t in enumerate(taken):
        runs = [(a, b) for a in range(len(t)) for b in range(a + 1, len(t) + 1)
                if sum(len(x.split()) for x in t[a:b]) >= 20]
        gone = {j for a, b in runs if tuple(t[a:b]) in seen for j in range(a, b)}
        assert got[i].split() == [w for j, x in enumerate(t) if j not in gone for w in x.split()]
        seen |= {tuple(t[a:b]) for a, b in runs}


def test_archives_round_trip(spark):
    long = "x" * 1500
    pages = spark.createDataFrame(
        [(1, "http://a/ü", long), (2, None, long), (3, "u", "short"), (4, "u", "short"),
         (5, "u", None), (6, "u", "é" * 700), (2, None, long)],
        "page_id bigint, url string, html string",
    )
    folder = new_folder(spark, "test-warc")
    archives = warc.write_warc(pages, folder)
    for split in (100, 1 << 20, None):
        got = warc.read_warc(archives, split).orderBy("record_id", "offset").collect()
        assert [(r.record_id[-1], r.record_type, r.payload_bytes) for r in got] == [
            ("1", "revisit", 1500), ("2", "response", 1500), ("2", "response", 1500),
            ("3", "response", 5), ("4", "response", 5), ("5", "response", 0),
            ("6", "response", 1400),
        ]
        assert got[0].refers_to.endswith(":2") and bytes(got[1].payload) == long.encode()
    assert warc.read_warc(warc.write_warc(pages.limit(0), new_folder(spark, "none"))).count() == 0


def _components(sets: dict) -> dict:
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 80 * len(x | y) and least[a] < least[b]:
                    least[b], changed = least[a], True
    return least


def test_near_duplicates_equal_all_pairs(spark):
    base = [words(s, 120) for s in range(6)]
    rng, texts = random.Random(9), []
    for i in range(60):
        text = list(base[i % 6])
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(["uu", "vv", "ww"]) + str(i)
        texts.append(" ".join(text))
    texts += [None, "", " \n", "one", "ONE", "one two", texts[0]]
    table = docs(spark, *texts)
    got = near_duplicates(table, k=4).collect()
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        n = min(4, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    want = _components(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {
        i: (len(sets[i]), want[i]) for i in sets
    }
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(table.limit(0)).count() == 0
    kept = near_representatives(table.unionByName(table.limit(1)), k=4)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)


def test_near_duplicates_without_or_with_repeated_ids(spark):
    texts = [words(4000 + i, 120) for i in range(3)]
    near = lambda i, n: " ".join(texts[i][:-1] + [f"end{n}"])
    rows = [(None, near(0, 1)), (None, near(0, 2)), (5, near(0, 3)), (None, near(0, 1)),
            (7, near(1, 1)), (7, near(2, 1)), (2, near(1, 2)), (3, near(2, 2))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_duplicates(table, k=4).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [
        (0, 5), (0, 5), (0, 5), (2, 2), (3, 3), (5, 5), (7, 2), (7, 3),
    ]


def test_trees_bring_pairs_together_at_depth(spark):
    rng = np.random.default_rng(8)
    left = rng.integers(0, 1 << 30, (400, 64))
    right = np.where(rng.random((400, 64)) < 0.8, left, left + 1)
    rows = [(i, x.tolist()) for i, x in enumerate(np.stack([left, right], 1).reshape(800, 64))]
    classes = spark.createDataFrame(rows, "class bigint, tokens array<int>").cache()
    share = 100 / 80 / 64
    for level in (4, 7):
        trees = range(neardup.FIRST_TREES, neardup.FIRST_TREES + neardup.trees_for(level, share, 80))
        nodes = neardup._rooted(classes.select("class"), trees, classes, share, level)
        met = nodes.groupBy("node", F.expr("class div 2 AS pair")).count().filter("count > 1")
        assert met.select("pair").distinct().count() == 400


def test_top_k_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (None, [1.0]), (120, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = top_k(table, F.col("vec_id") % 20 == 0, k=5, block=16).collect()
    valid = [(i, np.floor(64 * np.float32(v).astype(float)).astype(int))
             for i, v in rows if i is not None and i not in (100, 101, 102)]
    want = []
    for q, v in valid:
        if q % 20 == 0:
            best = sorted((-int(v @ c), i) for i, c in valid if i != q)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert top_k(table.limit(0), F.lit(True)).count() == 0


def test_shards_are_even_and_gapless(spark):
    table = spark.range(3000).selectExpr(
        "if(id < 2000, 7L, if(id = 2500, NULL, id)) AS k", "id AS line", "id AS shard", "id AS `a.b`"
    )
    got = histogram_sort(table, [F.col("k"), F.col("line")], F.lit(10), 7).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "max"])
    assert len(got) == 3000 and sizes["count"].between(428, 429).all()
    assert (sizes["max"] + 1 == sizes["count"]).all()
    ordered = got.sort_values(["shard", "slot"])
    assert ordered.k.fillna(-1).is_monotonic_increasing and "a.b" in got.columns
    few = histogram_sort(table.limit(3), [F.col("line")], F.lit(1), 40)
    assert few.count() == 3
    assert histogram_sort(table.limit(0), [F.col("line")], F.lit(1), 4).count() == 0


def test_contamination_equals_plain_search(spark):
    item, short = words(1, 30), ["tiny", "item"]
    texts = [
        " ".join(words(2, 50) + item[5:20] + words(3, 10)), " ".join(item[:12]), None, "",
        "A Tiny, ITEM!", " ".join(words(4, 400) + item[:13]), " ".join(item),
    ]
    bench = spark.createDataFrame(
        [(1, " ".join(item)), (2, "tiny item"), (3, None), (4, "..."), (10, " ".join(item[:13]))],
        "item_id bigint, text string",
    )
    got = contamination(docs(spark, *texts), bench).collect()
    windows = {tuple(item[i : i + 13]): {"1"} for i in range(18)} | {tuple(short): {"2"}}
    windows[tuple(item[:13])] = {"1", "10"}
    for r in got:
        w = "".join(c if c.isalnum() else " " for c in (r.text or "").lower()).split()
        hit, names = set(), set()
        for i in range(len(w)):
            for n in (13, 2):
                if i + n <= len(w) and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(names))
    assert contamination(docs(spark, *texts).limit(0), bench).count() == 0
    assert contamination(docs(spark, "a b"), bench.limit(0)).collect()[0].n_hit == 0


def test_boundaries_are_optimal():
    rng = random.Random(5)
    lengths = np.array(sorted(rng.sample(range(1, 60), 9)))
    counts = np.array([rng.randint(1, 30) for _ in lengths])

    def padding(ends):
        at = np.searchsorted(ends, lengths)
        return int((counts * (np.array(ends)[at] - lengths)).sum())

    from itertools import combinations

    best = min(
        padding(sorted([*c, lengths[-1]])) for c in combinations(lengths[:-1].tolist(), 2)
    )
    assert padding(packing.boundaries(lengths, counts, 3)) == best
    assert packing.boundaries(lengths[:0], counts[:0], 3) == []


def test_packing_keeps_all_tokens(spark):
    texts = [" ".join(words(i, n)) for i, n in enumerate([1, 3, 8, 7, 20, 33, 0])] + [None]
    got = packing.pack(docs(spark, *texts), longest=8, buckets=3, budget=32).toPandas()
    assert got.n_tokens.sum() == sum(len((t or "").split()) + 1 for t in texts)
    assert (got.n_tokens <= got.bucket_tokens).all() and got.n_tokens.max() <= 8
    for i, t in enumerate(texts):
        parts = got[got.doc_id == i].sort_values("piece").text
        assert "".join(x or "" for x in parts).split() == (t or "").split()
    for _, batch in got.groupby(["bucket", "batch"]):
        assert sorted(batch.place) == list(range(len(batch)))
        assert len(batch) * batch.bucket_tokens.iloc[0] <= 32
    assert packing.pack(docs(spark, "a").limit(0)).count() == 0


def test_personal_data_and_terms(spark):
    texts = [
        "Mail Zorblat at z@x.org today", "we saw zorblat again, write z@x.org now please",
        "the chief ZORBLAT has the address z@x.org indeed", "nothing here", None, "",
        "1.2.3.4.5.6.7.8 or 999.1.1.1, 4111 1111 1111 1111, +1 (017) 555-7713 a@b@c.de",
    ] + ["the chief said today now please"] * 20
    got = {r.doc_id: r for r in privacy.personal_data(docs(spark, *texts)).collect()}
    assert [t["start"] for t in got[0].terms] == [5] and not got[3].terms and not got[4].spans
    assert [texts[6][s["start"] : s["end"]] for s in got[6].spans] == [
        "b@c.de", "1.2.3.4", "5.6.7.8", "4111 1111 1111 1111", "+1 (017) 555-7713",
    ]
    clean = privacy.sanitised(privacy.personal_data(docs(spark, *texts)))
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[0] == "Mail [NAME] at [EMAIL] today" and out[4] is None and out[7] == texts[7]


def test_disclosing_terms_go_wherever_they_stand(spark):
    far = "one two three four five six seven eight nine ten eleven twelve"
    texts = [
        "Mail Zorblat at z@x.org today", "we saw zorblat again, write z@x.org now please",
        f"the chief ZORBLAT has z@x.org indeed {far} Zorblat", f"\u00fc \u4e2d, {far} zorblat.",
    ] + ["the chief said today now please"] * 2000
    found = privacy.personal_data(docs(spark, *texts))
    got = {r.doc_id: r for r in found.filter("doc_id < 5").collect()}
    assert [[texts[i][t["start"] : t["end"]] for t in got[i].terms] for i in range(5)] == [
        ["Zorblat"], ["zorblat"], ["ZORBLAT", "Zorblat"], ["zorblat"], [],
    ]


def test_quality_on_held_out_texts(spark):
    good = [sentences(i, 80) for i in range(120)]
    bad = [" ".join(w.upper() + "!!%" for w in words(500 + i, 80)) for i in range(120)]
    table = docs(spark, *good, *bad, None, "")
    labels = spark.createDataFrame(
        [(i, int(i < 120)) for i in range(240)] + [(None, 1), (7, None), (999, 0)],
        "doc_id bigint, quality int",
    )
    model = quality.train(table, labels.filter("doc_id % 2 = 0"))
    got = {r.doc_id: r.score for r in quality.with_score(table, model).collect()}
    assert len(got) == 242 and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == (i < 120) for i in range(1, 240, 2)]
    assert sum(right) / len(right) > 0.95
    none = quality.train(table, labels.limit(0))
    assert none.weights[-1] == 0.0


def test_close_pairs_equal_all_pairs():
    rng = np.random.default_rng(5)
    for n in (2, 5, 40, 700):
        classes = rng.permutation(10 * n)[:n].astype(np.int64)
        parts = rng.integers(0, max(2, n // 3), n)
        sizes = rng.integers(80, 110, n)
        tokens = rng.integers(0, 2, (neardup.PLACES, n)).astype(np.int32)
        got = set(zip(*(x.tolist() for x in neardup.close_pairs(classes, parts, sizes, tokens, 80, 36))))
        want = set()
        for i in range(n):
            for j in range(i):
                small, large = sorted((sizes[i], sizes[j]))
                if parts[i] != parts[j] and 100 * small >= 80 * large:
                    if (tokens[:, i] == tokens[:, j]).sum() >= 36:
                        want.add((min(classes[i], classes[j]), max(classes[i], classes[j])))
        assert got == want


def test_a_group_of_one_template_equals_all_pairs(spark, monkeypatch):
    """Texts that share most words without links between most of them, in one node."""
    monkeypatch.setattr(neardup, "OPEN_PAIRS", 1 << 14)
    rng, k = random.Random(6), 4
    base = words(7, 200)
    texts = []
    for i in range(160):
        own = list(base)
        for at in rng.sample(range(0, 200, 5), rng.choice([3, 9, 9, 9])):
            own[at] = f"own{i}x{at}"
        texts.append(" ".join(own))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, *texts), k=k).collect()}
    sets = [{tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label))
    assert len(set(label)) > 20


def _template_texts(rng: random.Random, n: int, length: int, changed: list[int]) -> list[str]:
    base = words(11, length)
    texts = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(0, length, 5), rng.choice(changed)):
            own[at] = f"own{i}x{at}"
        texts.append(" ".join(own))
    return texts


def test_sketches_rule_out_no_link(spark):
    rng, percent = random.Random(12), 80
    texts = [t for n in (40, 150, 400) for t in _template_texts(rng, 30, n, [0, 1, n // 50, n // 25])]
    sets = list(neardup.shingle_sets(texts, 4))
    classes = np.arange(len(sets)) * 7
    parts = np.array([rng.choice([0, 0, i]) for i in range(len(sets))])
    sizes = np.array([len(x) for x in sets])
    sketches = pa.array([neardup.parity_sketch(x).tobytes() for x in sets])
    got = set(zip(*(x.tolist() for x in neardup.linkable_pairs(classes, parts, sizes, sketches, percent))))
    assert len({len(x.as_py()) for x in sketches}) > 1
    links = others = 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            union = sizes[i] + sizes[j] - common
            pair = (int(classes[j]), int(classes[i]))
            if parts[i] == parts[j]:
                assert pair not in got
            elif 100 * common >= percent * union:
                assert pair in got
                links += 1
            else:
                others += pair in got and 100 * common < (percent - 5) * union
    assert links > 50 and others == 0
    pairs = spark.createDataFrame(
        [(int(classes[i]), int(classes[j]), int(sizes[i]), int(sizes[j]),
          bytearray(sketches[i].as_py()), bytearray(sketches[j].as_py()))
         for i in range(len(sets)) for j in range(i) if parts[i] != parts[j]],
        "a bigint, b bigint, size_a bigint, size_b bigint, sketch_a binary, sketch_b binary",
    ).repartition(3).filter("5 * least(size_a, size_b) >= 4 * greatest(size_a, size_b)")
    close = pairs.mapInArrow(neardup._close(percent), "a bigint, b bigint").collect()
    assert {(r.b, r.a) for r in close} == got


def test_texts_alike_below_the_threshold_make_no_pairs(spark, monkeypatch):
    """Rows of pairs must not grow with the square of a group without links."""
    texts, asked = _template_texts(random.Random(13), 120, 300, [8, 9, 10]), []
    load = neardup._Join._load

    def watched(join, pairs):
        asked.append(pairs.count())
        load(join, pairs)

    monkeypatch.setattr(neardup._Join, "_load", watched)
    got = near_duplicates(docs(spark, *texts), k=4).collect()
    assert all(r.kept for r in got) and len(got) == 120
    assert sum(asked) < 120


def test_pairs_that_meet_in_many_nodes_are_told_once(spark):
    rng = random.Random(14)
    sets = list(neardup.shingle_sets(_template_texts(rng, 30, 150, [0, 1, 2]), 4))
    nodes = [sorted(rng.sample(range(-40, 40), 25)) for _ in sets]
    rows = [(v, i, i % 9, len(x), bytearray(neardup.parity_sketch(x).tobytes()), held)
            for i, (x, held) in enumerate(zip(sets, nodes)) for v in held]
    table = spark.createDataFrame(
        rows, "node bigint, class bigint, component bigint, size bigint, sketch binary, nodes array<bigint>"
    ).repartition(5, "node").sortWithinPartitions("node")
    found = table.mapInArrow(neardup._within_nodes(80), "a bigint, b bigint").collect()
    want = set()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            common = len(np.intersect1d(x, y))
            if i % 9 != j % 9 and set(nodes[i]) & set(nodes[j]):
                if 100 * common >= 80 * (len(x) + len(y) - common):
                    want.add((j, i))
    got = [(r.a, r.b) for r in found]
    assert len(got) == len(set(got)) and want <= set(got) and len(want) > 50


def test_tree_nodes_are_made_without_moving_classes(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 5, rng.integers(0, 3, 64).tolist()) for i in range(50)]
    classes = spark.createDataFrame(rows, "class bigint, size bigint, tokens array<int>")
    nodes = neardup._children(classes, range(16), 100 / 80 / 64)
    assert "hashpartitioning" not in nodes._jdf.queryExecution().executedPlan().toString()
    assert nodes.columns == ["node", "class", "size"] and nodes.count() > 50
    assert nodes.count() == nodes.distinct().count()


def test_components_of_paths_and_stars(spark):
    rng = random.Random(15)
    names = rng.sample(range(1000), 60)
    edges = list(zip(names[:30], names[1:30])) + [(names[30], x) for x in names[31:50]]
    edges += [(names[i], names[i + 1]) for i in range(50, 60, 2)] + edges[:3]
    links = spark.createDataFrame([(min(e), max(e)) for e in edges], "a bigint, b bigint")
    got = {(r["class"], r["component"]) for r in neardup.components(links).collect()}
    groups = [names[:30], names[30:50]] + [names[i : i + 2] for i in range(50, 60, 2)]
    assert got == {(x, min(g)) for g in groups for x in g}

"""Every stage of the pipeline against a plain version on its own input, and components that
grow link by link."""

from __future__ import annotations

import random

import corpus_pipeline
from laureate.llm.neardup import _Join
from laureate.llm.quality import THRESHOLD, learned, with_score
from tests.llm.test_operators import _components, sentences, words

ITEM = words(901, 30)
PASSAGE = sentences(902, 60)


def _documents() -> list[tuple]:
    good = [" ".join(words(i, 120)) for i in range(60)]
    bad = [" ".join(w.upper() + "!!%" for w in words(500 + i, 80)) for i in range(60)]
    near, other = good[0].split(), good[1].split()
    near[-1] = "changed"
    planted = [
        f"{sentences(700, 60)}\n{PASSAGE}\n{sentences(701, 40)}",
        f"{sentences(702, 60)}\n{PASSAGE}\n{sentences(703, 40)}",
        " ".join(near), good[1], " ".join(other[:60] + words(704, 60)),
        " ".join(words(705, 60) + ITEM[3:28] + words(706, 30)),
        " ".join(words(707, 600) + ITEM[:13]), None, "", "one", "one",
    ]
    texts = good + planted + bad
    return [(i, t, "x", None if t is None else len(t)) for i, t in enumerate(texts)]


def _runs(text: str | None, k: int) -> set:
    w = (text or "").lower().split()
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def _is_contaminated(text: str | None) -> bool:
    w = (text or "").split()
    windows = {tuple(ITEM[i : i + 13]) for i in range(len(ITEM) - 12)}
    hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_equal_plain_versions(spark, tmp_path, monkeypatch):
    rows = _documents()
    spark.createDataFrame(rows, "doc_id bigint, text string, row string, n_chars int").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    labels = [(i, int(i < 71)) for i in range(len(rows)) if i < 60 or i >= 71]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(
        f"{tmp_path}/labels.parquet"
    )
    spark.createDataFrame(
        [(1, " ".join(ITEM)), (2, None)], "item_id bigint, text string"
    ).write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            seen[name] = docs.collect()
            return stage(spark, docs, sf_dir)

        return name, run

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scored = with_score(table, learned(spark, table, str(tmp_path)))
    want = {r.doc_id for r in scored.collect() if r.score >= THRESHOLD}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, table, str(tmp_path)).collect()}
    assert kept == want and not any(i >= 71 for i in kept)

    # So few labels leave many scores near the threshold: the other stages see all documents.
    monkeypatch.setattr(
        corpus_pipeline, "STAGES", [watched(*stage) for stage in corpus_pipeline.STAGES[1:]]
    )
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {name: {r.doc_id: r.text for r in found} for name, found in seen.items()}

    after = texts["near_dedup"]
    assert PASSAGE in after[60] and PASSAGE not in after[61]
    # The whole copy of another document is a passage that an earlier one has.
    assert set(texts["line_dedup"]) - set(after) == {63}
    assert all(after[i] == t for i, t in texts["line_dedup"].items() if i not in (61, 63))
    assert all(r.n_chars == len(r.text) for r in seen["near_dedup"] if r.text is not None)

    sets = {i: _runs(t, 5) for i, t in after.items()}
    least = _components(sets)
    assert least[62] == 0
    assert set(texts["decontaminate"]) == {i for i in least if least[i] == i}

    left = {i: t for i, t in texts["decontaminate"].items() if not _is_contaminated(t)}
    assert 65 not in left and 66 in left
    assert texts["packing"] == left

    tokens = {}
    for r in packed:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {i: len((t or "").split()) + 1 for i, t in left.items()}


def test_components_of_links_in_steps(spark):
    rng = random.Random(4)
    links = sorted({tuple(sorted(rng.sample(range(80), 2))) for _ in range(60)})
    rng.shuffle(links)
    join = _Join(None, None, 5, 80)
    for some in (links[:25], links[25:28], links[28:], links[:3]):
        join.fresh = spark.createDataFrame(some, "a bigint, b bigint")
        join.relabel()
    least = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    assert sorted(tuple(r) for r in join.labels.select("class", "component").collect()) == sorted(
        least.items()
    )

"""Benchmark passages in documents: a prefix-filtered set join.

A window is a run of item words that must occur whole in a document. Seen as the
set of its shingles it has to be contained whole, so the necessary prefix, with
shingles ordered from rare to common, is the one rarest. Only documents that hold
that shingle can hold the window, and only where its place in the window fits
(position) and the window does not stick out of the document (length). What is
left is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.llm.common import (
    Words, batches, bit_filter, column, grouped, heavy_split, in_filter, plain_bytes,
    row_numbers, schema, shingle_hashes, table, written,
)

WINDOW, SHINGLE = 13, 5

#: Lower-cases A-Z and blanks every other ASCII byte that is no digit or letter.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


_ITEM_DDL = "window string, length int, item_id bigint, size int, place int, hash bigint"
_ITEM = pa.schema([
    ("window", pa.string()), ("length", pa.int32()), ("item_id", pa.int64()),
    ("size", pa.int32()), ("place", pa.int32()), ("hash", pa.int64()),
])


def _windows(window: int, shingle: int):
    """Each window of each item with the hashes and places of its shingles."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for item, text in zip(*(c.to_pylist() for c in part.columns)):
                    found = Words([plain_bytes(text, _PLAIN)])
                    n = len(found.hashes)
                    if not n:
                        continue
                    words = found.text(0, 0, n)
                    length = min(window, n)
                    size = min(shingle, length)
                    hashes = shingle_hashes(found.hashes, size).view(np.int64).tolist()
                    for i in range(n - length + 1):
                        joined = " ".join(words[i : i + length])
                        for p in range(length - size + 1):
                            yield joined, length, item, size, p, hashes[i + p]

        yield from batches(rows(), _ITEM)

    return run


_RUN_DDL = (
    "array<struct<first: int, words: array<string>, "
    "hits: array<struct<at: int, size: int, hash: bigint>>>>"
)
_RUN = pa.struct([
    ("first", pa.int32()), ("words", pa.list_(pa.string())),
    ("hits", pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("hash", pa.int64())]))),
])
def _hits(mask: np.ndarray, sizes: list[int], window: int):
    """Places where a document may hold an item's shingle, with the words around.

    Neighbouring places share one run of words, which reaches as far as any
    window over them could.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = row_numbers()
        for part in parts:
            counts, runs = [], []
            for group in grouped([plain_bytes(t, _PLAIN) for t in part.column(0).to_pylist()]):
                words = Words(group)
                found = _places(words)
                at = np.searchsorted(found[0], words.first)
                counts += np.diff(words.first).tolist()
                runs += [
                    _runs(words, i, [f[a:b] for f in found]) if b > a else []
                    for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist()))
                ]
            rows = [next(numbers) for _ in counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), part.column(1), pa.array(counts, pa.int64()),
                 pa.array(runs, pa.list_(_RUN))],
                ["row", "document", "n_words", "runs"],
            )

    def _places(words: Words) -> list[np.ndarray]:
        """Places among all words, sizes and hashes of the shingles in the filter."""
        last = np.repeat(words.first[1:], np.diff(words.first))
        found = []
        for size in sizes:
            own = shingle_hashes(words.hashes, size)
            at = np.flatnonzero(in_filter(mask, own))
            at = at[at + size <= last[at]]
            found.append((at, np.full(len(at), size), own[at].view(np.int64)))
        if not found:
            return [np.empty(0, dtype=np.int64)] * 3
        joined = [np.concatenate(x) for x in zip(*found)]
        order = np.lexsort((joined[1], joined[0]))
        return [x[order] for x in joined]

    def _runs(words: Words, i: int, found: list[np.ndarray]) -> list[dict]:
        n = int(words.first[i + 1] - words.first[i])
        out: list[dict] = []
        for at, size, value in zip((found[0] - words.first[i]).tolist(), *(f.tolist() for f in found[1:])):
            low, high = max(0, at - window), min(n, at + window)
            if not out or low > out[-1]["last"]:
                out.append({"first": low, "last": high, "hits": []})
            out[-1]["last"] = high
            out[-1]["hits"].append({"at": at, "size": size, "hash": value})
        for one in out:
            one["words"] = words.text(i, one["first"], one.pop("last"))
        return out

    return run


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    shingle: int = SHINGLE, keep: list[str] | None = None,
) -> DataFrame:
    """Per row of ``docs``: its columns, the words counted and hit, and the items found.

    ``keep`` lists the columns of ``docs`` to return, by default all.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items``
    and ``items`` (ids of the items with an occurring window, as sorted strings).
    An item shorter than a window is one window; an item without words is none.
    Null text has no words. Windows of an item without an id count as hits, but
    not as an item. Repeated rows of either table each keep their own result.
    Added columns replace columns of the same names.
    """
    windows = written(
        items.select(column(items, item_id).cast("long"), column(items, item_text))
        .mapInArrow(_windows(window, shingle), _ITEM_DDL),
        "windows",
    )
    shingles = windows.select("size", "hash").distinct()
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())
    mask = bit_filter(shingles, "hash")
    added = ("n_words", "n_hit", "n_items", "items")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    document = F.struct(*[column(docs, c) for c in kept])
    source = docs.select(column(docs, text).alias("text"), document.alias("document"))
    numbered = written(
        source.mapInArrow(
            _hits(mask, sizes, window),
            schema(row="bigint", document=source.schema["document"].dataType,
                   n_words="bigint", runs=_RUN_DDL),
        ),
        "document-hits",
    )
    runs = numbered.select("row", F.posexplode("runs").alias("run", "found"))
    hits = runs.select(
        "row", "run", F.explode("found.hits").alias("hit")
    ).select("row", "run", "hit.at", "hit.size", "hit.hash")
    # How many places hold each shingle. Rare ones come first; ties go by the hash.
    common = (
        hits.groupBy("size", "hash").agg(F.count(F.lit(1)).alias("places"))
        .join(shingles, ["size", "hash"])
    )
    prefix = (
        windows.select("window", "length", "size", "place", "hash").distinct()
        .join(common, ["size", "hash"], "left")
        .groupBy("window", "length")
        .agg(F.min(F.struct(
            F.coalesce("places", F.lit(0)).alias("places"), "hash", "size", "place"
        )).alias("rarest"))
        .filter("rarest.places > 0")
        .select("window", "length", "rarest.*")
    )
    keyed = written(
        prefix.groupBy("size", "hash")
        .agg(F.max("places").alias("places"),
             F.collect_list(F.struct("window", "length", "place")).alias("windows"))
        .select(F.struct("size", "hash").alias("token"), "places", "windows"),
        "prefixes",
    )
    total = hits.count()
    tokens = hits.select("row", "run", "at", F.struct("size", "hash").alias("token"))
    candidates = (
        heavy_split(tokens, keyed, "token", "places", total)
        .select("row", "run", "at", F.explode("windows").alias("w"))
        .select("row", "run", (F.col("at") - F.col("w.place")).alias("start"),
                "w.length", "w.window")
    )
    per_run = candidates.groupBy("row", "run").agg(
        F.collect_set(F.struct("start", "length", "window")).alias("candidates")
    )
    words = F.col("words")

    def occurs(c):
        at = c["start"] - F.col("first")
        inside = (at >= 0) & (at + c["length"] <= F.size(words))
        same = F.array_join(F.slice(words, F.greatest(at, F.lit(0)) + 1, c["length"]), " ")
        return inside & (same == c["window"])

    verified = written(
        runs.select("row", "run", "found.first", "found.words")
        .join(per_run, ["row", "run"])
        .select("row", F.explode(F.filter("candidates", occurs)).alias("c"))
        .select("row", "c.*").distinct(),
        "occurrences",
    )
    covered = (
        verified.groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"))
        .select("row", _covered(F.col("spans")).alias("n_hit"))
    )
    owners = (
        windows.filter("item_id IS NOT NULL").select("window", "length", "item_id").distinct()
    )
    named = (
        verified.select("row", "window", "length").distinct()
        .join(owners, ["window", "length"])
        .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    none = F.array().cast("array<string>")
    return (
        numbered.select("row", "document", "n_words")
        .join(covered, "row", "left").join(named, "row", "left")
        .select(
            *[F.col("document").getField(c).alias(c) for c in kept],
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", none).alias("items"),
        )
    )


def _covered(spans):
    """Words inside any of the sorted (start, length) spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("words"))

    def add(sofar, span):
        end = F.greatest(sofar["end"], span["start"] + span["length"])
        new = end - F.greatest(sofar["end"], span["start"])
        return F.struct(end.alias("end"), (sofar["words"] + new).alias("words"))

    return F.aggregate(spans, start, add)["words"]


def is_contaminated(hit, words):
    """At least a twentieth of the words, and at least one, are hit."""
    return (hit > 0) & (20 * hit >= words)


def op7_prefix_filtered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all documents."""
    found = contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )

"""Removal of passages that repeat across documents.

A text is cut into lines and these after sentences. From each line on, the shortest run
of lines with enough words is looked up among the runs of all documents, and so is the
shortest one that ends with it. Every longer run is made up of such runs, so a repeated
passage is found whole, whatever stands around it. The first document keeps the passage,
all others lose it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.llm.common import (
    bit_filter, column, filtered, forget, heavy_split, schema, table, written,
)

#: A passage of fewer words stays.
LEAST_WORDS = 20

_LINE = re.compile(r"[^\n]+")
_SENTENCE_END = re.compile(r"[.!?](?=\s)")
_TRIMMED = re.compile(r"\S(?:.*\S)?", re.S)


def lines_of(text: str) -> list[tuple[int, int]]:
    """Spans of the lines and sentences of a text, without the white space around them."""
    out = []
    for line in _LINE.finditer(text):
        start, end = line.span()
        for stop in [*(m.end() for m in _SENTENCE_END.finditer(text, start, end)), end]:
            trimmed = _TRIMMED.search(text, start, stop)
            if trimmed:
                out.append(trimmed.span())
            start = stop
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _digests(text: str, spans: list[tuple[int, int]]) -> bytes:
    """The digests of all lines, 16 bytes each."""
    return b"".join(_digest(text[a:b].encode("utf-8", "surrogatepass")) for a, b in spans)


def runs_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First lines, lines after the last, and digests of the runs of a text to look up.

    These are the shortest runs of at least ``LEAST_WORDS`` words from each line and up to
    each line. A line of any longer run lies in one of them that lies in that run.
    """
    spans = lines_of(text)
    n = len(spans)
    words = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(text[a:b].split()) for a, b in spans], out=words[1:])
    if words[-1] < LEAST_WORDS:
        return words[:0], words[:0], np.empty((0, 2), dtype=np.int64)
    stops = np.searchsorted(words, words[:-1] + LEAST_WORDS, "left")
    firsts = np.searchsorted(words, words[1:] - LEAST_WORDS, "right") - 1
    at = np.arange(n)
    ahead, behind = stops <= n, firsts >= 0
    runs = np.unique(np.concatenate([
        at[ahead] * (n + 1) + stops[ahead], firsts[behind] * (n + 1) + at[behind] + 1,
    ]))
    first, stop = runs // (n + 1), runs % (n + 1)
    lines = _digests(text, spans)
    found = b"".join(_run(lines, a, b) for a, b in zip(first.tolist(), stop.tolist()))
    return first, stop, np.frombuffer(found, dtype=np.int64).reshape(-1, 2)


def _run(lines: bytes, first: int, stop: int) -> bytes:
    """The digest of a run, given those of all lines."""
    own = lines[16 * first : 16 * stop]
    return own if stop == first + 1 else _digest(own)


def _found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        ids, found = [], []
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            found.append(runs_of(text or ""))
            ids.append(np.full(len(found[-1][0]), doc, dtype=np.int64))
        if found:
            first, stop, digests = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(ids)), pa.array(first.astype(np.int32)),
                 pa.array(stop.astype(np.int32)), pa.array(digests[:, 0].copy()),
                 pa.array(digests[:, 1].copy())],
                ["doc", "first", "stop", "low", "high"],
            )


def _without(text: str, wanted: list[dict]) -> str:
    """``text`` without the runs that an earlier document has."""
    spans = lines_of(text)
    lines = _digests(text, spans)
    gone = np.zeros(len(spans) + 1, dtype=bool)
    for w in wanted:
        a, b = w["first"], w["stop"]
        # A run may be from another row with the same id.
        if b <= len(spans):
            low, high = np.frombuffer(_run(lines, a, b), dtype=np.int64).tolist()
            if (low, high) == (w["low"], w["high"]):
                gone[a:b] = True
    out, at, i = [], 0, 0
    while i < len(spans):
        if not gone[i]:
            i += 1
            continue
        j = i
        while gone[j]:
            j += 1
        out.append(text[at : spans[i][0]])
        at = spans[j][0] if j < len(spans) else len(text)
        i = j
    if not out:
        return text
    out.append(text[at:])
    return "".join(out)


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_emptied: bool = False
) -> DataFrame:
    """``docs`` with texts that lack the passages of earlier documents.

    A passage is a run of lines or sentences that a document with a smaller id has as well,
    by digests of 128 bits, whatever stands before and after it; it goes if it has at least
    ``LEAST_WORDS`` words. What repeats only inside one document stays. Rows that share an
    id count as one document; a row without an id comes last. Rows, their number and all
    other columns stay as they are. Null and empty texts have no lines and stay. With
    ``drop_emptied`` a row goes if all its lines were in such passages.
    """
    last = F.lit((1 << 63) - 1)
    key = F.coalesce(column(docs, doc_id).cast("long"), last)
    texts = docs.select(key.alias("doc"), column(docs, text).alias("text"))
    runs = written(
        texts.mapInArrow(_found, "doc bigint, first int, stop int, low bigint, high bigint"), "runs"
    )
    repeated = written(
        runs.groupBy("low", "high")
        .agg(F.min("doc").alias("keeper"), F.max("doc").alias("latest"),
             F.count(F.lit(1)).alias("places"))
        .filter("keeper < latest").drop("latest"),
        "repeated-runs",
    )
    places = filtered(runs, "low", bit_filter(repeated, "low"))
    matches = written(
        heavy_split(places, repeated, ["low", "high"], "places", runs.count())
        .filter("doc > keeper")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("first", "stop", "low", "high")).alias("matches")),
        "matches",
    )
    forget(runs, repeated)
    rows = docs.select(
        key.alias("doc"), F.struct(*[column(docs, c) for c in docs.columns]).alias("row"),
        F.xxhash64(key).alias("h"),
    )
    mask = bit_filter(matches.select(F.xxhash64("doc").alias("h")), "h")
    touched = (
        filtered(rows, "h", mask).join(matches, "doc", "left")
        .select("row", F.col("row").getField(text).alias("text"), "matches")
    )

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = [
                t if t is None or not m else _without(t, m)
                for t, m in zip(part.column(1).to_pylist(), part.column(2).to_pylist())
            ]
            found = pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(out, pa.string())], ["row", "text"]
            )
            if drop_emptied:
                before = part.column(1).to_pylist()
                found = found.filter(pa.array(
                    [a == b or bool(a and a.strip()) for a, b in zip(out, before)], pa.bool_()
                ))
            yield found

    changed = touched.mapInArrow(cut, schema(row=rows.schema["row"].dataType, text="string"))
    same = filtered(rows, "h", mask, inside=False).select(
        "row", F.col("row").getField(text).alias("text")
    )
    return changed.unionByName(same).select(
        *[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c)
          for c in docs.columns]
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without passages that an earlier document has."""
    return dedup_lines(table(spark, sf_dir, "documents"))

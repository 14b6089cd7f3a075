"""Text quality by compression with dictionaries of good and bad text.

Two zstandard dictionaries are built from pieces of good and of bad labelled
texts. A text is compressed piece by piece with either; how much better the good
one does, as a share of both sizes, says which class it resembles. A logistic fit
on other labelled texts turns that difference into a probability. It also sees
how well the text compresses at all, since endless repetition compresses well
with any dictionary, and how long it is, since little text is little evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.llm.common import column, forget, schema, table, written

#: Labelled texts per class to learn from: half for dictionaries, half for the fit.
SAMPLE_PER_CLASS = 3000
#: Pieces that one text gives to a dictionary, evenly spread over it.
PIECES_PER_TEXT = 32
PIECE, DICTIONARY, LEVEL = 512, 32 << 10, 3
#: Bytes at which a text's difference counts by half.
HALF_TRUST = 200
THRESHOLD = 0.7


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, by which rows are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]  # the last is the constant


def _pieces(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def _spread(pieces: list[bytes], most: int) -> list[bytes]:
    if len(pieces) <= most:
        return pieces
    return [pieces[i * len(pieces) // most] for i in range(most)]


def _dictionary(pieces: list[bytes]) -> bytes:
    """Trained by zstandard; where it finds too little to train on, the text itself."""
    import zstandard

    if len(pieces) >= 100:
        try:
            return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(pieces)[-DICTIONARY:]


def _compressor(dictionary: bytes):
    import zstandard

    trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if trained:
        trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=trained, write_content_size=False, write_dict_id=False
    )


def _sizes(good: bytes, bad: bytes):
    """Text to (bytes with the good dictionary, with the bad one, bytes of the text)."""
    compressors = [_compressor(good), _compressor(bad)]

    def measure(text: str | None) -> tuple[int, int, int]:
        pieces = _pieces(text)
        a, b = (sum(len(c.compress(p)) for p in pieces) for c in compressors)
        return a, b, sum(map(len, pieces))

    return measure


def _features(sizes: np.ndarray) -> np.ndarray:
    good, bad, plain = sizes.astype(float).T
    trust = plain / (plain + HALF_TRUST)
    difference = (bad - good) / np.maximum(bad + good, 1)
    ratio = np.minimum(good, bad) / np.maximum(plain, 1)
    return np.c_[difference * trust, 1 - trust, ratio * trust, ratio * ratio * trust]


def _scores(model: Model, sizes: np.ndarray) -> np.ndarray:
    x = (_features(sizes) - model.mean) / model.scale
    line = x @ np.array(model.weights[:-1]) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(line, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small pull towards zero."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    pull = 1e-2 * np.eye(len(w))
    pull[-1, -1] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
        w = w - np.linalg.solve(curve + pull, x.T @ (weight * (p - y)) + pull @ w)
    return w


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    quality: str = "quality", per_class: int = SAMPLE_PER_CLASS,
) -> Model:
    """Learn from at most ``per_class`` labelled texts of each class.

    They are those whose hashed ids are least, so the sample is the same in every
    run. The driver receives at most ``PIECES_PER_TEXT`` pieces for each of them
    and three numbers for each of the rest. Labels other than 0 and 1 and labels
    without a text teach nothing. Without both classes the score is the share of
    good labels, 0.5 if there are none.
    """
    wanted = labels.select(
        column(labels, doc_id).alias("id"), column(labels, quality).cast("int").alias("quality")
    ).filter("id IS NOT NULL AND quality IN (0, 1)").distinct()
    there = {r["quality"]: r["count"] for r in wanted.groupBy("quality").count().collect()}
    chosen = None
    for value in (0, 1):
        ordered = wanted.filter(F.col("quality") == value).orderBy(F.xxhash64("id"), "id")
        part = ordered.limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most two times per_class rows.
    texts = docs.select(column(docs, doc_id).alias("id"), column(docs, text).alias("text"))
    sample = written(
        texts.filter("text IS NOT NULL").join(F.broadcast(chosen), "id")
        .groupBy("id", "quality").agg(F.min("text").alias("text"))
        .withColumn("for_fit", F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(2)) == 1),
        "labelled",
    )

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values, texts_ = part.column(0).to_pylist(), part.column(1).to_pylist()
            pieces = [_spread(_pieces(t), PIECES_PER_TEXT) for t in texts_]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, p in zip(values, pieces) for _ in p], pa.int32()),
                 pa.array([x for p in pieces for x in p], pa.binary())],
                ["quality", "piece"],
            )

    ground = (
        sample.filter("NOT for_fit").select("quality", "text")
        .mapInArrow(cut, "quality int, piece binary")
        .orderBy("quality", "piece").toArrow()
    )
    of = {
        v: [p for q, p in zip(ground["quality"].to_pylist(), ground["piece"].to_pylist()) if q == v]
        for v in (0, 1)
    }
    good, bad = _dictionary(of[1]), _dictionary(of[0])

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_of = _sizes(good, bad)
        for part in parts:
            found = np.array(
                [size_of(t) for t in part.column(1).to_pylist()], dtype=np.int64
            ).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c) for c in found.T)], ["quality", "a", "b", "n"]
            )

    measured = (
        sample.filter("for_fit").select("quality", "text")
        .mapInArrow(measure, "quality int, a bigint, b bigint, n bigint")
        .orderBy("quality", "a", "b", "n").toArrow()
    )
    forget(sample)
    y = measured["quality"].to_numpy().astype(float)
    width = _features(np.zeros((1, 3))).shape[1]
    if not (of[0] and of[1]) or len(set(y)) < 2:
        share = there.get(1, 0) / sum(there.values()) if there else 0.5
        constant = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Model(good, bad, [0.0] * width, [1.0] * width, [0.0] * width + [constant])
    x = _features(np.c_[tuple(measured[c].to_numpy() for c in "abn")])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    # Each class counts as often as it occurs among all labels.
    held = {v: (y == v).sum() for v in (0.0, 1.0)}
    weight = np.array([there[int(v)] / held[v] for v in y])
    weight *= len(y) / weight.sum()
    weights = _fit((x - mean) / scale, y, weight)
    return Model(good, bad, mean.tolist(), scale.tolist(), weights.tolist())


def with_score(
    docs: DataFrame, model: Model, text: str = "text", name: str = "score",
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the probability that a text is good, from the whole text.

    ``keep`` lists the columns to return, by default all. A null or empty text is
    scored as one without evidence. A column called ``name`` is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    source = docs.select(
        column(docs, text).alias("text"), F.struct(*[column(docs, c) for c in kept]).alias("row")
    )

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_of = _sizes(model.good, model.bad)
        for part in parts:
            sizes = [size_of(t) for t in part.column(0).to_pylist()]
            found = _scores(model, np.array(sizes, dtype=np.int64).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found)], ["row", "score"])

    scored = source.mapInArrow(score, schema(row=source.schema["row"].dataType, score="double"))
    return scored.select(
        *[F.col("row").getField(c).alias(c) for c in kept], F.col("score").alias(name)
    )


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Learn from the labelled rows that are not held out."""
    labels = table(spark, sf_dir, "labels")
    return train(docs, labels.filter(remainder(F.col("doc_id"), 4) != 2))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; a quarter of all ids is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs, learned(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )

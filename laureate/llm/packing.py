"""Batches of sequences of like length, with as little padding as can be.

A histogram of all sequence lengths is small, however large the corpus. Dynamic
programming over it finds the bucket boundaries with the least padding. Every
sequence then gets a place in its bucket, and consecutive places form batches
that fill a token budget.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laureate.llm.common import column, schema, table, written

#: Longest sequence, number of buckets and tokens of a batch, padding included.
LONGEST, BUCKETS, BUDGET = 2048, 16, 1 << 16

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets that minimise the total padding.

    ``lengths`` rise. A bucket pads its sequences to its longest one.
    """
    if not len(lengths):
        return []
    many = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(float)
    n = len(lengths)
    # best[j]: least padding of the first j lengths in the buckets used so far.
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (many[j] - many[:j]) - (tokens[j] - tokens[:j])
            cut[j] = int(cost.argmin())
            new[j] = cost[cut[j]]
        new[0] = 0
        best = new
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return ends[::-1]


def _pieces(text: str | None, longest: int) -> list[tuple[int, str]]:
    """(tokens, text) of the pieces of a text; its end counts as a token."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data.split())
    if n < longest:
        return [(n + 1, text or "")]
    starts = [m.start() for i, m in enumerate(_WORD.finditer(data)) if i % longest == 0 and i]
    cuts = [0, *starts, len(data)]
    out = [
        [longest, data[a:b].decode("utf-8", "surrogatepass")] for a, b in zip(cuts, cuts[1:])
    ]
    out[-1][0] = n - longest * (len(out) - 1)
    if out[-1][0] < longest:
        out[-1][0] += 1
    else:
        out.append([1, ""])
    return [tuple(x) for x in out]


def sequences(docs: DataFrame, text: str, longest: int) -> DataFrame:
    """One row per piece of at most ``longest`` tokens: doc, piece, n_tokens, part."""
    kept = [c for c in docs.columns if c != text]
    source = docs.select(
        column(docs, text).alias("text"),
        F.struct(*[column(docs, c) for c in kept]).alias("doc"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_pieces(t, longest) for t in batch.column(0).to_pylist()]
            take = pa.array([i for i, p in enumerate(found) for _ in p], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(take),
                 pa.array([i for p in found for i in range(len(p))], pa.int32()),
                 pa.array([n for p in found for n, _ in p], pa.int32()),
                 pa.array([t for p in found for _, t in p], pa.string())],
                ["doc", "piece", "n_tokens", "part"],
            )

    return source.mapInArrow(
        cut, schema(doc=source.schema["doc"].dataType, piece="int", n_tokens="int", part="string")
    )


def pack(
    docs: DataFrame, text: str = "text", order: str = "doc_id", longest: int = LONGEST,
    buckets: int = BUCKETS, budget: int = BUDGET,
) -> DataFrame:
    """The sequences of ``docs`` with bucket, batch and place in the batch.

    Tokens are words (runs without ASCII white space) and one end per text. Texts of
    more than ``longest`` tokens become several sequences, numbered by ``piece``; a
    null or empty text is one sequence of its end alone. ``bucket_tokens`` is the length
    a sequence is padded to, ``padding`` what that adds. Batches are numbered from 0
    in each bucket, ``place`` from 0 in each batch; only the last batch of a bucket may
    hold less than fits ``budget``. The columns of ``docs`` stay, the text being that of
    the sequence; columns named like the added ones are replaced.
    """
    spark = docs.sparkSession
    added = ("piece", "n_tokens", "bucket", "bucket_tokens", "padding", "batch", "place")
    docs = docs.select(*[column(docs, c) for c in docs.columns if c not in added])
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = sequences(docs, text, longest).withColumn(
        "slice",
        F.pmod(F.xxhash64("piece", "part", F.col("doc").getField(order)), F.lit(slices)).cast("int"),
    )
    # At most ``longest`` lengths, and as many slices as shuffle partitions.
    lengths = written(
        cut.groupBy("n_tokens", "slice").agg(F.count(F.lit(1)).alias("n")), "lengths"
    )
    histogram = lengths.groupBy("n_tokens").agg(F.sum("n")).orderBy("n_tokens").collect()
    ends = boundaries(
        np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), buckets
    )
    upper = np.array(ends or [1])
    of_length = np.searchsorted(upper, np.arange(longest + 1)).clip(max=len(upper) - 1)
    bucket = F.get(F.array(*[F.lit(int(b)) for b in of_length]), F.col("n_tokens"))
    # No more rows than buckets times slices.
    first = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        lengths.withColumn("bucket", bucket)
        .groupBy("bucket", "slice").agg(F.sum("n").alias("n"))
        .select("bucket", "slice", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("offset"))
    )
    sorted_ = Window.partitionBy("bucket", "slice").orderBy(
        F.col("doc").getField(order), "piece", F.xxhash64("part")
    )
    ranked = (
        cut.withColumn("bucket", bucket)
        .withColumn("rank", F.row_number().over(sorted_) - 1)
        .join(F.broadcast(offsets), ["bucket", "slice"])
        .withColumn("rank", F.col("rank") + F.col("offset"))
        .withColumn("bucket_tokens", F.get(F.array(*[F.lit(int(e)) for e in upper]), "bucket"))
    )
    fits = F.greatest(F.expr(f"{budget} div bucket_tokens"), F.lit(1))
    return ranked.select(
        *[(F.col("part").alias(c) if c == text else F.col("doc").getField(c).alias(c))
          for c in docs.columns],
        "piece", "n_tokens", "bucket", "bucket_tokens",
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
        F.floor(F.col("rank") / fits).alias("batch"),
        (F.col("rank") % fits).cast("int").alias("place"),
    )


def op8_optimal_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return pack(table(spark, sf_dir, "documents"))

"""Exact inner-product search by block-at-a-time pruning.

Vectors are rounded to whole numbers and laid out in blocks of neighbouring rows.
Per block the largest and the least value of every dimension (term) are known; for
a query, the sum of the better of the two bounds every score in the block. Each
round scores the blocks with the highest open bounds through their forward indexes
(the block's matrix) and raises the query's kth score. Blocks whose bound cannot
beat it are never read. Rounds end when no block is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.llm.common import column, forget, row_numbers, table, written

#: Rows of a block, queries of a query block, and blocks of a bounds row.
BLOCK, QUERIES, CHUNK = 512, 256, 256
#: Blocks that a query reads in the first round of each chunk, and their growth by round.
FIRST, GROWTH = 4, 8


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _valid(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, vector of whole numbers) of the rows that take part."""
    finite = F.forall(
        column(df, vector),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))),
    )
    return (
        df.filter(column(df, vec_id).isNotNull() & column(df, vector).isNotNull() & finite)
        .select(column(df, vec_id).cast("long").alias("id"),
                whole_numbers(column(df, vector), scale).alias("v"))
    )


_BLOCKS = "block bigint, ids binary, matrix binary, highs binary, lows binary, least bigint"


def _blocks(rows: DataFrame, size: int, width: int, kind: str, parts: int) -> DataFrame:
    """``size`` neighbouring rows in each block.

    Rows whose largest and least components are in the same places are neighbours,
    which keeps the ranges within a block narrow. Ids split large groups of equal vectors.
    """
    place = [F.array_position("v", f("v")) for f in (F.array_max, F.array_min)]
    ordered = rows.select("id", "v", place[0].alias("top"), place[1].alias("bottom"))
    key = ["top", "bottom", "id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ids, vectors = row_numbers(), [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(ids) >= size:
                yield block(next(numbers), ids[:size], vectors[:size])
                ids, vectors = ids[size:], vectors[size:]
        if ids:
            yield block(next(numbers), ids, vectors)

    def block(number: int, ids: list[int], vectors: list[list[int]]) -> pa.RecordBatch:
        matrix = np.zeros((len(ids), width), dtype=kind)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        columns = [
            pa.array([number], pa.int64()),
            *(pa.array([x.tobytes()], pa.binary())
              for x in (np.array(ids, dtype="<i8"), matrix, matrix.max(0), matrix.min(0))),
            pa.array([min(ids)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "matrix", "highs", "lows", "least"])

    return (
        ordered.repartitionByRange(parts, *key).sortWithinPartitions(*key)
        .select("id", "v").mapInArrow(cut, _BLOCKS)
    )


def _matrix(data: bytes, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(-1, width)


def _product(a: np.ndarray, b: np.ndarray, exact_as_double: bool) -> np.ndarray:
    """a times b transposed, exact: in doubles where no sum can pass 2^53."""
    kind = np.float64 if exact_as_double else np.int64
    out = a.astype(kind) @ b.astype(kind).T
    return out.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def top_k(
    df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id",
    vector: str = "embedding", scale: int = 64, block: int = BLOCK,
) -> DataFrame:
    """The ``k`` highest scores of every query row against all rows with another id.

    Components x become floor(scale * x); the score is the inner product. Ties go to
    the smaller id. Returns query_id, rank (from 1), vec_id and score. Rows without an
    id or vector, or with a null or non-finite component, take no part. Shorter
    vectors are filled up with zeros. Rows that repeat an id each count, and a query that
    is repeated has its results repeated; none of them meets its own id.
    Scores beyond 64 bits are not defined. An empty table gives an empty result.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _valid(df, vec_id, vector, scale)
    width, largest = rows.agg(
        F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))
    ).first()
    width, largest = max(width or 0, 1), largest or 0
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    as_double = float(largest) ** 2 * max(width, 1) < 2.0**53
    blocks = written(_blocks(rows, block, width, kind, parts), "blocks")
    asked = _valid(df.filter(is_query), vec_id, vector, scale)
    queries = written(
        _blocks(asked, QUERIES, width, kind, max(1, parts // 4))
        .select(F.col("block").alias("queries"), F.col("ids").alias("query_ids"),
                F.col("matrix").alias("asked")),
        "queries",
    )
    bounds = written(_bounds(spark, blocks, queries, width, kind, as_double), "bounds")
    state, depth, done = None, FIRST, None
    while True:
        pairs = written(_open_pairs(bounds, state, done, depth, k), "pairs")
        if pairs.isEmpty():
            forget(pairs)
            break
        found = _scored(pairs, blocks, queries, state, width, kind, as_double, k)
        # A group is one block of queries and one candidate list for each pair it has.
        both = found if state is None else found.unionByName(state.select(*found.columns))
        new = written(_merged(both, k), "best")
        done = pairs if done is None else written(done.unionByName(pairs), "done")
        if state is not None:
            forget(state)
        state, depth = new, depth * GROWTH
    if state is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return _unpacked(state, queries)


def _bounds(spark, blocks, queries, width: int, kind: str, as_double: bool) -> DataFrame:
    """For each block of queries and each chunk of blocks: the bound of every pair."""
    ids = [r[0] for r in blocks.agg(F.count(F.lit(1))).collect()]
    chunks = max(1, -(-ids[0] // CHUNK))
    summary = (
        blocks.select(F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk"),
                      F.struct("block", "highs", "lows", "least").alias("one"))
        .groupBy("chunk").agg(F.array_sort(F.collect_list("one")).alias("blocks"))
    )
    asked = queries.select(
        "queries", "asked",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"),
    )

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = _matrix(batch.column(1)[i].as_py(), width, kind).astype(np.int64)
                chunk = batch.column(2)[i].as_py()
                highs = np.concatenate([_matrix(b["highs"], width, kind) for b in chunk])
                lows = np.concatenate([_matrix(b["lows"], width, kind) for b in chunk])
                top = _product(np.maximum(q, 0), highs, as_double)
                top += _product(np.minimum(q, 0), lows, as_double)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([top.astype("<i8").tobytes()]),
                     pa.array([[b["block"] for b in chunk]], pa.list_(pa.int64())),
                     pa.array([[b["least"] for b in chunk]], pa.list_(pa.int64()))],
                    ["queries", "tops", "blocks", "leasts"],
                )

    return asked.join(summary, "chunk").select("queries", "asked", "blocks").mapInArrow(
        bound, "queries bigint, tops binary, blocks array<bigint>, leasts array<bigint>"
    )


def _open_pairs(bounds, state, done, depth: int, k: int) -> DataFrame:
    """Pairs of blocks to score next: for each query the best ``depth`` of a chunk
    that are not scored yet and whose bound can still change its result."""
    rows = bounds
    if state is not None:
        before = done.groupBy("queries").agg(F.collect_list("block").alias("seen"))
        rows = bounds.join(before, "queries", "left").join(
            state.select("queries", "kth", "kth_id"), "queries"
        )
    else:
        rows = bounds.select(
            "*", *[F.lit(None).cast(t).alias(c)
                   for c, t in (("seen", "array<bigint>"), ("kth", "binary"), ("kth_id", "binary"))]
        )

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                blocks = np.array(row["blocks"], dtype=np.int64)
                tops = np.frombuffer(row["tops"], dtype="<i8").reshape(-1, len(blocks))
                live = np.ones(tops.shape, dtype=bool)
                if row["kth"] is not None:
                    kth = np.frombuffer(row["kth"], dtype="<i8")[: len(tops), None]
                    kth_id = np.frombuffer(row["kth_id"], dtype="<i8")[: len(tops), None]
                    least = np.array(row["leasts"], dtype=np.int64)[None, :]
                    live = (tops > kth) | ((tops == kth) & (least < kth_id))
                if row["seen"]:
                    live &= ~np.isin(blocks, row["seen"])[None, :]
                if live.shape[1] > depth:
                    ranked = np.where(live, tops, np.iinfo(np.int64).min)
                    cut = np.partition(ranked, -depth, axis=1)[:, -depth][:, None]
                    live &= ranked >= cut
                chosen = blocks[live.any(0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["queries"]] * len(chosen), pa.int64()), pa.array(chosen)],
                    ["queries", "block"],
                )

    return rows.select("queries", "tops", "blocks", "leasts", "seen", "kth", "kth_id").mapInArrow(
        choose, "queries bigint, block bigint"
    )


_FOUND = "queries bigint, which binary, ids binary, scores binary"


def _scored(pairs, blocks, queries, state, width, kind, as_double, k) -> DataFrame:
    """The best k of each query of a pair, packed: query numbers, ids and scores."""
    joined = pairs.join(queries, "queries").join(
        blocks.select("block", "ids", "matrix"), "block"
    )
    if state is None:
        joined = joined.withColumn("kth", F.lit(None).cast("binary"))
    else:
        joined = joined.join(state.select("queries", "kth"), "queries")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, own, q, ids, m, kth = (c[i].as_py() for c in batch.columns)
                own, ids = np.frombuffer(own, dtype="<i8"), np.frombuffer(ids, dtype="<i8")
                scores = _product(_matrix(q, width, kind), _matrix(m, width, kind), as_double)
                floor = np.frombuffer(kth, dtype="<i8") if kth is not None else None
                which, found, values = [], [], []
                for j, row in enumerate(scores):
                    open_ = ids != own[j]
                    if floor is not None:
                        open_ &= row >= floor[j]
                    at = np.flatnonzero(open_)
                    at = at[_best(row[at], ids[at], k)]
                    which.append(np.full(len(at), j))
                    found.append(ids[at])
                    values.append(row[at])
                packed = [np.concatenate(x).astype("<i8").tobytes() for x in (which, found, values)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), *(pa.array([x], pa.binary()) for x in packed)],
                    ["queries", "which", "ids", "scores"],
                )

    return joined.select("queries", "query_ids", "asked", "ids", "matrix", "kth").mapInArrow(
        score, _FOUND
    )


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of every query over all its pairs, and its kth score and id.

    A query with fewer than k results has an open floor.
    """

    def best(group: pa.Table) -> pa.Table:
        which, ids, scores = (
            np.concatenate([np.frombuffer(x.as_py(), dtype="<i8") for x in group[c]])
            for c in ("which", "ids", "scores")
        )
        order = np.lexsort((ids, -scores, which))
        which, ids, scores = which[order], ids[order], scores[order]
        first = np.searchsorted(which, which, side="left")
        keep = np.arange(len(which)) - first < k
        which, ids, scores = which[keep], ids[keep], scores[keep]
        kth = np.full(QUERIES, np.iinfo(np.int64).min)
        kth_id = np.full(QUERIES, np.iinfo(np.int64).max)
        last = np.flatnonzero(np.arange(len(which)) - np.searchsorted(which, which) == k - 1)
        kth[which[last]], kth_id[which[last]] = scores[last], ids[last]
        return pa.table({
            "queries": group["queries"].slice(0, 1),
            **{n: pa.array([x.astype("<i8").tobytes()], pa.binary())
               for n, x in (("which", which), ("ids", ids), ("scores", scores),
                            ("kth", kth), ("kth_id", kth_id))},
        })

    return found.groupBy("queries").applyInArrow(best, f"{_FOUND}, kth binary, kth_id binary")


def _unpacked(state: DataFrame, queries: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, which, ids, scores = (
                    np.frombuffer(c[i].as_py(), dtype="<i8") for c in batch.columns
                )
                rank = np.arange(len(which)) - np.searchsorted(which, which) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[which]), pa.array(rank.astype(np.int32)),
                     pa.array(ids), pa.array(scores)],
                    ["query_id", "rank", "vec_id", "score"],
                )

    return (
        state.join(queries.select("queries", "query_ids"), "queries")
        .select("query_ids", "which", "ids", "scores")
        .mapInArrow(rows, "query_id bigint, rank int, vec_id bigint, score bigint")
    )


def op5_block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for each twentieth embedding."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

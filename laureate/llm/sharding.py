"""Balanced shards by histogram sort, in DataFrame operations only.

Rows are ordered by a key. Splitters between shards are found without sorting:
each round counts the exact bytes and rows below candidate boundaries (probes)
in one partial aggregation, keeps for every splitter the bin that its target
falls into, and probes that bin more finely. Once every splitter meets its
tolerance, or a bin cannot be divided, the rows move once.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laureate.llm.common import column, forget, table, written

_LOW = -(1 << 63)
#: Probes of the first round, and of each open bin in later rounds, as bits.
FIRST_BITS, NEXT_BITS = 12, 6


def _unsigned(value: int) -> int:
    return value - _LOW


def _digits(key: str, shift: int) -> Column:
    """The leading bits of a signed 64-bit key, as a number that sorts alike."""
    lifted = F.col(key).bitwiseXOR(F.lit(_LOW))
    return F.shiftrightunsigned(lifted, shift) if shift else lifted


class _Splitter:
    """Searches the boundary whose bytes below come nearest to ``target``."""

    def __init__(self, target: float, tolerance: float):
        self.target, self.tolerance = target, tolerance
        self.prefix: tuple = ()  # the open bin: key values, then leading digits
        self.best = None  # (error, bytes below, rows below, boundary)

    def offer(self, bytes_below: int, rows_below: int, boundary: tuple) -> None:
        found = (abs(bytes_below - self.target), bytes_below, rows_below, boundary)
        if self.best is None or found[:3] < self.best[:3]:
            self.best = found

    def done(self) -> bool:
        return self.best is not None and self.best[0] <= self.tolerance


def _levels(low_high: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(key number, bits to drop) of each round, from the ranges of the keys."""
    out = []
    for i, (low, high) in enumerate(low_high):
        bits = (_unsigned(low) ^ _unsigned(high)).bit_length()
        shift = max(0, bits - (FIRST_BITS if not out else NEXT_BITS))
        out.append((i, shift))
        while shift:
            shift = max(0, shift - NEXT_BITS)
            out.append((i, shift))
    return out


def _boundary(level: tuple[int, int], prefix: tuple, digit: int, keys: int) -> tuple:
    """The least key whose leading digits are ``digit``."""
    key, shift = level
    value = ((digit & ((1 << (64 - shift)) - 1)) << shift) + _LOW
    return (*prefix, value, *([_LOW] * (keys - key - 1)))


def splitters(narrow: DataFrame, keys: list[str], shards: int, parts: int, tolerance: float):
    """Boundaries of ``shards`` times ``parts`` pieces, with exact counts below each.

    Between shards the bytes below must lie within ``tolerance`` of a shard's
    share; inside a shard, within a tenth of a piece. The driver holds at most
    2^FIRST_BITS counts in the first round and 2^NEXT_BITS per splitter later.
    """
    ends = narrow.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)),
        *[f(k) for k in keys for f in (F.min, F.max)],
    ).first()
    rows, total, ranges = ends[0], ends[1], list(zip(ends[2::2], ends[3::2]))
    if not rows:
        return 0, 0, []
    share, pieces = total / shards, shards * parts
    wanted = [
        _Splitter(
            total * i / pieces, share * tolerance if i % parts == 0 else share / parts / 10
        )
        for i in range(1, pieces)
    ]
    for w in wanted:
        w.offer(0, 0, tuple([_LOW] * len(keys)))
    #: Bytes and rows below the first key of each open bin.
    below = {(): (0, 0)}
    for level in _levels(ranges):
        key, shift = level
        open_bins = {w.prefix for w in wanted if not w.done()}
        if not open_bins:
            break
        counts = _count(narrow, keys, level, open_bins)
        groups: dict[tuple, list] = {}
        for prefix, digit, size, n in counts:
            groups.setdefault(prefix, []).append((_order(digit, shift), digit, size, n))
        nested = {}
        for prefix in open_bins:
            bins = sorted(groups.get(prefix, []))
            start_bytes, start_rows = below[prefix]
            marks, at_bytes, at_rows = [], start_bytes, start_rows
            for _, digit, size, n in bins:
                marks.append((at_bytes, at_rows, digit))
                at_bytes, at_rows = at_bytes + size, at_rows + n
            starts = [m[0] for m in marks]
            for w in (w for w in wanted if w.prefix == prefix and not w.done()):
                at = max(0, bisect_right(starts, w.target) - 1)
                for b, r, digit in marks[at : at + 2]:
                    w.offer(b, r, _boundary(level, prefix[:key], digit, len(keys)))
                b, r, digit = marks[at]
                exact = prefix[:key] + (_boundary(level, (), digit, key + 1)[0],)
                w.prefix = exact if shift == 0 else prefix[:key] + ((digit, shift),)
                nested[w.prefix] = (b, r)
        below = nested
    return rows, total, [w.best[1:] for w in wanted]


def _order(digit: int, shift: int) -> int:
    return digit & ((1 << (64 - shift)) - 1)


def _count(narrow: DataFrame, keys: list[str], level: tuple[int, int], open_bins: set):
    """Bytes and rows of every sub-bin of the open bins."""
    key, shift = level
    spark, digit = narrow.sparkSession, _digits(keys[key], shift)
    if open_bins == {()}:
        found = narrow.groupBy(digit.alias("digit")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
        )
        return [((), r["digit"], r["size"], r["n"]) for r in found.collect()]
    listed = sorted(open_bins, key=str)
    partial = isinstance(listed[0][-1], tuple)
    values = [(i, *(p[-1][0] if isinstance(v, tuple) else v for v in p)) for i, p in enumerate(listed)]
    names = [f"bin_{j}" for j in range(len(listed[0]))]
    bins = spark.createDataFrame(values, ", ".join(f"{c} long" for c in ["bin", *names]))
    parts = [
        (_digits(keys[j], listed[0][-1][1]) if partial and j == len(names) - 1 else F.col(keys[j]))
        == F.col(c)
        for j, c in enumerate(names)
    ]
    # One row per open bin: at most one for each splitter.
    inside = narrow.join(F.broadcast(bins), reduce(lambda a, b: a & b, parts))
    found = inside.groupBy("bin", digit.alias("digit")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    return [(listed[r["bin"]], r["digit"], r["size"], r["n"]) for r in found.collect()]


def histogram_sort(
    df: DataFrame, keys: list[Column], size: Column, shards: int,
    tolerance: float = 0.001, parts: int | None = None,
) -> DataFrame:
    """``df`` with columns ``shard`` and ``slot``, shards holding near equal sizes.

    ``keys`` are 64-bit integers that order the rows; together they should
    tell rows apart, since equal ones stay in one shard. A null key sorts first.
    ``slot`` numbers a shard's rows from 0 in key order, without gaps. Each
    shard is exchanged in ``parts`` pieces, by default as many as make all
    shards fill the shuffle partitions, so that no task sorts a whole shard.

    A shard ends at the row boundary nearest to its target, so sizes differ from
    equal by at most the tolerance or a row. With fewer rows than
    shards some shards stay empty. An empty table gives an empty result.
    Columns of ``df`` keep their names, but for ``shard`` and ``slot``.
    """
    spark = df.sparkSession
    if parts is None:
        parts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    names = [f"key_{i}" for i in range(len(keys))]
    lowest = [F.coalesce(k.cast("long"), F.lit(_LOW)).alias(c) for k, c in zip(keys, names)]
    narrow = written(df.select(*lowest, size.cast("long").alias("size")), "sort-keys")
    rows, _, found = splitters(narrow, names, shards, parts, tolerance)
    forget(narrow)
    # Pieces of the sorted order; of those with the same boundary all but the last are empty.
    starts = [(0, 0, tuple([_LOW] * len(keys)))]
    for found_one in found:
        starts.append(max(starts[-1], found_one, key=lambda s: s[2]))
    pieces = spark.createDataFrame(
        [
            (i, i // parts, below - starts[i // parts * parts][1])
            for i, (_, below, _) in enumerate(starts)
        ],
        "piece int, shard int, first_slot long",
    )
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    placed = df.select(
        F.struct(*[column(df, c) for c in kept]).alias("row"), *lowest
    ).withColumn("piece", _piece([s[2] for s in starts], names))
    order = Window.partitionBy("piece").orderBy(*names)
    numbered = placed.withColumn("place", F.row_number().over(order) - 1)
    # One row per piece.
    out = numbered.join(F.broadcast(pieces), "piece")
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        "shard",
        (F.col("first_slot") + F.col("place")).alias("slot"),
    )


def _piece(bounds: list[tuple], names: list[str]) -> Column:
    """The last piece whose first key is not above the row's, by binary search."""
    columns = [F.array(*[F.lit(b[i]) for b in bounds]) for i in range(len(names))]
    steps = [1 << i for i in reversed(range((len(bounds) - 1).bit_length()))]
    if not steps:
        return F.lit(0)

    def reached(at: Column) -> Column:
        out = F.lit(True)
        for name, values in reversed(list(zip(names, columns))):
            bound = F.get(values, at)
            out = (F.col(name) > bound) | ((F.col(name) == bound) & out)
        return out

    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step < len(bounds)) & reached(at + step), at + step
        ).otherwise(at),
    )


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, ordered by ``doc_id``.

    Rows that share a ``doc_id`` are told apart by their place in the input files.
    """
    shards = 40
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "text",
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line"),
    )
    keys = [F.col("doc_id"), F.col("file"), F.col("line")]
    sharded = histogram_sort(documents, keys, size, shards)
    return sharded.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

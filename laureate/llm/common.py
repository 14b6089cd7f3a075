"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of ASCII white space, the only separators of a word.
BLANKS = b" \t\n\x0b\x0c\r"


#: Python workers receive rows in batches of about so many bytes.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once by bytes, since texts differ in length.

    This sets ``spark.sql.execution.arrow.maxBytesPerBatch`` for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    A local session without one gets a temporary folder; any other master has
    to name a folder that all its machines share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm/{label}-{uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, and row numbers
    given before the write stay what they are.
    """
    small_batches(df.sparkSession)
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._written_to = path
    return again


def forget(*tables: DataFrame) -> None:
    """Remove the files of tables from ``written`` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def column(df: DataFrame, name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def schema(**fields: str | T.DataType) -> T.StructType:
    """A schema by column names; types as objects or as SQL."""
    out = T.StructType()
    for name, kind in fields.items():
        out.add(name, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind)
    return out


def row_numbers() -> Iterator[int]:
    """Numbers that no other task gives. Stable once the rows are written."""
    first = TaskContext.get().partitionId() << 33
    while True:
        yield first
        first += 1


def heavy_split(
    left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int
):
    """Inner join of ``left`` with ``right``, which has one row per key.

    ``weight`` says how many rows of ``left`` have the key. Keys above a fair
    share of a shuffle partition are joined by broadcast: there are fewer of
    them than partitions, whatever the data. Rows of all other keys are joined
    by a shuffle, in which no key can fill more than its partition.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    is_heavy = F.col(weight) * F.lit(parts) > F.lit(total)
    heavy, light = right.filter(is_heavy), right.filter(~is_heavy)
    by_broadcast = left.join(F.broadcast(heavy), key)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return by_broadcast.unionByName(rest.join(light, key))


def bit_filter(hashes: DataFrame, column_name: str, bits: int = 1 << 22) -> np.ndarray:
    """A Bloom filter with one hash, of a fixed size whatever the input.

    ``column_name`` holds 64-bit hashes. The result has ``bits`` bits and only
    spares work: what passes it still goes through an exact join.
    """
    place = F.pmod(F.col(column_name), F.lit(bits))
    words = (
        hashes.select(place.alias("place"))
        .groupBy(F.expr("place div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("mask"))
        .toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def in_filter(mask: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For 64-bit unsigned hashes: which may be in the filter."""
    place = hashes & np.uint64(len(mask) * 64 - 1)
    return (mask[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers for the words of a shingle by their place.
_STEP = 0x9E3779B97F4A7C15


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, given the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(_STEP) + words[i : i + n]
    return mixed(out)


#: A random number for each byte value.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.cumprod(np.full(64, _BASE))
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS, dtype=np.uint8))

#: Lower-cases A-Z; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_bytes(text: str | None, changed: bytes) -> bytes:
    """The bytes of a text, each replaced by its entry in ``changed``."""
    return (text or "").encode("utf-8", "surrogatepass").translate(changed)


class Words:
    """All words of some texts at once, as 64-bit hashes.

    ``hashes`` and ``starts`` (places in ``data``) run over the words of all texts;
    those of text i are ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, texts: list[bytes]):
        self.data = data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        inside = ~_IS_BLANK[data]
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.first = np.concatenate([[0], np.searchsorted(self.starts, ends)])
        length = self.ends - self.starts
        if not len(length):
            self.hashes = np.empty(0, dtype=np.uint64)
            return
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        most = int(length.max())
        powers = _POWERS if most <= len(_POWERS) else np.cumprod(np.full(most, _BASE))
        parts = _BYTE[data[inside]] * powers[place]
        self.hashes = mixed(np.add.reduceat(parts, begin) + length.astype(np.uint64))

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    def text(self, i: int, a: int, b: int) -> list[str]:
        """Words a to b of text i."""
        at = self.first[i]
        return [
            self.data[x:y].tobytes().decode("utf-8", "surrogatepass")
            for x, y in zip(self.starts[at + a : at + b], self.ends[at + a : at + b])
        ]


def grouped(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in groups of about ``most`` bytes, to be taken apart together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def batches(rows: Iterator[tuple], kinds: pa.Schema, size: int = 2000):
    """Arrow batches of ``size`` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, kinds)
            held = []
    if held:
        yield _batch(held, kinds)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, schema=kinds)


def filtered(df: DataFrame, hash_column: str, mask: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows whose hash may be in the filter, or (``inside=False``) is surely not."""
    at = df.columns.index(hash_column)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashes = part.column(at).to_numpy(zero_copy_only=False).view(np.uint64)
            yield part.filter(pa.array(in_filter(mask, hashes) == inside))

    return df.mapInArrow(run, df.schema)

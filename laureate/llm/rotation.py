"""Fill-in-the-middle by rotating blocks of a text in place.

A text is cut twice between units. Sentinels are put at the cuts of a bytearray;
two neighbouring segments then change places by three reversals, which need no
second copy of the text. The same rotation with the lengths swapped undoes it, so
the text comes back exactly from the output and its form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.llm.common import BLANKS, column, schema, table

# --- fixed values: sentinels, seed and shares of the forms, in percent ---
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "42:"
TRANSFORMED, SPM = 50, 80

#: Reversals exchange blocks of so many bytes, which bounds what they copy.
_BLOCK = 1 << 16
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS, dtype=np.uint8))


def unit_ends(text: np.ndarray) -> np.ndarray:
    """Where the units of a text end: a word with the blanks before it, or last blanks."""
    if not len(text):
        return np.empty(0, dtype=np.int64)
    blank = _IS_BLANK[text]
    last_of_word = ~blank
    last_of_word[:-1] &= blank[1:]
    ends = np.flatnonzero(last_of_word) + 1
    return np.append(ends, len(text)) if blank[-1] else ends


def reverse(data: np.ndarray, a: int, b: int) -> None:
    """Reverse ``data[a:b]`` in place, block by block from both ends."""
    while b - a > 1:
        n = min(_BLOCK, (b - a) // 2)
        low = data[a : a + n].copy()
        data[a : a + n] = data[b - n : b][::-1]
        data[b - n : b] = low[::-1]
        a, b = a + n, b - n


def rotate(data: np.ndarray, a: int, cut: int, b: int) -> None:
    """Exchange the segments ``a:cut`` and ``cut:b`` by three reversals."""
    reverse(data, a, cut)
    reverse(data, cut, b)
    reverse(data, a, b)


def transformed(text: bytes, cuts: tuple[int, int], form: str) -> bytearray:
    """The text cut at two places, in the order of ``form`` (psm or spm)."""
    first, second = cuts
    out = bytearray(text)
    # Prefix, middle, suffix: sentinels go in from the back, so the cuts stay valid.
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    data = np.frombuffer(out, dtype=np.uint8)
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    # psm exchanges middle and suffix; spm moves the suffix before both others.
    rotate(data, middle if form == "psm" else 0, suffix, len(data))
    return out


def restored(output: bytes, form: str) -> bytes:
    """The text that ``transformed`` made ``output`` from."""
    if form == "plain":
        return bytes(output)
    out = bytearray(output)
    data = np.frombuffer(out, dtype=np.uint8)
    # Sentinels neither occur in the text nor overlap what stands beside them.
    if form == "psm":
        a, cut = out.index(SUFFIX), out.index(MIDDLE)
    else:
        a, cut = 0, out.index(PREFIX)
    rotate(data, a, cut, len(data))
    del data
    middle, suffix = out.index(MIDDLE), out.index(SUFFIX)
    del out[suffix : suffix + len(SUFFIX)]
    del out[middle : middle + len(MIDDLE)]
    del out[: len(PREFIX)]
    return bytes(out)


def _points(data: np.ndarray) -> int:
    """Code points of UTF-8."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _one(text: bytes, keys: list[int]) -> tuple:
    data = np.frombuffer(text, dtype=np.uint8)
    ends = unit_ends(data)
    n = len(ends)
    marked = any(s in text for s in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or keys[2] % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    form = "spm" if keys[3] % 100 < SPM else "psm"
    units = sorted(k % (n + 1) for k in keys[:2])
    cuts = tuple(int(ends[u - 1]) if u else 0 for u in units)
    a, b = cuts
    return n, form, _points(data[:a]), _points(data[a:b]), bytes(transformed(text, cuts, form))


def _keys(key: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(
        *[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    )


ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the number of units, form, lengths of the parts and ``output``.

    Cuts and form depend on the key alone, so equal rows give equal outputs wherever
    they run; a null key counts as empty. A null or empty text, or one that holds a
    sentinel, stays plain: its output is the text (null: empty). Texts are taken as
    bytes, whole, one at a time. Other columns stay; ones named like the added columns
    are replaced. No rows give no rows.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    source = docs.select(
        F.coalesce(column(docs, text).cast("binary"), F.lit(b"")).alias("text"),
        _keys(column(docs, key)).alias("keys"),
        F.struct(*[column(docs, c) for c in kept]).alias("doc"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time: the outputs of a batch are as large as its texts.
            keys = batch.column(1).to_pylist()
            out = [_one(t.as_py(), k) for t, k in zip(batch.column(0), keys)]
            n, form, before, inside, output = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(before, pa.int64()), pa.array(inside, pa.int64()),
                 pa.array(output, pa.binary())],
                ["doc", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    done = source.mapInArrow(
        run,
        schema(doc=source.schema["doc"].dataType, n="bigint", form="string",
               prefix_chars="bigint", middle_chars="bigint", output="binary"),
    )
    return done.select(
        *[F.col("doc").getField(c).alias(c) for c in kept],
        *ADDED[:-1], F.col("output").cast("string").alias("output"),
    )


def restore(transformed_docs: DataFrame, into: str = "restored") -> DataFrame:
    """Add the text rebuilt from ``output`` and ``form`` alone."""
    rest = [c for c in transformed_docs.columns if c != into]
    source = transformed_docs.select(
        column(transformed_docs, "output").cast("binary").alias("output"),
        column(transformed_docs, "form").alias("form"),
        F.struct(*[column(transformed_docs, c) for c in rest]).alias("row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(1).to_pylist()
            texts = [restored(o.as_py(), f) for o, f in zip(batch.column(0), forms)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(texts, pa.binary())], ["row", "text"]
            )

    done = source.mapInArrow(run, schema(row=source.schema["row"].dataType, text="binary"))
    return done.select(
        *[F.col("row").getField(c).alias(c) for c in rest],
        F.col("text").cast("string").alias(into),
    )


def op12_block_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in their forms, with digests of the output and the restored text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return restore(fill_in_middle(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


#: Units by a regular expression, parts by joining them.
SQL = r"""
    WITH texts AS (
        SELECT doc_id, coalesce(text, '') AS t,
            sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
        FROM documents
    ), units AS (
        SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
            CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
            CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4
        FROM texts
    ), forms AS (
        SELECT doc_id, t, u, len(u) AS n,
            least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
            greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                    OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM units
    ), parts AS (
        SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
            array_to_string(u[b + 1:], '') AS s
        FROM forms
    )
    SELECT doc_id, n, form,
        CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t
            WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM parts
"""

"""Personal data in texts, and terms that give it away.

Four kinds of personal data are found by pattern. Terms near an entity (a
distinct address, number, ...) may reveal it: corpus counts tell how much. The pointwise
mutual information of a term and an entity, as a share of the entity's information
content, is the part of the entity that the term discloses. Terms above a
threshold, seen in several different contexts, become spans too and are
generalised like the entities themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.llm.common import (
    LOWER, Words, bit_filter, column, grouped, heavy_split, in_filter, plain_bytes,
    row_numbers, schema, table, written,
)

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that count as its context.
REACH = 8
#: Share of an entity's information that a term has to disclose.
DISCLOSURE = 0.9
#: Different contexts in which a term has to stand near an entity.
LEAST_CONTEXTS = 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that began inside a run of digits would have begun at its start.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Letters and characters beyond ASCII.
_TERM = re.compile("[A-Za-z\u0080-\U0010ffff]{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses, from one @ to the next, so that long runs cost no more."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _is_ip(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in value.split("."))


def _is_card(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()]
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _is_phone(value: str) -> bool:
    return 9 <= sum(c.isdigit() for c in value) <= 15


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; leftmost matches that pass their test."""
    out = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern, good in (
        ("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)
    ):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if good(m.group())]
    return out


def entity(kind: str, value: str) -> str:
    """The same for all ways to write an address or number."""
    if kind == "email":
        return "email:" + value.lower()
    return f"{kind}:" + (value if kind == "ip" else "".join(c for c in value if c.isdigit()))


def _around(text: str, span: tuple[int, int], taken: np.ndarray) -> list[tuple[str, int, int]]:
    """(term, start, end) of the nearest words outside all entities, to either side."""
    left = text[max(0, span[0] - 200) : span[0]]
    base = span[0] - len(left)
    before = [(m.group(), m.start() + base, m.end() + base) for m in _TERM.finditer(left)]
    if base and before and before[0][1] == base:
        before = before[1:]  # perhaps the rest of a longer word
    right = text[span[1] : span[1] + 200]
    after = [(m.group(), m.start() + span[1], m.end() + span[1]) for m in _TERM.finditer(right)]
    if after and span[1] + 200 < len(text) and after[-1][2] == span[1] + 200:
        after = after[:-1]
    near = before[-REACH:] + after[:REACH]
    return [(_lower(t), a, b) for t, a, b in near if not taken[a:b].any()]


def _lower(term: str) -> str:
    data = term.encode("utf-8", "surrogatepass").translate(LOWER)
    return data.decode("utf-8", "surrogatepass")


_TERM_DDL = "array<struct<entity: bigint, context: bigint, term: string, start: int, end: int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_NEAR = pa.struct([
    ("entity", pa.int64()), ("context", pa.int64()), ("term", pa.string()),
    ("start", pa.int32()), ("end", pa.int32()),
])

_MARK = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    def number(value: str) -> int:
        found = xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))
        return found - (found >> 63 << 64)

    numbers = row_numbers()
    for part in parts:
        rows, nears = [], []
        for text in part.column(0).to_pylist():
            text = text or ""
            found = find(text)
            near = []
            if found:
                taken = np.zeros(len(text), dtype=bool)
                for _, a, b in found:
                    taken[a:b] = True
                for kind, a, b in found:
                    words = _around(text, (a, b), taken)
                    who = number(entity(kind, text[a:b]))
                    context = number(" ".join(w for w, _, _ in words))
                    near += [
                        {"entity": who, "context": context, "term": w, "start": x, "end": y}
                        for w, x, y in words
                    ]
            rows.append(next(numbers))
            nears.append(near)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(nears, pa.list_(_NEAR))], ["row", "near"]
        )


#: Keeps letters and bytes beyond ASCII, A-Z in lower case.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)
)


def _term_hash(terms: list[str]) -> np.ndarray:
    """Hashes by which words of documents are compared with terms."""
    return Words([" ".join(terms).encode("utf-8", "surrogatepass")]).hashes


#: Hashes that a task holds before it adds up those that are equal.
_HELD = 1 << 20


def _holding(mask: np.ndarray):
    """(hash, holding): how many texts hold each word, of those that may be in the filter.

    Tasks add up what they hold, so a frequent word gives few rows.
    """

    def summed(found: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(counts, pa.int64())], ["hash", "holding"]
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            for group in grouped([plain_bytes(t, _LETTERS) for t in part.column(0).to_pylist()]):
                words = Words(group)
                at = np.flatnonzero(in_filter(mask, words.hashes))
                text = np.searchsorted(words.first, at, side="right")
                found = np.unique(np.stack([text.astype(np.uint64), words.hashes[at]], 1), axis=0)
                held.append(found[:, 1].copy())
                size += len(found)
                if size >= _HELD:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    return run


def _marked(mask: np.ndarray):
    """Each text with its spans, and its words outside them that may be in the filter."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = row_numbers()
        for part in parts:
            texts = [t or "" for t in part.column(0).to_pylist()]
            rows, spans, marks = [], [], []
            for group in grouped([plain_bytes(t, _LETTERS) for t in texts]):
                words = Words(group)
                hit = np.flatnonzero(in_filter(mask, words.hashes))
                base = 0
                for i, data in enumerate(group):
                    text = texts[len(rows)]
                    a, b = np.searchsorted(hit, words.first[i : i + 2])
                    found = find(text)
                    marks.append(_places(
                        text, data, words.starts[hit[a:b]] - base, words.ends[hit[a:b]] - base, found
                    ))
                    spans.append([{"kind": k, "start": x, "end": y} for k, x, y in found])
                    rows.append(next(numbers))
                    base += len(data) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), part.column(1), pa.array(spans, pa.list_(_SPAN)),
                 pa.array(marks, pa.list_(_MARK))],
                ["row", "document", "spans", "marks"],
            )

    return run


def _places(
    text: str, data: bytes, starts: np.ndarray, ends: np.ndarray, found: list[tuple[str, int, int]]
) -> list[dict]:
    """Words at places in ``data`` with their places in the text, but those in ``found``."""
    if not len(starts):
        return []
    taken = np.zeros(len(text), dtype=bool)
    for _, a, b in found:
        taken[a:b] = True
    first, stop = starts, ends
    if not text.isascii():
        # Code points before each byte.
        begins = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(begins)])
        first, stop = points[starts], points[ends]
    return [
        {"term": data[x:y].decode("utf-8", "surrogatepass"), "start": a, "end": b}
        for x, y, a, b in zip(starts.tolist(), ends.tolist(), first.tolist(), stop.tolist())
        if not taken[a:b].any()
    ]


def _with_hash(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        terms = part.column(0).to_pylist()
        hashes = _term_hash(terms) if terms else np.empty(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array(hashes.view(np.int64))], [*part.schema.names, "hash"]
        )


def disclosing(
    docs: DataFrame, scanned: DataFrame, text: str = "text", share: float = DISCLOSURE,
    least: int = LEAST_CONTEXTS,
) -> DataFrame:
    """(entity, term, disclosure) of the terms that disclose an entity.

    ``disclosure`` is PMI(term, entity) / IC(entity), from the numbers of documents
    that hold the term, that hold the entity, and that have the term in a context of the
    entity. Contexts that repeat word for word count once for the support, so
    copies of a text are no evidence.
    """
    near = scanned.select("row", F.explode("near").alias("x")).select("row", "x.*")
    known = (
        near.select("row", "entity").distinct()
        .groupBy("entity").agg(F.count(F.lit(1)).alias("known"))
    )
    # A term is held by no fewer documents than have it near any entity.
    spread = (
        near.select("row", "term").distinct()
        .groupBy("term").agg(F.count(F.lit(1)).alias("spread"))
    )
    total = max(scanned.count(), 1)

    def disclosure(holding: str) -> Column:
        n = F.lit(float(total))
        mutual = F.log2(
            F.col("together") * n / (F.greatest(holding, "together") * F.col("known"))
        )
        return mutual / F.log2(n / F.col("known"))

    pairs = written(
        near.groupBy("entity", "term")
        .agg(F.countDistinct("context").alias("contexts"), F.countDistinct("row").alias("together"))
        .filter(F.col("contexts") >= least)
        .join(known, "entity").filter(F.col("known") < total)
        .join(spread, "term").filter(disclosure("spread") >= share)
        .select("entity", "term", "together", "known"),
        "pairs",
    )
    terms = written(
        pairs.select("term").distinct().mapInArrow(_with_hash, "term string, hash bigint"), "terms"
    )
    mask = bit_filter(terms, "hash")
    held = (
        docs.select(column(docs, text)).mapInArrow(_holding(mask), "hash bigint, holding bigint")
        .groupBy("hash").agg(F.sum("holding").alias("holding"))
    )
    return (
        pairs.join(terms.join(held, "hash").select("term", "holding"), "term")
        .withColumn("disclosure", disclosure("holding"))
        .filter(F.col("disclosure") >= share)
        .select("entity", "term", "disclosure", "together")
    )


def personal_data(
    docs: DataFrame, text: str = "text", share: float = DISCLOSURE, least: int = LEAST_CONTEXTS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per row: its columns, ``spans`` (kind, start, end) and ``terms`` (likewise).

    Spans are found in the whole text, in code points, the end exclusive, ordered by kind
    and start. ``terms`` are all occurrences, in any text, of words that disclose an entity,
    of kind "term"; what a word discloses is learned near entities. ``keep``
    lists the columns to return, by default all; ``spans`` and ``terms`` replace columns
    of these names. A null or empty text has no spans. Rows that repeat are judged each by
    itself but give no more evidence than one.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "terms")]
    source = docs.select(
        column(docs, text).alias("text"),
        F.struct(*[column(docs, c) for c in kept]).alias("document"),
    )
    scanned = written(
        source.select("text").mapInArrow(_scan, schema(row="bigint", near=_TERM_DDL)), "scanned"
    )
    found = written(disclosing(docs, scanned, text, share, least), "disclosing")
    words = written(
        found.select("term").distinct().mapInArrow(_with_hash, "term string, hash bigint"), "words"
    )
    marked = written(
        source.mapInArrow(
            _marked(bit_filter(words, "hash")),
            schema(row="bigint", document=source.schema["document"].dataType,
                   spans="array<struct<kind: string, start: int, end: int>>",
                   marks="array<struct<term: string, start: int, end: int>>"),
        ),
        "marked",
    )
    places = marked.select("row", F.explode("marks").alias("x")).select("row", "x.*")
    counts = places.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(words, "term")
    counts = written(counts.select("term", "n"), "term-places")
    terms = (
        heavy_split(places, counts, "term", "n", places.count())
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(
            F.struct(F.lit("term").alias("kind"), "start", "end")
        )).alias("terms"))
    )
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    return marked.join(terms, "row", "left").select(
        *[F.col("document").getField(c).alias(c) for c in kept],
        "spans",
        F.coalesce("terms", none).alias("terms"),
    )


def _general(kind: str, value: str) -> str:
    """What stands for a span: its kind, or for a term what sort of word it was."""
    if kind != "term":
        return f"[{kind.upper()}]"
    return "[NAME]" if value[:1].isupper() else "[WORD]"


def sanitised(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of ``personal_data`` with spans and terms generalised in the text.

    Where spans overlap, the first and longest stands for all. Null texts stay null.
    """
    kept = [c for c in found.columns if c not in (text, "spans", "terms")]
    source = found.select(
        column(found, text).alias("text"), F.concat("spans", "terms").alias("spans"),
        F.struct(*[column(found, c) for c in kept]).alias("document"),
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for value, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                done, pieces = 0, []
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= done:
                        pieces += [value[done : s["start"]],
                                   _general(s["kind"], value[s["start"] : s["end"]])]
                        done = s["end"]
                out.append(value if value is None else "".join(pieces) + value[done:])
            yield pa.RecordBatch.from_arrays(
                [part.column(2), pa.array(out, pa.string())], ["document", "text"]
            )

    changed = source.mapInArrow(
        run, schema(document=source.schema["document"].dataType, text="string")
    )
    return changed.select(
        *[F.col("text").alias(c) if c == text else F.col("document").getField(c).alias(c)
          for c in found.columns if c not in ("spans", "terms")]
    )


def _listed(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the terms that disclose it."""
    found = personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [
        F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS
    ]
    return found.select(
        "doc_id", *counts,
        F.sha2(_listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("spans", "terms")).alias("spans"),
    )

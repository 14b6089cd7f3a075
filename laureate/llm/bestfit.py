"""Documents packed into few token sequences by best fit and swap-based local search.

Pieces of equal length are alike, so a packing is decided by the histogram of piece
lengths, of at most ``longest`` rows whatever the corpus. Bins with the same lengths in
them form a class; best fit places, and each exchange of the local search changes, whole
classes at a time. Every piece then finds its bin by its place in the order of lengths,
which Spark counts over range partitions.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laureate.llm.common import column, row_numbers, schema, small_batches, table, written
from laureate.operators.order import numbered

#: Tokens of a sequence, and the token that ends a document.
LONGEST, END = 2048, 0

#: The local search looks at so many of the emptiest bin classes for each receiver,
#: and at so many pairs of classes in all. More effort can only save bins.
BREADTH, EFFORT = 32, 20_000


# Packing classes of bins


def best_fit(lengths: Counter, capacity: int) -> list[tuple[Counter, int]]:
    """(lengths in a bin, number of such bins) by best fit, longest pieces first.

    All pieces of a length are placed at once: each fullest class of bins with room
    takes as many as fit. A length adds at most three classes, so there are no more
    than three a length.
    """
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[tuple[Counter, int]] = []

    def keep(content: Counter, many: int, room: int) -> None:
        if room == 0:
            done.append((content, many))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([content, many])

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                content, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, content, many = capacity, Counter(), left
            each = min(room // length, left)
            full = min(many, left // each)
            keep(content + Counter({length: each}), full, room - each * length)
            left -= full * each
            if full < many and content:
                keep(content, many - full, room)
    return done + [(c, n) for room in rooms for c, n in open_[room]]


def _exchange(receiver: Counter, donor: Counter, room: int) -> tuple[int, tuple, tuple]:
    """(tokens gained, pieces given by the donor, pieces given by the receiver).

    A move, a one-for-one or a two-for-one exchange in either direction: the one that
    fills most of the receiver's room, with the fewest pieces among equals.
    """
    def singles(bin_: Counter) -> list[tuple]:
        return [(x,) for x in bin_]

    def pairs(bin_: Counter) -> list[tuple]:
        held = sorted(bin_)
        return [(x, y) for i, x in enumerate(held) for y in held[i:] if x != y or bin_[x] > 1]

    best = (0, (), ())
    for give, take in (
        (singles(donor), [()]), (singles(donor), singles(receiver)),
        (pairs(donor), singles(receiver)), (singles(donor), pairs(receiver)),
    ):
        if not give or not take:
            continue
        into = np.array([sum(x) for x in give])
        back = np.sort(np.array([sum(x) for x in take]))
        # The least that may come back so that the receiver does not overflow.
        at = np.searchsorted(back, into - room)
        fits = at < len(back)
        gain = np.where(fits, into - back[np.minimum(at, len(back) - 1)], 0)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            j = [sum(x) for x in take].index(int(into[i] - gain[i]))
            best = (int(gain[i]), give[i], take[j])
    return best


def local_search(
    bins: list[tuple[Counter, int]], capacity: int, breadth: int = BREADTH, effort: int = EFFORT
) -> list[tuple[Counter, int]]:
    """Exchange pieces between underfull bins until none empties a bin any further.

    Each step takes pieces from an emptier bin for a fuller one, which raises the sum
    of squared fills; classes of equal bins take the step together, bin by bin. So
    fills drift apart until bins are full or empty.
    """
    full = [b for b in bins if sum((b[0]).elements()) == capacity]
    classes: Counter = Counter()
    for content, many in bins:
        if sum(content.elements()) < capacity:
            classes[tuple(sorted(content.items()))] += many
    fill = {c: sum(x * n for x, n in c) for c in classes}
    settled: set[tuple] = set()

    def add(content: Counter, many: int) -> None:
        content = +content
        size = sum(x * n for x, n in content.items())
        if size == capacity:
            full.append((content, many))
        elif size:
            name = tuple(sorted(content.items()))
            fill[name] = size
            classes[name] += many

    while effort > 0:
        by_fill = sorted(classes, key=lambda c: (-fill[c], c))
        step = None
        for receiver in by_fill:
            for donor in by_fill[: -breadth - 1 : -1]:
                if fill[donor] > fill[receiver] or (receiver, donor) in settled:
                    continue
                if donor == receiver and classes[donor] < 2:
                    continue
                effort -= 1
                gain, into, back = _exchange(
                    Counter(dict(receiver)), Counter(dict(donor)), capacity - fill[receiver]
                )
                if gain:
                    step = receiver, donor, into, back
                    break
                settled.add((receiver, donor))
            if step or effort <= 0:
                break
        if not step:
            break
        receiver, donor, into, back = step
        if receiver == donor:
            many = classes[receiver] // 2
        else:
            many = min(classes[receiver], classes[donor])
        into, back = Counter(into), Counter(back)
        for name in (receiver, donor):
            classes[name] -= many
        add(Counter(dict(receiver)) + into - back, many)
        add(Counter(dict(donor)) + back - into, many)
        classes = +classes
    return full + [(Counter(dict(c)), n) for c, n in classes.items()]


class Plan:
    """Where the pieces of each length go, by their place in the order of lengths."""

    def __init__(self, lengths: Counter, bins: list[tuple[Counter, int]]):
        first = dict(zip(sorted(lengths), np.cumsum([0, *[lengths[x] for x in sorted(lengths)]])))
        rows, number = [], 0
        for content, many in bins:
            at = 0
            for length in sorted(content, reverse=True):
                each = content[length]
                rows.append((first[length], number, each, at))
                first[length] += many * each
                at += length * each
            number += many
        rows.sort()
        table_ = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.start, self.number, self.each, self.offset = table_.T

    def of(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset in it of the pieces at these places."""
        row = np.searchsorted(self.start, place, side="right") - 1
        nth = place - self.start[row]
        each = self.each[row]
        return self.number[row] + nth // each, self.offset[row] + nth % each * length


# Tokens and pieces

#: White space and a word of Latin letters, or all up to the next white space.
_CHUNK = re.compile(r"\s*(?:[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[\s.,;:!?]|$)|\S+)|\s+")
#: White space to Python only: a tokenizer may not part words there.
_UNSURE = "\x1c\x1d\x1e\x1f"
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Characters tokenised at once, and chunks whose ids a worker remembers.
_STRETCH, _REMEMBERED = 1 << 20, 1 << 20


class _Numbers(dict):
    """Numbers of chunks in the order in which they were first asked for; ``new`` are
    those whose ids nobody has looked up yet."""

    def __init__(self, names: list[str]):
        super().__init__((name, i) for i, name in enumerate(names))
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.new.append(chunk)
        return number


class Tokens:
    """Ids of texts by a byte-level tokenizer, which sees each new chunk once.

    Byte-level pre-tokens never reach from a character into white space after it, nor
    from a letter into punctuation, so the ids of a text are those of its chunks (blanks
    and the word after them, or the marks that follow a word), one after another. ``tokenizers`` gives the ids of chunks not met before; they are kept
    one after another, with the place and number of each chunk's ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        pieces = self.model.get_vocab(with_added_tokens=True)
        # In a byte-level vocabulary a token has one character for each byte.
        self.bytes = np.zeros(max(pieces.values()) + 1, dtype=np.int64)
        for text, i in pieces.items():
            self.bytes[i] = len(text)
        self.known = _Numbers([])
        self.ids = np.empty(0, dtype=np.int32)
        self.starts = np.zeros(1, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int64)

    def _forget(self) -> None:
        """Keep the chunks used most, of those used again at all, up to half of the bound."""
        least = 2
        if len(self.used) > _REMEMBERED // 2:
            least = max(least, int(np.partition(self.used, -(_REMEMBERED // 2))[-(_REMEMBERED // 2)]) + 1)
        kept = np.flatnonzero(self.used >= least)
        names = list(self.known)
        ids = [self.ids[self.starts[i] : self.starts[i + 1]] for i in kept]
        self.known = _Numbers([names[i] for i in kept])
        self.ids = np.concatenate([*ids, np.empty(0, dtype=np.int32)])
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        self.used = self.used[kept] // 2

    def _plain(self, text: str) -> np.ndarray:
        found = self.model.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(found.ids, dtype=np.int32)

    def _learn(self) -> None:
        """Look up the ids of new chunks; should that fail, they stay new."""
        new = self.known.new
        # Chunks that begin with white space and hold more can stand side by side.
        alone = [c[0] not in " \n" or c.isspace() for c in new]
        joined = [c for c, x in zip(new, alone) if not x]
        ids = self._plain("".join(joined))
        ends = np.cumsum([len(c.encode()) for c in joined], dtype=np.int64)
        edges = np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1
        apart = [self._plain(c) for c, x in zip(new, alone) if x]
        # Ids come in the order of the numbers: those before each chunk that stands alone.
        sizes = np.zeros(len(new), dtype=np.int64)
        is_alone = np.array(alone, dtype=bool)
        sizes[~is_alone] = np.diff(edges, prepend=0)
        sizes[is_alone] = [len(x) for x in apart]
        owner = np.repeat(is_alone, sizes)
        flat = np.empty(len(owner), dtype=np.int32)
        flat[~owner] = ids
        flat[owner] = np.concatenate([*apart, ids[:0]])
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int64)])
        self.known.new = []

    def _together(self, stretches: list[str]) -> list[np.ndarray]:
        """The ids of some stretches of texts."""
        found = [[] if any(c in s for c in _UNSURE) else _CHUNK.findall(s) for s in stretches]
        sizes = [len(x) for x in found]
        chunks = [c for x in found for c in x]
        if len(self.known) > _REMEMBERED and not self.known.new:
            self._forget()
        each = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        if self.known.new:
            self._learn()
        self.used += np.bincount(each, minlength=len(self.used))
        starts = self.starts[each]
        many = self.starts[each + 1] - starts
        ends = np.concatenate([[0], np.cumsum(many)])
        place = np.arange(ends[-1])
        place += np.repeat(starts - ends[:-1], many)
        ids = self.ids[place]
        at = ends[np.cumsum([0, *sizes])]
        return [
            self._plain(s) if not n else ids[a:b]
            for s, n, a, b in zip(stretches, sizes, at, at[1:])
        ]

    def of(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """The ids of each text, taken in stretches of bounded length."""
        held: list[str] = []
        owners: list[int] = []
        ready: dict[int, list[np.ndarray]] = {}
        size = 0

        def settle() -> None:
            for owner, ids in zip(owners, self._together(held)):
                ready.setdefault(owner, []).append(ids)
            held.clear()
            owners.clear()

        first = 0
        for i, text in enumerate(texts):
            for stretch in _stretches(text):
                held.append(stretch)
                owners.append(i)
                size += len(stretch)
                if size >= _STRETCH:
                    settle()
                    size = 0
            if not held:
                for j in range(first, i + 1):
                    yield np.concatenate(ready.pop(j))
                first = i + 1
        settle()
        for j in sorted(ready):
            yield np.concatenate(ready.pop(j))


def _stretches(text: str) -> Iterator[str]:
    """Parts of a text that end between chunks, of little more than ``_STRETCH``."""
    at = 0
    while len(text) - at > _STRETCH:
        cut = _SAFE_CUT.search(text, at + _STRETCH)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_MODELS: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    """One a Python worker, which serves many tasks."""
    if path not in _MODELS:
        _MODELS[path] = Tokens(path)
    return _MODELS[path]


def cuts(n: int, longest: int) -> list[int]:
    """Starts of the pieces of ``n`` ids; only the first may be shorter than ``longest``."""
    return [0, *range(n % longest or longest, n, longest)]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def unpacked(ids: pa.Array) -> pa.Array:
    """Ids from their bytes."""
    return pa.array([np.frombuffer(x.as_py(), dtype="<i4") for x in ids], pa.list_(pa.int32()))


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """One row per piece: its row's number, columns, place and token ids.

    The ids of a text (null: none) are followed by ``END``. They come as little-endian
    bytes, which Spark moves and writes as a whole, not id by id; ``unpacked`` lists them.
    """
    kept = [c for c in docs.columns if c != text]
    source = docs.select(
        column(docs, text).alias("text"),
        F.struct(F.lit(0).alias("_"), *[column(docs, c) for c in kept]).alias("doc"),
    )
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, numbers = _tokens(tokenizer), row_numbers()
        names = ["row", "doc", "piece", "start", "length", "ids", "ids_crc32"]
        for batch in batches:
            rows, ids, lengths, size = [], [], [], 0

            def out() -> pa.RecordBatch:
                take, row, piece, start = zip(*rows)
                return pa.RecordBatch.from_arrays(
                    [pa.array(row, pa.int64()), batch.column(1).take(pa.array(take)),
                     pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([zlib.crc32(x) for x in ids], pa.int64())],
                    names,
                )

            texts = (value.as_py() or "" for value in batch.column(0))
            for i, found in enumerate(tokens.of(texts)):
                found = np.append(found, np.int32(END)).astype("<i4")
                row = next(numbers)
                starts = cuts(len(found), longest)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(found)])):
                    rows.append((i, row, piece, a))
                    ids.append(found[a:b].tobytes())
                    lengths.append(b - a)
                    size += b - a
                    if size > 1 << 20:
                        yield out()
                        rows, ids, lengths, size = [], [], [], 0
            if rows:
                yield out()

    return source.mapInArrow(
        cut,
        schema(row="bigint", doc=source.schema["doc"].dataType, piece="int", start="bigint",
               length="bigint", ids="binary", ids_crc32="bigint"),
    )


ADDED = ("piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


def pack_best_fit(
    docs: DataFrame, tokenizer: str, text: str = "text", longest: int = LONGEST,
    breadth: int = BREADTH, effort: int = EFFORT,
) -> DataFrame:
    """The pieces of ``docs`` with their ids, sequence and offset in the sequence.

    Each text becomes the ids of ``tokenizer`` (a file of the ``tokenizers`` library, at
    that path on every machine) and an end; a null or empty text is its end alone. Only
    texts of more than ``longest`` ids are cut. Sequences are numbered from 0; pieces
    fill each gapless from 0. Every row is packed, also repeated ones and those without
    an id; which of several pieces of one length goes where is settled by row numbers
    and without effect on the number of sequences. The columns of ``docs`` but the text
    stay; ones named like the added columns are replaced. No rows give no sequences.
    """
    kept = [c for c in docs.columns if c not in ADDED and c != text]
    named = docs.select(*[column(docs, c) for c in kept], column(docs, text).alias("text"))
    cut = written(pieces(named, tokenizer, "text", longest), "pieces")
    # At most ``longest`` rows.
    lengths = Counter(dict(cut.groupBy("length").count().collect()))
    plan = Plan(lengths, local_search(best_fit(lengths, longest), longest, breadth, effort))
    placed = numbered(
        cut.select("row", "piece", "length"),
        [F.col("length"), F.col("row"), F.col("piece")], first=0,
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, offset = plan.of(
                batch.column("place").to_numpy(), batch.column("length").to_numpy()
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("piece"), pa.array(number), pa.array(offset)],
                ["row", "piece", "sequence_id", "offset"],
            )

    found = placed.select("row", "piece", "length", "place").mapInArrow(
        assign, schema(row="bigint", piece="int", sequence_id="bigint", offset="bigint")
    )
    return cut.join(found, ["row", "piece"]).select(
        *[F.col("doc").getField(c).alias(c) for c in kept],
        *[unpacked(c).alias(c) if c == "ids" else c for c in ADDED],
    )


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_best_fit(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )

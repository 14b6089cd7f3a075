"""A hidden Markov language model, trained and scored in blocks of documents.

Each latent state emits a word class, and the class a word. The most frequent words
are classes of their own, all others share one by their last letters, so what
the states learn has a fixed size while the words counted are all there are.

Words are counted per block of documents and summed over all blocks; each block
gets back the counts of its own words, so nobody holds the whole vocabulary. In
every Baum-Welch round the blocks add up expected counts of starts, moves and
emissions. Sums are taken over whole numbers, so their order does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laureate.llm.common import (
    LOWER, Words, column, forget, grouped, plain_bytes, row_numbers, table, written,
)

#: Latent states, words with a class of their own, classes of the others, training rounds.
STATES, OWN, SHARED, ROUNDS = 8, 2047, 1024, 4
#: Occurrences a word needs for a class of its own.
LEAST_OWN = 3
#: Bytes of text in a block, and tokens after which a long text is cut to run in parallel.
BLOCK_BYTES, SEGMENT = 8 << 20, 8192
#: Tokens of texts that are run through the recursions together.
TOGETHER = 3 << 19
#: Blocks a task may have, and words a block may have, as powers of two.
BLOCK_BITS, PLACE_BITS, CLASS_BITS = 10, 26, 12
#: The end of a text as a word. No word holds a line feed.
END = "\n"
#: Expected counts are summed in units of 2^-20.
UNIT = 1 << 20

_CLASSES = 1 + OWN + SHARED


@dataclass
class Model:
    start: np.ndarray  # by state
    moves: np.ndarray  # from state, to state
    emit: np.ndarray  # class, state


# Blocks of documents with words as numbers


_BLOCKS = (
    "block bigint, words array<string>, counts array<bigint>, ids binary, "
    "doc_ids array<bigint>, held array<boolean>, lengths array<int>"
)


def _packed(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype="<i4")


def _as_blocks(block_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Fewer bits than other row numbers, as places in a block are added to them.
        numbers = ((n >> 33 << BLOCK_BITS) + n % (1 << 33) for n in row_numbers())
        ids, held, texts, size = [], [], [], 0
        for part in parts:
            for doc, out, text in zip(*(c.to_pylist() for c in part.columns)):
                ids.append(doc)
                held.append(out)
                texts.append(plain_bytes(text, LOWER))
                size += len(texts[-1])
                if size >= block_bytes:
                    yield block(next(numbers), ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield block(next(numbers), ids, held, texts)

    def block(number: int, ids: list, held: list, texts: list[bytes]) -> pa.RecordBatch:
        # Group by group, so that only distinct words are kept of each.
        lengths, kinds, own, strings = [], [], [], []
        for group in grouped(texts):
            found = Words(group)
            kind, first, which = np.unique(found.hashes, return_index=True, return_inverse=True)
            lengths.append(np.diff(found.first))
            own.append((which + sum(map(len, kinds))).astype(np.int32))
            kinds.append(kind)
            data = found.data.tobytes()
            spans = zip(found.starts[first].tolist(), found.ends[first].tolist())
            strings += [data[x:y] for x, y in spans]
        lengths = np.concatenate(lengths)
        _, first, merged = np.unique(np.concatenate(kinds), return_index=True, return_inverse=True)
        number_of = merged.astype(np.int32)[np.concatenate(own)]
        learns = np.repeat(~np.array(held), lengths)
        often = np.bincount(number_of, minlength=len(first))
        # Frequent words get small numbers, and the end of a text gets 0.
        order = np.argsort(-often, kind="stable")
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(1, len(order) + 1)
        counts = np.bincount(place[number_of[learns]], minlength=len(order) + 1)
        counts[0] = len(held) - sum(held)
        words = [END.encode(), *(strings[i] for i in first[order].tolist())]
        sequence = np.zeros(len(number_of) + len(ids), dtype=np.int32)
        ends = np.cumsum(lengths + 1) - 1
        inner = np.ones(len(sequence), dtype=bool)
        inner[ends] = False
        sequence[inner] = place[number_of]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
             pa.array([counts], pa.list_(pa.int64())), pa.array([_packed(sequence)], pa.binary()),
             pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
             pa.array([lengths + 1], pa.list_(pa.int32()))],
            [f.split()[0] for f in _BLOCKS.split(", ")],
        )

    return run


# Word classes of a block


_CODED = (
    "doc_ids array<bigint>, held array<boolean>, lengths array<int>, known array<bigint>, "
    "base array<double>, inside array<double>, classes binary"
)


def _coded(total: int, distinct: int, sums: np.ndarray, kinds: np.ndarray):
    """From word numbers to classes, with what needs word counts worked out per text."""
    own = np.arange(_CLASSES) <= OWN
    class_total = np.where(own, 1.0, sums + 0.5 * (kinds + 1))
    all_total = total + 0.5 * (distinct + 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                entries = part.column(0)[i].values
                code = entries.field(0).to_numpy()
                place = code >> CLASS_BITS
                counts, classes = (np.empty(len(place), dtype=np.int64) for _ in range(2))
                counts[place] = entries.field(1).to_numpy()
                classes[place] = code & ((1 << CLASS_BITS) - 1)
                base = np.log10((counts + 0.5) / all_total)
                inside = np.where(
                    own[classes], 0.0, np.log10((counts + 0.5) / class_total[classes])
                )
                ids = _unpacked(part.column(1)[i].as_py())
                lengths = part.column(4)[i].values.to_numpy()
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                of_text = lambda x: np.add.reduceat(x[ids], starts)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).slice(i, 1) for c in (2, 3, 4)),
                     pa.array([of_text((counts > 0).astype(np.int64))], pa.list_(pa.int64())),
                     pa.array([of_text(base)], pa.list_(pa.float64())),
                     pa.array([of_text(inside)], pa.list_(pa.float64())),
                     pa.array([_packed(classes[ids])], pa.binary())],
                    [f.split()[0] for f in _CODED.split(", ")],
                )

    return run


# Forward and backward recursions over many sequences at once


class _Rows:
    """Sequences side by side, longest first; tokens are held step by step."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sorted_ = lengths[self.order]
        steps = int(sorted_[0]) if len(sorted_) else 0
        #: How many sequences have a token at each step, and where a step begins.
        self.active = np.searchsorted(-sorted_, -np.arange(steps), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[self.order] = np.arange(len(lengths))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
        step = np.arange(len(tokens)) - np.repeat(starts, lengths)
        self.tokens = np.empty(len(tokens), dtype=tokens.dtype)
        self.tokens[self.offset[step] + np.repeat(rank, lengths)] = tokens
        self.rank = rank

    def forward(self, model: Model, start: np.ndarray, keep: bool = False):
        """Per sequence: state weights after its last token, scaled to 1, and the
        natural logarithm of the scale. ``keep``: also the weights at every token."""
        ahead = start[self.order].copy()
        logs = np.zeros(len(ahead))
        last = np.empty_like(ahead)
        kept = np.empty((len(self.tokens), ahead.shape[1]), ahead.dtype) if keep else None
        for t, n in enumerate(self.active):
            a, b = self.offset[t], self.offset[t + 1]
            now = ahead[:n] * model.emit[self.tokens[a:b]]
            scale = now.sum(1)
            now /= scale[:, None]
            logs[:n] += np.log(scale)
            last[:n] = now
            if keep:
                kept[a:b] = now
            ahead[:n] = now @ model.moves
        return last[self.rank], logs[self.rank], kept

    def backward(self, model: Model, kept: np.ndarray, end: np.ndarray):
        """Turns ``kept`` into the states' probabilities at every token; returns the
        expected moves within the sequences. ``end``: weights of what follows each."""
        end = end[self.order]
        behind = np.empty_like(end)
        moves = np.zeros(model.moves.shape)
        done = 0
        for t in range(len(self.active) - 1, -1, -1):
            n, a, b = self.active[t], self.offset[t], self.offset[t + 1]
            if done:
                # ``behind`` holds what each sequence with a next token emits from there.
                c, d = self.offset[t + 1], self.offset[t + 2]
                ahead = behind[:done] * model.emit[self.tokens[c:d]]
                back = ahead @ model.moves.T
                scale = (kept[a : a + done] * back).sum(1)[:, None]
                moves += kept[a : a + done].T @ (ahead / scale)
                behind[:done] = back / scale
            fresh = end[done:n]
            behind[done:n] = fresh / (kept[a + done : b] * fresh).sum(1)[:, None]
            kept[a:b] *= behind[:n]
            done = n
        return moves * model.moves


def _segments(classes: np.ndarray, lengths: np.ndarray):
    """Tokens cut into segments: their lengths, texts and numbers within the text."""
    pieces = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    number = np.arange(len(text)) - first[text]
    size = np.minimum(SEGMENT, lengths[text] - number * SEGMENT)
    return size, text, number


class _Texts:
    """The recursions over whole texts.

    The later segments of a long text are run from every state at once; chaining the
    resulting matrices gives the weights with which each segment starts and ends, and the
    very same likelihood as one long run.
    """

    def __init__(self, model: Model, classes: np.ndarray, lengths: np.ndarray):
        self.model, self.classes = model, classes
        self.size, self.text, self.number = _segments(classes, lengths)
        self.begin = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64)
        k = len(model.start)
        self.start = np.tile(model.start, (len(self.size), 1))
        self.end = np.ones((len(self.size), k))
        self.logs = np.zeros(len(lengths))
        self.later = np.flatnonzero(self.number > 0)
        self._chain(k)

    def _rows(self, at: np.ndarray) -> _Rows:
        parts = [self.classes[self.begin[i] : self.begin[i] + self.size[i]] for i in at.tolist()]
        return _Rows(np.concatenate(parts) if parts else self.classes[:0], self.size[at])

    def _chain(self, k: int) -> None:
        if not len(self.later):
            return
        unit = np.tile(np.eye(k) @ self.model.moves, (len(self.later), 1))
        last, scales, _ = self._rows(np.repeat(self.later, k)).forward(self.model, unit)
        scales = scales.reshape(-1, k)
        top = scales.max(1)
        step = last.reshape(-1, k, k) * np.exp(scales - top[:, None])[:, :, None]
        heads = self.later[self.number[self.later] == 1] - 1
        now, found, _ = self._rows(heads).forward(self.model, self.start[heads])
        state = dict(zip(self.text[heads].tolist(), now))
        self.logs[self.text[heads]] += found
        for j, i in enumerate(self.later.tolist()):
            t = int(self.text[i])
            self.start[i] = state[t] @ self.model.moves
            new = state[t] @ step[j]
            self.logs[t] += np.log(new.sum()) + top[j]
            state[t] = new / new.sum()
        for j, i in reversed(list(enumerate(self.later.tolist()))):
            back = step[j] @ self.end[i]
            self.end[i - 1] = back / back.sum()

    def likelihood(self) -> np.ndarray:
        """The natural logarithm of each text's probability."""
        many = np.bincount(self.text, minlength=len(self.logs))
        short = np.flatnonzero(many[self.text] == 1)
        _, found, _ = self._rows(short).forward(self.model, self.start[short])
        self.logs[self.text[short]] = found
        return self.logs

    def expected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts by state, moves by states and emissions by class and state.

        Weights are scaled at every token, so single precision holds them; sums over
        tokens are double.
        """
        every = np.arange(len(self.size))
        rows = _Rows(self.classes, self.size)
        single = [x.astype(np.float32) for x in (self.model.start, self.model.moves, self.model.emit)]
        start, end = (x.astype(np.float32) for x in (self.start, self.end))
        last, _, kept = rows.forward(Model(*single), start, keep=True)
        moves = rows.backward(Model(*single), kept, end)
        heads = np.empty((len(every), kept.shape[1]))
        heads[rows.order] = kept[: len(every)]
        at = self.later
        joint = last[at - 1].T @ (heads[at] / np.maximum(self.start[at], 1e-300))
        emit = [
            np.bincount(rows.tokens, weights=kept[:, s], minlength=_CLASSES)
            for s in range(kept.shape[1])
        ]
        return heads[self.number == 0].sum(0), moves + joint * self.model.moves, np.stack(emit, 1)


def _together(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """(texts, tokens) of groups of neighbouring texts."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + TOGETHER, side="right")) - 1)
        yield slice(a, b), slice(int(ends[a]), int(ends[b]))
        a = b


# Training


def _expected(model: Model):
    """Rows (kind, number, one sum per state) of what the texts of a task add up to."""
    k = len(model.start)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves = np.zeros(k), np.zeros((k, k))
        emit = np.zeros((_CLASSES, k))
        for part in parts:
            for i in range(part.num_rows):
                held = np.array(part.column(0)[i].as_py())
                lengths = part.column(1)[i].values.to_numpy()
                if held.all():
                    continue
                classes = _unpacked(part.column(2)[i].as_py())
                classes = classes[np.repeat(~held, lengths)]
                lengths = lengths[~held].astype(np.int64)
                for texts, tokens in _together(lengths):
                    a, b, c = _Texts(model, classes[tokens], lengths[texts]).expected()
                    starts, moves, emit = starts + a, moves + b, emit + c
        rows = np.concatenate([starts[None], moves, emit])
        numbers = np.arange(len(rows))
        some = rows.any(1)
        values = np.round(rows[some] * UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[some]), *(pa.array(values[:, s]) for s in range(k))],
            ["number", *(f"s{s}" for s in range(k))],
        )

    return run


def _first_model(frequency: np.ndarray, states: int) -> Model:
    """States that stay put and differ a little in what they emit, the same in every run."""
    noise = np.random.default_rng(1).normal(size=(len(frequency), states))
    emit = frequency[:, None] * np.exp(noise)
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, emit / emit.sum(0))


def fit(coded: DataFrame, frequency: np.ndarray, states: int, rounds: int) -> Model:
    """Baum-Welch over all texts that are not held out.

    Every count gets a small addition, so no class is impossible in any state. The
    driver receives one row per state and class, however large the corpus.
    """
    model = _first_model(frequency, states)
    names = [f"s{s}" for s in range(states)]
    for _ in range(rounds):
        found = (
            coded.select("held", "lengths", "classes")
            .mapInArrow(_expected(model), ", ".join(["number bigint", *(f"{n} bigint" for n in names)]))
            .groupBy("number").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
        )
        sums = np.zeros((1 + states + _CLASSES, states))
        sums[found["number"].to_numpy()] = np.stack([found[n].to_numpy() for n in names], 1)
        sums /= UNIT
        start, moves, emit = sums[0] + 0.1, sums[1 : 1 + states] + 0.1, sums[1 + states :]
        emit = emit + frequency[:, None]
        model = Model(start / start.sum(), moves / moves.sum(1)[:, None], emit / emit.sum(0))
    return model


def score(
    docs: DataFrame, is_held_out, doc_id: str = "doc_id", text: str = "text",
    states: int = STATES, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    The model learns from rows where ``is_held_out`` is not true and scores all.
    Tokens are lower-cased (A-Z) words and one end per text; a null or empty text is its
    end alone. ``n_known`` counts tokens that occur in training texts, ``base_score`` is
    the log10 probability by smoothed word counts, ``score`` that by the hidden Markov
    model. A word that no training text has shares what its class sets aside for
    such words. Repeated rows each count and are each scored. Without training texts
    all words are unknown; an empty table gives an empty result.
    """
    rows = docs.select(
        column(docs, doc_id).cast("long").alias("doc"),
        F.coalesce(is_held_out, F.lit(False)).alias("held"),
        column(docs, text).alias("text"),
    )
    blocks = written(rows.mapInArrow(_as_blocks(block_bytes), _BLOCKS), "blocks")
    words = blocks.select(
        "block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")
    ).select(
        (F.shiftleft("block", PLACE_BITS) + F.col("place")).alias("key"),
        F.col("w.words").alias("word"), F.col("w.counts").alias("n"),
    )
    by_word = Window.partitionBy("word")
    counted = words.select(
        "key", "word", F.sum("n").over(by_word).alias("n"),
        (F.row_number().over(by_word.orderBy("key")) == 1).alias("first"),
    )
    counted = written(
        counted.select(
            "key", "n", "first",
            F.when(F.col("n") >= LEAST_OWN, F.xxhash64("word")).alias("hash"),
            F.when(F.col("word") == END, 0).otherwise(
                F.pmod(F.crc32(F.right("word", F.lit(3)).cast("binary")), F.lit(SHARED)) + OWN + 1
            ).cast("int").alias("shared"),
        ),
        "counted",
    )
    # Own classes: the end is 0, then the most frequent words.
    own = [
        (r["hash"], r["n"], i)
        for i, r in enumerate(
            counted.filter(f"first AND n >= {LEAST_OWN} AND shared > 0")
            .orderBy(F.desc("n"), "hash").limit(OWN).collect(), 1,
        )
    ]
    named = docs.sparkSession.createDataFrame(own, "hash bigint, n bigint, own int")
    classed = counted.join(F.broadcast(named), ["hash", "n"], "left").select(
        "key", "n", "first",
        F.when(F.col("shared") == 0, 0).otherwise(F.coalesce("own", "shared")).alias("class"),
    )
    found = (
        classed.filter("first").groupBy("class")
        .agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("kinds")).collect()
    )
    sums, kinds = np.zeros(_CLASSES), np.zeros(_CLASSES)
    for r in found:
        sums[r["class"]], kinds[r["class"]] = r["n"], r["kinds"]
    total, distinct = int(sums.sum()), int(kinds.sum())
    place = F.col("key") % (1 << PLACE_BITS)
    entries = classed.groupBy(F.shiftright("key", PLACE_BITS).alias("block")).agg(
        F.collect_list(
            F.struct((F.shiftleft(place, CLASS_BITS) + F.col("class")).alias("code"), "n")
        ).alias("entries")
    )
    coded = written(
        blocks.select("block", "ids", "doc_ids", "held", "lengths").join(entries, "block")
        .select("entries", "ids", "doc_ids", "held", "lengths")
        .mapInArrow(_coded(total, distinct, sums, kinds), _CODED),
        "coded",
    )
    forget(blocks, counted)
    frequency = (sums + 0.5) / (sums + 0.5).sum()
    model = fit(coded, frequency, states, rounds)

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                ids, held, lengths, known, base, inside = (
                    part.column(c)[i].values for c in range(6)
                )
                size = lengths.to_numpy().astype(np.int64)
                classes = _unpacked(part.column(6)[i].as_py())
                logs = np.concatenate([
                    _Texts(model, classes[tokens], size[texts]).likelihood()
                    for texts, tokens in _together(size)
                ])
                scores = logs / np.log(10) + inside.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [ids, held, pa.array(size), known, pa.array(np.full(len(size), total)), base,
                     pa.array(scores)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return coded.mapInArrow(
        finish,
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
        "train_tokens bigint, base_score double, score double",
    )


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; a fifth of all ids is held out from training."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    return score(table(spark, sf_dir, "documents"), held)

"""Near duplicates by a chosen-path set similarity join.

Texts are sets of word shingles; equal sets form a class and count once. A tree
branches classes by chosen minwise tokens: each node picks places of the signature
by a hash of its path, on average one and a quarter, and classes with the same minwise
token at a chosen place meet in a child. Pairs that are similar enough meet in
small nodes with a probability per tree that falls with the depth, and independent trees
raise that to the target recall: the deeper nodes stay open, the more trees are grown
for the classes in them. Every node is first compared with a few of its members, a node
of few members with all. What is left to find in it are pairs from different components:
if a task can compare their sketches it does, and only pairs that may be links become
rows; else the node branches again. Sketches of sets never differ in more bits than the
sets in items, so no link is ruled out by them. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.llm.common import (
    LOWER, Words, bit_filter, column, filtered, forget, grouped, heavy_split, mixed,
    plain_bytes, schema, shingle_hashes, table, written,
)

#: Minwise tokens of a signature and independent trees.
PLACES, TREES = 64, 16
#: Trees whose nodes are compared with leaders before all others, which mostly settles those.
FIRST_TREES = 2
#: Members that a whole node is compared with.
LEADERS = 8
#: A node is small if one task can compare it: so many pairs between components, and
#: members, of 260 bytes each.
OPEN_PAIRS, MEMBERS = 1 << 23, 1 << 16
#: Nodes that a member knows of, so that pairs which meet again are not told again.
NODES = 64
#: Levels that a large node goes down before it is looked at again.
LEVELS = 3
#: Bits of a set's parity sketch: at least four times its size, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 9, 1 << 20
#: Pairs compared at once.
BLOCK = 1 << 20
#: Probability that no tree brings a pair at the threshold together at some level.
LOSS = 1e-4


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """Each text's sorted hashes of its distinct runs of ``k`` words.

    Words lie between ASCII white space, A-Z in lower case. A text of fewer words is
    one run; one without words has none.
    """
    for group in grouped([plain_bytes(t, LOWER) for t in texts]):
        words = Words(group)
        runs = {n: shingle_hashes(words.hashes, n) for n in range(1, k + 1)}
        for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
            n = min(k, b - a)
            found = np.sort(runs[n][a : b - n + 1]) if n else runs[1][:0]
            yield found[np.concatenate([[True], found[1:] != found[:-1]])] if n else found


def parity_sketch(items: np.ndarray) -> np.ndarray:
    """A bit for each of some buckets, of whether an odd number of items falls there.

    Items that two sets share cancel each other, so sketches of the same length differ in at
    most as many bits as the sets differ in items. Half of a sketch over the other half is
    the sketch of half its length.
    """
    bits = min(max(LEAST_BITS, 1 << int(4 * len(items) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((items & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, one a row, brought down to some words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _may_link(sizes_a, sizes_b, differing, percent: int):
    """Whether sets of these sizes that differ in so many items, or more, may be linked."""
    return (100 + percent) * differing <= (100 - percent) * (sizes_a + sizes_b)


def _signatures(k: int):
    """Size, digest, minwise tokens and parity sketch of each text's set."""
    import hashlib

    seeds = mixed(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    turns = (seeds >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
    masks = seeds.astype(np.uint32)[:, None]

    def minwise(items: np.ndarray) -> np.ndarray:
        half = (items >> np.uint64(32)).astype(np.uint32)
        parts = [
            ((half[None, i : i + 1024] ^ masks) * turns).min(1) for i in range(0, len(half), 1024)
        ]
        return np.minimum.reduce(parts).view(np.int32)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, digests, tokens, sketches = [], [], [], []
            for items in shingle_sets(part.column(1).to_pylist(), k):
                sizes.append(len(items))
                if len(items):
                    digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                    tokens.append(minwise(items))
                    sketches.append(parity_sketch(items).tobytes())
                else:
                    digests.append(None)
                    tokens.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(tokens, pa.list_(pa.int32())), pa.array(sketches, pa.binary()),
                 part.column(2)],
                ["doc", "size", "digest", "tokens", "sketch", "source"],
            )

    return run


def _sets(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [x.tobytes() for x in shingle_sets(part.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sets, pa.binary())], ["class", "items"]
            )

    return run


def _linked(percent: int):
    """Which pairs of sets have at least ``percent`` of their union in common."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for a, b in zip(part.column(2), part.column(3)):
                a, b = (np.frombuffer(x.as_py(), dtype=np.uint64) for x in (a, b))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def close_pairs(
    classes: np.ndarray, parts: np.ndarray, sizes: np.ndarray, tokens: np.ndarray,
    percent: int, least: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different parts whose sizes and signatures allow a link.

    ``tokens`` has a row per place. The largest part is not compared with itself, so a
    group of linked texts costs no more than its pairs with others. The join uses
    ``linkable_pairs``, which needs sketches of the sets, passes fewer pairs and loses none.
    """
    names, part, many = np.unique(parts, return_inverse=True, return_counts=True)
    strangers = np.flatnonzero(part != many.argmax())
    left, right = [], []
    for at in range(0, len(strangers), 256):
        rows = strangers[at : at + 256]
        equal = np.zeros((len(rows), len(classes)), dtype=np.uint8)
        for place in tokens:
            equal += place[rows][:, None] == place[None, :]
        small = np.minimum(sizes[rows][:, None], sizes[None, :])
        large = np.maximum(sizes[rows][:, None], sizes[None, :])
        fits = (equal >= least) & (100 * small >= percent * large)
        fits &= part[rows][:, None] != part[None, :]
        i, j = np.nonzero(fits)
        a, b = classes[rows[i]], classes[j]
        left.append(np.minimum(a, b))
        right.append(np.maximum(a, b))
    if not left:
        return classes[:0], classes[:0]
    return np.concatenate(left), np.concatenate(right)


def _by_words(sketches: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, their sketches as rows of words) of each length."""
    words = pc.binary_length(sketches).to_numpy(zero_copy_only=False) // 8
    for many in np.unique(words).tolist():
        at = np.flatnonzero(words == many)
        data = b"".join(sketches.take(pa.array(at)).to_pylist())
        yield at, np.frombuffer(data, dtype=np.uint64).reshape(len(at), many)


def linkable_pairs(
    classes: np.ndarray, parts: np.ndarray, sizes: np.ndarray, sketches: pa.Array, percent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different parts whose sizes and sketches allow a link.

    The largest part is not compared with itself, so a group of linked texts costs no more
    than its pairs with others.
    """
    names, part, many = np.unique(parts, return_inverse=True, return_counts=True)
    strange = part != many.argmax()
    left, right = [], []

    def compare(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray) -> None:
        step = max(1, BLOCK // max(1, len(j)))
        for at in range(0, len(i) if len(j) else 0, step):
            rows, own = i[at : at + step], x[at : at + step]
            differing = np.zeros((len(rows), len(j)), dtype=np.int32)
            for word in range(x.shape[1]):
                differing += np.bitwise_count(own[:, word, None] ^ y[None, :, word])
            a, b = np.nonzero(
                _may_link(sizes[rows][:, None], sizes[j][None, :], differing, percent)
                & (part[rows][:, None] != part[j][None, :])
            )
            small, large = np.minimum(sizes[rows[a]], sizes[j[b]]), np.maximum(sizes[rows[a]], sizes[j[b]])
            fits = 100 * small >= percent * large
            a, b = classes[rows[a[fits]]], classes[j[b[fits]]]
            left.append(np.minimum(a, b))
            right.append(np.maximum(a, b))

    groups = list(_by_words(sketches))
    for n, (i, x) in enumerate(groups):
        words = x.shape[1]
        for j, y in groups[n:]:
            # Sets of so different sizes are not linked.
            if 100 * sizes[i].max() < percent * sizes[j].min():
                continue
            y = _folded(y, words)
            other = strange[j]
            compare(i[strange[i]], x[strange[i]], j, y)
            compare(i[~strange[i]], x[~strange[i]], j[other], y[other])
    if not left:
        return classes[:0], classes[:0]
    return np.concatenate(left), np.concatenate(right)


def _close(percent: int):
    """Which pairs have sizes and sketches that allow a link."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = [part.column(i).to_numpy() for i in (2, 3)]
            keep = np.zeros(part.num_rows, dtype=bool)
            for at, x in _by_words(part.column(4)):
                for of, y in _by_words(part.column(5).take(pa.array(at))):
                    words = min(x.shape[1], y.shape[1])
                    differing = np.bitwise_count(_folded(x[of], words) ^ _folded(y, words))
                    both = at[of]
                    keep[both] = _may_link(
                        sizes[0][both], sizes[1][both], differing.sum(1, dtype=np.int64), percent
                    )
            yield part.select([0, 1]).filter(pa.array(keep))

    return run


def _meet_first(
    node: np.ndarray, a: np.ndarray, b: np.ndarray, flat: np.ndarray, starts: np.ndarray
) -> np.ndarray:
    """Whether pairs of rows share no lesser node than the one in which they meet.

    Row i knows of the nodes ``flat[starts[i] : starts[i + 1]]``, in order.
    """
    names, rank = np.unique(flat, return_inverse=True)
    many = np.diff(starts)
    held = np.repeat(np.arange(len(node)), many) * len(names) + rank
    first = np.ones(len(a), dtype=bool)
    for at in range(0, len(a), 1 << 14):
        x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        pair = np.repeat(np.arange(len(x)), many[x])
        place = np.arange(len(pair)) + np.repeat(starts[x] - np.cumsum(many[x]) + many[x], many[x])
        lesser = flat[place] < node[x][pair]
        pair, other = pair[lesser], rank[place[lesser]]
        wanted = y[pair] * len(names) + other
        again = held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted
        first[at + pair[again]] = False
    return first


def _within_nodes(percent: int):
    """``linkable_pairs`` of each node, whose rows follow one another.

    A pair is told in the least node that both members know of, not wherever they meet.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settled(table_: pa.Table) -> pa.RecordBatch | None:
            sketches, nodes = (table_[c].combine_chunks() for c in ("sketch", "nodes"))
            node, classes, component, sizes = (
                table_[c].to_numpy() for c in ("node", "class", "component", "size")
            )
            edges = np.flatnonzero(np.diff(node, prepend=node[0] - 1, append=node[-1] - 1))
            found = [
                linkable_pairs(np.arange(x, y), component[x:y], sizes[x:y], sketches[x:y], percent)
                for x, y in zip(edges, edges[1:])
            ]
            a, b = (np.concatenate(side) for side in zip(*found))
            starts = nodes.offsets.to_numpy().astype(np.int64)
            first = _meet_first(node, a, b, nodes.values.to_numpy(), starts)
            a, b = classes[a[first]], classes[b[first]]
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

        for part in parts:
            if not part.num_rows:
                continue
            # All but the last node of the rows so far are whole.
            nodes = part.column(0).to_numpy()
            whole = int(np.searchsorted(nodes, nodes[-1]))
            starts_new = not held or held[-1].column(0)[-1].as_py() != nodes[0]
            if whole or starts_new:
                ready = [*held, part.slice(0, whole)] if whole else held
                if ready:
                    yield settled(pa.Table.from_batches(ready))
                held = []
            held.append(part.slice(whole))
        if held:
            yield settled(pa.Table.from_batches(held))

    return run


class _Join:
    """The state of one join: classes, their sets, and what is known of pairs."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, percent: int):
        self.docs, self.classes, self.k, self.percent = docs, classes, k, percent
        self.tried: DataFrame | None = None
        #: Links found since components were last worked out.
        self.fresh: DataFrame | None = None
        self.labels: DataFrame | None = None

    def compare(self, pairs: DataFrame) -> None:
        """Test pairs (a, b), a < b, of sizes that allow a link, and keep the links."""
        sketch = self.classes.select("class", "size", "sketch")
        sides = [
            sketch.select(F.col("class").alias(s), F.col("size").alias(f"size_{s}"),
                          F.col("sketch").alias(f"sketch_{s}"))
            for s in ("a", "b")
        ]
        both = (
            pairs.distinct().join(sides[0], "a").join(sides[1], "b")
            .select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
        )
        self._confirm(both.mapInArrow(_close(self.percent), "a bigint, b bigint"))

    def compare_nodes(self, members: DataFrame) -> None:
        """Compare all members of small nodes that are of different components.

        ``members`` has node, class and component. Nodes lie whole in a task; of a node's
        pairs only those become rows whose sketches say that they may be links.
        """
        own = members.groupBy("class").agg(
            F.first("component").alias("component"),
            F.sort_array(F.collect_list("node")).alias("nodes"),
        )
        rows = own.join(self.classes.select("class", "size", "sketch"), "class")
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = (
            rows.select(F.explode("nodes").alias("node"), "class", "component", "size", "sketch",
                        F.slice("nodes", 1, NODES).alias("nodes"))
            .repartition(parts, "node").sortWithinPartitions("node")
        )
        pairs = rows.mapInArrow(_within_nodes(self.percent), "a bigint, b bigint")
        self._confirm(pairs.distinct())

    def _confirm(self, pairs: DataFrame) -> None:
        """Keep the links among distinct pairs, of which those tried before are known."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        close = written(pairs, "close-pairs")
        if close.isEmpty():
            forget(close)
            return
        sets = self._load(close)
        a = sets.select(F.col("class").alias("a"), F.col("items").alias("items_a"))
        b = sets.select(F.col("class").alias("b"), F.col("items").alias("items_b"))
        full = close.join(a, "a").join(b, "b").select("a", "b", "items_a", "items_b")
        found = written(full.mapInArrow(_linked(self.percent), "a bigint, b bigint"), "links")
        forget(sets)
        self.tried = _more(self.tried, close, "tried")
        if found.isEmpty():
            forget(found)
        else:
            self.fresh = _more(self.fresh, found, "fresh")

    def relabel(self) -> None:
        """Bring components up to date: new links join those there are, as if each were
        a single class, so old links are not gone through again."""
        fresh, old, self.fresh = self.fresh, self.labels, None
        if fresh is None:
            return
        if old is None:
            self.labels = components(fresh)
            return
        ends = fresh.select("a", "b")
        for side in ("a", "b"):
            own = old.select(F.col("class").alias(side), "component")
            ends = ends.join(own, side, "left").withColumn(
                side, F.coalesce("component", side)
            ).drop("component")
        between = written(
            ends.filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "between",
        )
        if between.isEmpty():
            forget(between)
            return
        found = components(between)
        moves = found.select(F.col("class").alias("component"), F.col("component").alias("to"))
        sized = old.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        sized = sized.join(moves, "component", "left").select(
            "component", "n", F.coalesce("to", "component").alias("to")
        )
        sized = written(sized, "moves")
        moved = heavy_split(old, sized, "component", "n", old.count())
        first = found.join(old.select("class"), "class", "left_anti")
        self.labels = written(
            moved.select("class", F.col("to").alias("component"))
            .unionByName(first.select("class", "component")),
            "labels",
        )
        forget(old, between, found, sized)

    def _load(self, pairs: DataFrame) -> DataFrame:
        """Full sets of the classes in ``pairs``. They are not kept: later pairs are few and
        mostly of other classes."""
        asked = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        asked = written(asked.join(self.classes.select("class", "source"), "class"), "asked")
        mask = bit_filter(asked.select(F.xxhash64("source").alias("h")), "h")
        texts = self.docs.select("text", "source", F.xxhash64("source").alias("h"))
        texts = filtered(texts, "h", mask).dropDuplicates(["source"])
        own = (
            texts.join(asked, "source").select("class", "text")
            .mapInArrow(_sets(self.k), "class bigint, items binary")
        )
        sets = written(own, "sets")
        forget(asked)
        return sets

    def labelled(self, members: DataFrame) -> DataFrame:
        """``members`` with the component of each class: itself if it has no link."""
        if self.labels is None:
            return members.withColumn("component", F.col("class"))
        return members.join(self.labels, "class", "left").withColumn(
            "component", F.coalesce("component", "class")
        )


def _more(old: DataFrame | None, new: DataFrame, label: str) -> DataFrame:
    """Old and new rows. Each part is written once and stays where it is."""
    new = new if hasattr(new, "_written_to") else written(new, label)
    return new if old is None else old.unionByName(new)


def components(links: DataFrame) -> DataFrame:
    """(class, component): the least class that links lead to.

    Alternates large-star and small-star steps, which shorten paths to the least
    member by a constant factor, until a pair of steps changes nothing. Each step
    is written, so lineage stays short.
    """
    edges = written(links.select("a", "b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(
            F.min("b").alias("least"), F.count(F.lit(1)).alias("n"),
            F.count(F.when(F.col("b") < F.col("a"), 1)).alias("lesser"),
        )
        least = written(least.withColumn("least", F.least("least", "a")), "least")
        # In stars, every node has greater neighbours only or a single one, a lesser.
        if least.filter("lesser > 1 OR lesser = 1 AND n > 1").isEmpty():
            forget(edges)
            return least.select(F.col("a").alias("class"), F.col("least").alias("component"))
        # Large star: neighbours beyond a node move to the least of its neighbourhood.
        total = 2 * edges.count()
        large = written(
            heavy_split(both, least, "a", "n", total).filter("b > a")
            .select(F.col("least").alias("a"), "b").distinct(),
            "large-star",
        )
        # Small star: a node's lesser neighbours and the node move to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("least"), F.count(F.lit(1)).alias("n"))
        low = written(low, "low")
        lesser = heavy_split(large, low, "b", "n", large.count())
        small = written(
            lesser.filter("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
            .union(low.select(F.col("least").alias("a"), "b")).distinct(),
            "small-star",
        )
        forget(edges, least, large, low)
        edges = small


def _chosen(node: Column, share: float) -> Column:
    """The places that a node picks, each with the same small probability."""
    scale = 1 << 20
    return F.filter(
        F.sequence(F.lit(0), F.lit(PLACES - 1)),
        lambda i: F.pmod(F.xxhash64(node, i), F.lit(scale)) < int(share * scale),
    )


def _children(some: DataFrame, trees: range, share: float) -> DataFrame:
    """Nodes of classes below the roots of some trees. The classes bring their tokens, and no
    two rows are alike, so none has to move."""
    roots = some.sparkSession.range(trees.start, trees.stop, 1, 1).select(
        F.xxhash64(F.lit("root"), F.col("id").cast("int")).alias("root")
    )
    places = roots.select("root", F.explode(_chosen(F.col("root"), share)).alias("place"))
    node = F.xxhash64("root", "place", F.get("tokens", "place")).alias("node")
    kept = [c for c in some.columns if c != "tokens"]
    return some.crossJoin(F.broadcast(places)).select(node, *kept)


def _below(members: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """Nodes of classes some levels down: tokens travel along instead of being joined anew."""
    rows = members.select("node", "class").join(classes, "class")
    for _ in range(LEVELS):
        rows = rows.select(
            *classes.columns, "node", F.explode(_chosen(F.col("node"), share)).alias("place")
        ).select(
            *classes.columns, F.xxhash64("node", "place", F.get("tokens", "place")).alias("node")
        )
    return rows.select("node", *[c for c in classes.columns if c != "tokens"])


def _shared(members: DataFrame) -> DataFrame:
    """Members of nodes with at least two, with their number ``n``."""
    nodes = members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    nodes = written(nodes, "nodes")
    out = written(heavy_split(members, nodes, "node", "n", members.count()), "tree-nodes")
    forget(nodes)
    return out


def _to_leaders(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a leader and another member of its node, of sizes that allow a link.

    Its least members by number and by hashes of it lead a node; in nodes of up to
    ``LEADERS`` members all lead.
    """
    member = F.struct("class", "size")
    few = members.filter(F.col("n") <= LEADERS).groupBy("node").agg(
        F.collect_list(member).alias("leaders")
    ).select("leaders", F.explode("leaders").alias("member"))
    many = members.filter(F.col("n") > LEADERS)
    least = [F.min(member)] + [
        F.min(F.struct(F.xxhash64("class", F.lit(i)).alias("hash"), member.alias("member")))["member"]
        for i in range(1, LEADERS)
    ]
    leaders = many.groupBy("node").agg(
        F.max("n").alias("n"), F.array_distinct(F.array(*least)).alias("leaders")
    )
    many = heavy_split(
        many.select("node", member.alias("member")), written(leaders, "leaders"), "node", "n",
        many.count(),
    )
    small, large = F.least("member.size", "leader.size"), F.greatest("member.size", "leader.size")
    pair = [F.col("member.class"), F.col("leader.class")]
    return (
        few.select("leaders", "member").unionByName(many.select("leaders", "member"))
        .select("member", F.explode("leaders").alias("leader"))
        .filter((pair[0] != pair[1]) & (100 * small >= percent * large))
        .select(F.least(*pair).alias("a"), F.greatest(*pair).alias("b"))
    )


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text",
    trees: int = TREES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Rows are linked if their sets of ``k``-word shingles have at least ``percent``
    of their union in common; a shorter text is one shingle, one without words
    an empty set without links. ``component_id`` is the least id that links lead to,
    and ``kept`` marks the row that has it. A row without an id is linked like others, but
    gives no component its id; alone, its ``component_id`` is null and it is kept. Rows
    that share an id keep or lose their places together if their texts are linked.
    A pair at the threshold meets in a child of a tree's root with a probability of
    ``1 - 1 / e``, which ``trees`` independent trees raise to all but certainty. Classes in
    nodes that are still open below get further trees, so that at no level such a pair
    is lost with a probability over ``LOSS``.
    """
    # A text is found again by its digest, as ids may be missing or repeat.
    value = column(docs, text).cast("string")
    texts = docs.select(
        column(docs, doc_id).alias("doc"), value.alias("text"),
        F.unhex(F.sha2(value.cast("binary"), 256)).alias("source"),
    )
    signed = written(
        texts.mapInArrow(
            _signatures(k),
            schema(doc=texts.schema["doc"].dataType, size="bigint", digest="binary",
                   tokens="array<int>", sketch="binary", source="binary"),
        ),
        "signatures",
    )
    # Copies meet here: one row per task and class moves, however many copies there are.
    classes = written(
        signed.filter("size > 0").groupBy("digest")
        .agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"),
             F.first("size").alias("size"), F.first("tokens").alias("tokens"),
             F.first("sketch").alias("sketch"), F.first("source").alias("source"))
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    join = _Join(texts, classes, k, percent)
    signatures, share = classes.select("class", "size", "tokens"), 100 / percent / PLACES
    if trees > FIRST_TREES:
        # Leaders of the first trees' nodes settle most nodes of all trees.
        start = written(_children(signatures, range(FIRST_TREES), share), "members")
        first = _shared(start)
        join.compare(_to_leaders(first, percent))
        join.relabel()
        forget(start, first)
    _grow(join, _children(signatures, range(trees), share), signatures, share, trees)
    return _result(signed, classes, join, docs, doc_id)


def trees_for(level: int, share: float, percent: int) -> int:
    """How many trees bring a pair at the threshold together in a node of a level, but
    for a probability of ``LOSS``.

    Equal places of its signatures are binomial; given these, a pair's common nodes are a
    branching process.
    """
    same = np.arange(1, PLACES + 1)
    s = percent / 100
    weight = np.array([comb(PLACES, i) * s**i * (1 - s) ** (PLACES - i) for i in same.tolist()])
    meets = np.ones(PLACES)
    for _ in range(level):
        meets = 1 - (1 - share * meets) ** same
    few, many = 0, 1
    while (weight * (1 - meets) ** many).sum() > LOSS:
        few, many = many, 2 * many
    while many - few > 1:
        half = (few + many) // 2
        lost = (weight * (1 - meets) ** half).sum() > LOSS
        few, many = (half, many) if lost else (few, half)
    return many


def _rooted(some: DataFrame, trees: range, classes: DataFrame, share: float, level: int) -> DataFrame:
    """Nodes of some classes at a level of new trees."""
    rows = written(_children(classes.join(some, "class"), trees, share), "further")
    for _ in range(level // LEVELS):
        shared = _shared(rows)
        lower = written(_below(shared, classes, share), "further")
        forget(rows, shared)
        rows = lower
    return rows


def _grow(
    join: _Join, nodes: DataFrame, classes: DataFrame, share: float, trees: int
) -> None:
    """Compare within nodes, given as (node, class, size), and below them until none is open.

    The nodes are from so many trees. Classes in open nodes get as many further trees as the
    level below needs, and ``FIRST_TREES`` more.
    Components are worked out once a level. What is not known of them in between only costs
    some pairs more.
    """
    below, level = written(nodes, "members"), 1
    while below is not None:
        members = _shared(below)
        forget(below)
        if join.labels is not None:
            settled = members
            members = _open(join, members)
            forget(settled)
        join.compare(_to_leaders(members, join.percent))
        join.relabel()
        # Of smaller nodes all pairs were compared.
        several = _open(join, members.filter(F.col("n") > LEADERS))
        join.compare_nodes(several.filter("is_small").select("node", "class", "component"))
        large = several.filter("NOT is_small").select("node", "class")
        if large.isEmpty():
            below = None
        else:
            level += LEVELS
            lower = [_below(large, classes, share)]
            wanted = max(trees, FIRST_TREES + trees_for(level, share, join.percent))
            more, trees = range(trees, wanted), wanted
            if more:
                some = large.select("class").distinct()
                lower.append(_rooted(some, more, classes, share, level))
            below = lower[0] if len(lower) == 1 else lower[0].unionByName(lower[1])
            below = written(below, "members")
            forget(*lower)
        forget(members, several)
    join.relabel()


def _open(join: _Join, members: DataFrame) -> DataFrame:
    """Members of the nodes that span several components, and whether those are small."""
    plain = members.select("node", "class", "size", "n")
    own = written(join.labelled(plain), "labelled")
    parts = own.groupBy("node", "component").agg(F.count(F.lit(1)).cast("double").alias("size"))
    nodes = parts.groupBy("node").agg(
        F.sum("size").alias("n"), F.sum(F.col("size") * F.col("size")).alias("joined")
    ).withColumn("pairs", (F.col("n") * F.col("n") - F.col("joined")) / 2)
    nodes = nodes.filter("pairs > 0").select(
        "node", F.col("n").alias("members"),
        ((F.col("pairs") <= OPEN_PAIRS) & (F.col("n") <= MEMBERS)).alias("is_small"),
    )
    out = written(heavy_split(own, written(nodes, "open-nodes"), "node", "members", own.count()), "open")
    forget(own)
    return out


def _result(signed, classes, join: _Join, docs: DataFrame, doc_id: str) -> DataFrame:
    own = join.labelled(classes.select("class", "digest", "doc", "copies"))
    ids = own.groupBy("component").agg(F.min("doc").alias("least"))
    if join.labels is None:
        least = classes.select("digest", "copies", F.col("doc").alias("least"))
    else:
        sized = own.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(ids, "component")
        least = heavy_split(own, written(sized, "component-ids"), "component", "n", own.count())
        least = least.select("digest", "copies", "least")
    least = written(least, "class-ids")
    some = signed.filter("size > 0").select("doc", "size", "digest")
    found = heavy_split(some, least, "digest", "copies", some.count()).select("doc", "size", "least")
    none = signed.filter("size = 0").select("doc", "size", F.col("doc").alias("least"))
    return found.unionByName(none).select(
        F.col("doc").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.col("least").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("least")).alias("kept"),
    )


def near_representatives(
    docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the least id stays.

    Of rows with the same id one stays if their texts are linked; rows without an id give
    way to all others. Rows without words all stay.
    """
    numbered = written(
        docs.select(F.monotonically_increasing_id().alias("row"),
                    F.struct(*[column(docs, c) for c in docs.columns]).alias("document")),
        "numbered",
    )
    key, value = (F.col("document").getField(c) for c in (doc_id, text))
    rows = numbered.select(
        F.struct(key.isNull().alias("none"), key.alias("id"), "row").alias("doc"),
        value.alias("text"),
    )
    found = near_duplicates(rows, k, percent, "doc", "text")
    gone = written(found.filter("NOT kept").select("doc_id.row"), "near-copies")
    hashed = numbered.withColumn("h", F.xxhash64("row"))
    mask = bit_filter(gone.select(F.xxhash64("row").alias("h")), "h")
    rest = filtered(hashed, "h", mask).join(gone, "row", "left_anti")
    kept = filtered(hashed, "h", mask, inside=False).unionByName(rest)
    return kept.select(*[F.col("document").getField(c).alias(c) for c in docs.columns])


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)

"""The trie of conversation prefixes, from z-fast tries of batches.

Turns are ordered over range partitions and cut into segments of bounded length, so
that no conversation has to fit one task. A prefix is known by a polynomial hash of its
turns, which can be carried from segment to segment. Each task inserts its segments into
a z-fast trie: compacted nodes are found through their handle, the prefix at the
two-fattest depth of their edge, and a segment's exit node by fat binary search. Edges
are then expanded to one row per prefix, and equal prefixes of all tasks are added up.

Figures of subtrees need no walk through the trie. Every node belongs to the smallest
conversation through it, whose nodes are a stretch of its path; so sums over the members
of a node, taken the same way, give sums over its distinct descendants.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laureate.llm.common import (
    column,
    forget,
    heavy_split,
    row_numbers,
    schema,
    small_batches,
    table,
    written,
)

#: Turns of a segment, and turns whose segments share one trie in a task.
SEGMENT, TOGETHER = 2048, 1 << 17
#: Segments located before they are inserted.
BATCH = 1024
#: Characters of joined ids in one row.
CHUNK = 1 << 16

# --- fixed values: families of conversations and shared first turns ---
FAMILY, SHARED = 5, 9

#: Prefix hashes are numbers below a Mersenne prime, in 16 bytes.
_PRIME = (1 << 127) - 1
_BASE = 0x5851F42D4C957F2D14057B7EF767814F % _PRIME
_ROOT = bytes(16)


def _number(key: bytes) -> int:
    return int.from_bytes(key, "big")


def _key(number: int) -> bytes:
    return number.to_bytes(16, "big")


def extended(number: int, turns: bytes) -> list[int]:
    """Hashes of a prefix followed by one, two, ... of some turns (16 bytes each)."""
    out = []
    for i in range(0, len(turns), 16):
        number = (number * _BASE + int.from_bytes(turns[i : i + 16], "big") + 1) % _PRIME
        out.append(number)
    return out


# Z-fast trie


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that is divisible by the highest power of two."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class Segment:
    """Keys of the prefixes at depths ``start + 1`` to ``end``, and what to add up."""

    __slots__ = ("start", "end", "first", "keys", "sizes", "before", "sums", "least")

    def __init__(self, start, first, keys, sizes, before, sums, least):
        self.start, self.first, self.keys = start, first, keys
        self.end = start + len(keys) // 16
        self.sizes, self.before = sizes, before
        self.sums, self.least = sums, least

    def key(self, depth: int) -> bytes:
        at = 16 * (depth - self.start)
        return self.keys[at - 16 : at] if at else self.first


class Node:
    """The prefixes at depths ``low + 1`` to ``high`` of a segment, without a branch."""

    __slots__ = ("low", "high", "of", "parent", "children", "sums", "least")

    def __init__(self, low: int, high: int, of: Segment, parent: Node | None):
        self.low, self.high, self.of, self.parent = low, high, of, parent
        self.children: dict[bytes, Node] = {}
        self.sums, self.least = [0, 0], None

    def handle(self) -> bytes:
        return self.of.key(two_fattest(self.low, self.high))

    def add(self, sums, least) -> None:
        self.sums[0] += sums[0]
        self.sums[1] += sums[1]
        if self.least is None or least < self.least:
            self.least = least


class ZFastTrie:
    """Compacted trie of segments that start after the same prefix.

    Its nodes are hashed by their handles.
    """

    def __init__(self, any_: Segment):
        self.handles: dict[bytes, Node] = {}
        self.root = Node(any_.start, any_.start, any_, None)
        self.nodes: list[Node] = []

    def locate(self, s: Segment, node: Node) -> Node:
        """The deepest node below ``node`` all of whose prefixes ``s`` has.

        Fat binary search: a handle that is not there rules out all nodes that reach
        its depth, one that is there leads on to the end of its node.
        """
        a, b = node.high, s.end
        while a < b:
            f = two_fattest(a, b)
            found = self.handles.get(s.key(f))
            if found is None:
                b = f - 1
            elif found.high <= s.end and s.key(found.high) == found.of.key(found.high):
                node, a = found, found.high
            else:
                return found.parent
        return node

    def insert(self, batch: list[Segment]) -> None:
        """Locate all segments of a batch in the trie so far, then insert them by exit."""
        by_exit: dict[int, tuple[Node, list[Segment]]] = {}
        for s in batch:
            node = self.locate(s, self.root)
            by_exit.setdefault(id(node), (node, []))[1].append(s)
        for node, held in by_exit.values():
            for s in held:
                # Others of the batch may have grown the trie below.
                self._insert(s, self.locate(s, node))

    def _insert(self, s: Segment, node: Node) -> None:
        exit_ = node.children.get(s.key(node.high + 1)) if node.high < s.end else None
        if exit_ is not None:
            node = self._split(node, exit_, self._common(s, exit_))
        if node.high < s.end:
            leaf = Node(node.high, s.end, s, node)
            node.children[s.key(leaf.low + 1)] = leaf
            self._hash(leaf)
            self.nodes.append(leaf)
            node = leaf
        node.add(s.sums, s.least)

    @staticmethod
    def _common(s: Segment, node: Node) -> int:
        """The depth to which ``s`` runs along an edge whose first prefix it has."""
        a, b = node.low + 1, min(node.high, s.end)
        while a < b:
            middle = (a + b + 1) // 2
            if s.key(middle) == node.of.key(middle):
                a = middle
            else:
                b = middle - 1
        return a

    def _split(self, parent: Node, node: Node, depth: int) -> Node:
        if depth == node.high:
            return node
        upper = Node(node.low, depth, node.of, parent)
        parent.children[node.of.key(node.low + 1)] = upper
        del self.handles[node.handle()]
        node.low, node.parent = depth, upper
        upper.children[node.of.key(depth + 1)] = node
        self._hash(upper)
        self._hash(node)
        self.nodes.append(upper)
        return upper

    def _hash(self, node: Node) -> None:
        self.handles[node.handle()] = node

    def settled(self) -> list[Node]:
        """All nodes, once what their descendants hold is added to them.

        The root counts only if it is the empty prefix; another one ends a segment.
        """
        for node in sorted(self.nodes, key=lambda n: -n.high):
            node.parent.add(node.sums, node.least)
        return [*self.nodes, *([self.root] if self.root.high == 0 else [])]


def expanded(tries: Iterable[ZFastTrie]) -> pa.RecordBatch:
    """One row per prefix: an edge's prefixes all have the members of its node."""
    nodes = [n for trie in tries for n in trie.settled()]
    keys, parents, depths, sizes, before = [], [], [], [], []
    for n in nodes:
        s, a, b = n.of, n.low - n.of.start, n.high - n.of.start
        if n.parent is None:
            keys.append(_ROOT)
            parents.append(_ROOT)
            depths.append([0])
            sizes.append([0])
            before.append([0])
            continue
        keys.append(s.keys[16 * a : 16 * b])
        parents.append(s.key(n.low) + s.keys[16 * a : 16 * (b - 1)])
        depths.append(np.arange(n.low + 1, n.high + 1))
        own = s.sizes[a:b]
        sizes.append(own)
        before.append(s.before + int(s.sizes[:a].sum()) + np.cumsum(own) - own)
    many = [len(d) for d in depths]
    flat = [np.concatenate(x).astype(np.int64) for x in (depths, sizes, before)]
    added = [
        np.repeat(np.array(x, dtype=np.int64), many)
        for x in ([n.sums[0] for n in nodes], [n.sums[1] for n in nodes],
                  [n.least for n in nodes])
    ]
    binary = pa.binary(16)
    hashes = [
        pa.FixedSizeBinaryArray.from_buffers(
            binary, sum(many), [None, pa.py_buffer(b"".join(x))]
        ).cast(pa.binary())
        for x in (keys, parents)
    ]
    return pa.RecordBatch.from_arrays(
        [*hashes, *map(pa.array, flat), *map(pa.array, added)], list(NODE)
    )


NODE = {
    "key": "binary", "parent": "binary", "depth": "bigint", "size": "bigint",
    "before": "bigint", "sum_0": "bigint", "sum_1": "bigint", "least": "bigint",
}


def _summed(segments: DataFrame, sums: list[Column], least: Column) -> DataFrame:
    """One row per prefix: two sums and a least value over the segments through it."""
    picked = segments.select(
        "start", "first", "keys", "sizes", "before", *sums, least.alias("_least")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple[int, bytes], ZFastTrie] = {}
        turns = 0
        for batch in batches:
            start, first, keys, sizes, before, x, y, z = batch.columns
            held = [
                Segment(*row) for row in zip(
                    start.to_pylist(), first.to_pylist(), keys.to_pylist(),
                    (np.array(v, dtype=np.int64) for v in sizes.to_pylist()),
                    before.to_pylist(), zip(x.to_pylist(), y.to_pylist()), z.to_pylist(),
                )
            ]
            for i in range(0, len(held), BATCH):
                by_start: dict[tuple[int, bytes], list[Segment]] = {}
                for s in held[i : i + BATCH]:
                    by_start.setdefault((s.start, s.first), []).append(s)
                    turns += s.end - s.start + 1
                for at, some in by_start.items():
                    if at not in tries:
                        tries[at] = ZFastTrie(some[0])
                    tries[at].insert(some)
                if turns >= TOGETHER:
                    yield expanded(tries.values())
                    tries, turns = {}, 0
        if tries:
            yield expanded(tries.values())

    return (
        picked.mapInArrow(run, schema(**NODE))
        .groupBy("key", "depth")
        .agg(
            *[F.min(c).alias(c) for c in ("parent", "size", "before")],
            F.sum("sum_0").alias("sum_0"), F.sum("sum_1").alias("sum_1"),
            F.min("least").alias("least"),
        )
    )


# Rebuilt conversations


def _runs(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation's turns in order, as runs of up to ``SEGMENT`` turns."""
    spark = conversations.sparkSession
    who = F.coalesce(column(conversations, role), F.lit("")).cast("string")
    what = F.coalesce(column(conversations, text), F.lit("")).cast("string")
    turns = conversations.select(
        column(conversations, conv).cast("bigint").alias("conv"),
        column(conversations, turn).alias("turn"),
        F.unhex(F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what), 256), 1, 32))
        .alias("digest"),
        F.octet_length(what).cast("bigint").alias("size"),
    ).filter(F.col("conv").isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = row_numbers()
        held_conv, digests, sizes = None, [], []
        out: list[tuple] = []

        def close() -> None:
            if digests:
                joined = b"".join(digests)
                out.append((
                    next(numbers), held_conv, len(digests), _key(extended(0, joined)[-1]),
                    sum(sizes), joined, list(sizes),
                ))
                digests.clear()
                sizes.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(),
                     pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                ["run", "conv", "n", "hash", "bytes", "turns", "sizes"],
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("conv", "digest", "size")))
            for c, digest, size in rows:
                if c != held_conv or len(digests) == SEGMENT:
                    close()
                    held_conv = c
                digests.append(digest)
                sizes.append(size)
            if out:
                yield batch_of(out)
                out = []
        close()
        if out:
            yield batch_of(out)

    small_batches(spark)
    # Runs are numbered in the order of the range partitions.
    return written(
        dealt.select("conv", "digest", "size").mapInArrow(
            cut,
            schema(run="bigint", conv="bigint", n="bigint", hash="binary", bytes="bigint",
                   turns="binary", sizes="array<bigint>"),
        ),
        "runs",
    )


def _carried(runs: DataFrame) -> DataFrame:
    """Per run: its conversation's turns, hash and bytes before it, and turns and bytes in all.

    Only conversations of several runs go through Python, as one narrow row a run.
    """
    narrow = runs.select("run", "conv", "n", "hash", "bytes")
    counts = narrow.groupBy("conv").agg(
        F.count("*").alias("runs"), F.sum("n").alias("turns"), F.sum("bytes").alias("all_bytes")
    )
    known = narrow.join(counts, "conv")

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        offset, number, size, out = 0, 0, 0, []
        for run, n, key, many in zip(rows.run, rows.n, rows.hash, rows.bytes):
            out.append((run, offset, _key(number), size))
            number = (number * pow(_BASE, int(n), _PRIME) + _number(key)) % _PRIME
            offset, size = offset + n, size + many
        found = pd.DataFrame(out, columns=["run", "offset", "before_hash", "before"])
        return found.assign(conv=rows.conv.iloc[0], all_turns=offset, all_bytes=size)

    kinds = schema(run="bigint", offset="bigint", before_hash="binary", before="bigint",
                   conv="bigint", all_turns="bigint", all_bytes="bigint")
    several = known.filter("runs > 1").groupBy("conv").applyInPandas(carry, kinds)
    one = known.filter("runs = 1").select(
        "run", F.lit(0).cast("bigint").alias("offset"), F.lit(_ROOT).alias("before_hash"),
        F.lit(0).cast("bigint").alias("before"), "conv", F.col("turns").alias("all_turns"),
        "all_bytes",
    )
    return one.unionByName(several)


def _heads(runs: DataFrame, carried: DataFrame) -> DataFrame:
    """The first turns of each conversation, as far as others may share them."""
    most = SHARED - 1
    early = carried.filter(F.col("offset") < most).select("run", "offset")
    return (
        runs.select("run", "conv", F.substring("turns", 1, 16 * most).alias("turns"),
                    F.slice("sizes", 1, most).alias("sizes"))
        .join(early, "run")
        .groupBy("conv")
        # At most ``SHARED`` - 1 runs.
        .agg(F.sort_array(F.collect_list(F.struct("offset", "turns", "sizes"))).alias("head"))
        .select("conv", F.col("head.turns").alias("turns"), F.flatten("head.sizes").alias("sizes"))
    )


def _segments(runs: DataFrame) -> DataFrame:
    """The rebuilt conversations as segments of prefix keys.

    A conversation begins with the first turns of its family's first one and goes on
    with its own after as many; how many depends on its id.
    """
    carried = written(_carried(runs), "carried")
    heads = written(_heads(runs, carried), "heads")
    lead = heads.select(
        F.col("conv").alias("family"), F.col("turns").alias("lead"),
        F.col("sizes").alias("lead_sizes"),
    )
    own = heads.select("conv", F.col("turns").alias("own"), F.col("sizes").alias("own_sizes"))
    # One narrow row a run; five conversations share a family.
    told = (
        carried.join(own, "conv")
        .withColumn("family", F.col("conv") - F.col("conv") % FAMILY)
        .join(lead, "family", "left")
        .drop("family", "conv")
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = row_numbers()
        names = ["id", "conv", "start", "first", "keys", "sizes", "before", "total", "ends"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(),
                 pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            rows = (_rebuilt(row) for row in batch.to_pylist())
            found = [(next(numbers), *row) for row in rows if row]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found), kinds)], names
                )

    out = written(
        runs.drop("n", "hash", "bytes").join(told, "run").mapInArrow(
            build,
            schema(id="bigint", conv="bigint", start="bigint", first="binary", keys="binary",
                   sizes="array<bigint>", before="bigint", total="bigint", ends="boolean"),
        ),
        "segments",
    )
    forget(carried, heads)
    return out


def _rebuilt(row: dict) -> tuple | None:
    """Conversation, start, first key, keys, sizes, bytes before, bytes in all, whether it ends."""
    skipped = zlib.crc32(str(row["conv"]).encode()) % SHARED
    shared = b"".join(row["lead"] or [])[: 16 * skipped]
    shared_sizes = (row["lead_sizes"] or [])[:skipped]
    own_head, own_sizes = b"".join(row["own"])[: 16 * skipped], row["own_sizes"][:skipped]
    total = sum(shared_sizes) + row["all_bytes"] - sum(own_sizes)
    offset, n = row["offset"], len(row["sizes"])
    # The run's turns from this one on are kept.
    drop = min(max(skipped - offset, 0), n)
    turns, sizes = row["turns"][16 * drop :], row["sizes"][drop:]
    ends = offset + n == row["all_turns"]
    if offset == 0:
        keys = extended(0, shared + turns)
        ends = ends or row["all_turns"] <= skipped
        return (row["conv"], 0, _ROOT, b"".join(map(_key, keys)), shared_sizes + sizes, 0, total, ends)
    if not sizes:
        return None
    number = extended(0, shared)[-1] if shared else 0
    at = offset + drop
    if at > skipped:
        # Own turns after the skipped ones, up to this run, by the difference of hashes.
        head = extended(0, own_head)[-1] if own_head else 0
        between = pow(_BASE, at - skipped, _PRIME)
        number = (_number(row["before_hash"]) + (number - head) * between) % _PRIME
    before = sum(shared_sizes) + row["before"] + sum(row["sizes"][:drop]) - sum(own_sizes)
    start = len(shared) // 16 + at - skipped
    keys = b"".join(map(_key, extended(number, turns)))
    return (row["conv"], start, _key(number), keys, sizes, before, total, ends)


def _end_digests(segments: DataFrame) -> DataFrame:
    """Per end of a conversation: SHA-256 of the ids that end there, joined in order.

    Ids are joined over range partitions first, so that the task that digests a node
    gets a row for every ``CHUNK`` characters and not one for every id.
    """
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = segments.filter("ends").select(
        "conv", (F.col("start") + F.size("sizes")).alias("depth"),
        F.when(F.size("sizes") > 0, F.expr("substring(keys, length(keys) - 15, 16)"))
        .otherwise(F.col("first")).alias("key"),
    )
    order = ["key", "depth", "conv"]
    dealt = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, node, ids, size = row_numbers(), None, [], 0
        out: list[tuple] = []

        def close() -> None:
            if ids:
                out.append((*node, next(numbers), ",".join(ids)))
                ids.clear()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                ["key", "depth", "nth", "ids"],
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "depth", "conv")))
            for key, depth, conv in rows:
                if (key, depth) != node or size > CHUNK:
                    close()
                    node, size = (key, depth), 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield batch_of(out)
                out = []
        close()
        if out:
            yield batch_of(out)

    joined = dealt.select("key", "depth", "conv").mapInArrow(
        join, schema(key="binary", depth="bigint", nth="bigint", ids="string")
    )
    # Numbers rise with the partitions, so with the ids of a node.
    sorted_ = joined.repartition(parts, "key", "depth").sortWithinPartitions("key", "depth", "nth")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                ["key", "depth", "ends_sha256"],
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "depth", "ids")))
            for key, depth, ids in rows:
                if (key, depth) == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (key, depth), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield batch_of(out)
                out = []
        if node:
            yield batch_of([(*node, state.hexdigest())])

    return sorted_.mapInArrow(digest, schema(key="binary", depth="bigint", ends_sha256="string"))


def prefix_trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, the empty one included.

    ``key`` and ``parent`` identify a prefix and the one before its last turn. ``conv_id``
    is the smallest conversation with the prefix, ``parent_conv_id`` that of its parent
    (null for the root). ``saved_bytes`` adds up, over the prefixes that extend a prefix
    and itself, what keeping its last text once saves. Turns without a number come first;
    those of one number are ordered by a digest of role and text. A null role or text is
    empty. Rows without a conversation id belong to no conversation and are left out;
    repeated rows are turns of their own. Other columns are not used. No rows give no
    prefixes.
    """
    runs = _runs(conversations, conv, turn, role, text)
    segments = _segments(runs)
    forget(runs)
    node = ["key", "depth"]
    nodes = written(
        _summed(segments, [F.lit(1).cast("bigint").alias("_x"), F.col("total").alias("_y")],
                F.col("conv")),
        "nodes",
    )
    children = nodes.filter("depth > 0").groupBy(
        F.col("parent").alias("key"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count("*").alias("n_children"))
    counted = written(
        nodes.join(children, node, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0))),
        "counted",
    )
    forget(nodes)
    # A conversation owns the nodes that it is the smallest through, from this depth on.
    owners = counted.groupBy(F.col("least").alias("conv")).agg(
        F.min(F.struct("depth", "before")).alias("top"),
        F.max(F.expr("int(n_children = 0)")).cast("bigint").alias("leaf"),
    ).select("conv", F.col("top.before").alias("owned_from"), F.col("top.depth").alias("top"), "leaf")
    weights = segments.select("id", "conv", "total").join(owners, "conv").select(
        "id", (F.col("total") - F.col("owned_from")).alias("owned"), "owned_from", "leaf"
    )
    below = _summed(
        segments.select("id", "start", "first", "keys", "sizes", "before").join(weights, "id"),
        [F.col("owned").alias("_x"), F.col("leaf").alias("_y")], F.col("owned_from"),
    ).select(
        *node, F.col("sum_0").alias("owned"), F.col("sum_1").alias("n_leaves"),
        F.col("least").alias("owned_from"),
    )
    total = counted.count()
    # Below its top, the owner of a node owns the parent as well; tops look theirs up.
    tops = counted.filter("depth > 0").join(
        owners.select(F.col("conv").alias("least"), F.col("top").alias("depth")),
        ["least", "depth"],
    ).select("key", "depth", F.col("parent"), (F.col("depth") - 1).alias("above"))
    parents = heavy_split(
        tops,
        counted.filter("n_children > 0").select(
            F.col("key").alias("parent"), F.col("depth").alias("above"),
            F.col("least").alias("parent_conv"), "n_children",
        ),
        ["parent", "above"], "n_children", max(total, 1),
    ).select(*node, "parent_conv")
    no_end = hashlib.sha256(b"").hexdigest()
    start = F.col("before")
    shared = F.col("sum_1") - F.col("sum_0") * start
    distinct = F.col("owned") - (start - F.col("owned_from"))
    return (
        counted.join(below, node)
        .join(parents, node, "left")
        .join(_end_digests(segments), node, "left")
        .select(
            "key",
            F.when(F.col("depth") > 0, F.col("parent")).alias("parent"),
            F.col("least").alias("conv_id"), "depth",
            F.when(F.col("depth") > 0, F.coalesce("parent_conv", "least")).alias("parent_conv_id"),
            F.col("sum_0").alias("n_convs"), "n_children", "n_leaves",
            (shared - distinct).alias("saved_bytes"),
            F.coalesce("ends_sha256", F.lit(no_end)).alias("ends_sha256"),
        )
    )


def op13_zfast_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefixes of all conversations; a token is a byte here."""
    return prefix_trie(table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved_bytes").alias("saved_tokens"), "ends_sha256",
    )


def _crc_table() -> list[int]:
    """What the CRC-32 of a byte adds, for every byte: eight shifts by the polynomial."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


#: All prefixes written out, and all pairs of a prefix and one that extends it.
SQL = f"""
    WITH own AS (
        SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
            ORDER BY turn NULLS FIRST, role, text) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ), hashed AS (
        SELECT *, xor(list_reduce(
            list_concat([4294967295], list_transform(
                string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda a, x: xor(a >> 8, {_crc_table()}[xor(a & 255, x) + 1])), 4294967295) % 9 AS h
        FROM own
    ), rebuilt AS (
        SELECT o.c, list_concat(coalesce(l.turns, [])[1:o.h], o.turns[o.h + 1:]) AS r
        FROM hashed o LEFT JOIN own l ON l.c = o.c - o.c % 5
    ), prefixes AS (
        SELECT c, len(r) AS size, unnest(range(len(r) + 1)) AS d, r FROM rebuilt
    ), keyed AS (
        SELECT c, d, size, sha256(CAST(to_json(r[1:d]) AS VARCHAR)) AS k,
            CASE WHEN d > 0 THEN sha256(CAST(to_json(r[1:d - 1]) AS VARCHAR)) END AS up,
            CASE WHEN d > 0 THEN strlen(r[d].t) ELSE 0 END AS bytes
        FROM prefixes
    ), nodes AS (
        SELECT k, d AS depth, min(up) AS up, min(bytes) AS bytes, min(c) AS conv_id,
            count(*) AS n_convs,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), ''))
                AS ends_sha256
        FROM keyed GROUP BY k, d
    ), children AS (
        SELECT up AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up
    ), below AS (
        SELECT a.k, count(*) FILTER (m.n_children IS NULL) AS n_leaves,
            CAST(sum((n.n_convs - 1) * n.bytes) AS BIGINT) AS saved_tokens
        FROM nodes n
        JOIN keyed w ON w.c = n.conv_id AND w.d = n.depth
        JOIN keyed a ON a.c = w.c AND a.d <= w.d
        LEFT JOIN children m ON m.k = n.k
        GROUP BY a.k
    )
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
        coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
    FROM nodes n LEFT JOIN nodes p ON p.k = n.up LEFT JOIN children c ON c.k = n.k
    JOIN below b ON b.k = n.k
"""

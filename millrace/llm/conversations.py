"""The trie of conversations that share their first turns.

Conversations are sequences of turn fingerprints; equal ones are one class.
Classes are range-partitioned and sorted, so those below one trie node stand
side by side, and the depth to which two neighbours agree (LCP) is an edge
between them.  Union-find takes a block's edges from the deepest to the root:
each merge of components at a depth opens, or widens, the node of that depth,
and a component's node then stands for the chain of nodes down from there.

A block knows everything about a node that touches neither of its ends.  Nodes
on the way to its first and last class may go on in other blocks: a block only
gives partial rows for them.  These contracted forests are merged by node, each
node is owned by one of the ways it lies on, and sums over subtrees run up the
ways, one window each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.exchange import arrow_schema, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a turn's fingerprint.
TURN = 16
#: Turns in a block; a longer conversation is a block of its own.
BLOCK_TURNS = 1 << 19
#: Ids in one piece of text that goes into a digest.
PIECE_IDS = 1 << 15
NOTHING = hashlib.sha256(b"").hexdigest()

_INNER = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, way string"
)
# of a node on a way: what a block has below it, without other nodes on ways
_WAY = (
    "way string, depth long, node binary, parent binary, low long, n_convs long, words long, ends_sha256 string, "
    "inner_children long, inner_leaves long, inner_saved long"
)
_BOTH = "inner boolean, " + _INNER + ", node binary, parent binary, low long, words long, inner_children long, inner_leaves long, inner_saved long"


def rebuilt(conversations: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """(conv_id, seq, words): each conversation's turns behind those it shares with its group's first.

    ``seq`` has 16 bytes for each turn, ``words`` the words of its text.  The
    first ``crc32(conv_id) % shared`` turns come from the conversation
    ``conv_id - conv_id % group`` where there is one.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("key"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    own = (
        conversations.where(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))  # nulls first, then by turn
    )
    own = stored(own, "turns")
    heads = own.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, shared - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    with_base = own.select(
        "conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    ).join(heads, "base", "left")
    taken = F.when(F.col("head").isNull(), F.filter("turns", lambda _: F.lit(False))).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = F.when(F.col("conv_id") == F.col("base"), F.col("turns")).otherwise(F.concat(taken, rest))
    return with_base.select("conv_id", turns.alias("turns")).select(
        "conv_id",
        F.unhex(F.array_join("turns.key", "")).alias("seq"),
        F.col("turns.words").alias("words"),
    )


def id_digests(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, ends_sha256): SHA-256 of a key's numbers as decimals, ascending, joined by commas.

    A digest has to read its numbers in order.  They are sorted by ranges across
    the cluster, so a key of any size is cut into pieces of text; only the
    pieces then pass one hash, one after the other, and are never held together.
    """
    piece = f"{key} binary, first long, piece string"
    cut_to, made = arrow_schema(piece), arrow_schema(f"{key} binary, ends_sha256 string")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, numbers = part.column(key).to_pylist(), part.column(number).to_numpy()
            at = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            rows = [
                (keys[i], int(numbers[i]), ",".join(map(str, numbers[i : min(i + PIECE_IDS, e)].tolist())))
                for s, e in zip(at[:-1], at[1:], strict=True)
                for i in range(s, e, PIECE_IDS)
            ]
            yield pa.RecordBatch.from_pylist([{key: k, "first": n, "piece": p} for k, n, p in rows], schema=cut_to)

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, hashlib.sha256()
        for part in parts:
            done: list[dict] = []
            for k, text in zip(part.column(key).to_pylist(), part.column("piece"), strict=True):
                if k != held:
                    if held is not None:
                        done.append({key: held, "ends_sha256": state.hexdigest()})
                    held, state = k, hashlib.sha256(text.as_py().encode())
                else:
                    state.update(b"," + text.as_py().encode())
            yield pa.RecordBatch.from_pylist(done, schema=made)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{key: held, "ends_sha256": state.hexdigest()}], schema=made)

    pieces = stored(
        rows.select(key, number).repartitionByRange(key, number).sortWithinPartitions(key, number).mapInArrow(cut, piece),
        "pieces",
    )
    return pieces.repartition(key).sortWithinPartitions(key, "first").select(key, "piece").mapInArrow(
        hashed, f"{key} binary, ends_sha256 string"
    )


class _Node:
    """A node that is open: depth, members, least id, sums below it, its classes' range, rows that wait for it."""

    __slots__ = ("depth", "n", "low", "children", "leaves", "saved", "left", "right", "ends", "waiting")

    def __init__(self, depth, n, low, left, right, ends=None):
        self.depth, self.n, self.low, self.left, self.right, self.ends = depth, n, low, left, right, ends
        self.children = self.leaves = self.saved = 0
        self.waiting: list[list] = []


def common_depth(x: bytes, y: bytes) -> int:
    """How many turns two sequences share from the start."""
    size = min(len(x), len(y))
    if x[:size] == y[:size]:
        return size // TURN
    a, b = np.frombuffer(x, np.uint8, size), np.frombuffer(y, np.uint8, size)
    return int(np.flatnonzero(a != b)[0]) // TURN


def node_key(seq: bytes, depth: int) -> bytes:
    return hashlib.md5(seq[: depth * TURN]).digest()


def forest(name: str, classes: list[tuple]) -> tuple[list[list], list[list]]:
    """A block's finished rows and its partial rows, of sorted distinct classes (seq, words, n, low, ends).

    A finished row whose parent is on a way names the way instead of the parent.
    """
    last = len(classes) - 1
    lcp = [common_depth(classes[i][0], classes[i + 1][0]) for i in range(last)]
    reach = common_depth(classes[0][0], classes[last][0])
    parent = list(range(len(classes)))
    top = [_Node(len(c[0]) // TURN, c[2], c[3], i, i, c[4]) for i, c in enumerate(classes)]
    finished: list[list] = []
    spine: dict[tuple[str, int], _Node] = {}

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def on_way(node: _Node) -> bool:
        return node.left == 0 or node.right == last

    def close(node: _Node, down_to: int) -> tuple[list | None, int, int]:
        """Ends a node and the chain above it, to depth ``down_to``: its top row, and what is below the chain's end.

        The row is None if the chain lies on a way.
        """
        words = classes[node.left][1]
        edge = on_way(node)
        way = name + ("L" if node.left == 0 else "R")
        for row in node.waiting:
            if edge:
                # both ways hold a node above the depth that the first and the last class share
                row[8] = way
            else:
                row[2] = node.low
        row, leaves, saved = None, node.leaves, node.saved
        children, ends = node.children, node.ends
        for depth in range(node.depth, down_to, -1):
            if edge:
                kept = _Node(depth, node.n, node.low, node.left, node.right, ends)
                kept.children, kept.leaves, kept.saved = children, leaves, saved
                spine[way, depth] = kept
                children, ends = 0, None  # the next one's child is on the way itself
                continue
            if not children:
                leaves = 1
            saved += (node.n - 1) * words[depth - 1]
            if row is not None:
                row[2] = node.low
                finished.append(row)
            row = [node.low, depth, None, node.n, children, leaves, saved, ends or NOTHING, None]
            children, ends = 1, None
        return row, leaves, saved

    def hang(node: _Node, child: _Node) -> None:
        row, leaves, saved = close(child, node.depth)
        node.leaves += leaves
        node.saved += saved
        if row is not None:
            node.children += 1
            node.waiting.append(row)
            finished.append(row)

    for i in sorted(range(last), key=lambda i: -lcp[i]):
        left, right = find(i), find(i + 1)
        x, y, depth = top[left], top[right], lcp[i]
        if x.depth == depth:
            node = x
            into, others = left, [y]
        elif y.depth == depth:
            node = y
            into, others = right, [x]
        else:
            node = _Node(depth, 0, None, x.left, y.right)
            into, others = left, [x, y]
        for other in others:
            if other.depth == depth:  # two widths of one node
                node.children += other.children
                node.leaves += other.leaves
                node.saved += other.saved
                node.waiting += other.waiting
                node.ends = node.ends or other.ends
            else:
                hang(node, other)
            node.n += other.n
            node.low = other.low if node.low is None else min(node.low, other.low)
        node.left, node.right = x.left, y.right
        parent[right if into == left else left] = into
        top[into] = node
    whole = top[find(0)]
    close(whole, -1)
    if whole.depth == 0 and (name + "L", 0) not in spine:
        raise AssertionError("a block's root is on its way")

    ways: list[list] = []
    for way, seq_of in ((name + "L", classes[0]), (name + "R", classes[last])):
        seq, words = seq_of[0], seq_of[1]
        for depth in range(len(seq) // TURN + 1):
            node = spine.get((way, depth))
            if node is None and not (way[-1] == "R" and depth <= reach):
                continue
            above = node_key(seq, depth - 1) if depth else None
            word = words[depth - 1] if depth else 0
            own = [node.low, node.n, word, node.ends, node.children, node.leaves, node.saved] if node else [None, 0, word, None, 0, 0, 0]
            ways.append([way, depth, node_key(seq, depth), above, *own])
    return finished, ways


def _blocks(classes: DataFrame) -> DataFrame:
    """Finished and partial rows of all blocks; the classes come sorted."""
    schema = arrow_schema(_BOTH)
    inner_names = [f.split(" ")[0] for f in _INNER.split(", ")]
    way_names = [f.split(" ")[0] for f in _WAY.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        prefix, number, held, turns = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            finished, ways = forest(f"{prefix}.{number}", held)
            rows = [dict(zip(inner_names, r, strict=True)) | {"inner": True} for r in finished]
            rows += [dict(zip(way_names, r, strict=True)) | {"inner": False} for r in ways]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for part in parts:
            columns = [part.column(c).to_pylist() for c in ("seq", "words", "n", "low", "ends_sha256")]
            for row in zip(*columns, strict=True):
                if held and turns + len(row[1]) > BLOCK_TURNS:
                    yield flush()
                    number, held, turns = number + 1, [], 0
                held.append(row)
                turns += len(row[1])
        if held:
            yield flush()

    return classes.select("seq", "words", "n", "low", "ends_sha256").mapInArrow(run, _BOTH)


def prefix_trie(conversations: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conversations`` has conv_id, turn, role, text; other columns are not read.
    A node is a sequence of first turns (role, text), the root the empty one.
    Columns: conv_id (smallest member), depth, parent_conv_id (the parent's
    conv_id, null for the root), n_convs, n_children, n_leaves (childless nodes
    below it or itself), saved_tokens (of each node below it and itself, words of
    its last text times its members but one), ends_sha256 (of the conv_ids that
    end there).

    Turns are ordered by turn, nulls first; rows with one turn by role and text's
    fingerprint, repeated rows are turns of their own.  Null roles and texts are
    empty.  Rows without conv_id belong to no conversation.  One conversation's
    fingerprints (20 bytes a turn, whatever its texts) are one row.  An empty
    table has no root and gives no row.
    """
    sequences = stored(rebuilt(conversations, group, shared).withColumn("sid", F.unhex(F.md5("seq"))), "sequences")
    ends = id_digests(sequences, "sid", "conv_id")
    classes = (
        sequences.groupBy("sid")
        .agg(
            F.first("seq").alias("seq"),
            F.first("words").alias("words"),
            F.count(F.lit(1)).alias("n"),
            F.min("conv_id").alias("low"),
        )
        .join(ends, "sid")
    )
    classes = stored(classes, "classes")
    rows = stored(_blocks(classes.repartitionByRange("seq").sortWithinPartitions("seq")), "nodes")
    result = [f.split(" ")[0] for f in _INNER.split(", ")][:-1]

    ways = rows.where(~F.col("inner"))
    merged = ways.groupBy("node").agg(
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.min("low").alias("low"),
        F.sum("n_convs").alias("n_convs"),
        F.max("words").alias("words"),
        F.max("ends_sha256").alias("ends"),
        *[F.sum(c).alias(c) for c in ("inner_children", "inner_leaves", "inner_saved")],
        F.min("way").alias("owner"),
    )
    merged = stored(merged, "ways")
    children = merged.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.count(F.lit(1)).alias("on_ways"))
    known = merged.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn(
        "n_children", F.col("inner_children") + F.coalesce("on_ways", F.lit(0))
    )
    known = stored(
        known.withColumns(
            {
                "own_leaf": (F.col("n_children") == 0).cast("long"),
                "own_saved": F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * F.col("words")).otherwise(0),
            }
        ),
        "ways",
    )
    # A node's own share goes to all nodes above it, and these are all on its owner's way.
    upward = Window.partitionBy("way").orderBy(F.desc("depth"))
    owned = known.select("node", F.col("owner").alias("way"), "own_leaf", "own_saved")
    summed = (
        ways.select("way", "depth", "node")
        .join(owned, ["node", "way"], "left")
        .select("node", *[F.sum(F.coalesce(c, F.lit(0))).over(upward).alias(c) for c in ("own_leaf", "own_saved")])
        .groupBy("node")
        .agg(F.sum("own_leaf").alias("way_leaves"), F.sum("own_saved").alias("way_saved"))
    )
    done = stored(
        known.join(summed, "node").select(
            "node",
            "parent",
            F.col("low").alias("conv_id"),
            "depth",
            "n_convs",
            "n_children",
            (F.col("inner_leaves") + F.col("way_leaves")).alias("n_leaves"),
            (F.col("inner_saved") + F.col("way_saved")).alias("saved_tokens"),
            F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
        ),
        "ways",
    )
    above = done.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    on_ways = done.join(above, "parent", "left").select(result)
    # The least conv_id of a way's node reaches the rows below it by block, so the root's children don't meet in one task.
    lows = ways.select("way", "depth", "node").join(done.select("node", F.col("conv_id").alias("parent_low")), "node")
    inner = rows.where("inner")
    below = (
        inner.where(F.col("way").isNotNull())
        .withColumn("up", F.col("depth") - 1)
        .join(lows.select("way", F.col("depth").alias("up"), "parent_low"), ["way", "up"])
        .withColumn("parent_conv_id", F.col("parent_low"))
    )
    return on_ways.unionByName(below.select(result)).unionByName(inner.where(F.col("way").isNull()).select(result))

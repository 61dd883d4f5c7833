"""Chat formatting as prefix trees.

Conversations that begin with the same turns share them: the turns form a
tree per first turn, each distinct prefix of turns being a node. A tree's
tokens are laid out depth-first, every shared turn once. Each node tells

* `start`: where its tokens begin in the tree's sequence,
* `position`: the position id of its first token (the following count up),
  which is the number of tokens on the way to it, as if its conversation
  stood alone,
* `attends`: the intervals [from, to) of the sequence that its tokens may
  attend to besides the causal part of the node itself, which is the last
  interval's end: the nodes on the way to it, neighbouring ones merged, and
  the node's own tokens.

A turn is written "<|role|>" + line feed + text + "<|endoftext|>"; all but the
end mark is ordinary text to the tokenizer.

Turns are tokenized by rows. A conversation's path is the row of its turns'
digests; sorted by path, its new nodes are those beyond what it shares with the
conversation before it, in the order of a depth-first walk. Only paths and
token counts are sorted so, in ranges over all tasks: neither a tree, nor
conversations with the same path, have to fit into one task. Each range is
walked twice. The first walk counts, as if nothing came before, and leaves a
summary as long as two conversations; from these the driver works out with
which open path, node number and offset each range begins. The second walk
gives the nodes, which are then joined with the tokens of the turn that brought
them in.

A row with a null conv_id is a node; one with a conv_id says at which node of
which tree that conversation ends.

Defined results: turns are ordered by number (null first), role and digest;
identical rows count once; rows without conv_id are ignored; a null role or
text is an empty one; equal conversations end at the same node; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera import scratch
from tessera.llm import bpe

END = 50256


def _turns(conversations: DataFrame, path: str, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, digest, n and tokens of each distinct row."""
    kind = conversations.schema[conv_col].dataType.simpleString()
    rows = conversations.select(
        conversations[conv_col].alias("conv_id"),
        conversations[turn_col].cast("long").alias("turn"),
        F.coalesce(conversations[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations[text_col].cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))).dropDuplicates(["conv_id", "turn", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lists, _ = bpe.encode_column(batch.column(4), path)
            size = np.asarray(lists.value_lengths(), dtype=np.int64)
            values = np.asarray(lists.flatten(), dtype=np.int32)
            edge = np.concatenate([[0], np.cumsum(size + 1)])
            out = np.full(int(edge[-1]), END, dtype=np.int32)
            inside = np.ones(len(out), dtype=bool)
            inside[edge[1:] - 1] = False
            out[inside] = values
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array((size + 1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(out))], ["conv_id", "turn", "digest", "role", "n", "tokens"])

    written = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text")
    return rows.select("conv_id", "turn", "digest", "role", written.alias("written")).mapInArrow(run, f"conv_id {kind}, turn bigint, digest string, role string, n int, tokens array<int>")


WIDTH = 16


def _paths(turns: DataFrame) -> DataFrame:
    """conv_id, its path (the digests of its turns in a row), and turn numbers and token counts along it."""
    entry = F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("o"), "role", "digest", "turn", "n")
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    along = lambda name: F.transform("t", lambda x: x[name])
    return ordered.select("conv_id", F.unhex(F.array_join(along("digest"), "")).alias("path"), along("turn").alias("turns"), along("n").alias("ns"))


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in intervals:
        if out and out[-1][1] == lo:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def shared_depth(one: bytes, two: bytes) -> int:
    """How many turns two paths have in common."""
    depth, most = 0, min(len(one), len(two)) // WIDTH
    while depth < most and one[depth * WIDTH : (depth + 1) * WIDTH] == two[depth * WIDTH : (depth + 1) * WIDTH]:
        depth += 1
    return depth


class Walk:
    """A depth-first walk over conversations in the order of their paths.

    State: the open path, the node numbers, starts and sizes along it, and how
    many nodes and tokens its tree has so far.
    """

    def __init__(self, path: bytes = b"", open_nodes: list[tuple[int, int, int]] | None = None, nodes: int = 0, tokens: int = 0):
        self.path, self.open, self.nodes, self.tokens = path, list(open_nodes or []), nodes, tokens

    def step(self, path: bytes, ns: list[int]) -> int:
        """Go to a conversation's end; the depth from which its nodes are new."""
        shared = shared_depth(self.path, path)
        if not shared:
            self.nodes = self.tokens = 0
        del self.open[shared:]
        for n in ns[shared:]:
            self.open.append((self.nodes, self.tokens, n))
            self.nodes, self.tokens = self.nodes + 1, self.tokens + n
        self.path = path
        return shared

    def state(self) -> tuple:
        return self.path, [x for node in self.open for x in node], self.nodes, self.tokens


SUMMARY = "range int, first binary, first_ns array<int>, alone boolean, path binary, open array<bigint>, nodes bigint, tokens bigint"
STATE = "range int, path binary, turns array<bigint>, ns array<int>, open array<bigint>, nodes bigint, tokens bigint"


def begin_states(summaries: list[tuple]) -> list[tuple]:
    """For each range in order (range, path, open, nodes, tokens): where its walk begins, from the walks of all as if nothing came before."""
    now, out = Walk(), []
    for number, first, first_ns, alone, path, flat, nodes, tokens in summaries:
        shared = shared_depth(now.path, first)
        if shared:
            start = Walk(now.path[: shared * WIDTH], now.open[:shared], now.nodes, now.tokens)
        else:
            start = Walk()
        out.append((number, *start.state()))
        local = list(zip(flat[0::3], flat[1::3], flat[2::3]))
        if alone:  # one tree throughout: what is shared has been counted twice
            more_nodes, more_tokens = start.nodes - shared, start.tokens - sum(first_ns[:shared])
            nodes, tokens = nodes + more_nodes, tokens + more_tokens
            local = [start.open[node] if node < shared else (node + more_nodes, at + more_tokens, n) for node, at, n in local]
        now = Walk(path, local, nodes, tokens)
    return out


def format_trees(conversations: DataFrame, path: str = bpe.VOCABULARY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Node rows (conv_id null): tree, node, parent, depth, role, start, position, attends and tokens; and of each conversation a row with conv_id, tree and node."""
    spark = conversations.sparkSession
    kind = conversations.schema[conv_col].dataType.simpleString()
    turns = scratch.materialise(_turns(conversations, path, conv_col, turn_col, role_col, text_col), "turns")
    ranged = _paths(turns.drop("tokens")).repartitionByRange("path", "conv_id").withColumn("range", F.spark_partition_id())
    paths = scratch.materialise(ranged, "paths")

    def in_order(rows: DataFrame, *more: str) -> DataFrame:
        return rows.repartition("range").sortWithinPartitions("range", *more, "path", "conv_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = walk = first = None
        out: list[tuple] = []

        def close() -> None:
            if number is not None:
                out.append((number, *first, first[0][:WIDTH] == walk.path[:WIDTH], *walk.state()))

        for batch in batches:
            for here, way, ns in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if here != number:
                    close()
                    number, walk, first = here, Walk(), (way, ns)
                walk.step(way, ns)
        close()
        if out:
            kinds = [pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["range", "first", "first_ns", "alone", "path", "open", "nodes", "tokens"])

    # a row a range, each as long as two conversations
    summaries = [(r.range, bytes(r.first), r.first_ns, r.alone, bytes(r.path), r.open, r.nodes, r.tokens) for r in in_order(paths).select("range", "path", "ns").mapInArrow(count, SUMMARY).collect()]
    states = [(n, way, None, None, flat, nodes, tokens) for n, way, flat, nodes, tokens in begin_states(sorted(summaries))]
    begins = spark.createDataFrame(states, STATE).withColumn("conv_id", F.lit(None).cast(kind))
    none = F.lit(None).cast("bigint")
    rows = paths.select("range", "path", "turns", "ns", F.lit(None).cast("array<bigint>").alias("open"), none.alias("nodes"), none.alias("tokens"), "conv_id").unionByName(begins)
    rows = in_order(rows.withColumn("later", F.col("open").isNull()), "later").drop("later")
    id_type = to_arrow_type(conversations.schema[conv_col].dataType)
    edges = pa.struct([("from", pa.int64()), ("to", pa.int64())])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(edges), id_type, pa.int64(), pa.string(), pa.bool_()]
    names = ["tree", "node", "parent", "depth", "start", "position", "attends", "conv_id", "turn", "digest", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

        walk = Walk()
        for batch in batches:
            for _, way, numbers, ns, flat, nodes, tokens, conv in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if flat is not None:
                    walk = Walk(way, list(zip(flat[0::3], flat[1::3], flat[2::3])), nodes, tokens)
                    continue
                shared = walk.step(way, ns)
                tree = way[:WIDTH].hex()
                if shared < len(ns):
                    position = sum(n for _, _, n in walk.open[:shared])
                    attends = _merged([(at, at + n) for _, at, n in walk.open[:shared]])
                    for depth in range(shared, len(ns)):
                        node, at, n = walk.open[depth]
                        attends = _merged([*attends, (at, at + n)])
                        held.append((tree, node, walk.open[depth - 1][0] if depth else None, depth, at, position, [{"from": x, "to": y} for x, y in attends], conv, numbers[depth], way[depth * WIDTH : (depth + 1) * WIDTH].hex(), False))
                        position += n
                held.append((tree, walk.open[-1][0], None, None, None, None, None, conv, None, None, True))
                if len(held) >= 5_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    found = scratch.materialise(rows.mapInArrow(run, f"tree string, node bigint, parent bigint, depth int, start bigint, position bigint, attends array<struct<from:bigint,to:bigint>>, conv_id {kind}, turn bigint, digest string, ends boolean"), "nodes")
    a, b = found.where("not ends").alias("a"), turns.alias("b")
    joined = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & F.col("a.turn").eqNullSafe(F.col("b.turn")) & (F.col("a.digest") == F.col("b.digest")))
    nodes = joined.select(F.lit(None).cast(kind).alias("conv_id"), "a.tree", "a.node", "a.parent", "a.depth", "b.role", "a.start", "a.position", "a.attends", "b.tokens")
    ends = found.where("ends").select("conv_id", "tree", "node", *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("parent", "depth", "role", "start", "position", "attends", "tokens")))
    return nodes.unionByName(ends)

"""A trie over conversations: double arrays in shards of neighbouring prefixes, shared upper nodes merged globally.

A turn is known by the digest of its role and text, so texts are read once and never exchanged.  Rebuilt conversations,
as strings of digests, are dealt out in their order: a shard is a run of neighbours, even where a third of all conversations
share their first turns or are wholly alike.  Each shard numbers its turns densely in the order of the levels, which gives
siblings neighbouring numbers, packs the transitions into BASE and CHECK and walks its conversations through them.  Only
the nodes on the way that two neighbouring shards have in common are *open*: a shard counts as its own what no earlier shard has, so
the figures of an open node are sums over its shards, and all other nodes are complete where they lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .registry import query, table

#: Bytes of a turn's digest in a key.
DIGEST = 16
TURNS_A_SHARD = 1 << 17
#: Free places tried for a node with several children before it goes to the end of the arrays.
TRIES = 32
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
        "open boolean, key binary, parent_key binary, ends string, shard long")


class DoubleArray:
    """Transitions of a trie over dense codes: from ``state``, code c leads to ``base[state] + c`` if ``check`` there is ``state``.

    Built from nodes in level order, node 0 being the root (state 0): the parent and the code of each.  ``state_of`` gives each node's state.
    """

    def __init__(self, parents: np.ndarray, codes: np.ndarray):
        nodes = len(parents)
        # children of a node lie together, as nodes come level by level
        children = np.bincount(parents[1:], minlength=nodes)
        first = np.cumsum(children) - children + 1
        size, used = 1, np.zeros(2 * nodes + 2, bool)
        used[0] = True
        shift, free = np.zeros(nodes, np.int64), 1
        for node in np.flatnonzero(children > 1):
            own = np.sort(codes[first[node] : first[node] + children[node]])
            while free < size and used[free]:
                free += 1
            at, place = free, size
            for _ in range(TRIES):
                if at >= size:
                    break
                spots = at - own[0] + own
                if not used[spots[spots < size]].any():
                    place = at
                    break
                at += 1
            shift[node] = place - own[0]
            end = int(shift[node] + own[-1] + 1)
            if end > len(used):
                used = np.concatenate((used, np.zeros(max(end, 2 * len(used)) - len(used), bool)))
            size = max(size, end)
            used[shift[node] + own] = True
        single = np.flatnonzero(children == 1)
        holes = np.flatnonzero(~used[:size])[: len(single)]
        spots = np.concatenate((holes, np.arange(size, size + len(single) - len(holes))))
        size = max(size, int(spots[-1]) + 1 if len(spots) else 1)
        shift[single] = spots - codes[first[single]]
        self.state_of = np.zeros(nodes, np.int64)
        self.state_of[1:] = shift[parents[1:]] + codes[1:]
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[self.state_of] = shift
        self.check[self.state_of[1:]] = self.state_of[parents[1:]]

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states that the codes lead to; -1 where there is no such transition."""
        to = self.base[states] + codes
        inside = (to >= 0) & (to < len(self.check)) & (codes >= 0)
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def levels_of(codes: np.ndarray, depths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Level by level: which sequences have a turn there, and its place in ``codes``."""
    starts = np.cumsum(depths) - depths
    active = np.flatnonzero(depths > 0)
    for level in range(int(depths.max(initial=0))):
        yield active, starts[active] + level
        active = active[depths[active] > level + 1]


def level_codes(keys: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Dense turn numbers, by first occurrence along the levels: siblings get neighbouring numbers."""
    _, turns = np.unique(keys, return_inverse=True)
    order = np.concatenate([np.zeros(0, np.int64), *(places for _, places in levels_of(turns, depths))])
    _, first = np.unique(turns[order], return_index=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[turns]


def build(codes: np.ndarray, depths: np.ndarray) -> tuple[DoubleArray, np.ndarray, np.ndarray, np.ndarray]:
    """The double array of sorted sequences, with parent, depth and a place in ``codes`` of every node."""
    parents, depth, place = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.full(1, -1, np.int64)]
    at, n = np.zeros(len(depths), np.int64), 1
    for level, (active, places) in enumerate(levels_of(codes, depths), 1):
        parent, code = at[active], codes[places]
        new = np.concatenate(([True], (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])))
        at[active] = n + np.cumsum(new) - 1
        parents.append(parent[new])
        place.append(places[new])
        depth.append(np.full(int(new.sum()), level))
        n += int(new.sum())
    parents, depth, place = np.concatenate(parents), np.concatenate(depth), np.concatenate(place)
    node_codes = np.concatenate(([-1], codes[place[1:]])) if n > 1 else np.full(1, -1, np.int64)
    return DoubleArray(parents, node_codes), parents, depth, place


def common_turns(a: bytes | None, b: bytes | None) -> int:
    """Turns that two keys share at their start; -1 if one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(k[: n * DIGEST], f"S{DIGEST}") for k in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def shard_nodes(rows: pa.Table, neighbours: pa.Table) -> pa.Table:
    """All nodes of one shard.

    ``n_convs`` and ``saved_tokens`` of an open node are those of this shard, its children those that no earlier shard has,
    its leaves those that no later one has.  ``ends`` lists its members that end there; ``parent_key`` names an open parent.
    """
    rows = rows.sort_by([("key", "ascending"), ("conv_id", "ascending")])
    conv, keys = rows.column("conv_id").to_numpy(), rows.column("key").to_pylist()
    depths = np.array([len(k) // DIGEST for k in keys], np.int64)
    lengths = rows.column("lengths").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    codes = level_codes(np.frombuffer(b"".join(keys), f"S{DIGEST}"), depths)
    trie, parents, depth, place = build(codes, depths)
    before, after, shard = neighbours.column("before")[0].as_py(), neighbours.column("after")[0].as_py(), rows.column("shard")[0].as_py()
    seen, shared = common_turns(before, keys[0]), common_turns(keys[-1], after)

    # every conversation walks through the arrays; a node is where it is counted
    node = np.full(len(trie.check), -1, np.int64)
    node[trie.state_of] = np.arange(len(parents))
    n = len(parents)
    members, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    states = np.zeros(len(conv), np.int64)
    members[0], least[0] = len(conv), conv.min()
    paths = {0: [0], len(conv) - 1: [0]}
    for active, places in levels_of(codes, depths):
        states[active] = trie.step(states[active], codes[places])
        here = node[states[active]]
        members += np.bincount(here, minlength=n)
        np.minimum.at(least, here, conv[active])
        for i in paths:
            if len(active) and active[0 if i == 0 else -1] == i:
                paths[i].append(int(here[0 if i == 0 else -1]))
    last_of = node[states]

    counted_before, counted_after = np.zeros(n, bool), np.zeros(n, bool)
    counted_before[paths[0][: seen + 1]] = True
    counted_after[paths[len(conv) - 1][: shared + 1]] = True
    is_open = counted_before | counted_after
    has_child = np.zeros(n, bool)
    has_child[parents[1:]] = True
    children = np.bincount(parents[1:][~counted_before[1:]], minlength=n)
    leaves = (~has_child & ~counted_after).astype(np.int64)
    own = np.where(place >= 0, lengths[place] if len(lengths) else 0, 0)
    saved = (members - ~counted_before) * own
    level_start = np.searchsorted(depth, np.arange(int(depth[-1]) + 2))
    for level in range(int(depth[-1]), 0, -1):
        low, high = level_start[level], level_start[level + 1]
        for sums in (leaves, saved):
            np.add.at(sums, parents[low:high], sums[low:high])

    # members that end in a node are neighbours in the shard, in the order of their ids
    ends, digests = [None] * n, [hashlib.sha256(b"").hexdigest()] * n
    cuts = np.flatnonzero(np.concatenate(([True], last_of[1:] != last_of[:-1], [True])))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        text, k = ",".join(map(str, conv[low:high].tolist())), int(last_of[low])
        ends[k], digests[k] = (text, None) if is_open[k] else (None, hashlib.sha256(text.encode()).hexdigest())
    names: list[bytes | None] = [None] * n
    for i, path in paths.items():
        digest = hashlib.sha256()
        for level, k in enumerate(path):
            if not is_open[k]:
                break
            digest.update(keys[i][DIGEST * (level - 1) : DIGEST * level] if level else b"")
            names[k] = digest.digest()
    parent_open = is_open[parents]
    parent_open[0] = False
    parent_conv = [None if k == 0 or parent_open[k] else int(least[parents[k]]) for k in range(n)]
    parent_names = [names[parents[k]] if parent_open[k] else None for k in range(n)]
    closed_digest = [None if o else d for o, d in zip(is_open.tolist(), digests, strict=True)]
    return pa.table({
        "conv_id": pa.array(least), "depth": pa.array(depth), "parent_conv_id": pa.array(parent_conv, pa.int64()), "n_convs": pa.array(members),
        "n_children": pa.array(children), "n_leaves": pa.array(leaves), "saved_tokens": pa.array(saved), "ends_sha256": pa.array(closed_digest, pa.string()),
        "open": pa.array(is_open), "key": pa.array(names, pa.binary()), "parent_key": pa.array(parent_names, pa.binary()), "ends": pa.array(ends, pa.string()),
        "shard": pa.array([shard] * n, pa.int64())})


def rebuilt(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, group: int, spread: int) -> DataFrame:
    """(conv_id, key, lengths): conversations as strings of turn digests, with the code points of every text.

    The first h turns are those of the conversation that opens the group of ``group`` ids, h being the CRC-32 of the decimal id
    modulo ``spread``; then come the own turns after the first h.  A group meets in one task: ``group`` conversations at most.
    """
    said, words = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lean = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), said.alias("role"), words.alias("text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * DIGEST)
    turns = lean.filter("conv_id IS NOT NULL").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("opener"), F.struct("turn", digest.alias("digest"), F.length("text").alias("length")).alias("t"))
    own = turns.repartition("opener").groupBy("opener", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    first = own.filter("conv_id = opener").select("opener", F.slice("own", 1, spread).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int")
    both = own.join(first, "opener", "left").withColumn("h", h).withColumn("all", F.concat(
        F.slice(F.coalesce("head", F.array().cast(own.schema["own"].dataType)), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))))
    return both.select(
        "conv_id", F.unhex(F.array_join(F.transform("all", lambda t: t["digest"]), "")).alias("key"), F.transform("all", lambda t: t["length"]).alias("lengths"))


def open_ends(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256) of open nodes: the lists of their shards, hashed one after the other as they stream by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key == at:
                    digest.update(b"," + text.encode())
                else:
                    if at is not None:
                        yield result()
                    at, digest = key, hashlib.sha256(text.encode())
        if at is not None:
            yield result()

    pieces = nodes.filter("open AND ends IS NOT NULL").select("key", "shard", "ends")
    return pieces.repartition("key").sortWithinPartitions("key", "shard").drop("shard").mapInArrow(run, "key binary, ends_sha256 string")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                group: int = 100, spread: int = 6, turns_a_shard: int = TURNS_A_SHARD) -> DataFrame:
    """A row per node of the trie over rebuilt conversations, see ``RESULT``.

    Null role or text is empty; turns without a number come first; turns of the same number, repeated ones too, all
    count, in the order of their digests.  Rows without a conversation id belong to none and are left out.  No
    conversations give no rows, not even a root.  A conversation and the 100 of its group must fit a task.  Other columns are not read.
    """
    spark = conversations.sparkSession
    sequences = cut_lineage(rebuilt(conversations, conv_id, turn, role, text, group, spread))
    total = sequences.agg(F.coalesce(F.sum(F.size("lengths") + 1), F.lit(0))).first()[0]
    shards = max(spark.sparkContext.defaultParallelism, -(-total // turns_a_shard))
    # the ranges are written down, as a second evaluation could draw other bounds
    dealt = cut_lineage(sequences.repartitionByRange(shards, "key", "conv_id").withColumn("shard", F.spark_partition_id().cast("long")))
    edges = dealt.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # one row per shard
    along = Window.orderBy("shard")
    neighbours = edges.select("shard", F.lag("last").over(along).alias("before"), F.lead("first").over(along).alias("after"))
    nodes = cut_lineage(dealt.groupBy("shard").cogroup(neighbours.groupBy("shard")).applyInArrow(shard_nodes, NODE))

    parts = nodes.filter("open")
    merged = cut_lineage(parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]))
    ids = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    upper = merged.join(ids, "parent_key", "left").join(open_ends(nodes), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))
    # an open parent is looked up by shard and key, so that no key holds more than a shard
    by_shard = parts.select("shard", F.col("key").alias("parent_key")).join(ids, "parent_key")
    closed = nodes.filter(~F.col("open"))
    complete = closed.filter("parent_key IS NULL")
    below = closed.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(by_shard, ["shard", "parent_key"])
    return upper.select(RESULT).union(complete.select(RESULT)).union(below.select(RESULT))


SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i AS value, 0 AS n FROM range(256) r(i)
  UNION ALL
  SELECT byte, CASE WHEN value % 2 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, n + 1 FROM steps WHERE n < 8),
crc AS (SELECT list(value ORDER BY byte) AS t FROM steps WHERE n = 8),
turns AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, own,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                         lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM turns, crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(o.own, [])[1:c.h], c.own[c.h + 1:]) AS seq
  FROM hashed c LEFT JOIN turns o ON o.conv_id = c.conv_id - c.conv_id % 100),
paths AS (SELECT conv_id, unnest(range(len(seq) + 1)) AS depth, seq, len(seq) AS n FROM rebuilt),
members AS (SELECT conv_id, depth, n, seq[1:depth] AS path FROM paths),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(path[depth].t) END AS saved, max(n) = depth AS leaf
  FROM members GROUP BY path, depth),
subtree AS (
  SELECT a.path[1:k] AS path, sum(a.saved) AS saved_tokens, count(*) FILTER (WHERE a.leaf) AS n_leaves
  FROM (SELECT path, depth, saved, leaf, unnest(range(depth + 1)) AS k FROM nodes) a GROUP BY a.path[1:k]),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN subtree s ON s.path = x.path LEFT JOIN kids k ON k.path = x.path
LEFT JOIN nodes p ON x.depth > 0 AND p.path = x.path[1:x.depth - 1]
"""


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark, folder):
    return prefix_trie(table(spark, folder, "conversations"))

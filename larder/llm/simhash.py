"""SimHash near-duplicates by pivot distance tables.

1. Every document gets a 64-bit fingerprint; equal ones become one row, so copies never meet.
2. Every distinct fingerprint gets its *pivot table row*: its Hamming distances to 16 reference fingerprints.
3. Rows that may link meet in groups.  Of ``r + k`` blocks of bits at least ``k`` agree when at most ``r``
   bits differ, so a row joins one group per choice of ``k`` blocks.  Pivot distances alone give no
   such key: two unrelated fingerprints are within 3 of each other at one reference in nearly half of all cases.
4. In a group the rows lie in the order of their first pivot distance.  A pair is discarded when any two
   distances to the same reference differ by more than ``r`` (triangle inequality); survivors are verified on all bits.
5. Groups of more than ``limit`` rows go on to a finer choice of blocks.  At the finest, the agreeing blocks
   leave at most 12 bits free, which bounds a group by 4,096 fingerprints whatever the data are.
6. Links become a spanning forest inside each group, and components over all groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import PLACE, keep_rows, row_name, with_place
from .graph import components
from .registry import query, table

RADIUS = 3
#: Blocks into which the 64 bits are cut, coarse to fine; all but ``RADIUS`` of them agree.
CUTS = (5, 8, 16)
LIMIT = 4096
PIVOTS = [int(x) for x in np.random.default_rng(64).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.arange(16, dtype=np.uint64) % np.uint64(2)]
PIECE = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words: int) -> int:
    """Bitwise majority over the hashes of all shingles, repeats included."""
    tokens = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not tokens:
        return 0
    whole = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) > words:
        starts, ends = starts[: -(words - 1) or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), PIECE):
        span = zip(starts[i : i + PIECE].tolist(), ends[i : i + PIECE].tolist(), strict=True)
        hashes = np.array([digest(whole[s:e], 42) for s, e in span], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, row: str | None = None) -> DataFrame:
    """(doc_id, __row, fp): the fingerprint as a signed long.  Null text counts as empty; no words give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(t or b"", words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__row"), pa.array(prints, pa.int64())], names=["doc_id", "__row", "fp"])

    lean = docs.select(F.col(doc_id).alias("doc_id"), row_name(row).alias("__row"), F.col(text).cast("binary").alias("text"))
    kind = {c: lean.schema[c].dataType.simpleString() for c in ("doc_id", "__row")}
    return lean.mapInArrow(run, f"doc_id {kind['doc_id']}, __row {kind['__row']}, fp long")


def pivot_row(fp: Column) -> list[Column]:
    """Distances to the references, one byte each, in two longs."""
    near = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long") for p in PIVOTS]
    pack = lambda part: sum((F.shiftleft(d, 8 * i) for i, d in enumerate(part[1:], 1)), part[0])
    return [pack(near[:8]).alias("t0"), pack(near[8:]).alias("t1")]


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` of ``blocks`` even blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(c)) for c in combinations(single, blocks - radius)]


def _grouped(prints: DataFrame, blocks: int) -> DataFrame:
    """A row per fingerprint and choice of blocks; ``key`` hashes the choice and the agreeing bits (a collision only adds candidates)."""
    choices = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(block_masks(blocks))])
    rows = prints.select("fp", "t0", "t1", F.explode(choices).alias("c"))
    return rows.select("fp", "t0", "t1", F.xxhash64("c.i", F.col("fp").bitwiseAND(F.col("c.m"))).alias("key"))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the given links connect."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def link_groups(key: np.ndarray, fp: np.ndarray, pivots: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links inside runs of equal ``key``; rows are sorted by key, then by the first pivot distance."""
    n = len(key)
    last = np.searchsorted(key, key, side="right")
    out_a, out_b, held = [], [], 0
    active, step = np.arange(n), 0
    while active.size:
        step += 1
        active = active[active + step < last[active]]
        gap = pivots[active + step, 0] - pivots[active, 0]
        active = active[gap <= radius]  # sorted: what is too far now stays too far
        survive = active[np.abs(pivots[active + step] - pivots[active]).max(axis=1, initial=0) <= radius]
        linked = survive[np.bitwise_count(fp[survive] ^ fp[survive + step]) <= radius]
        if linked.size:
            out_a.append(fp[linked])
            out_b.append(fp[linked + step])
            held += linked.size
            if held > 1 << 20:  # keep memory to the nodes, not the links
                a, b = _forest(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b, held = [a], [b], 0
    if not out_a:
        return fp[:0], fp[:0]
    return _forest(np.concatenate(out_a), np.concatenate(out_b))


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key; the last, perhaps unfinished, run of a batch waits for the next batch."""
    held: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(4)]

    def links(rows):
        key, fp, t0, t1 = rows
        table16 = np.concatenate([np.ascontiguousarray(t).view(np.uint8).reshape(-1, 8) for t in (t0, t1)], axis=1).astype(np.int16)
        a, b = link_groups(key, fp.view(np.uint64), table16)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        rows = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "fp", "t0", "t1"), strict=True)]
        done = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
        held = [x[done:] for x in rows]
        if done:
            yield links([x[:done] for x in rows])
    if len(held[0]):
        yield links(held)


def near_links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): links that connect all of ``prints(fp)`` (distinct) that differ in at most ``RADIUS`` bits."""
    rows, found = prints.select("fp", *pivot_row(F.col("fp"))), None
    for level, blocks in enumerate(CUTS):
        grouped, crowded = _grouped(rows, blocks), None
        if level + 1 < len(CUTS):
            crowded = cut_lineage(grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("key"))
            if crowded.isEmpty():
                crowded = None
        here = grouped if crowded is None else grouped.join(crowded, "key", "left_anti")
        first = F.col("t0").bitwiseAND(F.lit(255))
        # Dealt out by a hash of the key, not by the key: after the join above the planner would drop an exchange on the key
        # itself, and adaptive execution may then read the join's sides locally, which tears groups apart.
        dealt = here.select("key", "fp", "t0", "t1").repartition(F.xxhash64("key")).sortWithinPartitions("key", first)
        links = dealt.mapInArrow(_link, "a long, b long")
        found = links if found is None else found.union(links)
        if crowded is None:
            return found
        rows = cut_lineage(grouped.join(crowded, "key", "left_semi").select("fp", "t0", "t1").distinct())
    return found


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, limit: int = LIMIT, row: str | None = None) -> DataFrame:
    """Per document: ``fp``, ``component_id`` (smallest id reachable over links of at most 3 bits), ``group`` and ``__row`` (the column ``row`` or a number of this read).

    Documents without words share fingerprint 0 and link like any other; null text is empty text.  A null id
    never is the smallest unless a component has no other.  Repeated rows share a fingerprint.  No input gives no
    rows; other columns are not read.
    """
    marked = cut_lineage(with_fingerprint(docs, doc_id, text, words, row))
    prints = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(prints, limit)).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    least = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.select("fp", "group").join(least, "group"), "fp")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns."""
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    placed = with_place(docs)
    return keep_rows(placed, near_groups(placed, doc_id, text, words, row=PLACE).groupBy("group").agg(best.alias("best")).select("best.__row"))


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark, folder):
    found = near_groups(table(spark, folder, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

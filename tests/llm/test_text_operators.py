"""Exact and near duplicates, mixing, packing, sharding: brute force, round trips and odd rows."""

import hashlib
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from larder.llm import exact, mixing, packing, sharding, simhash
from larder.llm.common import PLACE, with_place
from larder.llm.graph import components

WHITE = " \t\n\x0b\f\r"


def texts(rows):
    return [(r[0], r[1]) for r in rows]


# exact copies

def test_exact_matches_brute_force(odd, odd_rows):
    groups = defaultdict(list)
    for doc_id, text in texts(odd_rows):
        groups["".join(c for c in text or "" if c not in WHITE)].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        digest = hashlib.sha256(norm.encode()).hexdigest()
        for i, m in enumerate(sorted(members, key=lambda m: m[:3])):
            want[(m[3], best[3], len(members), i == 0, digest)] += 1
    got = Counter(tuple(r) for r in exact.mark_copies(odd).drop("__row").collect())
    assert got == want


@pytest.mark.parametrize("bits", [1, 3])
def test_exact_many_runs(spark, bits):
    docs = spark.range(600).selectExpr("id AS doc_id", "CAST(IF(id % 3 = 0, 7, id % 50) AS STRING) AS text").repartition(17)
    rows = exact.mark_copies(docs, bits=bits).collect()
    assert len(rows) == 600 and sum(r.kept for r in rows) == 50
    hot = [r for r in rows if r.doc_id % 3 == 0]
    assert {r.keep_id for r in hot} == {0} and {r.group_size for r in hot} == {208}


def test_exact_keeps_columns(odd, odd_rows):
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({"".join(c for c in t or "" if c not in WHITE) for _, t in texts(odd_rows)})


# near copies

def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_simhash_matches_brute_force(odd, odd_rows):
    prints = [(d, brute_print(t)) for d, t in texts(odd_rows)]
    roots = brute_components({p for _, p in prints})
    least = defaultdict(list)
    for d, p in prints:
        least[roots[p]].append(d)
    want = Counter((d, p, min((x for x in least[roots[p]] if x is not None), default=None)) for d, p in prints)
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_groups(odd, words=3).collect())
    assert got == want


@pytest.mark.parametrize("limit", [4096, 6, 2])
def test_no_link_is_lost_at_any_group_limit(spark, odd, limit):
    rng = np.random.default_rng(1)
    prints = set()
    for base in rng.integers(0, 2**63, 25, dtype=np.uint64):
        for _ in range(10):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            prints.add(int(base) ^ sum(1 << int(f) for f in flips))
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long").repartition(3)
    got = {r.node % 2**64: r.root for r in components(simhash.near_links(frame, limit)).collect()}
    want = brute_components(prints)
    groups = lambda of: {frozenset(p for p in of if of[p] == root) for root in set(of.values())}
    linked = {p: r for p, r in want.items() if sum(x == r for x in want.values()) > 1}
    assert groups(got) == groups(linked)


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components(edges).collect()} == {0}


def test_near_keeps_one_of_each_group(odd):
    kept = simhash.drop_near(odd, words=3)
    assert kept.columns == odd.columns
    assert kept.count() == simhash.near_groups(odd, words=3).select("group").distinct().count()


# mixing

def brute_targets(sizes, weights, share, most):
    target, free = {}, dict(sizes)
    left = share * sum(sizes.values())
    while free:
        unit = left / sum(weights[s] for s in free)
        above = [s for s in free if most * free[s] < unit * weights[s]]
        if not above:
            return target | {s: unit * weights[s] for s in free}
        for s in above:
            target[s] = most * free.pop(s)
            left -= target[s]
    return target


def test_mix_meets_targets(odd, odd_rows):
    rows = mixing.mix(odd).collect()
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5, 2.0)
    assert len(rows) == len(odd_rows)
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mix_repeats_whole_documents(odd):
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0


# packing

def test_packing_remembers_words_within_a_size():
    words = packing._Words(lambda word: word.encode() * 4)
    for i in range(2_000):
        assert words[f"{i}:" + "x" * 5_000] == (f" {i}:" + "x" * 5_000).encode() * 4
    for i in range(200_000):
        words[f"word{i}"]
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in words.items()) <= 32 << 20


def test_packing_hands_pieces_on_before_a_batch_is_done():
    def cut(batches):
        return list(packing.cut(batches, lambda text: b"\x07\0\0\0" * int(text or 0), 2048, b"\x01\0\0\0"))

    sizes = [0, None, 5_000_000, *[1_000] * 3_000, 2_047, 2_048]
    batch = pa.RecordBatch.from_arrays([pa.array([i if i % 2 else None for i in range(len(sizes))], pa.int64()), pa.array([None if n is None else str(n) for n in sizes])], names=["doc_id", "text"])
    got = cut([batch, batch.slice(0, 0), batch.slice(0, 2)])
    assert max(sum(len(x.as_py()) for x in b.column("ids")) for b in got) < (4 << 20) + 4 * 2048
    rows = pa.Table.from_batches(got).to_pylist()
    want = [(None if i is None else i, start, min(2048, (n or 0) + 1 - start), (n or 0) + 1, salt) for i, n, salt in
            [*((i if i % 2 else None, n, 0 if i % 2 else 1 + i) for i, n in enumerate(sizes)), (None, 0, 1 + len(sizes)), (1, None, 0)] for start in range(0, (n or 0) + 1, 2048)]
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["__salt"]) for r in rows] == want
    assert all(len(r["ids"]) == 4 * r["length"] and r["ids"].endswith(b"\x01\0\0\0") == (r["start"] + r["length"] == r["doc_tokens"]) for r in rows)


def test_packing_a_group_copies_its_ids_part_by_part():
    size = [1 + 37 * i % 2048 for i in range(4_096)]
    group = pa.table({"doc_id": pa.array(range(4_096), pa.int64()), "start": pa.array([0] * 4_096, pa.int64()), "length": pa.array(size, pa.int64()),
                      "ids": pa.array([i.to_bytes(4, "little") * n for i, n in enumerate(size)], pa.binary()), "doc_tokens": pa.array(size, pa.int64()), "__group": pa.array([1] * 4_096, pa.int64())})
    tracemalloc.start()
    try:
        packed = packing.pack_group(group, 2048, 32)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 2 * sum(size)  # half of the ids' bytes
    data = defaultdict(bytes)
    for p in sorted(packed.to_pylist(), key=lambda p: (p["doc_id"], p["start"])):
        assert len(p["ids"]) == 4 * p["length"] and 4 * p["start"] == len(data[p["doc_id"]])
        data[p["doc_id"]] += p["ids"]
    assert data == {i: i.to_bytes(4, "little") * n for i, n in enumerate(size)}


def test_packing_is_a_round_trip(odd, odd_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in texts(odd_rows))
    pieces = packing.packed(odd, documents_a_group=4).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[(p.doc_id, p.doc_tokens)].append(p)
        by_sequence[p.sequence_id].append(p)
    got = Counter()
    for (doc_id, n), own in by_doc.items():
        copies = sum(p.length for p in own) // n
        at = defaultdict(list)
        for p in own:
            at[p.start].append(p)
        for _ in range(copies):  # repeated rows have equal pieces, maybe cut differently: follow the starts
            data, place = b"", 0
            while place < n:
                p = max(at[place], key=lambda p: p.length)
                at[place].remove(p)
                data, place = data + bytes(p.ids), place + p.length
            got[(doc_id, data)] += 1
    assert sum(got.values()) == len(odd_rows)
    assert {k for k in got if k[0] not in (None, 3)} == {k for k in want if k[0] not in (None, 3)}
    padding = 0
    for own in by_sequence.values():
        place = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == place and len(p.ids) == 4 * p.length
            place += p.length
        assert place <= 2048
        padding += 2048 - place if place & (place - 1) else 0
    assert padding <= 32 * len(by_sequence)


def test_first_fit_decreasing_matches_plain_search():
    lengths = sorted(np.random.default_rng(2).integers(1, 100, 500).tolist(), reverse=True)
    rooms, want = [], []
    for n in lengths:
        i = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        if i == len(rooms):
            rooms.append(100)
        rooms[i] -= n
        want.append(i)
    assert packing.first_fit_decreasing(lengths, 100) == want


@pytest.mark.parametrize("text", ["a  b", "a \n b", "x\n\n y", " lead", "trail ", "tab\tx  y", "<|endoftext|> hi", "", "é à  b", "a\u3000 b", "don't  ' t", "  ", "a\u0085 b", "a\x1f b", "a \x1f b", "a \u200b b", "x\r\n y z"])
def test_words_give_the_tokenizers_ids(text):
    encoder = packing.encoder(packing.public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.by_word and encoder(text) == encoder.whole(text)


# sharding

@pytest.mark.parametrize("n", [1, 2, 5, 24, 1000, 4097])
def test_feistel_is_a_permutation(n):
    rows = np.arange(n)
    places = sharding.permute(rows, n, 3)
    assert sorted(places.tolist()) == rows.tolist() and (sharding.unpermute(places, n, 3) == rows).all()


def test_shards_are_even_and_reproducible(odd, odd_rows):
    lean = odd.select("doc_id", "text", "score", "shard")
    rows = sharding.assign_shards(lean, ["doc_id", "text"], 5, seed=1).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == len(odd_rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.assign_shards(lean.repartition(7), ["doc_id", "text"], 5, seed=1).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))


def test_written_shards_hold_every_row(spark, odd, odd_rows, tmp_path):
    sharding.write_shards(odd.select("doc_id", "text"), str(tmp_path / "shards"), ["doc_id", "text"], 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(texts(odd_rows))


def test_crc_of_op9(small, spark):
    rows = {r.doc_id: r for r in sharding.op9_feistel_shards(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        data = (r.text or "").encode()
        assert (rows[r.doc_id].size, rows[r.doc_id].text_crc32) == (len(data) + 8, zlib.crc32(data))


@pytest.mark.parametrize("run", [
    lambda d: exact.mark_copies(d), lambda d: exact.drop_copies(d), lambda d: simhash.near_groups(d), lambda d: simhash.drop_near(d), lambda d: mixing.mix(d),
    lambda d: mixing.mixed_documents(d), lambda d: packing.packed(d), lambda d: sharding.assign_shards(d, ["doc_id"], 3)])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0


def test_mix_reruns_agree(odd):
    lean = lambda rows: Counter((r.doc_id, r.source, r.taken) for r in rows if r.doc_id is not None)
    assert lean(mixing.mix(odd).collect()) == lean(mixing.mix(odd.repartition(5)).collect())


def test_places_do_not_depend_on_the_cut_into_tasks(spark, odd, tmp_path):
    odd.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    first = {(r.doc_id, r.text, r[PLACE]) for r in with_place(docs).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        again = with_place(spark.read.parquet(str(tmp_path / "docs")))
        assert {(r.doc_id, r.text, r[PLACE]) for r in again.collect()} == first
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r[2] for r in first}) == len(first) == docs.count()


def test_places_of_what_is_no_plain_table(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    twice = docs.union(docs)
    assert with_place(twice).select(PLACE).distinct().count() == twice.count()
    named = docs.withColumn("_metadata", F.lit("mine")).withColumn(PLACE, F.lit("mine"))
    assert with_place(named).select(PLACE).distinct().count() == docs.count()
    assert exact.drop_copies(named.drop(PLACE)).columns == named.drop(PLACE).columns
    assert exact.drop_copies(docs).columns == docs.columns
    assert exact.drop_copies(docs).count() == exact.drop_copies(odd).count() == exact.mark_copies(odd).filter("kept").count()


def test_packing_groups_are_bounded(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(i if i % 2 else None, text if i < 12 else "same words again") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pieces = packing.tokenised(docs, 10, public_tokenizers.path("byte_bpe_50k.json"), 64, 1, 3, "doc_id", "text")
    sizes = {r["__group"]: r["count"] for r in pieces.groupBy("__group").count().collect()}
    assert len([g for g in sizes if g >= 10]) > 12  # the long documents, in chunks
    assert max(n for g, n in sizes.items() if g >= 10) <= packing.LONG_GROUP
    assert max(n for g, n in sizes.items() if g < 10) < 600  # also the many equal rows without an id are spread
    packed = packing.packed(docs, length=64).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert {(r.doc_id, r.n) for r in packed.collect() if r.doc_id is not None} == {(r.doc_id, r.doc_tokens) for r in packed.collect() if r.doc_id is not None}

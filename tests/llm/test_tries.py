"""The prefix trie against plain dictionaries, with shards so small that most nodes are shared."""

import hashlib
import os
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from compare import compare, open_duck  # noqa: E402
from larder.llm import tries  # noqa: E402

KIND = "conv_id long, turn long, role string, text string, own_path string, depth int, key binary, shard long"


def row(conv, turn, role, text):
    return (conv, turn, role, text, "x", 3, b"z", 7)


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(list)
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        opener = conv - int(np.fmod(conv, 100))
        path = tuple(own.get(opener, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((conv, d == len(path)))
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, members in nodes.items():
        leaf = all(end for _, end in members)
        own_saved = (len(members) - 1) * len(path[-1][1]) if path else 0
        if path:
            children[path[:-1]] += 1
        for d in range(len(path) + 1):
            leaves[path[:d]] += leaf
            saved[path[:d]] += own_saved
    out = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        parent = min(c for c, _ in nodes[path[:-1]]) if path else None
        out.append((min(c for c, _ in members), len(path), parent, len(members), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    assert df.columns == tries.RESULT
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [
    *[row(c, t, "user", f"hello {t}") for c in range(40) for t in range(c % 5)], *[row(c, t, "user", "same") for c in range(1000, 1030) for t in range(7)],
    row(None, 1, "user", "nobody"), row(50, None, "user", "first"), row(50, 0, None, None), row(50, 0, None, None), row(51, 2, "", "tie b"), row(51, 2, "", "tie a"),
    row(101, 0, "user", "x"), row(103, 0, "a", "bc"), row(104, 0, "ab", "c"), *[row(200, t, "user", "deep") for t in range(300)], *[row(201, t, "user", "deep") for t in range(299)],
    *[row(c, t, "user", "deep") for c in (202, 203, 204) for t in range(40)], row(-7, 0, "user", "neg"), row(-7, 1, "user", "neg"), row(300, 1, "user", "\U0001f600é"), row(305, 9, "user", "z")]


@pytest.mark.parametrize("turns_a_shard", [8, 100, 1 << 17])
def test_matches_dictionaries(spark, small, turns_a_shard):
    rows = spark.createDataFrame(ODD, KIND).repartition(5)
    assert result(tries.prefix_trie(rows, turns_a_shard=turns_a_shard)) == brute(ODD)


def test_query_matches_dictionaries_and_sql(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(tries.op12_prefix_trie(spark, small)) == brute(rows)
    ok, note = compare(spark, open_duck(small), "op12", tries.op12_prefix_trie, tries.SQL, small)
    assert ok, note


def test_one_path_for_all_crosses_many_shards(spark, small):
    rows = [row(c, t, "user", "same") for c in range(0, 3000, 100) for t in range(3)] + [row(c, 0, "user", "same") for c in range(20_000, 20_600)]
    assert result(tries.prefix_trie(spark.createDataFrame(rows, KIND), turns_a_shard=16)) == brute(rows)


def test_no_conversations(spark, small):
    assert tries.prefix_trie(spark.createDataFrame([], KIND)).count() == 0
    assert tries.prefix_trie(spark.createDataFrame([row(None, 1, "a", "b")], KIND)).count() == 0


def test_double_array_finds_what_it_holds():
    rng = np.random.default_rng(3)
    depths = rng.integers(0, 6, 400)
    sequences = sorted(tuple(rng.integers(0, 9, d)) for d in depths)
    depths = np.array([len(s) for s in sequences])
    codes = np.array([c for s in sequences for c in s], np.int64)
    trie, parents, depth, place = tries.build(codes, depths)
    prefixes = {s[:d] for s in sequences for d in range(len(s) + 1)}
    assert len(parents) == len(prefixes) and len(set(trie.state_of.tolist())) == len(parents)
    reached = set()
    for s in prefixes:
        state = np.zeros(1, np.int64)
        for c in s:
            state = trie.step(state, np.array([c]))
            assert state[0] >= 0
        reached.add(int(state[0]))
        for c in range(10):
            found = trie.step(state, np.array([c]))[0] >= 0
            assert found == (s + (c,) in prefixes)
    assert len(reached) == len(prefixes)
    assert len(trie.check) <= 2 * len(parents) + 20

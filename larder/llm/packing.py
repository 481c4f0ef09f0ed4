"""Packing token sequences: first-fit decreasing over a tournament tree, inside random groups.

A document's ids are cut at multiples of the sequence length; only what remains needs company.  Pieces
are dealt into random groups of a few thousand, so that groups are alike and the tree
stays small, and every group is packed on its own.  What a document gives to these groups is bounded; the further full
sequences of long documents need no company and go to groups of 256, so a group's memory does not depend on the lengths.  A tree over the bins holds the largest
room below each node: the first bin that fits is found by walking down, in a logarithm of the bins.
Bins that stay emptier than ``slack`` are cut into power-of-two sequences, which need no padding.
"""

from __future__ import annotations

import functools
import json
import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .registry import query, table

LENGTH = 2048
DOCUMENTS_A_GROUP = 2048
#: Full sequences that one group takes of a long document; what goes beyond is in groups of its own.
FULL_A_GROUP = 8
LONG_GROUP = 256
#: Bytes of the words that a worker remembers with their ids, and the longest word among them: a bound by number alone would not bound the memory.
CACHED_BYTES, LONGEST_CACHED = 32 << 20, 64
#: Ids, in bytes, that a task holds before it hands them on, and pieces of a group that are written at once.
BYTES_A_BATCH, PIECES_A_PART = 4 << 20, 512


class _Words(dict):
    """Ids, as bytes, of a word with the space before it; the tokenizer fills in what is missing."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.held = encode, 0

    def __missing__(self, word):
        if not word or word[0].isspace():
            raise LookupError  # white space runs decide together: the whole text must be encoded at once
        ids = self.encode(" " + word)
        if len(word) <= LONGEST_CACHED:
            size = sys.getsizeof(word) + sys.getsizeof(ids)
            if self.held + size > CACHED_BYTES:
                self.clear()
                self.held = 0
            self[word] = ids
            self.held += size
        return ids


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_ranks(settings: dict) -> dict[bytes, int] | None:
    """The vocabulary as bytes to ids, if it is byte-level BPE whose merges come in the order of their ids."""
    before, model = settings.get("pre_tokenizer") or {}, settings["model"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or model.get("type", "BPE") != "BPE" or any(settings.get(k) for k in ("normalizer", "truncation", "padding")):
        return None
    letters, added = byte_letters(), {t["content"] for t in settings.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return ranks if made == sorted(made) and len(ranks) == len(made) + 256 else None


class Encoder:
    """Text to ids as little-endian unsigned 32-bit bytes, by a file of the ``tokenizers`` library.

    Byte-level pre-tokenizers end a token before every space that a non-space follows.  For such files
    words are encoded once and remembered, by the same vocabulary in ``tiktoken``, which is several times
    faster and gives the same ids.  Texts with white space runs and texts that may hold an
    added token go to ``tokenizers`` whole, as do all texts for any other file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"] for t in settings.get("added_tokens", [])]
        ranks = byte_ranks(settings)
        self.by_word = ranks is not None
        if self.by_word:
            import tiktoken

            fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.words = _Words(lambda word: struct.pack(f"<{len(ids := fast.encode_ordinary(word))}I", *ids))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_word or any(t in text for t in self.added):
            return self.whole(text)
        words = text.split(" ")
        try:
            rest = b"".join(map(self.words.__getitem__, words[1:]))
        except LookupError:
            return self.whole(text)
        return self.whole(words[0]) + rest


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder, with its memory of words, per Python worker."""
    return Encoder(path)


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item; items come in falling order of length."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins = []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        bins.append(node - leaves)
        room[node] -= length
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins


def cut(batches: Iterator[pa.RecordBatch], encode: Callable[[str], bytes], length: int, end: bytes) -> Iterator[pa.RecordBatch]:
    """A row per piece of the batches' texts, handed on as soon as ``BYTES_A_BATCH`` of ids are held: neither texts nor ids of a whole batch are in memory twice."""
    seen = 0
    for batch in batches:
        names, texts, held, size = batch.column("doc_id"), batch.column("text"), [], 0
        named = names.is_valid().to_pylist()

        def made(held, names=names, named=named, seen=seen):
            rows, starts, ids, whole = zip(*held, strict=True)
            salt = pa.array([0 if named[i] else 1 + seen + i for i in rows], pa.int64())
            return pa.RecordBatch.from_arrays(
                [names.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(whole, pa.int64()), salt],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "__salt"])

        for i in range(batch.num_rows):
            data = encode(texts[i].as_py() or "") + end
            n = len(data) // 4
            for start in range(0, n, length):
                held.append((i, start, data[4 * start : 4 * (start + length)], n))
                size += len(held[-1][2])
                if size >= BYTES_A_BATCH:
                    yield made(held)
                    held, size = [], 0
        if held:
            yield made(held)
        seen += batch.num_rows


def tokenised(docs: DataFrame, groups: int, path: str, length: int, end_id: int, seed: int, doc_id: str, text: str) -> DataFrame:
    """A row per piece: (doc_id, start, length, ids, doc_tokens, __group).  Rows without an id, which may all be alike, are told apart by their place in a task."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut(batches, encoder(path), length, end)

    lean = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    pieces = lean.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, __salt long")
    salt = F.when(F.col("__salt") > 0, F.struct(F.spark_partition_id(), F.col("__salt")))
    near = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", F.crc32("ids"), salt), F.lit(groups))
    # The number of a group has 31 bits; two long groups that share one are packed together.
    far = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", salt, F.floor(F.col("start") / (length * LONG_GROUP))), F.lit(2**31 - groups)) + groups
    return pieces.withColumn("__group", F.when((F.col("length") == length) & (F.col("start") >= length * FULL_A_GROUP), far).otherwise(near)).drop("__salt")


def pack_group(pieces: pa.Table, length: int, slack: int) -> pa.Table:
    """Sequences of one group.  Pieces enter in falling length, then by id and start, so reruns agree.  Only their order is sorted; ids are copied once, part by part."""
    order = pc.sort_indices(pieces, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
    lengths = pieces.column("length").take(order).to_pylist()
    full = sum(n == length for n in lengths)
    bins = [*range(full), *(full + b for b in first_fit_decreasing(lengths[full:], length))]
    used = np.bincount(np.array(bins, np.int64), np.array(lengths, np.int64)).astype(np.int64).tolist() if bins else []
    sequence, filled, left = list(range(len(used))), [0] * len(used), [0] * len(used)
    loose = [length - n > slack for n in used]
    fresh, base = len(used), pieces.column("__group")[0].as_py() << 32
    row, start, size, seq, offset = [], [], [], [], []
    for i, b, n in zip(order.to_pylist(), bins, lengths, strict=True):
        at = 0
        while at < n:
            if loose[b] and not left[b]:
                # the largest power of two within what is still to come from this bin
                left[b] = 1 << (used[b].bit_length() - 1)
                used[b] -= left[b]
                sequence[b], filled[b], fresh = fresh, 0, fresh + 1
            take = min(n - at, left[b]) if loose[b] else n
            row.append(i), start.append(at), size.append(take), seq.append(base + sequence[b]), offset.append(filled[b])
            filled[b] += take
            left[b] -= take
            at += take
    whole = pieces.select(["doc_id", "start", "doc_tokens"]).take(pa.array(row, pa.int64()))
    data, ids = pieces.column("ids"), []
    for at in range(0, len(row), PIECES_A_PART):
        part = slice(at, at + PIECES_A_PART)
        ids.append(pa.array([data[i].as_py()[4 * s : 4 * (s + n)] for i, s, n in zip(row[part], start[part], size[part], strict=True)], pa.binary()))
    starts = np.array(whole.column("start").to_pylist(), np.int64) + np.array(start, np.int64)
    return pa.table({
        "doc_id": whole.column("doc_id"), "start": starts, "length": pa.array(size, pa.int64()), "ids": pa.chunked_array(ids, pa.binary()),
        "doc_tokens": whole.column("doc_tokens"), "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(offset, pa.int64())})


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end_id: int = 1, slack: int = 32,
           seed: int = 11, documents_a_group: int = DOCUMENTS_A_GROUP) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every id of every document lies in one piece.  A sequence is padded to ``length`` unless its pieces
    add up to a power of two.  Null text counts as empty: one piece with the end id alone.  A null
    id stays null; repeated rows are packed each; a very long text spreads over many groups.  No input gives no
    rows; other columns are not read.
    """
    groups = max(1, -(-docs.count() // documents_a_group))
    pieces = tokenised(docs, groups, path or public_tokenizers.path("byte_bpe_50k.json"), length, end_id, seed, doc_id, text)
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.groupBy("__group").applyInArrow(
        lambda group: pack_group(group, length, slack),
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


@query("op1_ffd_packing")
def op1_ffd_packing(spark, folder):
    rows = packed(table(spark, folder, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Links between the tokens of two tokenizers: an identity map for exact matches, pair counts for the rest.

Text is cut at single spaces (and single line ends) that neither tokenizer joins over; what lies between, a *word*, is
aligned once and remembered.  The ends of A's and B's tokens, merged in order, cut a word into stretches that lie in one token of
each: a stretch is a link, and ends that both have in common close a group.  A group of one A and one B token with the same
bytes is *regular*: a map from A's ids to B's ids, made once from the vocabularies, names its pair, so its count is an
entry of a vector as long as A's vocabulary.  Only links of other groups are counted as pairs through a shuffle.

The second pass adds up counts per document.  Vectors and the pairs that hold at least one in ``frequent`` of all irregular links,
of which there are at most ``frequent``, travel to every task; links of rarer pairs meet their counts in a join, where no key can be hot.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .packing import byte_ranks
from .registry import query, table

SENTENCE_SPACE = "▁"
#: Words held in memory by a worker, and their characters.
HELD_WORDS = 400_000
HELD_CHARS = 16_000_000
#: Characters aligned at once, whatever the lengths of documents.
SLICE = 1 << 20
FREQUENT = 1 << 18
#: Words encoded in one call.
CHUNK_WORDS = 256
#: An id pair is one number, A's id times this plus B's.
SHIFT = 1 << 31
#: White space other than space and line feed, and the letter that stands for a space in pieces.
EXOTIC = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u2581]")
SAFE_SPACE = re.compile(r"(?<=[^\s\u2581\x1c-\x1f]) (?=[^\s\u2581\x1c-\x1f])")


def words_of(text: str) -> list[str]:
    """The text cut where neither tokenizer joins: ``w`` stands for a space and w; what starts with a space or line feed stands for itself."""
    words = text.replace("\n", " \n").split(" ")
    if "" not in words and "\n" not in words and words[0][0] != "\n" and "\n " not in text and " \n" not in text and not EXOTIC.search(text):
        return words
    return [" " + run for run in SAFE_SPACE.split(text)]


def slices_of(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices of about ``size`` characters, cut at safe spaces, which belong to no slice."""
    at = 0
    while len(text) - at > size:
        cut = SAFE_SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class Vocabularies:
    """A byte-level BPE file of ``tokenizers`` (A) and a ``sentencepiece`` BPE model with byte fallback (B), with bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as file:
            settings = json.load(file)
        ranks = byte_ranks(settings)
        if ranks is None:
            raise ValueError("the first tokenizer must be a byte-level BPE file")
        # strings of special tokens are plain text here, so the vocabulary in tiktoken gives the file's ids
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        a_bytes = {i: token for token, i in ranks.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        odd = [self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i) for i in range(len(pieces))]
        fallback = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if f else p.replace(SENTENCE_SPACE, " ").encode() for p, f in zip(pieces, fallback, strict=True)]
        if any(SENTENCE_SPACE in p.lstrip(SENTENCE_SPACE) or "\n" in p for p, o in zip(pieces, odd, strict=True) if not o):
            raise ValueError("a piece of the second tokenizer holds a space after another character, or a line end")
        self.a_size = max(a_bytes) + 1
        # decimal ids with what stands before them: a group's start, a further A id, the first B id, a further B id
        size = max(self.a_size, len(pieces))
        self.size = size
        self.texts = [b"%s%d" % (mark, i) for mark in (b";", b",", b"|", b",") for i in range(size)]
        self.text_length = np.array([len(t) for t in self.texts], np.int64)
        self.a_length = np.zeros(self.a_size, np.int64)
        self.a_length[list(a_bytes)] = [len(t) for t in a_bytes.values()]
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        # the identity map; a piece goes before the fallback for the same byte
        ids = {self.b_bytes[i]: i for i in sorted(range(len(pieces)), key=lambda i: not fallback[i]) if not odd[i]}
        self.same = np.full(self.a_size, -1, np.int64)
        for i, token in a_bytes.items():
            self.same[i] = ids.get(token, -1)

    def _chunk(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and B of words in a row, or nothing if B's tokens do not hold exactly their bytes."""
        text = "".join(words)
        # in front of a line end the model puts its space, which is not in the text
        encode = self.b.EncodeAsNumpy
        b = encode(text)[1:] if text[0] == "\n" else encode(text[1:])
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != text.encode():
            return None
        return self.a.encode_to_numpy(text, disallowed_special=()), b

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids by A and by B, and the bytes of each word; 0 bytes and no ids where B's tokens do not give back the word."""
        raw = [w if w[:1] in (" ", "\n") else " " + w for w in words]
        chunks, lengths = [], np.array([len(w.encode()) for w in raw], np.int64)
        a, b, start = [], [], 0
        for i, word in enumerate(words):
            # runs that stand for themselves may begin or end with white space: they are encoded alone
            if word[:1] == " ":
                chunks += [(start, i), (i, i + 1)]
                start = i + 1
            elif i - start == CHUNK_WORDS:
                chunks.append((start, i))
                start = i
        chunks.append((start, len(raw)))
        for low, high in chunks:
            ids = self._chunk(raw[low:high]) if low < high else None
            parts = [ids] if ids else [self._chunk(raw[i : i + 1]) for i in range(low, high)]
            for i, part in enumerate(parts, low):
                if part is None:
                    lengths[i] = 0
                else:
                    a.append(part[0])
                    b.append(part[1])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]).astype(np.int64), np.concatenate([none, *b]).astype(np.int64), lengths


@functools.cache
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


class Words(dict):
    """Word to its number in the arrays of this object, which hold the alignment of every word seen.

    ``sums`` has a row per word: tokens of A, of B, groups, links, and 1 if B's bytes differ.  ``link_ends`` cuts ``pairs`` (the
    links) and ``regular`` (whether their group is) into words.  ``groups`` holds the decimal ids, each group after a semicolon.
    """

    def __init__(self, paths: tuple[str, str]):
        super().__init__()
        self.of = vocabularies(*paths)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.chars, self.new = 0, []
        self.sums, self.pairs, self.regular = np.zeros((0, 5), np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        self.link_ends, self.groups = np.zeros(0, np.int64), []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def full(self) -> bool:
        return len(self) >= HELD_WORDS or self.chars >= HELD_CHARS

    def numbers(self, words: list[str], with_groups: bool) -> np.ndarray:
        """The number of each word; words not seen before are aligned, all at once."""
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self._align(self.new, with_groups)
            self.chars += sum(map(len, self.new))
            self.new = []
        return found

    def _align(self, words: list[str], with_groups: bool) -> None:
        """Words whose bytes differ get no tokens and no links."""
        a, b, lengths = self.of.encode(words)
        # ends of tokens in bytes, running over all words
        end_a, end_b, word_end = np.cumsum(self.of.a_length[a]), np.cumsum(self.of.b_length[b]), np.cumsum(lengths)
        n_a, n_b = (np.diff(np.searchsorted(end, word_end, side="right"), prepend=0) for end in (end_a, end_b))
        # between two neighbouring ends lies one link; at ends of both a group closes
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        pairs, both = a[at_a] * SHIFT + b[at_b], (end_a[at_a] == ends) & (end_b[at_b] == ends)
        # a group of one link has one token of each
        alone = both & np.concatenate(([True], both))[:-1]
        regular = alone & (self.of.same[a[at_a]] == b[at_b])
        link_end = np.searchsorted(ends, word_end, side="right")
        closed = np.concatenate(([0], np.cumsum(both)))[link_end]
        rows = np.stack([n_a, n_b, np.diff(closed, prepend=0), np.diff(link_end, prepend=0), lengths == 0], axis=1)
        self.link_ends = np.concatenate((self.link_ends, link_end + len(self.pairs)))
        self.sums, self.pairs, self.regular = np.concatenate((self.sums, rows.astype(np.int32))), np.concatenate((self.pairs, pairs)), np.concatenate((self.regular, regular))
        if with_groups:
            self.groups += self._group_texts(a, b, end_a, end_b, ends[both], word_end)

    def _group_texts(self, a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, group_end: np.ndarray, word_end: np.ndarray) -> list[bytes]:
        """The groups of every word in decimal ids: ``;a1,a2|b1;a3|b2``."""
        of, kinds, places, last = self.of, [], [], []
        for end in (end_a, end_b):
            group = np.searchsorted(group_end, end)
            kinds.append(np.diff(group, prepend=-1) == 0)
            places.append(group)
            last.append(np.searchsorted(end, group_end, side="right"))
        # in a group A's ids come first, then B's
        before_b = np.concatenate(([0], last[1]))[places[0]]
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + before_b] = kinds[0] * of.size + a
        order[np.arange(len(b)) + last[0][places[1]]] = (2 + kinds[1]) * of.size + b
        text = b"".join(map(of.texts.__getitem__, order.tolist()))
        at = np.concatenate(([0], np.cumsum(of.text_length[order])))
        tokens = np.searchsorted(end_a, word_end, side="right") + np.searchsorted(end_b, word_end, side="right")
        cuts = [0, *at[tokens].tolist()]
        return [text[i:j] for i, j in zip(cuts, cuts[1:])]

    def blocks(self, texts: list[str | None], with_groups: bool, make_room: Callable[[], None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Texts as word numbers, about ``SLICE`` characters at a time: (which texts, all their word numbers, where each text starts).

        A text whose bytes differ anywhere is left out; a longer one comes in several blocks.  ``make_room`` is called where
        the memory of words may be emptied, after which earlier numbers do not count.
        """
        held, chars = [], 0

        def block(parts: list[tuple[int, list[str]]]):
            lengths = np.array([len(w) for _, w in parts])
            starts = np.cumsum(lengths) - lengths
            found = self.numbers([w for _, words in parts for w in words], with_groups)
            bad = np.add.reduceat(self.sums[found, 4], starts) > 0
            keep = np.flatnonzero(~bad)
            if len(keep) < len(parts):
                found, lengths = found[np.repeat(~bad, lengths)], lengths[keep]
                starts = np.cumsum(lengths) - lengths
            return [parts[k][0] for k in keep], found, starts

        for i, text in enumerate(texts):
            if text and len(text) > SLICE:
                # seen twice: the first slices must not count if a later one differs
                for count in (False, True):
                    for part in slices_of(text):
                        make_room()
                        one = block([(i, words_of(part))])
                        if not one[0]:
                            break
                        if count:
                            yield one
                    else:
                        continue
                    break
            elif text:
                held.append((i, words_of(text)))
                chars += len(text)
            if held and (chars > SLICE or i + 1 == len(texts)):
                make_room()
                one = block(held)
                if one[0]:
                    yield one
                held, chars = [], 0
        if held:
            make_room()
            one = block(held)
            if one[0]:
                yield one


@functools.cache
def remembered(paths: tuple[str, str], with_groups: bool) -> Words:
    """The words of this Python worker."""
    return Words(paths)


def count_pairs(docs: DataFrame, text: str, paths: tuple[str, str]) -> DataFrame:
    """(a, b, regular, n): how often each pair is linked; regular groups and others apart.

    A task counts word by word and expands the words when its memory is full and at its end: regular links into a vector
    as long as the vocabulary, others into pairs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered(paths, False)
        vector, seen, pairs, counts = np.zeros(words.of.a_size, np.int64), np.zeros(0, np.int64), [], []

        def expand() -> None:
            nonlocal vector, seen
            times = np.repeat(np.pad(seen, (0, len(words.sums) - len(seen))), words.sums[:, 3])
            vector += np.bincount(words.pairs[words.regular] // SHIFT, times[words.regular], len(vector)).astype(np.int64)
            used = ~words.regular & (times > 0)
            found, place = np.unique(words.pairs[used], return_inverse=True)
            pairs.append(found)
            counts.append(np.bincount(place, times[used], len(found)).astype(np.int64))
            seen = np.zeros(0, np.int64)

        def make_room() -> None:
            if words.full():
                expand()
                words.reset()

        def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray, regular: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), regular)), pa.array(n, pa.int64())], names=["a", "b", "regular", "n"])

        def pair_rows() -> pa.RecordBatch:
            found, n = np.concatenate(pairs), np.concatenate(counts)
            pairs.clear(), counts.clear()
            return rows(found // SHIFT, found % SHIFT, n, False)

        for batch in batches:
            for _, found, _ in words.blocks(batch.column(0).to_pylist(), False, make_room):
                seen = np.pad(seen, (0, len(words.sums) - len(seen)))
                seen += np.bincount(found, minlength=len(seen))
            if len(pairs) > 8:
                yield pair_rows()
        expand()
        kept = np.flatnonzero(vector)
        yield rows(kept, words.of.same[kept], vector[kept], True)
        yield pair_rows()

    counted = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "a long, b long, regular boolean, n long")
    return counted.groupBy("a", "b", "regular").agg(F.sum("n").alias("n"))


def pair_counts(counted: DataFrame) -> DataFrame:
    """(a, b, n, regular, best): links of each pair over the whole corpus, whether some were regular, and whether no pair of its B id has more."""
    pairs = counted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("regular").alias("regular"))
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return pairs.join(most, "b").select("a", "b", "n", "regular", (F.col("n") == F.col("most")).alias("best"))


class Counts:
    """What every task knows of the corpus: counts of regular pairs by A id, and of frequent other pairs."""

    def __init__(self, a_size: int, regular: pa.Table, frequent: pa.Table):
        self.known, self.n, self.best = np.zeros(a_size, bool), np.zeros(a_size, np.int64), np.zeros(a_size, bool)
        a, b, n, best = (regular.column(c).to_numpy() for c in ("a", "b", "n", "best"))
        self.known[a], self.n[a], self.best[a] = True, n, best
        self.partner = np.full(a_size, -1, np.int64)
        self.partner[a] = b
        a, b, n, best = (frequent.column(c).to_numpy() for c in ("a", "b", "n", "best"))
        order = np.argsort(a * SHIFT + b)
        self.codes, self.code_n, self.code_best = (a * SHIFT + b)[order], n[order], best[order]

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, whether best, and whether known at all."""
        a = pairs // SHIFT
        by_map = self.known[a] & (self.partner[a] == pairs % SHIFT)
        n, best, known = np.where(by_map, self.n[a], 0), by_map & self.best[a], by_map.copy()
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, pairs), len(self.codes) - 1)
            hit = ~by_map & (self.codes[at] == pairs)
            n, best, known = np.where(hit, self.code_n[at], n), np.where(hit, self.code_best[at], best), known | hit
        return n, best, known


ROW = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, __tail array<struct<a:long,b:long,times:long>>"


def score(docs: DataFrame, doc_id: str, text: str, paths: tuple[str, str], counts: Counts) -> DataFrame:
    """Per document its sums, with links whose count is not known yet in ``__tail``."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(counts)
    lean = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    tail_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = remembered(paths, True), known.value
        words.reset()
        values, tails = np.zeros((0, 3), np.int64), {}

        def make_room() -> None:
            nonlocal values
            if words.full():
                words.reset()
                values = np.zeros((0, 3), np.int64)
                tails.clear()

        def learn() -> None:
            """Sums of the words that are new, and the links of unknown count in each."""
            nonlocal values
            first, last = len(values), len(words.sums)
            if first == last:
                return
            start = words.link_ends[first - 1] if first else 0
            pairs = words.pairs[start:]
            n, best, found = counts.look_up(pairs)
            owner = np.repeat(np.arange(first, last), words.sums[first:, 3])
            columns = [np.bincount(owner - first, mask, last - first).astype(np.int64) for mask in (best, ~found)]
            # counts may exceed what a double holds exactly: summed as integers
            total = np.concatenate(([0], np.cumsum(n)))
            ends = words.link_ends[first:] - start
            columns.insert(0, total[ends] - total[np.concatenate(([0], ends[:-1]))])
            values = np.concatenate((values, np.stack(columns, axis=1)))
            for word, pair in zip(owner[~found].tolist(), pairs[~found].tolist(), strict=True):
                tails.setdefault(word, []).append(pair)

        for batch in batches:
            rows, sums = batch.num_rows, np.zeros((batch.num_rows, 6), np.int64)
            hashes, tail = [None] * rows, [None] * rows
            for texts, found, starts in words.blocks(batch.column("text").to_pylist(), True, make_room):
                learn()
                sums[texts, :4] += np.add.reduceat(words.sums[found, :4], starts)
                added = np.add.reduceat(values[found], starts)
                sums[texts, 4] += added[:, 1]
                sums[texts, 5] += added[:, 0]
                ends = [*starts[1:].tolist(), len(found)]
                for i, start, end, unknown in zip(texts, starts.tolist(), ends, added[:, 2].tolist(), strict=True):
                    numbers = found[start:end].tolist()
                    joined = b"".join(map(words.groups.__getitem__, numbers))
                    if hashes[i] is None:
                        hashes[i] = hashlib.sha256(joined[1:])
                    else:
                        hashes[i].update(joined)
                    if unknown:
                        tail[i] = tail[i] or {}
                        for number in numbers:
                            for pair in tails.get(number, ()):
                                tail[i][pair] = tail[i].get(pair, 0) + 1
            tail_rows = [[{"a": p // SHIFT, "b": p % SHIFT, "times": n} for p, n in t.items()] if t else None for t in tail]
            columns = [pa.array(sums[:, k]) for k in range(6)]
            digests = pa.array([h.hexdigest() if h else "" for h in hashes], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, digests, pa.array(tail_rows, tail_type)],
                                             names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "__tail"])

    return lean.mapInArrow(run, f"doc_id {kind}, {ROW}")


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the table (a, b, n, regular, best).

    A encodes a space and the text, B the text, in front of which it puts a space itself.  Texts that are null, empty or whose
    tokens do not give back those bytes have zeros and an empty digest, and count nowhere.  A null id stays null; repeated
    rows count each; ties for the highest count are all best.  No input gives no rows; other columns are not read.
    """
    paths = (path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"))
    pairs = cut_lineage(pair_counts(cut_lineage(count_pairs(docs, text, paths))))
    irregular = pairs.filter(~F.col("regular"))
    total = irregular.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most ``frequent`` pairs hold a share of 1 / frequent; regular pairs are at most as many as A has ids
    least = max(1, -(-total // frequent))
    counts = Counts(vocabularies(*paths).a_size, pairs.filter("regular").toArrow(), irregular.filter(F.col("n") >= least).toArrow())
    scored = cut_lineage(score(docs, doc_id, text, paths, counts).withColumn("__row", F.monotonically_increasing_id()))
    links = scored.select("__row", F.explode("__tail").alias("t")).select("__row", "t.a", "t.b", "t.times")
    rare = irregular.filter(F.col("n") < least)
    added = links.join(rare, ["a", "b"]).groupBy("__row").agg(
        F.sum(F.col("times") * F.col("n")).alias("__sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"))
    whole = scored.join(added, "__row", "left")

    def plus(column: str, more: str) -> Column:
        return (F.col(column) + F.coalesce(F.col(more), F.lit(0))).alias(column)

    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "__best"), plus("count_sum", "__sum"), "groups_sha256"), pairs


@query("op13_alignment")
def op13_alignment(spark, folder):
    return align(table(spark, folder, "documents"))[0]

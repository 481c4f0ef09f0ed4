"""Token counts of whole texts: overlapping chunks of huge documents, spliced where both sides provably agree.

Texts up to ``chunk`` characters are counted where they lie.  Longer ones are cut into chunks that overlap; the chunks
are dealt out over the cluster, their overlaps are encoded with offsets, and two neighbours are spliced at a *stable boundary*
of their overlap: a single space between two other characters that no token of either encoding crosses.  The file of the
tokenizer proves the boundary (``Tokenizer.stable``): its rules never join text over such a space, whatever lies further
away; for the same reason the inside of a chunk is counted word by word.  Where two neighbours have no such boundary, their document is cut again with an overlap eight times as wide, until
it is a single chunk.  A tokenizer whose file proves nothing encodes every text at once.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import PLACE, with_place
from .packing import byte_ranks
from .registry import query, table

CHUNK = 32_768
OVERLAP = 256
#: Characters encoded beyond an overlap, so that its edge is not the edge of the encoding.
MARGIN = 64
WIDER = 8
CACHED_WORDS = 500_000
SENTENCE_SPACE = "▁"


def word_wise(settings: dict) -> bool:
    """Whether a ``tokenizers`` file turns white space into spaces and then keeps only matches of a pattern that holds none."""
    def steps(part, key):
        part = part or {}
        return part.get(key, [part] if part else [])

    cleaned = [n for n in steps(settings.get("normalizer"), "normalizers") if n.get("type") == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "]
    splits = [p for p in steps(settings.get("pre_tokenizer"), "pretokenizers") if p.get("type") == "Split" and p["behavior"] == "Removed" and p["invert"]]
    other = {n.get("type") for n in steps(settings.get("normalizer"), "normalizers")} - {"Replace", "NFC", "Lowercase"}
    if not cleaned or len(splits) != 1 or other:
        return False
    import regex

    pattern = regex.compile(splits[0]["pattern"]["Regex"])
    return all(pattern.fullmatch(f"{a} {b}") is None and pattern.fullmatch(f"{a} ") is None and pattern.fullmatch(f" {a}") is None for a in "a1'.é" for b in "a1'.é")


class Tokenizer:
    """Counts and offsets by a ``tokenizers`` (.json) or ``sentencepiece`` (.model) file, without special, begin or end tokens.

    Strings of special tokens inside a text are handled as the library does by default.  ``stable`` says whether a single
    space between two characters that are ``plain`` always ends a token: for word patterns that cannot match a space, for byte-level
    BPE, whose pattern takes such a space with what follows, and for pieces of which none holds a space after another character.
    ``drops_space``: white space gives no tokens.
    """

    def __init__(self, path: str):
        self.drops_space = False
        self.plain = lambda c: not c.isspace()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._offsets = lambda text: model.encode(text, return_type="offset_mapping")["offsets"]
            pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
            # a text gets a space in front, as every word has in its place
            prefixed = model.id_to_piece(model.encode("a")[0]).startswith(SENTENCE_SPACE)
            self.stable = prefixed and not any(SENTENCE_SPACE in piece.lstrip(SENTENCE_SPACE) for piece in pieces)
            self.count_of = lambda text: len(model.encode(text))
            self.after_space = self.count_of
            # the model's own rules may turn other characters into spaces
            self.plain = lambda c: "!" <= c <= "~"
            return
        from tokenizers import Tokenizer as Library

        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        library = Library.from_file(path)
        library.no_truncation()
        library.no_padding()
        added = settings.get("added_tokens", [])
        plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in added)
        self.drops_space = plain and word_wise(settings)
        self.stable = self.drops_space or (plain and byte_ranks(settings) is not None)
        self._offsets = lambda text: library.encode(text, add_special_tokens=False).offsets
        self.count_of = lambda text: len(library.encode(text, add_special_tokens=False))
        self.after_space = self.count_of if self.drops_space else lambda text: self.count_of(" " + text)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every token, in characters."""
        both = np.array(self._offsets(text), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


class Words(dict):
    """Tokens of a word after a space; the tokenizer fills in what is missing."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        n = self[word] = self.count(word)
        return n


@functools.cache
def tokenizer(path: str) -> tuple[Tokenizer, Words]:
    """One tokenizer, with its memory of words, per Python worker."""
    loaded = Tokenizer(path)
    return loaded, Words(loaded.after_space)


def count_text(text: str, path: str) -> int:
    """Tokens of a text, word by word where the file proves that words are independent."""
    loaded, words = tokenizer(path)
    if loaded.drops_space:
        return sum(map(words.__getitem__, text.replace("\n", " ").split(" ")))
    if not loaded.stable:
        return loaded.count_of(text)
    def flush(run: list[str], at_start: bool) -> int:
        joined = " ".join(run)
        return loaded.count_of(joined) if at_start else words[joined]

    total, (start, *rest), at_start = 0, text.split(" "), True
    run = [start]
    for word in rest:
        # a space whose neighbours are not both plain proves nothing: what it parts is encoded together
        if run[-1] and word and loaded.plain(run[-1][-1]) and loaded.plain(word[0]):
            total, run, at_start = total + flush(run, at_start), [word], False
        else:
            run.append(word)
    return total + flush(run, at_start)


def stable_boundaries(text: str, loaded: Tokenizer) -> tuple[list[int], list[int], int]:
    """Stable boundaries of ``text``, the number of tokens before each, and of all tokens."""
    starts, ends = loaded.spans(text)
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    places, before, at = [], [], text.find(" ", 1)
    while 0 <= at < len(text) - 1:
        if loaded.plain(text[at - 1]) and loaded.plain(text[at + 1]):
            k = int(np.searchsorted(starts, at))
            if not k or reach[k - 1] <= at:
                places.append(at)
                before.append(k)
        at = text.find(" ", at + 1)
    return places, before, len(starts)


def overlap_boundaries(text: str, part: int, parts: int, chunk: int, overlap: int, n: int, loaded: Tokenizer) -> tuple[list[int], list[int], list[int], list[int]]:
    """Stable boundaries of a chunk's two overlaps, counted from their starts, with the chunk's tokens before each."""
    head, head_n, tail, tail_n = [], [], [], []
    if part:
        for at, before in zip(*stable_boundaries(text[: overlap + MARGIN], loaded)[:2], strict=True):
            if at < overlap:
                head.append(at)
                head_n.append(before)
    if part + 1 < parts:
        low = max(0, chunk - MARGIN)
        places, before, total = stable_boundaries(text[low:], loaded)
        for at, k in zip(places, before, strict=True):
            if low + at >= chunk:
                tail.append(low + at - chunk)
                tail_n.append(n - total + k)
    return head, head_n, tail, tail_n


def cut_chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """A row per chunk of a long text: it starts at a multiple of ``chunk`` and runs ``overlap`` into the next one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                # the last chunk holds more than the overlap
                parts = max(1, -(-(len(text) - overlap) // chunk))
                one = batch.slice(i, 1)
                for part in range(parts):
                    piece = text[part * chunk : (part + 1) * chunk + overlap if part + 1 < parts else None]
                    yield pa.RecordBatch.from_arrays([one.column("name"), pa.array([part]), pa.array([parts]), pa.array([piece])], names=["name", "part", "parts", "text"])

    lean = long.select(F.col(PLACE).alias("name"), "text")
    return lean.mapInArrow(run, f"name {lean.schema['name'].dataType.simpleString()}, part long, parts long, text string")


def encode_chunks(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Per chunk its tokens, and the stable boundaries of its two overlaps with the tokens before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, _ = tokenizer(path)
        for batch in batches:
            n, columns = [], [[], [], [], []]
            for part, parts, text in zip(batch.column("part").to_pylist(), batch.column("parts").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n.append(count_text(text, path))
                for column, value in zip(columns, overlap_boundaries(text, part, parts, chunk, overlap, n[-1], loaded), strict=True):
                    column.append(value)
            lists = [pa.array(c, pa.list_(pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("part"), pa.array(n, pa.int64()), *lists], names=["name", "part", "n", "head", "head_n", "tail", "tail_n"])

    kind = chunks.schema["name"].dataType.simpleString()
    return chunks.mapInArrow(run, f"name {kind}, part long, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")


def splice(encoded: DataFrame) -> DataFrame:
    """Per document (name, n_tokens); null where two neighbouring chunks have no stable boundary in common.

    Chunks and seams are added up independently: a seam takes away what its left chunk holds after the boundary and its right chunk before it.
    """
    left = encoded.select("name", F.col("part").alias("seam"), F.col("n").alias("left_n"), "tail", "tail_n")
    right = encoded.filter("part > 0").select("name", (F.col("part") - 1).alias("seam"), "head", "head_n")
    # every part but the last has a seam to its right
    seams = right.join(left, ["name", "seam"]).withColumn("at", F.try_element_at(F.array_intersect("tail", "head"), F.lit(1)))
    kept = F.element_at("tail_n", F.array_position("tail", F.col("at")).cast("int")) - F.col("left_n")
    cut = F.element_at("head_n", F.array_position("head", F.col("at")).cast("int"))
    mended = seams.select("name", F.when(F.col("at").isNotNull(), kept - cut).alias("n"), F.col("at").isNull().alias("failed"))
    parts = encoded.select("name", "n", F.lit(False).alias("failed")).union(mended)
    return parts.groupBy("name").agg(F.when(~F.max("failed"), F.sum("n")).alias("n_tokens"))


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens of the whole text by the file at ``path``.

    Null text counts as empty: no tokens.  A null id stays null; repeated rows are counted each; ties do not occur, as
    every row stands alone.  No input gives no rows; other columns are not read.  One document's text must fit a
    task, as in any row; its encoding need not, as long texts are encoded chunk by chunk in many tasks.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = lean.schema["doc_id"].dataType.simpleString()
    is_long = F.length("text") > chunk + overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count_text(content, path) for content in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    if not tokenizer(path)[0].stable:
        return lean.select("doc_id", n_bytes, "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    short = lean.filter(~is_long).select("doc_id", n_bytes, "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    placed = with_place(docs)
    long = placed.select(PLACE, F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).filter(is_long)
    names = long.select(F.col(PLACE).alias("name"), "doc_id", n_bytes)
    todo, done = long, None
    while True:
        # chunks are dealt out before they are encoded, so one document keeps many tasks busy
        dealt = cut_chunks(todo, chunk, overlap).repartition("name", "part")
        counted = cut_lineage(splice(cut_lineage(encode_chunks(dealt, path, chunk, overlap))))
        good = counted.filter("n_tokens IS NOT NULL")
        done = good if done is None else done.union(good)
        failed = counted.filter("n_tokens IS NULL").select(F.col("name").alias(PLACE))
        if failed.isEmpty():
            break
        todo, overlap = long.join(failed, PLACE, "left_semi"), overlap * WIDER
    return short.union(names.join(done, "name").select("doc_id", "n_bytes", "n_tokens"))


@query("op11_token_counts")
def op11_token_counts(spark, folder):
    return count_tokens(table(spark, folder, "documents")).withColumn("over_limit", F.col("n_tokens") > 2048)

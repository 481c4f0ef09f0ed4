"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to three bytes long with the counts of the bytes that
followed.  A byte costs what its longest known context charges; a byte that a context has not seen pays the context's escape
(distinct followers over all followers and distinct ones, as in method C) and goes to the next shorter context, which
charges it among the bytes still possible.  Below the shortest context all 256 bytes are alike.  Code lengths are exact and add
up to a proper distribution at every step.  The statistics are frozen, so the charges of all
languages are laid out as one table over the union of their contexts, and a text is one pass of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import doc_key
from .registry import query, table

ORDER = 3
#: Bytes of text that each language learns from, at most and about: rows are drawn by hash at the rate that gives so much.
SAMPLE_BYTES = 4_000_000
#: Times a context of two or three bytes must occur, over all languages, to be kept.
LEAST_SEEN = 3
SLICE = 1 << 19


class Model:
    """Charges in bits of (context, byte, language); built from counts of four-byte windows."""

    def __init__(self, languages: list[str], counts: list[tuple[int, int, int]]):
        """``counts``: (language number, window as a big-endian 32-bit number, times)."""
        self.languages = languages
        table_ = np.array(counts, np.int64).reshape(-1, 3)
        which, window, times = table_.T
        data = np.stack([(window >> s) & 255 for s in (24, 16, 8, 0)])
        known = np.unique(np.concatenate([[0], data[3]]))
        self.symbol = np.full(256, len(known), np.int32)  # the last symbol stands for every byte never seen
        self.symbol[known] = np.arange(len(known))
        self.size = size = len(known) + 1
        symbols, unseen = self.symbol[data], 256 - len(known)
        share = np.ones(size)
        share[-1] = max(unseen, 1)
        state = np.zeros(1, np.int64)  # state of each context of the present order, dense
        tables, first, parent_rows = [], 0, None
        probability = np.empty((len(languages), 1, size))
        probability[:] = share / 256 if unseen else np.append(np.full(size - 1, 1 / 256), 1e-12)
        for order in range(ORDER + 1):
            code = np.zeros(len(window), np.int64)
            for k in range(ORDER - order, ORDER):
                code = code * size + symbols[k]
            total = np.bincount(code, times, minlength=size**order) if len(code) else np.zeros(size**order)
            kept = np.flatnonzero(total >= (LEAST_SEEN if order > 1 else 1)) if order else np.zeros(1, np.int64)
            parent = state[kept % size ** (order - 1)] if order else np.zeros(1, np.int64)
            number = np.full(size**order, -1, np.int64)
            number[kept] = np.arange(len(kept))
            at = number[code]
            rows = at >= 0
            seen = np.zeros((len(languages), len(kept), size))
            np.add.at(seen, (which[rows], at[rows], symbols[3][rows]), times[rows])
            below = probability if not order else self._all(tables)[:, parent]
            tables.append(self._charge(seen, below))
            dense = np.tile(state, size) if order else np.zeros(1, np.int64)
            dense[kept] = first + np.arange(len(kept))
            state, first = dense, first + len(kept)
        self.state = state.astype(np.int32)
        bits = self._all(tables)
        bits[:, :, -1] /= share[-1]
        self.bits = np.ascontiguousarray((-np.log2(bits)).transpose(1, 2, 0).reshape(-1, len(languages)).astype(np.float32))

    @staticmethod
    def _all(tables: list[np.ndarray]) -> np.ndarray:
        return np.concatenate(tables, axis=1)

    @staticmethod
    def _charge(seen: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities in each context, given those of the next shorter one."""
        total, distinct = seen.sum(axis=2, keepdims=True), (seen > 0).sum(axis=2, keepdims=True)
        possible = np.where(seen > 0, 0.0, below)
        mass = possible.sum(axis=2, keepdims=True)
        escape = np.where(mass > 0, distinct, 0)
        weight = np.maximum(total + escape, 1)
        lower = np.divide(possible, mass, out=np.zeros_like(possible), where=mass > 0)
        return np.where(total > 0, seen / weight + escape / weight * lower, below)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of every text (rows) under every language."""
        pad = b"\0" * ORDER
        whole = np.frombuffer(pad.join([b"", *texts]), np.uint8)
        symbols = self.symbol[whole]
        ends = np.cumsum([ORDER + len(t) for t in texts])
        starts = ends - np.array([len(t) for t in texts])
        out, n = np.zeros((len(texts), len(self.languages))), self.size
        for a in range(ORDER, len(whole), SLICE):
            b = min(a + SLICE, len(whole))
            code = (symbols[a - 3 : b - 3] * n + symbols[a - 2 : b - 2]) * n + symbols[a - 1 : b - 1]
            charge = self.bits[self.state[code] * n + symbols[a:b]]
            for i in range(np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")):
                s, e = max(starts[i], a), min(ends[i], b)
                if e > s:
                    out[i] += charge[s - a : e - a].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language of the shortest code (first in order of names in a tie), and its share of the posterior."""
        bits = self.lengths(texts)
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
        return [self.languages[i] for i in best], share


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language, how often each four-byte window occurs; a text starts after zero bytes."""
    totals: dict[str, dict] = {}
    for batch in batches:
        languages = batch.column("lang").to_pylist()
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(languages)):
            held = totals.setdefault(lang, {"keys": np.empty(0, np.uint32), "n": np.empty(0, np.int64)})
            keys = []
            for mine, text in zip(languages, texts, strict=True):
                if mine == lang:
                    data = np.frombuffer(b"\0" * ORDER + text, np.uint8).astype(np.uint32)
                    keys.append((data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:])
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            both, inverse = np.unique(np.concatenate([held["keys"], found]), return_inverse=True)
            held["keys"], held["n"] = both, np.bincount(inverse, np.concatenate([held["n"], n])).astype(np.int64)
    for lang, held in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held["n"])), pa.array(held["keys"].astype(np.int64)), pa.array(held["n"])], names=["lang", "window", "n"])


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Model of the languages in ``docs(doc_id, text, lang)``, from about ``sample_bytes`` of each; None if there are none."""
    usable = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND octet_length(text) > 0").select("doc_id", "text", "lang")
    sizes = usable.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    rates = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.col("bytes")).alias("rate")).collect()  # a row per language
    if not rates:
        return None
    rate = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(r["rate"])) for r in rates])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", F.octet_length("text")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.filter(draw < rate).select("lang", F.col("text").cast("binary").alias("text"))
    counts = sample.mapInArrow(_windows, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    which = [number[lang] for lang in counts.column("lang").to_pylist()]
    return Model(languages, np.column_stack([which, counts.column("window").to_numpy(), counts.column("n").to_numpy()]))


def identified(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score.

    ``und`` and 0 where the text is null or has no letter, and everywhere without a model.
    Repeated rows are predicted alike, null ids pass through, no input gives no rows; other columns are not read.
    """
    lean = docs.select(F.col(doc_id).alias("doc_id"), F.when(F.col(text).rlike(r"\p{L}"), F.col(text).cast("binary")).alias("text"))
    if model is None:
        return lean.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            written = [i for i, t in enumerate(texts) if t]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if written:
                for i, lang, score in zip(written, *shared.value.predict([texts[i] for i in written]), strict=True):
                    langs[i], scores[i] = lang, float(score)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return lean.mapInArrow(run, f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


@query("op8_ppm_language")
def op8_ppm_language(spark, folder):
    docs = table(spark, folder, "documents")
    model = learn(docs.filter(doc_key(F.col("doc_id")) % 4 != 2))
    return identified(docs, model).select("doc_id", (doc_key(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score")

"""Quality scores: a Gaussian kernel over document statistics, by random Fourier features.

Whole texts become a few statistics.  Cosines along fixed random directions of the standardised
statistics approximate a Gaussian kernel; ridge regression on them needs only the sums of their products, which
every partition adds up for itself.  Scores are then calibrated by isotonic regression on rows that the ridge has not seen.
Only statistics of the text enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import PLACE, doc_key, keep_rows, row_name, with_place
from .registry import query, table

FEATURES = 256
RIDGE = 1e-4
#: Labelled rows whose products one task adds up, and steps of the calibration curve.
ROWS_A_TASK, STEPS = 20_000, 2048
LOWEST = 0.3

_CLASSES = np.zeros((256, 7))
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".,;:!?'\"()-", b" \t\n\x0b\f\r")):
    _CLASSES[list(_set), _i] = 1
_CLASSES[_CLASSES.sum(axis=1) == 0, 6] = 1  # other symbols
_SYMBOL = frozenset(np.flatnonzero(_CLASSES[:, 6]).tolist())
NAMES = ("size", "lower", "upper", "digit", "beyond_ascii", "point", "white", "symbol", "entropy", "words", "word_length", "word_spread", "distinct", "odd_ends",
         "lines", "line_words", "line_repeats", "capitals")


def statistics(text: bytes) -> list[float]:
    """Statistics of one whole text; an empty text has zeros throughout."""
    if not text:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = counts / len(text)
    seen = share[share > 0]
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    odd = sum(w[-1] in _SYMBOL for w in words)
    return [
        np.log1p(len(text)), *(share @ _CLASSES), float(-(seen * np.log2(seen)).sum()), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()),
        np.log1p(len(set(words))) / np.log1p(n), odd / n, np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
        sum(w[:1].isupper() for w in words) / n]


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(doc_id, fold_key, __row, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t or b"") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "fold_key", "__row")), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "fold_key", "__row", "stats"])

    lean = docs.select(
        F.col(doc_id).alias("doc_id"), doc_key(F.col(doc_id)).alias("fold_key"), row_name(row).alias("__row"), F.col(text).cast("binary").alias("text"))
    kind = {c: lean.schema[c].dataType.simpleString() for c in ("doc_id", "__row")}
    return lean.mapInArrow(run, f"doc_id {kind['doc_id']}, fold_key long, __row {kind['__row']}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))


class Model:
    """Standardisation, random directions, ridge weights and calibration curve; all of fixed size."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int):
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((len(NAMES), FEATURES)) / np.sqrt(len(NAMES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.curve: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -5, 5)
        return np.column_stack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / FEATURES), np.ones(len(z))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), *self.curve) if self.curve else self.raw(stats), 0.0, 1.0)


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value, strict=True):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([np.full(n, v) for _, v, n in blocks])


def fit(stats: DataFrame, labels: DataFrame, seed: int = 3) -> Model:
    """Model from labelled rows of folds 1 to 3 (ridge) and 4 (calibration) of five; fold 0 is held out.

    ``labels`` is (doc_id, label 0/1); null labels teach nothing, several labels of one document count as their majority (1 in a tie).
    Without labelled rows every score is 0.5.
    """
    truth = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    known = stats.withColumn("fold", F.col("fold_key") % 5).filter("fold > 0").join(truth, "doc_id").select("fold", "label", "stats", "__row")
    moments = known.agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(len(NAMES))), *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(len(NAMES)))).first()
    n = moments["n"]
    if not n:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), seed)
    model = Model(np.array([moments[f"m{i}"] for i in range(len(NAMES))]), np.array([moments[f"s{i}"] for i in range(len(NAMES))]), seed)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = model.features(_matrix(part.column("stats")))
                total += x.T @ np.column_stack([x, part.column("label").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "sums"])

    def added(group: pa.Table) -> pa.Table:
        rows = group.column("sums").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        return pa.table({"i": group.column("i").slice(0, 1), "sums": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    tasks = max(1, -(-n // ROWS_A_TASK))
    partial = known.filter("fold < 4").repartition(tasks, "__row").select("label", "stats").mapInArrow(products, "i int, sums array<double>")
    sums = partial.groupBy("i").applyInArrow(added, "i int, sums array<double>").orderBy("i").collect()  # FEATURES + 1 rows
    products_sum = np.array([r["sums"] for r in sums])
    if not products_sum[-1, -2]:  # no rows in folds 1 to 3
        return model
    gram, target = products_sum[:, :-1], products_sum[:, -1]
    model.weights = np.linalg.solve(gram + RIDGE * gram[-1, -1] * np.eye(len(gram)) / FEATURES + 1e-9 * np.eye(len(gram)), target)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = np.floor((np.clip(model.raw(_matrix(batch.column("stats"))), -0.5, 1.5) + 0.5) / 2 * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(steps), batch.column("label")], names=["step", "label"])

    binned = known.filter("fold = 4").select("label", "stats").mapInArrow(raw, "step int, label double")
    curve = binned.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean")).orderBy("step").collect()  # STEPS + 1 rows at most
    if curve:
        centres = (np.array([r["step"] for r in curve]) + 0.5) / STEPS * 2 - 0.5
        model.curve = centres, isotonic(np.array([r["n"] for r in curve], float), np.array([r["mean"] for r in curve]))
    return model


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lowest: float = LOWEST, row: str | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``lowest`` on); also ``__row``, the column ``row`` or a number of this read.

    Null text counts as empty and is scored like any text; documents with a null id are scored and never teach;
    repeated rows score alike.  No input gives no rows; other columns are not read.
    """
    stats = cut_lineage(with_statistics(docs, doc_id, text, row))
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(model.score(_matrix(batch.column("stats"))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold_key"), batch.column("__row"), score], names=["doc_id", "fold_key", "__row", "score"])

    kind = {c: stats.schema[c].dataType.simpleString() for c in ("doc_id", "__row")}
    rows = stats.mapInArrow(run, f"doc_id {kind['doc_id']}, fold_key long, __row {kind['__row']}, score double")
    return rows.select("doc_id", (F.col("fold_key") % 5 == 0).alias("held_out"), "score", (F.col("score") >= lowest).cast("int").alias("predicted"), "__row")


def keep_good(docs: DataFrame, labels: DataFrame, lowest: float = LOWEST) -> DataFrame:
    """The documents that are not rejected, with their own columns; ``labels`` is (doc_id, quality, ...)."""
    placed = with_place(docs)
    truth = labels.select("doc_id", F.col("quality").alias("label"))
    return keep_rows(placed, scored(placed, truth, lowest=lowest, row=PLACE).filter("predicted = 1").select("__row"))


@query("op6_fourier_quality")
def op6_fourier_quality(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return scored(table(spark, folder, "documents"), labels).drop("__row")

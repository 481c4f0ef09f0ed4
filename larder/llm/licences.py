"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Every line of every file is a candidate header.  Its terms weigh by how few documents hold them, words
that no template has too: their frequencies are joined to the lines that could reach the least cosine if all those words were
in every document, where a word weighs least.  A line can reach the least cosine to a
template only if it has one of the template's *anchors*: without those, the rest of the template is too short
a vector.  So only lines with an anchor are compared, and nothing is missed.  A file that is mostly licence, or is named so,
is a licence file; files without a licence of their own take that of the nearest directory above that holds one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .registry import query, table

#: Names of licences and the usual wording of their notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
LEAST = 0.8
TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def vocabulary(templates: Sequence[tuple[str, str]]) -> list[str]:
    return sorted({t for _, text in templates for t in terms(text)})


#: Distinct terms that a task counts before it passes them on.
HELD = 1 << 18


def term_counts(files: DataFrame, text: str) -> DataFrame:
    """(term, n): the number of documents that hold each term, in parts to be summed; the empty term stands for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        part = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])
        for batch in batches:
            for content in batch.column("text").to_pylist():
                held[""] += 1
                held.update(set(terms(content or "")))
                if len(held) > HELD:
                    yield part()
                    held.clear()
        yield part()

    return files.select(F.col(text).alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def document_frequency(files: DataFrame, words: Sequence[str], text: str) -> tuple[int, dict[str, int]]:
    """The number of documents, and of those that hold each template term."""
    return collected(term_counts(files, text), words)


def collected(counts: DataFrame, words: Sequence[str]) -> tuple[int, dict[str, int]]:
    counts = counts.filter(F.col("term").isin("", *words)).collect()  # a row per template term
    found = {r["term"]: r["n"] for r in counts}
    return found.pop("", 0), found


class Matcher:
    """Cosine of a line to every template under given document frequencies."""

    def __init__(self, templates: Sequence[tuple[str, str]], documents: int, frequency: dict[str, int], least: float):
        words = vocabulary(templates)
        self.names, self.least = [name for name, _ in templates], least
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1 for w in words}
        self.documents = documents
        self.vectors, anchors = [], set()
        for _, text in templates:
            weights = {t: n * self.idf[t] for t, n in Counter(terms(text)).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            vector = {t: w / norm for t, w in weights.items()}
            self.vectors.append(vector)
            rest = 1.0
            for t in sorted(vector, key=lambda t: (-vector[t], t)):
                if rest < least * least:
                    break
                anchors.add(t)
                rest -= vector[t] ** 2
        self.anchors = frozenset(anchors)

    def _best(self, weights: dict[str, float]) -> tuple[float, str] | None:
        norm = math.sqrt(sum(w * w for w in weights.values()))
        score, name = max(((sum(w * v.get(t, 0.0) for t, w in weights.items()) / norm, n) for v, n in zip(self.vectors, self.names, strict=True)), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        return (score, name) if score >= self.least else None

    def line(self, words: list[str], others: dict[str, int] | None = None) -> tuple[float, str] | None:
        """Best cosine and its licence (the first by name in a tie) if it is high enough; ``others`` has the documents of words that no template has."""
        if not self.anchors.intersection(words):
            return None
        others = others or {}
        rest = lambda t: math.log((self.documents + 1) / (others.get(t, 0) + 1)) + 1
        return self._best({t: n * (self.idf[t] if t in self.idf else rest(t)) for t, n in Counter(words).items()})

    def text(self, text: str) -> tuple[int, list[str]]:
        """The number of words, and the lines (as words) that are high enough if other words weigh least, 1."""
        words = terms(text)
        if not self.anchors.intersection(words):
            return len(words), []
        lines = [terms(line) for line in text.split("\n")]
        return len(words), [" ".join(x) for x in lines if self.anchors.intersection(x) and self._best({t: n * self.idf.get(t, 1.0) for t, n in Counter(x).items()})]


def directory(path: Column) -> Column:
    """What stands before the last slash; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def scan(files: DataFrame, path: Column, text: str = "text", keep: Sequence[str] = ("doc_id",), templates: Sequence[tuple[str, str]] = TEMPLATES,
         least: float = LEAST, mostly: float = 0.5) -> DataFrame:
    """Per file: the kept columns, path, licence, how (own, inherited or null), score and origin (the path it comes from).

    A file's own licence is that of its best line (ties: the first such line).  It is a licence file if ``mostly`` of its words are in
    licence lines, or if it has a licence line and a name like LICENSE.  Of several licence files in a directory the one with the
    least path counts.  Null or empty text has no licence of its own; a null path is its own directory at the top
    and inherits nothing; repeated rows get the same answer.  No input gives no rows; columns not named are not read.
    """
    counts = cut_lineage(term_counts(files, text))
    matcher = Matcher(templates, *collected(counts, vocabulary(templates)), least)
    lean = files.select(*keep, path.alias("path"), F.monotonically_increasing_id().alias("__row"), F.col(text).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema.fields if f.name != "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.text(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*keep, "path", "__row")), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.string()))],
                names=[*keep, "path", "__row", "words", "lines"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for row, pos, line, others in zip(*(batch.column(c).to_pylist() for c in ("__row", "pos", "line", "others")), strict=True):
                words = line.split(" ")
                if (hit := matcher.line(words, {x["term"]: x["n"] for x in others})) is not None:
                    hits.append((row, pos, min(hit[0], 1.0), hit[1], len(words)))
            columns = list(zip(*hits, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.string(), pa.int64()), strict=True)], names=["__row", "pos", "score", "own", "inside"])

    searched = cut_lineage(lean.mapInArrow(find, f"{kinds}, words long, lines array<string>"))
    lines = searched.select("__row", F.posexplode("lines").alias("pos", "line"))
    # A line that can still be similar has few other words, so its list is short.
    each = lines.select("__row", "pos", "line", F.explode(F.array_distinct(F.split("line", " "))).alias("term"))
    weighed = each.join(counts, "term", "left").groupBy("__row", "pos").agg(F.first("line").alias("line"), F.collect_list(F.struct("term", F.coalesce("n", F.lit(0)).alias("n"))).alias("others"))
    hits = weighed.mapInArrow(judge, "__row long, pos int, score double, own string, inside long")
    own = hits.groupBy("__row").agg(F.max(F.struct("score", (-F.col("pos")).alias("first"), "own")).alias("best"), F.sum("inside").alias("inside"))
    scanned = cut_lineage(searched.drop("lines").join(own, "__row", "left").select(
        *keep, "path", F.col("best.own").alias("own"), F.col("best.score").alias("own_score"), (F.col("inside") / F.col("words")).alias("part"), directory(F.col("path")).alias("dir")))
    is_file = F.col("own").isNotNull() & ((F.col("part") >= mostly) | F.col("path").rlike(FILE_NAME))
    licensed = scanned.filter(is_file & F.col("path").isNotNull()).groupBy("dir").agg(F.min(F.struct("path", "own", "own_score")).alias("from"))
    # Each directory once, however many files it holds, with all directories above it.
    dirs = scanned.filter("own IS NULL AND path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    above = above.select("dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("up"))
    nearest = above.join(licensed.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by("from", "depth").alias("from"))
    rows = scanned.join(nearest, (scanned["dir"] == nearest["dir"]) & scanned["own"].isNull(), "left")
    own = F.col("own").isNotNull()
    return rows.select(
        *keep, "path", F.coalesce("own", "from.own").alias("licence"), F.when(own, "own").when(F.col("from").isNotNull(), "inherited").alias("how"),
        F.when(own, F.col("own_score")).otherwise(F.col("from.own_score")).alias("score"), F.when(own, F.col("path")).otherwise(F.col("from.path")).alias("origin"))


def document_path(source: Column, doc_id: Column) -> Column:
    """Documents as files: a folder per source, folders of a hundred documents inside."""
    return F.concat(F.coalesce(source, F.lit("none")), F.lit("/"), F.expr("CAST(doc_id DIV 100 AS STRING)"), F.lit("/"), doc_id.cast("string"), F.lit(".txt"))


@query("op10_licence_scan")
def op10_licence_scan(spark, folder):
    return scan(table(spark, folder, "documents"), document_path(F.col("source"), F.col("doc_id")))

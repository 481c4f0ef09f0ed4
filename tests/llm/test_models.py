"""Classifiers, searches and scans: brute force, held-out accuracy and odd rows."""

import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from larder.llm import language, licences, neighbours, quality, urls

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

MIDDLE = "/root/testdata/sf0.01"


# neighbours

def brute_nearest(vectors, query, k):
    scored = sorted(((-float(np.dot(v, query[1])), i) for i, v in vectors if i != query[0]))
    return [i for _, i in scored[:k]]


def test_neighbours_reach_recall(spark, small):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").collect()]
    found = neighbours.op2_collision_counting(spark, MIDDLE).collect()
    hits = total = 0
    by_id = dict(rows)
    for q in [r for r in rows if r[0] % 20 == 0]:
        mine = sorted((r for r in found if r.query_id == q[0]), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(float(by_id[r.vec_id] @ q[1]), abs=1e-12) and r.vec_id != q[0] for r in mine)
        hits += len({r.vec_id for r in mine} & set(brute_nearest(rows, q, 20)))
        total += 20
    assert hits / total >= 0.9


def test_neighbours_in_several_blocks_and_norms(spark):
    rng = np.random.default_rng(4)
    data = [(i, (rng.standard_normal(8) * rng.uniform(0.1, 10)).tolist()) for i in range(400)]
    frame = neighbours.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    found = neighbours.nearest(frame.filter("vec_id % 20 = 0"), frame, 5, block=100, query_block=7).collect()
    arrays = [(i, np.array(v)) for i, v in data]
    hits = sum(r.vec_id in brute_nearest(arrays, arrays[r.query_id], 5) for r in found)
    assert len(found) == 20 * 5 and hits >= 90


@pytest.mark.parametrize("outstanding", [1.0, 2.0, 4.0, 10.0, 1e6])
def test_neighbours_beside_an_outstanding_norm(spark, outstanding):
    rng = np.random.default_rng(6)
    data = rng.standard_normal((1500, 32))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[777] *= outstanding
    frame = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>"))
    found = neighbours.nearest(frame.filter("vec_id % 20 = 0"), frame, 10).collect()
    arrays = list(enumerate(data))
    asked = [i for i in range(1500) if i % 20 == 0]
    best = {q: set(brute_nearest(arrays, (q, data[q]), 10)) for q in asked}
    hits = sum(r.vec_id in best[r.query_id] for r in found)
    assert len(found) == 10 * len(asked) and hits >= 0.9 * len(found)


def test_neighbours_of_extreme_components(spark):
    data = [(i, [float(i + 1) * 10.0 ** e, 1.0]) for i, e in enumerate([160, -200, 0, 150, -300, 307, 0, 3])] + [(20, [1e160, -1e160]), (40, [1e-200, 1e-200])]
    frame = neighbours.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    found = neighbours.nearest(frame.filter("vec_id % 20 = 0"), frame, 3).collect()
    assert {r.query_id for r in found} == {0, 20, 40} and len(found) == 9 and all(r.vec_id != r.query_id for r in found)


def test_neighbours_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0])]
    frame = neighbours.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    found = neighbours.nearest(frame.filter("vec_id % 20 = 0"), frame, 20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, 1), (0, 2, 1), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 1)]
    empty = frame.limit(0)
    assert neighbours.nearest(empty, frame).count() == 0 and neighbours.nearest(frame, empty).count() == 0


# quality

def test_quality_on_held_out_rows(spark, small):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = quality.op6_fourier_quality(spark, MIDDLE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(p == t for p, t in held) / len(held) >= 0.95


def test_quality_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1), (8, 0), (None, 1), (99, 0), (12, None)], "doc_id long, label int")
    rows = quality.scored(odd, labels).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(nothing, labels).count() == 0
    kept = quality.keep_good(odd, labels.withColumnRenamed("label", "quality"))
    assert kept.columns == odd.columns


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(0)
    value, weight = rng.uniform(0, 1, 40), rng.uniform(1, 3, 40)
    fitted = quality.isotonic(weight, value)
    assert (np.diff(fitted) >= -1e-12).all()
    # min-max formula of isotonic regression
    mean = lambda a, b: np.average(value[a : b + 1], weights=weight[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(fitted, want)


# language

def brute_bits(model, counts, lang, text):
    """Code length of a text, symbol by symbol, straight from the counts."""
    known = set(np.flatnonzero(model.symbol < model.size - 1).tolist())
    folded = lambda b: b if b in known else -1
    trees, overall = {}, Counter()
    for l2, window, n in counts:
        data = [folded((window >> s) & 255) for s in (24, 16, 8, 0)]
        for k in range(4):
            context = tuple(data[3 - k : 3])
            overall[context] += n
            if l2 == lang:
                trees.setdefault(context, Counter())[data[3]] += n
    alphabet = [*sorted(known), -1]

    def chance(context):
        if len(context) == 0:
            below = {s: (256 - len(known) if s == -1 else 1) / 256 for s in alphabet}
        else:
            below = chance(context[1:])
        seen = trees.get(context)
        if (len(context) > 1 and overall[context] < language.LEAST_SEEN) or not seen:
            return below
        total, rest = sum(seen.values()), sum(p for s, p in below.items() if s not in seen)
        escape = len(seen) if rest > 0 else 0
        return {s: seen[s] / (total + escape) if s in seen else escape / (total + escape) * below[s] / rest for s in alphabet}

    bits, data = 0.0, [0, 0, 0, *text]
    for i in range(3, len(data)):
        context, symbol = tuple(folded(b) for b in data[i - 3 : i]), folded(data[i])
        p = chance(context)
        assert sum(p.values()) == pytest.approx(1)
        bits -= math.log2(p[symbol] / ((256 - len(known)) if symbol == -1 else 1))
    return bits


def test_code_lengths_match_brute_force():
    samples = [b"the cat and the hat", b"der hund und das haus", "été à la".encode()]
    counts = Counter()
    for lang, text in enumerate(samples):
        data = b"\0\0\0" + text * 3
        for i in range(3, len(data)):
            counts[(lang, int.from_bytes(data[i - 3 : i + 1], "big"))] += 1
    rows = [(a, b, n) for (a, b), n in counts.items()]
    model = language.Model(["en", "de", "fr"], rows)
    texts = [b"the hat", b"das und", b"xyz\xff!", b"", "là".encode()]
    got = model.lengths(texts)
    for i, text in enumerate(texts):
        for lang in range(3):
            assert got[i, lang] == pytest.approx(brute_bits(model, rows, lang, text), rel=1e-5, abs=1e-5)


def test_slices_do_not_change_lengths(monkeypatch):
    model = language.Model(["en"], [(0, int.from_bytes(b"\0abc", "big"), 3), (0, int.from_bytes(b"abcd", "big"), 2)])
    texts = [b"abcd" * 50, b"", b"dcba" * 30]
    whole = model.lengths(texts)
    monkeypatch.setattr(language, "SLICE", 7)
    assert np.allclose(model.lengths(texts), whole)


def test_language_on_held_out_rows(spark, small):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op8_ppm_language(spark, MIDDLE).collect()
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.98


def test_language_odd_rows(odd, odd_rows, nothing):
    model = language.learn(odd)
    rows = language.identified(odd, model).collect()
    assert len(rows) == len(odd_rows)
    assert Counter(r.lang_pred == "und" for r in rows)[True] == sum(not any(c.isalpha() for c in r[1] or "") for r in odd_rows)
    assert language.learn(nothing) is None and {r.lang_pred for r in language.identified(odd, None).collect()} == {"und"}
    assert language.identified(nothing, model).count() == 0


# URLs

def test_urls_match_sql(spark):
    from compare import compare, open_duck

    for folder in ("/root/testdata/sf0.001", MIDDLE):
        ok, note = compare(spark, open_duck(folder), "op5", urls.op5_url_models, urls._oracle(), folder)
        assert ok, note


def test_urls_odd_rows(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme/x": ("", "", None), "http://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1"), "x://notexample.org/es/": ("notexample.org", "/es/", "org/"), "http://org": ("org", "", None),
        "http://u@h.com:80/de/": ("u@h.com:80", "/de/", None), "http://h.com/de/a": ("h.com", "/de/a", "com/de/"), "http://h.com/fr/?q=://b.org/": ("h.com", "/fr/", "com/fr/"),
        "http://É.com/fr/x\ny": ("É.com", "/fr/x\ny", "com/fr/"), "http://h.net?a/b": ("h.net", "", None), "http://" + "l" * 5000 + ".net/": ("l" * 5000 + ".net", "/", None)}
    data = [(i, u, "html", "x") for i, u in enumerate(cases)] * 2
    rows = urls.judge(spark.createDataFrame(data, "page_id long, url string, html string, verdict string")).collect()
    assert len(rows) == len(data)
    for r in rows:
        want = list(cases.values())[r.page_id]
        assert (r.host, r.path, r.rule) == want
        assert r.verdict == {"org/": "allow", "com/fr/": "allow", "com/de/": "block", "example.org/es/": "block", "example.org/en/1": "block"}.get(r.rule, r.verdict)
        assert r.verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_models_tell_unruled_urls_apart(spark):
    data = [(i, f"http://a{i}.org/library/{i}") for i in range(200)] + [(1000 + i, f"http://b{i}.com/de/cheap-pills-{i}") for i in range(200)]
    data += [(5000, "http://z.net/library/77"), (5001, "http://z.net/de/cheap-pills-77")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(data, "page_id long, url string")).collect()}
    assert (got[5000], got[5001]) == ("allow", "block")


# licences

def test_no_line_is_missed_by_the_anchors(spark, small):
    files = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    total, frequency = licences.document_frequency(files, licences.vocabulary(licences.TEMPLATES), "text")
    matcher = licences.Matcher(licences.TEMPLATES, total, frequency, licences.LEAST)
    everything = licences.Matcher(licences.TEMPLATES, total, frequency, licences.LEAST)
    got = {r.doc_id: (r.own_licence, r.score) for r in licences.op10_licence_scan(spark, MIDDLE).selectExpr("doc_id", "IF(how = 'own', licence, NULL) AS own_licence", "score").collect()}
    found = 0
    for r in files.collect():
        best = None
        for line in (r.text or "").split("\n"):
            words = licences.terms(line)
            if not words:
                continue
            everything.anchors = frozenset(words)  # every line is compared
            hit = everything.line(words)
            if hit and (best is None or hit[0] > best[0]):
                best = hit
        assert got[r.doc_id][0] == (best and best[1])
        found += best is not None
        assert ("licensed under" in (r.text or "").lower() or "mit license" in (r.text or "").lower()) <= (best is not None)
    assert found > 10 and matcher.anchors


def test_nearest_directory_inherits(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    data = [
        (1, "a/LICENSE.txt", mit + "\n" + "more words " * 50, 1.0), (2, "a/b/c/x.txt", "nothing here", 1.0), (3, "a/b/note.txt", gpl, 1.0), (4, "a/d/y.txt", None, 1.0), (5, "z/y.txt", "", 1.0),
        (6, None, mit, 1.0), (7, None, "x", 1.0), (8, "top.txt", "plain", 1.0), (9, "a/b/c/own.txt", "Licensed under CC BY-NC 4.0.\n" + "body " * 90, 1.0), (9, "a/b/c/own.txt", "Licensed under CC BY-NC 4.0.\n" + "body " * 90, 1.0)]
    from pyspark.sql import functions as F

    rows = licences.scan(spark.createDataFrame(data, "doc_id long, path string, text string, score double"), F.col("path")).collect()
    got = Counter((r.doc_id, r.licence, r.how, r.origin) for r in rows)
    assert got == Counter([
        (1, "MIT", "own", "a/LICENSE.txt"), (2, "GPL-3.0", "inherited", "a/b/note.txt"), (3, "GPL-3.0", "own", "a/b/note.txt"), (4, "MIT", "inherited", "a/LICENSE.txt"), (5, None, None, None),
        (6, "MIT", "own", None), (7, None, None, None), (8, None, None, None), (9, "CC-BY-NC-4.0", "own", "a/b/c/own.txt"), (9, "CC-BY-NC-4.0", "own", "a/b/c/own.txt")])
    assert licences.scan(spark.createDataFrame([], "doc_id long, path string, text string"), F.col("path")).count() == 0

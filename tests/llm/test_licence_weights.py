"""Licence lines weigh all their words by how many documents hold them."""

import math
from collections import Counter

from pyspark.sql import functions as F

from larder.llm import licences


def plain(texts):
    """Best licence and cosine of each text by an unfiltered TF-IDF over all terms."""
    held = Counter(t for text in texts for t in set(licences.terms(text)))
    weigh = lambda text: {t: n * (math.log((len(texts) + 1) / (held[t] + 1)) + 1) for t, n in Counter(licences.terms(text)).items()}
    size = lambda v: math.sqrt(sum(w * w for w in v.values())) or 1.0
    out = []
    for text in texts:
        best = (0.0, None)
        for line in text.split("\n"):
            mine = weigh(line)
            for name, wording in licences.TEMPLATES:
                other = weigh(wording)
                score = sum(w * other.get(t, 0.0) for t, w in mine.items()) / size(mine) / size(other)
                best = max(best, (score, name), key=lambda x: x[0])
        out.append(best if best[0] >= licences.LEAST else (None, None))
    return out


def test_common_and_rare_words_beside_a_notice(spark, small, monkeypatch):
    monkeypatch.setattr(licences, "HELD", 20)
    texts = [f"body of text this file is a plain one with word{i}" for i in range(120)]
    texts += ["This file is released under the MIT License.", "# Released under the MIT License. this is", "Released under the MIT License. zebra quagga okapi", "first line\nReleased under the MIT License. word5\n", "Licensed under CC BY 4.0. plain", ""]
    data = [(i, f"d{i}/x.txt", t) for i, t in enumerate(texts)] * 2
    want = plain([t for _, _, t in data])
    rows = {r.doc_id: r for r in licences.scan(spark.createDataFrame(data, "doc_id long, path string, text string").repartition(3), F.col("path")).collect()}
    for (i, _, _), (score, name) in zip(data, want, strict=True):
        assert rows[i].licence == name and (score is None or abs(rows[i].score - score) < 1e-9)
    assert rows[120].licence == rows[121].licence == "MIT" and rows[122].licence is None

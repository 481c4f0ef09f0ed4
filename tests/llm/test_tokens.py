"""Token counts against the libraries themselves, with chunks small enough that odd texts are spliced and widened."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larder.llm import tokens

TEXTS = [
    "a  b", "\nfoo bar\n", " x", "x ", "tab\there x\ty", "nul \x00 x", "é É x", "", None, "<|endoftext|> x <|startoftext|>y a<|endoftext|>b", "　wide space x",
    "a\x1cb \x1c c d", "日本語 " * 300, "don't it's we'll   y", "x" * 5000, "ab " * 4000, "İSTANBUL ΣΣ ß", "x <|endoftext|> " * 300, "á " * 900, "ab " * 4000]


def counter(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return path, lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return path, lambda text: len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("chunk, overlap", [(400, 16), (16_384, 256)])
def test_counts_match_the_library(spark, small, name, chunk, overlap):
    path, count = counter(name)
    known = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    texts = TEXTS + known
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, path=path, chunk=chunk, overlap=overlap).collect()}
    assert got == {i: (len((t or "").encode()), count(t or "")) for i, t in enumerate(texts)}


def test_a_tokenizer_that_proves_nothing_encodes_whole_texts(spark, small, monkeypatch):
    path, count = counter("byte_bpe_50k.json")
    loaded, _ = tokens.tokenizer(path)
    monkeypatch.setattr(loaded, "stable", False)
    docs = spark.createDataFrame([(1, "one two " * 500), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path=path, chunk=100, overlap=5).collect()}
    assert got == {1: count("one two " * 500), 2: 0}


def test_boundaries_are_never_inside_a_token():
    path, _ = counter("word_bpe_49k.json")
    loaded, _ = tokens.tokenizer(path)
    text = "one two  three four"
    assert tokens.stable_boundaries(text, loaded) == ([3, 14], [1, 3], 4)

    class Crossing:
        plain = staticmethod(str.isalpha)

        def spans(self, text):
            return np.array([0, 2]), np.array([2, 5])

    assert tokens.stable_boundaries("a b c", Crossing()) == ([], [], 2)


def test_overlaps_hold_the_same_boundaries_from_both_sides():
    path, count = counter("byte_bpe_50k.json")
    loaded, _ = tokens.tokenizer(path)
    text = "some words and more words " * 20
    left, right = text[:260], text[200:]
    _, _, tail, tail_n = tokens.overlap_boundaries(left, 0, 2, 200, 60, count(left), loaded)
    head, head_n, _, _ = tokens.overlap_boundaries(right, 1, 2, 200, 60, count(right), loaded)
    assert set(tail) & set(head)
    for at in set(tail) & set(head):
        assert tail_n[tail.index(at)] == count(text[: 200 + at])
        assert count(text[: 200 + at]) + count(right) - head_n[head.index(at)] == count(text)


def test_odd_rows_and_empty_table(odd, odd_rows, nothing):
    rows = tokens.count_tokens(odd, chunk=1000, overlap=20)
    assert rows.columns == ["doc_id", "n_bytes", "n_tokens"]
    _, count = counter("word_bpe_49k.json")
    want = sorted((str(r[0]), len((r[1] or "").encode()), count(r[1] or "")) for r in odd_rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows.collect()) == want
    assert tokens.count_tokens(nothing).count() == 0


def test_query_reads_every_document(spark, small):
    rows = tokens.op11_token_counts(spark, small)
    _, count = counter("word_bpe_49k.json")
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in rows.collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert got == {r.doc_id: (count(r.text), count(r.text) > 2048) for r in docs}

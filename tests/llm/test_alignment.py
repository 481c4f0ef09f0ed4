"""Links between two tokenizers against plain loops over byte ranges."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from larder.llm import alignment

ODD = [
    "a  b", "\nfoo bar\n", " x", "x ", "a \n b", "tab\there x\ty", "▁ odd", "nul \x00 x", "é é x", "", None, "<|endoftext|> x", "　wide space x", "a\x1cb \x1c c d",
    "emoji \U0001f600 日本語 テスト x", "\n\n\n a b\n\nc d", "\n", "  ", "don't it's we'll   y", "x" * 3000, "one\ntwo three", "one\ntwo three", "ab " * 3000]


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    held, counts = [], Counter()
    for text in texts:
        held.append(None)
        if not text:
            continue
        a, b, want = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text), (" " + text).encode()
        a_bytes = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            continue
        a_span, b_span, links, low = spans(a_bytes), spans(b_bytes), [], 0
        for i, (start, end) in enumerate(a_span):
            while b_span[low][1] <= start:
                low += 1
            j = low
            while j < len(b) and b_span[j][0] < end:
                links.append((a[i], b[j]))
                j += 1
        groups, i, j = [], 0, 0
        for cut in sorted({e for _, e in a_span} & {e for _, e in b_span}):
            left, right = [], []
            while i < len(a) and a_span[i][1] <= cut:
                left.append(str(a[i]))
                i += 1
            while j < len(b) and b_span[j][1] <= cut:
                right.append(str(b[j]))
                j += 1
            groups.append(f"{','.join(left)}|{','.join(right)}")
        held[-1] = (len(a), len(b), groups, links)
        counts.update(links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for h in held:
        if h is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = h
        rows.append((n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows, counts


@pytest.mark.parametrize("frequent", [30, alignment.FREQUENT])
def test_matches_plain_loops(spark, small, frequent):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + ODD
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, best string").repartition(4)
    rows, pairs = alignment.align(docs, frequent=frequent)
    want, counts = brute(texts)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in rows.collect()} == dict(enumerate(want))
    assert {(r.a, r.b): r.n for r in pairs.collect()} == counts


def test_memory_of_words_may_empty_anywhere(spark, small, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 200)
    monkeypatch.setattr(alignment, "HELD_WORDS", 20)
    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    words, seen = alignment.Words(paths), Counter()
    texts = ["many words of a long text " * 40, "short", "bad ▁ " + "word and word " * 50, None, "two words"]

    def make_room():
        if words.full():
            words.reset()

    for docs, found, starts in words.blocks(texts, True, make_room):
        for i, start, end in zip(docs, starts.tolist(), [*starts[1:].tolist(), len(found)], strict=True):
            seen[i] += int(words.sums[found[start:end], 0].sum())
    want = brute(texts)[0]
    assert {i: n for i, n in seen.items()} == {i: w[0] for i, w in enumerate(want) if w[0]}


def test_identity_map_names_same_bytes():
    of = alignment.vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    mapped = (of.same >= 0).nonzero()[0]
    assert len(mapped) > 10_000
    assert all(of.a_length[i] == of.b_length[of.same[i]] for i in mapped)


def test_odd_rows_and_empty_table(odd, odd_rows, nothing):
    rows = alignment.align(odd)[0].collect()
    want = brute([r[1] for r in odd_rows])[0]
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in rows) == sorted((str(r[0]), *w) for r, w in zip(odd_rows, want, strict=True))
    assert alignment.align(nothing)[0].count() == 0

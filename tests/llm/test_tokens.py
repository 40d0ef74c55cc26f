"""Tokens against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from waybill.llm import bpe, token_counts
from waybill.llm.pretokens import Vocabulary
from waybill.llm.queries import QUERIES, VOCABULARY


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def encoder():
    vocabulary = Vocabulary.load(VOCABULARY)
    return bpe.Encoder(vocabulary, bpe.Merges.load(vocabulary))


def odd_texts():
    rng = random.Random(5)
    ranges = [(32, 127), (0, 32), (0xA0, 0x600), (0x2000, 0x2070), (0x3040, 0x3100), (0x4E00, 0x4F00), (0x550, 0x560),
              (0x1F600, 0x1F640), (0xA7C0, 0xA7F8), (0x1680, 0x1690), (0x370, 0x400), (0xFF00, 0xFF60)]
    for _ in range(400):
        pick = [ranges[0], *rng.sample(ranges, 2)]
        yield "".join(chr(rng.randrange(*rng.choice(pick))) for _ in range(rng.randrange(60)))
    yield from [
        "", " ", "  a  b ", "aaaa" * 500, "a" * 10_001, "x<|endoftext|>y <|endoftext|>", "<|endoftext|>", "<|endoftext",
        "I'll we've they're it's I'd don't 'S 'LL ''s", "\n\n\n  \n x\t\ty", "12345678901234567890", "=" * 333 + "!?" * 77,
        "é" * 70 + "́" * 5, "\r\n" * 20, "abcabcabcabc", "  \x85\xa0", "\x1c\x1d\x1e\x1f",
    ]


def test_ids_and_round_trip(library, encoder):
    texts = list(odd_texts())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for text, ids, got in zip(texts, want, encoder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids, repr(text)
        assert bpe.decode(got, encoder.merges) == library.decode(ids, skip_special_tokens=False) == text
    assert encoder.encode(texts)[5] == np.array(want[5], "<u4").tobytes()  # from the cache


def test_broken_bytes_decode_as_the_library_does(library, encoder):
    rng = random.Random(2)
    for _ in range(50):
        ids = [rng.randrange(50_257) for _ in range(20)]
        got = bpe.decode(np.array(ids, "<u4").tobytes(), encoder.merges)
        assert got == library.decode(ids, skip_special_tokens=False)


def test_a_small_cache_changes_nothing(library):
    vocabulary = Vocabulary.load(VOCABULARY)
    small = bpe.Encoder(vocabulary, bpe.Merges.load(vocabulary), most=5)
    for text in list(odd_texts())[:40]:
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    known = token_counts.Lengths(b"", np.zeros(0, np.uint8), vocabulary, 3)
    split = vocabulary.splitter()
    for text in list(odd_texts())[:40]:
        assert sum(map(known.__getitem__, split(text))) == len(library.encode(text, add_special_tokens=False).ids)
        assert len(known) <= 3 + 1 + 1


def test_queries(spark, small_dir, rows, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in zip(rows.doc_id, rows.text)}
    text = dict(zip(rows.doc_id, rows.text.fillna("")))
    for r in QUERIES["op8_bpe"](spark, small_dir).collect():
        mine = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(mine), sha(np.array(mine, "<u4").tobytes()))
        assert r["decoded_sha256"] == sha(text[r["doc_id"]].encode())
    got = QUERIES["op9_token_counts"](spark, small_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {
        i: (len(text[i].encode()), len(ids[i]), len(ids[i]) > 512) for i in ids
    }


def test_long_pieces(library, encoder):
    rng = random.Random(3)
    texts = ["".join(rng.choices(letters, k=n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ACGT", "東京都é", "ab") for n in (1100, 20_000)]
    texts += ["a" * 5001, "ab" * 3000 + "a", "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))]
    start = time.perf_counter()
    found = encoder.encode(texts)
    assert time.perf_counter() - start < 30  # by rounds over all symbols this takes an hour
    for text, got in zip(texts, found):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_both_ways_of_merging_agree(encoder):
    rng = random.Random(4)
    pieces = ["".join(rng.choices("abcde", k=rng.randrange(0, 60))).encode() for _ in range(200)]
    for piece, ids in zip(pieces, bpe.merge_rounds(pieces, encoder.merges)):
        assert bpe.merge_long(piece, encoder.merges).tolist() == ids.tolist()


def test_edges(edge_docs, no_docs, library):
    want = sorted((r["doc_id"] or 0, len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in edge_docs.collect())
    encoded = bpe.encode_documents(edge_docs, VOCABULARY)
    assert sorted((r["id"] or 0, len(r["ids"]) // 4) for r in encoded.collect()) == want
    back = sorted((r["id"] or 0, r["text"]) for r in bpe.decode_documents(encoded, VOCABULARY).collect())
    assert back == sorted((r["doc_id"] or 0, r["text"] or "") for r in edge_docs.collect())
    for sample_rows in (2, 10_000):
        counted = token_counts.token_counts(edge_docs, VOCABULARY, frequent=5, sample_rows=sample_rows).collect()
        assert sorted((r["id"] or 0, r["n_tokens"]) for r in counted) == want
    for empty in (
        bpe.round_trip_digests(no_docs, VOCABULARY), bpe.encode_documents(no_docs, VOCABULARY),
        token_counts.token_counts(no_docs, VOCABULARY),
    ):
        assert empty.count() == 0


def test_pieces_of_more_than_255_tokens(spark, library):
    texts = ["丐" * 120, "\U0001fae8" * 120, "ꙮ" * 140, "a plain text", "丐" * 120]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert max(want) > 255
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = token_counts.token_counts(docs, VOCABULARY).collect()
    assert {r["id"]: r["n_tokens"] for r in got} == dict(enumerate(want))

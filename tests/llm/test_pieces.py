"""Merge-type pieces against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from velograde.llm import pieces
from velograde.llm.textbytes import chunks

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = " ▁  ab\n\té\U0001f600" + "0123theingofan<>s/日本\x00　\xa0"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts() -> list[str]:
    rng = random.Random(11)
    odd = ["", " ", "  ", "▁", "x▁y", "x ▁ y", "a" * 5000, " " * 999, "▁" * 77, "</s><unk><0x41>", "\r\n", "�", "the the the", "the the the"]
    return odd + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(80))) for _ in range(800)]


def test_agenda_and_rounds_give_the_librarys_ids(library):
    found = [ids.tolist() for chunk in chunks(pa.array(texts()), 4000) for ids, _ in pieces.PieceEncoder(MODEL).encode(chunk)]
    assert found == library.encode(texts(), add_bos=True, add_eos=True)


def test_heap_and_rounds_agree():
    model = pieces.MergeModel(MODEL)
    some = [t.replace(" ", "▁") for t in texts() if t]
    counts, ids = model.rounds(some)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [model.ids(t) for t in some]


def test_a_full_cache_and_texts_with_equal_polynomials(library):
    # The Thue-Morse word and its complement.
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    pair = [word, word.translate(str.maketrans("ab", "ba"))] + [f"w{i} x{i}" for i in range(300)]
    found = [ids.tolist() for chunk in chunks(pa.array(pair), 3000) for ids, _ in pieces.PieceEncoder(MODEL, limit=2000).encode(chunk)]
    assert found == library.encode(pair, add_bos=True, add_eos=True)


def test_query_rows_and_odd_cases(spark, library):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (None, "", None), (3, "b  b ", "x"), (3, "b  b ", "x"), (4, " ".join(str(i) for i in range(30_000)), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, pieces.digests(docs, MODEL).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    whole = {r.doc_id: r for r in pieces.encode(docs, MODEL).collect()}
    assert whole[1].ids == library.encode("Hello world", add_bos=True, add_eos=True) and whole[3].decoded == "b  b " and whole[2].decoded == ""
    assert pieces.digests(docs.limit(0), MODEL).collect() == []


def test_a_wrong_agenda_is_noticed():
    encoder = pieces.PieceEncoder(MODEL)
    encoder.model.order = encoder.model.order[::-1].copy()
    with pytest.raises(ValueError, match="differ"):
        list(encoder.encode(next(chunks(pa.array(["wherever something else"])))))

"""Token files and WARC archives: exact round trips and damaged files."""

from __future__ import annotations

import gzip
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from velograde.llm import token_files, warc
from velograde.llm.textbytes import chunks
from velograde.llm.workdir import new_path

DOCS = "text string, start long, doc_id long"
ODD = [
    "", "one", "a  b\n\n c  d e　 f", "it's 'll  x\t y z\r\n", " lead", "trail ", "\n", "é è\nç", "x y z", "a\x1c b c", "don't stop", "a\nb", "\n\na b", "1 2  3", "日本 語", "🙂 🙂", " ", "a \n b",
]


@pytest.fixture(scope="module")
def path():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_segments_encode_like_whole_texts(path):
    encoder = token_files.SegmentEncoder(path, limit=400)  # a small cache that starts anew several times
    for texts in (ODD, ODD[::-1], ["".join(ODD) * 20]):
        got = [ids.tolist() for c in chunks(pa.array(texts)) for ids in encoder.encode(c, 2)]
        assert got == [x.ids + [2] for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, path):
    from tokenizers import Tokenizer

    rows = [(t, 9, k) for k, t in enumerate(ODD)] + [(None, 9, 50), ("null id", 9, None), ("again", 9, 51), ("again", 9, 51), ("long word " * 20_000, 9, -3)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(token_files.write_and_read(docs, path).collect(), key=lambda r: r["start"])
    tokenizer = Tokenizer.from_file(path)
    at = 0
    want = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0))
    assert [r["doc_id"] for r in got] == [r[2] for r in want]
    for r, (text, _, _) in zip(got, want, strict=True):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.write_and_read(spark.createDataFrame([], DOCS), path).count() == 0


def test_damaged_records_are_refused():
    data = token_files.record(7, np.array([1, 2, 70_000], np.uint32), 4)
    doc_id, ids, end = token_files.parse(data, 0)
    assert (doc_id, ids.tolist(), end) == (7, [1, 2, 70_000], len(data))
    assert token_files.parse(token_files.record(None, np.array([], np.uint32), 2), 0)[0] is None
    for k in (0, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            token_files.parse(bytes(bad), 0)


PAGES = "refers_to int, page_id long, url string, html string"


def test_warc_round_trip(spark):
    big = "é" * 60
    rows = [
        (1, 5, "http://a/\r\nb", big), (1, 3, "http://a", big), (1, 9, None, big), (1, None, "u", big), (1, 4, "u", "short"), (1, 6, "u", "short"), (1, 7, "u", None), (1, 8, "u", ""),
        (1, 10, "u", "x" * 200_000 + "\r\n\r\nWARC/1.1\r\n"), (1, None, "u", "y" * 100), (1, 11, "u", "z" * 99), (1, 12, "u", "z" * 99), (1, 3, "http://a", big),
    ]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(2)).collect()
    assert len(got) == len(rows)
    seen = sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got)
    want = []
    for _, page, _, html in rows:
        n = len((html or "").encode())
        revisit = html == big and page != 3
        want.append((page is None, page or 0, n, "revisit" if revisit else "response", 3 if revisit else None))
    assert seen == sorted(want, key=lambda r: r[:4]) or sorted(map(str, seen)) == sorted(map(str, want))
    digest = {hashlib.sha256((h or "").encode()).hexdigest() for *_, h in rows}
    assert {r["payload_digest"] for r in got} == digest
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_normaliser_reads_foreign_streams(tmp_path, spark):
    made = [warc.record(k, f"http://h/{k}", bytes([65 + k % 26]) * (k * 997), None) for k in range(40)]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    # One stream; and several members whose ends do not fall on records.
    (tmp_path / "in" / "one.warc.gz").write_bytes(gzip.compress(b"".join(made)))
    whole = b"".join(made)
    (tmp_path / "in" / "many.warc.gz").write_bytes(b"".join(gzip.compress(whole[k : k + 5000]) for k in range(0, len(whole), 5000)))
    manifest = spark.createDataFrame([("one", 40), ("many", 40)], "file string, records long")
    clean = warc.normalise(manifest, source, target)
    assert sorted(map(tuple, clean.collect())) == [("many", 40), ("one", 40)]
    for name in ("one", "many"):
        data = (tmp_path / "out" / f"{name}.warc.gz").read_bytes()
        for line, record in zip((tmp_path / "out" / f"{name}.idx").read_text().splitlines(), made, strict=True):
            _, at, n, *_ = line.split(" ")
            assert zlib.decompress(data[int(at) : int(at) + int(n)], 31) == record
    assert warc.read(clean, target).count() == 80


def test_cut_streams_are_errors():
    made = warc.record(1, None, b"x" * 5000, None)
    zipped = gzip.compress(made)

    def reader(data):
        parts = [data[k : k + 100] for k in range(0, len(data), 100)]
        return lambda n: parts.pop(0) if parts else b""

    assert len(list(warc.records(warc.inflate(reader(zipped))))) == 1
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(reader(zipped[:-20]))))
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(reader(gzip.compress(made[:-500])))))
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(made.replace(b"xx", b"xy", 1)))


def test_work_folder_is_the_sessions(spark):
    assert "velograde" in new_path(spark, "x")


@pytest.mark.parametrize("doublings", [10, 12])
def test_segments_with_equal_polynomials_get_their_own_ids(doublings):
    from tokenizers import Tokenizer

    a = "a"
    for _ in range(doublings):
        a += a.translate(str.maketrans("ab", "ba"))
    texts = [f"x {a} y", f"x {a.translate(str.maketrans('ab', 'ba'))} y"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_files.SegmentEncoder(path)
    # In one chunk, and in two through the cache.
    for limit in (1 << 20, 10):
        found = [ids.tolist() for chunk in chunks(pa.array(texts), limit) for ids in encoder.encode(chunk, 2)]
        assert found == [[*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for t in texts]

"""Exact, near and passage deduplication against brute force."""

from __future__ import annotations

import hashlib
import pathlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from velograde.llm import components, exact_dedup, near_dedup, passages

DOCS = "digest string, doc_id long, rep long, text string"
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def docs_of(spark, rows):
    return spark.createDataFrame([("x", i, 1, t) for i, t in rows], DOCS)


def words(text, lower=True):
    t = text or ""
    return [w for w in re.split("[ \t-\r]+", t.translate(LOWER) if lower else t) if w]


def vocabulary(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n)]


# --- components ---


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 240)] + [(5, 5)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert found == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- exact ---


def test_exact(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a\tb  "), (4, "A b"), (5, None), (6, ""), (7, " \n"), (None, "ab"), (8, "z"), (8, "z"), (None, "q"), (9, "a b"), (10, "é" * 50_000), (11, "é" * 50_000 + " ")]
    index = exact_dedup.DigestIndex(spark, buckets=3)
    got = exact_dedup.deduplicate(docs_of(spark, rows), index).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(words(t, lower=False)), []).append((i, t or ""))
    want = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        want += [(i, keep, len(members), i == keep, hashlib.sha256(key.encode()).hexdigest()) for i, _ in members]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    # A later batch: texts that the index holds are not appended again.
    assert index.read().count() == len(groups)
    index.append(exact_dedup.groups(exact_dedup.digests(docs_of(spark, [(50, "a  b"), (51, "new"), (52, "n e w")]))))
    assert index.read().count() == len(groups) + 1
    # The rows of all batches count, and the text that came first stays.
    by = {r["text_sha256"]: r for r in exact_dedup.resolve(exact_dedup.digests(docs_of(spark, [(60, "a b"), (61, "new")])), index).collect()}
    of = lambda text: by[hashlib.sha256(text.encode()).hexdigest()]
    assert (of("ab")["keep_id"], of("ab")["group_size"], of("ab")["kept"]) == (next(keep for i, keep, *_ in want if i == 1), len(groups["ab"]) + 1, False)
    assert (of("new")["keep_id"], of("new")["group_size"]) == (52, 2)
    tables = {t.name for t in spark.catalog.listTables()}
    exact_dedup.deduplicate(docs_of(spark, rows))
    assert {t.name for t in spark.catalog.listTables()} == tables
    index.drop()
    assert exact_dedup.deduplicate(docs_of(spark, [])).count() == 0


# --- near ---


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_corpus(seed):
    """Groups around templates with edits of any share, so that similarities lie on both sides of the threshold; a shared passage; short texts."""
    rng, vocab = random.Random(seed), vocabulary(300, seed)
    rows = []
    passage = [rng.choice(vocab) for _ in range(30)]
    for size in (60, 12, 3, 2, 1):
        for members in (14, 3, 2):
            template = [rng.choice(vocab) for _ in range(size)]
            for _ in range(members):
                w = [rng.choice(vocab) if rng.random() < rng.choice((0, 0.02, 0.05, 0.1)) else x for x in template]
                rows.append((len(rows), " ".join(w).title() if rng.random() < 0.3 else "\n".join(w)))
    for _ in range(15):
        rows.append((len(rows), " ".join(passage + [rng.choice(vocab) for _ in range(rng.randint(3, 20))])))
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 2), (2, 5)])
def test_near_duplicates_equal_brute_force(spark, seed, size):
    rows = [*near_corpus(seed), (900, None), (901, ""), (902, " \t"), (903, "É é"), (904, "é é")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(spark, rows), size=size).collect()}
    assert got == brute(rows, size, 80)


def test_a_large_group_of_mutually_unlike_copies(spark):
    rng, vocab = random.Random(9), vocabulary(500, 9)
    template = [rng.choice(vocab) for _ in range(80)]
    rows = []
    for k in range(120):
        w = list(template)
        for _ in range(rng.choice((0, 2, 6, 9))):
            w[rng.randrange(80)] = f"own{rng.randrange(200)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute(rows, 2, 80)


def test_few_unlike_copies_post_no_shingles_and_signatures_go(spark, monkeypatch):
    rng, vocab = random.Random(11), vocabulary(500, 11)
    template = [rng.choice(vocab) for _ in range(80)]
    rows = []
    for k in range(40):
        w = list(template)
        for _ in range(rng.choice((0, 1, 2)) if k < 30 else 10):
            w[rng.randrange(80)] = f"own{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    made, plain = {}, near_dedup.table

    def spy(df, name, codec=None):
        made.setdefault(name, []).append(plain(df, name, codec))
        return made[name][-1]

    monkeypatch.setattr(near_dedup, "table", spy)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute(rows, 2, 80)
    assert made["near-residue"][0].where("component <> top").count() > 0
    assert made["near-own"][0].count() == 0
    (signed,) = made["near-signatures"]
    assert dict(signed.dtypes)["sig"] == "array<int>"
    assert not pathlib.Path(signed._velograde_path.removeprefix("file://")).exists()


def test_tables_of_finished_steps_go(spark, monkeypatch):
    made, plain = {}, near_dedup.table

    def spy(df, name, codec=None):
        made.setdefault(name, []).append(plain(df, name, codec))
        return made[name][-1]

    monkeypatch.setattr(near_dedup, "table", spy)
    rows = near_corpus(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute(rows, 2, 80)
    # The values of all coordinates are never shuffled at once.
    assert len(made["near-shared"]) == near_dedup.COORDINATES // near_dedup.SLICE > 1
    for name in ("near-shared", "near-representatives", "near-postings", "near-pairs", "near-best", "near-best-ids", "near-best-texts", "near-rest-texts", "near-members", "near-members-texts", "near-open"):
        for df in made[name]:
            assert not pathlib.Path(df._velograde_path.removeprefix("file://")).exists(), name


def test_near_duplicates_of_odd_rows(spark):
    rows = [(3, "one two three"), (3, "one two three"), (None, "one two three"), (None, None), (2, "One TWO three"), (7, "word " * 40_000)]
    got = sorted(map(tuple, near_dedup.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 2, 2, False), (3, 2, 2, False), (None, 2, None, True), (None, 0, None, True), (2, 2, 2, True), (7, 1, 7, True)], key=str)
    kept = near_dedup.distinct_documents(docs_of(spark, rows))
    assert kept.columns == ["digest", "doc_id", "rep", "text"] and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "7", "None", "None"]
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0


# --- passages ---


def test_every_repeated_passage_is_found(spark):
    rng, vocab = random.Random(4), vocabulary(2000, 4)
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, hit = [], set()
    for n in (51, 52, 55, 60, 80, 150, 400):
        for _ in range(3):
            p = fresh(n)
            for _ in range(rng.randint(2, 4)):
                hit.add(len(rows))
                rows.append((len(rows), " ".join([*fresh(rng.randint(0, 60)), *p, *fresh(rng.randint(0, 60))])))
    edited = fresh(200)
    for k in range(2):
        hit.add(len(rows))
        w = list(edited)
        w[50 + 100 * k] = "edit"
        rows.append((len(rows), " ".join([*fresh(20), *w])))
    short = fresh(40)
    clean = range(len(rows), len(rows) + 30)
    rows += [(k, " ".join([*fresh(60), *(short if k % 2 else fresh(5)), *fresh(60)])) for k in clean]
    rows += [(800, None), (801, ""), (802, "a b c"), (803, "la " * 5000), (None, " ".join(edited))]
    found = passages.repeated(docs_of(spark, rows)).collect()
    assert {r["doc_id"] for r in found} == hit
    text = dict(rows)
    for r in found:
        assert r["words"] >= 50 and len(words(text[r["doc_id"]][r["start"] : r["end"]])) >= 50
    clusters = {}
    for r in found:
        clusters.setdefault((r["kept_doc_id"], r["kept_start"]), []).append(r)
    for members in clusters.values():
        stays = [r["doc_id"] for r in members if not r["removed"]]
        assert stays == [min(r["doc_id"] for r in members)] and len(members) > 1
    cut = {r["doc_id"]: r["text"] for r in passages.without(docs_of(spark, rows), passages.repeated(docs_of(spark, rows))).collect() if r["doc_id"] is not None}
    assert all(cut[k] == text[k] for k in clean) and cut[800] is None
    assert all(len(cut[r["doc_id"]]) <= len(text[r["doc_id"]]) - (r["end"] - r["start"]) for r in found if r["removed"])


def test_edited_passages_are_found_at_ids_of_any_size(spark):
    rng, vocab = random.Random(21), vocabulary(2000, 21)
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, want, top = [], set(), 2**62
    for n, edits in ((60, 1), (100, 2), (200, 4)):
        for _ in range(50):
            p = fresh(n)
            q = list(p)
            for at in rng.sample(range(n), edits):
                q[at] = rng.choice(vocab)
            if jaccard(grams(p), grams(q)) >= 0.8:
                want |= {top + len(rows), top + len(rows) + 1}
            rows += [(top + len(rows) + k, " ".join([*fresh(30), *x, *fresh(30)])) for k, x in enumerate((p, q))]
    found = {r["doc_id"] for r in passages.repeated(docs_of(spark, rows)).collect()}
    # An edit at either end leaves a shorter passage that may hold without it.
    assert len(want) > 200 and want <= found


def test_passages_equal_all_pairs(spark):
    """Against every pair of documents: those with a common run of 50 words, wherever it stands."""
    rng, vocab = random.Random(22), vocabulary(60, 22)
    pool = [[rng.choice(vocab) for _ in range(rng.randint(30, 70))] for _ in range(12)]
    rows = [(k, " ".join(w for _ in range(rng.randint(1, 5)) for w in (rng.choice(pool) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 40))]))) for k in range(120)]
    held = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            held.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = {i for ids in held.values() if len(ids) > 1 for i in ids}
    found = passages.repeated(docs_of(spark, rows)).collect()
    assert want <= {r["doc_id"] for r in found}
    # Whatever is found beyond is an edited passage: its cluster has another document, and most of its windows of 5 words are there.
    text = dict(rows)
    inside = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 4):
            inside.setdefault(tuple(w[k : k + 5]), set()).add(i)
    for r in found:
        w = text[r["doc_id"]][r["start"] : r["end"]].split()
        shared = sum(len(inside[tuple(w[k : k + 5])]) > 1 for k in range(len(w) - 4))
        assert len(w) >= 50 and shared >= 0.8 * (len(w) - 4)


def test_removal_carries_columns_of_any_name(spark):
    p = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"a {p} b", "x", "y"), (2, f"c {p} d", "x", "y"), (None, p, "x", "y"), (3, None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cut string, cut_of string")
    found = passages.repeated(docs)
    assert [(r["doc_id"], r["kept_doc_id"], r["removed"]) for r in found.orderBy("doc_id").collect()] == [(1, 1, False), (2, 1, True)]
    got = passages.without(docs, found)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, f"a {p} b", "x", "y"), (2, "c  d", "x", "y"), (None, p, "x", "y"), (3, None, "x", "y")], key=str)


def test_passages_are_aligned_by_the_shingle_that_is_shared(spark):
    rng, vocab = random.Random(11), vocabulary(2000, 11)
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for _ in range(250):
        p = fresh(51)
        # In the second document an earlier part of the passage stands before it, too.
        rows += [(len(rows), " ".join([*fresh(20), *p, *fresh(20)])), (len(rows) + 1, " ".join([*fresh(20), *p[:30], *fresh(3), *p, *fresh(20)]))]
    assert {r["doc_id"] for r in passages.repeated(docs_of(spark, rows)).collect()} == {i for i, _ in rows}


def test_all_stretches_of_a_run_and_across_inserted_words_are_found(spark):
    rng, vocab = random.Random(12), vocabulary(2000, 12)
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, want = [], []
    for _ in range(20):
        p, q, r, t = fresh(60), fresh(90), fresh(80), fresh(90)
        for one, other, lengths in (
            ([*p, *fresh(25), *q], [*p, *fresh(25), *q], [60, 90]),
            (r, [*r[:40], "more", *r[40:]], [80]),
            (t, [*t[:45], *t[46:]], [89]),
        ):
            for x in (one, other):
                want.append((len(rows), lengths))
                rows.append((len(rows), " ".join([*fresh(20), *x, *fresh(20)])))
    found = {}
    for r in passages.repeated(docs_of(spark, rows)).collect():
        found.setdefault(r["doc_id"], []).append(r["words"])
    assert {k: sorted(v) for k, v in found.items()} == dict(want)


def test_passages_are_found_whatever_fragments_hold_their_values(spark):
    rng, vocab = random.Random(13), vocabulary(2000, 13)
    fresh = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, want = [], set()
    for _ in range(30):
        p = fresh(70)
        for k in range(22):
            at = rng.randint(0, 25)
            if k in (10, 11):
                want.add(len(rows))
            rows.append((len(rows), " ".join([*fresh(20), *(p if k in (10, 11) else p[at : at + 45]), *fresh(20)])))
    assert {r["doc_id"] for r in passages.repeated(docs_of(spark, rows)).collect()} == want


def test_no_passages_in_nothing(spark):
    assert passages.repeated(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("doublings", [10, 12])
def test_words_with_equal_polynomials_modulo_a_power_of_two(spark, doublings):
    """The Thue-Morse word and its complement are different words."""
    a = "a"
    for _ in range(doublings):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"pre {a} post"), (4, f"pre {b} post"), (5, f"pre {b} post")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def test_slices_with_one_hash_are_told_apart_by_their_bytes():
    from velograde.llm.textbytes import classes

    data = np.frombuffer(b"abcabdabcabdxab", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 13]), np.array([3, 6, 9, 12, 15])
    which, first = classes(data, starts, ends, np.zeros(5, np.uint64))
    assert [data[starts[first[w]] : ends[first[w]]].tobytes() for w in which] == [b"abc", b"abd", b"abc", b"abd", b"ab"]
    assert len(set(which.tolist())) == 3


def test_postings_of_large_batches_take_little_memory():
    """Texts are hashed in small chunks: the arrays over one are a few MB, whatever the batch holds."""
    words = random.Random(4)
    texts = [" ".join(str(words.randrange(10**6)) for _ in range(300)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in passages.post(1, iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 20_000 and peak < 40e6

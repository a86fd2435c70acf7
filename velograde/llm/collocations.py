"""Phrases whose words come together more often than their parts do alone, per language.

1. A scan cuts texts into pieces and words. A block (about ``BLOCK_BYTES`` of texts) numbers its own words
   and becomes one row of numbers, zero between pieces, and one row per distinct word with its count.
2. Words that occur ``least`` times in their language form the dictionary; its ids are dense and stand for (language, word). A phrase
   with ``least`` occurrences has only such words, so pieces break at all others.
3. Each block meets its own words' ids (a join on words, which a block holds once each, then one on the block) and is kept as ids.
   It counts its pairs by runs of sorted numbers. The pairs' fixed-width keys go through a range partition and a sort; equal keys then stand in a run, and
   runs are summed up as they pass by. Two ids of four bytes are one whole number, which Spark sorts by radix; binary keys, for more words, it compares.
4. Triples are keyed the same way, from places where both pairs are frequent. Up to ``BROADCAST_PAIRS`` frequent pairs (8 bytes each) are
   sent to the tasks, so that a pair's place among them and a word are one whole number; more of them are joined to the blocks that hold them.
5. A phrase's cuts look their parts up by key. Products are decimals of 38 digits: exact for counts below 10**15.

No step holds more than a block, and no word or phrase is more than one row of a block: a hot word or
phrase has as many rows as there are blocks. Lookups salt the at most 200 words and pairs that make up a hundredth of all words.

Defined cases: null texts are empty; a null language is ``und``; repeated rows count each time; of equal scores and counts the
phrase in byte order decides; languages without candidates and empty tables have no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from velograde.llm.textbytes import LOWER, Chunk, chunks, classes
from velograde.llm.workdir import drop, release, rows_below, table
from velograde.shipping import ship

LEAST, COVERED_PERCENT, TOP = 10, 50, 2000
BLOCK_BYTES = 4_000_000
SALTS = 32
BROADCAST_PAIRS = 2_000_000

#: Bytes between pieces, and between words.
CUT = np.zeros(256, bool)
CUT[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = True
GAP = CUT.copy()
GAP[[0x20, 0x09]] = True

SCANNED = "block long, numbers binary, number int, lang string, word string, n long"


def scan(block_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, text): a row with the numbers of each block, and a row for each of its words."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs = batch.column(0).fill_null("und").dictionary_encode()
        names, of_doc = langs.dictionary, langs.indices.to_numpy()
        for raw in chunks(batch.column(1), block_bytes):
            chunk = Chunk(LOWER[raw.data], raw.bounds, raw.first)
            starts, ends = chunk.runs(~GAP[chunk.data])
            if not len(starts):
                continue
            doc = np.repeat(np.arange(chunk.docs), np.diff(chunk.owner_bounds(starts)))
            which, _ = classes(chunk.data, starts, ends, chunk.hasher()(starts, ends))
            number, distinct = pd.factorize(which.astype(np.int64) * len(names) + of_doc[chunk.first + doc])
            first = np.zeros(len(distinct), np.int64)
            first[number[::-1]] = np.arange(len(number))[::-1]
            cuts = np.cumsum(CUT[chunk.data])[starts]
            apart = np.flatnonzero((cuts[1:] != cuts[:-1]) | (doc[1:] != doc[:-1])) + 1
            numbers = np.insert(number.astype(np.int32) + 1, apart, 0)
            data = chunk.data.tobytes()
            words = [data[x:y] for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            n = len(distinct) + 1
            none = lambda t: pa.nulls(1, t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, block)),
                    pa.concat_arrays([pa.array([numbers.tobytes()], pa.binary()), pa.nulls(n - 1, pa.binary())]),
                    pa.concat_arrays([none(pa.int32()), pa.array(np.arange(1, n, dtype=np.int32))]),
                    pa.concat_arrays([none(pa.string()), names.take(pa.array(of_doc[chunk.first + doc[first]])).cast(pa.string())]),
                    pa.concat_arrays([none(pa.string()), pa.array(words, pa.binary()).cast(pa.string())]),
                    pa.concat_arrays([none(pa.int64()), pa.array(np.bincount(number, minlength=n - 1))]),
                ],
                names=["block", "numbers", "number", "lang", "word", "n"],
            )
            block += 1


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    begins = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return begins, np.diff(np.append(begins, len(sorted_values)))


def keys(ids: list[np.ndarray], width: int) -> pa.Array:
    """Ids as big-endian binary keys of ``width`` bytes each, one after the other."""
    n = len(ids[0])
    data = np.stack([i.astype(f">u{width}").view(np.uint8).reshape(n, width) for i in ids], axis=1)
    size = width * len(ids)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


ENCODED = "block long, ids binary"


def encoded(width: int, numbers: pa.Table, words: pa.Table) -> pa.Table:
    """A block as ids: zero stands for words without one and between pieces."""
    out = []
    for data in numbers["numbers"].to_pylist():
        at = np.frombuffer(data, np.int32)
        ids = np.zeros(int(at.max(initial=0)) + 1, f"u{width}")
        ids[words["number"].to_numpy()] = words["id"].to_numpy()
        out.append(ids[at].tobytes())
    return pa.table({"block": numbers["block"], "ids": pa.array(out, pa.binary())})


def local(width: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's ids: the distinct ones in order, the pairs (two places in them) of all neighbours, and which of these are of two words."""
    ids, at = np.unique(np.frombuffer(data, f"u{width}"), return_inverse=True)
    some = ids[at] > 0
    at = at.astype(np.int64)
    return ids.astype(np.int64), (at[:-1] << 32) | at[1:], some[:-1] & some[1:]


def _ends(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pair >> 32, pair & 0xFFFFFFFF


COUNTED = "key binary, n long"


def pairs_of(width: int, with_block: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each block by the key of their ids, and how often they stand there; with the block if asked for."""
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, pair, good = local(width, data)
            pair = np.sort(pair[good])
            begin, n = runs(pair)
            x, y = _ends(pair[begin])
            own = {"block": pa.array(np.full(len(n), block))} if with_block else {}
            yield pa.RecordBatch.from_pydict({**own, "key": keys([ids[x], ids[y]], width), "n": pa.array(n)})


def _triples(width: int, ids: np.ndarray, pair: np.ndarray, good: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Keys and numbers of the triples where two ``good`` pairs meet."""
    here = np.flatnonzero(good[:-1] & good[1:])
    distinct, place = np.unique(pair[good], return_inverse=True)
    at = np.zeros(len(pair), np.int64)
    at[good] = place
    triple = np.sort((at[here] << 32) | at[here + 1])
    begin, n = runs(triple)
    one, two = _ends(triple[begin])
    (x, y), (_, z) = _ends(distinct[one]), _ends(distinct[two])
    return keys([ids[x], ids[y], ids[z]], width), pa.array(n, pa.int64())


NUMBERED = "key long, n long"


def packed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two numbers of four bytes as one."""
    return (x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64)


def unpacked(key: np.ndarray) -> list[np.ndarray]:
    return [key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)]


def packed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each block, ids of four bytes packed into one number, and how often they stand there."""
    for batch in batches:
        for data in batch.column(1).to_pylist():
            ids, pair, good = local(4, data)
            pair = np.sort(pair[good])
            begin, n = runs(pair)
            x, y = _ends(pair[begin])
            yield pa.RecordBatch.from_arrays([pa.array(packed(ids[x], ids[y]).view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])


def triples_of(frequent: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triples of each block whose two pairs are among ``frequent`` (sorted, packed): the first pair's place in it and the last id, packed."""
    for batch in batches:
        for data in batch.column(1).to_pylist():
            ids, pair, good = local(4, data)
            distinct, place = np.unique(pair, return_inverse=True)
            x, y = _ends(distinct)
            wanted = packed(ids[x], ids[y])
            at = np.minimum(np.searchsorted(frequent, wanted), max(0, len(frequent) - 1))
            known = frequent[at] == wanted if len(frequent) else np.zeros(len(wanted), bool)
            good &= known[place]
            here = np.flatnonzero(good[:-1] & good[1:])
            triple = np.sort((at[place[here]] << 32) | ids[pair[here + 1] & 0xFFFFFFFF])
            begin, n = runs(triple)
            yield pa.RecordBatch.from_arrays([pa.array(triple[begin], pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])


def joined_triples(width: int, blocks: pa.Table, frequent: pa.Table) -> pa.Table:
    """The same for a block with the keys of its own frequent pairs."""
    out = []
    for data in blocks["ids"].to_pylist():
        ids, pair, good = local(width, data)
        of = np.frombuffer(b"".join(frequent["key"].to_pylist()), f">u{width}").astype(np.int64).reshape(-1, 2)
        at = np.searchsorted(ids, of)
        out.append(pa.table(dict(zip(("key", "n"), _triples(width, ids, pair, good & np.isin(pair, (at[:, 0] << 32) | at[:, 1])), strict=True))))
    return pa.concat_tables(out) if out else pa.table({"key": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})


def summed(width: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, n) in the order of keys, the sum of each run of equal keys, where it reaches ``least``."""
    held: tuple[bytes, int] | None = None

    def rows(keys_: list[bytes], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys_, pa.binary()), pa.array(n, pa.int64())], names=["key", "f"])

    for batch in batches:
        if not batch.num_rows:
            continue
        column, n = batch.column(0), batch.column(1).to_numpy()
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)
        begin = np.flatnonzero(np.concatenate([[True], (data[1:] != data[:-1]).any(axis=1)]))
        total = np.add.reduceat(n, begin)
        if held is not None:
            if data[0].tobytes() == held[0]:
                total[0] += held[1]
            elif held[1] >= least:
                yield rows([held[0]], [held[1]])
        held = data[begin[-1]].tobytes(), int(total[-1])
        kept = np.flatnonzero(total[:-1] >= least)
        yield pa.RecordBatch.from_arrays([column.take(pa.array(begin[kept])), pa.array(total[kept])], names=["key", "f"])
    if held is not None and held[1] >= least:
        yield rows([held[0]], [held[1]])


def summed_numbers(least: int, spelled: Callable[[np.ndarray], pa.Array], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same of keys that are numbers, given out as ``spelled`` writes them."""
    held: tuple[np.ndarray, np.ndarray] | None = None

    def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        often = n >= least
        return pa.RecordBatch.from_arrays([spelled(key[often].view(np.uint64)), pa.array(n[often], pa.int64())], names=["key", "f"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held is not None:
            key, n = np.concatenate([held[0], key]), np.concatenate([held[1], n])
        begin, _ = runs(key)
        total = np.add.reduceat(n, begin)
        held = key[begin[-1:]], total[-1:]
        yield rows(key[begin[:-1]], total[:-1])
    if held is not None:
        yield rows(*held)


def counted_numbers(rows: DataFrame, least: int, spelled: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """:func:`counted` of keys that are numbers."""
    ordered = rows.select("key", "n").repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(lambda batches: summed_numbers(least, spelled, batches), "key binary, f long")


def counted(rows: DataFrame, size: int, least: int) -> DataFrame:
    """(key, f) of rows (key, n) with keys of ``size`` bytes: range partition, sort, sums of runs."""
    ordered = rows.select("key", "n").repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(lambda batches: summed(size, least, batches), "key binary, f long")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact."""
    wide = lambda c: c.cast("decimal(38,0)")
    above = wide(wide(a.cast("decimal(15,0)") * a.cast("decimal(15,0)")) * F.lit(1_000_000).cast("decimal(7,0)"))
    below = wide(left.cast("decimal(15,0)") * right.cast("decimal(15,0)"))
    return F.call_function("div", above, below)


def _identified(words: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(lang, word, f, id) of the frequent words with dense ids from 1, and the bytes that an id needs."""
    found = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    row = F.monotonically_increasing_id()
    found = table(found.select("lang", "word", "f", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "collocation-words")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition.
    offsets = found.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    most = offsets.agg(F.max(F.col("offset") + F.col("rows"))).head()[0] or 0
    named = found.join(offsets, "part").select("lang", "word", "f", (F.col("offset") + F.col("nth") + 1).alias("id"))
    out = table(named, "collocation-dictionary")
    drop(found)
    return out, 4 if most < 2**32 else 8


def phrases(docs: DataFrame, least: int = LEAST, covered_percent: int = COVERED_PERCENT, top: int = TOP, block_bytes: int = BLOCK_BYTES, broadcast_pairs: int = BROADCAST_PAIRS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each language.

    Phrases inside a longer one that has ``covered_percent`` of their occurrences are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    scanned = table(docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(lambda batches: scan(block_bytes, batches), SCANNED), "collocation-blocks", "zstd")
    words = scanned.where("number is not null").select("block", "number", "lang", "word", "n")
    blocks = scanned.where("numbers is not null").select("block", "numbers")
    dictionary, width = _identified(words, least)
    sums = table(words.groupBy("lang").agg(F.sum("n").alias("n")), "collocation-languages")
    release(spark)
    own = table(words.join(dictionary, ["lang", "word"]).select("block", F.col("number").cast("long").alias("number"), "id"), "collocation-own", "zstd")
    release(spark)
    texts = blocks.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lambda numbers, rows: encoded(width, numbers, rows), ENCODED)
    texts = table(texts, "collocation-texts", "zstd")
    drop(own)
    drop(scanned)
    release(spark)
    if width == 4:
        twos = counted_numbers(texts.mapInArrow(packed_pairs, NUMBERED), least, lambda key: keys(unpacked(key), 4))
    else:
        twos = counted(texts.mapInArrow(lambda batches: pairs_of(width, False, batches), COUNTED), 2 * width, least)
    twos = table(twos, "collocation-twos")
    release(spark)
    if width == 4 and rows_below(twos, broadcast_pairs):
        frequent = twos.select(F.conv(F.hex("key"), 16, -10).cast("long").alias("pair")).toArrow()["pair"].to_numpy()
        sent = spark.sparkContext.broadcast(np.sort(frequent.view(np.uint64)))

        def spelled(key: np.ndarray) -> pa.Array:
            pair, last = unpacked(key)
            return keys([*unpacked(sent.value[pair.astype(np.int64)]), last], 4)

        triples = counted_numbers(texts.mapInArrow(lambda batches: triples_of(sent.value, batches), NUMBERED), least, spelled)
    else:
        held = texts.mapInArrow(lambda batches: pairs_of(width, True, batches), f"block long, {COUNTED}")
        frequent = held.join(twos, "key", "left_semi").select("block", "key")
        triples = texts.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(lambda of, rows: joined_triples(width, of, rows), COUNTED)
        triples = counted(triples, 3 * width, least)
    threes = table(triples, "collocation-threes")
    drop(texts)
    release(spark)

    binary = lambda c: F.unhex(F.lpad(F.hex(c), 2 * width, "0"))
    of = lambda first, n: F.substring("key", 1 + first * width, n * width)
    singles = dictionary.select(binary(F.col("id")).alias("key"), "f", "lang", "word")
    total = sums.agg(F.sum("n")).head()[0] or 0
    parts = singles.select("key", "f", "lang").union(twos.select("key", "f", F.lit(None).cast("string")))
    # At most a hundred words and a hundred pairs make up a hundredth of all words each.
    hot = [F.lit(bytes(r[0])) for r in parts.where(F.col("f") * 100 >= total).select("key").collect()]
    is_hot = lambda c: c.isin(*hot) if hot else F.lit(False)
    spread = parts.withColumn("salt", F.explode(F.when(is_hot(F.col("key")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))

    def looked_up(rows: DataFrame, by: str, **columns: str) -> DataFrame:
        salted = rows.withColumn("salt", F.when(is_hot(F.col(by)), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(0))
        other = spread.select(F.col("key").alias(by), "salt", *[F.col(c).alias(n) for n, c in columns.items()])
        return salted.join(other, [by, "salt"]).drop("salt")

    cut = lambda k, size: F.struct(F.lit(k).alias("k"), of(0, k).alias("left"), of(k, size - k).alias("right"))
    both = twos.select("key", F.col("f").alias("a"), F.array(cut(1, 2)).alias("cuts")).union(threes.select("key", F.col("f").alias("a"), F.array(cut(1, 3), cut(2, 3)).alias("cuts")))
    rows = both.select("key", "a", F.inline("cuts"))
    rows = looked_up(looked_up(rows, "left", l="f", lang="lang"), "right", r="f")
    rows = rows.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    rows = rows.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("least"), F.max(F.when(F.col("k") == 1, F.col("lang"))).alias("lang"))
    longer = threes.select(F.explode(F.array(of(0, 2), of(1, 2))).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    rows = rows.join(longer, "key", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered_percent))
    rows = rows.select("key", "lang", "a", "least.l", "least.r", "least.score")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    rows = rows.withColumn("rank", F.rank().over(best)).where(F.col("rank") <= top).drop("rank")
    word = singles.select(F.col("key").alias("part"), "word")
    each = rows.select("key", F.posexplode(F.array(of(0, 1), of(1, 1), of(2, 1))).alias("place", "part")).where(F.length("part") > 0)
    spelled = each.join(word, "part").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    rows = rows.join(spelled, "key").withColumn("phrase", F.array_join("words.word", " "))
    final = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(final).cast("long")).where(F.col("rank") <= top)
    return rows.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_COUNTS = "SELECT lang, {size} AS size, unnest(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) AS phrase FROM w"

ORACLE = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM ({" UNION ALL ".join(_COUNTS.format(size=s) for s in (1, 2, 3))}) GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS x FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(x[1:k], ' ') AS one, array_to_string(x[k + 1:size], ' ') AS two
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (
  SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = one AND x.size = k JOIN f y ON y.lang = c.lang AND y.phrase = two AND y.size = c.size - k),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, size, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(a) AS m FROM (
    SELECT lang, a, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS part FROM c WHERE size = 3) GROUP BY ALL),
left_over AS (SELECT lowest.* FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND part = phrase AND size = 2 WHERE m IS NULL OR 100 * m < 50 * a),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM left_over JOIN n USING (lang) QUALIFY rank <= 2000"""

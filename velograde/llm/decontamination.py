"""Benchmark decontamination by templates.

DataFrame operations only. Texts become words and numbers; numbers, units after
a number and names (capitalised inside a sentence) turn into typed
placeholders, all else into lower case. Windows of five template words of all
documents are hash-joined with those of the benchmark. A document that has at
least 80 % of an item's windows is aligned with the item in every way that has them, and the values in the slots of
the windows are compared: if in one alignment each value of the item has one value in the document, the document holds
the item, be it word by word or with other numbers, names and units.

Windows of the benchmark with fewer than ``LITERALS`` plain words say too little and do not count. The first window does not count in the share
either: what precedes an item in a document decides whether its first word is a name.

A capitalised word that begins a sentence may be a name or not. Windows with such words are posted in both forms, and
an item is looked for in two modes: with the words as they are (0), and with windows of either form (1), where what stands at
the beginning of a sentence is a slot like any other name.

Items that templates cannot carry, because they have at most five words or because fewer than half of their windows count (lists of names, rows of numbers),
are searched word for word in the same way: all their windows, of five words or of the whole item, of plain lower-case words.
Documents are hashed for these lengths only where the benchmark has such items. Those of more than five words with ``LITERALS`` plain ones
are looked for by template too (mode 2, such as arithmetic with other numbers): every window with a plain word, at one place, where the whole template then has to be the item's.

Defined cases: null texts are empty and match nothing; items of fewer than three words say
too little and are not searched; rows with one id are one document, each row without an id is one of its own (id null; equal texts are reported once); repeated items are each reported; empty tables yield no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograde.llm.workdir import rows_below, table

WINDOW, PERCENT, LITERALS = 5, 80, 2
#: The fewest words of an item that is searched.
LEAST = 3
#: Windows of the benchmark are broadcast below so many (about 50 bytes each); else both sides are shuffled.
BROADCAST_WINDOWS = 1_000_000

#: Sentence ends, numbers, words.
TOKEN = r"\p{L}++|[.!?\n]|\p{N}++(?:[.,]\p{N}++)*+"
#: Units that turn into a placeholder after a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "l", "s", "min", "h", "day", "days", "hour", "hours",
    "minute", "minutes", "second", "seconds", "week", "weeks", "month", "months", "year", "years", "meter", "meters", "metre", "metres",
    "kilometer", "kilometers", "kilometre", "kilometres", "mile", "miles", "inch", "inches", "foot", "feet", "gram", "grams", "kilogram", "kilograms",
    "pound", "pounds", "liter", "liters", "litre", "litres", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees",
)
NUMBER, UNIT, NAME = "#number", "#unit", "#name"
#: Stands before a word that is a name or begins a sentence; no token holds it.
INITIAL = "^"
#: With the words as they are, with beginnings of sentences as names, whole templates.
AS_WRITTEN, NAMED, WHOLE = 0, 1, 2
#: Windows of plain words, looked for as they are written only.
PLAIN = 3


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def typing(tokens: Column, word: Callable[[Column], Column], name: Callable[[Column], Column], placeholder: Callable[[str], Column]) -> Callable[[Column, Column], Column]:
    """The function that gives, for a token and its place, what its template word is made to; null for sentence ends. word: of plain words, name: of words that may be names."""

    def one(t: Column, i: Column) -> Column:
        before = F.get(tokens, i - 1)
        numeric = lambda x: (x >= "0") & (x < ":")
        plain = F.lower(t)
        # Lower case is the usual case and comes first; digits and sentence ends sort before letters.
        return (
            F.when((t == plain) & (t >= "A"), F.when(t.isin(*UNITS) & numeric(before), placeholder(UNIT)).otherwise(word(t)))
            .when((t < "0") | (t == "?"), F.lit(None))
            .when(t == plain, placeholder(NUMBER))
            .when(plain.isin(*UNITS) & numeric(before), placeholder(UNIT))
            .when(F.substring(t, 2, 1) == F.upper(F.substring(t, 2, 1)), word(plain))
            .when((i > 0) & ~before.isin(".", "!", "?", "\n"), placeholder(NAME))
            .otherwise(name(plain))
        )

    return one


def tokenised(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``tokens`` and ``typed``: the template word of each token, null for sentence ends, marked where it may be a name.

    Both are columns of steps of their own: an expression that a lambda refers to
    would be evaluated for each element.
    """
    one = typing(F.col("tokens"), lambda w: w, lambda w: F.concat(F.lit(INITIAL), w), F.lit)
    return rows.withColumn("tokens", tokens_of(text)).withColumn("typed", F.transform("tokens", one))


def code(word: Column) -> Column:
    """A template word as a number; its last bit is free for a mark."""
    return F.xxhash64(word).bitwiseAND(F.lit(-2))


def coded(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``tokens`` and ``codes``: the code of each template word, its last bit set where it may be a name."""
    one = typing(F.col("tokens"), code, lambda w: F.xxhash64(w).bitwiseOR(F.lit(1)), lambda w: code(F.lit(w)))
    codes = F.filter(F.transform("tokens", one), lambda x: x.isNotNull())
    return rows.withColumn("tokens", tokens_of(text)).withColumn("codes", codes)


def as_word(w: Column) -> Column:
    return F.when(w.startswith(INITIAL), F.substr(w, F.lit(2))).otherwise(w)


def as_name(w: Column) -> Column:
    return F.when(w.startswith(INITIAL), NAME).otherwise(w)


def with_words(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``typed``, the template of a text with its marks, ``words``, without them, ``named``, the same with beginnings of sentences as names, and ``plain``, its words in lower case at the same places."""
    plain = F.filter(F.zip_with("typed", "tokens", lambda w, v: F.when(w.isNotNull(), F.lower(v))), lambda x: x.isNotNull())
    rows = tokenised(rows, text).withColumns({"typed": F.filter("typed", lambda x: x.isNotNull()), "plain": plain})
    return rows.withColumns({"words": F.transform("typed", as_word), "named": F.transform("typed", as_name)}).drop("tokens")


def with_slots(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Add (word, named, value) of each template word: the template in both forms and what stood there."""
    pairs = F.zip_with("typed", "tokens", lambda w, v: F.struct(as_word(w).alias("word"), as_name(w).alias("named"), v.alias("value")))
    return tokenised(rows, text).withColumn(name, F.filter(pairs, lambda x: x["word"].isNotNull())).drop("tokens", "typed")


def windows(words: str, size: int = WINDOW, *salt: Column) -> Column:
    """The hash of each window of so many words, in order; none for fewer words."""
    last = F.size(words) - size
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*salt, *[code(F.get(F.col(words), i + k)) for k in range(size)]))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def plain_salt(size: int) -> Column:
    """Windows of plain words are apart from the templates' and from those of other lengths."""
    return F.lit(f"plain {size}")


def benchmark_windows(items: DataFrame) -> DataFrame:
    """(item_id, size, mode, at, h, counts): the windows that are searched; size: 0 for templates, else the number of plain words."""
    # A table: what a lambda or a later step refers to is not computed again for each element.
    rows = table(with_words(items, F.col("text")).select("item_id", "words", "named", "plain").withColumn("row", F.monotonically_increasing_id()), "benchmark-words")
    rows = rows.withColumn("n", F.size("words"))
    plain_words = lambda words: F.size(F.filter(words, lambda w: ~w.startswith("#")))

    def templates(words: str) -> DataFrame:
        each = rows.where(F.col("n") > WINDOW).select("row", "item_id", "n", words, F.posexplode(windows(words)).alias("at", "h"))
        return each.select("row", "item_id", "n", "at", "h", plain_words(F.slice(words, F.col("at") + 1, WINDOW)).alias("literal"))

    # The first window is searched with the others of a template, though it does not count.
    counts = (F.col("at") > 0).alias("counts")
    template = templates("words")
    enough = template.where(F.col("literal") >= LITERALS).select("row", "item_id", "n", F.lit(0).alias("size"), F.lit(AS_WRITTEN).alias("mode"), "at", "h", counts)
    carried = enough.where("counts").groupBy("row", "n").agg(F.count(F.lit(1)).alias("some")).where(2 * F.col("some") >= F.col("n") - WINDOW).select("row")
    # Of the other form the windows that count as they are written; where it is the same, a document's other form may meet it.
    own = enough.select("row", "at", F.col("h").alias("written"))
    named = templates("named").where(F.col("literal") >= LITERALS).join(own, ["row", "at"]).where("h != written")
    named = named.select("row", "item_id", "n", F.lit(0).alias("size"), F.lit(NAMED).alias("mode"), "at", "h", counts)
    names = ["item_id", "size", "mode", "at", "h", "counts"]
    out, rest = enough.union(named).join(carried, "row", "left_semi").select(*names), rows.join(carried, "row", "left_anti")
    whole = rest.where(plain_words(F.col("words")) >= LITERALS).select("row")
    whole = template.where(F.col("literal") >= 1).join(whole, "row", "left_semi")
    out = out.union(whole.select("item_id", F.lit(0).alias("size"), F.lit(WHOLE).alias("mode"), "at", "h", counts))
    for size in range(LEAST, WINDOW + 1):
        own = rest.where((F.col("n") >= size) & (F.lit(size == WINDOW) | (F.col("n") == size)))
        out = out.union(own.select("item_id", F.lit(size).alias("size"), F.lit(PLAIN).alias("mode"), F.posexplode(windows("plain", size, plain_salt(size))).alias("at", "h"), F.lit(True).alias("counts")).select(*names))
    return out


def document_windows(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, doc_id, pos, h, written) of the windows of a document, all lengths in one pass; templates come in both forms, in one where both are the same.

    Words are hashed once, and their hashes for each window after its place was exploded: there Spark compiles what it interprets in lambdas. Outer, as
    Spark adds a filter on the array's size to the other kind, which makes the tokens anew for each element; the place of an empty array is null and has no hash.
    """
    plain = [n for n in sizes if n]
    rows = coded(docs, F.col("text"))
    arrays = ["codes"]
    if plain:
        own = F.filter(F.transform("tokens", lambda t: F.when((t < "0") | (t == "?"), F.lit(None)).otherwise(code(F.lower(t)))), lambda x: x.isNotNull())
        rows, arrays = rows.withColumn("plain", own), ["codes", "plain"]
    rows = rows.select("key", "doc_id", *arrays, F.posexplode_outer("codes").alias("pos", "first"))
    at = lambda words, n: [F.get(words, F.col("pos") + k) for k in range(n)]
    fits = lambda h, n: F.when(F.col("pos") + n <= F.size("codes"), h)
    forms = [fits(F.xxhash64(plain_salt(n), *at("plain", n)), n) for n in plain]
    names = [f"code{k}" for k in range(WINDOW)]
    rows = rows.select("key", "doc_id", "pos", *[c.alias(name) for c, name in zip(at("codes", WINDOW), names)], *[h.alias(f"form{k}") for k, h in enumerate(forms)])
    hashes = [F.col(f"form{k}") for k in range(len(forms))]
    if 0 in sizes or not plain:
        marked = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
        fits = F.col(names[-1]).isNotNull()
        some = reduce(Column.bitwiseOR, map(F.col, names)).bitwiseAND(F.lit(1)) == 1
        hashes.append(F.when(fits, F.xxhash64(*[F.col(c).bitwiseAND(F.lit(-2)) for c in names])))
        hashes.append(F.when(some, F.xxhash64(*[F.when(marked(c), code(F.lit(NAME))).otherwise(F.col(c)) for c in names])))
    rows = rows.select("key", "doc_id", "pos", F.posexplode_outer(F.array(*hashes)).alias("form", "h")).where("h is not null")
    return rows.select("key", "doc_id", "pos", "h", (F.col("form") <= len(forms)).alias("written"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, windows, matched, coverage, verbatim."""
    return held(docs, benchmark, id_col, text_col, item_col, item_text_col, percent).drop("key")


def held(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """What :func:`contaminated` returns, with the document's ``key``."""
    docs = docs.select(own_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    wanted = table(benchmark_windows(items), "benchmark-windows")
    # An item counts its windows once, whatever their form.
    mode = F.col("mode")
    totals = wanted.where("counts").withColumn("whole", mode == WHOLE).groupBy("item_id", "whole").agg(F.count_distinct("at").alias("windows"))
    # At most one row for each length.
    sizes = sorted(r["size"] for r in wanted.select("size").distinct().collect())
    wanted = wanted.drop("size")
    if rows_below(wanted, BROADCAST_WINDOWS):
        wanted = F.broadcast(wanted)
    met = document_windows(docs, sizes).join(wanted, "h")
    # Windows as they are written serve both modes, those with another form on either side the second; whole templates are looked for as written.
    both = (mode == AS_WRITTEN) & F.col("written")
    modes = F.when(mode == WHOLE, F.when(F.col("written"), F.array(F.lit(WHOLE)))).when(mode == PLAIN, F.array(F.lit(AS_WRITTEN)))
    modes = modes.when(both, F.array(F.lit(AS_WRITTEN), F.lit(NAMED))).otherwise(F.array(F.lit(NAMED)))
    met = met.select("key", "doc_id", "item_id", "at", "counts", (F.col("pos") - F.col("at")).alias("shift"), F.explode(modes).alias("mode"))
    found = table(met.distinct(), "benchmark-found")
    least = F.when(mode == WHOLE, 100).otherwise(percent)
    shares = found.groupBy("key", "doc_id", "item_id", "mode").agg(F.count_distinct(F.when(F.col("counts"), F.col("at"))).alias("matched")).withColumn("whole", mode == WHOLE)
    hits = table(shares.join(totals, ["item_id", "whole"]).where(100 * F.col("matched") >= least * F.col("windows")).drop("whole"), "benchmark-hits")
    # Only documents with hits are read again, for the values in their slots.
    keys = table(hits.select("key").distinct(), "benchmark-keys")
    read = docs.join(F.broadcast(keys) if rows_below(keys, BROADCAST_WINDOWS) else keys, "key", "left_semi")
    read = with_slots(read, F.col("text"), "theirs").select("key", "theirs")
    ours = with_slots(items, F.col("text"), "ours").select("item_id", "ours")
    aligned = alignments(found.drop("doc_id").join(hits, ["key", "item_id", "mode"]), ours.groupBy("item_id").agg(F.max(F.size("ours")).alias("length")), least)
    pairs = aligned.join(ours, "item_id").join(read, "key")
    # The slots of each window that matched, at its own shift; of a whole template all.
    slots = F.array_distinct(F.flatten(F.transform("spots", lambda x: F.transform(F.array(*map(F.lit, range(WINDOW))), lambda k: F.struct((x["at"] + k).alias("i"), (x["at"] + x["shift"] + k).alias("j"))))))
    shift = F.get("spots", F.lit(0))["shift"]
    every = F.transform("ours", lambda x, i: F.struct(i.alias("i"), (i + shift).alias("j")))
    pairs = pairs.withColumn("slots", F.when(mode == WHOLE, every).otherwise(slots))
    form = lambda x: F.when(mode == AS_WRITTEN, x["word"]).otherwise(x["named"])
    side = lambda x, n: [x["word"].alias(f"word{n}"), form(x).alias(f"form{n}"), x["value"].alias(f"value{n}")]
    met = F.transform("slots", lambda x: F.struct(*side(F.get("ours", x["i"]), 1), *side(F.get("theirs", x["j"]), 2)))
    # Before the first word and after the last one of the document there are no words to get.
    equal = lambda x: F.coalesce((x["word1"] == x["word2"]) | (x["form1"] == x["form2"]), F.lit(False))
    names = ["key", "doc_id", "item_id", "mode", "windows", "matched"]
    pairs = pairs.select(*names, met.alias("met")).where((mode != WHOLE) | F.forall("met", equal))
    pairs = pairs.withColumn("filled", F.filter("met", lambda x: x["form1"].startswith("#") & (x["form1"] == x["form2"])))
    values = F.array_distinct(F.transform("filled", lambda x: F.struct(x["form1"].alias("w"), x["value1"].alias("v"))))
    both = F.array_distinct(F.transform("filled", lambda x: F.struct(x["form1"].alias("w"), x["value1"].alias("v"), x["value2"].alias("v2"))))
    verbatim = F.forall("filled", lambda x: x["value1"] == x["value2"])
    judged = pairs.select(*names, (F.size(values) == F.size(both)).alias("consistent"), verbatim.alias("verbatim"))
    # A document holds the item if one of its alignments, in one of the rows with its id, does.
    share = F.struct((F.col("matched") / F.col("windows")).alias("coverage"), "windows", "matched")
    kept = judged.where("consistent").groupBy("key", "doc_id", "item_id").agg(F.max(share).alias("x"), F.max("verbatim").alias("verbatim"))
    return kept.select("key", "doc_id", "item_id", "x.windows", "x.matched", "verbatim", "x.coverage")


def own_key(doc_id: Column, text: Column) -> Column:
    """The id, or for rows without one the digest of the text: what is found in a text is found in each row with it."""
    return F.when(doc_id.isNull(), F.concat(F.lit("text "), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))).otherwise(F.concat(F.lit("id "), doc_id.cast("string")))


def alignments(found: DataFrame, lengths: DataFrame, percent: Column) -> DataFrame:
    """(key, doc_id, item_id, mode, windows, matched, spots): the windows (at, shift) of each alignment of a document with an item.

    Every shift with windows is one: alone, and with each other window of the item at the shift that is nearest, at most the
    item's length away (words may be inserted or missing). These have to reach the share. The shift with
    most windows is one with the windows at any other shift. Whole templates stand at one shift.
    """
    names = ["key", "doc_id", "item_id", "mode", "windows", "matched"]
    found = found.join(lengths, "item_id").withColumn("cell", F.floor(F.col("shift") / F.col("length")))
    base = found.groupBy(*names, "cell", F.col("shift").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    best = base.groupBy("key", "item_id", "mode").agg(F.max(F.struct("n", "base")).alias("x")).select("key", "item_id", "mode", F.col("x.base").alias("base"))
    spot = found.where(F.col("mode") != WHOLE).select("key", "item_id", "mode", "at", "counts", "shift", "length", "cell")
    around = base.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    near = around.join(spot, ["key", "item_id", "mode", "cell"]).where("abs(shift - base) <= length").select(*names, "base", "at", "counts", "shift", F.lit(0).alias("kind"))
    alone = found.select(*names, F.col("shift").alias("base"), "at", "counts", "shift", F.lit(1).alias("kind"))
    pooled = found.where(F.col("mode") != WHOLE).join(best, ["key", "item_id", "mode"]).select(*names, "base", "at", "counts", "shift", F.lit(2).alias("kind"))
    away = F.struct(F.abs(F.col("shift") - F.col("base")).alias("d"), "shift")
    every = near.union(alone).union(pooled).groupBy(*names, "base", "kind", "at", "counts").agg(F.min(away).alias("x"))
    every = every.groupBy(*names, "base", "kind").agg(F.collect_list(F.struct("at", F.col("x.shift").alias("shift"))).alias("spots"), F.sum(F.col("counts").cast("long")).alias("own"))
    return every.where(100 * F.col("own") >= percent * F.col("windows")).select(*names, "spots")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item of the benchmark, all columns."""
    found = table(held(docs, benchmark, id_col, text_col).select(F.col("key").alias("_held")).distinct(), "benchmark-held")
    if rows_below(found, BROADCAST_WINDOWS):
        found = F.broadcast(found)
    return docs.join(found, own_key(docs[id_col], docs[text_col]) == found["_held"], "left_anti")

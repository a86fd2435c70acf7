"""Secret scan over a trigram inverted index.

DataFrame operations only. Each rule's regex is taken apart into a Boolean
query over trigrams of lower-case text: a conjunction of disjunctions of
literals, each a conjunction of trigrams. The index holds, per shard of
documents and trigram, the sorted list of documents that contain it. It covers the trigrams
that the rules ask for, is a table in the shared folder, and serves any rules over these trigrams.
Lists are intersected and united shard by shard; only documents that pass are
verified with the regex. Rules that need no trigram scan every text.

A match is a leftmost, non-overlapping one per kind, then dropped if its value is too short.
Offsets come from the lengths of the pieces between the matches, in code points.

Defined cases: null texts are empty; documents without an id are in no list and are verified
for every rule; rows with one id are candidates together and are verified each; empty tables yield no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograde.llm.workdir import rows_below, table

try:
    from re import _parser as sre
except ImportError:  # before Python 3.11
    import sre_parse as sre

#: Documents of an index shard, about: the length of its longest list.
SHARD_DOCS = 8192
#: Candidates are broadcast below so many (about 40 bytes each); else texts are shuffled to them.
BROADCAST_CANDIDATES = 200_000
#: Character classes up to this size are spelled out.
SMALL_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and the least length of one of its groups (0: the match)."""

    kind: str
    regex: str
    group: int
    least: int


#: The base kinds, in their order, then the further kinds of this scanner.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 27),
)

#: A conjunction of disjunctions of literals' trigrams.
Query = tuple[tuple[tuple[str, ...], ...], ...]


def _literals(node) -> list[str] | None:
    """The strings that a node matches, if they are few; else None."""
    kind, value = node
    if kind is sre.LITERAL:
        return [chr(value)]
    if kind is sre.IN:
        out: list[str] = []
        for k, v in value:
            if k is sre.LITERAL:
                out.append(chr(v))
            elif k is sre.RANGE and v[1] - v[0] < SMALL_CLASS:
                out += map(chr, range(v[0], v[1] + 1))
            else:
                return None
        return out if len(out) <= SMALL_CLASS else None
    if kind is sre.SUBPATTERN:
        return _all_of(value[-1])
    if kind is sre.BRANCH:
        parts = [_all_of(x) for x in value[1]]
        return None if None in parts else [s for p in parts for s in p]
    if kind is sre.MAX_REPEAT and value[0] <= value[1] <= 1:
        inner = _all_of(value[2])
        return None if inner is None else [""] * (value[0] == 0) + inner
    return None


def _all_of(nodes) -> list[str] | None:
    strings = [""]
    for node in nodes:
        if (found := _literals(node)) is None:
            return None
        strings = [a + b for a in strings for b in found]
    return strings


def trigrams(literal: str) -> tuple[str, ...]:
    low = literal.lower()
    return tuple(sorted({low[k : k + 3] for k in range(len(low) - 2)}))


def trigram_query(regex: str) -> Query:
    """What trigrams a text needs to hold a match; empty if none is mandatory."""
    runs: list[list[str]] = [[""]]

    def walk(nodes) -> None:
        for node in nodes:
            found = _literals(node)
            if found is not None and len(runs[-1]) * len(found) <= 64:
                runs[-1] = [a + b for a in runs[-1] for b in found]
                continue
            runs.append([""])
            if node[0] is sre.SUBPATTERN:
                walk(node[1][-1])
                runs.append([""])
            elif node[0] is sre.MAX_REPEAT and node[1][0] > 0:
                walk(node[1][2])
                runs.append([""])

    walk(sre.parse(regex))
    clauses = []
    for run in runs:
        needs = sorted({trigrams(x) for x in run})
        if needs and all(needs):
            # A literal whose trigrams include another's adds nothing to the disjunction.
            clauses.append(tuple(x for x in needs if not any(y != x and set(y) < set(x) for y in needs)))
    return tuple(dict.fromkeys(clauses))


def vocabulary(rules) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.regex) for need in clause for t in need})


def build_index(docs: DataFrame, words: list[str]) -> DataFrame:
    """(shard, trigram, docs): sorted lists of the ids of documents that contain each trigram, of (doc_id, text)."""
    shards = max(1, docs.count() // SHARD_DOCS)
    low = docs.where("doc_id is not null").select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in words]))
    posted = low.select("doc_id", F.explode(held).alias("trigram")).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    return table(posted.groupBy("shard", "trigram").agg(F.array_sort(F.collect_set("doc_id")).alias("docs")), "trigram-index")


def _evaluate(query: Query) -> Column:
    """The documents of a shard that satisfy a query, from the map ``lists`` of its trigrams."""
    of = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), F.array().cast("array<bigint>"))

    def fold(f, columns):
        out = columns[0]
        for c in columns[1:]:
            out = f(out, c)
        return out

    return fold(F.array_intersect, [fold(F.array_union, [fold(F.array_intersect, [of(t) for t in need]) for need in clause]) for clause in query])


def candidates(index: DataFrame, rules) -> DataFrame:
    """(doc_id, kinds): per document, the rules whose queries its trigrams satisfy."""
    lists = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "docs"))).alias("lists"))
    asked = [(r.kind, q) for r in rules if (q := trigram_query(r.regex))]
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), _evaluate(q).alias("docs")) for kind, q in asked])
    rows = lists.select(F.explode(each).alias("x")).select("x.kind", F.explode("x.docs").alias("doc_id"))
    return rows.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, rank: int) -> Column:
    """(start, rank, end) of the matches of a rule that are long enough."""
    regex = F.lit(rule.regex)
    found = F.regexp_extract_all("text", regex, F.lit(0))
    values = F.regexp_extract_all("text", regex, F.lit(rule.group)) if rule.group else found
    between = F.split("text", rule.regex, -1)
    rows = F.arrays_zip(F.transform(between, F.char_length).alias("gap"), F.transform(found, F.char_length).alias("n"), F.transform(values, F.char_length).alias("size"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["n"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["size"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, further=FURTHER, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans) with spans (start, end, kind) by start and then rule, one row per input row.

    ``index`` may be one that :func:`build_index` made of these documents before.
    """
    rules = [*base, *further]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if index is None:
        index = build_index(docs, vocabulary(rules))
    some = table(candidates(index, rules), "secret-candidates")
    if rows_below(some, BROADCAST_CANDIDATES):
        some = F.broadcast(some)
    rows = docs.join(some, "doc_id", "left")
    parts = []
    for rank, rule in enumerate(rules):
        spans = _spans(rule, rank)
        if trigram_query(rule.regex):
            asked = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
            spans = F.when(asked, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int>>"))
        parts.append(spans)
    kind = lambda x: F.element_at(F.array(*[F.lit(r.kind) for r in rules]), x["rank"] + 1)
    merged = rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))
    return merged.select("doc_id", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind(x).alias("kind"))).alias("spans"))


def digest(found: DataFrame, base=BASE) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    names = [r.kind for r in base]
    counted = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k))
    counts = [counted(k).cast("long").alias(f"n_{k}") for k in names]
    return found.select("doc_id", *counts, F.sha2(text(F.filter("spans", lambda x: x["kind"].isin(*names))), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _oracle(rules=(*BASE, *FURTHER)) -> str:
    each = []
    for rank, r in enumerate(rules):
        regex = r.regex.replace("'", "''")
        each.append(f"SELECT doc_id, row, '{r.kind}' AS kind, {rank} AS rank, {int(rank < len(BASE))} AS base, {r.least} AS least, regexp_extract_all(t, '{regex}', 0) AS ms, regexp_extract_all(t, '{regex}', {r.group}) AS gs, string_split_regex(t, '{regex}') AS ps FROM d")
    listed = "string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank)"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(each)}),
x AS (SELECT row, kind, rank, base, least, i, ms, gs, ps FROM m, unnest(range(1, len(ms) + 1)) AS u(i)),
s AS (
  SELECT row, kind, rank, base, b, b + length(ms[i]) AS e
  FROM (SELECT *, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0))::BIGINT AS b FROM x)
  WHERE length(gs[i]) >= least),
a AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         {listed} FILTER (base = 1) AS base, {listed} AS spans
  FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (row)"""


ORACLE = _oracle()

"""Registered queries of the training-data operators, with their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograde.llm import collocations, conversations, decontamination, exact_dedup, mixing, near_dedup, passages, pieces, quality, secrets, token_files, toxicity, warc


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats", "position")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(_read(spark, sf_dir, "documents"), _tokenizer())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality.training_labels(_read(spark, sf_dir, "labels"), "quality", 4, 2)
    return quality.decide(quality.score(_read(spark, sf_dir, "documents"), labels), 4, 2)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality.training_labels(_read(spark, sf_dir, "labels"), "toxic", 3, 1)
    return quality.decide(toxicity.score(_read(spark, sf_dir, "documents"), labels), 3, 1)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_read(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_read(spark, sf_dir, "documents"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_read(spark, sf_dir, "documents"), _piece_model())


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(_read(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(_read(spark, sf_dir, "conversations"))


QUERIES = {
    "op12_conversations": op12_conversations,
    "op13_collocations": op13_collocations,
    "op11_pieces": op11_pieces,
    "op8_passages": op8_passages,
    "op4_warc": op4_warc,
    "op2_secrets": op2_secrets,
    "op5_decontamination": op5_decontamination,
    "op3_near_dedup": op3_near_dedup,
    "op1_toxicity": op1_toxicity,
    "op7_quality": op7_quality,
    "op6_token_files": op6_token_files,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op13_collocations": collocations.ORACLE,
    "op4_warc": """
WITH k AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS refers_to FROM k WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> refers_to THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> refers_to THEN refers_to END AS refers_to
FROM k LEFT JOIN f USING (payload_digest)""",
    "op2_secrets": secrets.ORACLE,
    "op9_exact_dedup": r"""
WITH k AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size,
         first(doc_id ORDER BY points DESC, doc_id NULLS LAST) AS keep_id
  FROM k GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM k JOIN g USING (text_sha256)""",
    # Pairs are met by the rarest shingles of each set that two sets of 80 % similarity must share, then counted whole.
    "op3_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(sh) AS sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 1 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS sh FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
df AS (SELECT sh, count(*) AS df FROM s GROUP BY sh),
ranked AS (SELECT doc_id, sh, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, sh) AS place FROM s JOIN df USING (sh) JOIN n USING (doc_id)),
prefix AS (SELECT * FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1),
met AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.sh = b.sh AND a.doc_id < b.doc_id WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
linked AS (SELECT a, b FROM met JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.sh = x.sh GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
part AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN part USING (doc_id)""",
}

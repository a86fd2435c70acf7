"""The registered queries on the smallest tables: shapes, SQL equivalents, the pipeline's stages."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from velograde.llm import queries
from velograde.llm.workdir import table

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return None if pd.isna(v) else v.item() if hasattr(v, "item") else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return Counter(tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_stages_keep_the_columns_and_shrink(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = table(stage(spark, before, DATA), f"test-{name}")
        assert after.columns == columns, name
        ids = {r["doc_id"] for r in before.select("doc_id").collect()}
        now = Counter(r["doc_id"] for r in after.select("doc_id").collect())
        assert now and set(now) <= ids
        assert max(now.values()) <= (3 if name == "mixing" else 1)
        before = after
    tokens = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert tokens.count() == before.count()


def test_the_subpackage_is_all_that_needs_it():
    import __spark_entry__ as entry

    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    root = os.path.dirname(os.path.dirname(os.path.abspath(queries.__file__)))
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "velograde.llm" not in open(os.path.join(folder, n)).read(), n


def test_stages_carry_odd_rows_and_clashing_columns(spark):
    """Null and empty texts, rows without an id, repeated rows, and columns named like those of the stages."""
    import corpus_pipeline

    from pyspark.sql import functions as F

    extra = ("row", "position", "key", "label", "score", "size", "target", "_held", "_copy", "hash", "component", "item_id", "text_")
    given = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (900001, None, "en", None, 0), (900002, "", "en", "s", 0), (900003, " \n ", "en", "s", 3), (900004, "one", "en", "s", 3), (900005, "x" * 200_000, "en", "s", 200_000)]
    docs = given.union(spark.createDataFrame(odd, given.schema)).union(given.limit(5)).select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(c) for c in extra])
    docs = table(docs, "test-odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = table(stage(spark, docs, DATA), f"test-odd-{name}")
        assert after.columns == docs.columns, name
        # Each row keeps its own values.
        assert after.where(" or ".join(f"{c} <> concat('{c}-', coalesce(doc_id, -1))" for c in extra)).isEmpty(), name
        before, now = (Counter((r["doc_id"], r["text"]) for r in x.select("doc_id", "text").collect()) for x in (docs, after))
        assert now and set(now) <= set(before), name
        if name != "mixing":
            assert all(now[k] <= before[k] for k in now), name
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def test_stages_of_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = table(stage(spark, docs, DATA), f"test-empty-{name}")
        assert docs.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == 0


def test_a_grown_heap_of_the_driver_is_collected(monkeypatch):
    """Beyond half of the limit, and not again at once."""
    from types import SimpleNamespace as Own

    from velograde.llm import workdir

    runtime, done = Own(totalMemory=lambda: 300, maxMemory=lambda: 700), []
    fake = Own(_jvm=Own(java=Own(lang=Own(Runtime=Own(getRuntime=lambda: runtime)))))
    monkeypatch.setattr(workdir, "release", done.append)
    monkeypatch.setattr(workdir, "_settled", [float("-inf")])
    workdir.settle(fake)
    assert not done
    runtime.totalMemory = lambda: 400
    workdir.settle(fake)
    workdir.settle(fake)
    assert done == [fake]

"""The pipeline's stages and the registered queries on small tables."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import components, contamination, expected_groups
from trialweave.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.materialize(stage(spark, docs, DATA), "test")
        assert out.columns == docs.columns
        ids, texts = sorted(rows), [rows[i] for i in sorted(rows)]
        if name == "language_id":
            keep = set(ids)
        elif name == "exact_dedup":
            keep = {ids[k - 1] for k, g in expected_groups(texts).items() if g[2]}
        elif name == "near_dedup":
            keep = {ids[k - 1] for k, g in components(texts, corpus_pipeline.SHINGLE_WORDS).items() if g[2]}
        else:
            keep = {i for i, c in zip(ids, contamination(texts, items, 10)) if not c[1]}
        assert {r.doc_id for r in out.select("doc_id").collect()} == keep
        docs, rows = out, {i: rows[i] for i in keep}
    final = corpus_pipeline.run(spark, DATA)
    assert sorted(r.doc_id for r in final.select("doc_id").collect()) == sorted(rows) and final.where("not same").count() == 0


def test_stages_drop_what_they_should(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    extra = [(900001, "12 34", None, None, 5), (900002, None, None, None, 0), (900003, "", "en", "s", 0)]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").unionByName(spark.createDataFrame(extra, schema))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, DATA).select("doc_id").collect()}
    assert not kept & {900001, 900002, 900003} and len(kept) == docs.count() - 3


def test_stages_on_odd_rows(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in base.collect()}
    one = next(t for t in texts.values() if t and len(t) > 300)
    odd = [(None, one, "en", "s", 1), (None, one, "en", "s", 1), (900001, one, "en", "s", 1), (900001, "Other text that was not there before.", "en", None, None), (900002, None, None, None, None), (None, "", None, None, None)]
    clash = {"digest": F.lit(b"d"), "bucket": F.lit("b"), "node": F.lit("n"), "row": F.lit("r"), "kept": F.lit(False), "items": F.lit("i"), "chunk": F.lit("c"), "score": F.lit("s")}
    docs = base.unionByName(spark.createDataFrame(odd, base.schema)).withColumns(clash)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.materialize(stage(spark, docs, DATA), "test")
        assert out.schema.simpleString() == docs.schema.simpleString() and not stage(spark, out.limit(0), DATA).count()
        docs = out
    rows = docs.where("doc_id is null or doc_id > 900000").collect()
    # rows without an id stay where they have text; the id that stands twice is a copy by its first text, and both its rows go
    assert [r.text == one for r in rows] == [True, True] and {r.doc_id for r in rows} == {None}
    assert corpus_pipeline.tokenized(spark, docs, DATA).count() == docs.count()
    assert corpus_pipeline.tokenized(spark, docs.limit(0), DATA).count() == 0


def test_the_near_duplicate_stage_keeps_what_the_operator_keeps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in queries.QUERIES["op6_near_dedup"](spark, DATA).where("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, DATA).select("doc_id").collect()} == kept


def test_unlearnt_languages_and_gibberish_go(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rng = random.Random(0)
    odd = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(n)) for n in (100, 500, 3000)]
    odd += ["Все люди рождаются свободными и равными в своем достоинстве и правах.", "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan"]
    extra = spark.createDataFrame([(900001 + k, t, None, None, len(t)) for k, t in enumerate(odd)], docs.schema)
    french = docs.where("lang = 'fr'").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, docs.where("lang <> 'fr'").unionByName(french).unionByName(extra), data)
    counts = {lang: n for lang, n in kept.groupBy("lang").count().collect()}
    clean = docs.where("lang <> 'fr'").count()
    assert counts.get(None, 0) <= 0.03 * french.count() and sum(n for lang, n in counts.items() if lang) >= 0.99 * clean
    assert kept.where("doc_id > 900000").count() == 0


def test_texts_of_two_languages_stay(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    long = {r.lang: r.text for r in docs.where("length(text) between 1500 and 4000").collect()}
    mixed = [f"{long[a][:n]} {long[b][:1500]}" for a in long for b in long if a != b for n in (900, 1500)]
    extra = spark.createDataFrame([(900001 + k, t, None, None, len(t)) for k, t in enumerate(mixed)], docs.schema)
    assert corpus_pipeline.language_id(spark, docs.unionByName(extra), data).where("doc_id > 900000").count() == len(mixed)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    want = [[r[columns.index(n)] for n in names] for r in got.fetchall()]
    plain = lambda rows: sorted(repr([round(x, 5) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(df.select(*names).collect()) == plain(want)


def test_all_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in names if q.startswith("op")} and "pipeline" in names

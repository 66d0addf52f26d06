"""Repeated rows, empty tables and columns of clashing names, for the operators whose own tests have other inputs."""

from pyspark.sql import functions as F

from trialweave.llm import language, pieces, toxicity, warc
from trialweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string"


def test_toxicity_edges(spark):
    train = spark.createDataFrame([(k, "you awful zorgle of a man" if k % 2 else "a fine day in the park") for k in range(60)], SCHEMA)
    labels = train.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    odd = spark.createDataFrame([(1, "what a zorgle", 9.0, "x"), (1, "what a zorgle", 8.0, "y"), (2, None, 0.0, "z"), (3, "", 0.0, None), (None, "word " * 200_000, 0.0, None)], SCHEMA + ", score double, predicted string")
    for known in (labels, labels.limit(0), labels.withColumn("text", F.lit("clash")).unionByName(labels.withColumn("text", F.lit("again")))):
        model = toxicity.fit(train, known)
        got = toxicity.score(odd, model)
        assert got.columns == ["doc_id", "score", "predicted"]
        rows = got.collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 1}) == 1
        assert toxicity.score(odd.limit(0), model).collect() == []


def test_language_of_nothing(spark):
    docs = spark.createDataFrame([(1, "the and of", "en"), (2, "der und die", "de")], SCHEMA + ", lang string")
    model = language.fit(docs)
    assert language.predict(docs.limit(0), model).collect() == []
    twice = docs.withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    assert sorted(r.doc_id for r in language.predict(twice.unionByName(twice), model).collect()) == [1, 1, 2, 2]


def test_pieces_of_nothing_and_of_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (2, None, "z")], SCHEMA + ", ids string").withColumn("n_tokens", F.lit("clash"))
    got = sorted(map(tuple, pieces.round_trip(docs, tokenizer_path()).collect()))
    assert len(got) == 3 and got[0] == got[1] and got[2][:2] == (2, 0)
    assert pieces.round_trip(docs.limit(0), tokenizer_path()).collect() == []
    again = pieces.decode(pieces.encode(docs, tokenizer_path()), tokenizer_path())
    assert sorted((r.doc_id, r.text) for r in again.collect()) == [(1, "a b"), (1, "a b"), (2, "")]


def test_archives_number_their_pages(spark, tmp_path):
    pages = spark.createDataFrame([("k", "u", "x" * 200), ("12", "v", "y")], "page_id string, url string, html string")
    warc.write_archive(pages, str(tmp_path / "a"))
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert sorted((r.page_id or 0, bytes(r.payload)) for r in got) == [(0, b"x" * 200), (12, b"y")]  # only whole numbers come back, as the docstring says

"""Language identification: held-out accuracy, edge cases, independence of other columns."""

from pyspark.sql import functions as F

from codelattice.llm import language_id
from codelattice.llm.queries import op4_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = op4_language_id(spark, SF)
    assert found.count() == docs.count()
    seen = found.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    n, right = seen.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right >= 0.9 * n
    assert found.where("score < 0 or score > 1").isEmpty()


def test_edge_cases(spark):
    rows = [(i, x, y, "clash", 0.0) for i, (x, y) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("", "en"), (None, "en"), ("123 ...", "fr"), ("une phrase", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = language_id.train(docs)
    assert model.languages == ("en", "fr")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert [found[i][0] for i in range(5)] == ["en", "fr", "und", "und", "und"] and found[5][0] in ("en", "fr")
    assert found[2][1] == found[3][1] == 0.0
    assert {r.lang_pred for r in language_id.identify(docs.limit(0)).collect()} == set()


def test_long_text_in_slices(spark):
    docs = spark.createDataFrame([(0, "the cat sat " * 10, "en"), (1, "le chat dort " * 10, "fr"), (2, "le chat dort " * 200_000, None)], "doc_id long, text string, lang string")
    found = language_id.predict(docs, language_id.train(docs), ["doc_id"]).where("doc_id = 2").first()
    assert found.lang_pred == "fr" and 0.99 < found.score <= 1.0

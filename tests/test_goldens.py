"""Small texts with known measures."""

import pytest
from pyspark.sql import functions as F

from inkstat.config.rules import Rules
from inkstat.functions import metrics as M
from inkstat.functions import text as T
from inkstat.operators import editing, ensemble, ngrams, verdicts
from inkstat.plans import audit
from inkstat.sources import corpus
from inkstat.streaming import streams


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("word, n", [("table", 2), ("make", 1), ("the", 1), ("idea", 2)])
def test_syllables(spark, word, n):
    assert one(spark, word, T.syllables(F.col("text"))) == n


def test_sentence_lengths(spark):
    text = "a a a a a. " + "b " * 15 + "b. c c."
    row = M.with_layers(spark.createDataFrame([(text,)], "text string"), M.burstiness(F.col("text"), F.col)).first()
    assert round(row["mean"], 2) == 7.67 and round(row["deviation"], 2) == 7.37 and round(row["cv"], 2) == 96.14 and round(row["fano"], 2) == 7.09


def test_dash_spacing(spark):
    assert one(spark, "a—b—c", editing.cleaned(F.col("text"))) == "a — b—c"
    assert one(spark, "the the end  \n\n\n\n\nx -- y", editing.cleaned(F.col("text"))) == "the end\n\n\nx — y"


def test_protected_code_is_left_alone(spark):
    row = editing.clean_protected(spark.createDataFrame([(1, "the the `a -- b` c -- d\n```\nx -- y\n```\n")], "doc_id long, text string")).first()
    assert row["cleaned"] == "the `a -- b` c — d\n```\nx -- y\n```\n" and row["changes"] == {"double_hyphen_to_em_dash": 1, "doubled_words": 1}


def test_prose(spark):
    text = "---\ntitle: x\n---\nimport A from 'b'\n# Head\n> quote `code` [link](u) ![img](v)\n```js\ncode\n```\n<Tag />\nend"
    assert one(spark, text, T.prose(F.col("text"))).replace("\n\n", "\n") == "Head\nquote  link img\nend"


def test_rules():
    assert Rules(("academic",)).get("punctuation", "period_quote") == (97.0, 98.0)
    assert Rules(("book",)).get("structure", "bullet_density") is None
    with pytest.raises(ValueError):
        Rules(("blog", "blog"))


def test_rule_beyond_its_baseline_is_off(spark):
    row = spark.range(1).select(Rules(("academic",)).flags("punctuation", "period_quote", F.lit(99.0)).alias("a"), Rules(("academic",)).flags("punctuation", "period_quote", F.lit(99.0), auto_off=False).alias("b")).first()
    assert (row["a"], row["b"]) == (False, True)


def test_ensembles(spark):
    rows = [(1, t, "likely_ai", 0.95, []) for t in ("vocabulary", "burstiness", "ngram", "syntactic", "content", "punctuation", "structure")] + [(2, "vocabulary", "error", 0.0, [])]
    found = {r["doc_id"]: r for r in ensemble.full(spark.createDataFrame(rows, "doc_id long, tool string, classification string, confidence double, signals array<string>")).collect()}
    assert (found[1]["score"], found[1]["classification"], found[1]["confidence"]) == (0.88, "likely_ai", 0.95)
    assert (found[2]["score"], found[2]["tools"]) == (0.5, 0)
    scores = spark.createDataFrame([("uncertain", 0.5), ("uncertain", 0.7)], "classification string, confidence double").select(ensemble.fast_score().alias("s")).collect()
    assert [r["s"] for r in scores] == [0.6, 0.75]


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two words. Three whole words here.")], "doc_id long, text string")
    assert verdicts.tool_rows(docs, tuple(verdicts.TOOLS)).count() == 15
    assert {r["doc_id"] for r in ngrams.profile(docs, 2).collect()} == {3}
    assert ngrams.mtld(docs).count() == 3


def test_replacements(spark):
    docs = spark.createDataFrame([(1, "First one. Second  one. Third.")], "doc_id long, text string")
    items = spark.createDataFrame([(1, 1, "First one.", "A."), (1, 9, "Second one.", "B."), (1, 7, "Gone.", "C.")], "doc_id long, id int, original string, text string")
    row = editing.replaced(docs, items).first()
    assert (row["text"], row["applied"], row["missed"]) == ("A. B. Third.", 2, 1)


def test_fix_plan(spark):
    issues = spark.createDataFrame([(1, 1, "a", 1, 1.0), (1, 1, "b", 1, 1.0), (1, 2, "a", 9, 1.0), (1, 3, "b", 1, 1.0)], "doc_id long, sentence_id long, tool string, priority int, contribution double")
    budgets = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "doc_id long, tool string, excess double")
    assert [(r["sentence_id"], r["place"]) for r in editing.fix_plan(issues, budgets).orderBy("place").collect()] == [(1, 1), (2, 2)]


def test_audit(spark):
    rows = spark.createDataFrame([("a", 0.72), ("b", 0.41), ("c", 0.28)], "path string, score double")
    assert [r["status"] for r in audit.report(rows).collect()] == ["NEEDS WORK", "NEEDS WORK", "OK"]


def test_files_and_streams(spark, tmp_path):
    for name, text in (("a.md", " one \n"), ("b.txt", "two"), ("c.bin", "x"), ("skip.md", "y")):
        (tmp_path / name).write_text(text)
    assert sorted(r["text"] for r in corpus.text_files(spark, str(tmp_path), ignore="skip").collect()) == ["one", "two"]
    spark.createDataFrame([(1, "We delve.", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "in"))
    streams.score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["classification"] == "likely_ai"

"""Tables of outside scores."""

import pytest

from inkstat.operators import ensemble, scores


def test_model_verdicts_are_clamped_and_errors_excluded(spark):
    rows = spark.createDataFrame([(1, "likely_ai", 0.99), (2, "likely_human", 0.1), (3, None, 0.8), (4, "uncertain", None)], "doc_id long, classification string, confidence double")
    got = {r["doc_id"]: (r["classification"], r["confidence"]) for r in scores.model_verdicts(rows, "binoculars").collect()}
    assert got == {1: ("likely_ai", 0.95), 2: ("likely_human", 0.3), 3: ("error", 0.0), 4: ("uncertain", 0.5)}
    full = {r["doc_id"]: (r["score"], r["tools"]) for r in ensemble.full(scores.model_verdicts(rows, "binoculars")).collect()}
    assert full[1] == (pytest.approx(0.88), 1) and full[3] == (0.5, 0)


def test_perplexity(spark):
    docs = spark.createDataFrame([(1, 8.0), (2, 90.0), (3, None), (4, 12.0)], "doc_id long, perplexity double")
    sentences = spark.createDataFrame([(1, 10.0), (1, 10.0), (2, 20.0), (2, 180.0), (2, None)], "doc_id long, perplexity double")
    rows = {r["doc_id"]: r for r in scores.perplexity_verdict(scores.perplexity_measures(docs, sentences)).collect()}
    assert {k: (r["classification"], r["confidence"]) for k, r in rows.items()} == {1: ("likely_ai", 0.9), 2: ("likely_human", 0.9), 3: ("error", 0.0), 4: ("likely_ai", 0.75)}
    assert (rows[2]["scored"], rows[2]["mean"], rows[2]["deviation"], rows[2]["flat"], rows[1]["flat"]) == (2, 100.0, 80.0, False, True)


def test_curvature(spark):
    rows = spark.createDataFrame([(1, 5.0, [1.0, 3.0]), (2, 5.0, [2.0, 2.0]), (3, 1.0, [])], "doc_id long, log_prob double, perturbed array<double>")
    assert {r["doc_id"]: r["d_score"] for r in scores.curvature(rows).collect()} == {1: 3.0, 2: None, 3: None}


def test_punctuation_issues(spark):
    from inkstat.operators.dashes import dash_sentences, punctuation_issues

    stacked = "One—two—three. Four—five.\n\nSix—seven. Plain here.\n\nNothing.\n\nEight—nine."
    long = " ".join(["word"] * 300) + ", which is long. " + " ".join(["word"] * 220) + ", but " + "it ends.\n\nTiny not one."
    docs = spark.createDataFrame([(1, stacked), (2, long), (3, ""), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["issue"], r["sentence_id"]) for r in punctuation_issues(dash_sentences(docs)).collect())
    assert got == [
        (1, "em_dash_density", 1), (1, "em_dash_density", 2), (1, "em_dash_density", 3), (1, "em_dash_density", 6), (1, "em_dash_semicolon_ratio", 1), (1, "em_dash_semicolon_ratio", 2), (1, "em_dash_semicolon_ratio", 3),
        (1, "em_dash_stacking", 3), (2, "low_em_dash_density", 1), (2, "low_semicolon_density", 2),
    ]

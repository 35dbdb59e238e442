"""Analyses of parsed sentences on small parses."""

import pytest

from inkstat.operators import syntax as X

SCHEMA = "doc_id long, sentence_id long, paragraph int, tokens array<struct<text:string,lemma:string,pos:string,dep:string,head:int>>"


def token(text, pos, dep="dep", head=0):
    return (text, text.lower(), pos, dep, head)


def test_measures_of_a_parse(spark):
    rows = [
        (1, 1, 0, [token("It", "PRON", head=2), token("was", "AUX", head=2), token("seen", "VERB", head=2), token("because", "SCONJ", "mark", 5), token("dogs", "NOUN", head=5), token("bark", "VERB", "advcl", 2), token(".", "PUNCT", head=2)]),
        (1, 2, 0, [token("Stop", "VERB")]),
        (2, 1, 0, []),
    ]
    found = X.sentence_measures(spark.createDataFrame(rows, SCHEMA))
    one, two, three = found.orderBy("doc_id", "sentence_id").collect()
    assert (one["words"], one["aux"], one["pronouns"], one["nouns"], one["vague"], one["depth"], one["kind"], one["opens_with_pronoun"]) == (6, 1, 1, 1, 1, 2, "complex", True)
    assert (one["children"], one["parents"]) == (6, 2) and one["aux_share"] == pytest.approx(16.67)
    assert (two["depth"], two["kind"], three["words"], three["depth"], three["opens_with_pronoun"]) == (0, "simple", 0, 0, False)
    doc = X.document_measures(found).where("doc_id = 1").first()
    assert (doc["depth_mean"], doc["depth_variance"], doc["branching"], doc["clauses_per_sentence"]) == (1.0, 2.0, 3.0, 0.5)
    assert X.verdict(X.document_measures(found)).where("doc_id = 1").first()["classification"] == "likely_ai"


def test_height_ends_on_cycles(spark):
    rows = spark.createDataFrame([([0, 0, 1, 2],), ([1, 0],), ([],)], "h array<int>").select(X.height("h").alias("d"))
    assert [r["d"] for r in rows.collect()] == [3, 2, 0]


def test_provider(spark):
    docs = spark.createDataFrame([(1, "It rains because clouds, which isn't fair, burst. Go!"), (2, ""), (3, None)], "doc_id long, text string")
    rows = X.sentence_measures(X.closed_classes(docs)).orderBy("sentence_id").collect()
    assert [(r["doc_id"], r["words"], r["clauses"], r["depth"], r["kind"]) for r in rows] == [(1, 8, 2, 3, "complex"), (1, 1, 0, 1, "simple")]


def test_flags_spend_budgets(spark):
    rows = [(1, k, 0, [token("was", "AUX")] * n + [token("words", "NOUN")] * (10 - n)) for k, n in ((1, 1), (2, 4), (3, 2), (4, 0))]
    found = X.sentence_measures(spark.createDataFrame(rows, SCHEMA))
    got = X.auxiliary_flags(found, target=10.0).orderBy("place").collect()  # 7 of 40; excess 3: two count for sentence 2, two for 3
    assert [(r["sentence_id"], r["priority"]) for r in got] == [(2, "critical"), (3, "critical")]
    assert X.auxiliary_flags(found, target=20.0).count() == 0


def test_groups_merge_to_the_end(spark):
    targets = spark.createDataFrame([(1, 4, 1), (1, 6, 4), (1, 9, 8), (1, 3, 2), (2, 1, None)], "doc_id long, sentence_id long, antecedent long")
    got = {(r["doc_id"], r["group_id"]): r["members"] for r in X.pronoun_groups(targets).collect()}
    assert got == {(1, 1): [1, 4, 6], (1, 2): [2, 3], (1, 8): [8, 9], (2, 1): [1]}


def test_structure_flags(spark):
    plain = [token("word", "X")] * 10
    deep = [token("word", "X", head=max(0, i - 1)) for i in range(10)]
    rows = [(1, 1, 0, plain), (1, 2, 0, plain), (1, 3, 1, deep), (1, 4, 2, [token("and", "CCONJ", "cc")] + plain), (1, 5, 2, plain[:5])]
    got = X.structure_flags(X.sentence_measures(spark.createDataFrame(rows, SCHEMA))).orderBy("place").collect()
    assert [(r["sentence_id"], r["priority"], r["merge_with"]) for r in got] == [(1, "critical", 2), (2, "critical", 1)]  # budget: 30 % of four simple ones

"""The planner's pass over documents against the operators over sentence tables that it stands for."""

import os
import random

import pytest
from pyspark.sql import functions as F

from inkstat.catalogue import QUERIES
from inkstat.operators import dashes, editing, planner
from inkstat.operators import syntax as X

DIR = "/root/testdata/sf0.001"
WORDS = "it was this he they had is been and but because which when although table green running delve Robust crucial realm thing stuff way don't DON'T It's naïve 7 x_y İ increasingly vibrant not only especially a an the—and".split()
ENDS = [". ", "! ", "? ", "; ", ", ", " — ", "—", ", which ", ", but ", " (an aside of it) ", ": ", ".\n", "...  ", ".\n\n", "\n\n\n", ", and ", ", the old man, "]


def texts(n: int = 150, seed: int = 7):
    r = random.Random(seed)
    for i in range(n):
        own, ends = r.sample(WORDS, r.randint(2, len(WORDS))), r.sample(ENDS, r.randint(2, len(ENDS)))
        yield i, "".join(r.choice(own) + (r.choice(ends) if r.random() < 0.15 else " ") for _ in range(r.choice([3, 30, 120, 700, 1500])))
    yield from enumerate([None, "", " \n ", "—", "...", "É à.", "K It.", "It was. " * 600, "A table, and chairs, which were green and long enough to be seen. " * 80, "A note—short—here and there.\n\nOne—more.\n\n" * 30], n)


def by_operators(docs):
    """The six analyses, each over its own sentence table."""
    c, s = F.col, X.sentence_measures(X.closed_classes(docs))
    row = lambda found, tool, priority, contribution, instruction: found.select("doc_id", "sentence_id", F.lit(tool).alias("tool"), priority.alias("priority"), contribution.cast("double").alias("contribution"), instruction.alias("instruction"))
    grade = F.when((c("pronoun_share") > 20) | (c("pronouns") >= 4), "critical").when(c("pronoun_share") > 15, "high").otherwise("medium")
    parts = [
        row(X.auxiliary_flags(s, 3.0), "auxiliary", c("priority"), F.least(c("aux"), F.lit(2)), F.format_string("%d auxiliaries of %.2f percent", c("aux"), c("aux_share"))),
        row(X.pronoun_targets(s).where("doc_pronouns > 5"), "pronoun", grade, F.ceil(c("pronouns") * 0.5), F.concat(F.lit("name what is meant, see sentence "), F.coalesce("antecedent", "sentence_id").cast("string"))),
        row(dashes.punctuation_issues(dashes.dash_sentences(docs)), "punctuation", F.when(c("issue").endswith("em_dash_density"), "high").otherwise("medium"), F.lit(1), c("issue")),
        row(X.structure_flags(s), "structure", c("priority"), F.lit(1), F.coalesce(F.concat(F.lit("merge with sentence "), c("merge_with").cast("string")), F.lit("vary the structure"))),
        row(X.noun_flags(s, 20.0), "noun", c("priority"), F.lit(1), c("issue")),
        row(editing.marker_sentences(docs), "vocabulary", F.when(c("severity") == "moderate", "medium").otherwise(c("severity")), F.lit(1), F.concat(F.lit("replace "), c("marker"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def test_as_the_operators(spark):
    docs = spark.createDataFrame(list(texts()), "doc_id long, text string").repartition(4).cache()
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    want = rows(by_operators(docs))
    assert {r[2] for r in want} == {"auxiliary", "pronoun", "punctuation", "structure", "noun", "vocabulary"}
    assert {r[5] for r in want} >= {"em_dash_density", "low_em_dash_density", "em_dash_stacking", "low_semicolon_density", "em_dash_semicolon_ratio", "low_noun_high_pronoun", "low_noun_high_aux", "vague_references", "low_noun_general"}
    assert rows(planner.issues(docs)) == want
    assert rows(planner.issues(docs, X.closed_classes(docs))) == want
    given = lambda found: rows(planner.plan(docs, planner.gathered(docs, found)).withColumn("constraints", F.to_json("constraints")))
    assert rows(planner.plan(docs).withColumn("constraints", F.to_json("constraints"))) == given(None) == given(planner.issues(docs))
    assert rows(planner.verdict(docs)) == rows(planner.verdict(docs, planner.plan(docs)))


def test_text_without_words(spark):
    docs = spark.createDataFrame([(1, "\x0b"), (2, "It was\x0b.")], "doc_id long, text string")
    assert {r["doc_id"] for r in planner.issues(docs).collect()} == {2}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", ["plan_issues", "plan_verdict", "fix_plan"])
def test_documents_are_read_once(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Relation [") == 1

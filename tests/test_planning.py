"""Plans, configurations, offsets and the one-call interface on small cases worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from inkstat import api
from inkstat.config import resolve
from inkstat.operators import editing, offsets, planner, verdicts
from inkstat.operators import syntax as X

FLAGS = "doc_id long, sentence_id long, tool string, priority string, contribution double, instruction string"


def test_plan(spark):
    text = "We delve here. It is a crucial, robust thing—really—with words. Plain enough.\n\nIt was. It was, and it had been."
    docs = spark.createDataFrame([(1, text), (2, "Nothing to see."), (3, None)], "doc_id long, text string")
    flags = [(1, 1, "vocabulary", "critical", 1.0, "replace delve"), (1, 2, "vocabulary", "high", 1.0, "replace crucial"), (1, 2, "vocabulary", "high", 1.0, "replace robust"), (1, 2, "punctuation", "high", 1.0, "em_dash_density"), (1, 5, "structure", "low", 1.0, "x")]
    rows = planner.gathered(docs, spark.createDataFrame(flags, FLAGS))
    got = {r["tool"]: (r["target"], r["excess"]) for r in planner.budgets(rows).collect()}
    assert got["vocabulary"] == (0.0, 3.0) and got["structure"] == (0.0, 1.0) and got["punctuation"] == (1.5, 2.0) and got["auxiliary"][1] > 0
    plan = planner.plan(docs, rows).orderBy("place").collect()
    assert [(r["sentence_id"], r["issue_count"], r["paragraph"]) for r in plan] == [(2, 2, 0), (1, 1, 0), (5, 1, 1)]
    assert [(c["tool"], c["instruction"]) for c in plan[0]["constraints"]] == [("punctuation", "em_dash_density"), ("vocabulary", "replace crucial")] and plan[1]["text"] == "We delve here."
    assert {r["doc_id"]: r["verdict"] for r in planner.verdict(docs, planner.plan(docs, rows)).collect()} == {1: "needs-revision", 2: "approved", 3: "approved"}


def test_issues_of_six_tools(spark):
    text = "We delve into it—and so—on and on here. " + "It was what it was, as it had been. " * 6 + "\n\n" + "He did, and they were, and it is. " * 4
    found = planner.issues(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")).collect()
    assert {r["tool"] for r in found} >= {"auxiliary", "pronoun", "punctuation", "noun", "vocabulary"} and {r["doc_id"] for r in found} == {1}
    assert {(r["priority"], r["instruction"]) for r in found if r["tool"] == "vocabulary"} == {("critical", "replace delve")}
    assert all(r["contribution"] <= 2 for r in found if r["tool"] == "auxiliary")


def test_greedy_spends_budgets():
    flags = [(1, "a", 1, 1.0), (1, "b", 1, 1.0), (2, "a", 4, 1.0), (3, "b", 1, 1.0), (4, "c", 4, 9.0)]
    assert editing.greedy(flags, {"a": 2.0, "b": 1.0}) == [1, 2] and editing.greedy(flags, {}) == [] and editing.greedy(flags, {"c": 1.0}) == [4]


def test_patterns_and_pronouns(spark):
    docs = spark.createDataFrame([(1, "She is running. It was taken. They have gone home, they have seen. He could have walked. I can swim. You do know. We are here. This table and this."), (2, None)], "doc_id long, text string")
    parsed = X.closed_classes(docs)
    assert {r["pattern"]: r["n"] for r in X.auxiliary_patterns(parsed).collect()} == {"progressive": 1, "passive": 1, "perfect": 2, "other": 2, "modal_perfect": 1, "modal": 1, "do_emphasis": 1}
    got = {r["type"]: r["n"] for r in X.pronoun_types(parsed).collect()}
    assert got == {"personal": 8, "demonstrative": 1}
    row = X.topic_coherence(spark.createDataFrame([(1, "we saw Ann Lee and then Ann Lee, Bob Hall")], "doc_id long, text string")).first()
    assert (row["entities"], row["distinct"], row["coherence"], row["top"]) == (3, 2, 0.33, "Ann Lee 2; Bob Hall 1")


def test_offsets(spark):
    text = "  One here. Two?\nThree!  \n \nFour is it\n\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r["sentence_id"], r["sentence"], text[r["start"] : r["end"]]) for r in offsets.sentences(docs).orderBy("sentence_id").collect()]
    assert got == [(k, s, s) for k, s in enumerate(["One here.", "Two?", "Three!", "Four is it"], 1)]
    assert [(r["paragraph"], text[r["start"] : r["end"]].strip()) for r in offsets.paragraphs(docs).orderBy("paragraph").collect()] == [(0, "One here. Two?\nThree!"), (1, "Four is it")]
    assert [(r["paragraph"], r["first"], r["last"]) for r in offsets.paragraph_bounds(offsets.sentences(docs), offsets.paragraphs(docs)).orderBy("paragraph").collect()] == [(0, 1, 3), (1, 4, 4)]
    marked = "---\na: b\n---\n# Head\n> quote `code` [l](u) ![i](v)\n```js\n# x\n```\nend"
    row = spark.createDataFrame([(marked,)], "t string").select(offsets.blanked("t").alias("b"), offsets.protected_ranges("t").alias("r")).first()
    assert len(row["b"]) == len(marked) and row["b"].split() == ["quote", "l", "i", "end"] and all(marked.index(w) == row["b"].index(w) for w in ("quote", "end"))
    assert [marked[r["start"] : r["end"]] for r in row["r"]] == ["---\na: b\n---", "`code`", "```js\n# x\n```"]
    line = spark.createDataFrame([("ab\ncd\n" + "x" * 50,)], "t string").select(offsets.line_at(F.col("t"), F.lit(4)).alias("l"), offsets.context(F.col("t"), F.lit(3), F.lit(2)).alias("c")).first()
    assert (line["l"], line["c"]) == (2, "ab\\ncd\\n" + "x" * 29 + "...")


def test_corrections(spark):
    docs = spark.createDataFrame([(1, "teh cat `teh` sat  on"), (2, "same")], "doc_id long, text string")
    fixes = [(1, 0, 3, "TYPOS", ["the", "tea"]), (1, 9, 3, "TYPOS", ["the"]), (1, 17, 2, "WHITESPACE", [" "]), (1, 4, 3, "STYLE", ["dog"]), (1, 4, 3, "TYPOS", []), (1, 18, 3, "TYPOS", [" in"]), (1, 14, 3, "CASING", ["sat"])]
    got = {r["doc_id"]: (r["text"], r["applied"], r["skipped"]) for r in offsets.corrected(docs, spark.createDataFrame(fixes, "doc_id long, offset long, length long, category string, replacements array<string>")).collect()}
    assert got == {1: ("the cat `teh` sat  in", 2, 5), 2: ("same", 0, 0)}


def test_changes_are_logged(spark):
    docs = spark.createDataFrame([(1, "a\nthe the `the the` x -- y"), (2, "fine"), (3, None)], "doc_id long, text string")
    got = sorted((r["rule"], r["line"], r["before"], r["after"]) for r in editing.clean_changes(docs).collect())
    assert got == [("double_hyphen_to_em_dash", 2, " -- ", " — "), ("doubled_words", 2, "the the", "the")]


def test_names():
    assert resolve.snake("sixGramTTR") == "six_gram_ttr" and resolve.camel("em_dash") == "emDash"
    assert resolve.renamed({"aB": [{"cD": 1}]}, resolve.snake) == {"a_b": [{"c_d": 1}]}


def test_configurations(tmp_path):
    (tmp_path / "base.yaml").write_text("presets: [book]\nrules:\n  punctuation:\n    em_dash: {ai_threshold: 9}\n")
    (tmp_path / "own.yaml").write_text("presets: [base.yaml]\npublication: {media: blog}\nrules:\n  content:\n    cliche: {disabled: true}\n")
    found = resolve.resolve(str(tmp_path / "own.yaml"), presets=("academic",))
    rules = resolve.rules_of(found)
    assert rules.get("punctuation", "em_dash") == (9, 2.5) and rules.get("content", "cliche") is None and rules.get("content", "superlative") == (5.0, 2.0) and rules.get("structure", "bullet_density") is None
    (tmp_path / "a.yaml").write_text("presets: [b.yaml]")
    (tmp_path / "b.yaml").write_text("presets: [a.yaml]")
    for bad in (str(tmp_path / "a.yaml"), {"presets": ["blog", "blog"]}):
        with pytest.raises(ValueError, match="circular"):
            resolve.resolve(bad)
    assert resolve.merged({"a": {"b": 1}, "l": [1]}, {"a": {"b": None, "c": 2}, "l": [2]}) == {"a": {"b": None, "c": 2}, "l": [2]}
    assert resolve.merged({"a": 1}, {"a": None}, keep_null=False) == {"a": 1}
    assert resolve.resolve("technical") == {"publication": {"media": "technical"}} == {"publication": {"media": resolve.resolve('{"media": "technical"}')["publication"]["media"]}}
    assert resolve.resolve("no such")["publication"] == {"media": "unknown"} and "rules" in resolve.resolve("technical-book")
    assert resolve.session({"session": {"max_rounds": 2, "verbose": None}}) == {"max_rounds": 2, "success_mode": "any_flag", "confidence_threshold": 0.3, "preserve_structure": True, "preserve": [], "verbose": False}


def test_problems():
    config = {
        "style": {}, "publication": {"media": "tv", "era": 999, "platform": "web"},
        "rules": {"punctuation": {"emDash": {}, "em_dash": {"aiThreshold": 1, "ai_threshold": "x", "weight": 2, "disabled": 1, "odd": 0}, "nope": {}}, "magic": {}},
    }
    got = {(level, path) for level, path, _ in resolve.problems(config)}
    p = "rules.punctuation.em_dash"
    assert got == {
        ("error", "publication.media"), ("error", "publication.era"), ("error", f"{p}.ai_threshold"), ("error", f"{p}.disabled"), ("warning", "style"), ("warning", "rules.punctuation.emDash"), ("warning", f"{p}.aiThreshold"),
        ("warning", f"{p}.weight"), ("warning", f"{p}.odd"), ("warning", "rules.punctuation.nope"), ("warning", "rules.magic"),
    }
    assert resolve.problems({"publication": {"media": "blog", "era": 1850}}) == []


def test_default_rules_by_value():
    """Thresholds written out once more, not printed from the code."""
    want = """punctuation period_quote 97 85, punctuation oxford_comma 95 75, punctuation em_dash 2.5 1.5, punctuation semicolon_to_em_dash_ratio 0.5 1.5, punctuation parenthesis_to_em_dash_ratio 1.0 2.0,
        structure paragraph_fano_factor 0.5 1.2, structure bullet_density 3 1, structure transition_density 20 10, vocabulary ai_vocab_density 15 3, burstiness coefficient_of_variation 30 50, burstiness fano_factor 0.8 1.5,
        burstiness length_range 10 25, ngram six_gram_repetition_rate 0.3 0.1, ngram six_gram_ttr 0.3 0.8, ngram ai_pattern_count 2 0, content hedging 10 5, content cliche 2 0, content superlative 8 4, content filler 2 0,
        syntactic avg_dependency_depth 3.5 6.0, syntactic sentence_type_uniformity 0.7 0.5, perplexity perplexity 20 80, detectgpt d_score 2.0 0.5, fast_detectgpt probability 0.70 0.30, binoculars score 0.8536 1.2"""
    rules = resolve.rules_of({})
    listed = [x.split() for x in want.replace("\n", " ").split(",")]
    assert len(listed) == len(rules.rules) and all(rules.get(c, r) == (float(a), float(h)) for c, r, a, h in listed)


def test_analyze(spark):
    docs = spark.createDataFrame([(1, "We delve into a robust realm. We delve again, and delve—again—on. " * 5), (2, "Short.")], "doc_id long, text string")
    mine = lambda d: d.select("doc_id", F.lit("binoculars").alias("tool"), F.lit("likely_ai").alias("classification"), F.lit(0.9).alias("confidence"), F.array(F.lit("low score")).alias("signals"))
    rows = {r["doc_id"]: r for r in api.analyze(docs, "blog", scorers=(mine,)).collect()}
    assert rows[1]["tools"] == 8 and rows[1]["top_signals"][0] == "low score" and any(re.fullmatch(r"delve \(15x, severity: critical\)", s) for s in rows[1]["top_signals"])
    assert rows[2]["tools"] == 6 and set(rows) == {1, 2}  # too few words and sentences for two tools
    assert api.analyze(docs, fast=True).count() == 2
    report = {r["tool"]: r for r in api.category_report(verdicts.tool_rows(docs.where("doc_id = 1"), ("vocabulary", "structure"))).collect()}
    assert (report["vocabulary"]["score"], report["vocabulary"]["weight"], report["structure"]["weight"]) == (0.84, 0.15, 0.05) and report["vocabulary"]["key_signals"].startswith("delve (15x")

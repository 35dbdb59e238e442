"""Places, overlaps, baselines and trees against small cases and plain Python."""

import random

import pytest

from inkstat.operators import ngrams
from inkstat.operators import profiles as P

DOCS = "doc_id long, text string"


def test_places(spark):
    docs = spark.createDataFrame([(1, "Delve\u200b and delve; robust.\u200b\ufeff"), (2, ""), (3, None), (4, "delved")], DOCS)
    got = {(r["doc_id"], r["marker"]): (r["n"], r["positions"], r["severity"], r["contribution"]) for r in P.marker_positions(docs).collect()}
    assert got == {(1, "delve"): (2, [0, 11], "critical", 50.4), (1, "robust"): (1, [18], "high", 5.0)}
    assert {(r["doc_id"], r["name"]): r["positions"] for r in P.invisible_positions(docs).collect()} == {(1, "Zero-Width Space"): [5, 25], (1, "Byte Order Mark"): [26]}


def test_formulas(spark):
    long = "In conclusion, x. Whether you're " + "y" * 60 + " or z, it offers"
    got = {r["doc_id"]: (r["openings"], r["closings"]) for r in P.formulas(spark.createDataFrame([(1, long), (2, "discontinue it. When it comes to tea, tea is one of the most vital"), (3, None)], DOCS)).collect()}
    assert got == {1: ([], ["In conclusion,", ("Whether you're " + "y" * 60)[:50]]), 2: (["When it comes to", "tea is one of the most vital"], []), 3: ([], [])}


def test_overlap(spark):
    rows = [(1, "a b c d e f", "a b c d e x"), (2, "a b", "a b"), (3, None, "a b c"), (4, "a b c", None), (5, "a b c a b c", "a b c")]
    got = {r["doc_id"]: r for r in P.weighted_overlap(spark.createDataFrame(rows, "doc_id long, text string, other string")).collect()}
    assert [got[1][f"overlap_{n}"] for n in (3, 4, 5, 6)] == [0.75, 0.6667, 0.5, 0.0] and got[1]["jaccard_3"] == 0.6 and got[1]["aggregate"] == pytest.approx(0.3583, abs=1e-4)
    assert got[2]["aggregate"] is None and got[3]["aggregate"] is None and got[4]["aggregate"] == 0.0 and got[5]["overlap_3"] == pytest.approx(1 / 3, abs=1e-4)


def test_baseline(spark):
    docs = spark.createDataFrame([(1, "a b a b c d"), (2, "x y"), (3, "z"), (4, None)], DOCS)
    corpus = spark.createDataFrame([(7, "a b a b a"), (8, "c d")], DOCS)
    # own ranks: a b 0; b a, b c, c d share 2.  The corpus: a b and b a share 0.5; c d 2
    got = {r["doc_id"]: (r["grams"], r["in_vocabulary"], r["rank_divergence"]) for r in P.baseline(docs, corpus).collect()}
    assert ngrams.counted(docs, 2).where("doc_id = 1 and gram = 'b a'").first()["n"] == 1
    assert got == {1: (4, 0.75, 0.67), 2: (1, 0.0, None)}


def plain(heads: list[int], clause: list[bool]) -> tuple[float, float, int]:
    n = len(heads)
    if not n:
        return 0.0, 0.0, 0
    kids = {h: [i for i in range(n) if heads[i] == h and i != h] for h in range(n)}
    yngve, frazier = [], []
    for word in range(n):
        total, at = 0, word
        while heads[at] != at:
            total += len([k for k in kids[heads[at]] if k > at])
            at = heads[at]
        yngve.append(total)
        at, score = word, 0.0
        while True:
            score += 1.5 if clause[at] or heads[at] == at else 1.0
            if heads[at] == at or kids[heads[at]][0] != at:
                break
            at = heads[at]
        frazier.append(score)
    return sum(yngve) / n, max(sum(frazier[i : i + 3]) for i in range(max(1, n - 2))), sum(abs(i - h) for i, h in enumerate(heads))


def test_trees(spark):
    rng, rows, want = random.Random(7), [], {}
    for k in range(200):
        n = rng.choice([0, 1, 2, 3, 5, 9, 40])
        order = rng.sample(range(n), n)  # each token hangs on one drawn before it
        heads = [0] * n
        for i, token in enumerate(order):
            heads[token] = order[rng.randrange(i)] if i else token
        deps = [rng.choice(["dep", "advcl", None]) for _ in range(n)]
        rows.append((1, k, [("w", "w", "X", d, h) for d, h in zip(deps, heads)]))
        want[k] = plain(heads, [d == "advcl" for d in deps])
    parsed = spark.createDataFrame(rows, "doc_id long, sentence_id long, tokens array<struct<text:string,lemma:string,pos:string,dep:string,head:int>>")
    got = {r["sentence_id"]: (r["yngve"], r["frazier"], r["dependency_length"]) for r in P.tree_measures(parsed).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

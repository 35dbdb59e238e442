"""One table of awkward rows through every operator and stage: null and repeated ids, a text of over 3 MB, names that clash, nothing at all."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkstat.llm import chat, common, decontaminate, language_id, lm_score, packing, quality, simhash, tokens, urls

LONG = " ".join(f"word{i * 7919 % 5000}" for i in range(400_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
TEXTS = [(None, BASE), (None, BASE), (None, "plain other words in a row of their own"), (4, LONG), (4, BASE + " and more"), (4, None), (5, ""), (5, LONG), (6, "der die das und ein haus"), (7, "<|endoftext|>"), (None, None)]
CLASHES = {"score": 0.5, "predicted": 1, "lang_pred": "x", "bits": 2.0, "__words": 3, "__spans": None, "__items": "i", "__row": 9, "__id": 1, "row": 2, "key": "k", "n": 7, "train": True, "rid": 1, "__in_0": "z", "held_out": False, "fp": 1}
KINDS = {"score": "double", "predicted": "int", "lang_pred": "string", "bits": "double", "__words": "long", "__spans": "string", "__items": "string", "__row": "long", "__id": "long", "row": "long", "key": "string", "n": "long", "train": "boolean", "rid": "long", "__in_0": "string", "held_out": "boolean", "fp": "long"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` {KINDS[c]}" for c in CLASHES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "de" if t and t.startswith("der") else None if i is None else "en", None, None, *CLASHES.values()) for i, t in TEXTS]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/none.parquet")
    spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None), (6, 1)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, BASE), (None, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


@pytest.fixture(scope="module")
def docs(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet").cache()


@pytest.fixture(scope="module")
def none(spark, tables):
    return spark.read.parquet(f"{tables}/none.parquet")


def by_text(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows.collect()), key=str)


def test_marks(spark, tables, docs, none):
    bench = spark.read.parquet(f"{tables}/benchmark.parquet")
    rows = decontaminate.mark(docs, bench)
    assert rows.columns == [c for c in docs.columns if not c.startswith("__") or c in ("__row", "__id", "__in_0")] + ["__words", "__spans", "__items"]
    got = rows.select(F.length("text").alias("size"), "score", "__row", "__words", decontaminate.n_hit().alias("hit"), "__items").collect()
    assert len(got) == len(TEXTS) and all((r["score"], r["__row"]) == (0.5, 9) for r in got)
    assert sorted((r["__words"], r["hit"]) for r in got) == sorted([(14, 14), (14, 14), (16, 14), (9, 0), (400_000, 0), (400_000, 0), (0, 0), (0, 0), (0, 0), (6, 0), (1, 0)])
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(TEXTS) - 3 and left.where("__words = 3 and __items = 'i'").count() == len(TEXTS) - 3
    assert decontaminate.drop_contaminated(none, bench).count() == 0


def test_language_and_quality(spark, tables, docs, none):
    for given in (docs, none):
        langs, models = language_id.fit(given, F.lit(True))
        rows = language_id.identify(given, langs, models)
        assert rows.columns == [c for c in docs.columns if c not in ("lang_pred", "score", "bits")] + ["lang_pred", "score", "bits"]
        assert rows.count() == given.count() and rows.where("text is null and lang_pred != 'und'").count() == 0
        model = quality.fit(given, spark.read.parquet(f"{tables}/labels.parquet"), F.lit(True))
        rows = quality.scored(given, model)
        assert rows.columns == [c for c in docs.columns if c not in ("score", "predicted")] + ["score", "predicted"]
        assert rows.where("score between 0 and 1").count() == given.count()
        kept = quality.scored(given, model, least=0.0)
        assert kept.columns == docs.columns and kept.where("score = 0.5").count() == given.count()


def test_scores(docs, none):
    rows = lm_score.score(docs, lm_score.remainder("doc_id", 7) != 2, nodes=100, head=50)
    got = rows.collect()
    assert len(got) == len(TEXTS) and {r["n_tokens"] for r in got} == {15, 10, 400_001, 17, 1, 7, 2} and all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert len({(r["score"], r["n_tokens"]) for r in got if r["n_tokens"] == 15}) == 1
    assert lm_score.score(none, F.lit(True)).count() == 0


def test_tokens_and_packing(spark, docs, none, tmp_path):
    tokens.write_tokens(tokens.encode_sorted(docs), str(tmp_path / "t"))
    rows = tokens.with_starts(spark, str(tmp_path / "t"), tokens.digest(tokens.read_tokens(spark, str(tmp_path / "t")))).collect()
    rows.sort(key=lambda r: r["start"])
    assert len(rows) == len(TEXTS) and [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]
    assert [r["doc_id"] for r in rows] == [None] * 4 + [4, 4, 4, 5, 5, 6, 7]
    pieces = packing.pack(docs).collect()
    assert sum(r["length"] for r in pieces) == sum(r["n_tokens"] for r in rows) and sum(r["length"] == r["doc_tokens"] == 1 for r in pieces) == 3
    places = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        size = sum(n for _, n in own)
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and size <= 2048 and size & (size - 1) == 0
    assert packing.pack(none).count() == 0


def test_near_duplicates(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("__row = 9 and fp = 1").count() == kept.count()
    assert by_text(kept.select("doc_id", F.substring("text", 1, 8).alias("text")), "doc_id", "text") == sorted([(None, BASE[:8]), (None, "plain ot"), (4, LONG[:8]), (4, BASE[:8]), (4, None), (6, "der die "), (7, "<|endoft")], key=str)
    assert simhash.near_duplicates(docs).count() == len(TEXTS) and simhash.keep_one(none).count() == 0


def test_pages_and_turns(spark):
    pages = spark.createDataFrame([(None, "http://a.com/en/1", "h"), (1, None, "r"), (1, "http://a.com/" + "x/" * 3000, "t"), (1, "http://a.com/" + "y" * 3_000_000, "t")], "page_id long, url string, template string")
    rows = urls.judge(pages).collect()
    assert sorted((str(r["page_id"]), r["host"], r["verdict"]) for r in rows) == sorted([("None", "a.com", "block"), ("1", "", "allow"), ("1", "a.com", "allow"), ("1", "a.com", "allow")])
    assert urls.judge(pages.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", LONG, 5, 6), (1, 1, "user", LONG, 5, 6), (2, 0, "user", LONG, 5, 6)], "conv_id long, turn long, role string, text string, chunk long, place long")
    rows = chat.numbered(turns)
    got = chat.render(rows, chat.maximal(rows)).collect()
    assert [(r["conv_id"], r["n_turns"], len(r["chat"])) for r in got] == [(1, 2, 2 * len(LONG) + 2 * len("<|user|>\n<|end|>\n"))]


@pytest.mark.parametrize("table", ["documents", "none"])
def test_stages(spark, tables, tmp_path, table):
    docs = spark.read.parquet(f"{tables}/{table}.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, tables).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.schema.simpleString() == before.schema.simpleString()
            assert docs.exceptAll(before).count() == 0


def test_staged_tables_go(spark, tables, tmp_path):
    for t in ("documents", "benchmark"):
        os.symlink(f"{tables}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.createDataFrame([(4, 1), (6, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    before = len(common.staged_since())
    rows = corpus_pipeline.run(spark, str(tmp_path))
    left = common.staged_since(before)
    assert len(left) < 6 and rows.count() > 0 and all(os.path.isdir(p.removeprefix("file://")) for p in left)

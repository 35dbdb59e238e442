"""Dispersions that lie on a threshold fall to the same side as in the SQL."""

import duckdb
import pytest

from inkstat.catalogue import ORACLE_SQL, QUERIES

SENTENCES = {8: [7, 3, 2, 4, 4, 6], 16: [7, 3, 10, 6, 3], 24: [1, 1, 2, 5, 5], 40: [2, 3, 7, 4, 4, 6]}  # variance to mean 4/5, 3/2, 3/2, 4/5
PARAGRAPHS = [15] + 15 * [31]  # variance to mean 1/2


def texts():
    for doc_id, sizes in SENTENCES.items():
        yield doc_id, " ".join("bo " * (n - 1) + "bo." for n in sizes)
    head, tail = "In today's digital age we go on".split(), "In conclusion we go on".split()
    parts = [["bo"] * n for n in PARAGRAPHS]
    parts[0][: len(head)], parts[-1][: len(tail)] = head, tail
    yield 32, "\n".join(" ".join(p) for p in parts)


@pytest.mark.parametrize("name", ["burstiness_verdict", "category_report", "fast_ensemble", "only_filter", "fast_ensemble_sane"])
def test_threshold(spark, tmp_path, name):
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts()], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))

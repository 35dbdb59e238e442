"""Queries of score tables; a stand-in for a model scores by lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scores as C
from . import sql as S


def register(add, rounded) -> None:
    sentences = lambda d: d.select("doc_id", F.explode_outer(C.naive_sentences(F.col("text"))).alias("s")).where("s is not null").select("doc_id", (F.length("s") % 97 + 3).cast("double").alias("perplexity"))
    documents = lambda d: d.select("doc_id", F.when(F.length(F.trim("text")) >= 50, F.length("text") % 113 + 2).cast("double").alias("perplexity"))
    sql = f""", sp AS (SELECT doc_id, CAST(length(s) % 97 + 3 AS DOUBLE) AS p FROM (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {S.strip('x')}), lambda x: len(regexp_split_to_array(x, '\\s+')) >= 3)) AS s FROM docs)),
        g AS (SELECT doc_id, count(*) AS scored, avg(p) AS m, stddev_pop(p) AS s, min(p) AS lo, max(p) AS hi, stddev_samp(p) AS burstiness FROM sp GROUP BY doc_id),
        r AS (SELECT d.doc_id, perplexity, coalesce(scored, 0) AS scored, coalesce(m, perplexity) AS mean, coalesce(s, 0.0) AS deviation, coalesce(lo, perplexity) AS least, coalesce(hi, perplexity) AS most, burstiness
            FROM (SELECT doc_id, CASE WHEN length(trim(text)) >= 50 THEN CAST(length(text) % 113 + 2 AS DOUBLE) END AS perplexity FROM docs) d LEFT JOIN g USING (doc_id)),
        v AS (SELECT *, CASE WHEN mean > 0 THEN deviation / mean ELSE 0.0 END AS cv FROM r)"""
    doubles = ["perplexity", "mean", "deviation", "least", "most", "burstiness", "cv"]
    add(
        "perplexity_statistics",
        lambda d: rounded(C.perplexity_measures(documents(d), sentences(d)).select("doc_id", "scored", "flat", *doubles)),
        f"{sql} SELECT doc_id, scored, cv < 0.2 AS flat, {', '.join(f'round({n}, 6) AS {n}' for n in doubles)} FROM v",
    )
    add(
        "perplexity_verdict",
        lambda d: rounded(C.perplexity_verdict(C.perplexity_measures(documents(d), sentences(d))).select("doc_id", "classification", "confidence")),
        f"""{sql} SELECT doc_id, CASE WHEN perplexity IS NULL THEN 'error' WHEN perplexity < 20 AND (cv < 0.2 OR mean < 15) THEN 'likely_ai' WHEN perplexity > 50 AND cv > 0.3 THEN 'likely_human' ELSE 'uncertain' END AS classification,
        CAST(CASE WHEN perplexity IS NULL THEN 0.0 WHEN perplexity < 20 AND (cv < 0.2 OR mean < 15) THEN CASE WHEN perplexity < 10 THEN 0.9 WHEN perplexity < 15 THEN 0.75 ELSE 0.6 END
        WHEN perplexity > 50 AND cv > 0.3 THEN CASE WHEN perplexity > 85 THEN 0.9 WHEN perplexity > 70 THEN 0.75 ELSE 0.6 END ELSE 0.5 END AS DOUBLE) AS confidence FROM v""",
    )

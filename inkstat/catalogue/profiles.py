"""Queries of places, overlaps, baseline corpora and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import alternatives
from ..operators import ngrams
from ..operators import profiles as P
from ..operators import syntax as X
from . import sql as S
from .syntax import parse

_TAIL = "a\u200bb\u202f\u200b\ufeff"


def _places(text: str, pattern: str) -> str:
    """Text cut around each match: even pieces are matches."""
    cut = f"string_split(regexp_replace({text}, {S.q(pattern)}, chr(3) || '\\1' || chr(3), 'g'), chr(3))"
    return f"""(SELECT doc_id, lower(piece) AS found, s FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT doc_id, unnest(generate_series(1, len(l))) AS i, unnest(l) AS piece FROM (SELECT doc_id, {cut} AS l FROM docs))) WHERE i % 2 = 0)"""


_at = lambda name: f"{name}, count(*) AS n, string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR), ',' ORDER BY s) AS positions"
_multiplier = "CASE found " + " ".join(f"WHEN {S.q(k)} THEN {m}" for k, (m, _) in L.MARKERS.items()) + " END"
_severity = "CASE found " + " ".join(f"WHEN {S.q(k)} THEN {S.q(s)}" for k, (_, s) in L.MARKERS.items()) + " END"
_names = "CASE found " + " ".join(f"WHEN chr({ord(k)}) THEN {S.q(v)}" for k, v in P.INVISIBLE.items()) + " END"
_matches = lambda ps: "array_to_string(list_filter([" + ", ".join(f"left(regexp_extract(text, {S.q('(?i)\\b' + p)}), 50)" for p in ps) + "], lambda x: x <> ''), ' | ')"
_cut = lambda text: f"regexp_extract_all(lower({text}), {S.q(ngrams.TOKEN)})"

_BASELINE = f""", w AS (SELECT doc_id, lang, {_cut('text')} AS t FROM docs),
    g AS (SELECT doc_id, lang, unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM w),
    own AS (SELECT doc_id, gram, count(*) AS c FROM g GROUP BY ALL),
    ranked AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY c DESC) - 1 + (count(*) OVER (PARTITION BY doc_id, c) - 1) / 2.0 AS r FROM own),
    base AS (SELECT gram, rank() OVER (ORDER BY c DESC) - 1 + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS b FROM (SELECT gram, count(*) AS c FROM g WHERE lang = 'en' GROUP BY gram))
    SELECT doc_id, count(*) AS grams, round(count(b) * 1.0 / count(*), 4) AS in_vocabulary, round(avg(abs(r - b)), 2) AS rank_divergence FROM ranked LEFT JOIN base USING (gram) GROUP BY doc_id"""


def register(add, table: str) -> None:
    shown = lambda rows: rows.withColumn("positions", F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))))
    add(
        "marker_positions",
        lambda d: shown(P.marker_positions(d)).withColumn("contribution", F.round("contribution", 4)),
        f"SELECT doc_id, {_at('found AS marker')}, CAST({_multiplier} AS DOUBLE) AS multiplier, {_severity} AS severity, round(CAST(count(*) * {_multiplier} AS DOUBLE), 4) AS contribution FROM {_places('text', '(?i)\\b' + alternatives(L.MARKERS) + '\\b')} GROUP BY doc_id, found",
    )
    add(
        "invisible_positions",
        lambda d: shown(P.invisible_positions(d.withColumn("text", F.concat("text", F.lit(_TAIL))))),
        f"SELECT doc_id, {_at(_names + ' AS name')} FROM {_places('text || ' + S.q(_TAIL), '([' + ''.join(P.INVISIBLE) + '])')} GROUP BY doc_id, found",
    )
    joined = lambda c: F.concat_ws(" | ", c).alias(c)
    add("formula_texts", lambda d: P.formulas(d).select("doc_id", joined("openings"), joined("closings")), f"SELECT doc_id, {_matches(L.OPENINGS)} AS openings, {_matches(L.CLOSINGS)} AS closings FROM docs")
    add("weighted_overlap", lambda d: P.weighted_overlap(d.withColumn("other", F.replace("text", F.lit(" the "), F.lit(" a ")))))
    add("baseline_bigrams", lambda d: P.baseline(d, d.where("lang = 'en'"), 2), _BASELINE)
    add("hapax_top4", lambda d: ngrams.top(d, 1, 4), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS rank FROM (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest({_cut('text')}) AS gram FROM docs) GROUP BY ALL)) WHERE rank <= 4")
    add("tree_measures", lambda d: P.tree_measures(X.closed_classes(d)).select("doc_id", "sentence_id", F.round("yngve", 4).alias("yngve"), "frazier", "dependency_length"))
    add(
        "dependency_length",
        lambda d: P.tree_measures(X.closed_classes(d)).groupBy("doc_id").agg(F.sum("dependency_length").alias("total"), F.max("dependency_length").alias("longest")),
        f""", {parse(table)}, h AS (SELECT doc_id, sentence_id, i - coalesce(max(CASE WHEN pos = 'SCONJ' AND i > 1 THEN i END) OVER (PARTITION BY doc_id, sentence_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS d FROM pos),
        l AS (SELECT doc_id, sentence_id, CAST(sum(d) AS BIGINT) AS d FROM h GROUP BY ALL) SELECT doc_id, CAST(sum(d) AS BIGINT) AS total, max(d) AS longest FROM l GROUP BY doc_id""",
    )

"""Queries of the analyses of parsed sentences, over the rule-based parse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import syntax as X
from . import sql as S

_in = lambda terms: "(" + ", ".join(map(S.q, terms)) + ")"
_lemma = "CASE lw " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in X.AUXILIARIES.items()) + " ELSE lw END"
_pct = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} * 100.0 / {b}, 2) ELSE 0.0 END"


def parse(table: str) -> str:
    return f"""
    tok AS (SELECT *, lower(w) AS lw FROM (SELECT doc_id, sentence_id, paragraph, generate_subscripts(r, 1) AS i, unnest(r) AS w FROM (SELECT doc_id, sentence_id, paragraph, regexp_extract_all(sentence, {S.q(X.TOKEN)}) AS r FROM ({table})))),
    pos AS (SELECT *, CASE WHEN NOT regexp_matches(w, '[A-Za-z]') THEN 'PUNCT' WHEN lw IN {_in(X.AUXILIARIES)} THEN 'AUX' WHEN lw IN {_in(X.PRONOUNS)} THEN 'PRON' WHEN lw IN {_in(X.COORDINATORS)} THEN 'CCONJ'
            WHEN lw IN {_in(X.SUBORDINATORS)} THEN 'SCONJ' WHEN length(w) >= 5 THEN 'NOUN' ELSE 'X' END AS pos FROM tok),
    raw AS (SELECT doc_id, sentence_id, paragraph, count(*) AS tokens_all, count(*) FILTER (pos <> 'PUNCT') AS words, count(*) FILTER (pos = 'AUX') AS aux, count(*) FILTER (pos = 'PRON') AS pronouns, count(*) FILTER (pos = 'NOUN') AS nouns,
            count(*) FILTER (lw IN {_in(X.VAGUE)}) AS vague, count(*) FILTER (pos = 'SCONJ') AS clauses, count(*) FILTER (pos = 'CCONJ') AS coordinations, count(*) FILTER (pos = 'SCONJ' AND i > 1) AS k,
            coalesce(max(i) FILTER (pos = 'SCONJ' AND i > 1), 0) AS opened, arg_min(string_split(lw, '''')[1], i) IN {_in(X.PRONOUNS)} AS opens_with_pronoun FROM pos GROUP BY ALL),
    sent AS (SELECT *, CASE WHEN tokens_all = 1 THEN 0 ELSE k + CASE WHEN opened = tokens_all THEN 0 ELSE 1 END END AS depth, {_pct('aux', 'words')} AS aux_share, {_pct('pronouns', 'words')} AS pronoun_share, {_pct('nouns', 'words')} AS noun_share,
            CASE WHEN clauses > 0 AND coordinations > 0 THEN 'compound_complex' WHEN clauses > 0 THEN 'complex' WHEN coordinations > 0 THEN 'compound' ELSE 'simple' END AS kind FROM raw),
    doc AS (SELECT doc_id, count(*) AS sentences, sum(words) AS words, sum(aux) AS aux, sum(pronouns) AS pronouns, sum(nouns) AS nouns, count(*) FILTER (kind = 'simple') AS simple, count(*) FILTER (kind = 'compound_complex') AS n_both, avg(depth) AS depth_mean, max(depth) AS depth_max,
            coalesce(var_samp(depth), 0.0) AS depth_variance, avg(tokens_all) AS length_mean, coalesce(stddev_samp(tokens_all), 0.0) AS length_deviation, sum(clauses) AS clauses FROM sent GROUP BY doc_id),
    docm AS (SELECT *, round(n_both * 1.0 / sentences, 4) AS compound_complex_ratio, {_pct('aux', 'words')} AS aux_share, {_pct('pronouns', 'words')} AS pronoun_share, {_pct('nouns', 'words')} AS noun_share,
            round(clauses * 1.0 / sentences, 2) AS clauses_per_sentence, round(greatest(0.0, least(1.0, 1 - length_deviation / length_mean)), 3) AS uniformity FROM doc)"""


_DOUBLES = ["depth_mean", "depth_variance", "length_mean", "length_deviation", "compound_complex_ratio", "aux_share", "pronoun_share", "noun_share", "clauses_per_sentence", "uniformity"]
_points = (
    "(CASE WHEN compound_complex_ratio < 0.05 THEN 25 WHEN compound_complex_ratio > 0.15 THEN -15 ELSE 0 END + CASE WHEN depth_variance < 1 THEN 25 WHEN depth_variance > 2 THEN -15 ELSE 0 END"
    " + CASE WHEN depth_mean < 3.5 THEN 20 ELSE 0 END + CASE WHEN aux_share > 5.5 THEN 15 ELSE 0 END + CASE WHEN uniformity > 0.7 THEN 15 ELSE 0 END)"
)

VERDICT = f"SELECT doc_id, CASE WHEN p > 30 THEN 'likely_ai' WHEN p < -30 THEN 'likely_human' ELSE 'uncertain' END AS classification, round(CAST(abs(p) / 100.0 AS DOUBLE), 6) AS confidence FROM (SELECT doc_id, {_points} AS p FROM docm)"


_FLAGS = ["compound_complex_ratio < 0.05", "depth_variance < 1", "depth_mean < 3.5", "uniformity > 0.7", "aux_share > 5.5", "noun_share < 18", "pronoun_share > 7"]
SIGNALS = VERDICT.replace(" AS confidence FROM (SELECT doc_id,", f" AS confidence, {S.named(_FLAGS, X.SIGNALS)} AS signals FROM (SELECT *,")


def register(add, rounded, table: str) -> None:
    parts = ", " + parse(table)
    sentences = lambda d: X.sentence_measures(X.closed_classes(d))
    documents = lambda d: X.document_measures(sentences(d))
    names = ["sentences", "words", "aux", "pronouns", "nouns", "simple", "depth_max"]
    add(
        "syntactic_metrics",
        lambda d: rounded(documents(d).select("doc_id", *names, *_DOUBLES)),
        f"{parts} SELECT doc_id, {', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in names)}, {', '.join(f'round(CAST({n} AS DOUBLE), 6) AS {n}' for n in _DOUBLES)} FROM docm",
    )
    add(
        "syntactic_verdict",
        lambda d: rounded(X.verdict(documents(d)).select("doc_id", "classification", "confidence")),
        f"{parts} {VERDICT}",
    )
    add("pos_distribution", lambda d: X.pos_shares(X.closed_classes(d)), f"{parts} SELECT doc_id, pos, CAST(round(n * 100.0 / sum(n) OVER (PARTITION BY doc_id), 2) AS DOUBLE) AS share FROM (SELECT doc_id, pos, count(*) AS n FROM pos WHERE pos <> 'PUNCT' GROUP BY doc_id, pos)")
    add("auxiliary_lemmas", lambda d: rounded(X.top_auxiliaries(X.closed_classes(d))), f"{parts} SELECT * FROM (SELECT doc_id, lemma, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lemma) AS rank FROM (SELECT doc_id, {_lemma} AS lemma, count(*) AS n FROM pos WHERE pos = 'AUX' GROUP BY 1, 2)) WHERE rank <= 5")
    add(
        "auxiliary_flags",
        lambda d: rounded(X.auxiliary_flags(sentences(d))),
        f"""{parts}, c AS (SELECT s.*, d.aux_share AS doc_aux, floor(d.aux - 3.0 / 100 * d.words + 0.5) AS excess, row_number() OVER w AS place, sum(least(s.aux, 2)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM sent s JOIN docm d USING (doc_id) WHERE d.aux_share > 3 AND s.aux > 0 WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.aux DESC, s.aux_share DESC, s.sentence_id))
        SELECT doc_id, sentence_id, aux, CAST(aux_share AS DOUBLE) AS aux_share, CASE WHEN aux_share > 15 OR aux >= 4 THEN 'critical' WHEN aux_share > 10 OR aux >= 3 THEN 'high' WHEN aux_share > doc_aux * 1.5 OR aux >= 2 THEN 'medium' ELSE 'low' END AS priority, place
        FROM c WHERE place = 1 OR before < excess""",
    )
    add(
        "noun_flags",
        lambda d: rounded(X.noun_flags(sentences(d), 60.0)),
        f"""{parts}, g AS (SELECT s.*, d.words AS dw, d.nouns AS dn, CASE WHEN s.noun_share < 10 AND s.pronoun_share > 15 THEN 'low_noun_high_pronoun' WHEN s.noun_share < 10 AND s.aux_share > 10 THEN 'low_noun_high_aux' WHEN s.vague > 0 THEN 'vague_references'
            WHEN s.noun_share < d.noun_share * 0.7 THEN 'low_noun_general' END AS issue FROM sent s JOIN docm d USING (doc_id) WHERE d.noun_share < 60 AND s.words >= 4 AND s.noun_share < 60),
        h AS (SELECT *, CASE WHEN issue LIKE 'low_noun_high%' THEN 1 WHEN issue = 'vague_references' THEN CASE WHEN vague >= 2 THEN 2 ELSE 3 END WHEN noun_share < 8 THEN 2 ELSE 3 END AS grade FROM g WHERE issue IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY grade, noun_share, sentence_id) AS place FROM h)
        SELECT doc_id, sentence_id, issue, ['critical', 'high', 'medium', 'low'][grade] AS priority, CAST(noun_share AS DOUBLE) AS noun_share, place FROM o WHERE place = 1 OR (place - 1) * 2 < floor(60.0 / 100 * dw - dn + 0.5)""",
    )
    add(
        "pronoun_targets",
        lambda d: rounded(X.pronoun_targets(sentences(d)).drop("doc_pronouns").fillna(0, ["antecedent"])),
        f"""{parts}, t AS (SELECT s.* FROM sent s JOIN docm d USING (doc_id) WHERE s.pronoun_share > d.pronoun_share * 1.5 OR s.pronouns >= 2 OR s.opens_with_pronoun)
        SELECT t.doc_id, t.sentence_id, any_value(t.pronouns) AS pronouns, CAST(any_value(t.pronoun_share) AS DOUBLE) AS pronoun_share, CASE WHEN max(b.nouns) > 0 THEN arg_max(b.sentence_id, b.nouns * 1000000000 + b.sentence_id) ELSE t.sentence_id - 1 END AS antecedent
        FROM t LEFT JOIN sent b ON b.doc_id = t.doc_id AND b.sentence_id BETWEEN t.sentence_id - 3 AND t.sentence_id - 1 AND b.paragraph >= t.paragraph - 1 GROUP BY t.doc_id, t.sentence_id""",
    )
    add("pronoun_groups", lambda d: X.pronoun_groups(X.pronoun_targets(sentences(d))).select("doc_id", "group_id", F.concat_ws(",", "members").alias("members")))
    add(
        "pronoun_types",
        lambda d: X.pronoun_types(X.closed_classes(d)),
        f"""{parts}, x AS (SELECT doc_id, CASE WHEN lw IN {_in(X.TYPES['demonstrative'])} THEN CASE WHEN coalesce(lead(pos) OVER w, '') <> 'NOUN' THEN 'demonstrative' END WHEN lw IN {_in(X.TYPES['possessive'])} THEN 'possessive'
            WHEN lw IN {_in(X.TYPES['relative'])} THEN 'relative' WHEN lw IN {_in(X.INDEFINITE)} THEN 'indefinite' WHEN pos = 'PRON' THEN 'personal' END AS type FROM pos WINDOW w AS (PARTITION BY doc_id, sentence_id ORDER BY i))
        SELECT doc_id, type, count(*) AS n FROM x WHERE type IS NOT NULL GROUP BY doc_id, type""",
    )
    add(
        "auxiliary_patterns",
        lambda d: X.auxiliary_patterns(X.closed_classes(d)),
        f"""{parts}, x AS (SELECT doc_id, pos, {_lemma} AS lemma, coalesce(lead(lw) OVER w, '') AS l1, coalesce(lead(lw, 2) OVER w, '') AS l2 FROM pos WINDOW w AS (PARTITION BY doc_id, sentence_id ORDER BY i)),
        y AS (SELECT doc_id, CASE WHEN lemma = 'be' THEN CASE WHEN regexp_matches(l1, '^[a-z]+ing$') THEN 'progressive' WHEN regexp_matches(l1, '^[a-z]+(ed|en)$') THEN 'passive' ELSE 'other' END
            WHEN lemma = 'have' THEN CASE WHEN regexp_matches(l1, '^[a-z]+(ed|en)$') THEN 'perfect' ELSE 'other' END WHEN lemma = 'do' THEN 'do_emphasis'
            WHEN l1 IN ('have', 'has', 'had') AND regexp_matches(l2, '^[a-z]+(ed|en)$') THEN 'modal_perfect' ELSE 'modal' END AS pattern FROM x WHERE pos = 'AUX')
        SELECT doc_id, pattern, count(*) AS n FROM y GROUP BY doc_id, pattern""",
    )
    add(
        "topic_coherence",
        lambda d: X.topic_coherence(d),
        f"""SELECT doc_id, CAST(len(e) AS BIGINT) AS entities, CAST(len(d) AS BIGINT) AS "distinct", CASE WHEN len(e) > 0 THEN round(1 - CAST(len(d) AS DOUBLE) / len(e), 2) ELSE 0.0 END AS coherence,
        array_to_string(list_transform(list_sort(list_transform(d, lambda w: {{'n': -len(list_filter(e, lambda x: x = w)), 'w': w}}))[1:5], lambda r: r.w || ' ' || (-r.n)), '; ') AS top
        FROM (SELECT doc_id, e, list_distinct(e) AS d FROM (SELECT doc_id, regexp_extract_all(text, {S.q(X.ENTITY)}, 1) AS e FROM docs))""",
    )
    add("structure_flags", lambda d: rounded(X.structure_flags(sentences(d))))

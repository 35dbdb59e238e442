"""The query of punctuation issues."""

from __future__ import annotations

from ..operators import dashes as D
from . import sql as S

_points = " + ".join(["CASE WHEN n >= 15 THEN 1 ELSE 0 END", "CASE WHEN n >= 25 THEN 1 ELSE 0 END", *(f"CASE WHEN n >= {least} AND regexp_matches(s, {S.q(p)}) THEN {v} ELSE 0 END" for v, p, least in D.FIT)])
_SQL = f"""
    , par AS (SELECT doc_id, all_words, unnest(generate_series(0, len(ps) - 1)) AS paragraph, unnest(ps) AS text FROM (SELECT doc_id, len({S.WORDS}) AS all_words, {S.PARAGRAPHS} AS ps FROM docs)),
    sen AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, i) AS sentence_id, len(regexp_split_to_array(s, '\\s+')) AS n FROM (SELECT doc_id, all_words, paragraph, unnest(generate_series(1, len(l))) AS i, unnest(l) AS s FROM (SELECT doc_id, all_words, paragraph, {S.SENTENCES} AS l FROM par))),
    m AS (SELECT *, sum(dashes) OVER d AS ad, count(*) FILTER (semicolon) OVER d AS asemi, count(*) FILTER (dashes > 1) OVER d AS several FROM (SELECT doc_id, sentence_id, paragraph, {S.cnt('—', 's')} AS dashes, contains(s, ';') AS semicolon,
          length(s) > 50 AND regexp_matches(s, {S.q(D.JOINED)}) AS joined, CASE WHEN n < 8 THEN 0 ELSE {_points} END AS fit, all_words FROM sen) WINDOW d AS (PARTITION BY doc_id)),
    dn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(dashes = 1 AS INTEGER), sentence_id) AS place, row_number() OVER (PARTITION BY doc_id ORDER BY sentence_id) AS first FROM m WHERE dashes > 0),
    rk AS (SELECT *, least(2, row_number() OVER (PARTITION BY doc_id, paragraph ORDER BY fit DESC, sentence_id)) AS turn FROM m WHERE ad * 1000.0 / all_words < 1 AND all_words > 500 AND dashes = 0 AND NOT semicolon AND fit > 0),
    rp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY turn, fit DESC, sentence_id) AS place FROM rk),
    hd AS (SELECT doc_id, paragraph, count(*) AS n FROM dn GROUP BY ALL)
    SELECT doc_id, 'em_dash_density' AS issue, sentence_id FROM dn WHERE ad * 1000.0 / all_words > 1.5 AND place <= greatest(ad - floor(1.5 * all_words / 1000), several)
    UNION ALL SELECT doc_id, 'em_dash_semicolon_ratio', sentence_id FROM dn WHERE asemi = 0 AND first <= 3
    UNION ALL SELECT doc_id, 'low_em_dash_density', sentence_id FROM rp WHERE place <= greatest(ceil(1.0 * all_words / 1000), ceil(0.75 * all_words / 1000)) - ad
    UNION ALL SELECT doc_id, 'low_semicolon_density', sentence_id FROM m WHERE asemi * 1000.0 / all_words < 2 AND all_words > 500 AND NOT semicolon AND joined
    UNION ALL SELECT dn.doc_id, 'em_dash_stacking', sentence_id FROM dn WHERE EXISTS (SELECT 1 FROM hd x JOIN hd y USING (doc_id) WHERE x.doc_id = dn.doc_id AND x.paragraph = dn.paragraph AND ((y.paragraph = x.paragraph + 1 AND x.n <= y.n) OR (y.paragraph = x.paragraph - 1 AND x.n < y.n)))"""


def register(add, rounded) -> None:
    add("punctuation_issues", lambda d: D.punctuation_issues(D.dash_sentences(d)), _SQL)

"""Queries of places in texts: paragraphs, sentences, protected ranges, lines, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editing
from ..operators import offsets as O
from . import sql as S


def _pieces(text: str) -> str:
    return f"""(SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT doc_id, unnest(generate_series(1, len(l))) AS i, unnest(l) AS piece FROM (SELECT doc_id, string_split({text}, chr(3)) AS l FROM docs)))"""


_BLANK = r"regexp_replace({}, '(\n\s*\n)', chr(3) || '\1' || chr(3), 'g')"
_PARAGRAPHS = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS paragraph, CAST(s AS BIGINT) AS s, CAST(s + length(piece) AS BIGINT) AS e FROM {_pieces(_BLANK.format('text'))} WHERE regexp_matches(piece, '\\S')"
_cut = _BLANK.format(r"regexp_replace(text, '([.!?])(\s+)', '\1' || chr(3) || '\2' || chr(3), 'g')")
_SENTENCES = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS sentence_id, CAST(s + length(regexp_extract(piece, '^\\s*')) AS BIGINT) AS s,
    CAST(s + length(regexp_extract(piece, '^\\s*')) + length({S.strip('piece')}) AS BIGINT) AS e, {S.strip('piece')} AS sentence FROM {_pieces(_cut)} WHERE regexp_matches(piece, '\\S')"""
_LINE = "len(regexp_extract_all(left(text, CAST({0} AS INTEGER)), chr(10))) + 1"
_CONTEXT = "CASE WHEN {0} > 30 THEN '...' ELSE '' END || replace(substring(text, CAST(greatest(0, {0} - 30) + 1 AS INTEGER), CAST(least(length(text), {0} + {1} + 30) - greatest(0, {0} - 30) AS INTEGER)), chr(10), '\\n') || CASE WHEN {0} + {1} + 30 < length(text) THEN '...' ELSE '' END"
_CATEGORIES = ["TYPOS", "STYLE", "CASING", "GRAMMAR"]


def _corrections(d):
    """A correction of each document's first and last ` the ` by a rule of its id; some unsafe, some without replacement."""
    category = F.element_at(F.array(*map(F.lit, _CATEGORIES)), (F.col("doc_id") % 4 + 1).cast("int"))
    other = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" a "), F.lit(" this ")))
    one = lambda at: d.where(at >= 0).select("doc_id", at.cast("long").alias("offset"), F.lit(5).cast("long").alias("length"), category.alias("category"), other.alias("replacements"))
    first = F.instr("text", " the ") - 1
    last = F.when(F.instr("text", " the ") > 0, F.length("text") - F.instr(F.reverse("text"), " eht ") - 4)
    return one(first).unionByName(one(last)).distinct()


_FIXES = f"""fx AS (SELECT DISTINCT doc_id, o, ['TYPOS', 'STYLE', 'CASING', 'GRAMMAR'][doc_id % 4 + 1] AS category, CASE WHEN doc_id % 5 <> 0 THEN ' a ' END AS after, text
    FROM (SELECT doc_id, text, instr(text, ' the ') - 1 AS o FROM docs UNION ALL SELECT doc_id, text, length(text) - instr(reverse(text), ' eht ') - 4 FROM docs WHERE instr(text, ' the ') > 0) WHERE o >= 0),
    fy AS (SELECT *, category IN ('TYPOS', 'CASING') AND after IS NOT NULL AS fit, max(o) OVER (PARTITION BY doc_id) AS top FROM fx),
    fz AS (SELECT *, fit AND (o = top OR o + 5 <= top) AS applied FROM fy)"""


def register(add) -> None:
    add("paragraph_offsets", lambda d: O.paragraphs(d), f'SELECT doc_id, paragraph, s AS start, e AS "end" FROM ({_PARAGRAPHS})')
    add("sentence_offsets", lambda d: O.sentences(d), f'SELECT doc_id, sentence_id, s AS start, e AS "end", sentence FROM ({_SENTENCES})')
    add("paragraph_bounds", lambda d: O.paragraph_bounds(O.sentences(d), O.paragraphs(d)), f"SELECT p.doc_id, paragraph, min(sentence_id) AS first, max(sentence_id) AS last FROM ({_PARAGRAPHS}) p JOIN ({_SENTENCES}) s ON p.doc_id = s.doc_id AND s.s >= p.s AND s.s < p.e GROUP BY p.doc_id, paragraph")
    at = lambda: F.instr("text", ".") - 1
    add(
        "line_and_context",
        lambda d: d.where(at() >= 0).select("doc_id", O.line_at(F.col("text"), at()).alias("line"), O.context(F.col("text"), at(), F.lit(1)).alias("context")),
        f"SELECT doc_id, CAST({_LINE.format('o')} AS BIGINT) AS line, {_CONTEXT.format('o', '1')} AS context FROM (SELECT doc_id, text, instr(text, '.') - 1 AS o FROM docs) WHERE o >= 0",
    )
    fenced = lambda d: d.select("doc_id", F.concat(F.lit("---\na: b\n---\n# Head\n> see `code`, [label](to)\n"), "text").alias("text"))
    add(
        "protected_ranges",
        lambda d: fenced(d).select("doc_id", F.explode(O.protected_ranges("text")).alias("r")).select("doc_id", "r.start", "r.end"),
        "SELECT doc_id, unnest([0, 26]) AS start, unnest([12, 32]) AS \"end\" FROM docs",
    )
    add("blanked_text", lambda d: fenced(d).select("doc_id", O.blanked("text").alias("text")), r"SELECT doc_id, repeat(' ', 12) || chr(10) || repeat(' ', 6) || chr(10) || '  see       ,  label     ' || chr(10) || regexp_replace(text, '(?m)^# Head$', '      ', 'g') AS text FROM docs")
    add(
        "corrections_checked",
        lambda d: O.checked_corrections(d, _corrections(d)).select("doc_id", "offset", "category", "line", "before", "context", "applied"),
        f"WITH_ {_FIXES} SELECT doc_id, CAST(o AS BIGINT) AS \"offset\", category, CAST({_LINE.format('o')} AS BIGINT) AS line, ' the ' AS before, {_CONTEXT.format('o', '5')} AS context, applied FROM fz".replace("WITH_", ","),
    )
    add(
        "corrections_applied",
        lambda d: O.corrected(d, _corrections(d)),
        f""", {_FIXES}, fa AS (SELECT doc_id, count(*) FILTER (applied) AS applied, count(*) FILTER (NOT applied) AS skipped, min(o) FILTER (applied) AS lo, max(o) FILTER (applied) AS hi FROM fz GROUP BY doc_id)
        SELECT doc_id, CASE WHEN coalesce(applied, 0) = 0 THEN text WHEN lo = hi THEN left(text, CAST(lo AS INTEGER)) || ' a ' || substring(text, CAST(lo + 6 AS INTEGER))
            ELSE left(text, CAST(lo AS INTEGER)) || ' a ' || substring(text, CAST(lo + 6 AS INTEGER), CAST(hi - lo - 5 AS INTEGER)) || ' a ' || substring(text, CAST(hi + 6 AS INTEGER)) END AS text, coalesce(applied, 0) AS applied, coalesce(skipped, 0) AS skipped FROM docs LEFT JOIN fa USING (doc_id)""",
    )
    add("cleanup_changes", lambda d: editing.clean_changes(d).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents")))

"""The measures once more, as SQL that another engine runs on the same tables."""

from __future__ import annotations

from ..config.rules import DEFAULTS
from ..functions import lexicons as L
from ..functions.text import alternatives


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cnt(pattern: str, column: str = "text") -> str:
    return f"len(regexp_extract_all({column}, {q(pattern)}))"


def hits(terms) -> str:
    return f"list_transform(regexp_extract_all(text, {q('(?i)\\b' + alternatives(terms) + '\\b')}, 1), lambda x: lower(x))"


def per(n: str, words: str, scale: int) -> str:
    return f"CASE WHEN {words} > 0 THEN ({n}) * {scale}.0 / ({words}) ELSE 0.0 END"


#: Documents with doubled newlines and a sentence of markers by id, so that every measure has something to find.
MARKERS = {
    1: " We delve into a robust, crucial realm. Furthermore, it is vibrant.",
    2: " A note—short and another—here; (aside) done — yes.",
    3: ' Red, green, and blue. Red, green and blue. He said "yes." She said "no".',
    4: " Perhaps it could work, probably. At the end of the day, very truly, that being said, the most important thing.",
    5: "\n\n- one\n- two\n1. three\n# Head\nBody here.",
    6: " In conclusion, however, therefore, we continue. In today's digital age, when it comes to it.",
    7: " “Smart” and \"plain\" quotes… and dots... the the end.",
}
DOCS = (
    "docs AS (SELECT doc_id, lang, source, replace(text, chr(10), chr(10) || chr(10)) || CASE doc_id % 8 "
    + " ".join(f"WHEN {k} THEN " + q(v).replace("\n", "' || chr(10) || '") for k, v in MARKERS.items())
    + " ELSE '' END AS text FROM documents)"
)

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
PARAGRAPHS = r"list_filter(regexp_split_to_array(text, '\n\n+'), lambda p: trim(translate(p, chr(10) || chr(9) || chr(13), '   ')) <> '')"
SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(translate(s, chr(10) || chr(9) || chr(13), '   ')) <> '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


VOCABULARY = {
    "found": hits(L.MARKERS),
    "words": r"len(regexp_split_to_array(lower(text), '\s+'))",
    "flags": f"len({hits(L.MARKERS)})",
    "critical": f"len({hits([t for t, (_, s) in L.MARKERS.items() if s == 'critical'])})",
    "load": f"coalesce(list_sum(list_transform({hits(L.MARKERS)}, lambda x: CASE x " + " ".join(f"WHEN {q(t)} THEN {m}" for t, (m, _) in L.MARKERS.items()) + " END)), 0.0)",
}
VOCABULARY2 = {"density": per("flags", "words", 1000), "score": "least(1.0, load / (words * 0.5))"}

PUNCTUATION = {
    "words": cnt(r"\w+"), "em_dashes": cnt("—"), "stacked": cnt(r"\w+—[\s\w]+—"), "smart": cnt("[“”‘’]"), "straight": cnt("[\"']"), "ellipsis": cnt("…"), "dots": cnt(r"\.\.\."),
    "semicolons": cnt(";"), "brackets": cnt("[()]"), "oxford": cnt(r"\w+,\s+\w+,\s+and\s+\w+"), "not_oxford": cnt(r"\w+,\s+\w+\s+and\s+\w+"),
    "inside": cnt(r'"\w[\w\s]*\."') + " + " + cnt(r"'\w[\w\s]*\.'"), "outside": cnt(r'"\w[\w\s]*"\.') + " + " + cnt(r"'\w[\w\s]*'\."),
}
_share = lambda a, b: f"CASE WHEN {a} + {b} > 0 THEN greatest({a}, {b}) * 100.0 / ({a} + {b}) ELSE 0.0 END"
PUNCTUATION2 = {
    "em_dash": per("em_dashes", "words", 1000), "mixed": "smart > 0 AND straight > 0", "semicolon": per("semicolons", "words", 1000), "parenthesis": per("brackets", "words", 1000),
    "semicolon_ratio": "CASE WHEN em_dashes > 0 THEN semicolons * 1.0 / em_dashes ELSE 0.0 END", "bracket_ratio": "CASE WHEN em_dashes > 0 THEN brackets * 1.0 / em_dashes ELSE 0.0 END",
    "oxford_share": _share("oxford", "not_oxford"), "quote_share": _share("inside", "outside"),
}

_any = lambda formulas: " + ".join(f"CAST(regexp_matches(text, {q('(?i)\\b' + f)}) AS INTEGER)" for f in formulas)
STRUCTURE = {
    "words": f"len({WORDS})",
    "sizes": f"list_transform({PARAGRAPHS}, lambda p: len(regexp_split_to_array({strip('p')}, '\\s+')))",
    "bullets": cnt(r"(?m)^\s*[-*•]\s|^\d+\.\s"), "openings": _any(L.OPENINGS), "closings": _any(L.CLOSINGS), "sections": cnt(r"(?m)^#+\s+.+$"),
    "parts": "list_transform(list_filter(regexp_split_to_array(text, '(?m)^#+\\s+.+$'), lambda s: " + strip("s") + " <> ''), lambda s: len(regexp_split_to_array(" + strip("s") + ", '\\s+')))",
    "found": hits(L.TRANSITIONS),
}
STRUCTURE2 = {
    "paragraphs": "len(sizes)", "paragraph_mean": "coalesce(list_avg(sizes), 0.0)", "paragraph_variance": "coalesce(list_var_pop(sizes), 0.0)",
    "fano": "CASE WHEN list_avg(sizes) > 0 THEN list_var_pop(sizes) / list_avg(sizes) ELSE 0.0 END", "bullet_density": per("bullets", "words", 100),
    "section_variance": "CASE WHEN sections > 0 THEN coalesce(list_var_pop(parts), 0.0) END", "transitions": "len(found)", "transition_density": per("len(found)", "words", 1000), "transition_kinds": "len(list_distinct(found))",
}

BURSTINESS = {"sizes": f"list_transform({SENTENCES}, lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')))"}
BURSTINESS2 = {
    "sentences": "len(sizes)", "mean": "CASE WHEN len(sizes) > 1 THEN list_avg(sizes) END", "variance": "CASE WHEN len(sizes) > 1 THEN list_var_samp(sizes) END", "deviation": "CASE WHEN len(sizes) > 1 THEN list_stddev_samp(sizes) END",
    "shortest": "CASE WHEN len(sizes) > 1 THEN list_min(sizes) END", "longest": "CASE WHEN len(sizes) > 1 THEN list_max(sizes) END", "spread": "CASE WHEN len(sizes) > 1 THEN list_max(sizes) - list_min(sizes) END",
    "cv": "CASE WHEN len(sizes) > 1 AND list_avg(sizes) > 0 THEN list_stddev_samp(sizes) * 100.0 / list_avg(sizes) END", "fano": "CASE WHEN len(sizes) > 1 AND list_avg(sizes) > 0 THEN list_var_samp(sizes) / list_avg(sizes) END",
    "uniformity": "CASE WHEN len(sizes) > 1 AND list_avg(sizes) > 0 THEN greatest(0.0, 1 - list_stddev_samp(sizes) / list_avg(sizes)) END",
}

_clean = r"list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''), lambda w: regexp_replace(w, '[^\p{L}\p{M}\p{N}_]', '', 'g'))"
_in = lambda terms: "(" + ", ".join(q(t) for t in terms) + ")"
CONTENT = {"clean": _clean, "cliches": f"len({hits(L.CLICHES)})", "fillers": f"len({hits(L.FILLERS)})"}
CONTENT2 = {
    "words": "len(clean)", "hedges": f"len(list_filter(clean, lambda w: w IN {_in(L.HEDGES)}))",
    "superlatives": f"len(list_filter(clean, lambda w: w IN {_in([t for t in L.SUPERLATIVES if ' ' not in t])})) + len(list_filter(generate_series(1, len(clean) - 1), lambda i: clean[i] = 'most' AND clean[i + 1] IN {_in(L.MOST)}))",
}
CONTENT3 = {"hedging": per("hedges", "words", 1000), "superlative": per("superlatives", "words", 1000)}


def layers(*parts: dict[str, str], source: str = "docs", keep: str = "doc_id", first: str = "text") -> str:
    """SELECT of SELECT, a layer of expressions upon another."""
    sql, names = f"SELECT {keep}, {first} FROM {source}", [keep]
    for part in parts:
        sql = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in part.items())} FROM ({sql})"
    return sql


TOOL_LAYERS = {"vocabulary": (VOCABULARY, VOCABULARY2), "punctuation": (PUNCTUATION, PUNCTUATION2), "structure": (STRUCTURE, STRUCTURE2), "burstiness": (BURSTINESS, BURSTINESS2), "content": (CONTENT, CONTENT2, CONTENT3)}


def _t(category: str, rule: str, k: int) -> float:
    return DEFAULTS[category][rule][k]


_b = lambda c: f"CAST({c} AS INTEGER)"
FLAGS = {
    "punctuation": [
        f"em_dash > {_t('punctuation', 'em_dash', 0)}", "stacked > 0", f"semicolon_ratio < {_t('punctuation', 'semicolon_to_em_dash_ratio', 0)} AND em_dashes > 0",
        f"bracket_ratio < {_t('punctuation', 'parenthesis_to_em_dash_ratio', 0)} AND em_dashes > 0", f"oxford_share > {_t('punctuation', 'oxford_comma', 0)} AND oxford + not_oxford > 2",
        f"quote_share > {_t('punctuation', 'period_quote', 0)} AND inside + outside > 2", "mixed",
    ],
    "burstiness": ["cv < 30", "cv > 50", "fano < 0.8", "fano > 1.5", "spread < 10", "spread > 25", "mean BETWEEN 12 AND 18 AND deviation < 5", "shortest < 5", "longest > 35"],
    "content": ["hedging > 10", "hedging < 5", "cliches > 2", "superlative > 8", "superlative < 8", "fillers > 2"],
    "structure": ["openings > 0", "closings > 0", f"fano < {_t('structure', 'paragraph_fano_factor', 0)} AND paragraphs > 3", f"bullet_density > {_t('structure', 'bullet_density', 0)}"],
}
_n = {k: "(" + " + ".join(_b(f) for f in v) + ")" for k, v in FLAGS.items()}
_score = (
    f"(CASE WHEN cv < {_t('burstiness', 'coefficient_of_variation', 0)} THEN -2 WHEN cv > {_t('burstiness', 'coefficient_of_variation', 1)} THEN 2 ELSE 0 END"
    f" + CASE WHEN fano < {_t('burstiness', 'fano_factor', 0)} THEN -2 WHEN fano > {_t('burstiness', 'fano_factor', 1)} THEN 2 ELSE 0 END"
    f" + CASE WHEN spread < {_t('burstiness', 'length_range', 0)} THEN -1 WHEN spread > {_t('burstiness', 'length_range', 1)} THEN 1 ELSE 0 END)"
)
_points = (
    "(CASE WHEN hedging > 10 THEN -3 WHEN hedging < 5 THEN 2 ELSE 0 END + CASE WHEN cliches >= 2 THEN -3 WHEN cliches > 0 THEN -1 ELSE 0 END"
    " + CASE WHEN superlative > 8 THEN -2 WHEN superlative < 4 THEN 1 ELSE 0 END + CASE WHEN fillers >= 2 THEN -2 WHEN fillers > 0 THEN -1 ELSE 0 END)"
)
#: Rules in order: condition, verdict, confidence.
VERDICTS = {
    "vocabulary": [("density > 15 OR critical > 0", "likely_ai", "CASE WHEN critical > 0 THEN 0.85 ELSE 0.70 END"), ("flags = 0 AND density < 3", "likely_human", "0.65"), ("true", "uncertain", "0.5")],
    "punctuation": [(f"{_n['punctuation']} >= 3", "likely_ai", f"least(0.95, 0.5 + {_n['punctuation']} * 0.15)"), (f"{_n['punctuation']} = 0", "likely_human", "0.65"), ("true", "uncertain", f"greatest(0.3, least(0.7, {_n['punctuation']} * 0.2 + 0.3))")],
    "structure": [(f"{_n['structure']} >= 2", "likely_ai", f"least(0.95, 0.5 + {_n['structure']} * 0.15)"), (f"fano > 1.2 AND {_n['structure']} = 0", "likely_human", "0.75"), ("true", "uncertain", "0.5")],
    "burstiness": [
        ("sentences < 2", "error", "0.0"), ("cv < 30 AND fano < 0.8", "likely_ai", "0.95"), ("cv > 50 AND fano > 1.5", "likely_human", "0.95"), (f"{_score} <= -3", "likely_ai", "0.75"),
        (f"{_score} <= -1", "likely_ai", "0.55"), (f"{_score} >= 3", "likely_human", "0.75"), (f"{_score} >= 1", "likely_human", "0.55"), ("true", "uncertain", "0.4"),
    ],
    "content": [
        ("words < 20", "error", "0.0"), (f"{_points} <= -5", "likely_ai", "0.85"), (f"{_points} <= -2", "likely_ai", "0.65"), (f"{_points} >= 3", "likely_human", "0.75"),
        (f"{_points} >= 1", "likely_human", "0.60"), ("true", "uncertain", "0.5"),
    ],
}


def case(rules, k: int) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {q(v) if k == 1 else f'CAST({n} AS DOUBLE)'}" for c, v, n in rules) + " END"


def verdict(tool: str) -> str:
    return f"SELECT *, {case(VERDICTS[tool], 1)} AS classification, {case(VERDICTS[tool], 2)} AS confidence FROM ({layers(*TOOL_LAYERS[tool])})"


def named(flags: list[str], names: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {f} THEN {q(n)} END" for f, n in zip(flags, names, strict=True)) + "], lambda x: x IS NOT NULL)"


_by = lambda k: "CASE {} " + " ".join(f"WHEN {q(t)} THEN {q(v[k]) if k else v[k]}" for t, v in L.MARKERS.items()) + " END"
MARKER_SIGNALS = (
    "list_transform(list_sort(list_transform(list_distinct(found), lambda w: {'o': -len(list_filter(found, lambda x: x = w)) * CAST(" + _by(0).format("w")
    + " AS DOUBLE), 'i': list_position(found, w), 'w': w, 'n': len(list_filter(found, lambda x: x = w))})), lambda r: r.w || ' (' || r.n || 'x, severity: ' || " + _by(1).format("r.w") + " || ')')"
)


def tool_rows(tools, signals: dict[str, list[str]]) -> str:
    parts = []
    for tool in tools:
        found = MARKER_SIGNALS if tool == "vocabulary" else named(FLAGS[tool], signals[tool])
        parts.append(f"SELECT doc_id, {q(tool)} AS tool, classification, confidence, {found} AS signals FROM ({verdict(tool)})")
    return " UNION ALL ".join(parts)


def ensemble(rows: str, weights: dict[str, float], score: str, ai: str, high: float, low: float, very_high: float, very_low: float, sure: tuple[float, float], top: int) -> str:
    w = "CASE tool " + " ".join(f"WHEN {q(t)} THEN {v}" for t, v in weights.items()) + " ELSE 0.05 END"
    o = "CASE tool " + " ".join(f"WHEN {q(t)} THEN {i}" for i, t in enumerate(weights)) + f" ELSE {len(weights)} END"
    return f"""
    rows_ AS ({rows}),
    weighed AS (SELECT *, CASE WHEN classification <> 'error' THEN {w} ELSE 0.0 END AS w, CASE WHEN classification <> 'error' THEN {score} ELSE 0.5 END AS s, {o} AS o FROM rows_),
    sums AS (SELECT doc_id, CASE WHEN sum(w) > 0 THEN sum(s * w) / sum(w) ELSE 0.5 END AS score, count(*) FILTER (classification <> 'error' AND {ai}) AS ai_tools,
             count(*) FILTER (classification = 'likely_human') AS human_tools, count(*) FILTER (classification <> 'error') AS tools FROM weighed GROUP BY doc_id),
    flat AS (SELECT doc_id, w, o, unnest(signals) AS x, unnest(generate_series(1, len(signals))) AS i FROM weighed WHERE classification <> 'error'),
    best AS (SELECT doc_id, list(x ORDER BY w DESC, o, i)[1:{top}] AS l FROM flat GROUP BY doc_id),
    found AS (SELECT doc_id, round(score, 6) AS score, CASE WHEN score > {high} THEN 'likely_ai' WHEN score < {low} THEN 'likely_human' ELSE 'uncertain' END AS classification,
              CAST(CASE WHEN score > {high} THEN CASE WHEN score > {very_high} THEN {sure[1]} ELSE {sure[0]} END WHEN score < {low} THEN CASE WHEN score < {very_low} THEN {sure[1]} ELSE {sure[0]} END ELSE 0.5 END AS DOUBLE) AS confidence,
              ai_tools, human_tools, tools, coalesce(array_to_string(l, '; '), '') AS top_signals FROM sums LEFT JOIN best USING (doc_id))"""


FULL_SCORE = "CASE classification WHEN 'likely_ai' THEN 0.5 + 0.4 * least(1.0, greatest(0.0, coalesce(nullif(confidence, 0), 0.5))) WHEN 'likely_human' THEN 0.5 - 0.4 * least(1.0, greatest(0.0, coalesce(nullif(confidence, 0), 0.5))) ELSE 0.5 END"


def fast_score(compat: bool) -> str:
    ai = "contains(classification, 'ai')" if compat else "classification = 'likely_ai'"
    return f"CASE WHEN {ai} THEN CASE WHEN confidence >= 0.8 THEN 0.9 WHEN confidence >= 0.6 THEN 0.75 ELSE 0.6 END WHEN contains(classification, 'human') THEN CASE WHEN confidence >= 0.8 THEN 0.1 WHEN confidence >= 0.6 THEN 0.25 ELSE 0.4 END ELSE 0.5 END"

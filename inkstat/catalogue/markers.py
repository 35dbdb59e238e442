"""Queries of the marker groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import markers as K
from ..functions import metrics as M
from . import sql as S

_sum = lambda ps, flags="(?i)": " + ".join(S.cnt(flags + p) for p in ps)
_any = lambda ps, flags="(?i)", col="text": " + ".join(f"CAST(regexp_matches({col}, {S.q(flags + p)}) AS INTEGER)" for p in ps)
_weight = "CASE x " + " ".join(f"WHEN {S.q(t)} THEN {w}.0" for t, w in K.WEIGHTED.items()) + " END"
_lines = f"list_filter(string_split(text, chr(10)), lambda x: {S.strip('x')} <> '')"
_compounds = " + ".join(f"(length(lower(text)) - length(replace(lower(text), {S.q(t)}, ''))) // {len(t)}" for t in K.COMPOUNDS)
_points = " + ".join(f"CASE WHEN {k} > {0.5 if k == 'dash_ratio' else 0} THEN {v} ELSE 0 END" for k, v in K.POINTS.items())

LAYERS = {
    "formatting": (
        {
            "invisible": S.cnt(f"[{L.INVISIBLE}]"), "smart_double": S.cnt("[“”]"), "smart_single": S.cnt("[‘’]"), "straight_double": S.cnt('"'), "straight_single": S.cnt("'"), "em": S.cnt("—"), "en": S.cnt("–"), "hyphens": S.cnt("-"),
            "ellipsis_sign": S.cnt("…"), "periods": S.cnt(r"\.{3}"), "double_spaces": S.cnt("  +"), "trailing_blanks": S.cnt(r"(?m)[ \t]+$"), "blank_lines": S.cnt(r"\n{3,}"), "lines": f"len({_lines})",
            "titled": f"len(list_filter({_lines}, lambda x: {S.cnt(r'(^|\s)[A-Z]', 'x')} * 1.0 / {S.cnt(r'\S+', 'x')} > 0.7))", **{k: f"regexp_matches(text, {S.q(p)})" for k, p in K.MARKDOWN.items()},
        },
        {"dash_ratio": "CASE WHEN em + en + hyphens > 0 THEN em * 1.0 / (em + en + hyphens) ELSE 0.0 END", "title_ratio": "CASE WHEN lines > 0 THEN titled * 1.0 / lines ELSE 0.0 END", "markdown": " + ".join(f"CAST({k} AS INTEGER)" for k in K.MARKDOWN)},
        {"suspicion": _points},
    ),
    "style": (
        {"pieces": S.cnt(r"\W+") + " + 1", "hedge_phrases": _sum(K.HEDGE_PHRASES), "formal": f"len({S.hits(K.FORMAL)})", "load": f"coalesce(list_sum(list_transform({S.hits(K.WEIGHTED)}, lambda x: {_weight})), 0.0)", "words": f"len({S.WORDS})", "compounds": _compounds},
        {
            "opener_ratio": f"len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, {S.q('(?i)^\\s*(' + '|'.join(K.OPENERS) + ')\\b')}))) * 1.0 / len(string_split(text, chr(10) || chr(10)))",
            "formality": "formal * 100.0 / pieces", "weighted": "load / pieces", "compound_density": S.per("compounds", "words", 10000),
        },
    ),
    "narrative": (
        {"tricolons": S.cnt("(?i)" + K.TRICOLON), "not_but": _sum(K.NOT_BUT), "conclusions": _sum(K.CONCLUSIONS), "proper": f"regexp_extract_all(text, {S.q(K.PROPER)})", "specifics": S.cnt(K.SPECIFICS), "hundreds": r"len(regexp_split_to_array(lower(text), '\s+')) / 100.0"},
        {"proper_nouns": "len(proper)", "default_names": "len(list_filter(proper, lambda x: lower(x) IN (" + ", ".join(map(S.q, K.NAMES)) + ")))"},
        {"proper_density": "proper_nouns / hundreds", "name_ratio": "default_names * 1.0 / greatest(proper_nouns, 1)", "specificity": "specifics / hundreds"},
    ),
    "claims": (
        {"balance": _sum(K.BALANCE), "caveats": _sum(K.CAVEATS), "placeholders": S.cnt("(?i)" + K.PLACEHOLDERS), "dois": S.cnt(K.DOI), "self_reference": _any(K.SELF) + " + " + _any(K.SELF_LINES, "(?m)"), "refusals": _sum(K.REFUSALS)},
    ),
    "anchored": (
        {"opening": f"({_any(K.FIRST, col='string_split(text, chr(10) || chr(10))[1]')}) > 0", "closing": f"({_any(K.LAST, col='string_split(text, chr(10) || chr(10))[-1]')}) > 0", "lengths": r"list_transform(regexp_split_to_array(text, '\n\n+'), lambda p: length(p))"},
        {"char_fano": "CASE WHEN list_sum(lengths) > 0 THEN list_var_pop(lengths) / list_avg(lengths) ELSE 0.0 END"},
    ),
}

_TRUTH = [*K.MARKDOWN, "opening", "closing"]
_DOUBLE = "dash_ratio title_ratio formality weighted opener_ratio compound_density proper_density name_ratio specificity char_fano".split()


def _shown(group: str) -> str:
    cast = lambda n: n if n in _TRUTH else f"round(CAST({n} AS DOUBLE), 6) AS {n}" if n in _DOUBLE else f"CAST({n} AS BIGINT) AS {n}"
    return ", ".join(cast(n) for n in K.GROUPS[group][1])


def register(add, rounded) -> None:
    for group, (layers, names) in K.GROUPS.items():
        add(
            f"{group}_markers",
            lambda d, layers=layers, names=names: rounded(M.with_layers(d.select("doc_id", "text"), layers(F.col("text"), F.col)).select("doc_id", *names)),
            f"SELECT doc_id, {_shown(group)} FROM ({S.layers(*LAYERS[group])})",
        )

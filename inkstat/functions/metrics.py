"""Per-document measures over a text column, without a shuffle.

A tool's measures come in layers: dicts of Columns, where a layer may name what
layers before it made, through `c`.  Every layer becomes a projection of its
own, so that costly parts are computed once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from .text import alternatives, bounded, count, count_chars, count_literal, count_runs, count_split, count_words, if_there, paragraphs, per, sentences, split_words, strip, syllables

Layers = list[dict[str, Column]]
Name = Callable[[str], Column]


def with_layers(rows: DataFrame, layers: Layers, prefix: str = "") -> DataFrame:
    for layer in layers:
        rows = rows.withColumns({prefix + k: v for k, v in layer.items()})
    return rows


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def moments(values: Column) -> Column:
    """Struct of n, mean and the sum of squared differences, in one pass.

    Squares grow along a running mean, in the order of the values, as the SQL's engine
    does it: dispersions that lie on a threshold fall to the same side in both.
    """
    zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "s", "m", "q")))

    def add(a: Column, x: Column) -> Column:
        x = x.cast("double")
        m = a["m"] + (x - a["m"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), m.alias("m"), (a["q"] + (x - m) * (x - a["m"])).alias("q"))

    return F.aggregate(values, zero, add, lambda a: F.struct(a["n"].alias("n"), F.coalesce(F.try_divide(a["s"], a["n"]), F.lit(0.0)).alias("mean"), a["q"].alias("squares")))


def hits(text, terms, flags: str = "(?i)") -> Column:
    """Lower-cased occurrences of any term between ASCII word boundaries."""
    return F.transform(F.regexp_extract_all(text, F.lit(flags + bounded(alternatives(terms))), F.lit(1)), F.lower)


def vocabulary(text, c: Name) -> Layers:
    weights = F.create_map(*(F.lit(x) for term, (m, _) in L.MARKERS.items() for x in (term, m)))
    critical = F.array(*(F.lit(t) for t, (_, s) in L.MARKERS.items() if s == "critical"))
    return [
        {"found": hits(text, L.MARKERS), "words": count_split(text)},
        {
            "flags": F.size(c("found")).cast("long"),
            "critical": F.size(F.filter(c("found"), lambda t: F.array_contains(critical, t))).cast("long"),
            "load": total(F.transform(c("found"), lambda t: F.element_at(weights, t))),
        },
        {"density": per(c("flags"), c("words"), 1000), "score": F.least(F.lit(1.0), c("load") / (c("words") * 0.5))},
    ]


def punctuation(text, c: Name) -> Layers:
    """Patterns begin with the last letter of a word: as many matches as with the whole word, none begun in vain."""
    n = lambda p: count(text, p)
    share = lambda a, b: F.when(c(a) + c(b) > 0, F.greatest(c(a), c(b)) * 100.0 / (c(a) + c(b))).otherwise(F.lit(0.0))
    ratio = lambda a: F.when(c("em_dashes") > 0, c(a) * 1.0 / c("em_dashes")).otherwise(F.lit(0.0))
    return [
        {
            "words": count_runs(text), "em_dashes": count_literal(text, "\u2014"), "stacked": if_there(text, "\u2014", n("\\w\u2014[\\s\\w]+\u2014")), "smart": count_chars(text, "\u201c\u201d\u2018\u2019"),
            "straight": count_chars(text, "\"'"), "ellipsis": count_literal(text, "\u2026"), "dots": count_literal(text, "..."), "semicolons": count_literal(text, ";"), "brackets": count_chars(text, "()"),
            "oxford": if_there(text, ",", n(r"\w,\s+\w+,\s+and\s+\w+")), "not_oxford": if_there(text, ",", n(r"\w,\s+\w+\s+and\s+\w+")),
            "inside": if_there(text, '."', n(r'"\w[\w\s]*\."')) + if_there(text, ".'", n(r"'\w[\w\s]*\.'")), "outside": if_there(text, '".', n(r'"\w[\w\s]*"\.')) + if_there(text, "'.", n(r"'\w[\w\s]*'\.")),
        },
        {
            "em_dash": per(c("em_dashes"), c("words"), 1000), "mixed": (c("smart") > 0) & (c("straight") > 0), "semicolon": per(c("semicolons"), c("words"), 1000), "parenthesis": per(c("brackets"), c("words"), 1000),
            "semicolon_ratio": ratio("semicolons"), "bracket_ratio": ratio("brackets"), "oxford_share": share("oxford", "not_oxford"), "quote_share": share("inside", "outside"),
        },
    ]


def structure(text, c: Name) -> Layers:
    there = lambda f: reduce(lambda a, b: a | b, [F.contains(c("low"), F.lit(x)) for x in L.FORMULA_WORDS[f]])
    first = lambda formulas: sum(F.when(there(f), text.rlike("(?i)(?<![A-Za-z0-9_])" + f).cast("long")).otherwise(0) for f in formulas)
    sizes = lambda parts: F.transform(parts, lambda p: F.greatest(F.lit(1), count(p, r"\S+")).cast("long"))
    heading = r"(?md)^#+\s+.+$"
    sections = F.when(c("sections") > 0, F.filter(F.split(text, heading), lambda s: s.rlike(r"\S"))).otherwise(F.array().cast("array<string>"))
    return [
        {"words": count_words(text), "low": F.lower(text), "sections": if_there(text, "#", count(text, heading))},
        {
            "sizes": sizes(paragraphs(text)), "bullets": count(text, "(?md)^\\s*[-*\u2022]\\s|^\\d+\\.\\s"), "openings": first(L.OPENINGS), "closings": first(L.CLOSINGS),
            "parts": sizes(sections), "found": hits(text, L.TRANSITIONS),
        },
        {"m": moments(c("sizes")), "k": moments(c("parts")), "transitions": F.size(c("found")).cast("long"), "transition_kinds": F.size(F.array_distinct(c("found"))).cast("long")},
        {"paragraphs": c("m")["n"].cast("long"), "paragraph_mean": c("m")["mean"], "paragraph_variance": F.coalesce(F.try_divide(c("m")["squares"], c("m")["n"]), F.lit(0.0))},
        {
            "fano": F.coalesce(F.try_divide(c("paragraph_variance"), c("paragraph_mean")), F.lit(0.0)), "bullet_density": per(c("bullets"), c("words"), 100),
            "section_variance": F.when(c("sections") > 0, F.coalesce(F.try_divide(c("k")["squares"], c("k")["n"]), F.lit(0.0))), "transition_density": per(c("transitions"), c("words"), 1000),
        },
    ]


def burstiness(text, c: Name) -> Layers:
    """Word counts of sentences; sample deviation.  Null measures below two sentences."""
    some = lambda v: F.when(c("sentences") > 1, v)
    return [
        {"sizes": F.transform(sentences(text), lambda s: count(s, r"\S+"))},
        {"sentences": F.size(c("sizes")).cast("long"), "m": moments(c("sizes")), "shortest": F.array_min(c("sizes")).cast("double"), "longest": F.array_max(c("sizes")).cast("double")},
        {"mean": some(c("m")["mean"]), "variance": some(F.try_divide(c("m")["squares"], c("m")["n"] - 1)), "shortest": some(c("shortest")), "longest": some(c("longest"))},
        {"deviation": F.sqrt(F.when(c("variance") < 0, 0.0).otherwise(c("variance"))), "spread": c("longest") - c("shortest")},
        {
            "cv": F.when(c("mean") > 0, c("deviation") * 100.0 / c("mean")), "fano": F.when(c("mean") > 0, c("variance") / c("mean")),
            "uniformity": F.when(c("mean") > 0, F.greatest(F.lit(0.0), 1 - c("deviation") / c("mean"))),
        },
    ]


def content(text, c: Name) -> Layers:
    among = lambda terms: F.size(F.filter(c("clean"), lambda w: w.isin(list(terms)))).cast("long")
    phrases = lambda terms: F.size(hits(text, terms)).cast("long")
    most = F.size(F.filter(c("clean"), lambda w, i: (w == "most") & F.coalesce(F.get(c("clean"), i + 1).isin(L.MOST), F.lit(False)))).cast("long")
    return [
        {"clean": F.transform(split_words(F.lower(text)), lambda w: F.regexp_replace(w, r"(?U)[^\w]", "")), "cliches": phrases(L.CLICHES), "fillers": phrases(L.FILLERS)},
        {"words": F.size(c("clean")).cast("long"), "hedges": among(L.HEDGES), "superlatives": among([t for t in L.SUPERLATIVES if " " not in t]) + most},
        {"hedging": per(c("hedges"), c("words"), 1000), "superlative": per(c("superlatives"), c("words"), 1000)},
    ]


def phrase_patterns(text) -> Column:
    """Occurrences of the phrases as plain substrings of the lower-cased text."""
    low = F.lower(text)
    return sum((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p) for p in L.PHRASES).cast("long")


def readability(text, c: Name) -> Layers:
    """Flesch reading ease (0 to 100) and grade (from 0) over runs of ASCII letters."""
    return [
        {"w": F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), "s": F.greatest(F.size(sentences(text)), F.lit(1)).cast("double")},
        {"letters_words": F.size(c("w")).cast("long"), "syllables": F.aggregate(c("w"), F.lit(0).cast("long"), lambda a, w: a + syllables(w))},
        {"x": c("letters_words") / c("s"), "y": F.try_divide(c("syllables"), c("letters_words"))},
        {"ease": F.least(F.lit(100.0), F.greatest(F.lit(0.0), 206.835 - 1.015 * c("x") - 84.6 * c("y"))), "grade": F.greatest(F.lit(0.0), 0.39 * c("x") + 11.8 * c("y") - 15.59)},
        {k: F.when(c("letters_words") > 0, c(k)) for k in ("ease", "grade")},
    ]

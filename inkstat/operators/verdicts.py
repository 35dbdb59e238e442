"""Verdicts of the tools: conditions over metric columns and resolved thresholds, no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config.rules import Rules
from ..functions import lexicons as L
from ..functions import metrics as M

AI, HUMAN, UNSURE, ERROR = "likely_ai", "likely_human", "uncertain", "error"


def cases(*rules: tuple[Column | None, str, Column | float]) -> tuple[Column, Column]:
    """Classification and confidence of the first rule that holds; the last has no condition."""
    *some, (_, last, confidence) = rules
    as_column = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    c, n = F.lit(last), as_column(confidence)
    for condition, verdict, sure in reversed(some):
        c, n = F.when(condition, F.lit(verdict)).otherwise(c), F.when(condition, as_column(sure)).otherwise(n)
    return c, n


def number(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])


def _at_most(n: Column, cap: float = 0.95) -> Column:
    return F.least(F.lit(cap), n)


def vocabulary(m: dict[str, Column], rules: Rules):
    ai, human = rules.get("vocabulary", "ai_vocab_density") or (15.0, 3.0)
    critical = m["critical"] > 0
    return cases(
        ((m["density"] > ai) | critical, AI, F.when(critical, 0.85).otherwise(0.70)),
        ((m["flags"] == 0) & (m["density"] < human), HUMAN, 0.65),
        (None, UNSURE, 0.50),
    )


def punctuation_flags(m: dict[str, Column], rules: Rules) -> list[Column]:
    dashes = m["em_dashes"] > 0
    return [
        rules.flags("punctuation", "em_dash", m["em_dash"]),
        m["stacked"] > 0,
        rules.flags("punctuation", "semicolon_to_em_dash_ratio", m["semicolon_ratio"]) & dashes,
        rules.flags("punctuation", "parenthesis_to_em_dash_ratio", m["bracket_ratio"]) & dashes,
        rules.flags("punctuation", "oxford_comma", m["oxford_share"]) & (m["oxford"] + m["not_oxford"] > 2),
        rules.flags("punctuation", "period_quote", m["quote_share"]) & (m["inside"] + m["outside"] > 2),
        m["mixed"],
    ]


PUNCTUATION_SIGNALS = ["em dash frequency", "stacked em dashes", "few semicolons to em dashes", "few parentheses to em dashes", "uniform Oxford commas", "uniform quote placement", "mixed quotes"]


def punctuation(m, rules: Rules):
    n = number(punctuation_flags(m, rules))
    return cases(
        (n >= 3, AI, _at_most(0.5 + n * 0.15)),
        (n == 0, HUMAN, 0.65),
        (None, UNSURE, F.greatest(F.lit(0.3), F.least(F.lit(0.7), n * 0.2 + 0.3))),
    )


def structure_flags(m, rules: Rules) -> list[Column]:
    return [
        m["openings"] > 0,
        m["closings"] > 0,
        rules.flags("structure", "paragraph_fano_factor", m["fano"]) & (m["paragraphs"] > 3),
        rules.flags("structure", "bullet_density", m["bullet_density"]),
    ]


STRUCTURE_SIGNALS = ["opening formula", "closing formula", "uniform paragraphs", "bullet density"]


def structure(m, rules: Rules):
    n = number(structure_flags(m, rules))
    varied = m["fano"] > (rules.get("structure", "paragraph_fano_factor") or (None, 1.5))[1]
    return cases((n >= 2, AI, _at_most(0.5 + n * 0.15)), (varied & (n == 0), HUMAN, 0.75), (None, UNSURE, 0.5))


def _side(rules: Rules, category: str, rule: str, value: Column, fallback: float) -> tuple[Column, Column]:
    """Beyond the ai threshold; beyond the human baseline on the other side."""
    baseline = (rules.get(category, rule) or (None, fallback))[1]
    return rules.flags(category, rule, value, auto_off=False), F.coalesce(value > baseline, F.lit(False)) if rules.get(category, rule) else F.lit(False)


def burstiness_flags(m, rules: Rules) -> list[Column]:
    pairs = [_side(rules, "burstiness", rule, m[c], base) for rule, c, base in (("coefficient_of_variation", "cv", 60.0), ("fano_factor", "fano", 1.5), ("length_range", "spread", 25.0))]
    return [*(f for pair in pairs for f in pair), m["mean"].between(12, 18) & (m["deviation"] < 5), m["shortest"] < 5, m["longest"] > 35]


BURSTINESS_SIGNALS = ["low variation of sentence lengths", "high variation of sentence lengths", "low dispersion of sentence lengths", "high dispersion of sentence lengths", "narrow range of sentence lengths", "wide range of sentence lengths", "sentences of 12 to 18 words", "very short sentences", "very long sentences"]


def vocabulary_signals(m) -> Column:
    """One signal a marker word: `word (nx, severity: s)`, by what it contributes, then by first place."""
    spec = F.create_map(*(F.lit(x) for term, (weight, severity) in L.MARKERS.items() for x in (term, F.struct(F.lit(weight).alias("weight"), F.lit(severity).alias("severity")))))
    words = F.array_distinct(m["found"])
    rows = F.transform(words, lambda w, i: F.struct((-F.size(F.filter(m["found"], lambda x: x == w)) * F.element_at(spec, w)["weight"]).alias("order"), i.alias("i"), w.alias("word"), F.size(F.filter(m["found"], lambda x: x == w)).alias("n")))
    return F.transform(F.sort_array(rows), lambda r: F.concat(r["word"], F.lit(" ("), r["n"].cast("string"), F.lit("x, severity: "), F.element_at(spec, r["word"])["severity"], F.lit(")")))


def burstiness(m, rules: Rules):
    """error below two sentences."""
    bounds = {k: rules.get("burstiness", k) or d for k, d in (("coefficient_of_variation", (30.0, 50.0)), ("fano_factor", (0.8, 1.5)), ("length_range", (10.0, 25.0)))}
    (cv, cv_high), (fano, fano_high), (spread, spread_high) = bounds.values()
    side = lambda v, low, high, n: F.when(v < low, -n).when(v > high, n).otherwise(0)
    score = side(m["cv"], cv, cv_high, 2) + side(m["fano"], fano, fano_high, 2) + side(m["spread"], spread, spread_high, 1)
    return cases(
        (m["sentences"] < 2, ERROR, 0.0),
        ((m["cv"] < cv) & (m["fano"] < fano), AI, 0.95),
        ((m["cv"] > cv_high) & (m["fano"] > fano_high), HUMAN, 0.95),
        (score <= -3, AI, 0.75),
        (score <= -1, AI, 0.55),
        (score >= 3, HUMAN, 0.75),
        (score >= 1, HUMAN, 0.55),
        (None, UNSURE, 0.40),
    )


def content_flags(m, rules: Rules) -> list[Column]:
    above = lambda rule, c: rules.flags("content", rule, m[c], auto_off=False)
    return [
        above("hedging", "hedging"), ~above("hedging", "hedging") & (m["hedging"] < 5), above("cliche", "cliches"), above("superlative", "superlative"), ~above("superlative", "superlative") & (m["superlative"] < 8), above("filler", "fillers"),
    ]


CONTENT_SIGNALS = ["much hedging", "little hedging", "cliches", "many superlatives", "few superlatives", "filler phrases"]


def content(m, rules: Rules):
    """error below twenty words."""
    hedge, cliche, superlative, filler = (rules.get("content", k) or d for k, d in (("hedging", (15.0, 5.0)), ("cliche", (3.0, 0.0)), ("superlative", (20.0, 8.0)), ("filler", (3.0, 0.0))))
    score = (
        F.when(m["hedging"] > hedge[0], -3).when(m["hedging"] < hedge[1], 2).otherwise(0)
        + F.when(m["cliches"] >= cliche[0], -3).when(m["cliches"] > 0, -1).otherwise(0)
        + F.when(m["superlative"] > superlative[0], -2).when(m["superlative"] < superlative[1], 1).otherwise(0)
        + F.when(m["fillers"] >= filler[0], -2).when(m["fillers"] > 0, -1).otherwise(0)
    )
    return cases((m["words"] < 20, ERROR, 0.0), (score <= -5, AI, 0.85), (score <= -2, AI, 0.65), (score >= 3, HUMAN, 0.75), (score >= 1, HUMAN, 0.60), (None, UNSURE, 0.50))


NGRAM_SIGNALS = ["much 6-gram repetition", "low 6-gram diversity", "very high 6-gram diversity", "phrase patterns", "some phrase patterns", "elevated 4-gram repetition", "high 5-gram diversity"]


def ngram_flags(m, rules: Rules) -> list[Column]:
    many = rules.flags("ngram", "ai_pattern_count", m["patterns"], auto_off=False)
    return [
        rules.flags("ngram", "six_gram_repetition_rate", m["rep6"], auto_off=False), rules.flags("ngram", "six_gram_ttr", m["ttr6"], auto_off=False), F.coalesce((m["ttr6"] > 0.95) & (m["hapax6"] > 0.9), F.lit(False)), many,
        ~many & (m["patterns"] > 0), F.coalesce(m["rep4"] > 0.25, F.lit(False)), F.coalesce(m["ttr5"] > 0.9, F.lit(False)),
    ]


def ngram(m, rules: Rules):
    """m: rep4, ttr5, rep6, ttr6, hapax6 (null: no such n-grams) and patterns."""
    rep_limit = (rules.get("ngram", "six_gram_repetition_rate") or (0.15, None))[0]
    pattern_limit = (rules.get("ngram", "ai_pattern_count") or (2.0, None))[0]
    flags = ngram_flags(m, rules)
    varied = flags[2]
    scores = list(zip(flags, (0.7, 0.6, -0.7, 0.8, 0.4, 0.3, -0.3)))
    n = number([c for c, _ in scores])
    mean = F.when(n > 0, reduce(lambda a, b: a + b, [F.when(c, F.lit(s)).otherwise(F.lit(0.0)) for c, s in scores]) / n).otherwise(F.lit(0.0))
    strong, weak = _at_most(0.5 + F.abs(mean)), _at_most(0.4 + F.abs(mean * 0.5))
    return cases(
        ((m["patterns"] >= pattern_limit) | F.coalesce(m["rep6"] > rep_limit, F.lit(False)), AI, strong),
        (varied, HUMAN, strong),
        (mean > 0.3, AI, weak),
        (mean < -0.3, HUMAN, weak),
        (None, UNSURE, weak),
    )


def named(flags: list[Column], names: list[str]) -> Column:
    """The names of the flags that hold."""
    return F.array_compact(F.array(*(F.when(f, F.lit(n)) for f, n in zip(flags, names))))


#: Tools whose measures are one projection of the text: measures, verdict, flags with their signals.
TOOLS = {
    "vocabulary": (M.vocabulary, vocabulary, vocabulary_signals),
    "punctuation": (M.punctuation, punctuation, (punctuation_flags, PUNCTUATION_SIGNALS)),
    "structure": (M.structure, structure, (structure_flags, STRUCTURE_SIGNALS)),
    "burstiness": (M.burstiness, burstiness, (burstiness_flags, BURSTINESS_SIGNALS)),
    "content": (M.content, content, (content_flags, CONTENT_SIGNALS)),
}


def measured(docs: DataFrame, tools: tuple[str, ...], text: str = "text") -> DataFrame:
    """doc_id, the text, and every tool's measures with its name and two underscores before; the text is read once."""
    rows = docs.select("doc_id", F.col(text).alias("text"))
    for tool in tools:
        rows = M.with_layers(rows, TOOLS[tool][0](F.col("text"), lambda k, t=tool: F.col(f"{t}__{k}")), f"{tool}__")
    return rows


class Measures(dict):
    """A tool's measures by name, as columns of measured()."""

    def __init__(self, tool: str):
        self.tool = tool

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.tool}__{name}")


def verdict(docs: DataFrame, tool: str, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the tool's measures, classification and confidence."""
    classification, confidence = TOOLS[tool][1](Measures(tool), rules)
    return measured(docs, (tool,)).withColumn("classification", classification).withColumn("confidence", confidence).drop("text")


def tool_rows(docs: DataFrame, tools: tuple[str, ...], rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """One row a document and tool: classification, confidence, signals.  The text is measured once, then laid out in rows."""
    rows = measured(docs, tools, text)
    made = []
    for tool in tools:
        m = Measures(tool)
        classification, confidence = TOOLS[tool][1](m, rules)
        told = TOOLS[tool][2]
        signals = told(m) if callable(told) else named(told[0](m, rules), told[1])
        made.append(F.struct(F.lit(tool).alias("tool"), classification.alias("classification"), confidence.alias("confidence"), signals.alias("signals")))
    return rows.select("doc_id", F.explode(F.array(*made)).alias("r")).select("doc_id", "r.*")

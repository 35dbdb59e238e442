"""Threshold rules: defaults, presets, merging, checks and validation.  All numbers here are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category -> rule -> (ai threshold, human baseline).
DEFAULTS = {
    "punctuation": {"period_quote": (97.0, 85.0), "oxford_comma": (95.0, 75.0), "em_dash": (2.5, 1.5), "semicolon_to_em_dash_ratio": (0.5, 1.5), "parenthesis_to_em_dash_ratio": (1.0, 2.0)},
    "structure": {"paragraph_fano_factor": (0.5, 1.2), "bullet_density": (3.0, 1.0), "transition_density": (20.0, 10.0)},
    "vocabulary": {"ai_vocab_density": (15.0, 3.0)},
    "burstiness": {"coefficient_of_variation": (30.0, 50.0), "fano_factor": (0.8, 1.5), "length_range": (10.0, 25.0)},
    "ngram": {"six_gram_repetition_rate": (0.3, 0.1), "six_gram_ttr": (0.3, 0.8), "ai_pattern_count": (2.0, 0.0)},
    "content": {"hedging": (10.0, 5.0), "cliche": (2.0, 0.0), "superlative": (8.0, 4.0), "filler": (2.0, 0.0)},
    "syntactic": {"avg_dependency_depth": (3.5, 6.0), "sentence_type_uniformity": (0.7, 0.5)},
    "perplexity": {"perplexity": (20.0, 80.0)},
    "detectgpt": {"d_score": (2.0, 0.5)},
    "fast_detectgpt": {"probability": (0.70, 0.30)},
    "binoculars": {"score": (0.8536, 1.2)},
}

# Preset -> (category, rule) -> (ai, human, disabled); None keeps what is there.
PRESETS = {
    "blog": {("punctuation", "period_quote"): (95.0, 70.0, None), ("punctuation", "oxford_comma"): (None, 60.0, None), ("punctuation", "em_dash"): (3.5, 2.0, None), ("structure", "paragraph_fano_factor"): (0.4, 1.5, None), ("structure", "transition_density"): (25.0, 12.0, None), ("content", "hedging"): (12.0, 6.0, None), ("content", "cliche"): (3.0, 1.0, None), ("burstiness", "coefficient_of_variation"): (25.0, 45.0, None)},
    "book": {("punctuation", "period_quote"): (None, 95.0, None), ("punctuation", "oxford_comma"): (None, 90.0, None), ("punctuation", "em_dash"): (4.0, 2.5, None), ("structure", "paragraph_fano_factor"): (0.3, 1.8, None), ("structure", "bullet_density"): (None, None, True), ("vocabulary", "ai_vocab_density"): (10.0, 2.0, None), ("burstiness", "coefficient_of_variation"): (35.0, 55.0, None), ("burstiness", "fano_factor"): (0.6, 2.0, None)},
    "technical-book": {("punctuation", "period_quote"): (100.0, 100.0, True), ("punctuation", "oxford_comma"): (None, 100.0, None), ("punctuation", "em_dash"): (4.0, 2.0, None), ("structure", "paragraph_fano_factor"): (0.3, 0.8, None), ("structure", "bullet_density"): (8.0, 3.0, None), ("structure", "transition_density"): (30.0, 15.0, None), ("content", "hedging"): (15.0, 8.0, None), ("vocabulary", "ai_vocab_density"): (20.0, 5.0, None), ("burstiness", "coefficient_of_variation"): (35.0, 55.0, None), ("burstiness", "fano_factor"): (0.6, 2.0, None)},
    "technical-docs": {("punctuation", "period_quote"): (None, None, True), ("punctuation", "oxford_comma"): (None, None, True), ("punctuation", "em_dash"): (4.0, 2.0, None), ("structure", "bullet_density"): (8.0, 3.0, None), ("structure", "transition_density"): (30.0, 15.0, None), ("structure", "paragraph_fano_factor"): (0.3, 0.8, None), ("content", "hedging"): (15.0, 8.0, None), ("content", "cliche"): (None, None, True), ("vocabulary", "ai_vocab_density"): (20.0, 5.0, None)},
    "academic": {("punctuation", "period_quote"): (None, 98.0, None), ("punctuation", "oxford_comma"): (None, 95.0, None), ("content", "hedging"): (18.0, 10.0, None), ("content", "superlative"): (5.0, 2.0, None), ("vocabulary", "ai_vocab_density"): (12.0, 4.0, None), ("syntactic", "avg_dependency_depth"): (3.0, 6.5, None), ("perplexity", "perplexity"): (15.0, 60.0, None)},
    "casual": {("punctuation", "period_quote"): (None, None, True), ("punctuation", "oxford_comma"): (None, None, True), ("punctuation", "em_dash"): (2.0, 1.0, None), ("structure", "paragraph_fano_factor"): (0.6, 2.0, None), ("content", "hedging"): (8.0, 4.0, None), ("content", "filler"): (1.0, 0.0, None), ("burstiness", "coefficient_of_variation"): (20.0, 60.0, None), ("burstiness", "fano_factor"): (1.0, 2.5, None), ("perplexity", "perplexity"): (30.0, 100.0, None)},
    "student": {("punctuation", "period_quote"): (98.0, 80.0, None), ("punctuation", "oxford_comma"): (98.0, 70.0, None), ("structure", "paragraph_fano_factor"): (0.4, 1.0, None), ("vocabulary", "ai_vocab_density"): (12.0, 2.0, None), ("content", "hedging"): (12.0, 6.0, None), ("content", "cliche"): (2.0, 0.0, None), ("perplexity", "perplexity"): (25.0, 70.0, None), ("detectgpt", "d_score"): (1.8, 0.3, None)},
    "business": {("punctuation", "em_dash"): (3.0, 1.5, None), ("structure", "bullet_density"): (5.0, 2.0, None), ("content", "cliche"): (4.0, 1.0, None), ("content", "hedging"): (12.0, 7.0, None), ("content", "superlative"): (10.0, 5.0, None)},
}

# Rules for which lower measures point to a machine.
BELOW = {
    ("punctuation", "semicolon_to_em_dash_ratio"), ("punctuation", "parenthesis_to_em_dash_ratio"), ("structure", "paragraph_fano_factor"), ("burstiness", "coefficient_of_variation"),
    ("burstiness", "fano_factor"), ("burstiness", "length_range"), ("ngram", "six_gram_ttr"), ("syntactic", "avg_dependency_depth"), ("perplexity", "perplexity"), ("binoculars", "score"),
}


class Rules:
    """Resolved thresholds: defaults, then presets in order, then overrides."""

    def __init__(self, presets: tuple[str, ...] = (), overrides: dict | None = None):
        if len(set(presets)) < len(presets):
            raise ValueError(f"circular preset: {presets}")
        self.rules = {(c, r): [ai, human, False] for c, rules in DEFAULTS.items() for r, (ai, human) in rules.items()}
        for layer in [*(PRESETS[p] for p in presets), overrides or {}]:
            for key, values in layer.items():
                old = self.rules.setdefault(key, [None, None, False])
                self.rules[key] = [o if v is None else v for o, v in zip(old, values)]

    def get(self, category: str, rule: str) -> tuple[float | None, float | None] | None:
        """(ai, human); None if there is no such rule or it is off."""
        found = self.rules.get((category, rule))
        return None if found is None or found[2] else (found[0], found[1])

    def flags(self, category: str, rule: str, value: Column, auto_off: bool = True) -> Column:
        """True where value lies beyond the ai threshold, strictly.

        auto_off: a rule whose human baseline lies beyond its ai threshold is off.
        """
        found = self.get(category, rule)
        if found is None or found[0] is None:
            return F.lit(False)
        ai, human = found
        below = (category, rule) in BELOW
        if auto_off and human is not None and (human <= ai if below else human >= ai):
            return F.lit(False)
        return F.coalesce(value < ai if below else value > ai, F.lit(False))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, r, ai, human, off) for (c, r), (ai, human, off) in sorted(self.rules.items())]
        return spark.createDataFrame(rows, "category string, rule string, ai_threshold double, human_baseline double, disabled boolean")


def merged(base: DataFrame, layer: DataFrame) -> DataFrame:
    """Rule tables merged: what the layer sets wins, rules of either side stay."""
    keys = ["category", "rule"]
    values = ("ai_threshold", "human_baseline", "disabled")
    other = layer.withColumnsRenamed({v: f"new_{v}" for v in values})
    return base.join(other, keys, "full_outer").select(*keys, *(F.coalesce(f"new_{v}", v).alias(v) for v in values))


def preset_table(spark: SparkSession, preset: str) -> DataFrame:
    rows = [(c, r, *v) for (c, r), v in PRESETS[preset].items()]
    return spark.createDataFrame(rows, "category string, rule string, ai_threshold double, human_baseline double, disabled boolean")


# What a publication may say.
ALLOWED = {
    "media": ["blog", "book", "technical-book", "technical-docs", "academic", "casual", "business", "technical"],
    "audience": ["general", "technical", "academic", "beginner"],
    "length": ["short", "medium", "long"],
}


def validate(config: DataFrame) -> DataFrame:
    """config: field, value.  One row an error: a value that its field doesn't allow."""
    spark = config.sparkSession
    allowed = spark.createDataFrame([(f, v) for f, vs in ALLOWED.items() for v in vs], "field string, value string")
    return config.where(F.col("field").isin(list(ALLOWED))).join(F.broadcast(allowed), ["field", "value"], "left_anti").select("field", "value", F.concat(F.lit("not allowed for "), "field").alias("error"))

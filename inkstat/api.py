"""One call from texts to verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import resolve
from .functions.text import prose
from .operators import ensemble, ngrams, scores, syntax, verdicts

#: From documents (doc_id, text) to rows of doc_id, tool, classification, confidence, signals.
Scorer = Callable[[DataFrame], DataFrame]
TOOLS = (*verdicts.TOOLS, "ngram", "syntactic")


def tool_rows(docs: DataFrame, config=None, tools: tuple[str, ...] = TOOLS, scorers: tuple[Scorer, ...] = (), markdown: bool = False) -> DataFrame:
    """A row a document and tool.  markdown: the texts' prose is taken first."""
    rules = resolve.rules_of(resolve.resolve(config))
    docs = docs.select("doc_id", (prose(F.col("text")) if markdown else F.col("text")).alias("text"))
    parts = []
    if own := tuple(t for t in tools if t in verdicts.TOOLS):
        parts.append(verdicts.tool_rows(docs, own, rules))
    if "ngram" in tools:
        parts.append(scores.as_rows(ngrams.verdict(docs, rules), "ngram"))
    if "syntactic" in tools:
        parts.append(scores.as_rows(syntax.verdict(syntax.document_measures(syntax.sentence_measures(syntax.closed_classes(docs))), rules), "syntactic"))
    parts += [scorer(docs).select("doc_id", "tool", "classification", "confidence", "signals") for scorer in scorers]
    if not parts:
        raise ValueError("no tools")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def analyze(docs: DataFrame, config=None, fast: bool = False, **options) -> DataFrame:
    """One verdict a document by the full ensemble, or by the fast one of three tools.  config: whatever resolve.resolve takes."""
    if fast:
        return ensemble.fast(tool_rows(docs, config, **{"tools": ("vocabulary", "punctuation", "structure"), **options}))
    return ensemble.full(tool_rows(docs, config, **{"markdown": True, **options}))


def category_report(rows: DataFrame) -> DataFrame:
    """tool rows with the score and weight that they enter the full ensemble with, and their first three signals."""
    ok = F.col("classification") != "error"
    return rows.select(
        "doc_id", "tool", "classification", F.round("confidence", 6).alias("confidence"), F.when(ok, F.round(ensemble.full_score(), 6)).otherwise(0.5).alias("score"), F.when(ok, ensemble.weight(ensemble.FULL)).otherwise(0.0).alias("weight"),
        F.concat_ws("; ", F.slice("signals", 1, 3)).alias("key_signals"),
    )

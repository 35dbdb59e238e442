"""Sentence tables, deterministic cleanup, replacements and the fix plan."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import alternatives, bounded, paragraphs, sentences
from .offsets import PROTECTED

DASH = "—"


def sentence_table(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, more, sentence_id (from 1), paragraph (from 0), sentence, words: no sentence goes beyond its paragraph."""
    cut = F.flatten(F.transform(paragraphs(F.col("text")), lambda p, i: F.transform(sentences(p), lambda s: F.struct(i.alias("paragraph"), s.alias("sentence")))))
    # outer: Spark would cut the text twice, to filter and to explode
    rows = docs.select("doc_id", *more, F.posexplode_outer(cut).alias("i", "s")).where("s is not null")
    return rows.select(*(c for c in rows.columns if c not in ("i", "s")), (F.col("i") + 1).cast("long").alias("sentence_id"), F.col("s.paragraph").cast("long").alias("paragraph"), "s.sentence", F.regexp_count("s.sentence", F.lit(r"\S+")).cast("long").alias("words"))


def marker_sentences(docs: DataFrame) -> DataFrame:
    """One row a sentence and vocabulary marker in it, however often."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("sentence", F.lit("(?i)" + bounded(alternatives(L.SENTENCE_MARKERS))), F.lit(1)), F.lower))
    rows = sentence_table(docs).select("doc_id", "sentence_id", F.explode(found).alias("marker"))
    spec = rows.sparkSession.createDataFrame([(k, m, s) for k, (m, s) in L.SENTENCE_MARKERS.items()], "marker string, multiplier double, severity string")
    return rows.join(F.broadcast(spec), "marker")  # a fixed list


def neighbours(docs: DataFrame) -> DataFrame:
    """Each sentence with the longest of the three before it, the nearest of equal ones: an antecedent's place."""
    w = Window.partitionBy("doc_id").orderBy("sentence_id")
    best = F.array_max(F.array_compact(F.array(*(F.when(F.lag("words", k).over(w).isNotNull(), F.struct(F.lag("words", k).over(w).alias("words"), F.lag("sentence_id", k).over(w).alias("id"))) for k in (1, 2, 3)))))
    return sentence_table(docs).select("doc_id", "sentence_id", best.getField("id").alias("antecedent"))


def align(spans: DataFrame, canonical: DataFrame) -> DataFrame:
    """Each span (doc_id, span_id, start, end) with the canonical one it overlaps most, the first of equals; none without overlap."""
    pairs = spans.alias("a").join(canonical.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")))
    overlap = F.least("a.end", "b.end") - F.greatest("a.start", "b.start")
    rows = pairs.select(F.col("a.doc_id").alias("doc_id"), F.col("a.span_id").alias("span_id"), F.col("b.span_id").alias("canonical_id"), overlap.alias("overlap"))
    order = Window.partitionBy("doc_id", "span_id").orderBy(F.desc("overlap"), "canonical_id")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


#: Cleanup rules in order: name, pattern, replacement.
CLEANUP = [
    ("em_dash_spacing", rf"(\S){DASH}(\S)", rf"$1 {DASH} $2"),
    ("em_dash_spacing", rf"(\S){DASH}(\s)", rf"$1 {DASH}$2"),
    ("em_dash_spacing", rf"(\s){DASH}(\S)", rf"$1{DASH} $2"),
    ("em_dash_spacing", rf" {{2,}}{DASH} +| +{DASH} {{2,}}", f" {DASH} "),
    ("double_hyphen_to_em_dash", r"(\s)--(\s)", rf"$1{DASH}$2"),
    ("doubled_words", r"(?i)\b(" + "|".join(L.DOUBLED) + r")\s+\1\b", "$1"),
    ("trailing_whitespace", r"(?md)[ \t]+$", ""),
    ("multiple_blank_lines", r"\n{4,}", "\n\n\n"),
]


def cleaned(text, dashes: bool = True) -> Column:
    """All rules over a text without protected parts; dashes: False leaves em dashes and hyphens alone."""
    for name, pattern, new in CLEANUP:
        if dashes or "dash" not in name:
            text = F.regexp_replace(text, pattern, new)
    return text


def clean_protected(docs: DataFrame, dashes: bool = True) -> DataFrame:
    """doc_id, cleaned, changes (rule -> count); front matter, fenced and inline code stay as they are.

    Texts without a sign that could protect anything (most) never leave the JVM.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = ~(F.contains("text", F.lit("`")) | F.contains("text", F.lit("~~~")) | F.startswith("text", F.lit("---")))
    rows, steps = docs.where(plain), []
    rows = rows.withColumn("t0", F.col("text"))
    for name, pattern, new in CLEANUP:
        if dashes or "dash" not in name:
            k = len(steps)
            rows = rows.withColumn(f"t{k + 1}", F.regexp_replace(f"t{k}", pattern, new))
            steps.append((name, F.when(F.col(f"t{k}") != F.col(f"t{k + 1}"), F.regexp_count(f"t{k}", F.lit(pattern))).otherwise(0).cast("long")))
    names = list(dict.fromkeys(name for name, _ in steps))
    sums = [F.struct(F.lit(name), sum(n for own, n in steps if own == name)) for name in names]
    native = rows.select("doc_id", F.col(f"t{len(steps)}").alias("cleaned"), F.map_filter(F.map_from_entries(F.array(*sums)), lambda _, n: n > 0).alias("changes"))
    return native.unionByName(_clean_with_ranges(docs.where(~plain), dashes))


def clean_changes(docs: DataFrame, dashes: bool = True) -> DataFrame:
    """doc_id, rule, line, before, after, context: every change of the cleanup, its place told in the text as the rules before left it."""
    rules = [(n, re.compile(p.replace("(?md)", "(?m)"), re.ASCII), re.sub(r"\$(\d)", r"\\\1", new)) for n, p, new in CLEANUP if dashes or "dash" not in n]

    def one(doc_id, text: str):
        for name, pattern, new in rules:
            kept, done = [m.span() for m in PROTECTED.finditer(text)], []

            def put(m, name=name, new=new, kept=kept, done=done, text=text):
                if any(a <= m.start() < b for a, b in kept):
                    return m[0]
                after = m.expand(new)
                a, b = max(0, m.start() - 30), min(len(text), m.end() + 30)
                around = ("..." if a else "") + text[a:b].replace("\n", "\\n") + ("..." if b < len(text) else "")
                done.append((doc_id, name, text.count("\n", 0, m.start()) + 1, m[0], after, around))
                return after

            text = pattern.sub(put, text)
            yield from done

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([c for doc_id, t in zip(frame["doc_id"], frame["text"]) for c in one(doc_id, t)], columns=["doc_id", "rule", "line", "before", "after", "context"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(reduce(lambda a, b: a | b, [F.col("text").rlike(p) for n, p, _ in CLEANUP if dashes or "dash" not in n]))
    return rows.mapInPandas(run, "doc_id long, rule string, line long, before string, after string, context string")


def _clean_with_ranges(docs: DataFrame, dashes: bool) -> DataFrame:
    rules = [(n, re.compile(p.replace("(?md)", "(?m)"), re.ASCII), re.sub(r"\$(\d)", r"\\\1", new)) for n, p, new in CLEANUP if dashes or "dash" not in n]

    def one(text: str) -> tuple[str, dict]:
        changes: dict[str, int] = {}
        for name, pattern, new in rules:
            kept = [m.span() for m in PROTECTED.finditer(text)]

            def put(m, name=name, new=new, kept=kept):
                if any(a <= m.start() < b for a, b in kept):
                    return m[0]
                changes[name] = changes.get(name, 0) + 1
                return m.expand(new)

            text = pattern.sub(put, text)
        return text, changes

    def run(frames):
        for frame in frames:
            made = [one(t or "") for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "cleaned": [t for t, _ in made], "changes": [c for _, c in made]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, cleaned string, changes map<string,long>")


def replaced(docs: DataFrame, replacements: DataFrame) -> DataFrame:
    """doc_id, text with its sentences exchanged, applied, missed.

    replacements: doc_id, id, original (null: not checked), text.  A sentence is
    found by its id if it reads as the original, else by content, else by content
    with any white space; from the end backwards, so that places stay right.
    """
    def run(frames):
        for frame in frames:
            out = []
            for doc_id, text, items in zip(frame["doc_id"], frame["text"], frame["items"]):
                text = text or ""
                spans = [(m.start(), m.end()) for m in re.finditer(r"\S(?:[^.!?]|[.!?](?!\s))*[.!?]*", text)]
                found, missed = [], 0
                for item in [] if items is None else items:
                    k, original = item["id"], item["original"]
                    own = spans[k - 1] if k is not None and 0 < k <= len(spans) else None
                    same = own and (original is None or re.sub(r"\s+", " ", text[own[0] : own[1]]).strip() == re.sub(r"\s+", " ", original).strip())
                    if same:
                        found.append((*own, item["text"]))
                    elif original and (at := text.find(original)) >= 0:
                        found.append((at, at + len(original), item["text"]))
                    elif original and original.split() and (m := re.search(r"\s+".join(map(re.escape, original.split())), text)):
                        found.append((*m.span(), item["text"]))
                    else:
                        missed += 1
                for a, b, new in sorted(found, reverse=True):
                    text = text[:a] + (new or "") + text[b:]
                out.append((doc_id, text, len(found), missed))
            yield pd.DataFrame(out, columns=["doc_id", "text", "applied", "missed"])

    items = replacements.groupBy("doc_id").agg(F.collect_list(F.struct("id", "original", "text")).alias("items"))
    return docs.select("doc_id", "text").join(items, "doc_id").mapInPandas(run, "doc_id long, text string, applied long, missed long")


def greedy(flags: list[tuple], left: dict[str, float]) -> list[int]:
    """Sentences in the order in which they are chosen: those that serve most tools first, then by priority and place, until every budget is spent.

    flags: sentence_id, tool, priority (a number), contribution; left: each tool's budget.
    """
    of: dict[int, list[tuple]] = {}
    for sentence, *flag in flags:
        of.setdefault(sentence, []).append(flag)
    left, out = dict(left), []
    for sentence in sorted(of, key=lambda k: (-len({tool for tool, _, _ in of[k]}), -sum(p for _, p, _ in of[k]), k)):
        if all(v <= 0 for v in left.values()):
            break
        if any(left.get(tool, 0) > 0 for tool, _, _ in of[sentence]):
            out.append(sentence)
            for tool, _, contribution in of[sentence]:
                if tool in left:
                    left[tool] -= contribution
    return out


def fix_plan(issues: DataFrame, budgets: DataFrame) -> DataFrame:
    """doc_id, sentence_id, place: sentences to rewrite, by `greedy`, a document at a time.

    issues: doc_id, sentence_id, tool, priority, contribution; budgets: doc_id, tool, excess.
    """
    rows = issues.groupBy("doc_id").agg(F.collect_list(F.struct("sentence_id", "tool", "priority", "contribution")).alias("flags"))
    rows = rows.join(budgets.groupBy("doc_id").agg(F.collect_list(F.struct("tool", "excess")).alias("budgets")), "doc_id")

    def run(frames):
        for frame in frames:
            made = [(doc_id, sentence, place) for doc_id, flags, left in zip(frame["doc_id"], frame["flags"], frame["budgets"]) for place, sentence in enumerate(greedy([tuple(f.values()) for f in flags], {b["tool"]: b["excess"] for b in left}), 1)]
            yield pd.DataFrame(made, columns=["doc_id", "sentence_id", "place"])

    return rows.mapInPandas(run, "doc_id long, sentence_id long, place long")

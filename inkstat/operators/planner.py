"""From the analyses' flags to a plan of rewriting: issues, budgets, the greedy choice, constraints, verdict.

Documents are read once: the JVM cuts the sentences, Python workers do the rest
a document at a time, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import count_literal, count_words, paragraphs, sentences
from . import editing, flags
from . import syntax as X

SCORES, TARGETS = flags.SCORES, flags.TARGETS

#: Documents that a worker hands on at once.
CHUNK = 256

ISSUES = "sentence_id long, tool string, priority string, contribution double, instruction string"
FLAG = [("sentence_id", pa.int64()), ("tool", pa.string()), ("score", pa.int32()), ("contribution", pa.float64()), ("priority", pa.string()), ("instruction", pa.string())]
BUDGET = [("tool", pa.string()), ("current", pa.float64()), ("target", pa.float64()), ("excess", pa.float64())]
GATHERED = "flags array<struct<sentence_id:long,tool:string,score:int,contribution:double,priority:string,instruction:string>>, budgets array<struct<tool:string,current:double,target:double,excess:double>>"
CONSTRAINT = [("tool", pa.string()), ("priority", pa.string()), ("instruction", pa.string())]
PLAN = "place long, issue_count long, constraints array<struct<tool:string,priority:string,instruction:string>>, paragraph long, text string"


def score(priority: Column) -> Column:
    out = F.lit(0)
    for name, n in SCORES.items():
        out = F.when(priority == name, n).otherwise(out)
    return out


def _cut(docs: DataFrame) -> DataFrame:
    """doc_id, cut (paragraph and text of the sentences of sentence_table(), in order), dashes, all_words."""
    text = F.col("text")
    cut = F.flatten(F.transform(paragraphs(text), lambda p, i: F.transform(sentences(p), lambda s: F.struct(i.alias("paragraph"), s.alias("sentence")))))
    return docs.select("doc_id", cut.alias("cut"), count_literal(text, "—").alias("dashes"), count_words(text).alias("all_words"))


def _read(docs: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """_cut(), with the sentences' measures where a parse is given; without one, workers measure by word lists."""
    rows = _cut(docs)
    if parsed is None:
        return rows
    measures = X.sentence_measures(parsed).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*flags.Sentence._fields))).alias("measures"))
    return rows.join(measures, "doc_id", "left")


def _lists(column) -> list[list]:
    """An Arrow list column as Python lists; no list is an empty one."""
    return [v or [] for v in column.to_pylist()]


def _sentences(column) -> list[list[tuple[int, str]]]:
    flat, out, at = column.flatten(), [], 0
    made = list(zip(flat.field("paragraph").to_pylist(), flat.field("sentence").to_pylist()))
    for n in pc.list_value_length(column).to_pylist():
        out.append(made[at : at + (n or 0)])
        at += n or 0
    return out


def _by_document(rows: DataFrame, schema: str, one: Callable[[dict], list[tuple]], names: list[str], types: list[pa.DataType]) -> DataFrame:
    """doc_id and what `one` tells of each document (a dict of its columns), a row each; schema: of these columns, without doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                columns = {}
                for name in batch.schema.names:
                    column = batch.column(name)
                    columns[name] = _sentences(column) if name == "cut" else _lists(column) if pa.types.is_list(column.type) else column if name == "doc_id" else column.to_pylist()
                of, made = [], []
                for k in range(batch.num_rows):
                    told = one({name: values[k] for name, values in columns.items() if name != "doc_id"})
                    of += [k] * len(told)
                    made += told
                ids = columns["doc_id"].take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([m[j] for m in made], t) for j, t in enumerate(types))], ["doc_id", *names])

    fields = [StructField("doc_id", rows.schema["doc_id"].dataType), *StructType.fromDDL(schema).fields]
    return rows.mapInArrow(run, StructType(fields))


def _measures(doc: dict) -> list[flags.Sentence]:
    if "measures" in doc:
        return [flags.Sentence(**m) for m in doc["measures"]]
    return [flags.measured(i, paragraph, sentence) for i, (paragraph, sentence) in enumerate(doc["cut"], 1)]


def _issues(doc: dict) -> list[tuple]:
    return flags.issues(_measures(doc), doc["cut"], doc["all_words"] or 0)


def _gathered(doc: dict) -> tuple[list[tuple], list[tuple]]:
    """Flags in order and budgets."""
    rows = _measures(doc)
    if "found" in doc:
        found = flags.ordered([tuple(f.values()) for f in doc["found"]])
    else:
        found = flags.ordered(flags.issues(rows, doc["cut"], doc["all_words"] or 0))
    return found, flags.budgets(rows, found, doc["dashes"] or 0, doc["all_words"] or 0)


def _chosen(found: list[tuple], left: list[tuple]) -> list[tuple]:
    """(place, sentence_id, constraints) of the sentences to rewrite; of a tool's flags the highest stands, the first of equal ones."""
    chosen = editing.greedy([f[:4] for f in found], {b[0]: b[3] for b in left})
    best: dict = {sentence: {} for sentence in chosen}
    for f in found:
        own = best.get(f[0])
        if own is not None and (f[1] not in own or own[f[1]][2] < f[2]):
            own[f[1]] = f
    kept = lambda sentence: sorted(best[sentence].values(), key=lambda f: (-f[2], f[1]))
    return [(place, sentence, [{"tool": f[1], "priority": f[4], "instruction": f[5]} for f in kept(sentence)]) for place, sentence in enumerate(chosen, 1)]


def _planned(doc: dict) -> list[tuple]:
    found, left = (doc["flags"], doc["budgets"]) if "flags" in doc else _gathered(doc)
    if "flags" in doc:
        found, left = ([tuple(x[k] for k, _ in kind) for x in part] for part, kind in ((found, FLAG), (left, BUDGET)))
    n = len(doc["cut"])
    return [(sentence, place, len(kept), kept, *doc["cut"][sentence - 1]) for place, sentence, kept in _chosen(found, left) if 0 < sentence <= n]


def issues(docs: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """doc_id, sentence_id, tool, priority, contribution, instruction: what six analyses want changed, one row a flag.

    All of them number the sentences of one table.  parsed: the sentences' parse, by default that of word lists.
    """
    types = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]
    return _by_document(_read(docs, parsed), ISSUES, _issues, ["sentence_id", "tool", "priority", "contribution", "instruction"], types)


def gathered(docs: DataFrame, found: DataFrame | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """doc_id, flags, budgets: a document's issues and what each tool wants changed (tool, current, target, excess; only tools that want anything).

    Auxiliaries and pronouns count words beyond their target, punctuation dashes
    beyond its own or else its issues, the others their flags.  found: issues to
    take instead of those of issues(); documents without any are left out.
    """
    rows = _read(docs, parsed)
    if found is not None:
        own = found.groupBy("doc_id").agg(F.collect_list(F.struct("sentence_id", "tool", "priority", "contribution", "instruction")).alias("found"))
        rows = rows.join(own, "doc_id")

    def one(doc: dict) -> list[tuple]:
        told, left = _gathered(doc)
        laid = lambda rows, kind: [dict(zip([k for k, _ in kind], r)) for r in rows]
        return [(laid(told, FLAG), laid(left, BUDGET))] if told else []

    return _by_document(rows, GATHERED, one, ["flags", "budgets"], [pa.list_(pa.struct(FLAG)), pa.list_(pa.struct(BUDGET))])


def budgets(rows: DataFrame) -> DataFrame:
    """doc_id, tool, current, target, excess; rows: of gathered()."""
    return rows.select("doc_id", F.explode_outer("budgets").alias("b")).where("b is not null").select("doc_id", "b.*")


def plan(docs: DataFrame, rows: DataFrame | None = None, parsed: DataFrame | None = None) -> DataFrame:
    """doc_id, place, sentence_id, issue_count, constraints (tool, priority, instruction; the highest first, one a tool), paragraph, text.

    rows: of gathered(); without them, issues are found and planned in one pass.
    """
    rows = _read(docs, parsed) if rows is None else _cut(docs).select("doc_id", "cut").join(rows, "doc_id")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct(CONSTRAINT)), pa.int64(), pa.string()]
    return _by_document(rows, "sentence_id long, " + PLAN, _planned, ["sentence_id", "place", "issue_count", "constraints", "paragraph", "text"], types)


def verdict(docs: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """doc_id, to_rewrite, verdict: approved where nothing is planned.

    planned: of plan(); without it, documents are planned and counted in one pass.
    """
    if planned is None:
        rows = _by_document(_read(docs), "to_rewrite long", lambda doc: [(len(_chosen(*_gathered(doc))),)], ["to_rewrite"], [pa.int64()])
    else:
        n = planned.groupBy("doc_id").agg(F.count("*").alias("n"))
        rows = docs.select("doc_id").join(n, "doc_id", "left").withColumn("to_rewrite", F.coalesce("n", F.lit(0)))
    return rows.select("doc_id", "to_rewrite", F.when(F.col("to_rewrite") == 0, "approved").otherwise("needs-revision").alias("verdict"))

"""Analyses of parsed sentences.

A parse is a row a sentence: doc_id, sentence_id, paragraph, tokens, an array
of (text, lemma, pos, dep, head), where head is a place in the array and the
root is its own head.  Any parser can supply it (a function from documents to
such rows); `closed_classes` is a rule-based stand-in.  Sentence measures are
projections of the array, documents group sentences once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..config.rules import Rules
from . import verdicts
from .editing import sentence_table

#: Words with their contractions, and single signs.
TOKEN = r"[A-Za-z]+(?:'[a-z]+)?|[^\sA-Za-z]"

# Auxiliary verbs by form.
AUXILIARIES = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "be": "be", "been": "be", "being": "be", "have": "have", "has": "have", "had": "have", "do": "do", "does": "do", "did": "do",
    "will": "will", "would": "would", "shall": "shall", "should": "should", "can": "can", "could": "could", "may": "may", "might": "might", "must": "must",
}
# Pronouns that open a sentence.
PRONOUNS = [
    "i", "me", "my", "mine", "myself", "you", "your", "yours", "yourself", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "we", "us", "our", "ours", "ourselves",
    "they", "them", "their", "theirs", "themselves", "this", "that", "these", "those",
]
# Vague references.
VAGUE = ["this", "that", "it", "these", "those", "thing", "things", "stuff", "something", "everything", "nothing", "anything", "aspect", "area", "way", "part", "kind", "type", "sort"]
# Dependency labels of clauses and of coordination.
CLAUSES, COORDINATION = ["ccomp", "xcomp", "advcl", "relcl", "acl", "csubj"], ["cc", "conj"]

COORDINATORS = ["and", "but", "or", "nor", "yet"]
SUBORDINATORS = ["because", "although", "though", "while", "since", "when", "if", "unless", "until", "which", "who"]
PRIORITIES = ["critical", "high", "medium", "low"]


def closed_classes(docs: DataFrame) -> DataFrame:
    """A parse by word lists: closed classes by form; all other words count as nouns from five letters on.

    A subordinator opens a clause (advcl) that what follows hangs on.
    """
    lemma = F.create_map(*(F.lit(x) for kv in AUXILIARIES.items() for x in kv))
    rows = sentence_table(docs).select("doc_id", "sentence_id", "paragraph", F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0)).alias("w"))
    rows = rows.withColumn("low", F.transform("w", F.lower))
    rows = rows.withColumn("opens", F.filter(F.transform("low", lambda x, i: F.when((i > 0) & x.isin(SUBORDINATORS), i)), lambda i: i.isNotNull()))
    pos = lambda x, i: (
        F.when(x.isin(list(AUXILIARIES)), "AUX").when(x.isin(PRONOUNS), "PRON").when(x.isin(COORDINATORS), "CCONJ").when(x.isin(SUBORDINATORS), "SCONJ").when(~F.get("w", i).rlike("^[A-Za-z]"), "PUNCT")
        .when(F.length(x) >= 5, "NOUN").otherwise("X")
    )
    rows = rows.withColumn("pos", F.transform("low", pos))
    token = lambda x, i: F.struct(
        F.get("w", i).alias("text"), F.when(F.get("pos", i) == "AUX", F.try_element_at(lemma, x)).otherwise(x).alias("lemma"), F.get("pos", i).alias("pos"),
        F.when(F.get("pos", i) == "SCONJ", "advcl").when(F.get("pos", i) == "CCONJ", "cc").otherwise("dep").alias("dep"), F.coalesce(F.array_max(F.filter("opens", lambda o: o < i)), F.lit(0)).alias("head"),
    )
    return rows.select("doc_id", "sentence_id", "paragraph", F.transform("low", token).alias("tokens"))


@F.pandas_udf(LongType())
def height(heads: pd.Series) -> pd.Series:
    """Edges of the longest path down from the root; a cycle ends after as many steps as there are tokens."""

    sizes = heads.map(len).to_numpy()
    out = np.zeros(len(heads), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        at = np.concatenate(heads.to_numpy()[some]).astype(np.int64) + np.repeat(first, sizes[some])
        depth = (at != np.arange(len(at))).astype(np.int64)
        for _ in range(int(sizes.max()).bit_length()):  # follow heads of heads, in all sentences at once
            depth, at = depth + depth[at], at[at]
        out[some] = np.minimum(np.maximum.reduceat(depth, first), sizes[some])
    return pd.Series(out)


def sentence_measures(parsed: DataFrame) -> DataFrame:
    """One row a sentence: words, aux, pronouns, nouns, vague, clauses, coordinations, kind, depth, its children and parents, shares in percent."""
    n = lambda test: F.size(F.filter("tokens", test)).cast("long")
    share = lambda c: F.when(F.col("words") > 0, F.round(F.col(c) * 100.0 / F.col("words"), 2)).otherwise(0.0)
    first = F.split(F.lower(F.get("tokens", 0)["text"]), "'")[0]
    heads = F.transform("tokens", lambda t: t["head"])
    children = F.filter(F.transform("tokens", lambda t, i: F.when(t["head"] != i, t["head"])), lambda h: h.isNotNull())
    rows = parsed.select(
        "doc_id", "sentence_id", "paragraph", F.size("tokens").cast("long").alias("tokens_all"), n(lambda t: t["pos"] != "PUNCT").alias("words"), n(lambda t: t["pos"] == "AUX").alias("aux"), n(lambda t: t["pos"] == "PRON").alias("pronouns"),
        n(lambda t: t["pos"].isin("NOUN", "PROPN")).alias("nouns"), n(lambda t: F.lower(t["text"]).isin(VAGUE)).alias("vague"), n(lambda t: t["dep"].isin(CLAUSES)).alias("clauses"), n(lambda t: t["dep"].isin(COORDINATION)).alias("coordinations"),
        height(heads).alias("depth"), F.coalesce(first.isin(PRONOUNS), F.lit(False)).alias("opens_with_pronoun"), F.size(children).cast("long").alias("children"), F.size(F.array_distinct(children)).cast("long").alias("parents"),
    )
    kind = F.when((F.col("clauses") > 0) & (F.col("coordinations") > 0), "compound_complex").when(F.col("clauses") > 0, "complex").when(F.col("coordinations") > 0, "compound").otherwise("simple")
    return rows.select("*", kind.alias("kind"), share("aux").alias("aux_share"), share("pronouns").alias("pronoun_share"), share("nouns").alias("noun_share"))


def document_measures(sentences: DataFrame) -> DataFrame:
    """One row a document from its sentences' measures."""
    kinds = ["simple", "compound", "complex", "compound_complex"]
    percent = lambda c: F.when(F.col("words") > 0, F.round(F.col(c) * 100.0 / F.col("words"), 2)).otherwise(0.0)
    sums = ["words", "aux", "pronouns", "nouns", "clauses", "children", "parents"]
    deviation = F.coalesce(F.stddev_samp("tokens_all"), F.lit(0.0))
    rows = sentences.groupBy("doc_id").agg(
        F.count("*").alias("sentences"), *(F.sum(c).alias(c) for c in sums), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.avg("depth").alias("depth_mean"), F.max("depth").alias("depth_max"),
        F.coalesce(F.var_samp("depth"), F.lit(0.0)).alias("depth_variance"), F.avg("tokens_all").alias("length_mean"), deviation.alias("length_deviation"),
    )
    uniformity = F.when(F.col("length_mean") > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("length_deviation") / F.col("length_mean"))), 3)).otherwise(1.0)
    return rows.select(
        "*", *(F.round(F.col(k) / F.col("sentences"), 4).alias(f"{k}_ratio") for k in kinds), percent("aux").alias("aux_share"), percent("pronouns").alias("pronoun_share"), percent("nouns").alias("noun_share"),
        F.round(F.coalesce(F.try_divide("children", "parents"), F.lit(0.0)), 2).alias("branching"), F.round(F.col("clauses") / F.col("sentences"), 2).alias("clauses_per_sentence"), uniformity.alias("uniformity"),
    )


def pos_shares(parsed: DataFrame) -> DataFrame:
    """doc_id, pos, share: percent of the words, punctuation left out."""
    counts = parsed.select("doc_id", F.explode_outer("tokens").alias("t")).where("t.pos != 'PUNCT'").groupBy("doc_id", F.col("t.pos").alias("pos")).agg(F.count("*").alias("n"))
    return counts.select("doc_id", "pos", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("doc_id")), 2).alias("share"))


def verdict(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """documents with classification and confidence; the sum of points never falls below the human bound, which is kept."""
    c = F.col
    flag = lambda rule, col: rules.flags("syntactic", rule, c(col), auto_off=False)
    points = (
        F.when(c("compound_complex_ratio") < 0.05, 25).when(c("compound_complex_ratio") > 0.15, -15).otherwise(0) + F.when(c("depth_variance") < 1, 25).when(c("depth_variance") > 2, -15).otherwise(0)
        + F.when(flag("avg_dependency_depth", "depth_mean"), 20).otherwise(0) + F.when(c("aux_share") > 5.5, 15).otherwise(0) + F.when(flag("sentence_type_uniformity", "uniformity"), 15).otherwise(0)
    )
    classification, confidence = verdicts.cases((points > 30, verdicts.AI, F.abs(points) / 100), (points < -30, verdicts.HUMAN, F.abs(points) / 100), (None, verdicts.UNSURE, F.abs(points) / 100))
    flags = [c("compound_complex_ratio") < 0.05, c("depth_variance") < 1, flag("avg_dependency_depth", "depth_mean"), flag("sentence_type_uniformity", "uniformity"), c("aux_share") > 5.5, c("noun_share") < 18, c("pronoun_share") > 7]
    return documents.select("*", classification.alias("classification"), confidence.alias("confidence"), verdicts.named(flags, SIGNALS).alias("signals"))


SIGNALS = ["no compound-complex sentences", "low variance of depth", "shallow dependencies", "uniform sentence types", "many auxiliaries", "few nouns", "many pronouns"]


def _with_totals(sentences: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    doc = Window.partitionBy("doc_id")
    rows = sentences.select("*", *(F.sum(c).over(doc).alias(f"all_{c}") for c in ("words", *columns)))
    return rows.select("*", *(F.when(F.col("all_words") > 0, F.round(F.col(f"all_{c}") * 100.0 / F.col("all_words"), 2)).otherwise(0.0).alias(f"doc_{c}") for c in columns))


def _budgeted(rows: DataFrame, order: list[Column], gain: Column, budget: Column) -> DataFrame:
    """Rows in order until those before have gained the budget; the first always."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    before = F.sum("__gain").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__gain", gain).withColumn("__before", before).withColumn("place", F.row_number().over(w))
    return rows.where((F.col("place") == 1) | (F.col("__before") < budget)).drop("__gain", "__before")


def auxiliary_flags(sentences: DataFrame, target: float = 3.0) -> DataFrame:
    """Sentences to relieve of auxiliaries, in documents above the target share: most auxiliaries first, until the excess is spent."""
    rows = _with_totals(sentences, ("aux",))
    excess = F.greatest(F.lit(0), F.floor(F.col("all_aux") - F.lit(target) / 100 * F.col("all_words") + 0.5))
    priority = (
        F.when((F.col("aux_share") > 15) | (F.col("aux") >= 4), "critical").when((F.col("aux_share") > 10) | (F.col("aux") >= 3), "high")
        .when((F.col("aux_share") > F.col("doc_aux") * 1.5) | (F.col("aux") >= 2), "medium").otherwise("low")
    )
    rows = rows.where((F.col("doc_aux") > target) & (F.col("aux") > 0))
    found = _budgeted(rows, [F.desc("aux"), F.desc("aux_share"), F.col("sentence_id")], F.least(F.col("aux"), F.lit(2)), excess)
    return found.select("doc_id", "sentence_id", "aux", "aux_share", priority.alias("priority"), "place")


def top_auxiliaries(parsed: DataFrame, k: int = 5) -> DataFrame:
    """Each document's most frequent auxiliary lemmas."""
    counts = parsed.select("doc_id", F.explode_outer("tokens").alias("t")).where("t.pos = 'AUX'").groupBy("doc_id", F.col("t.lemma").alias("lemma")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "lemma"))).where(F.col("rank") <= k)


def noun_flags(sentences: DataFrame, target: float = 18.0) -> DataFrame:
    """Sentences short of nouns, in documents below the target share; worst first, two nouns gained by each, until the deficit is spent."""
    c = F.col
    rows = _with_totals(sentences, ("nouns",)).where((c("doc_nouns") < target) & (c("words") >= 4) & (c("noun_share") < target))
    issue = (
        F.when((c("noun_share") < 10) & (c("pronoun_share") > 15), "low_noun_high_pronoun").when((c("noun_share") < 10) & (c("aux_share") > 10), "low_noun_high_aux").when(c("vague") > 0, "vague_references")
        .when(c("noun_share") < c("doc_nouns") * 0.7, "low_noun_general")
    )
    grade = F.when(c("issue").isin("low_noun_high_pronoun", "low_noun_high_aux"), 0).when(c("issue") == "vague_references", F.when(c("vague") >= 2, 1).otherwise(2)).otherwise(F.when(c("noun_share") < 8, 1).otherwise(2))
    rows = rows.withColumn("issue", issue).where("issue is not null").withColumn("grade", grade)
    deficit = F.greatest(F.lit(0), F.floor(F.lit(target) / 100 * c("all_words") - c("all_nouns") + 0.5))
    found = _budgeted(rows, [c("grade"), c("noun_share"), c("sentence_id")], F.lit(2), deficit)
    return found.select("doc_id", "sentence_id", "issue", F.element_at(F.array(*map(F.lit, PRIORITIES)), c("grade") + 1).alias("priority"), "noun_share", "place")


def pronoun_targets(sentences: DataFrame) -> DataFrame:
    """Sentences with many pronouns and the one of the three before, at most a paragraph back, with most nouns (the nearest of equals; else the one before)."""
    rows = _with_totals(sentences, ("pronouns",))
    w = Window.partitionBy("doc_id").orderBy("sentence_id")
    back = lambda k: F.when(F.lag("paragraph", k).over(w) >= F.col("paragraph") - 1, F.struct(F.lag("nouns", k).over(w).alias("nouns"), F.lag("sentence_id", k).over(w).alias("id")))
    best = F.array_max(F.array_compact(F.array(*(back(k) for k in (1, 2, 3)))))
    rows = rows.select("*", best.alias("best"), F.lag("sentence_id").over(w).alias("previous"))
    target = (F.col("pronoun_share") > F.col("doc_pronouns") * 1.5) | (F.col("pronouns") >= 2) | F.col("opens_with_pronoun")
    return rows.where(target).select("doc_id", "sentence_id", "pronouns", "pronoun_share", "doc_pronouns", F.when(F.col("best.nouns") > 0, F.col("best.id")).otherwise(F.col("previous")).alias("antecedent"))


def pronoun_groups(targets: DataFrame) -> DataFrame:
    """doc_id, group_id (its smallest sentence), members: targets and antecedents that share a sentence, merged to the end; a document at a time."""

    def run(frames):
        for frame in frames:
            out = []
            for doc_id, pairs in zip(frame["doc_id"], frame["pairs"]):
                up: dict[int, int] = {}

                def root(i, up=up):
                    while up.setdefault(i, i) != i:
                        up[i] = up[up[i]]
                        i = up[i]
                    return i

                for p in pairs:
                    a, b = root(p["sentence_id"]), root(p["sentence_id"] if p["antecedent"] is None else p["antecedent"])
                    up[max(a, b)] = min(a, b)
                groups: dict[int, list[int]] = {}
                for i in sorted(up):
                    groups.setdefault(root(i), []).append(i)
                out += [(doc_id, g, members) for g, members in groups.items()]
            yield pd.DataFrame(out, columns=["doc_id", "group_id", "members"])

    pairs = targets.groupBy("doc_id").agg(F.collect_list(F.struct("sentence_id", "antecedent")).alias("pairs"))
    return pairs.mapInPandas(run, "doc_id long, group_id long, members array<long>")


def structure_flags(sentences: DataFrame) -> DataFrame:
    """Sentences of more than six words to rework, in order and within the document's budget: simple ones shallower than the mean to merge or deepen, compound ones to subordinate.

    A neighbour of the same paragraph is a merge candidate if it is simple too and both hold fewer than forty words.
    """
    c, doc = F.col, Window.partitionBy("doc_id")
    order = doc.orderBy("sentence_id")
    mean, spread = F.avg("tokens_all").over(doc), F.coalesce(F.stddev_samp("tokens_all").over(doc), F.lit(0.0))
    rows = sentences.select(
        "*", F.count("*").over(doc).alias("n"), F.count_if(c("kind") == "simple").over(doc).alias("simples"), F.count_if(c("kind") == "compound_complex").over(doc).alias("both"), F.avg("depth").over(doc).alias("depth_mean"),
        F.coalesce(F.var_samp("depth").over(doc), F.lit(0.0)).alias("depth_variance"), F.when(mean > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - spread / mean)), 3)).otherwise(1.0).alias("uniformity"),
        *(F.when((f("kind").over(order) == "simple") & (f("paragraph").over(order) == c("paragraph")) & (f("words").over(order) + c("words") < 40), f("sentence_id").over(order)).alias(k) for k, f in (("next", F.lead), ("last", F.lag))),
    )
    few, shallow, even, flat = c("both") / c("n") < 0.05, c("depth_mean") < 5, c("uniformity") > 0.8, c("depth_variance") < 1
    merge = F.coalesce("next", "last")
    plain = (c("kind") == "simple") & (c("depth") < c("depth_mean"))
    priority = (
        F.when(~plain, F.when((c("kind") == "compound") & few & (c("clauses") == 0), "medium")).when(few & merge.isNotNull(), "critical").when(shallow, F.when(c("depth") <= 2, "high").otherwise("medium"))
        .when(even & (c("words") < 8), "medium").when(even | flat, "low")
    )
    rows = rows.where(c("words") > 6).select("*", priority.alias("priority"), F.when(plain, merge).alias("merge_with")).where("priority is not null")
    budget = F.least(F.greatest(F.lit(0), F.ceil(c("n") * 0.06) - c("both")) + 3, F.ceil(c("simples") * 0.3))
    return rows.withColumn("place", F.row_number().over(order)).where(c("place") <= budget).select("doc_id", "sentence_id", "priority", "depth", "words", "merge_with", "place")


# Indefinite pronouns.
INDEFINITE = [
    "anyone", "anything", "everybody", "everyone", "everything", "nobody", "nothing", "somebody", "someone", "something", "one", "none", "all", "any", "each", "either", "neither", "both", "few", "many", "several", "some",
]
# Other pronouns by type; what is left of PRONOUNS is personal.
TYPES = {"possessive": ["my", "your", "his", "its", "our", "their", "whose"], "demonstrative": ["this", "that", "these", "those"], "relative": ["who", "whom", "which"]}


def pronoun_types(parsed: DataFrame) -> DataFrame:
    """doc_id, type, n: pronouns by type, told by form; a demonstrative before a noun determines it and is none."""
    low = lambda t: F.lower(t["text"])
    follows = lambda i: F.coalesce(F.get("tokens", i + 1)["pos"].isin("NOUN", "PROPN"), F.lit(False))
    kind = lambda t, i: (
        F.when(low(t).isin(TYPES["demonstrative"]), F.when(~follows(i), "demonstrative")).when(low(t).isin(TYPES["possessive"]), "possessive").when(low(t).isin(TYPES["relative"]), "relative").when(low(t).isin(INDEFINITE), "indefinite").when(t["pos"] == "PRON", "personal")
    )
    rows = parsed.select("doc_id", F.explode_outer(F.array_compact(F.transform("tokens", kind))).alias("type")).where("type is not null")
    return rows.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def auxiliary_patterns(parsed: DataFrame) -> DataFrame:
    """doc_id, pattern, n: what auxiliaries do, by the one or two tokens behind them.

    Where the parse has no finer tags, a participle is told by its ending.
    """
    ing = lambda k: F.coalesce(F.lower(F.get("tokens", k)["text"]).rlike("^[a-z]+ing$"), F.lit(False))
    past = lambda k: F.coalesce(F.lower(F.get("tokens", k)["text"]).rlike("^[a-z]+(ed|en)$"), F.lit(False))
    lemma = lambda k: F.coalesce(F.get("tokens", k)["lemma"], F.lit(""))
    modal = [v for v in set(AUXILIARIES.values()) if v not in ("be", "have", "do")]
    kind = lambda t, i: F.when(
        t["pos"] == "AUX",
        F.when((t["lemma"] == "be") & ing(i + 1), "progressive").when((t["lemma"] == "be") & past(i + 1), "passive").when((t["lemma"] == "have") & past(i + 1), "perfect")
        .when(t["lemma"].isin(modal), F.when((lemma(i + 1) == "have") & past(i + 2), "modal_perfect").otherwise("modal")).when(t["lemma"] == "do", "do_emphasis").otherwise("other"),
    )
    rows = parsed.select("doc_id", F.explode_outer(F.array_compact(F.transform("tokens", kind))).alias("pattern")).where("pattern is not null")
    return rows.groupBy("doc_id", "pattern").agg(F.count("*").alias("n"))


#: Capitalised words in a row that do not begin a sentence: the entities of a text without a model.
ENTITY = "[a-z,;] ([A-Z][a-z]+(?: [A-Z][a-z]+)*)"


def topic_coherence(docs: DataFrame, entities: Column | None = None) -> DataFrame:
    """doc_id, entities, distinct, coherence (one less the share of distinct ones), top: five most frequent, ties in order of text.

    entities: an array of names, for a recogniser's result; by default capitalised runs.
    """
    rows = docs.select("doc_id", (F.regexp_extract_all("text", F.lit(ENTITY), F.lit(1)) if entities is None else entities).alias("e"))
    rows = rows.select("doc_id", F.coalesce("e", F.array().cast("array<string>")).alias("e")).withColumn("d", F.array_sort(F.array_distinct("e")))
    counted = F.transform("d", lambda w: F.struct((-F.size(F.filter("e", lambda x: x == w))).alias("n"), w.alias("w")))
    top = F.concat_ws("; ", F.transform(F.slice(F.array_sort(counted), 1, 5), lambda x: F.concat(x["w"], F.lit(" "), (-x["n"]).cast("string"))))
    n, k = F.size("e").cast("long"), F.size("d").cast("long")
    return rows.select("doc_id", n.alias("entities"), k.alias("distinct"), F.round(F.when(n > 0, 1 - k / n).otherwise(0.0), 2).alias("coherence"), top.alias("top"))

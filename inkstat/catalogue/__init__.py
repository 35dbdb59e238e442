"""Every query by name, with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import rules as R
from ..functions import lexicons as L
from ..functions import metrics as M
from ..functions import text as T
from .. import api
from ..operators import editing, ensemble, ngrams, planner, verdicts
from ..operators import scores as C
from ..operators import syntax as X
from ..plans import audit
from ..sources.corpus import tables
from ..streaming import streams
from . import dashes, markers, offsets, profiles, scores, syntax
from . import sql as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with doubled newlines and a sentence of markers by id; see sql.MARKERS."""
    tail = F.lit("")
    for k, v in S.MARKERS.items():
        tail = F.when(F.col("doc_id") % 8 == k, v).otherwise(tail)
    return tables(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat(F.regexp_replace("text", "\n", "\n\n"), tail).alias("text"))


def add(name: str, query, oracle: str | None = None, docs: bool = True) -> None:
    """docs: the query takes the marked documents; its SQL may name them docs."""
    QUERIES[name] = (lambda spark, sf_dir: query(documents(spark, sf_dir))) if docs else query
    if oracle:
        ORACLE_SQL[name] = f"WITH {S.DOCS} {oracle}" if docs else oracle


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in rows.dtypes))


def _sql_rounded(names: list[tuple[str, str]], source: str) -> str:
    cast = {"double": lambda n: f"round(CAST({n} AS DOUBLE), 6) AS {n}", "long": lambda n: f"CAST({n} AS BIGINT) AS {n}", "other": lambda n: n}
    return f"SELECT {', '.join(cast[k](n) for n, k in names)} FROM ({source})"


#: Which measures of a tool are whole numbers or truth values; the others are doubles.
_LONG = "words flags critical em_dashes stacked smart ellipsis dots semicolons brackets oxford not_oxford inside outside paragraphs bullets openings closings sections transitions transition_kinds sentences hedges cliches superlatives fillers".split()


def _kinds(names) -> list[tuple[str, str]]:
    return [("doc_id", "long"), *((n, "other" if n in ("mixed", "classification") else "long" if n in _LONG else "double") for n in names)]


def _tool_queries(tool: str, names: list[str]) -> None:
    add(f"{tool}_metrics", lambda d: rounded(verdicts.measured(d, (tool,)).select("doc_id", *(F.col(f"{tool}__{n}").alias(n) for n in names))), _sql_rounded(_kinds(names), S.layers(*S.TOOL_LAYERS[tool])))
    shown = ["classification", "confidence"]
    add(f"{tool}_verdict", lambda d: rounded(verdicts.verdict(d, tool).select("doc_id", *shown)), _sql_rounded(_kinds(shown), S.verdict(tool)))


_tool_queries("vocabulary", ["words", "flags", "critical", "density", "score"])
_tool_queries("punctuation", "words em_dashes em_dash stacked smart mixed ellipsis dots semicolons semicolon brackets parenthesis semicolon_ratio bracket_ratio oxford not_oxford oxford_share inside outside quote_share".split())
_tool_queries("structure", "words paragraphs paragraph_mean paragraph_variance fano bullets bullet_density openings closings sections section_variance transitions transition_density transition_kinds".split())
_tool_queries("burstiness", "sentences mean deviation variance shortest longest spread cv fano uniformity".split())
_tool_queries("content", "words hedges hedging cliches superlatives superlative fillers".split())

# words and sentences
add(
    "word_rules",
    lambda d: d.select("doc_id", T.count_split(F.col("text")).alias("split_words"), T.count_words(F.col("text")).alias("words"), T.count_runs(F.col("text")).alias("runs"), F.size(ngrams.tokens(F.col("text"))).cast("long").alias("tokens")),
    rf"SELECT doc_id, CAST(len(regexp_split_to_array(lower(text), '\s+')) AS BIGINT) AS split_words, CAST(len({S.WORDS}) AS BIGINT) AS words, CAST({S.cnt(r'\w+')} AS BIGINT) AS runs, CAST(len(regexp_extract_all(lower(text), {S.q(ngrams.TOKEN)})) AS BIGINT) AS tokens FROM docs",
)
_paragraphs = f"SELECT doc_id, unnest(generate_series(0, len(ps) - 1)) AS paragraph, unnest(ps) AS text FROM (SELECT doc_id, {S.PARAGRAPHS} AS ps FROM docs)"
_table = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, i) AS sentence_id, paragraph, sentence
    FROM (SELECT doc_id, paragraph, unnest(generate_series(1, len(l))) AS i, unnest(l) AS sentence FROM (SELECT doc_id, paragraph, {S.SENTENCES} AS l FROM ({_paragraphs})))"""
_words_of = r"CAST(len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda x: x <> '')) AS BIGINT)"
add("sentence_table", editing.sentence_table, f"SELECT doc_id, sentence_id, paragraph, sentence, {_words_of} AS words FROM ({_table})")
_markers = ", ".join(f"({S.q(k)}, CAST({m} AS DOUBLE), {S.q(s)})" for k, (m, s) in L.SENTENCE_MARKERS.items())
add(
    "marker_sentences",
    lambda d: editing.marker_sentences(d).select("doc_id", "sentence_id", "marker", "multiplier", "severity"),
    f"SELECT doc_id, sentence_id, marker, multiplier, severity FROM ({_table}), (VALUES {_markers}) AS m(marker, multiplier, severity) WHERE regexp_matches(sentence, '(?i)\\b' || marker || '\\b')",
)
add(
    "antecedents",
    lambda d: editing.neighbours(d).fillna(0, ["antecedent"]),
    f"""SELECT a.doc_id, a.sentence_id, coalesce(arg_max(b.sentence_id, b.words * 1000000000 + b.sentence_id), 0) AS antecedent
        FROM (SELECT doc_id, sentence_id FROM ({_table})) a LEFT JOIN (SELECT doc_id, sentence_id, {_words_of} AS words FROM ({_table})) b
        ON a.doc_id = b.doc_id AND b.sentence_id BETWEEN a.sentence_id - 3 AND a.sentence_id - 1 GROUP BY a.doc_id, a.sentence_id""",
)


def _spans(d: DataFrame, size: int, shift: int) -> DataFrame:
    n = F.length("text")
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    rows = d.select("doc_id", n.alias("n"), F.posexplode(at).alias("i", "at"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("span_id"), (F.col("at") + shift).cast("long").alias("start"), F.least(F.col("at") + size + shift, F.col("n")).cast("long").alias("end"))


_span_sql = lambda size, shift: f"SELECT doc_id, i AS span_id, (i - 1) * {size} + {shift} AS s, least(i * {size} + {shift}, n) AS e FROM (SELECT doc_id, length(text) AS n, unnest(generate_series(1, greatest((length(text) - 1) // {size} + 1, 1))) AS i FROM docs)"
add(
    "align_overlap",
    lambda d: editing.align(_spans(d, 700, 50), _spans(d, 1000, 0)).select("doc_id", "span_id", "canonical_id", F.col("overlap").cast("long").alias("overlap")),
    f"""SELECT doc_id, span_id, canonical_id, CAST(overlap AS BIGINT) AS overlap FROM (SELECT a.doc_id, a.span_id, b.span_id AS canonical_id, least(a.e, b.e) - greatest(a.s, b.s) AS overlap,
        row_number() OVER (PARTITION BY a.doc_id, a.span_id ORDER BY least(a.e, b.e) - greatest(a.s, b.s) DESC, b.span_id) AS r
        FROM ({_span_sql(700, 50)}) a JOIN ({_span_sql(1000, 0)}) b ON a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e) WHERE r = 1""",
)
_prose = "text"
for _p, _new in T.PROSE_STEPS:
    if "\\1\\s" not in _p:  # a back reference: no document here has fences
        _prose = f"regexp_replace({_prose}, {S.q(_p.replace('(?md)', '(?m)'))}, {S.q(_new.replace('$1', chr(92) + '1')) if chr(10) not in _new else 'chr(10) || chr(10)'}, 'g')"
add("prose_extract", lambda d: d.select("doc_id", T.prose(F.col("text")).alias("prose")), f"SELECT doc_id, {S.strip(_prose)} AS prose FROM docs")

# n-grams and diversity
_tokens = f"SELECT doc_id, regexp_extract_all(lower(text), {S.q(ngrams.TOKEN)}) AS t FROM docs"


def _grams(n: int, source: str = _tokens, key: str = "doc_id") -> str:
    return f"SELECT {key}, unnest(list_transform(generate_series(1, len(t) - {n - 1}), lambda i: array_to_string(t[i:i + {n - 1}], ' '))) AS gram FROM ({source})"


_counts = lambda n: f"SELECT doc_id, gram, count(*) AS n FROM ({_grams(n)}) GROUP BY doc_id, gram"
_profile = lambda n: f"SELECT doc_id, sum(n) AS total, count(*) AS uniq, count(*) FILTER (n = 1) AS once FROM ({_counts(n)}) GROUP BY doc_id"
for _k in range(2, 7):
    add(
        f"ngram_profile_n{_k}",
        lambda d, k=_k: rounded(ngrams.profile(d, k)),
        f'SELECT doc_id, CAST(total AS BIGINT) AS total, CAST(uniq AS BIGINT) AS "unique", round(CAST(uniq AS DOUBLE) / total, 6) AS ttr, round(CAST(once AS DOUBLE) / uniq, 6) AS hapax, round(CAST(total - uniq AS DOUBLE) / total, 6) AS repetition FROM ({_profile(_k)})',
    )
add("ngram_top10", lambda d: rounded(ngrams.top(d, 2)), f"SELECT * FROM (SELECT doc_id, gram, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(gram)) AS rank FROM ({_counts(2)})) WHERE rank <= 10")
_patterns = " + ".join(f"(length(lower(text)) - length(replace(lower(text), {S.q(p)}, ''))) // {len(p)}" for p in L.PHRASES)
add("phrase_patterns", lambda d: d.select("doc_id", M.phrase_patterns(F.col("text")).alias("patterns")), f"SELECT doc_id, CAST({_patterns} AS BIGINT) AS patterns FROM docs")
_nscores = [("rep6 > 0.3", 0.7), ("ttr6 < 0.3", 0.6), ("ttr6 > 0.95 AND hapax6 > 0.9", -0.7), ("patterns > 2", 0.8), ("patterns BETWEEN 1 AND 2", 0.4), ("rep4 > 0.25", 0.3), ("ttr5 > 0.9", -0.3)]
_ngram_parts = f"""m AS (SELECT d.doc_id, CAST({_patterns.replace('text', 'd.text')} AS BIGINT) AS patterns, CAST(f.total - f.uniq AS DOUBLE) / f.total AS rep4, CAST(v.uniq AS DOUBLE) / v.total AS ttr5,
        CAST(x.total - x.uniq AS DOUBLE) / x.total AS rep6, CAST(x.uniq AS DOUBLE) / x.total AS ttr6, CAST(x.once AS DOUBLE) / x.uniq AS hapax6
        FROM docs d LEFT JOIN ({_profile(4)}) f USING (doc_id) LEFT JOIN ({_profile(5)}) v USING (doc_id) LEFT JOIN ({_profile(6)}) x USING (doc_id)),
    s AS (SELECT *, {' + '.join(f'coalesce(CAST({c} AS INTEGER), 0)' for c, _ in _nscores)} AS k, {' + '.join(f'CASE WHEN {c} THEN {v} ELSE 0.0 END' for c, v in _nscores)} AS t FROM m),
    a AS (SELECT *, CASE WHEN k > 0 THEN CAST(t AS DOUBLE) / k ELSE 0.0 END AS avg FROM s)"""
_ngram_select = """SELECT doc_id, CASE WHEN patterns >= 2 OR coalesce(rep6 > 0.3, false) THEN 'likely_ai' WHEN coalesce(ttr6 > 0.95 AND hapax6 > 0.9, false) THEN 'likely_human' WHEN avg > 0.3 THEN 'likely_ai' WHEN avg < -0.3 THEN 'likely_human' ELSE 'uncertain' END AS classification,
    round(CASE WHEN patterns >= 2 OR coalesce(rep6 > 0.3, false) OR coalesce(ttr6 > 0.95 AND hapax6 > 0.9, false) THEN least(0.95, 0.5 + abs(avg)) ELSE least(0.95, 0.4 + abs(avg * 0.5)) END, 6) AS confidence FROM a"""
add("ngram_verdict", lambda d: rounded(ngrams.verdict(d, R.Rules()).select("doc_id", "classification", "confidence")), f", {_ngram_parts} {_ngram_select}")
_letters = "SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM docs"
add("ttr_family", lambda d: rounded(ngrams.diversity(d)), f"SELECT doc_id, round(v / n, 6) AS ttr, round(v / sqrt(n), 6) AS rttr, round(v / sqrt(2 * n), 6) AS cttr, CASE WHEN n > 1 THEN round(ln(v) / ln(n), 6) END AS log_ttr FROM (SELECT doc_id, CAST(len(w) AS DOUBLE) AS n, CAST(len(list_distinct(w)) AS DOUBLE) AS v FROM ({_letters}) WHERE len(w) > 0)")
_wc = f"SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM ({_letters})) GROUP BY doc_id, x"
add("hapax", lambda d: rounded(ngrams.hapaxes(d)), f"SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS types, count(*) FILTER (n = 1) AS once, count(*) FILTER (n = 2) AS twice FROM ({_wc}) GROUP BY doc_id")
add(
    "mattr",
    lambda d: rounded(ngrams.mattr(d), 8),
    f"""SELECT doc_id, round(CASE WHEN len(w) < 50 THEN CAST(len(list_distinct(w)) AS DOUBLE) / len(w) ELSE list_avg(list_transform(generate_series(1, len(w) - 49), lambda i: CAST(len(list_distinct(w[i:i + 49])) AS DOUBLE) / 50)) END, 8) AS mattr FROM ({_letters}) WHERE len(w) > 0""",
)
add("mtld", lambda d: rounded(ngrams.mtld(d)))
add(
    "zipf",
    lambda d: rounded(ngrams.zipf(d), 4),
    f"""SELECT lang, count(*) AS levels, round(regr_slope(ln(n), ln(r)), 4) AS slope, round(regr_r2(ln(n), ln(r)), 4) AS r2 FROM (SELECT lang, n, avg(r) AS r FROM (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC) AS r
        FROM (SELECT lang, x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM ({_letters})) GROUP BY lang, x)) GROUP BY lang, n) GROUP BY lang""",
)
_dg = lambda table, key: f"SELECT DISTINCT {key}, gram FROM ({_grams(5, f'SELECT {key}, regexp_extract_all(lower(text), {S.q(ngrams.TOKEN)}) AS t FROM {table}', key)})"
add(
    "ngram_overlap_benchmark",
    lambda s, p: rounded(ngrams.overlap(tables(s, p, "documents"), tables(s, p, "benchmark"))),
    f"""WITH a AS ({_dg('documents', 'doc_id')}), b AS ({_dg('benchmark', 'item_id')}), na AS (SELECT doc_id, count(*) AS a FROM a GROUP BY doc_id), nb AS (SELECT item_id, count(*) AS b FROM b GROUP BY item_id)
    SELECT doc_id, item_id, shared, round(CAST(shared AS DOUBLE) / (a + b - shared), 6) AS jaccard FROM (SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (gram) GROUP BY doc_id, item_id) JOIN na USING (doc_id) JOIN nb USING (item_id)""",
    docs=False,
)
add(
    "readability",
    lambda d: rounded(M.with_layers(d.select("doc_id", "text"), M.readability(F.col("text"), F.col)).select("doc_id", "letters_words", "syllables", "ease", "grade")),
    f"""SELECT doc_id, CAST(n AS BIGINT) AS letters_words, CAST(b AS BIGINT) AS syllables, CASE WHEN n > 0 THEN round(least(100.0, greatest(0.0, 206.835 - 1.015 * (n / s) - 84.6 * (b / n))), 6) END AS ease,
        CASE WHEN n > 0 THEN round(greatest(0.0, 0.39 * (n / s) + 11.8 * (b / n) - 15.59), 6) END AS grade FROM (SELECT doc_id, CAST(len(w) AS DOUBLE) AS n, greatest(CAST(len(l) AS DOUBLE), 1.0) AS s,
        CAST(coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CAST(ends_with(lower(x), 'e') AS INTEGER) + CAST(regexp_matches(lower(x), '[^aeiouy]le$') AS INTEGER)))), 0) AS DOUBLE) AS b
        FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w, {S.SENTENCES} AS l FROM docs))""",
)

# formatting
add(
    "invisible_chars",
    lambda d: d.select("doc_id", *(T.count(F.col("text"), c).alias(f"u{ord(c):04x}") for c in L.INVISIBLE)),
    "SELECT doc_id, " + ", ".join(f"CAST({S.cnt(c)} AS BIGINT) AS u{ord(c):04x}" for c in L.INVISIBLE) + " FROM docs",
)
_html = "regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>|<!--.*?-->|<[^>]*>', ' ', 'g')"
for _e, _s in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
    _html = f"replace({_html}, {S.q(_e)}, {S.q(_s)})"
add("html_text", lambda s, p: tables(s, p, "pages").select("page_id", T.plain_html(F.col("html")).alias("text")), f"SELECT page_id, trim(regexp_replace({_html}, '\\s+', ' ', 'g')) AS text FROM pages", docs=False)

# ensembles
FAST_TOOLS, FIVE = ("vocabulary", "punctuation", "structure"), tuple(verdicts.TOOLS)
_signals = {"punctuation": verdicts.PUNCTUATION_SIGNALS, "structure": verdicts.STRUCTURE_SIGNALS, "burstiness": verdicts.BURSTINESS_SIGNALS, "content": verdicts.CONTENT_SIGNALS}
_show = lambda rows: rows.withColumn("top_signals", F.concat_ws("; ", "top_signals"))
_fast = lambda compat: S.ensemble(S.tool_rows(FAST_TOOLS, _signals), ensemble.FAST, S.fast_score(compat), "contains(classification, 'ai')" if compat else "classification = 'likely_ai'", 0.65, 0.35, 0.8, 0.2, (0.65, 0.85), 5)
_ngram_signals = _ngram_select.replace(" AS confidence FROM a", f" AS confidence, {S.named([c for c, _ in _nscores], verdicts.NGRAM_SIGNALS)} AS signals FROM a")
_more = f"""SELECT doc_id, 'ngram' AS tool, classification, confidence, signals FROM (WITH {_ngram_parts} {_ngram_signals})
    UNION ALL SELECT doc_id, 'syntactic' AS tool, classification, confidence, signals FROM (WITH {syntax.parse(_table)} {syntax.SIGNALS})"""
_full = S.ensemble(f"{S.tool_rows(FIVE, _signals)} UNION ALL {_more}", ensemble.FULL, S.FULL_SCORE, "classification = 'likely_ai'", 0.7, 0.3, 0.85, 0.15, (0.75, 0.95), 10)
fast_rows = lambda d: ensemble.fast(verdicts.tool_rows(d, FAST_TOOLS))


def full_tools(d: DataFrame) -> DataFrame:
    """Rows of all tools that need no outside model: five from one pass, n-grams and the parse."""
    five = verdicts.tool_rows(d, FIVE)
    return five.unionByName(C.as_rows(ngrams.verdict(d, R.Rules()), "ngram")).unionByName(C.as_rows(X.verdict(X.document_measures(X.sentence_measures(X.closed_classes(d)))), "syntactic"))


full_rows = lambda d: ensemble.full(full_tools(d))
add("fast_ensemble", lambda d: _show(fast_rows(d)), f", {_fast(True)} SELECT * FROM found")
add("fast_ensemble_sane", lambda d: _show(ensemble.fast(verdicts.tool_rows(d, FAST_TOOLS), compat=False)), f", {_fast(False)} SELECT * FROM found")
add("full_ensemble", lambda d: _show(full_rows(d)), f", {_full} SELECT * FROM found")
add("only_filter", lambda d: rounded(ensemble.only(verdicts.tool_rows(d, FIVE), "likely_ai").select("doc_id", "tool", "confidence")), f"SELECT doc_id, tool, round(confidence, 6) AS confidence FROM ({S.tool_rows(FIVE, _signals)}) WHERE classification = 'likely_ai'")
add("top_per_class", lambda d: rounded(ensemble.top_per_class(full_rows(d), 10).select("doc_id", "classification", "score", "rank")), f", {_full} SELECT doc_id, classification, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY score DESC, doc_id) AS rank FROM found) WHERE rank <= 10")
add(
    "preset_matrix",
    lambda d: _presets(d),
    " UNION ALL ".join(
        f"SELECT {S.q(p)} AS preset, doc_id, density > {(r := R.Rules((p,))).get('vocabulary', 'ai_vocab_density')[0]} AS vocabulary, em_dash > {r.get('punctuation', 'em_dash')[0]} AS em_dash FROM (SELECT v.doc_id, density, em_dash FROM ({S.layers(S.VOCABULARY, S.VOCABULARY2)}) v JOIN ({S.layers(S.PUNCTUATION, S.PUNCTUATION2)}) p USING (doc_id))"
        for p in R.PRESETS
    ),
)


def _presets(d: DataFrame) -> DataFrame:
    """Documents by presets: one pass measures, each preset is a row of flags."""
    rows = verdicts.measured(d, ("vocabulary", "punctuation")).select("doc_id", F.col("vocabulary__density").alias("density"), F.col("punctuation__em_dash").alias("dash"))
    flags = []
    for name in R.PRESETS:
        rules = R.Rules((name,))
        flags.append(F.struct(F.lit(name).alias("preset"), rules.flags("vocabulary", "ai_vocab_density", F.col("density")).alias("vocabulary"), rules.flags("punctuation", "em_dash", F.col("dash")).alias("em_dash")))
    return rows.select("doc_id", F.explode(F.array(*flags)).alias("f")).select("f.preset", "doc_id", "f.vocabulary", "f.em_dash")


# configuration
_rule_values = lambda rules: ", ".join(f"({S.q(c)}, {S.q(r)}, {ai}, {h}, {str(off).lower()})" for (c, r), (ai, h, off) in rules.items())
_rule_sql = lambda rules: f"SELECT category, rule, CAST(ai_threshold AS DOUBLE) AS ai_threshold, CAST(human_baseline AS DOUBLE) AS human_baseline, disabled FROM (VALUES {_rule_values(rules)}) AS t(category, rule, ai_threshold, human_baseline, disabled)"
add("rules_default", lambda s, p: R.Rules().table(s), _rule_sql(R.Rules().rules), docs=False)
for _name in R.PRESETS:
    add(f"rules_{_name.replace('-', '_')}", lambda s, p, n=_name: R.merged(R.Rules().table(s), R.preset_table(s, n)), _rule_sql(R.Rules((_name,)).rules), docs=False)
add(
    "config_validation",
    lambda s, p: R.validate(tables(s, p, "documents").select(F.lit("media").alias("field"), F.col("lang").alias("value")).distinct()),
    "SELECT DISTINCT 'media' AS field, lang AS value, 'not allowed for media' AS error FROM documents WHERE lang NOT IN (" + ", ".join(S.q(v) for v in R.ALLOWED["media"]) + ")",
    docs=False,
)

# editing
add("cleanup_text", lambda d: d.select("doc_id", editing.cleaned(F.col("text")).alias("cleaned")))
# outer: to leave out empty maps beforehand Spark would run all rules once more for each
add("cleanup_report", lambda d: editing.clean_protected(d).select(F.explode_outer("changes").alias("rule", "n")).where("rule is not null").groupBy("rule").agg(F.sum("n").alias("changes")))
add("replace_sentences", lambda d: editing.replaced(d, editing.sentence_table(d).where("sentence_id = 1").select("doc_id", F.lit(1).alias("id"), F.col("sentence").alias("original"), F.lit("A new beginning.").alias("text"))))


def _issues(d: DataFrame) -> DataFrame:
    vocab = editing.marker_sentences(d).select("doc_id", "sentence_id", F.lit("vocabulary").alias("tool"), F.when(F.col("severity") == "critical", 4).when(F.col("severity") == "high", 3).otherwise(2).alias("priority"), F.lit(1.0).alias("contribution"))
    dash = editing.sentence_table(d).where(F.contains("sentence", F.lit("—"))).select("doc_id", "sentence_id", F.lit("punctuation").alias("tool"), F.lit(3).alias("priority"), T.count(F.col("sentence"), "—").cast("double").alias("contribution"))
    return vocab.unionByName(dash)


_issue_sql = f"""SELECT DISTINCT doc_id, sentence_id, 'vocabulary' AS tool, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 2 END AS priority, marker FROM ({_table}), (VALUES {_markers}) AS m(marker, multiplier, severity) WHERE regexp_matches(sentence, '(?i)\\b' || marker || '\\b')
    UNION ALL SELECT doc_id, sentence_id, 'punctuation' AS tool, 3 AS priority, '' AS marker FROM ({_table}) WHERE contains(sentence, '—')"""
add("issues_union", lambda d: rounded(_issues(d).groupBy("doc_id", "sentence_id", "tool").agg(F.sum("priority").alias("priority"))), f"SELECT doc_id, sentence_id, tool, CAST(sum(priority) AS BIGINT) AS priority FROM ({_issue_sql}) GROUP BY doc_id, sentence_id, tool")


add("plan_issues", lambda d: rounded(planner.issues(d).groupBy("tool", "priority").agg(F.count("*").alias("n"), F.sum("contribution").alias("contribution"))))
add("plan_budgets", lambda d: planner.budgets(planner.gathered(d)))
add("fix_plan", lambda d: planner.plan(d).withColumn("constraints", F.to_json("constraints")))
add("plan_verdict", planner.verdict)
add(
    "category_report",
    lambda d: api.category_report(verdicts.tool_rows(d, FAST_TOOLS)),
    f"""SELECT doc_id, tool, classification, round(CAST(confidence AS DOUBLE), 6) AS confidence, round({S.FULL_SCORE}, 6) AS score, CASE tool WHEN 'vocabulary' THEN 0.15 ELSE 0.05 END::DOUBLE AS weight, coalesce(array_to_string(signals[1:3], '; '), '') AS key_signals
        FROM ({S.tool_rows(FAST_TOOLS, _signals)})""",
)

# audits, rounds, reports
_when = lambda k: F.timestamp_seconds(F.col("doc_id") * 60 + k)
_files = lambda d: d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), _when(0).alias("modified_at"), "doc_id")
_cache = lambda d: d.where(F.col("doc_id") % 3 != 0).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 5 == 0, _when(1)).otherwise(_when(0)).alias("modified_at"))
add("audit_changed", lambda d: audit.changed(_files(d), _cache(d)).select("path", "doc_id"), "SELECT 'doc/' || doc_id AS path, doc_id FROM docs WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
add("audit_report", lambda d: audit.report(full_rows(d).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "score")), f", {_full} SELECT 'doc/' || doc_id AS path, score, CASE WHEN score > 0.3 THEN 'NEEDS WORK' ELSE 'OK' END AS status FROM found")
_ledger = lambda d: full_rows(d).select((F.col("doc_id") % 50).alias("session"), F.col("doc_id").alias("round"), "score", "classification", (F.col("confidence") * 100).alias("confidence"))
add(
    "rounds_delta",
    lambda d: rounded(audit.rounds(_ledger(d))),
    f", {_full} SELECT doc_id % 50 AS session, doc_id AS round, round(score, 6) AS score, round(score - lag(score) OVER (PARTITION BY doc_id % 50 ORDER BY doc_id), 6) AS delta, classification = 'likely_human' AND (confidence * 100 > 80 OR score < 0.26) AS success FROM found",
)
QUERIES["label_confusion"] = lambda s, p: full_rows(documents(s, p)).join(tables(s, p, "labels"), "doc_id").groupBy("classification", "quality").agg(F.count("*").alias("n"))
ORACLE_SQL["label_confusion"] = f"WITH {S.DOCS}, {_full} SELECT classification, quality, count(*) AS n FROM found JOIN labels USING (doc_id) GROUP BY classification, quality"
QUERIES["corpus_rollup"] = lambda s, p: rounded(full_rows(documents(s, p)).join(documents(s, p).select("doc_id", "lang", "source"), "doc_id").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("score").alias("score_sum")))
ORACLE_SQL["corpus_rollup"] = f"WITH {S.DOCS}, {_full} SELECT lang, source, count(*) AS n, round(sum(score), 6) AS score_sum FROM found JOIN docs USING (doc_id) GROUP BY ROLLUP (lang, source)"
QUERIES["event_windows"] = lambda s, p: streams.windows(tables(s, p, "events"))
ORACLE_SQL["event_windows"] = "SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
QUERIES["chat_role_words"] = lambda s, p: tables(s, p, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(T.count_words(F.col("text"))).alias("words"))
ORACLE_SQL["chat_role_words"] = f"SELECT role, count(*) AS turns, CAST(sum(len({S.WORDS})) AS BIGINT) AS words FROM conversations GROUP BY role"

markers.register(add, rounded)
syntax.register(add, rounded, _table)
scores.register(add, rounded)
dashes.register(add, rounded)
offsets.register(add)
profiles.register(add, _table)

"""Formatting, style, narrative and content markers of a text, without a shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import lexicons as L
from .metrics import Layers, Name, hits, total
from .text import RIGHT, count, count_split, count_words, strip

# Phrases that hedge.
HEDGE_PHRASES = [
    r"it's (important|worth|essential) to (note|mention|consider)", r"it should be noted", r"based on the information provided", r"can vary depending on", r"while this may be true", r"it's crucial to understand",
]

# Words that open a paragraph as a formal transition.
OPENERS = ["furthermore", "moreover", "additionally", "consequently", "thus", "subsequently", "hence", "therefore", "nonetheless"]

# Formal words, and weighted vocabulary.
FORMAL = ["utilize", "leverage", "endeavor", "facilitate", "implement", "optimize"]
WEIGHTED = {"delve": 400, "underscore": 200, "meticulous": 150, "tapestry": 147, "intricate": 125, "realm": 100, "showcase": 100, "pivotal": 80, "leverage": 75, "holistic": 50}

# Lists of three, "not X but Y" and conclusions.
TRICOLON = r"(\w+),\s*(\w+),?\s*(and|or)\s+(\w+)"
NOT_BUT = [r"it's not (just )?about .+ — it's about", r"is not (just )?.+ — (it's|it is)", r"isn't (just )?.+ — it's", r"not .+ but rather"]
CONCLUSIONS = [
    r"(?m)^In conclusion,?", r"(?m)^In summary,?", r"(?m)^To sum up,?", r"(?m)^Overall,?", r"(?m)^To summarize,?", r"Whether you're .+ or .+, .+ offers", r"Both sides present valid",
    r"As (I|we) (progress|move forward|continue) (in|on)",
]

# Proper nouns, default names and specific figures.
PROPER = r"[A-Z][a-z]+(?:\s[A-Z][a-z]+)*"
NAMES = ["emily", "sarah", "john", "michael"]
SPECIFICS = r"\b\d{4}\b|\$[\d,]+|\d+%"

# Balance, caveats, citations, self-reference and refusals.
BALANCE = [
    r"while some (argue|believe|think)", r"on the other hand", r"both (sides|perspectives|views) (have|present|offer)", r"it (depends|varies)", r"there are (pros and cons|advantages and disadvantages)",
    r"it's (important|worth) (noting|mentioning) that",
]
CAVEATS = [
    r"consult (a|your) (professional|doctor|lawyer|financial advisor)", r"this is not (medical|legal|financial) advice", r"individual results may vary", r"always do your own research", r"not (guaranteed|a substitute for)",
    r"seek professional (help|advice|guidance)", r"before making any (decisions|changes)",
]
PLACEHOLDERS = r"\[citation needed\]|\[cite\]|\[\d+\]|citeturn\d+"
DOI = r"10\.\d{4,}/[^\s]+"
SELF = [
    r"as an? (AI|artificial intelligence|language model)", r"I('m| am) (an? )?(AI|Claude|GPT|assistant)", r"I (don't|do not) have (personal|real|actual) (experiences|feelings|opinions)", r"I was (created|trained|developed) by",
    r"my (training|knowledge) (cutoff|data)",
]
SELF_LINES = [r"^Certainly!", r"I hope this helps!?$", r"Let me know if you have any (other )?questions!?$", r"What do you think\?$"]
REFUSALS = [
    r"I (cannot|can't|am unable to|won't) (provide|assist|help)", r"outside (my|of my) (capabilities|scope|programming)", r"I (don't|do not) feel comfortable", r"I must (respectfully )?decline", r"I('m| am) not (able|permitted|allowed) to",
    r"against my (guidelines|programming|principles)",
]

# Hyphenated compounds.
COMPOUNDS = [
    "state-of-the-art", "cutting-edge", "world-class", "well-established", "deeply-rooted", "thought-provoking", "game-changing", "ground-breaking", "forward-thinking", "results-driven", "customer-centric", "data-driven",
    "best-in-class", "high-quality", "long-term", "real-time",
]

# Opening formulas of a first paragraph, closing formulas of a last one.
FIRST = [r"^In today's (fast-paced|competitive|digital|modern)", r"^In an era where", r"^Have you ever wondered", r"^In the realm of", r"^When it comes to", r"is one of the most (important|significant|crucial)"]
LAST = [r"In conclusion,?", r"In summary,?", r"To sum up,?", r"Whether you're .+ or .+, .+ offers", r"Both sides present valid", r"As (I|we) (progress|move forward|continue)"]

# Left-over Markdown, and points of suspicion.
MARKDOWN = {"bold": r"\*\*[^*]+\*\*", "headers": r"(?m)^#{1,6}\s", "bullets_left": r"(?m)^\s*[-*]\s", "links_left": r"\[.+\]\(.+\)", "code_left": "```"}
POINTS = {"invisible": 40, "markdown": 30, "dash_ratio": 15, "smart_double": 10, "ellipsis_sign": 5}


def java(pattern: str) -> str:
    """Only a newline ends a line; ASCII word boundaries."""
    head, rest = (pattern[:4], pattern[4:]) if pattern.startswith("(?m)") else ("", pattern)
    return (head.replace("(?m)", "(?md)") or "(?d)") + rest.replace(r"\b\d", r"(?<![A-Za-z0-9_])\d").replace(r"}\b", "}" + RIGHT)


def counts(text, patterns: list[str], flags: str = "(?i)"):
    """Occurrences of all patterns, each counted by itself."""
    return sum((count(text, flags + java(p)) for p in patterns[1:]), count(text, flags + java(patterns[0])))


def formatting(text, c: Name) -> Layers:
    n = lambda p: count(text, java(p))
    lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
    titled = F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"(^|\s)[A-Z]")) / F.regexp_count(x, F.lit(r"\S+")) > 0.7)
    return [
        {
            "invisible": n(f"[{L.INVISIBLE}]"), "smart_double": n("[“”]"), "smart_single": n("[‘’]"), "straight_double": n('"'), "straight_single": n("'"), "em": n("—"), "en": n("–"), "hyphens": n("-"),
            "ellipsis_sign": n("…"), "periods": n(r"\.{3}"), "double_spaces": n("  +"), "trailing_blanks": n(r"(?m)[ \t]+$"), "blank_lines": n(r"\n{3,}"), "lines": F.size(lines).cast("long"), "titled": F.size(titled).cast("long"),
            **{k: text.rlike(java(p)) for k, p in MARKDOWN.items()},
        },
        {
            "dash_ratio": F.coalesce(F.try_divide(c("em"), c("em") + c("en") + c("hyphens")), F.lit(0.0)), "title_ratio": F.coalesce(F.try_divide(c("titled"), c("lines")), F.lit(0.0)),
            "markdown": sum((c(k).cast("long") for k in MARKDOWN), F.lit(0).cast("long")),
        },
        {"suspicion": sum((F.when(c(k) > (0.5 if k == "dash_ratio" else 0), v).otherwise(0) for k, v in POINTS.items()), F.lit(0)).cast("long")},
    ]


def style(text, c: Name) -> Layers:
    parts = F.split(text, "\n\n")
    weights = F.create_map(*(F.lit(x) for t, w in WEIGHTED.items() for x in (t, float(w))))
    opening = F.filter(parts, lambda p: p.rlike(r"(?i)^\s*(" + "|".join(OPENERS) + ")" + RIGHT))
    compounds = sum(((F.length(F.lower(text)) - F.length(F.replace(F.lower(text), F.lit(t), F.lit("")))) / len(t) for t in COMPOUNDS), F.lit(0.0))
    return [
        {"pieces": count(text, r"\W+") + 1, "hedge_phrases": counts(text, HEDGE_PHRASES), "formal": F.size(hits(text, FORMAL)).cast("long"), "load": total(F.transform(hits(text, WEIGHTED), lambda t: F.element_at(weights, t))), "words": count_words(text), "compounds": compounds.cast("long")},
        {
            "opener_ratio": F.size(opening) / F.size(parts), "formality": c("formal") * 100.0 / c("pieces"), "weighted": c("load") / c("pieces"),
            "compound_density": F.when(c("words") > 0, c("compounds") * 10000.0 / c("words")).otherwise(F.lit(0.0)),
        },
    ]


def narrative(text, c: Name) -> Layers:
    return [
        {
            "tricolons": count(text, "(?i)" + TRICOLON), "not_but": counts(text, NOT_BUT), "conclusions": counts(text, CONCLUSIONS), "proper": F.regexp_extract_all(text, F.lit(PROPER), F.lit(0)),
            "specifics": count(text, java(SPECIFICS)), "hundreds": count_split(text) / 100.0,
        },
        {"proper_nouns": F.size(c("proper")).cast("long"), "default_names": F.size(F.filter(c("proper"), lambda x: F.lower(x).isin(NAMES))).cast("long")},
        {"proper_density": c("proper_nouns") / c("hundreds"), "name_ratio": c("default_names") / F.greatest(c("proper_nouns"), F.lit(1)), "specificity": c("specifics") / c("hundreds")},
    ]


def claims(text, c: Name) -> Layers:
    kinds = lambda ps, flags: sum(text.rlike(flags + java(p)).cast("long") for p in ps)
    return [
        {
            "balance": counts(text, BALANCE), "caveats": counts(text, CAVEATS), "placeholders": count(text, "(?i)" + PLACEHOLDERS), "dois": count(text, DOI),
            "self_reference": kinds(SELF, "(?i)") + kinds(["(?m)" + p for p in SELF_LINES], ""), "refusals": counts(text, REFUSALS),
        },
    ]


def anchored(text, c: Name) -> Layers:
    """Formulas at the places where they belong, and the spread of paragraph lengths in characters."""
    first, last = F.element_at(F.split(text, "\n\n"), 1), F.element_at(F.split(text, "\n\n"), -1)
    some = lambda part, ps: sum((part.rlike("(?i)" + java(p)).cast("int") for p in ps), F.lit(0)) > 0
    lengths = F.transform(F.split(text, r"\n\n+"), lambda p: F.length(p).cast("double"))
    return [
        {"opening": some(first, FIRST), "closing": some(last, LAST), "lengths": lengths},
        {"n": F.size(c("lengths")).cast("double"), "sum": total(c("lengths"))},
        {"squares": F.aggregate(c("lengths"), F.lit(0.0), lambda a, x: a + (x - c("sum") / c("n")) * (x - c("sum") / c("n")))},
        {"char_fano": F.when(c("sum") > 0, c("squares") / c("sum")).otherwise(F.lit(0.0))},
    ]


#: Groups of markers with the measures they show.
GROUPS = {
    "formatting": (formatting, "invisible smart_double smart_single straight_double straight_single em en hyphens ellipsis_sign periods double_spaces trailing_blanks blank_lines bold headers bullets_left links_left code_left markdown dash_ratio title_ratio suspicion".split()),
    "style": (style, "hedge_phrases formal formality weighted opener_ratio compounds compound_density".split()),
    "narrative": (narrative, "tricolons not_but conclusions proper_nouns default_names proper_density name_ratio specificity".split()),
    "claims": (claims, "balance caveats placeholders dois self_reference refusals".split()),
    "anchored": (anchored, "opening closing char_fano".split()),
}

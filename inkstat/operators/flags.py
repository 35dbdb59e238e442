"""What six analyses want changed in one document, from its sentences, in plain Python.

The same rules as the operators over sentence tables (auxiliary_flags,
pronoun_targets, punctuation_issues, structure_flags, noun_flags,
marker_sentences), which work by windows: here a document's sentences are read
once and nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from typing import NamedTuple

from ..functions import lexicons as L
from ..functions.text import alternatives, bounded
from . import dashes as D
from . import syntax as X

# What a priority counts.
SCORES = {"critical": 4, "high": 3, "medium": 2, "low": 1}
# Shares in percent and dashes in 1000 words that a text should keep to.
TARGETS = {"auxiliary": 3.0, "pronoun": 5.0, "punctuation": 1.5, "noun": 20.0}

_TOKEN = re.compile(X.TOKEN, re.ASCII)
_SPACE = re.compile(r"\s+", re.ASCII)
_MARKER = re.compile("(?i)" + bounded(alternatives(L.SENTENCE_MARKERS)), re.ASCII)
_FIT = [(points, re.compile(p, re.ASCII), least) for points, p, least in D.FIT]
_JOINED = re.compile(D.JOINED, re.ASCII)
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_AUX, _PRONOUN, _COORDINATOR, _SUBORDINATOR, _VAGUE = 1, 2, 4, 8, 16
_FORMS: dict[str, int] = defaultdict(int)
for _bit, _forms in ((_AUX, X.AUXILIARIES), (_PRONOUN, X.PRONOUNS), (_COORDINATOR, X.COORDINATORS), (_SUBORDINATOR, X.SUBORDINATORS), (_VAGUE, X.VAGUE)):
    for _form in _forms:
        _FORMS[_form] |= _bit
_FORMS = dict(_FORMS)


class Sentence(NamedTuple):
    """Measures of a parsed sentence, as sentence_measures() has them."""

    sentence_id: int
    paragraph: int
    tokens_all: int
    words: int
    aux: int
    pronouns: int
    nouns: int
    vague: int
    clauses: int
    coordinations: int
    depth: int
    opens_with_pronoun: bool


def measured(sentence_id: int, paragraph: int, sentence: str) -> Sentence:
    """Of the parse by word lists: what sentence_measures(closed_classes()) tells of the sentence."""
    tokens = _TOKEN.findall(sentence)
    low = [t.lower() for t in tokens]
    aux = pronouns = nouns = vague = clauses = coordinations = signs = openers = 0
    last, n = -1, len(tokens)
    known = _FORMS.get
    for i, x in enumerate(low):
        k = known(x)
        if k is None:
            if tokens[i][0] not in _LETTERS:
                signs += 1
            elif len(x) >= 5:
                nouns += 1
            continue
        if k & _VAGUE:
            vague += 1
        if k & _AUX:
            aux += 1
        elif k & _PRONOUN:
            pronouns += 1
        elif k & _COORDINATOR:
            coordinations += 1
        elif k & _SUBORDINATOR:
            clauses += 1
            if i:
                openers, last = openers + 1, i
        elif len(x) >= 5:
            nouns += 1
    # every opener hangs on the one before, the first on the first token, all others on the last opener
    depth = openers + (last < n - 1) if openers else int(n > 1)
    return Sentence(sentence_id, paragraph, n, n - signs, aux, pronouns, nouns, vague, clauses, coordinations, depth, bool(low) and low[0].split("'")[0] in X.PRONOUNS)


def rounded(value: float, digits: int) -> float:
    """Half up, on the shortest decimal of the number."""
    return float(Decimal(repr(float(value))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


@lru_cache(1 << 16)
def share(n: int, words: int) -> float:
    return rounded(n * 100.0 / words, 2) if words > 0 else 0.0


def _variance(values: list[int]) -> float:
    """Of a sample; exact up to the last rounding."""
    n, s = len(values), sum(values)
    return (n * sum(v * v for v in values) - s * s) / (n * (n - 1)) if n > 1 else 0.0


def auxiliaries(rows: list[Sentence], target: float):
    words, aux = sum(r.words for r in rows), sum(r.aux for r in rows)
    whole = share(aux, words)
    if whole <= target:
        return
    excess, gained = max(0, math.floor(aux - target / 100 * words + 0.5)), 0
    for r in sorted((r for r in rows if r.aux > 0), key=lambda r: (-r.aux, -share(r.aux, r.words), r.sentence_id)):
        if gained and gained >= excess:
            break
        own = share(r.aux, r.words)
        priority = "critical" if own > 15 or r.aux >= 4 else "high" if own > 10 or r.aux >= 3 else "medium" if own > whole * 1.5 or r.aux >= 2 else "low"
        yield r.sentence_id, "auxiliary", priority, float(min(r.aux, 2)), f"{r.aux} auxiliaries of {own:.2f} percent"
        gained += min(r.aux, 2)


def pronouns(rows: list[Sentence], target: float):
    whole = share(sum(r.pronouns for r in rows), sum(r.words for r in rows))
    if whole <= target:
        return
    for i, r in enumerate(rows):
        own = share(r.pronouns, r.words)
        if own > whole * 1.5 or r.pronouns >= 2 or r.opens_with_pronoun:
            near = max(((p.nouns, p.sentence_id) for p in rows[max(0, i - 3) : i] if p.paragraph >= r.paragraph - 1), default=(0, 0))
            antecedent = near[1] if near[0] > 0 else rows[i - 1].sentence_id if i else r.sentence_id
            priority = "critical" if own > 20 or r.pronouns >= 4 else "high" if own > 15 else "medium"
            yield r.sentence_id, "pronoun", priority, float(math.ceil(r.pronouns * 0.5)), f"name what is meant, see sentence {antecedent}"


def _fitness(sentence: str) -> int:
    n = len(_SPACE.findall(sentence)) + 1
    return 0 if n < 8 else sum(points for points, p, least in _FIT if n >= least and p.search(sentence)) + (n >= 15) + (n >= 25)


def punctuation(cut: list[tuple[int, str]], all_words: int, target: float = 1.5, least: float = 1.0):
    """cut: paragraph and text of the sentences, in order."""
    of = [s.count("—") for _, s in cut]
    total, dashed = sum(of), [i for i, n in enumerate(of) if n]
    semicolons = sum(";" in s for _, s in cut)
    long = all_words > 500
    found = []
    if dashed:
        if total * 1000.0 / all_words > target:
            several = [i for i in dashed if of[i] > 1]
            most = max(total - math.floor(target * all_words / 1000), len(several))
            found += [(i, "em_dash_density") for i in (several + [i for i in dashed if of[i] == 1])[: max(0, most)]]
        here = Counter(cut[i][0] for i in dashed)
        for i in dashed:
            p = cut[i][0]
            if here.get(p + 1, 0) >= here[p] or here.get(p - 1, 0) > here[p]:
                found.append((i, "em_dash_stacking"))
        if not semicolons:
            found += [(i, "em_dash_semicolon_ratio") for i in dashed[:3]]
    if long and total * 1000.0 / all_words < least:
        fits = [(-f, i) for i, (_, s) in enumerate(cut) if not of[i] and ";" not in s and (f := _fitness(s)) > 0]
        first, order = set(), []
        for f, i in sorted(fits):
            order.append((cut[i][0] in first, f, i))  # the fittest of its paragraph, then the others
            first.add(cut[i][0])
        needed = max(math.ceil(least * all_words / 1000), math.ceil(target * 0.5 * all_words / 1000)) - total
        found += [(i, "low_em_dash_density") for _, _, i in sorted(order)[: max(0, needed)]]
    if long and semicolons * 1000.0 / all_words < 2:
        found += [(i, "low_semicolon_density") for i, (_, s) in enumerate(cut) if len(s) > 50 and ";" not in s and _JOINED.search(s)]
    for i, issue in found:
        yield i + 1, "punctuation", "high" if issue.endswith("em_dash_density") else "medium", 1.0, issue


def _kind(r: Sentence) -> str:
    return ("compound_complex" if r.coordinations else "complex") if r.clauses else "compound" if r.coordinations else "simple"


def structure(rows: list[Sentence]):
    n = len(rows)
    if not n:
        return
    kinds = [_kind(r) for r in rows]
    simples, both = kinds.count("simple"), kinds.count("compound_complex")
    sizes, depths = [r.tokens_all for r in rows], [r.depth for r in rows]
    size, depth = sum(sizes) / n, sum(depths) / n
    uniformity = rounded(min(1.0, max(0.0, 1 - math.sqrt(_variance(sizes)) / size)), 3) if size > 0 else 1.0
    few, shallow, even, flat = both / n < 0.05, depth < 5, uniformity > 0.8, _variance(depths) < 1
    budget = min(max(0, math.ceil(n * 0.06) - both) + 3, math.ceil(simples * 0.3))
    place = 0
    for i, r in enumerate(rows):
        if place >= budget:
            return
        if r.words <= 6:
            continue
        plain, merge, priority = kinds[i] == "simple" and r.depth < depth, None, None
        if plain:
            near = (j for j in (i + 1, i - 1) if 0 <= j < n and kinds[j] == "simple" and rows[j].paragraph == r.paragraph and rows[j].words + r.words < 40)
            merge = next((rows[j].sentence_id for j in near), None)
            if few and merge is not None:
                priority = "critical"
            elif shallow:
                priority = "high" if r.depth <= 2 else "medium"
            elif even and r.words < 8:
                priority = "medium"
            elif even or flat:
                priority = "low"
        elif kinds[i] == "compound" and few:
            priority = "medium"
        if priority:
            place += 1
            yield r.sentence_id, "structure", priority, 1.0, "vary the structure" if merge is None else f"merge with sentence {merge}"


def nouns(rows: list[Sentence], target: float):
    words, all_nouns = sum(r.words for r in rows), sum(r.nouns for r in rows)
    whole, found = share(all_nouns, words), []
    if whole >= target:
        return
    for r in rows:
        own = share(r.nouns, r.words)
        if r.words < 4 or own >= target:
            continue
        if own < 10 and share(r.pronouns, r.words) > 15:
            found.append((0, own, r.sentence_id, "low_noun_high_pronoun"))
        elif own < 10 and share(r.aux, r.words) > 10:
            found.append((0, own, r.sentence_id, "low_noun_high_aux"))
        elif r.vague > 0:
            found.append((1 if r.vague >= 2 else 2, own, r.sentence_id, "vague_references"))
        elif own < whole * 0.7:
            found.append((1 if own < 8 else 2, own, r.sentence_id, "low_noun_general"))
    deficit = max(0, math.floor(target / 100 * words - all_nouns + 0.5))
    for place, (grade, _, sentence_id, issue) in enumerate(sorted(found)):
        if place and 2 * place >= deficit:
            return
        yield sentence_id, "noun", X.PRIORITIES[grade], 1.0, issue


def vocabulary(cut: list[tuple[int, str]]):
    """A flag a sentence and marker in it."""
    low = [s.lower() for _, s in cut]
    text = "\n".join(low)
    there = [m for m in L.SENTENCE_MARKERS if m in text]  # far cheaper than the pattern, which decides
    if there:
        for i, (_, s) in enumerate(cut):
            if any(m in low[i] for m in there):
                for marker in dict.fromkeys(m.lower() for m in _MARKER.findall(s)):
                    severity = L.SENTENCE_MARKERS[marker][1]
                    yield i + 1, "vocabulary", "medium" if severity == "moderate" else severity, 1.0, f"replace {marker}"


def issues(rows: list[Sentence], cut: list[tuple[int, str]], all_words: int) -> list[tuple]:
    """(sentence_id, tool, priority, contribution, instruction) of all six."""
    return [
        *auxiliaries(rows, TARGETS["auxiliary"]), *pronouns(rows, TARGETS["pronoun"]), *punctuation(cut, all_words), *structure(rows), *nouns(rows, TARGETS["noun"]), *vocabulary(cut),
    ]


def ordered(found: list[tuple]) -> list[tuple]:
    """(sentence_id, tool, score, contribution, priority, instruction), in the order in which plans read them."""
    return sorted((sentence, tool, SCORES.get(priority, 0), contribution, priority, instruction) for sentence, tool, priority, contribution, instruction in found)


def budgets(rows: list[Sentence], flags: list[tuple], dashes: int, all_words: int) -> list[tuple]:
    """(tool, current, target, excess) of the tools that want anything; see planner.gathered."""
    words, n = sum(r.words for r in rows), Counter(f[1] for f in flags)
    aux, pronoun, noun = (share(sum(v), words) for v in ((r.aux for r in rows), (r.pronouns for r in rows), (r.nouns for r in rows)))
    density = dashes * 1000.0 / all_words if all_words > 0 else 0.0
    beyond = lambda value, tool: math.ceil((value - TARGETS[tool]) / 100 * words) if value > TARGETS[tool] else 0
    made = [
        ("auxiliary", aux, TARGETS["auxiliary"], beyond(aux, "auxiliary")),
        ("pronoun", pronoun, TARGETS["pronoun"], beyond(pronoun, "pronoun")),
        ("punctuation", density, TARGETS["punctuation"], math.ceil((density - TARGETS["punctuation"]) / 1000 * all_words) if density > TARGETS["punctuation"] else n["punctuation"]),
        ("structure", n["structure"], 0.0, n["structure"]),
        ("noun", noun, TARGETS["noun"], n["noun"] if noun < TARGETS["noun"] else 0),
        ("vocabulary", n["vocabulary"], 0.0, n["vocabulary"]),
    ]
    return [(tool, rounded(current, 4), target, float(excess)) for tool, current, target, excess in made if excess > 0]

"""Operators that SQL can't express against plain Python, symbol by symbol and row by row."""

import bisect
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstat.llm import language_id, lm_score, packing, quality, urls

DIR = "/root/testdata/sf0.001"
START, END = 0xFE, 0xFF


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


class PlainPpm:
    """A trie as nested dictionaries, asked one symbol at a time: escapes by method D, exclusion, 256 symbols below order 0."""

    def __init__(self, texts, order):
        self.order, self.followers = order, defaultdict(Counter)
        for text in texts:
            symbols = [START] * order + list(text) + [END]
            for i in range(order, len(symbols)):
                for j in range(order + 1):
                    self.followers[tuple(symbols[i - j : i])][symbols[i]] += 1

    def log(self, text):
        symbols, total = [START] * self.order + list(text) + [END], 0.0
        for i in range(self.order, len(symbols)):
            out = set()
            for j in range(self.order, -1, -1):
                seen = self.followers.get(tuple(symbols[i - j : i]))
                if not seen:
                    continue
                left = {s: n for s, n in seen.items() if s not in out}
                mass = sum(left.values())
                if symbols[i] in left:
                    total += math.log((left[symbols[i]] - 0.5) / mass)
                    break
                total += math.log(0.5 * len(left) / mass) if left else 0.0
                out |= set(seen)
            else:
                total -= math.log(256 - len(out))
        return total


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_ppm_scores_of_whole_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r["doc_id"]: lower(r["text"]) for r in docs.select("doc_id", "text").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    model = PlainPpm([t for d, t in texts.items() if not held[d]], lm_score.ORDER)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, lm_score.remainder("doc_id", 7) != 2, nodes=5000).collect()}
    some = [d for d in sorted(texts) if len(texts[d]) < 3000]
    for d in [d for d in some if held[d]][:6] + [d for d in some if not held[d]][:4]:
        assert math.isclose(got[d], model.log(texts[d]) / math.log(10), rel_tol=1e-5)


def letters(text):
    return bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in lower(text))


def test_languages_by_plain_tries(spark):
    rng = random.Random(5)
    words = {"aa": "the cat sat on that mat with the hat".split(), "bb": "der hund lief über das große feld".split(), "cc": "le chat était sur la table déjà".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 12))) + f" {i}!", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "cat", None)], "doc_id long, text string, lang string")
    langs, models = language_id.fit(docs, F.col("doc_id") % 3 != 9)
    plain = [PlainPpm([letters(t) for _, t, own in rows if own == lang], language_id.ORDER) for lang in langs]
    asked = ["the mat", "das feld", "la table", "Über DEM hat?", "zzz qqq", "x", " ".join(words["cc"]) * 40, "12", "", None, "中文"]
    got = {r["k"]: r for r in language_id.identify(spark.createDataFrame(list(enumerate(asked)), "k long, text string"), langs, models).collect()}
    assert langs == ["aa", "bb", "cc"]
    for k, text in enumerate(asked):
        if not text or text == "12":
            assert (got[k]["lang_pred"], got[k]["score"], got[k]["bits"]) == ("und", 0.0, None)
            continue
        logs = [p.log(letters(text)) for p in plain]
        best = max(logs)
        share = sum(math.exp((v - best) / max(1, len(text.encode()) / 16)) for v in logs)
        assert got[k]["lang_pred"] == langs[logs.index(best)]
        assert math.isclose(got[k]["bits"], -best / math.log(2), rel_tol=1e-5) and math.isclose(got[k]["score"], 1 / share, rel_tol=1e-3)


def plain_features(text):
    data = (text or "").encode()
    kinds = Counter(quality._KIND[b] for b in data)
    parts = data.split()
    w, size = max(len(parts), 1), max(len(data), 1)
    cased = max(kinds[quality._LOWER] + kinds[quality._UPPER], 1)
    per = [kinds[k] / w for k in (quality._NEWLINE, quality._PIPE, quality._BANG, quality._NOISE, quality._STOP, quality._OTHER)]
    return [
        math.log1p(len(data)), math.log1p(len(parts)), kinds[quality._UPPER] / cased, kinds[quality._DIGIT] / size, kinds[quality._SPACE] / size, *per,
        sum(map(len, parts)) / w, sum(a == b for a, b in zip(parts, parts[1:])) / w, len(set(parts)) / w, sum(len(p) <= 3 for p in parts) / w, kinds[quality._HIGH] / size,
    ]


def test_quality_by_plain_sums(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "One", "a a a b", "LOUD!! | x | y\n\nnow 12 %", "é ü 中文", *(" ".join(rng.choice(["alpha", "be", "GAMMA!", "x1", "#"]) for _ in range(rng.randint(1, 60))) for _ in range(300))]
    x = np.array([plain_features(t) for t in texts])
    assert np.allclose(quality.features(pa.array(texts, pa.string())), x)
    y = np.array([float((t or "").count("GAMMA") > (t or "").count("be")) for t in texts])
    model = quality.fit_gam(x, y, bins=8, rounds=20, pair_rounds=6, pairs=3)
    assert len(model.pairs) == 3 and any(np.abs(t).sum() for _, _, t in model.pairs)
    got = {r["k"]: r for r in quality.scored(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), model).collect()}
    for k, row in enumerate(x.tolist()):
        bins = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.edges, row)]
        raw = model.base + sum(t[b] for t, b in zip(model.mains, bins)) + sum(t[bins[i] // model.fold, bins[j] // model.fold] for i, j, t in model.pairs)
        assert math.isclose(got[k]["score"], 1 / (1 + math.exp(-raw)), rel_tol=1e-9) and got[k]["predicted"] == int(got[k]["score"] >= 0.3)


def test_trees_are_the_best_cuts():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, h = rng.standard_normal(9), rng.random(9) + 0.1
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0)  # noqa: E731, B023
        best = max(range(1, 9), key=lambda c: gain(0, c) + gain(c, 9))
        want = np.zeros(9)
        for a, b in ((0, best), (best, 9)):
            cut = max(range(a + 1, b), key=lambda c: gain(a, c) + gain(c, b), default=0)
            for c, d in ((a, cut), (cut, b)) if cut and gain(a, cut) + gain(cut, b) > gain(a, b) + 1e-9 else ((a, b),):
                want[c:d] = g[c:d].sum() / (h[c:d].sum() + 2.0)
        assert np.allclose(quality._tree(g, h, 2.0), want)
        grid, weight = rng.standard_normal((4, 5)), rng.random((4, 5)) + 0.1
        four = lambda i, j: [(grid[a][:, b], weight[a][:, b]) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None))]  # noqa: E731, B023
        i, j = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda c: sum(p.sum() ** 2 / (q.sum() + 2.0) for p, q in four(*c)))
        found, table = quality._quadrants(grid, weight, 2.0)
        assert math.isclose(found, sum(p.sum() ** 2 / (q.sum() + 2.0) for p, q in four(i, j)))
        assert np.allclose([table[0, 0], table[0, -1], table[-1, 0], table[-1, -1]], [p.sum() / (q.sum() + 2.0) for p, q in four(i, j)])


def plain_templates(pages, s=urls.Settings()):
    """(host, shape) -> template, purity, from lists of paths, one prefix after another."""

    def variable(segment):
        stem = re.sub(r"\.[A-Za-z]{1,5}$", "", segment)
        return bool(re.search("[0-9]", stem) or re.search("^[0-9A-Fa-f-]{16,}$", stem) or len(stem) > 40)

    shapes = {}
    for host, path, blocked in pages:
        shape = tuple("*" if variable(p) else p for p in path.split("/") if p)
        n = shapes.setdefault((host, shape), [0, 0, 0])
        n[0] += 1
        n[1] += blocked is not None
        n[2] += bool(blocked)
    smooth = lambda bad, n, prior: (bad + s.strength * prior) / (n + s.strength)
    found = {}

    def walk(rows, depth, name, prior, up):
        """rows: of one prefix, [(key, counts)]; up: labelled and blocked pages of the prefix above."""
        labelled, bad = (sum(n[k] for _, n in rows) for k in (1, 2))
        outside = prior if up is None else smooth(up[1] - bad, up[0] - labelled, prior)
        deeper = [(key, n) for key, n in rows if len(key[1]) > depth]
        below = smooth(sum(n[2] for _, n in deeper), sum(n[1] for _, n in deeper), outside)
        for key, _ in rows:
            if len(rows) == 1 or len(key[1]) <= depth:
                found[key] = (name + key[1][depth:], outside if len(key[1]) > depth else below)
        if len(rows) == 1:
            return
        children = defaultdict(lambda: [0, 0, 0])
        for key, n in deeper:
            for k in range(3):
                children[key[1][depth]][k] += n[k]
        literal = [n for c, n in children.items() if c != "*"]
        told = [n for n in literal if n[1]]
        merge = len(literal) >= s.children and sum(n[0] for n in literal) < s.repeats * len(literal)
        if len(told) > 1:
            pooled = sum(n[2] for n in literal) / sum(n[1] for n in literal)
            chi = 0.0 if pooled in (0, 1) else sum((n[2] - n[1] * pooled) ** 2 / n[1] for n in told) / (pooled * (1 - pooled))
            merge = merge or chi <= len(told) - 1 + s.z * math.sqrt(2 * (len(told) - 1))
        groups = defaultdict(list)
        for key, n in deeper:
            groups["*" if merge else key[1][depth]].append((key, n))
        for child, own in groups.items():
            walk(own, depth + 1, name + (child,), outside, (labelled, bad))

    for host in {h for h, _ in shapes}:
        walk([(k, n) for k, n in shapes.items() if k[0] == host], 0, (), s.prior, None)
    total = defaultdict(lambda: [0, 0])
    for key, (template, _) in found.items():
        total[key[0], template][0] += shapes[key][1]
        total[key[0], template][1] += shapes[key][2]
    highest = {}
    for key, (template, prior) in found.items():
        highest[key[0], template] = max(prior, highest.get((key[0], template), 0.0))
    return {key: ("/" + "/".join(t), smooth(total[key[0], t][1], total[key[0], t][0], highest[key[0], t])) for key, (t, _) in found.items()}


def check_templates(spark, pages):
    want = plain_templates(pages)
    got = {(r["host"], tuple(r["shape"])): r for r in urls.templates(spark.createDataFrame(pages, "host string, path string, blocked boolean")).collect()}
    assert got.keys() == want.keys()
    for key, (template, purity) in want.items():
        assert got[key]["template"] == template and math.isclose(got[key]["purity"], purity, rel_tol=1e-9) and got[key]["rejected"] == (got[key]["purity"] >= 0.8)
    return {r["rejected"] for r in got.values()}


@pytest.mark.parametrize("seed", range(3))
def test_templates_by_plain_trees(spark, seed):
    rng = random.Random(seed)
    names = [a + b for a in "abcdefg" for b in "uvwxyz"]
    pages = []
    for _ in range(400):
        host = rng.choice(["a.com", "b.org"])
        path = "/" + "/".join(rng.choice([["shop", "news", "u"], names[: rng.choice((3, 30))], ["x", str(rng.randint(1, 99)), "y.html"]][min(k, 2)]) for k in range(rng.randint(0, 4)))
        blocked = None if rng.random() < 0.4 else (rng.random() < (0.95 if host == "a.com" and "shop" in path or path.startswith("/u") else 0.1))
        pages.append((host, path, blocked))
    check_templates(spark, pages)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_pages_are_judged_both_ways(spark):
    rows = urls.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    pages = [(r["host"], r["path"], None if r["rule"] is None else r["verdict"] == "block") for r in rows.collect()]
    assert check_templates(spark, pages) == {True, False}


def test_greedy_sequences_are_full():
    rng = random.Random(1)
    for window in (16, 64, 128):
        rest = [0] + [rng.choice((0, 0, 1, 2, 9)) for _ in range(window - 1)]
        before = list(rest)
        made = packing.greedy(rest, window)
        used = Counter()
        for lengths, times in made:
            assert sum(lengths) == window and times > 0
            used.update({n: k * times for n, k in Counter(lengths).items()})
        assert made and all(before[n] - used[n] == rest[n] >= 0 for n in range(window))
    assert packing.greedy([0, 0, 3, 0, 0, 2, 1, 0], 8) == [([6, 2], 1)]
    h = np.zeros(100, np.int64)
    h[[99, 1, 60, 25, 15]] = 5, 5, 3, 2, 6
    plan = packing.make_plan(h, 100)
    assert plan.sequences >= 7 and plan.sequences * 100 + plan.stream == int((h * np.arange(100)).sum())


def test_least_squares_come_near_the_histogram():
    h = np.zeros(64, np.int64)
    h[[10, 22, 32, 54, 42]] = 30, 12, 20, 25, 12
    combos = packing.combinations(np.flatnonzero(h), 64)
    x = packing.solve(combos, h, gain=1e-9)
    made = np.zeros(64)
    for (a, b, c), n in zip(combos.tolist(), x):
        for k in (a, b, c):
            made[k] += n * (k > 0)
    # a finer grid of plain coordinate descent can't do better
    best = np.zeros(len(combos))
    use = np.array([[(r == k).sum() for r in combos] for k in range(1, 64)], float)
    for _ in range(3000):
        for j in range(len(combos)):
            g = use[:, j] @ (h[1:] - use @ best)
            best[j] = max(0.0, best[j] + g / (use[:, j] @ use[:, j]))
    assert ((made - h)[1:] ** 2).sum() <= ((use @ best - h[1:]) ** 2).sum() + 1.0

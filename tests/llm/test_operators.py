"""The training-data operators against brute force on small tables with every awkward row."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstat.llm import ann, chat, decontaminate, fm_index, language_id, lm_score, packing, ppm, quality, simhash, tokens, urls

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, key string"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


TEXTS = [
    None, "", " \t\n", "Word", BASE, BASE, BASE + " one more", "  double  spaces \n\n\n here   and there ", "Ünïcödé wörds — “quoted”, 中文 字 ½ ²x!", "a\x00b c\x85d e\u2028f",
    "<|endoftext|> it's 'll 123 4.5", BASE.upper() + "!! ##", " ".join(f"w{i % 700}" for i in range(9000)), "x" * 5000, "12 34 ... ---", BASE.replace("pi", "pie"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en" if i % 2 else "de", None, None, 0.5, 7, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def ids_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 4, 400)
    text[0] = 0
    index = fm_index.FmIndex(text, 3, sample=5)
    patterns = rng.integers(1, 4, (60, 4))
    patterns[::3, :2] = -1
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        own = p[p >= 0]
        want = [i for i in range(len(text) - len(own) + 1) if (text[i : i + len(own)] == own).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("pass_bytes", [1 << 20, 100])
def test_decontamination(spark, docs, none, pass_bytes):
    items = [(1, BASE), (2, "one more"), (10, None), (None, "zeta eta theta"), (3, " ... "), (4, BASE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for name, text in items:
        w = ALNUM.findall(lower(text))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(None if name is None else str(name))
    found = {r["doc_id"]: r for r in decontaminate.mark(docs, bench, pass_bytes=pass_bytes).select("*", decontaminate.n_hit().alias("hit"), decontaminate.contaminated().alias("bad")).collect()}
    for doc_id, text in texts(docs).items():
        w, hit, names = ALNUM.findall(lower(text)), set(), set()
        for k, owners in windows.items():
            for i in range(len(w)):
                if tuple(w[i : i + len(k)]) == k:
                    hit.update(range(i, i + len(k)))
                    names.update(o for o in owners if o)
        r = found[doc_id]
        assert (r["__words"], r["hit"], sorted(names)) == (len(w), len(hit), r["__items"])
        assert r["bad"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.mark(none, bench).count() == 0
    assert decontaminate.mark(docs, bench.limit(0)).where("size(__spans) > 0").count() == 0


def test_spans_are_cut():
    assert decontaminate.cut_spans("Keep this, drop that now. End", [2, 4]) == "Keep this,  now. End"


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((600, 20)).tolist()
    v[5], v[6], v[7], v[8], v[9], v[40], v[41] = None, [0.0] * 20, [None] + [1.0] * 19, [float("nan")] * 20, [], v[60], v[60]
    rows = list(enumerate(v)) + [(600 + i, x) for i, x in enumerate(rng.standard_normal((50, 3)).tolist())]  # another width
    rows += [(None, v[60]), (None, v[61]), (20, v[100]), (20, v[20]), (640, [9.0] * 20), (660, [1.0])]  # no id, ids that repeat, one alone in its width
    table = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.search(table.repartition(3), F.col("vec_id") % 20 == 0, block=7).collect():
        got.setdefault(r["query_row"], []).append((r["rank"], r["query_id"], r["vec_id"], r["score"]))
    usable = [(i, np.array(x, np.float32).astype(float)) for i, x in rows if x and None not in x and any(x) and not np.isnan(x).any()]
    want, share = [], []
    for a, (q, x) in enumerate(usable):
        if q is not None and q % 20 == 0:
            others = sorted((-float(y @ x), i is None, i or 0) for b, (i, y) in enumerate(usable) if b != a and len(y) == len(x))
            want.append((q, [-s for s, _, _ in others][:20], [None if n else i for _, n, i in others][:20]))
    mine = [([x[1] for x in r][0], [x[3] for x in r], [x[2] for x in r]) for r in map(sorted, got.values())]
    assert all([x[0] for x in sorted(r)] == list(range(1, len(r) + 1)) for r in got.values())
    want = [w for w in want if w[1]]
    assert len(mine) == len(want) and sorted(len(x[1]) for x in mine) == sorted(len(x[1]) for x in want)
    for q, scores, ids in mine:
        near = min((w for w in want if w[0] == q and len(w[1]) == len(scores)), key=lambda w: float(np.abs(np.array(w[1]) - scores).sum()))
        share.append(sum(abs(a - b) < 1e-9 for a, b in zip(scores, near[1])) / len(scores))
        if share[-1] == 1:
            assert ids == near[2]
    assert np.mean(share) >= 0.95
    doubles = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    assert ann.search(doubles, F.col("vec_id") == 20, k=3).count() == 9
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_turning_keeps_inner_products():
    v = np.random.default_rng(4).standard_normal((30, 100))
    assert np.allclose(ann.turned(v) @ ann.turned(v).T, v @ v.T) and ann.turned(v[:, :1]).shape == (30, 1)


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 5000, "assistant", "yes"), (4, None, None, None), (4, 1, "tool", "x"), (5, 0, "user", "no")]
    turns = chat.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: (r["n_turns"], r["copies"], r["chat"]) for r in chat.render(turns, chat.maximal(turns)).collect()}
    assert got == {
        2: (2, 2, "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n"),
        4: (2, 1, "<|none|>\n<|end|>\n<|tool|>\nx<|end|>\n"),
        5: (1, 1, "<|user|>\nno<|end|>\n"),
    }
    assert chat.maximal(turns.limit(0)).count() == 0 and chat.render(turns.limit(0), chat.maximal(turns)).count() == 0


def test_chat_of_ids_that_are_null_or_hold_most_turns(spark):
    long = [(9, i // 3, "user", f"turn {i % 7}") for i in range(5000)]
    rows = long + [(None, i, r, t) for i, (_, _, r, t) in enumerate(long[:2000])] + [(8, *x[1:]) for x in long[:2400]] + [(1, None, None, "")] * 3 + [(7, None, None, "")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    turns = chat.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert turns.where("c = 9").select("chunk").distinct().count() > 1
    kept = chat.maximal(turns)
    # turns are ordered by the hash of the text within a number
    line = lambda x: f"<|{x[2] or 'none'}|>\n{x[3]}<|end|>\n"
    want = {i: "".join(line(x) for x in sorted((x for x in rows if x[0] == i), key=lambda x: (x[1] or 0, hashlib.sha256(x[3].encode()).hexdigest()))) for i in (None, 9, 1)}
    parts = {}
    for r in chat.render(turns, kept, part=100).collect():
        parts.setdefault(r["conv_id"], {})[r["part"]] = r["chat"]
    assert {i: "".join(p[k] for k in sorted(p)) for i, p in parts.items()} == want
    assert sorted(parts[9]) == list(range(50)) and parts[9][3].count("<|end|>") == 100


def test_urls(spark):
    given = [None, "", "no shape", "http://a.COM/en/1?x", "http://example.com/en/7x", "http://x.example.net/de/80#f", "http://y.net/de/3", "http://com/fr/1", "ftp://notcom/en/1", "http://h.com/EN/1", "x://b.org/es/2://c.com/en/"]
    rows = {r["url"]: r for r in urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")).join(spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string"), "page_id").collect()}
    want = {None: ("", "", None), "": ("", "", None), "no shape": ("", "", None), "http://a.COM/en/1?x": ("a.com", "/en/1", "com/en/"), "http://example.com/en/7x": ("example.com", "/en/7x", "example.com/en/7"), "http://x.example.net/de/80#f": ("x.example.net", "/de/80", "example.net/de/8"), "http://y.net/de/3": ("y.net", "/de/3", "net/de/"), "http://com/fr/1": ("com", "/fr/1", None), "ftp://notcom/en/1": ("notcom", "/en/1", None), "http://h.com/EN/1": ("h.com", "/EN/1", None), "x://b.org/es/2://c.com/en/": ("b.org", "/es/2:", "org/es/")}
    for u, (host, path, rule) in want.items():
        if u and u.startswith("x://"):
            path = "/es/2://c.com/en/"
        assert (rows[u]["host"], rows[u]["path"], rows[u]["rule"]) == (host, path, rule)
        if rule:
            assert rows[u]["verdict"] == ("allow" if rule in ("example.com/en/7", "net/de/") else "block")


def test_url_templates_learn_from_labels(spark):
    bad = [(f"/shop/{i}", True) for i in range(40)] + [("/shop/999", None)]
    good = [(f"/news/{i}", False) for i in range(40)] + [("/news/999", None), ("/other/x", None)]
    found = urls.templates(spark.createDataFrame([("h", p, b) for p, b in bad + good], "host string, path string, blocked boolean"))
    assert {r["template"]: r["rejected"] for r in found.collect()} == {"/shop/*": True, "/news/*": False, "/other/x": False}


def test_url_levels_are_merged_from_the_root(spark):
    names = [a + b for a in "abcdef" for b in "uvwxyz"]
    rows = [("h", f"/u/{n}/{n}-post", True if i < 20 else None) for i, n in enumerate(names)] + [("h", "/about/team/us", False), ("h", "/", False), ("g", "/a/b/c/d", None)]
    got = {(r["host"], "/".join(r["shape"])): (r["template"], r["rejected"]) for r in urls.templates(spark.createDataFrame(rows, "host string, path string, blocked boolean")).collect()}
    want = {("h", f"u/{n}/{n}-post"): ("/u/*/*", True) for n in names}
    assert got == {**want, ("h", "about/team/us"): ("/about/team/us", False), ("h", ""): ("/", False), ("g", "a/b/c/d"): ("/a/b/c/d", False)}


def test_url_siblings_without_labels_are_judged(spark):
    rows = [("one", f"/en/{i}", True) for i in range(40)] + [("one", "/fr/1", None), ("one", "/", None)]
    rows += [("few", f"/en/{i}", True) for i in range(11)] + [("few", "/fr/1", None)]
    rows += [("two", f"/{c}/{i}", True) for c in ("a", "b") for i in range(10)] + [("two", "/c/1", None)]
    rows += [("apart", f"/a/x/{i}", True) for i in range(40)] + [("apart", f"/b/x/{i}", False) for i in range(40)] + [("apart", "/a/y/1", None), ("apart", "/b/y/1", None)]
    rows += [("deep", "/a/b/c/d/e/1", True), ("deep", "/a/b/c/d/e/f/1", None)]
    found = urls.templates(spark.createDataFrame(rows, "host string, path string, blocked boolean"))
    assert {(r["host"], r["template"]): r["rejected"] for r in found.collect()} == {
        ("one", "/en/*"): True, ("one", "/fr/*"): True, ("one", "/"): True, ("few", "/en/*"): False, ("few", "/fr/*"): False, ("two", "/*/*"): True,
        ("apart", "/a/x/*"): True, ("apart", "/b/x/*"): False, ("apart", "/a/y/*"): True, ("apart", "/b/y/*"): False,
        ("deep", "/a/b/c/d/e/*"): False, ("deep", "/a/b/c/d/e/f/*"): False,
    }


def test_ppm_is_a_distribution_and_exact():
    """Against a plain trie with escapes and exclusion, symbol by symbol."""
    data = np.frombuffer(b"abracadabra abracabra" * 3 + b"xyz", np.uint8)
    keys, _ = ppm.gram_keys(data, np.array([0, 30, len(data)]), 2)
    new, n = np.unique(keys, return_counts=True)
    orders = [(new, n[:, None].astype(float))]
    for j in (1, 0):
        orders.insert(0, ppm.suffix_orders(orders[0][0] & np.uint64((1 << 8 * (j + 1)) - 1), orders[0][1]))
    model = ppm.Model(orders)

    def plain(context, symbol):
        p, out = 1.0, set()
        for j in (2, 1, 0):
            own = context & ((1 << 8 * j) - 1)
            seen = {int(k) & 255: c for k, c in zip(orders[j][0], orders[j][1][:, 0]) if int(k) >> 8 == own}
            if not seen:
                continue
            left = {s: c for s, c in seen.items() if s not in out}
            total = sum(left.values())
            if symbol in left:
                return p * (left[symbol] - 0.5) / total
            p *= 0.5 * len(left) / total if left else 1.0
            out |= set(seen)
        return p / (256 - len(out))

    for context in (0x6162, 0x7A7A, 0xFEFE, 0x6120):
        want = [plain(context, s) for s in range(256)]
        got = np.exp(model.chain((np.uint64(context) << np.uint64(8)) + np.arange(256, dtype=np.uint64))[:, 0])
        assert np.allclose(got, want, rtol=1e-4) and abs(sum(want) - 1) < 1e-9


@pytest.mark.parametrize("head", [1 << 19, 2])
def test_lm_scores(docs, none, head):
    got = {r["doc_id"]: r for r in lm_score.score(docs, lm_score.remainder("doc_id", 7) != 2, head=head).collect()}
    own = {d: [*SPACED.findall(lower(t)), None] for d, t in texts(docs).items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in own}
    counts = Counter(w for d, ws in own.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in own.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm_score.score(none, lm_score.remainder("doc_id", 7) != 2).count() == 0


@pytest.mark.parametrize("nodes", [1 << 20, 40, 0])
def test_lm_scores_come_from_the_whole_trie(docs, nodes):
    """However few keys are broadcast, against one model of all training texts."""
    own = {d: lower(t).encode() for d, t in texts(docs).items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in own}

    def joined(ids):
        return np.frombuffer(b"".join(own[d] for d in ids), np.uint8), np.cumsum([0, *(len(own[d]) for d in ids)])

    new, n = np.unique(ppm.gram_keys(*joined([d for d in own if not held[d]]), lm_score.ORDER)[0], return_counts=True)
    orders = [(new, n[:, None].astype(float))]
    for j in range(lm_score.ORDER - 1, -1, -1):
        orders.insert(0, ppm.suffix_orders(orders[0][0] & np.uint64((1 << 8 * (j + 1)) - 1), orders[0][1]))
    want = dict(zip(own, ppm.Model(orders).text_logs(*joined(own))[:, 0] / math.log(10)))
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, lm_score.remainder("doc_id", 7) != 2, nodes=nodes).collect()}
    assert any(held.values()) and got.keys() == want.keys()
    assert all(math.isclose(got[d], want[d], rel_tol=1e-5) for d in want)
    nothing = lm_score.score(docs, F.lit(False), nodes=nodes).collect()
    assert all(math.isclose(r["score"], -(len(own[r["doc_id"]]) + 1) * math.log10(256), rel_tol=1e-6) for r in nothing)


def test_language(spark, docs, none):
    en, de = "the cat and the dog run to the house with a ball", "der hund und die katze laufen mit dem ball zu dem haus"
    rows = [(i, (en if i % 2 else de) + f" {i}", "en" if i % 2 else "de") for i in range(60)] + [(100, en, None), (101, None, "en")]
    langs, model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") >= 0)
    assert langs == ["de", "en"]
    asked = spark.createDataFrame([(1, "the dog"), (2, "dem hund"), (3, None), (4, ""), (5, "12 !"), (6, "中")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(asked, langs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"] and got[6]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    langs, model = language_id.fit(none, F.lit(True))
    assert [r["lang_pred"] for r in language_id.identify(asked, langs, model).collect()] == ["und"] * 6
    # with a sample bound in bytes, one long text can't crowd out a language
    many = spark.createDataFrame([(i, en + str(i), "en") for i in range(400)] + [(1000, de * 3000, "de"), (1001, de, "de")], "doc_id long, text string, lang string")
    assert language_id.fit(many, F.lit(True), sample=4000)[0][-1] == "en"


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_tokens_round_trip(spark, docs, none, tmp_path, encoding):
    path = str(tmp_path / "t")
    tokens.write_tokens(tokens.encode_sorted(docs), path, encoding)
    rows = tokens.with_starts(spark, path, tokens.digest(tokens.read_tokens(spark, path))).collect()
    at = 0
    for r, (doc_id, text) in zip(sorted(rows, key=lambda r: r["doc_id"]), sorted(texts(docs).items())):
        ids = ids_of(text) + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.read_tokens(spark, path, ("doc_id", "ids"), (3, 9)).count() == 3
    tokens.write_tokens(tokens.encode_sorted(none), str(tmp_path / "e"))
    assert tokens.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs, window=64).collect()
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in texts(docs).items():
        ids, at = ids_of(text) + [1], 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in places.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64 and at & (at - 1) == 0
    assert packing.pack(none).count() == 0


def test_plan_keeps_to_the_histogram():
    h = np.random.default_rng(2).integers(0, 40, 128)
    h[0] = 0
    plan = packing.make_plan(h, 128)
    assert (plan.covered <= h).all() and plan.sequences * 128 + plan.stream == (h * np.arange(128)).sum()
    assert plan.stream < 0.2 * (h * np.arange(128)).sum()


def test_quality(spark, docs, none):
    rows = [(i, ("plain words in a row " * (3 + i % 4)) if i % 3 else "BAD!! WORDS!! " * (2 + i % 5)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(table, labels, lm_score.remainder("doc_id", 5) != 0)
    got = quality.scored(table, model).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got]) > 0.98
    again = quality.scored(docs, model).collect()
    assert len(again) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in again)
    assert quality.scored(docs, model, least=2.0).count() == 0 and quality.scored(docs, model, least=0.0).columns == docs.columns
    assert quality.scored(docs, quality.fit(none, labels, F.lit(True))).first()["score"] == 0.5


def simhash_of(text):
    w = SPACED.findall(lower(text))
    parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, bits=4):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_simhash(docs, none):
    own = sorted(texts(docs).items())
    prints = [simhash_of(t) for _, t in own]
    want = {d: (p, own[g][0]) for (d, _), p, g in zip(own, prints, groups(prints))}
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    kept = simhash.keep_one(docs.union(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_component_is_kept_whatever_its_id(spark):
    a, b, c, d = (" ".join(f"{name}{i}" for i in range(40)) for name in "abcd")
    rows = [(None, a), (None, b), (7, a), (5, a + " "), (5, c), (6, c), (5, c), (None, d), (None, d.upper()), (None, None), (None, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(((r["doc_id"], lower(r["text"]).strip()) for r in kept.collect()), key=str) == sorted([(5, a), (None, b), (5, c), (None, d), (None, "")], key=str)


@pytest.mark.parametrize("bucket", [20_000, 5])
def test_simhash_links_are_complete(spark, bucket):
    rng = np.random.default_rng(8)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = set(map(int, seeds))
    for s in map(int, seeds):
        for _ in range(25):
            x = s
            for b in rng.integers(0, 64, int(rng.integers(1, 7))):
                x ^= 1 << int(b)
            values.add(x)
    values = sorted(values)
    table = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(table, bucket=bucket)).collect()}
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    found = [label.get(s, s) for s in signed]
    want = groups(values)
    assert len(set(zip(found, want))) == len(set(want)) == len(set(found))


def test_words_hash_alike_everywhere():
    from inkstat.llm import common

    data = np.frombuffer(b"abcdefghijklmnopq xabcdefghijklmnopq abc", np.uint8)
    h = common.word_hashes(data, np.array([0, 19, 37, 0]), np.array([17, 36, 40, 3]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")

"""Language, periodic runs and ranked search against brute force, and the parts of older operators that SQL cannot show."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginflow.llm import langid, toxicity
from marginflow.llm.langid import Pieces, expected, forward, learn, predict, units_of, vocabulary_path
from marginflow.llm.lexical import search
from marginflow.llm.packing import pack
from marginflow.llm.periodic import collapse_runs, find_runs
from marginflow.llm.quality import RULES, apply_cutoffs, cutoffs
from marginflow.llm.sharding import shard

# -- periodic runs ------------------------------------------------------------


def runs_by_hand(words, least):
    """All maximal stretches of every period, the smallest period of each."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n_, q) for (s, n_), q in best.items())


def periodic_words(draw, size, kinds):
    words = []
    while len(words) < size:
        if draw.random() < 0.6:
            words += [draw.randrange(kinds) for _ in range(draw.randint(1, 12))] * draw.randint(1, 8)
        else:
            words += [draw.randrange(kinds) for _ in range(draw.randint(1, 10))]
    return [b"%d" % w for w in words[:size]]


@pytest.mark.parametrize("least", [3, 6, 10, 24])
def test_runs_equal_those_by_hand(least):
    draw = random.Random(least)
    for _ in range(120):
        texts = [periodic_words(draw, draw.choice([0, 1, 5, 30, 90, 250]), draw.choice([1, 2, 3, 5, 40])) * draw.choice([1, 1, 4]) for _ in range(draw.randint(1, 4))]
        runs, many = find_runs(texts, least)
        ends = np.cumsum(many)
        for text, n, end in zip(texts, many, ends):
            assert list(map(tuple, runs[end - n : end].tolist())) == runs_by_hand(text, least)


def test_runs_of_long_texts():
    one = [b"a"] * 60_000
    nested = ([b"x", b"y"] * 6 + [b"z"]) * 900
    fibonacci = [b"b"], [b"a"]
    for _ in range(18):
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    unlike = [b"%d" % k for k in range(50_000)]
    runs, many = find_runs([one, nested, fibonacci[1][:3000], unlike])
    assert many[0] == 1 and tuple(runs[0]) == (0, 60_000, 1) and many[3] == 0
    at = many[0]
    assert list(map(tuple, runs[at : at + many[1]].tolist())) == [(0, len(nested), 13)]
    assert list(map(tuple, runs[at + many[1] :].tolist())) == runs_by_hand(fibonacci[1][:3000], 24)


def test_runs_where_hashes_agree_by_chance():
    """Words in the order of Thue and Morse collide in any hash by powers of two; runs beside them are still found."""
    order = [0]
    while len(order) < 8192:
        order += [1 - x for x in order]
    words = [b"%d" % x for x in order] * 3 + [b"a", b"b"] * 40
    runs, many = find_runs([words[:4096] + [b"a", b"b"] * 40, words])
    got = list(map(tuple, runs.tolist()))
    for text, mine in ((words[:4096] + [b"a", b"b"] * 40, got[: many[0]]), (words, got[many[0] :])):
        assert (len(text) - 80, 80, 2) in mine
        for start, length, period in mine:
            part = text[start : start + length]
            assert part[period:] == part[:-period] and length >= max(24, 3 * period)
            assert start == 0 or text[start - 1] != text[start - 1 + period]
            assert start + length == len(text) or text[start + length] != text[start + length - period]
    # Three whole copies are a run of their own length.
    assert any(length >= 3 * 8192 for _, length, _ in got[many[0] :])


def test_collapsing_keeps_the_first_period(spark):
    song = "row the boat ashore " * 9
    rows = [(1, f"start {song}end here", "keep", 3), (2, None, "keep", None), (3, "", "x", 1), (4, "a  b\tc", "x", 1), (1, f"start {song}end here", "keep", 3), (None, "w " * 30, "x", 0)]
    out = collapse_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, _x int")).collect()
    got = Counter((r["doc_id"], r["text"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"])) for r in out)
    first = (1, "start row the boat ashore end here", 39, ((1, 36, 4),))
    assert got == Counter([first, first, (2, "", 0, ()), (3, "", 0, ()), (4, "a b c", 3, ()), (None, "w", 30, ((0, 30, 1),))])
    assert collapse_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- ranked search ------------------------------------------------------------


def terms(text):
    folded = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def ranked_by_hand(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = set()
    for item, wanted in asked.items():
        scored = []
        for (doc, bag), n in zip(bags, sizes):
            m = 10 + 90 * n * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in wanted if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:top], 1):
            out.add((item, rank, doc, -score))
    return out


@pytest.mark.parametrize("block", [7, 10_000])
def test_search_equals_the_formula(spark, block):
    draw = random.Random(block)
    vocabulary = [f"t{k}" for k in range(40)] + ["É", "naïve", "日本", "X1y", "42"]
    prose = lambda n: draw.choice([" ", "\n", ", ", "\x00", "-"]).join(draw.choice(vocabulary) for _ in range(n))
    texts = [prose(draw.choice([0, 1, 3, 20, 200])) for _ in range(60)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(100 + k, texts[k % 3 + 5]) for k in range(40)] + [(None, texts[5]), (None, texts[9]), (7, texts[5]), (200, None), (201, ""), (202, "T1 t1 T2")]
    items = [(k, prose(draw.choice([1, 4, 30]))) for k in range(12)] + [(3, "t5 T6"), (50, None), (51, "not there"), (None, "t1 t2"), (None, "t3")]
    got = search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), top=10, block_terms=block).collect()
    assert {tuple(r) for r in got} == ranked_by_hand(docs, items, 10) and len(got) > 80
    assert len({(r["item_id"], r["rank"]) for r in got}) == len(got)


def test_search_without_documents_or_items(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "b")], "item_id string, text string")
    assert search(docs.limit(0), items).count() == search(docs, items.limit(0)).count() == search(docs, items.withColumn("text", F.lit(None).cast("string"))).count() == 0
    assert [tuple(r)[:3] for r in search(docs, items).collect()] == [("x", 1, 1)]


# -- language -----------------------------------------------------------------


def cuts(unit, names):
    """All segmentations of a unit into pieces."""
    if not unit:
        yield ()
    for k in range(1, len(unit) + 1):
        if unit[:k] in names:
            for rest in cuts(unit[k:], names):
                yield (unit[:k], *rest)


@pytest.fixture(scope="module")
def pieces():
    return Pieces(vocabulary_path())


def test_forward_sums_all_segmentations(pieces):
    p = np.random.default_rng(1).random((len(pieces.names), 3))
    p /= p.sum(axis=0)
    number = {n: k for k, n in enumerate(pieces.names)}
    units = [b" the", b" thing", " né".encode(), b" q", b"inging", b" and"]
    got = forward(pieces, p, units)
    for k, unit in enumerate(units):
        ways = list(cuts(unit, number))
        assert len(ways) > 1
        assert got[k] == pytest.approx(np.log(sum(np.prod([p[number[x]] for x in way], axis=0) for way in ways)))
    counts = expected(pieces, p, units, np.array([0, 1, 2, 0, 1, 1]), np.array([2.0, 1, 1, 1, 3, 1]))
    want = np.zeros_like(counts)
    for unit, lang, n in zip(units, [0, 1, 2, 0, 1, 1], [2.0, 1, 1, 1, 3, 1]):
        weights = {way: np.prod([p[number[x], lang] for x in way]) for way in cuts(unit, number)}
        for way, w in weights.items():
            for x in way:
                want[number[x], lang] += n * w / sum(weights.values())
    assert np.allclose(counts, want)


def test_units_are_runs_of_letters():
    assert units_of("l'été,42x") == [b" l", " été".encode(), b" x"] and units_of("1234!") == []
    long = "ab" * 100
    assert b"".join(units_of(long)) == b" " + long.encode() and max(map(len, units_of(long))) == langid.LONGEST


def test_language_is_learned_and_ties_are_settled(spark):
    draw = random.Random(6)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "ich"], "日": ["日本", "語学", "東京", "水曜"]}
    word = lambda lang: "".join(draw.choice(sounds[lang]) for _ in range(draw.randint(1, 3)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(k, text(lang, draw.choice([3, 30, 300])), lang, "clash", "en") for k, lang in enumerate(list(sounds) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred string")
    model = learn(df.where("doc_id % 4 <> 2"))
    assert model.langs == sorted(sounds) and np.allclose(model.p.sum(axis=0), 1, atol=1e-3)
    out = {r["doc_id"]: r for r in predict(df, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(out[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    odd = [(1, None), (2, ""), (3, "1234 !!"), (4, "x" * 500_000), (5, "KATO mira"), (5, "kato MIRA"), (None, "schung einich")]
    got = predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    found = defaultdict(set)
    for r in got:
        found[r["doc_id"]].add((r["lang_pred"], r["score"]))
    assert found[1] == found[2] == found[3] == {("und", 0.0)} and len(found[5]) == 1 and {x for x, _ in found[5]} == {"aa"} and {x for x, _ in found[None]} == {"bb"}
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(odd)
    # Nothing to learn from, and nothing to judge.
    nothing = learn(df.where("doc_id < 0"))
    assert {tuple(r) for r in predict(df.select("text"), nothing).distinct().collect()} == {("und", 0.0)}
    assert predict(df.limit(0), model).count() == 0


# -- older operators ----------------------------------------------------------


def test_packing_is_the_tightest_compatible_bin():
    """A quadratic best fit over all bins, with conflicts of sources and clusters that do fire."""
    draw = random.Random(5)
    conflicts = [("a", "b"), ("c", "d")]
    forbidden = {frozenset(c) for c in conflicts}
    for _ in range(30):
        rows = sorted(((draw.randint(0, 50), draw.choice("abcde"), draw.choice([None, None, 1, 2, 65, 66])) for _ in range(80)), key=lambda r: -r[0])
        bins, fired = [], 0
        want = []
        for words, source, cluster in rows:
            fit = [(50 - sum(x[0] for x in b), k) for k, b in enumerate(bins) if 50 - sum(x[0] for x in b) >= words]
            free = [(room, k) for room, k in fit if not any(frozenset((source, x[1])) in forbidden or (cluster is not None and cluster == x[2]) for x in bins[k])]
            fired += len(free) < len(fit)
            if free:
                room, k = min(free)
            else:
                room, k = 50, len(bins)
                bins.append([])
            want.append((k, 50 - room))
            bins[k].append((words, source, cluster))
        assert pack(rows, 50, conflicts) == want and fired > 5


def test_toxicity_gradients_match_differences(monkeypatch):
    """Back-propagation through both directions and the attention, in double precision, against finite differences."""
    monkeypatch.setattr(np, "float32", np.float64)
    net = toxicity.Network(3)
    draw = np.random.default_rng(4)
    steps, n = 7, 3
    x = draw.normal(0, 1, (steps, n, 6 * toxicity.HIDDEN))
    mask = np.arange(steps)[:, None] < np.array([7, 4, 1])
    x *= mask[:, :, None]
    pull = draw.normal(0, 1, n)
    loss = lambda: float(net.forward(x, mask) @ pull)
    _, kept = net.forward(x, mask, keep=True)
    g, dx = net.backward(mask, kept, pull)
    for name in ("fh", "bh", "att", "key", "out"):
        flat = net.p[name].reshape(-1)
        for k in draw.choice(len(flat), 6, replace=False):
            was = flat[k]
            flat[k] = was + 1e-4
            up = loss()
            flat[k] = was - 1e-4
            down = loss()
            flat[k] = was
            assert g[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-4, rel=1e-2, abs=1e-4), name
    for at in [(0, 0, 0), (3, 1, 30), (6, 0, 47), (0, 2, 10)]:
        was = x[at]
        x[at] = was + 1e-4
        up = loss()
        x[at] = was - 1e-4
        down = loss()
        x[at] = was
        assert dx[at] == pytest.approx((up - down) / 2e-4, rel=1e-2, abs=1e-4)


def test_every_shard_matches_the_mixture(spark):
    draw = random.Random(2)
    rows = [(k if k % 9 else None, draw.choice(["hot"] * 6 + ["b", "b", "c", None]), f"text {k % 700}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    runs = [shard(df.repartition(n), shards=8).collect() for n in (3, 11)]
    total = Counter(s for _, s, _ in rows)
    for out in runs:
        each = defaultdict(Counter)
        for r in out:
            each[r["shard"]][r["source"]] += 1
        assert len(out) == 4000 and {sum(c.values()) for c in each.values()} == {500}
        assert all(abs(c[s] - total[s] / 8) <= 2 for c in each.values() for s in total)
    key = lambda out: sorted(map(repr, ((r["shard"], r["slot"], r["doc_id"], r["source"], r["text"]) for r in out)))
    assert key(runs[0]) == key(runs[1])


def tail(k, n, rate):
    return sum(math.comb(n, i) * rate**i * (1 - rate) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("alpha", [0.05, 0.2])
def test_certified_cutoffs_equal_the_ladder_by_hand(spark, alpha):
    """Strata large enough to certify, values that tie with cutoffs, and the promise on a second holdout."""
    draw, delta = random.Random(17), 0.05
    ladder = list(RULES.items())
    rows, labels = [], []
    for k in range(6000):
        lang = draw.choice(["en", "en", "fr", None])
        values = []
        for name, steps in ladder:
            low = min(steps)
            x = draw.choice(steps) if draw.random() < 0.01 else low * draw.random()
            values.append(float(x))
        rows.append((k, lang, draw.random() < 0.02, *values))
        labels.append((k, int(draw.random() < 0.9)))
    names = [n for n, _ in ladder]
    features = spark.createDataFrame(rows, "doc_id long, lang string, base_failed boolean, " + ", ".join(f"{n} double" for n in names))
    marks = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int")
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in cutoffs(features, marks, alpha=alpha, delta=delta).collect()}
    good = {d for d, q in labels if q and d % 2}
    strata = {"=" + s if s else "null" for s in ("en", "fr", None)}
    want = {}
    for stratum in strata:
        held = [r for r in rows if r[0] in good and not r[2] and ("=" + r[1] if r[1] else "null") == stratum]
        for j, (name, steps) in enumerate(ladder):
            for cutoff in steps:
                k = sum(r[3 + j] > cutoff for r in held)
                if not (k < alpha / len(RULES) * len(held) and tail(k, len(held), alpha / len(RULES)) <= delta / (len(strata) * len(RULES))):
                    break
                want[stratum, name] = min(cutoff, want.get((stratum, name), cutoff))
    assert got == want and len({s for s, _ in got}) == (3 if alpha > 0.1 else len({s for s, _ in want})) and want
    # Of the good documents that were not used, no stratum loses more than the promised share.
    kept = {r["doc_id"]: r["kept"] for r in apply_cutoffs(features, cutoffs(features, marks, alpha=alpha, delta=delta)).collect()}
    for stratum in strata:
        second = [r[0] for r in rows if r[0] % 2 == 0 and labels[r[0]][1] and not r[2] and ("=" + r[1] if r[1] else "null") == stratum]
        assert sum(not kept[d] for d in second) <= alpha * len(second)

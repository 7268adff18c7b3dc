"""The n-gram join and every pipeline stage against brute-force versions, each on its own input."""

import hashlib
import importlib.util
import math
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from marginflow.llm.jaccard import jaccard_join

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(seed=7):
    """Own texts, near and exact copies in groups, shared lines and passages, nulls and very short and long texts."""
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [pick.choice(vocabulary) for _ in range(n)]
    notice = "All rights of this page are reserved by its owner"
    passage, rows = prose(60), []

    def add(tokens, line=None):
        text = " ".join(tokens) if not isinstance(tokens, str) else tokens
        rows.append((len(rows), text + (f"\n{line}\nend of page {len(rows)}" if line else ""), pick.choice(["en", "fr"]), pick.choice(["a", "a", "a", "b", "c", None])))

    for _ in range(40):
        add(prose(pick.randint(25, 120)), notice if pick.random() < 0.5 else None)
    for _ in range(10):
        add(prose(30) + passage + prose(30))
    for size in (2, 5, 25):
        base = prose(90)
        for k in range(size):
            near = list(base)
            for _ in range(pick.choice([0, 1, 1, 2, 3])):
                near[pick.randrange(90)] = f"x{k}"
            add(near)
    add(prose(5000))
    add(" ".join(rows[0][1].split()).upper())
    for text in ("", "two words", "Two  WORDS", "the same eight words come again and again " * 30):
        add(text)
    rows += [(len(rows), None, "en", "a"), (len(rows) + 1, None, None, None)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def components_of(rows, ngram, percent):
    sets = {}
    for i, text, *_ in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
        sets[i] = {tuple(w[k : k + ngram]) for k in range(max(1, len(w) - ngram + 1))} if w else set()
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((top(a), top(b)))
                least[high] = low
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, rows, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, *_ in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize(("ngram", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_join_finds_every_link(docs, rows, ngram, percent):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(docs, ngram, percent).collect()}
    assert got == components_of(rows, ngram, percent)


def test_quality_stage(spark, docs, rows, folder):
    """So few labels certify no cutoff: the base rules alone decide."""
    kept = set()
    for i, text, *_ in rows:
        w, at = words(text), defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        repeated = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        if len(w) >= 20 and 100 * len(repeated) <= 30 * len(w):
            kept.add(i)
    out = STAGES["quality rules"](spark, docs, folder)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept and 0 < len(kept) < len(rows)


def test_line_stage(spark, docs, rows, folder):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(" \t\n\x0b\x0c\r").lower()].add(i)
    drops = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    want = {i: "\n".join(x for x in (text or "").split("\n") if drops.get(x.strip(" \t\n\x0b\x0c\r").lower(), i) == i) for i, text, *_ in rows}
    out = STAGES["line dedup"](spark, docs, folder)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == docs.columns and got == want and drops


def best_rows(rows):
    """Row numbers that stay: of each component of different (doc_id, text) the longest, then the largest doc_id."""
    texts = {}
    for k, r in enumerate(rows):
        texts.setdefault((r[0], r[1] or ""), k)
    linked = components_of([(k, text) for (_, text), k in texts.items()], 5, 80)
    groups = defaultdict(list)
    for (i, text), k in texts.items():
        groups[linked[k][1]].append((len(text), -(10**9) if i is None else i, i, text))
    return sorted(((i, text) for v in groups.values() for _, _, i, text in [max(v, key=lambda g: g[:2])]), key=repr)


def test_near_duplicate_stage(spark, docs, rows, folder):
    out = STAGES["n-gram Jaccard join"](spark, docs, folder)
    assert out.columns == docs.columns and sorted(((r["doc_id"], r["text"] or "") for r in out.collect()), key=repr) == best_rows(rows)


def test_near_duplicates_are_judged_row_by_row(spark, folder):
    """Repeated and null ids, equal rows, clashing columns: another text of a doc_id is no copy, and copies without an id go."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a + " more"), (5, b), (5, b), (None, c), (None, c), (None, c + " end"), (7, c), (None, b + " x"), (8, None), (8, ""), (9, ""), (None, ""), (None, None), (3, "short one"), (4, "short one")]
    df = spark.createDataFrame([(i, t, "en", None, k % 2, "clash", "clash") for k, (i, t) in enumerate(rows)], SCHEMA + ", component_id string, class string").repartition(3)
    out = STAGES["n-gram Jaccard join"](spark, df, folder)
    got = sorted(((r["doc_id"], r["text"] or "") for r in out.collect()), key=repr)
    assert out.columns == df.columns and got == best_rows(rows)
    assert {t for _, t in got} == {a + " more", b + " x", c + " end", "", "short one"}


def test_shared_lines_survive_line_dedup_and_near_duplicates(spark, rows, docs, folder):
    """Near copies that share lines: the copy that kept the lines is the one that stays."""
    body = " ".join(f"w{k}" for k in range(60))
    lines = ["this line is held by many pages", "so is this one, and by all of the copies"]
    own = [(k, f"{body} {k}\n" + "\n".join(lines[: 1 + k % 2]), "en", "a", 0) for k in range(12)] + [(50 + k, f"other page {k} " + " ".join(f"p{k}x{j}" for j in range(30)) + "\n" + lines[k % 2], "en", "b", 0) for k in range(4)]
    thin = STAGES["line dedup"](spark, spark.createDataFrame(own, SCHEMA), folder)
    left = [r["text"] for r in STAGES["n-gram Jaccard join"](spark, thin, folder).collect()]
    assert len(left) == 5 and all(sum(line in t.split("\n") for t in left) == 1 for line in lines)


def test_every_stage_takes_null_ids_and_repeats_alike(spark, folder):
    """Two runs over other partitions give the same rows, whatever ids are missing or repeated."""
    base = [(None if k % 3 == 0 else k % 40, " ".join(f"v{k}x{j}" for j in range(20 + k % 30)), "en", ["a", "b", None][k % 3 and k % 2], 0) for k in range(200)]
    rows = base + base[:20]
    for name, stage in corpus_pipeline.STAGES:
        keep = ["doc_id", "text", "source"]
        got = [sorted(map(repr, stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(n), folder).select(keep).collect())) for n in (2, 7)]
        assert got[0] == got[1] and got[0], name


def test_mixing_stage(spark, docs, rows, folder):
    by = defaultdict(list)
    for i, text, _, source, _ in rows:
        by[source].append((hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), i, len(words(text))))
    sizes = {s: sum(n for *_, n in v) for s, v in by.items()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    free, budget, capped = set(by), 1.5 * sum(sizes.values()), {}
    while free:
        level = (budget - sum(capped.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not above:
            break
        capped |= {s: 2 * sizes[s] for s in above}
        free -= above
    want = Counter()
    for s, v in by.items():
        target, begin = math.floor(capped.get(s, level * weight[s]) + 0.5), 0
        for _, i, n in sorted(v):
            for k in (0, 1):
                taken = max(0, min(n, target - begin - k * sizes[s]))
                want[i] += taken > 0 and 2 * taken >= n
            begin += n
    out = STAGES["mixing sources to target weights"](spark, docs, folder)
    assert out.columns == docs.columns and Counter(r["doc_id"] for r in out.collect()) == +want


def test_packing_stage(spark, docs, rows, folder):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in STAGES["best-fit packing"](spark, docs, folder).collect():
        bins[r["bin_id"]].append(r)
        pieces[r["doc_id"]].append((r["piece"], r["text"]))
    assert {i: "".join(t for _, t in sorted(v)) for i, v in pieces.items()} == {i: t or "" for i, t, *_ in rows}
    for v in bins.values():
        assert sum(r["n_words"] for r in v) <= 2048
        clusters = [r["cluster"] for r in v if r["cluster"] is not None]
        assert len(clusters) == len(set(clusters))


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"bin_id", "doc_id", "text"} <= set(out.columns)


def test_stages_take_empty_tables(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_the_pipeline_is_registered():
    assert importlib.util.find_spec("__spark_entry__")
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()


def brute_signatures(text):
    """The signature sets of a text by hand: each common word with the next three content words."""
    from marginflow.llm.spotsigs import ANCHORS, CHAIN

    t = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    found = set()
    for i, w in enumerate(t):
        chain = [x for x in t[i + 1 :] if x not in ANCHORS][:CHAIN]
        if w in ANCHORS and len(chain) == CHAIN:
            found.add((w, *chain))
    return found or ({tuple(t)} if t else set())


def test_fingerprints_and_likeness_by_hand(spark):
    from marginflow.llm.spotsigs import alike, edited_fingerprints

    pick = random.Random(2)
    glue, content = ["the", "of", "and", "la", "und"], [f"c{k}" for k in range(60)]
    prose = lambda n: " ".join(pick.choice(glue if pick.random() < 0.3 else content) for _ in range(n))
    texts = {k: prose(pick.choice([3, 30, 200])) for k in range(60)}
    for k in range(60, 90):
        near = texts[k % 20].split()
        near[pick.randrange(len(near))] = f"x{k}"
        texts[k] = " ".join(near)
    texts |= {90: None, 91: "", 92: texts[3], 93: texts[3].upper(), 94: "the of and"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {k: brute_signatures(t) for k, t in texts.items()}
    like = lambda a, b: float(a == b) if not a or not b else len(a & b) / len(a | b)
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    prints = {}
    for r in edited_fingerprints(df).collect():
        t = texts[r["doc_id"]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + (texts[after[r["doc_id"]]] or "")[:half]
        assert r["near_edited"] == pytest.approx(like(sets[r["doc_id"]], brute_signatures(edited)))
        assert r["near_next"] == pytest.approx(like(sets[r["doc_id"]], sets[after[r["doc_id"]]]))
        prints[r["doc_id"]] = r["fingerprint"]
    assert all((prints[a] == prints[b]) == (sets[a] == sets[b]) for a in texts for b in texts)
    for least in (0.8, 0.3):
        got = {frozenset((r["class_a"], r["class_b"])): r["likeness"] for r in alike(df, least).collect()}
        first = {}
        for k in sorted(texts):
            first.setdefault(frozenset(sets[k]), k)
        want = {frozenset((x, y)): like(a, b) for a, x in first.items() for b, y in first.items() if a and b and x < y and like(a, b) >= least}
        assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want) and want
    assert alike(df.limit(0)).count() == 0

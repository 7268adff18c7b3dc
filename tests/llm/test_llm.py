"""Corpus operators against brute force, with nulls, empty texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginflow.llm import warc
from marginflow.llm.jaccard import jaccard_join
from marginflow.llm.lines import dedup_lines
from marginflow.llm.mixing import mix
from marginflow.llm.packing import exact_cluster, pack_documents
from marginflow.llm.quality import apply_cutoffs, binomial_tail, cutoffs, measured
from marginflow.llm.sharding import shard
from marginflow.llm.spotsigs import edited_fingerprints
from marginflow.llm.toxicity import score_documents, tokens, train
from marginflow.llm.urls import judge_urls
from marginflow.llm.warc import read_archives, round_trip, write_archives

PASSAGE = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
DOCS = [
    (1, PASSAGE, "en", "a"), (2, PASSAGE + " tail", "en", "a"), (3, PASSAGE.upper(), "en", None), (4, None, None, "b"), (5, "", "en", "b"),
    (6, "one two", "fr", "b"), (7, "ONE  two", "fr", "c"), (8, LONG, "en", "a"), (9, "a shared line of some length\nown\n\n A Shared line of some LENGTH ", "en", "c"),
    (10, "a shared line of some length\r\nother", "en", "c"), (11, "x\na shared line of some length", "de", None), (11, "x\na shared line of some length", "de", None), (None, "no id at all here", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size string, kept string, _x int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in DOCS], SCHEMA)


def test_every_operator_takes_an_empty_table(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert mix(none).count() == jaccard_join(none).count() == edited_fingerprints(none).count() == dedup_lines(none).count() == 0
    assert shard(none).count() == pack_documents(none.withColumn("cluster", exact_cluster())).count() == 0
    rows = measured(none)
    assert apply_cutoffs(rows, cutoffs(rows, labels)).count() == 0
    assert score_documents(none, train(none, labels)).count() == 0
    assert round_trip(pages).count() == judge_urls(pages, spark.createDataFrame([], "url string")).count() == 0


def test_mix_meets_its_targets(docs):
    rows = mix(docs).collect()
    assert len(rows) == len(DOCS)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-6 * total
    for v in by.values():
        assert sum(r["taken"] for r in v) == round(v[0]["target"]) and v[0]["target"] <= 2 * sum(r["size"] for r in v)
        assert all(r["taken"] <= 2 * r["size"] and all(0 <= t["position"] <= 1 for t in r["takes"]) for r in v)


def test_jaccard_links(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join(docs).collect()}
    assert got[1] == (56, 1) and got[2] == (57, 1) and got[3] == (56, 1)
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[6] == got[7] == (1, 6) and got[8][1] == 8


def test_edited_fingerprints(docs):
    text = {r[0]: r[1] or "" for r in DOCS}
    order = sorted((k for k in text if k is not None), reverse=True) + [None]
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = edited_fingerprints(docs).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        t = text[r["doc_id"]]
        half = len(t) // 2
        edited = t[: len(t) - half] + text[after[r["doc_id"]]][:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[4] == prints[5] == "" and prints[1] == prints[3]


def test_warc_round_trip(spark):
    inner = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "http://a\r\nb", inner * 40), (2, None, None), (3, "c", ""), (4, "d", "é" * 900), (5, "d", "é" * 900), (6, "e", "small"), (7, "e", "small"), (8, "f", "WARC/1.0\r\n")]
    got = {r["page_id"]: r for r in round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        body = (html or "").encode()
        assert (got[page]["payload_bytes"], got[page]["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
    assert (got[4]["record_type"], got[4]["refers_to"]) == ("revisit", 5) and got[6]["record_type"] == got[5]["record_type"] == "response"


def test_warc_magic_in_urls_and_other_splits(spark, tmp_path):
    inner = "x WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    rows = [(i, ("http://a/WARC/1.0", "WARC/1.0\r\n", "http://b")[i % 3], inner * (i + 1)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in round_trip(pages).collect()}
    assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows}
    path = f"{tmp_path}/warc"
    assert write_archives(pages, path) == 30
    with pytest.raises(ValueError, match="30 records found"):
        read_archives(spark, path, 31)
    # The plan is made under one split size and run under another, as after a lost executor.
    real, sizes = warc._pieces, iter(("700", "5000"))

    def pieces(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return real(*args)

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(warc, "_pieces", pieces)
        try:
            again = read_archives(spark, path, 30).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["page_id"]: (r["payload_bytes"], r["stored_digest"]) for r in again} == got


def test_line_dedup_keeps_the_largest_document(docs):
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs).collect()}
    assert got[9] == ("own\n", 4, 2) and got[10] == ("other", 2, 1) and got[11] == ("x\na shared line of some length", 2, 0) and got[4] == ("", 1, 0)


def test_url_rules_and_list(spark):
    urls = ["http://www.Example.com/en/1", "http://m.example.com/en/2", "http://example.com/fr", "http://a.net/es/", "http://a.org/x?utm_a=1#f", "http://a.org/x/", "http://b.org/x", None, "nothing", "http://com"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(pages, spark.createDataFrame([("a.org/x?",)], "url string")).collect()}
    assert [got[i] for i in range(5)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), (None, "block")]
    assert got[5] == (None, "block") and all(got[i] == (None, "allow") for i in (6, 7, 8, 9))


def test_packing_keeps_whole_texts_apart_from_their_copies(docs):
    rows = pack_documents(docs.withColumn("cluster", exact_cluster()), capacity=64, with_text=True).collect()
    bins, texts = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
        texts[(r["doc_id"], r["cluster"])].append((r["piece"], r["text"]))
    for v in bins.values():
        assert sum(r["n_words"] for r in v) <= 64
        clusters = [r["cluster"] for r in v if r["cluster"] is not None]
        assert len(clusters) == len(set(clusters))
    assert "".join(t for _, t in sorted(texts[next(k for k in texts if k[0] == 8)])) == LONG


def test_shards_differ_by_one_row(docs):
    rows = shard(docs, shards=4).collect()
    counts = defaultdict(list)
    for r in rows:
        counts[r["shard"]].append(r["slot"])
    assert len(rows) == len(DOCS) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())


def test_quality_counts_and_guarantee(spark, docs):
    def repeats(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        places = defaultdict(list)
        for i in range(len(w) - 7):
            places[tuple(w[i : i + 8])].append(i)
        return len({j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)})

    text = {r[0]: r[1] or "" for r in DOCS}
    for r in measured(docs).collect():
        assert r["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]])) and r["n_repeat_words"] == repeats(text[r["doc_id"]])
    tail = spark.range(1).select(binomial_tail(F.lit(2).cast("long"), F.lit(50).cast("long"), 0.1).alias("p")).first()["p"]
    assert abs(tail - 0.11172875) < 1e-6


def test_toxicity_learns_marked_words(spark):
    plain = [(i, f"the {i} and of to word{i % 7} in that", 0) for i in range(60)]
    marked = [(100 + i, f"the {i} and of idiot word{i % 7} moron", 1) for i in range(60)]
    rows = spark.createDataFrame(plain + marked + [(900, None, None), (901, "", None)], "doc_id long, text string, toxic int")
    net = train(rows, rows.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r["score"] for r in score_documents(rows, net).collect()}
    held = [i for i in got if i % 5 == 0 and i < 900]
    assert sum((got[i] >= 0.5) == (i >= 100) for i in held) >= 0.9 * len(held) and all(0 <= s <= 1 for s in got.values())


def test_toxicity_reads_long_runs_to_their_end(spark):
    for n in (1, 40, 41, 43, 44, 77, 78, 1000):
        run = "".join(chr(97 + i * i % 23) for i in range(n))
        parts = tokens(f"a {run} b")[1:-1]
        assert all(len(p) <= 40 for p in parts) and parts[0] + b"".join(p[3:] for p in parts[1:]) == run.encode()
        assert {run[i : i + 4].encode() for i in range(n - 3)} <= {p[i : i + 4] for p in parts for i in range(len(p) - 3)}
    plain = [(i, f"the {i} and of to word{i % 7} in that", 0) for i in range(60)]
    marked = [(100 + i, f"the {i} and of idiot word{i % 7} moron", 1) for i in range(60)]
    net = train(rows := spark.createDataFrame(plain + marked, "doc_id long, text string, toxic int"), rows)
    joined = "_the_and_of_to_in_that" * 40
    pairs = [(1, joined), (2, joined + "_idiot_moron"), (3, "\u7684" * 300), (4, "\u7684" * 300 + "idiot\u00a0moron")]
    got = {r["doc_id"]: r["score"] for r in score_documents(spark.createDataFrame(pairs, "doc_id long, text string"), net).collect()}
    assert got[2] > got[1] and got[4] > got[3]

"""Quality rules with risk-controlled cutoffs.

Base rules are fixed. Every further rule compares one measure with a cutoff that labelled documents choose: in each
stratum and for each rule, cutoffs are tested from the mildest to the strictest with an exact binomial test of the
hypothesis that the rule rejects more than its share of the good documents, and the strictest one before the first
test that fails is used. Fixed-sequence testing needs no correction over cutoffs; a Bonferroni correction covers all
strata and rules. So with probability ``1 - delta`` every stratum falsely rejects at most ``alpha`` of its good
documents by these rules. A stratum with too few labels to prove a cutoff has none, and its documents stay.

Nulls: a null text has no words and fails the base rules; a null lang is a stratum of its own; labels with a null
quality or doc_id are not used. Repeated rows are judged alike. Without labels only the base rules reject. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import durable
from .common import BLANK, BLANKS, group_key, join_sized, let, text_of, without

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Good labels that may be broadcast, as one id each.
BROADCAST_LABELS = 1_000_000
ALPHA = 0.02
DELTA = 0.05
#: Each rule's cutoffs from the mildest to the strictest; a document fails above its cutoff.
RULES = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.25, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "capital_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "duplicate_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_word_share": (0.28, 0.25, 0.2, 0.15, 0.1, 0.05),
    "chars_per_word": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0),
}


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text.

    Window hashes are compared as a set first; only texts with a repeat sort them to find the places.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def places(h):
        def repeated(s):
            # Neighbours in hash order that agree; their places are sorted again and the words they cover counted once.
            same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            at = F.array_sort(F.transform(same, lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)

    def count(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(places(h))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, count))


def measured(docs: DataFrame) -> DataFrame:
    """Adds the base counts and the measures of the rules; everything from the document's own row."""
    docs = without(docs, *RULES, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum")
    text = text_of()
    # The words are needed several times inside array functions: bound once per row.
    words = F.filter(F.split(F.trim(text, F.lit(BLANKS)), f"{BLANK}+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")

    def counts(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    own = F.struct(
        let(words, counts).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("capitals"),
    )
    out = docs.withColumn("_own", own)
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return (
        out.select(
            *docs.columns, "_own.w.n_words", "_own.w.word_chars", "_own.n_symbols", F.col("_own.l.dup").alias("n_dup_lines"), "_own.w.n_repeat_words",
            share("_own.n_symbols", "_own.w.n_words").alias("symbols_per_word"), share("_own.capitals", "_own.w.word_chars").alias("capital_share"),
            share("_own.l.dup", "_own.l.n").alias("duplicate_line_share"), share("_own.w.n_repeat_words", "_own.w.n_words").alias("repeat_word_share"),
            share("_own.w.word_chars", "_own.w.n_words").alias("chars_per_word"),
        )
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of ``n`` trials at ``rate``: exact, summed in logarithms from term to term."""
    odds = F.lit(rate / (1 - rate))
    first = F.struct((n * F.log1p(F.lit(-rate))).alias("term"), (n * F.log1p(F.lit(-rate))).alias("sum"))

    def add(s, i):
        term = s["term"] + F.log((n - i + 1) / i * odds)
        high, low = F.greatest(s["sum"], term), F.least(s["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, first, add)["sum"])


def good_ids(labels: DataFrame) -> DataFrame:
    """The documents that labels call good, once each."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def cutoffs(features: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The certified cutoff of each stratum and rule, from the labelled good documents that pass the base rules.

    Only counts by stratum, rule and first cutoff exceeded are shuffled, after partial sums. A rule's share of the risk
    is ``alpha`` over the rules; its share of the error probability is ``delta`` over strata times rules.
    """
    held = features.where(~F.col("base_failed")).join(good_ids(labels), "doc_id", "left_semi")
    levels = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), sum((F.col(name) <= c).cast("int") for c in cuts).alias("safe")) for name, cuts in RULES.items())))
    counts = held.select(group_key(stratum).alias("stratum"), levels.alias("_l")).groupBy("stratum", "_l.rule", "_l.safe").agg(F.count(F.lit(1)).alias("n"))
    # safe: how many cutoffs, from the mildest on, the document passes; it is rejected by every later one.
    by_rule = durable(counts)
    strata = by_rule.select("stratum").distinct().count()
    level = delta / max(1, strata * len(RULES))
    ladder = F.create_map(*(x for name, cuts in RULES.items() for x in (F.lit(name), F.array(*map(F.lit, cuts)))))
    steps = by_rule.groupBy("stratum", "rule").agg(F.sum("n").alias("total"), F.collect_list(F.struct("safe", "n")).alias("at")).withColumn("_cuts", ladder[F.col("rule")])
    tried = steps.select("stratum", "rule", "total", "at", F.posexplode("_cuts").alias("step", "cutoff"))
    rejected = F.aggregate(F.filter("at", lambda x: x["safe"] <= F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    allowed = alpha / len(RULES)
    k, n = F.col("rejected"), F.col("total")
    tested = tried.withColumn("rejected", rejected).withColumn("passes", F.when(k < allowed * n, binomial_tail(k, n, allowed) <= level).otherwise(False))
    before = W.partitionBy("stratum", "rule").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    certified = tested.withColumn("_all", F.min(F.col("passes").cast("int")).over(before)).where(F.col("_all") == 1)
    return certified.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def apply_cutoffs(rows: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds kept to measured rows: the base rules and the certified cutoffs of the row's stratum."""
    wide = durable(chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"_{name}") for name in RULES)))
    out = join_sized(rows.withColumn("stratum", group_key(stratum)), wide, ["stratum"], "left")
    above = F.lit(False)
    for name in RULES:
        above = above | F.coalesce(F.col(name) > F.col(f"_{name}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~above).drop("stratum", *(f"_{name}" for name in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Adds the measures, base_failed and kept.

    Cutoffs need the measures of labelled good documents only, so no other text is measured for them; with more labels
    than may be broadcast all are, which shuffles no text either. Only narrow rows are made durable.
    """
    good = durable(good_ids(labels))
    few = good.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    labelled = docs.join(F.broadcast(good), "doc_id", "left_semi") if few else docs
    narrow = durable(measured(labelled).select("doc_id", stratum, *RULES, "base_failed"))
    return apply_cutoffs(measured(docs), cutoffs(narrow, labels, stratum, alpha, delta), stratum)

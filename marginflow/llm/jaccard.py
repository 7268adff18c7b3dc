"""N-gram Jaccard join: exact near-duplicate links between sets of word shingles.

1. Texts with equal shingle sets fall into one class; only class representatives go on.
2. A class sends the first shingles of its set in one global order: classes that link must share one of them (prefix
   filter). The order puts shingles that many documents hold last, so shared passages do not attract candidates.
3. Classes that share such a shingle form a tile per size band; bands are one threshold wide, so links stay inside a band
   or between neighbours.
4. A class is first held against the hubs (the smallest class of a shingle) that it shares most shingles with, then, once what these links connect is known,
   against every class of the tile that is still in another component. So a large group of near copies is not
   compared pair by pair, and no link between components is missed.
5. A pair is bounded from above by bit counts of hashed bitmaps, then intersected exactly on sorted arrays.

Shingles are 64-bit hashes of word n-grams after lower-casing A-Z; sets are told apart by 128 bits. Nulls: a null or
empty text has an empty set, links with nothing and is its own component. A null doc_id is kept but stands for no
component: its class is named by its smallest doc_id, and if it has none, the component is null. Repeated rows get the
same component. Extra columns are not needed and not returned. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import number_rows
from .common import row_hash, staged
from .components import components

NGRAM = 5
PERCENT = 80
#: Bits that mark common shingles; the set is only used to order shingles, so a wrong mark costs time, never a link.
COMMON_BITS = 1 << 22
#: A shingle is common from so many sets on; sets are counted in runs of RUN_SHINGLES, and counts under LEAST_LOCAL in a run are not sent.
COMMON_SETS = 48
LEAST_LOCAL = 3
RUN_SHINGLES = 2_000_000
#: Hubs a class is held against in the first round; all other candidates follow in the second.
FIRST_HUBS = 3
#: Bits that mark the documents whose sets are made again.
WANTED_BITS = 1 << 23
#: Words whose hashes a task remembers, and shingles that a task prepares at once.
VOCABULARY = 200_000
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


class _Words(dict):
    """Hashes of the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: _Words, ngram: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams; a shorter text is one shingle, an empty one none."""
    # bytes.lower() changes A-Z only and bytes.split() splits at the six ASCII blanks.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    size = min(ngram, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out + h[i : len(h) - size + 1 + i]) * MIX[0]
    return np.unique(scramble(out))


def prefix_length(n: int, percent: int) -> int:
    """A set of n shingles links with no other that misses all of its first so many shingles."""
    return n - -(-percent * n // 100) + 1


def bitmap_words(n: int) -> int:
    """64-bit words of the bitmap of a set: about two bits per shingle, a power of two."""
    return min(256, max(2, 1 << (max(1, n) // 32).bit_length()))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    width = bitmap_words(len(shingles))
    bits = np.zeros(width * 64, np.uint8)
    bits[(shingles >> np.uint64(20)) & np.uint64(width * 64 - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def overlap_bound(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> int:
    """No two sets with these bitmaps share more: a bit that one alone has stands for a shingle the other lacks."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))


def _common_counts(ngram: int):
    """Shingles that several sets of a run hold, with their counts; equal sets count once in a run."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, run, seen, held = _Words(), [], set(), 0

        def flush():
            values, n = np.unique(np.concatenate(run), return_counts=True)
            keep = n >= LEAST_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["shingle", "n"])

        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), words, ngram)
                key = xxhash.xxh64_intdigest(s.tobytes())
                if len(s) == 0 or key in seen:
                    continue
                seen.add(key)
                run.append(s)
                held += len(s)
                if held >= RUN_SHINGLES:
                    yield flush()
                    run, seen, held = [], set(), 0
        if run:
            yield flush()

    return counts


def common_marks(docs: DataFrame, ngram: int) -> np.ndarray:
    """A bit set of fixed size that marks the shingles many sets hold."""
    counts = docs.select("text").mapInArrow(_common_counts(ngram), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_SETS)
    return marked_bits(counts, "shingle", COMMON_BITS)


def _signatures(ngram: int, percent: int, marks):
    """Per document: set size, set digest, and its first shingles in the global order (rare ones first, then by hash)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, common = _Words(), np.unpackbits(np.frombuffer(marks.value, np.uint8), bitorder="little")
        for batch in batches:
            sizes, high, low, prefixes, bits = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), words, ngram)
                digest = np.frombuffer(hashlib.md5(s.tobytes()).digest(), np.int64)
                sizes.append(len(s))
                high.append(digest[0])
                low.append(digest[1])
                bits.append(bitmap(s).tobytes())
                late = common[(s & np.uint64(COMMON_BITS - 1)).astype(np.int64)].astype(bool)
                prefixes.append(np.concatenate([s[~late], s[late]])[: prefix_length(len(s), percent) if len(s) else 0].view(np.int64))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "high", "low", "prefix", "bits"])

    return sign


def marked_bits(ids: DataFrame, name: str, bits: int) -> np.ndarray:
    """A bit set of fixed size with the low bits of the ids: at most ``bits / 64`` rows come to the driver."""
    bit = F.col(name).bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    words = ids.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(one).alias("word")).toPandas()
    marks = np.zeros(bits // 64, np.uint64)
    marks[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64).view(np.uint64)
    return marks.view(np.uint8)


def _sets(ngram: int, wanted):
    """Shingle sets of the documents whose bit is set; others that share a bit are joined away later."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, marks = _Words(), np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            here = marks[batch.column(0).fill_null(0).to_numpy(zero_copy_only=False) & (len(marks) - 1)]
            batch = batch.filter(pa.array(here))
            raw = [shingle_set(text.as_py(), words, ngram).tobytes() for text in batch.column(1)]
            digests = [hashlib.md5(x).digest() for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["class", "digest", "shingles"])

    return sets


def _possible(percent: int):
    """Keeps the pairs whose bitmaps leave room for a link."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            keep = [
                (100 + percent) * overlap_bound(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), m, n) >= percent * (m + n)
                for p, q, m, n in zip(f["p"], f["q"], f["na"], f["nb"], strict=True)
            ]
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    return check


def _linked(percent: int):
    """Keeps the pairs that link: the exact intersection of sorted arrays."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            keep = []
            for x, y in zip(f["x"], f["y"], strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
            yield f.loc[np.array(keep, bool), ["a", "b"]]

    return check


def _fitting(small, large, percent: int):
    """Two sets can link only if their sizes are within the threshold."""
    return (100 * F.least(small, large) >= percent * F.greatest(small, large)) & (small > 0) & (large > 0)


def _band(n, percent: int):
    """Size bands one threshold wide: sets of one band or of neighbouring bands may link."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent))).cast("int")


def jaccard_join(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, class_id, component_id."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    marks = spark.sparkContext.broadcast(common_marks(docs, ngram).tobytes())
    signed = staged(docs.mapInArrow(_signatures(ngram, percent, marks), "doc_id long, n long, high long, low long, prefix array<long>, bits binary"))

    repeats = signed.groupBy("doc_id").count().where("doc_id is not null and count > 1").limit(1).count() > 0

    # A class is named by its smallest doc_id; its representative is that document.
    classes = staged(signed.where("n > 0 and doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("class"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits")))
    tokens = classes.select("class", "n", F.posexplode("prefix").alias("pos", "token"))

    # The star of a shingle: its smallest class. Shingles of one class only end here.
    stars = tokens.groupBy("token").agg(F.min("class").alias("hub"), F.max("class").alias("last")).where("hub < last").select("token", "hub")
    members = staged(tokens.join(stars, "token").select("token", "hub", "class", "n", "pos"))
    # A few links per class are enough to begin with: to the hubs it shares most shingles with. Near copies hang together by them.
    shared = members.where("class <> hub").groupBy("class", "hub").agg(F.count(F.lit(1)).alias("n"))
    nearest = W.partitionBy("class").orderBy(F.col("n").desc(), "hub")
    pairs = shared.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= FIRST_HUBS).select(F.col("hub").alias("a"), F.col("class").alias("b"))
    links = _verify(docs, classes, pairs, ngram, percent, repeats)

    # Shingles whose classes are not all connected yet: every pair of different components is a candidate.
    first = components(links)
    placed = members.join(first.select(F.col("node").alias("class"), "component"), "class", "left").withColumn("component", F.coalesce("component", "class")).drop("hub")
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    open_rows = staged(placed.join(mixed, "token").withColumn("band", _band(F.col("n"), percent)))
    left = open_rows.select("token", "band", F.col("class").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"))
    right = open_rows.select("token", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("band").alias("own"), F.col("class").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"))
    # Two sets of these sizes that link share a shingle among the first n - need + 1 of each.
    need = F.ceil(percent * (F.col("na") + F.col("nb")) / float(100 + percent))
    early = (F.col("pa") + need <= F.col("na")) & (F.col("pb") + need <= F.col("nb"))
    tile = left.join(right, ["token", "band"]).where((F.col("ca") != F.col("cb")) & early & _fitting(F.col("na"), F.col("nb"), percent) & ((F.col("own") > F.col("band")) | (F.col("a") < F.col("b"))))
    rest = tile.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = links.unionByName(_verify(docs, classes, rest, ngram, percent, repeats))

    found = components(links)
    named = classes.select("high", "low", "class").join(found.select(F.col("node").alias("class"), "component"), "class", "left")
    named = named.select("high", "low", F.col("class").alias("class_id"), F.coalesce("component", "class").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "high", "low")
    full = out.where("n_shingles > 0").join(named, ["high", "low"], "left")
    empty = out.where("n_shingles = 0").withColumn("class_id", F.col("doc_id")).withColumn("component_id", F.col("doc_id"))
    return full.unionByName(empty).drop("high", "low")


def _numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Adds ``_row``, one number per different (doc_id, text), and tells whether rows share one.

    A doc_id that one row has is its own number. Rows without a doc_id, or with one that other rows have too, are
    numbered below all of them by doc_id and digest of the text, the same in every run.
    """
    several = staged(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1").select("doc_id"))
    if not several.limit(1).count():
        return docs.withColumn("_row", F.col("doc_id").cast("long")), False
    least = min(0, docs.agg(F.min(F.col("doc_id").cast("long"))).first()[0] or 0)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    odd = docs.alias("a").join(several.alias("b"), F.expr("a.doc_id <=> b.doc_id"), "left_semi").select("doc_id", digest.alias("_digest")).distinct()
    numbers = staged(number_rows(odd, [F.col("doc_id"), F.col("_digest")], "_at").select("doc_id", "_digest", (least - F.col("_at")).alias("_number")))
    met = docs.withColumn("_digest", digest).alias("a").join(numbers.alias("b"), F.expr("a.doc_id <=> b.doc_id and a._digest = b._digest"), "left")
    return met.select(*(f"a.`{c}`" for c in docs.columns), F.coalesce("_number", F.col("a.doc_id").cast("long")).alias("_row")), True


def keep_one(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The rows without near copies: of each group of linked texts one row stays.

    The longest text stays, of equally long ones that of the largest doc_id (null is none), then by hash of the row. Rows
    are judged by their own text: a doc_id that stands for several texts links none of them to the copies of another.
    Texts without words link with nothing and stay, all but repeats of one (doc_id, text).
    """
    rows, shared = _numbered(docs)
    if shared:
        rows = rows.withColumn("_hash", row_hash(docs))
    else:
        rows = rows.withColumn("_hash", F.lit(0).cast("long"))
    groups = jaccard_join(rows.select(F.col("_row").alias("doc_id"), "text"), ngram, percent).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    facts = rows.select("_row", "_hash", F.length(F.coalesce("text", F.lit(""))).alias("_size"), F.col("doc_id").cast("long").alias("_id"))
    placed = staged(facts.join(groups, "_row"))
    best = placed.groupBy("component_id").agg(F.max(F.struct("_size", "_id", "_hash", "_row")).alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Narrow rows, and only those of groups: most documents are in none.
    lost = placed.join(best, "component_id").where("_row <> _best._row or _hash <> _best._hash").select("_row", "_hash").distinct()
    kept = rows.join(lost, ["_row", "_hash"], "left_anti")
    return (kept.dropDuplicates(["_row"]) if shared else kept).drop("_row", "_hash")


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, ngram: int, percent: int, repeats: bool) -> DataFrame:
    """The pairs of classes that link. Shingle sets are made again for the classes in question only.

    A doc_id that stands for several texts links if one of them does.
    """
    spark = docs.sparkSession
    known = lambda k, **names: classes.select(F.col("class").alias(k), *(F.col(c).alias(m) for c, m in names.items()))
    bounded = pairs.join(known("a", bits="p", n="na"), "a").join(known("b", bits="q", n="nb"), "b").where(_fitting(F.col("na"), F.col("nb"), percent)).mapInPandas(_possible(percent), "a long, b long")
    pairs = staged(bounded.distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class"))
    bits = spark.sparkContext.broadcast(marked_bits(wanted, "class", WANTED_BITS).tobytes())
    sets = docs.where("doc_id is not null").mapInArrow(_sets(ngram, bits), "class long, digest binary, shingles binary")
    sets = staged(sets.dropDuplicates(["class", "digest"]) if repeats else sets)
    side = lambda k, x: sets.select(F.col("class").alias(k), F.col("shingles").alias(x))
    return staged(pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(_linked(percent), "a long, b long").distinct())

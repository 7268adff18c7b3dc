"""Ranked lexical search over bags: documents that look alike to the items are scored once.

Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A document is
restricted to the items' vocabulary: its bag holds the terms that some item asks for, with their counts, and with its
length factor m it is all that a score can see. Documents of equal (bag, m) are one class: they meet by hash, and the
bags themselves are grouped, so that a hash shared by chance makes no class. Each class is scored once against all
items; of a class among an item's best, the members are listed by ascending doc_id.

An item's ``top`` best documents lie in its ``top`` best classes, ordered by score and then by smallest doc_id: a
class beyond them has ``top`` documents before its first. So every task keeps that many classes per item, and as many
members are kept per class, before any row is shuffled. Items are served in blocks of at most about ``BLOCK_TERMS``
terms; a block's vocabulary is what tasks receive. Nothing else of the documents or items is held in one place.

Nulls: a null text has no terms; a null item text asks for nothing and gets no rows. A null doc_id comes after all
others; rows that repeat a doc_id are documents of their own. Rows that repeat an item_id (null is one too) are one
item with the terms of all. Documents with score 0 are not listed. Without documents or items the result is empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged

TOP = 10
#: Terms, with repeats between items, that a block of items asks for.
BLOCK_TERMS = 200_000
#: Class-item cells and term-item pairs that a task holds at once.
CELLS = 2_000_000
#: Bytes to bytes: A-Z in lower case, all that stands between terms a blank.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_LAST = np.iinfo(np.int64).max


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, its distinct terms) of (item_id, text)."""
    for batch in batches:
        found = [sorted(set(terms(t))) for t in _binary(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])


class Block:
    """The items of a block: their terms, numbered, and which items ask for each."""

    def __init__(self, ids: pa.Array, asked: list[list[bytes]]):
        self.ids = ids
        self.number = {t: k for k, t in enumerate(sorted(set().union(*asked)))}
        pairs = sorted((self.number[t], i) for i, ts in enumerate(asked) for t in ts)
        self.items = np.array([i for _, i in pairs], np.int64)
        self.degree = np.bincount(np.array([t for t, _ in pairs], np.int64), minlength=len(self.number))
        self.start = np.cumsum(self.degree) - self.degree


def bagger(number: dict[bytes, int]) -> Callable:
    """(doc_id, text) to (doc_id, n terms, bag): the bag is pairs (term number, count) in 32 bits each, by number."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            lengths, bags = [], []
            for text in _binary(batch.column(1)):
                words = terms(text)
                seen = Counter(map(get, words))
                seen.pop(None, None)
                lengths.append(len(words))
                bags.append(np.array(sorted(seen.items()), "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])

    return bag


def _postings(bags: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class number, term and count of all pairs in the bags."""
    flat = np.frombuffer(b"".join(bags), "<u4").astype(np.int64).reshape(-1, 2)
    return np.repeat(np.arange(len(bags)), [len(b) // 8 for b in bags]), flat[:, 0], flat[:, 1]


def holder_counts(n_terms: int) -> Callable:
    """(bag, size of its class) to (term, documents that hold it): one row per term and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            owner, term, _ = _postings(batch.column(0).to_pylist())
            np.add.at(total, term, batch.column(1).to_numpy()[owner])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["term", "df"])

    return count


def best_classes(block: Block, weight: np.ndarray, top: int) -> Callable:
    """Classes (h, m, bag, first doc_id) to the best ``top`` of every item that this task sees, with their scores.

    All numbers are integers; sums go through doubles only while they stay exact.
    """
    n_items, exact = len(block.ids), int(weight.max(initial=0)) * 1_000_000 * int(np.bincount(block.items).max(initial=0)) < 1 << 53

    def scores(bags: list[bytes], m: np.ndarray) -> np.ndarray:
        owner, term, tf = _postings(bags)
        value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[owner]))
        total = np.zeros(len(bags) * n_items, np.int64)
        many = block.degree[term]
        ends = np.cumsum(many)
        begin = 0
        while begin < len(term):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CELLS, "right")))
            part = slice(begin, end)
            at = np.repeat(np.arange(begin, end), many[part])
            inside = np.arange(len(at)) - np.repeat(ends[part] - many[part] - (ends[begin] - many[begin]), many[part])
            cell = owner[at] * n_items + block.items[block.start[term[at]] + inside]
            if exact:
                low = owner[begin] * n_items
                added = np.bincount(cell - low, value[at]).astype(np.int64)
                total[low : low + len(added)] += added
            else:
                np.add.at(total, cell, value[at])
            begin = end
        return total.reshape(len(bags), n_items)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.ones(n_items, np.int64)  # a class below this is not among an item's best
        item, score, first = (np.zeros(0, np.int64) for _ in range(3))
        h, m, bag = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
        step = max(1, CELLS // max(1, n_items))
        for whole in batches:
            for k in range(0, whole.num_rows, step):
                batch = whole.slice(k, step)
                bags = np.array(batch.column(2).to_pylist() + [None], object)[:-1]
                found = scores(list(bags), ms := batch.column(1).to_numpy())
                row, col = np.nonzero(found >= least)
                firsts = batch.column(3).fill_null(_LAST).to_numpy()
                item, score, first = np.concatenate([item, col]), np.concatenate([score, found[row, col]]), np.concatenate([first, firsts[row]])
                h, m, bag = np.concatenate([h, batch.column(0).to_numpy()[row]]), np.concatenate([m, ms[row]]), np.concatenate([bag, bags[row]])
                order = np.lexsort((h, first, -score, item))
                item, score, first, h, m, bag = (x[order] for x in (item, score, first, h, m, bag))
                begins = np.searchsorted(item, np.arange(n_items))
                keep = np.arange(len(item)) - begins[item] < top
                item, score, first, h, m, bag = (x[keep] for x in (item, score, first, h, m, bag))
                full = np.bincount(item, minlength=n_items) == top
                least[full] = score[np.searchsorted(item, np.flatnonzero(full), "right") - 1]
        yield pa.RecordBatch.from_arrays(
            [block.ids.take(pa.array(item)), pa.array(item.astype(np.int32)), pa.array(score), pa.array(h), pa.array(m), pa.array(bag, pa.binary()), pa.array(first)],
            ["item_id", "item", "score", "h", "m", "bag", "first"],
        )

    return best


def _search_block(docs: DataFrame, block: Block, id_type: str, top: int) -> DataFrame:
    bags = staged(docs.select("doc_id", "text").mapInArrow(bagger(block.number), "doc_id long, n long, bag binary"))
    # N and L of the collection: two numbers.
    n_docs, n_terms = bags.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    members = bags.where(F.octet_length("bag") > 0).select("doc_id", "bag", F.expr(f"10 + (90L * n * {n_docs}L) div {max(n_terms, 1)}L").alias("m"), F.xxhash64("bag").alias("h"))
    # Hashed to meet, equal in every byte to be one class.
    classes = staged(members.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")))
    held = classes.select("bag", "size").mapInArrow(holder_counts(len(block.number)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    # A term that no document holds is in no bag. One row per term of the block.
    rows = held.select("term", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")).collect()
    weight = np.zeros(len(block.number), np.int64)
    for r in rows:
        weight[r["term"]] = r["w"]
    order = W.partitionBy("item").orderBy(F.col("score").desc(), "first", "h", "m")
    found = classes.select("h", "m", "bag", "first").mapInArrow(best_classes(block, weight, top), f"item_id {id_type}, item int, score long, h long, m long, bag binary, first long")
    chosen = staged(found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top).drop("_k", "first"))
    # At most ``top`` keys of 16 bytes per item of the block: they narrow the members before bags are compared.
    listed = members.join(F.broadcast(chosen.select("h", "m").distinct()), ["h", "m"], "left_semi")
    eldest = listed.withColumn("_k", F.row_number().over(W.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last()))).where(F.col("_k") <= top)
    ranked = chosen.join(eldest, ["h", "m", "bag"]).withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "h", "m", "_k")))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    id_type = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").mapInArrow(item_terms, f"item_id {id_type}, terms array<binary>")
    asked = staged(asked.select("item_id", F.explode("terms").alias("term")).distinct())
    total = asked.count()
    n_blocks = max(1, -(-total // block_terms))
    placed = asked.withColumn("_block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    out = None
    for k in range(n_blocks):
        # The terms of one block of items.
        rows = placed.where(F.col("_block") == k).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item_id").toArrow()
        if rows.num_rows:
            block = Block(rows["item_id"].combine_chunks(), [[bytes(t) for t in ts] for ts in rows["terms"].to_pylist()])
            part = _search_block(docs, block, id_type, top)
            out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long") if out is None else out

"""Best-fit packing of documents into bins of fixed length, under conflicts.

Documents are dealt by hash to packing groups of bounded size; each group is packed by itself, longest first. Open bins
stand in order of what is left in them. A piece goes to the tightest bin that can hold it and has no conflict: the
search starts at the first bin with enough room and moves on to its successors until one is compatible; only if none is,
a bin is opened. A bin carries two bitmaps, of its sources and of its duplicate clusters: two documents of one cluster
never share a bin, nor do two sources that are declared to conflict. Cluster bits are hashed; a set bit is settled by the
bin's own short list, so a collision never keeps compatible documents apart.

Documents longer than a bin are cut into pieces: all but the last fill bins of their own. Whole texts are kept. Nulls: a
null or empty text has one piece of no words and is packed like any other; a null source is a source of its own; a null
cluster conflicts with nothing. Repeated rows are separate documents of one cluster. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_key, word_count

CAPACITY = 2048
#: Words of a packing group: large enough for tight bins, small enough for a task.
GROUP_WORDS = 1_000_000
#: Pairs of sources that may not share a bin in the production packing.
CONFLICTS = (("src1", "src2"), ("src3", "src4"))
CLUSTER_BITS = 64

ASSIGNED = "bin_id string, bin_start long, doc_id long, piece int, n_pieces int, n_words long, source string, cluster long"
_RUN = re.compile(r"[^\x20\x09-\x0D]+")


class Bins:
    """Open bins in order of the room left in them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.members: list[set[int]] = []

    def place(self, words: int, bit: int, against: int, cluster: int | None) -> tuple[int, int]:
        """The bin and the place in it of a piece whose source has ``bit`` and conflicts with the bits of ``against``."""
        mark = 0 if cluster is None else 1 << cluster % CLUSTER_BITS
        at = bisect_left(self.order, (words, -1))
        while at < len(self.order):
            room, number = self.order[at]
            if not self.sources[number] & against and not (self.clusters[number] & mark and cluster in self.members[number]):
                del self.order[at]
                break
            at += 1
        else:
            room, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
            self.members.append(set())
        self.sources[number] |= bit
        self.clusters[number] |= mark
        if cluster is not None:
            self.members[number].add(cluster)
        insort(self.order, (room - words, number))
        return number, self.capacity - room


def pack(pieces: Iterable[tuple[int, str, int | None]], capacity: int, conflicts: Iterable[tuple[str, str]]) -> list[tuple[int, int]]:
    """Bin and place of each piece (words, source, cluster), which come longest first."""
    bits: dict[str, int] = {}
    against: dict[str, int] = {}
    for pair in conflicts:
        for name in pair:
            bits.setdefault(name, 1 << len(bits))
    for a, b in conflicts:
        against[a] = against.get(a, 0) | bits[b]
        against[b] = against.get(b, 0) | bits[a]
    bins, out = Bins(capacity), []
    for words, source, cluster in pieces:
        if source not in bits:
            bits[source] = 1 << len(bits)
        out.append(bins.place(words, bits[source], against.get(source, 0), cluster))
    return out


def cut(text: str, capacity: int) -> list[str]:
    """A text in pieces of ``capacity`` words that join to the text again."""
    runs = [m.end() for m in _RUN.finditer(text)]
    ends = runs[capacity - 1 :: capacity]
    if ends and len(runs) % capacity == 0 or not ends:
        ends = ends[:-1]
    at = [0, *ends, len(text)]
    return [text[i:j] for i, j in zip(at, at[1:], strict=False)]


def _group(capacity: int, conflicts: tuple, with_text: bool):
    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for i, (doc_id, words, source, cluster) in enumerate(zip(frame["doc_id"], frame["n_words"], frame["source"], frame["cluster"], strict=True)):
            full = max(1, -(-words // capacity))
            for k in range(full):
                rows.append((min(capacity, words - k * capacity), k, full, i, doc_id, source, None if pd.isna(cluster) else int(cluster)))
        rows.sort(key=lambda r: (-r[0], str(r[4]), r[1], str(r[5]), r[3]))
        places = pack(((r[0], "null" if r[5] is None else "=" + r[5], r[6]) for r in rows), capacity, [("=" + a, "=" + b) for a, b in conflicts])
        group = int(frame["_group"].iloc[0]) if len(frame) else 0
        out = pd.DataFrame(
            {
                "bin_id": [f"{group}-{number}" for number, _ in places],
                "bin_start": [start for _, start in places],
                "doc_id": pd.array([r[4] for r in rows], dtype="Int64"),
                "piece": [r[1] for r in rows],
                "n_pieces": [r[2] for r in rows],
                "n_words": [r[0] for r in rows],
                "source": [r[5] for r in rows],
                "cluster": pd.array([r[6] for r in rows], dtype="Int64"),
            }
        )
        if with_text:
            texts = [[x] if r <= capacity else cut(x, capacity) for x, r in zip(frame["text"].fillna(""), frame["n_words"], strict=True)]
            out["text"] = [texts[r[3]][r[1]] for r in rows]
        return out

    return assign


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, conflicts: Iterable[tuple[str, str]] = CONFLICTS, with_text: bool = False, group_words: int = GROUP_WORDS) -> DataFrame:
    """Bins of the rows (doc_id, source, cluster, text): one row per piece, with its text on request.

    One pass sums the words to choose the number of groups; one shuffle by hash deals the rows. Groups are alike in
    size whatever the sources and clusters, since rows are dealt by document.
    """
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"), F.coalesce(word_count(F.col("text")), F.lit(0).cast("long")).alias("n_words"), *(["text"] if with_text else []))
    words, rows = own.agg(F.sum("n_words"), F.count(F.lit(1))).first()
    # A document counts as 16 words at least, so groups of very short ones are bounded as well.
    groups = max(1, -(-max(words or 0, 16 * rows) // group_words))
    # The bin number of a repeated document depends on its copies only through their order, which is the row order of equal rows.
    key = F.pmod(F.xxhash64("doc_id", group_key("source"), "cluster", "n_words"), F.lit(groups))
    return own.withColumn("_group", key).groupBy("_group").applyInPandas(_group(capacity, tuple(conflicts), with_text), ASSIGNED + (", text string" if with_text else ""))


def exact_cluster() -> Column:
    """The cluster of exact copies: equal texts have equal clusters; empty texts have none."""
    return F.when(F.length("text") > 0, F.xxhash64("text"))

"""Periodic runs of words, found in the grammar that Re-Pair makes of each text.

A run is a stretch of words that repeats with its smallest period q, is at least ``max(min_words, 3 * q)`` long and
cannot grow at either end. Re-Pair replaces the most frequent pair of neighbouring symbols by a new one until no pair
occurs twice (ties: the shorter expansion first, which keeps grammars flat); what is left is halved into a balanced tree.
A run lies whole in some node of the derivation and crosses the boundary between that node's two halves, so each
symbol's boundary is searched once: the boundary's pair of words names the candidate periods, hashes of prefixes give
how far each reaches, and words are compared one by one before a run is believed. Runs of a symbol are moved to all
places it derives; pieces of a run that a symbol's ends cut off are merged into the whole.

Before that, texts are narrowed without loss: every window of eight words inside a run occurs again a period away in
it, so only stretches covered by such windows go to the grammar. Texts are taken whole; each is the work of one task,
and tasks hold about ``CHARS_AT_ONCE`` of text at a time, or one text.

Nulls: a null text has no words, no runs and the empty text as result. Repeated rows get equal results. An empty table
gives an empty result. Columns ``n_words`` and ``runs`` of the input give way; others stay.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import without

MIN_WORDS = 24
#: A run of 24 words or more repeats all its windows of so many words.
WINDOW = 8
CHARS_AT_ONCE = 500_000
CANDIDATES_AT_ONCE = 200_000
RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
_ODD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each number."""
    x = (x.astype(np.uint64) + np.uint64(1)) * _ODD
    x ^= x >> np.uint64(32)
    x *= _BASE
    return x ^ x >> np.uint64(29)


def stretches(ids: np.ndarray, begins: np.ndarray, min_words: int) -> np.ndarray:
    """(from, to) of the stretches that can hold a run, in the words of several texts laid end to end."""
    n = len(ids)
    size = max(1, min(WINDOW, min_words // 3))
    if n < size:
        return np.zeros((0, 2), np.int64)
    text = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
    with np.errstate(over="ignore"):
        key, word = np.zeros(n - size + 1, np.uint64), _mixed(ids)
        for k in range(size):
            key = key * _BASE + word[k : n - size + 1 + k]
        key ^= _mixed(text[: len(key)] + (1 << 40))
    at = np.flatnonzero(text[: len(key)] == text[size - 1 :])
    order = at[np.argsort(key[at], kind="stable")]
    gap = np.where(key[order[1:]] == key[order[:-1]], np.diff(order), n)
    nearest = np.full(n, n)
    nearest[order] = np.minimum(np.append(gap, n), np.append(n, gap))
    alive = nearest < n
    border = np.diff(text, prepend=-1) != 0
    for _ in range(3):  # a stretch holds three periods, so each window's nearest copy is within a third of it
        marks = np.zeros(n + 1, np.int64)
        marks[:n] += alive
        marks[size:] -= alive[: n + 1 - size]
        inside = np.cumsum(marks[:n]) > 0
        first = np.flatnonzero(inside & (border | ~np.append(False, inside[:-1])))
        last = np.flatnonzero(inside & np.append(border[1:] | ~inside[1:], True)) + 1
        long = last - first >= min_words
        first, last = first[long], last[long]
        length = np.zeros(n + 1, np.int64)
        length[first] += last - first
        length[last] -= last - first
        alive &= 3 * nearest <= np.cumsum(length[:n])
    return np.stack([first, last], axis=1)


def re_pair(parts: list[list[int]]) -> tuple[list[tuple[int, int]], list[list[tuple[int, int]]]]:
    """Rules (left, right) of new symbols and what is left of each part as (symbol, place); symbol -1 - r is rule r."""
    symbol: list[int] = []
    begins = []
    for part in parts:
        begins.append(len(symbol))
        symbol += part
        symbol.append(None)  # no pair goes over the end of a part
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k in range(n - 1):
        if symbol[k] is not None and symbol[k + 1] is not None:
            places[symbol[k], symbol[k + 1]].append(k)
    size: list[int] = []
    width = lambda x: 1 if x >= 0 else size[-1 - x]
    heap = [(-len(at), 2, at[0], pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, wide, _, pair = heapq.heappop(heap)
        left, right = pair
        alive, last = [], -1
        for k in places[pair]:
            # Places of a pair of equal symbols may overlap: only every second one counts.
            if symbol[k] == left and k != last and after[k] < n and symbol[after[k]] == right:
                alive.append(k)
                last = after[k] if left == right else -1
        if len(alive) < 2:
            del places[pair]
            continue
        places[pair] = alive
        if len(alive) < -count:
            heapq.heappush(heap, (-len(alive), wide, alive[0], pair))
            continue
        del places[pair]
        new = -1 - len(rules)
        rules.append(pair)
        size.append(width(left) + width(right))
        fresh: dict[tuple[int, int], list[int]] = defaultdict(list)
        for k in alive:
            gone = after[k]
            symbol[k], symbol[gone] = new, None
            after[k] = then = after[gone]
            if then < n:
                before[then] = k
                if symbol[then] is not None:
                    fresh[new, symbol[then]].append(k)
            prior = before[k]
            if prior >= 0 and symbol[prior] is not None:
                fresh[symbol[prior], new].append(prior)
        for found, at in fresh.items():
            # A neighbour replaced later in this round leaves a dead place; it is dropped when the pair's turn comes.
            if len(at) > 1:
                places[found] = at
                heapq.heappush(heap, (-len(at), width(found[0]) + width(found[1]), at[0], found))
    left_over = []
    for begin in begins:
        row, k = [], begin
        while symbol[k] is not None:
            row.append((symbol[k], k))
            k = after[k]
        left_over.append(row)
    return rules, left_over


def grammar_nodes(parts: list[list[int]]) -> tuple[list[tuple[int, int, int, int]], list[list[int]]]:
    """Nodes (from, middle, to, rule or -1) over the parts laid end to end with one word between, and where each rule occurs.

    A rule is one node, at the first of its places; what it leaves of a part is halved into nodes that occur once.
    """
    rules, left_over = re_pair(parts)
    size = []
    for a, b in rules:
        size.append((1 if a >= 0 else size[-1 - a]) + (1 if b >= 0 else size[-1 - b]))
    places: list[list[int]] = [[] for _ in rules]
    nodes = []
    for part, row in zip(parts, left_over):
        for s, k in row:
            if s < 0:
                places[-1 - s].append(k)
        cuts = [k for _, k in row]
        end = cuts[0] + len(part)
        while len(cuts) > 1:
            nodes += [(cuts[k], cuts[k + 1], cuts[k + 2] if k + 2 < len(cuts) else end, -1) for k in range(0, len(cuts) - 1, 2)]
            cuts = cuts[::2]
    for r in range(len(rules) - 1, -1, -1):
        a, b = rules[r]
        half = 1 if a >= 0 else size[-1 - a]
        if a < 0:
            places[-1 - a] += places[r]
        if b < 0:
            places[-1 - b] += [k + half for k in places[r]]
        k = places[r][0]
        nodes.append((k, k + half, k + size[r], r))
    return nodes, places


def _reach(prefix: np.ndarray, power: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from x on equal those from y > x on, at most ``most``; all by halving, on hashes of prefixes."""
    low, high = np.zeros_like(x), most.copy()
    shift = power[y - x]
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = (prefix[x + mid] - prefix[x]) * shift == prefix[y + mid] - prefix[y]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def crossing(words: np.ndarray, nodes: np.ndarray, min_words: int) -> np.ndarray:
    """(node, from, to, period) of the periodic stretches that cross each node's middle, within the node."""
    if not len(nodes):
        return np.zeros((0, 4), np.int64)
    n = len(words)
    with np.errstate(over="ignore"):
        value = _mixed(words)
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _BASE)))
        prefix = np.append(np.uint64(0), np.cumsum(value * power[:n]))
        backward = np.append(np.uint64(0), np.cumsum(value[::-1] * power[:n]))
        # The pair of words at every place, and the places of each pair in order.
        pair = value[:-1] * _ODD + value[1:]
        order = np.argsort(pair, kind="stable")
        _, number = np.unique(pair, return_inverse=True)
        sorted_keys = number[order] * (n + 1) + order
        lo, mid, hi = nodes[:, 0], nodes[:, 1], nodes[:, 2]
        base = number[mid - 1] * (n + 1)
        start, stop = np.searchsorted(sorted_keys, base + lo), np.searchsorted(sorted_keys, base + hi - 1)
        out = []
        total = np.cumsum(stop - start)
        begin = 0
        while begin < len(nodes):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + CANDIDATES_AT_ONCE, "right")))
            many = (stop - start)[begin:end]
            node = np.repeat(np.arange(begin, end), many)
            place = order[np.repeat(start[begin:end], many) + np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)]
            q = np.abs(place - (mid[node] - 1))
            fits = (q > 0) & (3 * q <= hi[node] - lo[node])
            node, q, place = node[fits], q[fits], np.minimum(place[fits], mid[node[fits]] - 1)
            # From the pair on to the right, and from the pair's second word to the left.
            right = _reach(prefix, power, place, place + q, hi[node] - place - q)
            left = _reach(backward, power, n - 1 - place - q, n - 1 - place, place - lo[node] + 1)
            first, last = place + 1 - left, place + q + right
            long = last - first >= np.maximum(min_words, 3 * q)
            out.append(np.stack([node[long], first[long], last[long], q[long]], axis=1))
            begin = end
    every = np.unique(np.concatenate(out), axis=0)
    found = _smallest(every)
    # Hashes may agree by chance, and do in texts made for it; nodes where one did are searched word by word.
    false = {int(node) for node, a, b, q in found if not (words[a : b - q] == words[a + q : b]).all()}
    if not false:
        return found
    doubtful = np.isin(every[:, 0], list(false))
    again = [(node, *run) for node, q in np.unique(every[doubtful][:, [0, 3]], axis=0) for run in _direct(words, *nodes[node, :3], q, min_words)]
    sound = found[~np.isin(found[:, 0], list(false))]
    return _smallest(np.unique(np.concatenate([sound, np.array(again, np.int64).reshape(-1, 4)]), axis=0))


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of the periods of one stretch the smallest counts: the first of sorted rows (node, from, to, period)."""
    return rows[np.append(True, (np.diff(rows[:, :3], axis=0) != 0).any(axis=1))[: len(rows)]]


def _direct(words: np.ndarray, lo: int, mid: int, hi: int, q: int, min_words: int) -> set[tuple[int, int, int]]:
    """The stretches of period q within a node that hold the words on both sides of its middle."""
    equal = np.concatenate([[False], words[lo : hi - q] == words[lo + q : hi], [False]])
    breaks = np.flatnonzero(~equal)
    out = set()
    for at in (mid - lo, mid - q - lo):
        if 0 < at < len(equal) and equal[at]:
            k = int(np.searchsorted(breaks, at))
            start, end = lo + int(breaks[k - 1]), lo + int(breaks[k]) - 1 + q
            if end - start >= max(min_words, 3 * q):
                out.add((start, end, int(q)))
    return out


def _maximal(pieces: np.ndarray) -> np.ndarray:
    """(from, to, period) of whole runs: pieces within a longer one of their period go, and the smallest period of a stretch stays."""
    if not len(pieces):
        return pieces
    pieces = pieces[np.lexsort((-pieces[:, 1], pieces[:, 0], pieces[:, 2]))]
    group = np.cumsum(np.diff(pieces[:, 2], prepend=-1) != 0) * (int(pieces[:, 1].max()) + 1)
    reach = np.maximum.accumulate(pieces[:, 1] + group)
    whole = pieces[np.append(True, (pieces[:, 1] + group)[1:] > reach[:-1])]
    whole = whole[np.lexsort((whole[:, 2], whole[:, 1], whole[:, 0]))]
    return whole[np.append(True, (np.diff(whole[:, :2], axis=0) != 0).any(axis=1))]


def find_runs(texts: list[list[bytes]], min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start, length, period) of several texts, by text, start and period; and how many each has."""
    vocabulary: defaultdict[bytes, int] = defaultdict(int)
    vocabulary.default_factory = vocabulary.__len__
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.fromiter((vocabulary[w] for words in texts for w in words), np.int64, int(lengths.sum()))
    begins = np.cumsum(lengths) - lengths
    parts = stretches(ids, begins, min_words)
    text_of = np.searchsorted(begins, parts[:, 0], "right") - 1
    # Parts of each text lie end to end in ``words``, with a word of its own behind each.
    words, nodes, origin, places = [], [], [], []
    at = 0
    for text in np.unique(text_of):
        own = parts[text_of == text]
        rows, where = grammar_nodes([ids[a:b].tolist() for a, b in own])
        nodes += [(at + lo, at + mid, at + hi, rule, len(places)) for lo, mid, hi, rule in rows]
        places.append((at, where))
        for a, b in own:
            words += [ids[a:b], [-2 - len(origin)]]
            origin.append((at, a - begins[text], text))
            at += b - a + 1
    if not nodes:
        return np.zeros((0, 3), np.int64), np.zeros(len(texts), np.int64)
    table = np.array(nodes, np.int64)
    found = crossing(np.concatenate(words).astype(np.int64), table, min_words)
    rule = table[found[:, 0], 3]
    pieces = [found[rule < 0, 1:]]
    for node, a, b, q in found[rule >= 0]:
        base, where = places[table[node, 4]]
        shift = np.array(where[table[node, 3]]) + base - table[node, 0]
        pieces.append(np.stack([a + shift, b + shift, np.full(len(shift), q)], axis=1))
    whole = _maximal(np.unique(np.concatenate(pieces), axis=0))
    place = np.array(origin, np.int64)
    part = np.searchsorted(place[:, 0], whole[:, 0], "right") - 1
    runs = np.stack([whole[:, 0] - place[part, 0] + place[part, 1], whole[:, 1] - whole[:, 0], whole[:, 2]], axis=1)
    owner = place[part, 2]
    order = np.lexsort((runs[:, 2], runs[:, 0], owner))
    return runs[order], np.bincount(owner, minlength=len(texts))


#: What a row's words are, given its doc_id and the words of its text.
Change = Callable[[int | None, list[bytes]], list[bytes]]


def _chunks(ids: pa.Array | None, column: pa.Array, change: Change | None) -> Iterator[tuple[int, list[list[bytes]]]]:
    """First row and words of consecutive texts, about ``CHARS_AT_ONCE`` together."""
    held, chars = [], 0
    for i, text in enumerate(column):
        text = text.as_py() or b""
        # Bytes split at the six ASCII blanks only.
        held.append(change(ids[i].as_py(), text.split()) if change else text.split())
        chars += len(text)
        if chars >= CHARS_AT_ONCE:
            yield i + 1 - len(held), held
            held, chars = [], 0
    if held:
        yield len(column) - len(held), held


def collapser(min_words: int, change: Change | None = None):
    """Batches (…, text last) to batches (…, n_words, runs, text)."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")) if change else None
            for first, texts in _chunks(ids, batch.column(batch.num_columns - 1).cast(pa.binary()), change):
                runs, many = find_runs(texts, min_words)
                ends = np.cumsum(many)
                kept = []
                for i, words in enumerate(texts):
                    if many[i]:
                        stay = np.ones(len(words), bool)
                        for start, length, period in runs[ends[i] - many[i] : ends[i]]:
                            stay[start + period : start + length] = False
                        words = [words[k] for k in np.flatnonzero(stay)]
                    kept.append(b" ".join(words))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"]))
                rows = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array([len(w) for w in texts], pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], [*rows.schema.names[:-1], "n_words", "runs", "text"])

    return collapse


def collapse_runs(docs: DataFrame, min_words: int = MIN_WORDS, change: Change | None = None) -> DataFrame:
    """Adds n_words and runs; of each run the text keeps the first period, words joined by one blank.

    ``change``: makes the words to search from a row's doc_id and its text's words, for texts that are edited on the way.
    """
    docs = without(docs, "n_words", "runs")
    kept = [c for c in docs.columns if c != "text"]
    result = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("text", T.StringType())])
    return docs.select(*(F.col(f"`{c}`") for c in kept), "text").mapInArrow(collapser(min_words, change), result)

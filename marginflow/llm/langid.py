"""Language of a text from unigram piece models, summed over all segmentations.

Pieces come from a fixed public vocabulary of byte pieces; every language has a probability for each. A text is a row of
units: maximal runs of letters and marks, in lower case, behind a blank, cut every ``LONGEST`` bytes. The forward
algorithm sums the probability of all ways to cut a unit into pieces, and a text's likelihood is the product over its
units. The score is the posterior of the best language, with the languages' shares of the learned units as prior.

Learning counts units per language over all rows given (in Spark, combined per task and then by shuffle) and runs
``ROUNDS`` rounds of expectation and maximisation over those counts: tasks add up expected pieces per language, and the
driver receives one number per piece and language, never texts. Nothing is sampled or capped. Languages are taken to be
a small set of names: the model holds vocabulary times languages.

Results: a null text or one without a letter is ``und`` with score 0; so is every text if nothing was learned. Equal
posteriors go to the smallest language. Rows without text or language teach nothing; repeated rows count each time and
get equal predictions. Texts are read whole. Columns of other names stay; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import importlib.util
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, without

VOCABULARY_FILE = "byte_bpe_multi_50k.tiktoken"
LONGEST = 32
ROUNDS = 2
#: Expected pieces that a language borrows from the mixture of all.
BORROWED = 100.0
#: Share of that mixture that is spread evenly over the vocabulary.
EVEN = 0.05
#: No piece is less likely, so that ``LONGEST`` single bytes stay above the smallest double.
FLOOR = 1e-9
#: Different words that a task keeps before it starts anew.
REMEMBERED = 400_000
UNITS_AT_ONCE = 20_000
ROWS_AT_ONCE = 200
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def vocabulary_path() -> str:
    """The installed public vocabulary, at the same place on every machine."""
    return str(Path(importlib.util.find_spec("public_tokenizers").origin).parent / VOCABULARY_FILE)


class Pieces:
    """The vocabulary's pieces that can occur in a unit, as a tree of bytes."""

    def __init__(self, path: str):
        listed = (base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip())
        fits = [p for p in listed if len(p) <= LONGEST and all(b >= 128 or 97 <= b <= 122 or (b == 32 and not k) for k, b in enumerate(p))]
        # Every byte is a piece, so every unit has a segmentation.
        self.names = sorted({*fits, b" ", *(bytes([b]) for b in (*range(97, 123), *range(128, 256)))})
        # Bytes that occur in units get the columns of a table of followers; 0 is no state but the root, which follows none.
        self.column = np.full(256, -1, np.int64)
        used = sorted({b for name in self.names for b in name})
        self.column[used] = np.arange(len(used))
        state = {b"": 0}
        for name in self.names:
            for k in range(1, len(name) + 1):
                state.setdefault(name[:k], len(state))
        self.follow = np.zeros((len(state), len(used)), np.int32)
        for prefix, number in state.items():
            if prefix:
                self.follow[state[prefix[:-1]], self.column[prefix[-1]]] = number
        self.piece = np.full(len(state), -1, np.int64)
        self.piece[[state[n] for n in self.names]] = np.arange(len(self.names))

    def lattice(self, units: list[bytes]) -> tuple[np.ndarray, ...]:
        """Nodes are the places between bytes of each unit. Edges (from, to, piece, place of from, place of to), and first nodes."""
        length = np.fromiter(map(len, units), np.int64, len(units))
        buffer = self.column[np.frombuffer(b"".join(units), np.uint8)]
        first = np.cumsum(length + 1) - (length + 1)
        unit = np.repeat(np.arange(len(units)), length)
        place = np.arange(len(buffer)) - np.repeat(np.cumsum(length) - length, length)
        node, left = first[unit] + place, length[unit] - place
        at, state, edges = np.arange(len(buffer)), np.zeros(len(buffer), np.int64), []
        for depth in range(LONGEST):
            inside = left[at] > depth
            at, state = at[inside], state[inside]
            if not len(at):
                break
            state = self.follow[state, buffer[at + depth]]
            known = state > 0
            at, state = at[known], state[known]
            whole = self.piece[state] >= 0
            found = at[whole]
            edges.append((node[found], node[found] + depth + 1, self.piece[state[whole]], place[found], place[found] + depth + 1))
        return *(np.concatenate(x) for x in zip(*edges)), first, length


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    """Read once per Python worker."""
    return Pieces(path)


def _sweep(values: np.ndarray, source: np.ndarray, target: np.ndarray, factor: np.ndarray, level: np.ndarray, levels: Iterator[int]) -> None:
    """Adds up factor times the source's value at every target, one level of places after another."""
    # Edges come as few ascending runs, and levels are bytes: both stable sorts are close to linear.
    order = np.argsort(target, kind="stable")
    order = order[np.argsort(level[order].astype(np.int8), kind="stable")]
    source, target, level, factor = source[order], target[order], level[order], factor[order]
    begins = np.searchsorted(level, np.arange(LONGEST + 2))
    for k in levels:
        part = slice(begins[k], begins[k + 1])
        if part.start < part.stop:
            new = np.flatnonzero(np.diff(target[part], prepend=-1))
            values[target[part][new]] = np.add.reduceat(values[source[part]] * factor[part], new, axis=0)


def forward(pieces: Pieces, p: np.ndarray, units: list[bytes]) -> np.ndarray:
    """Log-likelihood of each unit in each language: all segmentations summed. ``p`` is (pieces, languages)."""
    source, target, piece, _, to, first, length = pieces.lattice(units)
    alpha = np.zeros((int(first[-1] + length[-1]) + 1, p.shape[1]))
    alpha[first] = 1
    _sweep(alpha, source, target, p[piece], to, range(1, LONGEST + 1))
    return np.log(alpha[first + length])


def expected(pieces: Pieces, p: np.ndarray, units: list[bytes], lang: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected count of each piece in each language, for n copies of each unit in its language."""
    source, target, piece, begin, to, first, length = pieces.lattice(units)
    nodes = int(first[-1] + length[-1]) + 1
    unit_of = np.repeat(np.arange(len(units)), length + 1)
    tongue = lang[unit_of[source]]
    factor = p[piece, tongue]
    alpha, beta = np.zeros(nodes), np.zeros(nodes)
    alpha[first], beta[first + length] = 1, 1
    _sweep(alpha, source, target, factor, to, range(1, LONGEST + 1))
    _sweep(beta, target, source, factor, begin, range(LONGEST, -1, -1))
    share = alpha[source] * factor * beta[target] * (n / alpha[first + length])[unit_of[source]]
    return np.bincount(piece * p.shape[1] + tongue, share, len(pieces.names) * p.shape[1]).reshape(-1, p.shape[1])


def units_of(word: str) -> list[bytes]:
    out = []
    for run in (word,) if word.isalpha() else _LETTERS.findall(word):
        unit = b" " + run.encode("utf-8", "surrogatepass")
        out += [unit] if len(unit) <= LONGEST else [unit[k : k + LONGEST] for k in range(0, len(unit), LONGEST)]
    return out


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, unit, n), added up over at most ``REMEMBERED`` words at a time."""

    def told() -> pa.RecordBatch:
        total = Counter()
        for lang, words in held.items():
            for word, n in words.items():
                for unit in units_of(word):
                    total[lang, unit] += n
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.binary()), pa.array(list(total.values()), pa.int64())], ["lang", "unit", "n"])

    held: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(lang, Counter()).update(_words(text.as_py()))
        if sum(map(len, held.values())) > REMEMBERED:
            yield told()
            held = {}
    yield told()


class Model:
    """Piece probabilities of the learned languages, and the log of their shares."""

    def __init__(self, path: str, langs: list[str], p: np.ndarray, prior: np.ndarray):
        self.path, self.langs, self.p, self.prior = path, langs, p, prior


def _smoothed(counts: np.ndarray) -> np.ndarray:
    """Counts to probabilities: each language borrows from the mixture of all, which gives every piece something."""
    pooled = counts.sum(axis=1)
    mixture = (1 - EVEN) * pooled / pooled.sum() + EVEN / len(pooled)
    return np.maximum(FLOOR, (counts + BORROWED * mixture[:, None]) / (counts.sum(axis=0) + BORROWED))


def learn(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> Model:
    """Fits the piece probabilities to all rows of ``docs`` (text, lang)."""
    path = path or vocabulary_path()
    rows = docs.where("text is not null and lang is not null").select("lang", "text").mapInArrow(unit_counts, "lang string, unit binary, n long")
    units = staged(rows.groupBy("lang", "unit").agg(F.sum("n").alias("n")))
    # One row per language.
    sizes = sorted(tuple(r) for r in units.groupBy("lang").agg(F.sum("n")).collect())
    langs = [r[0] for r in sizes]
    number = {lang: k for k, lang in enumerate(langs)}
    n_pieces = len(pieces_of(path).names)
    p = np.full((n_pieces, len(langs)), 1 / n_pieces)
    spark = docs.sparkSession
    for _ in range(rounds if langs else 0):
        model = spark.sparkContext.broadcast(p)

        def add_up(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            pieces, total = pieces_of(path), np.zeros((n_pieces, len(langs)))
            for whole in batches:
                for k in range(0, whole.num_rows, UNITS_AT_ONCE):
                    batch = whole.slice(k, UNITS_AT_ONCE)
                    tongue = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
                    total += expected(pieces, model.value, batch.column(1).to_pylist(), tongue, batch.column(2).to_numpy().astype(float))
            piece, tongue = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(tongue.astype(np.int32)), pa.array(total[piece, tongue])], ["piece", "tongue", "n"])

        # One number per piece and language: its size follows the vocabulary, not the rows.
        sums = units.mapInArrow(add_up, "piece int, tongue int, n double").groupBy("piece", "tongue").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros_like(p)
        counts[sums["piece"].to_numpy(), sums["tongue"].to_numpy()] = sums["n"].to_numpy()
        p = _smoothed(counts)
        model.unpersist()
    share = np.array([r[1] for r in sizes], float)
    return Model(path, langs, p, np.log(share / share.sum()) if langs else share)


def predictor(model: Model) -> Callable:
    """Batches (…, text last) to batches (…, lang_pred, score)."""

    def predict_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model.path)
        row: dict[str, int] = {}
        table, letters, filled = np.zeros((0, len(model.langs))), np.zeros(0, np.int64), 0

        def learn_words(fresh: list[str]) -> None:
            """Adds a row per new word: the sum over its units, and whether it has any."""
            nonlocal table, letters, filled
            found = [units_of(w) for w in fresh]
            many = np.fromiter(map(len, found), np.int64, len(found))
            number = {u: k for k, u in enumerate(dict.fromkeys(u for us in found for u in us))}
            units, added = list(number), np.zeros((len(fresh), len(model.langs)))
            each = [forward(pieces, model.p, units[k : k + UNITS_AT_ONCE]) for k in range(0, len(units), UNITS_AT_ONCE)]
            if each:
                flat = np.concatenate(each)[np.fromiter((number[u] for us in found for u in us), np.int64, int(many.sum()))]
                some = np.flatnonzero(many)
                added[some] = np.add.reduceat(flat, (np.cumsum(many) - many)[some], axis=0)
            row.update(zip(fresh, range(filled, filled + len(fresh))))
            if filled + len(fresh) > len(table):
                more = max(len(table), len(fresh))
                table, letters = np.concatenate([table, np.zeros((more, len(model.langs)))]), np.concatenate([letters, np.zeros(more, np.int64)])
            table[filled : filled + len(fresh)], letters[filled : filled + len(fresh)] = added, many
            filled += len(fresh)

        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(k, ROWS_AT_ONCE)
                likelihood, lettered = np.zeros((batch.num_rows, len(model.langs))), np.zeros(batch.num_rows, np.int64)
                texts = [_words(t.as_py()) for t in batch.column(batch.num_columns - 1)]
                if len(row) > REMEMBERED:
                    row, filled = {}, 0
                if fresh := list(set().union(*texts).difference(row)):
                    learn_words(fresh)
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                at = np.fromiter(chain.from_iterable(map(row.__getitem__, words) for words in texts), np.int64, int(sizes.sum()))
                if len(at):
                    some = np.flatnonzero(sizes)
                    begins = (np.cumsum(sizes) - sizes)[some]
                    likelihood[some], lettered[some] = np.add.reduceat(table[at], begins, axis=0), np.add.reduceat(letters[at], begins)
                if model.langs:
                    posterior = likelihood + model.prior
                    best = posterior.argmax(axis=1)
                    score = 1 / np.exp(posterior - posterior.max(axis=1, keepdims=True)).sum(axis=1)
                else:
                    best, score, lettered = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), lettered * 0
                named = [model.langs[b] if n else UNKNOWN for b, n in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(named, pa.string()), pa.array(np.where(lettered > 0, np.round(score, 9), 0.0))], [*batch.schema.names[:-1], "lang_pred", "score"])

    return predict_batches


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows with lang_pred and score in place of their text."""
    docs = without(docs, "lang_pred", "score")
    kept = [c for c in docs.columns if c != "text"]
    result = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*(F.col(f"`{c}`") for c in kept), "text").mapInArrow(predictor(model), result)

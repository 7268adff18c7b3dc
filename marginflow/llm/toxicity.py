"""Toxicity scores from a bidirectional gated recurrent network over words and their characters, trained in numpy.

A token's input is the vector of its word (hashed) plus the vectors of its character four-grams (hashed, with marks at
the word's ends). Two gated recurrent layers read a window forwards and backwards, attention pools their states, and a
logistic unit scores the window. A document is all its overlapping windows of ``WINDOW`` tokens, ``STRIDE`` apart; its
score is that of the worst window. Labels are of documents, so training pushes the worst window of a toxic document up
and the worst window of a clean one down.

Training uses at most ``MAX_PER_CLASS`` labelled documents per class, the first in a seeded shuffle, on the driver, and
of a text of over ``MAX_TRAIN_WORDS`` tokens one random stretch of so many per step; everything else covers every window
of every document. Nulls: a null or empty text is one window of one padding token.
Labels with a null doc_id or null mark are not used; without labels of both classes every score is the prior. Repeated
rows get the same score. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 64
STRIDE = 48
#: A longer run without blanks is cut into tokens of so many bytes; neighbours share ``SHARED``, so no four-gram is lost.
LONGEST = 40
SHARED = 3
WORD_BUCKETS = 1 << 14
CHAR_BUCKETS = 1 << 15
INPUT = 12
HIDDEN = 8
MAX_PER_CLASS = 600
MAX_TRAIN_WORDS = 3000
EPOCHS = 4
#: Words whose inputs a task remembers, and windows that it scores at once.
VOCABULARY = 250_000
WINDOWS_AT_ONCE = 1024
PAD = b"\x00"


def char_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed four-grams of bytes of each word between marks, and where each word's grams begin."""
    marked = [b"\x02" + w + b"\x03\x03" if len(w) < 2 else b"\x02" + w + b"\x03" for w in words]
    buffer = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(lengths)
    gram = buffer[:-3] | buffer[1:-2] << 8 | buffer[2:-1] << 16 | buffer[3:] << 24
    inside = np.ones(len(gram), bool)
    for back in (1, 2, 3):
        cut = ends[:-1] - back
        inside[cut[cut < len(gram)]] = False
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths - 3, 1))[:-1]])
    return ((gram[inside] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), starts


class Vocabulary(dict):
    """Word to row number; rows of new words wait in ``fresh``."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        self.fresh.append(word)
        return value


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; a run of over ``LONGEST`` bytes without blanks is several tokens, which hold all its bytes and four-grams."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return [PAD]
    if max(map(len, words)) <= LONGEST:
        return words
    return [w[k : k + LONGEST] for w in words for k in range(0, max(1, len(w) - SHARED), LONGEST - SHARED)]


def windows(n: int) -> np.ndarray:
    """Where the windows of a text of n tokens begin: every token is in one, and neighbours overlap."""
    return np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": normal(WORD_BUCKETS, INPUT, scale=0.1), "char": normal(CHAR_BUCKETS, INPUT, scale=0.1)}
        for d in ("f", "b"):
            self.p |= {f"{d}x": normal(INPUT, 3 * HIDDEN, scale=0.4), f"{d}h": normal(HIDDEN, 3 * HIDDEN, scale=0.3), f"{d}c": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"att": normal(2 * HIDDEN, 2 * HIDDEN, scale=0.3), "key": normal(2 * HIDDEN, scale=0.5), "out": normal(2 * HIDDEN, scale=0.5), "bias": np.full(1, -1.0, np.float32)}

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """One input vector per word."""
        grams, starts = char_grams(words)
        slots = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % WORD_BUCKETS
        counts = np.diff(np.append(starts, len(grams)))
        scale = (1 / np.sqrt(counts)).astype(np.float32)[:, None]
        summed = np.add.reduceat(self.p["char"][grams], starts, axis=0) * scale
        return self.p["word"][slots] + summed, (grams, counts, slots, scale)

    def run(self, d: str, projected: np.ndarray, keep: bool = False):
        """States of one direction: projected inputs (time, windows, 3 gates) to (time, windows, hidden)."""
        steps, n, _ = projected.shape
        wh, h = self.p[f"{d}h"], np.zeros((n, HIDDEN), np.float32)
        states, trail = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            a = projected[t] + 0
            g = h @ wh
            zr = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            if keep:
                trail.append((h, z, r, c, g[:, 2 * HIDDEN :]))
            h = c + z * (h - c)
            states[t] = h
        return states, trail

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Scores (logits) of windows: x (time, windows, 6 * hidden) projected inputs of both directions, mask (time, windows).

        Padding stands at the end; the backward layer starts from it, with inputs of zero.
        """
        forward, ft = self.run("f", x[:, :, : 3 * HIDDEN], keep)
        backward, bt = self.run("b", x[::-1, :, 3 * HIDDEN :], keep)
        both = np.concatenate([forward, backward[::-1]], axis=2)
        flat = both.reshape(-1, 2 * HIDDEN)
        hid = np.tanh(flat @ self.p["att"])
        e = np.where(mask, (hid @ self.p["key"]).reshape(mask.shape), np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, both)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, (ft, bt, both, hid, weight, pooled)) if keep else logit

    def projection(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([self.p["fx"], self.p["bx"]], axis=1), np.concatenate([self.p["fc"], self.p["bc"]])

    def _back_run(self, d: str, trail: list, dstates: np.ndarray):
        wh = self.p[f"{d}h"]
        steps, n, _ = dstates.shape
        dproj, dwh, dh = np.empty((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(wh), np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, c, gc = trail[t]
            dh = dh + dstates[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * gc * r * (1 - r)
            dproj[t] = np.concatenate([dz, dr, dc], axis=1)
            dg = np.concatenate([dz, dr, dc * r], axis=1)
            dwh += h.T @ dg
            dh = dh * z + dg @ wh.T
        return dproj, dwh

    def backward(self, mask: np.ndarray, kept: tuple, dlogit: np.ndarray):
        """Gradients of all but the embeddings, and of the projected inputs."""
        ft, bt, both, hid, weight, pooled = kept
        steps, n = mask.shape
        g = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * self.p["out"]
        dweight = np.einsum("nk,tnk->tn", dpool, both)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        g["key"] = hid.T @ de.reshape(-1)
        dhid = de.reshape(-1, 1) * self.p["key"] * (1 - hid * hid)
        flat = both.reshape(-1, 2 * HIDDEN)
        g["att"] = flat.T @ dhid
        dboth = weight[:, :, None] * dpool + (dhid @ self.p["att"].T).reshape(steps, n, -1)
        df, g["fh"] = self._back_run("f", ft, dboth[:, :, :HIDDEN])
        db, g["bh"] = self._back_run("b", bt, dboth[::-1, :, HIDDEN:])
        return g, np.concatenate([df, db[::-1]], axis=2)


def _summed(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by index."""
    order = np.argsort(index, kind="stable")
    sorted_index = index[order]
    starts = np.flatnonzero(np.diff(sorted_index, prepend=-1))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[sorted_index[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def _laid_out(ids: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of several texts side by side: word rows (time, windows), mask, and the text of each window."""
    begins = [windows(len(x)) for x in ids]
    n = sum(map(len, begins))
    at, mask, owner = np.zeros((WINDOW, n), np.int64), np.zeros((WINDOW, n), bool), np.repeat(np.arange(len(ids)), [len(b) for b in begins])
    k = 0
    for x, b in zip(ids, begins, strict=True):
        place = b[None, :] + np.arange(WINDOW)[:, None]
        good = place < len(x)
        at[:, k : k + len(b)] = np.where(good, x[np.minimum(place, len(x) - 1)], 0)
        mask[:, k : k + len(b)] = good
        k += len(b)
    return at, mask, owner


def fit(texts: list[str], marks: list[int], seed: int = 11) -> Network:
    """Trains on labelled texts; a text's windows compete and the worst one carries its label."""
    net, draw = Network(seed), np.random.default_rng(seed)
    if not texts or len(set(marks)) < 2:
        return net
    split = [tokens(t) for t in texts]
    y_all, share = np.array(marks, np.float32), max(1e-3, float(np.mean(marks)))
    size = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(split))
        for chunk in np.array_split(order, max(1, len(order) // 24)):
            vocabulary = Vocabulary()
            ids = []
            for i in chunk:
                # A very long text lends a random stretch per step; over the epochs its windows take turns.
                w = split[i]
                at = int(draw.integers(0, max(1, len(w) - MAX_TRAIN_WORDS + 1)))
                ids.append(np.fromiter(map(vocabulary.__getitem__, w[at : at + MAX_TRAIN_WORDS]), np.int64))
            x, (grams, counts, slots, scale) = net.inputs(vocabulary.fresh)
            px, pc = net.projection()
            at, mask, owner = _laid_out(ids, x)
            projected = (x @ px + pc)[at] * mask[:, :, None]
            logit, kept = net.forward(projected, mask, keep=True)
            best = np.full(len(chunk), -np.inf, np.float32)
            np.maximum.at(best, owner, logit)
            # A soft maximum shares the gradient among a text's windows.
            soft = np.exp(2 * (logit - best[owner]))
            total = np.bincount(owner, soft, len(chunk)).astype(np.float32)
            pull = soft / total[owner]
            score = _sigmoid(best)
            wrong = (score - y_all[chunk]) * np.where(y_all[chunk] > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(chunk)
            g, dproj = net.backward(mask, kept, (wrong[owner] * pull).astype(np.float32))
            dproj = dproj * mask[:, :, None]
            half = 3 * HIDDEN
            dword = _summed(dproj.reshape(-1, 2 * half), at.reshape(-1), len(x))
            g["fx"], g["bx"] = x.T @ dword[:, :half], x.T @ dword[:, half:]
            g["fc"], g["bc"] = dword[:, :half].sum(axis=0), dword[:, half:].sum(axis=0)
            dx = dword @ px.T
            g["word"], g["char"] = _summed(dx, slots, WORD_BUCKETS), _summed(np.repeat(dx * scale, counts, axis=0), grams, CHAR_BUCKETS)
            step += 1
            for k, v in net.p.items():
                m, s = size[k]
                m += np.float32(0.1) * (g[k] - m)
                s += np.float32(0.01) * (g[k] * g[k] - s)
                v -= np.float32(0.01) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(s / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    worst = np.concatenate([_worst(net, split[k : k + 64]) for k in range(0, len(split), 64)])
    # One half lies midway between the highest clean and the lowest toxic scores of the sample, leaving out the outermost.
    net.p["bias"] -= np.float32((np.quantile(worst[y_all == 0], 0.998) + np.quantile(worst[y_all == 1], 0.02)) / 2)
    return net


def _worst(net: Network, split: list[list[bytes]]) -> np.ndarray:
    """The logit of each text's worst window."""
    vocabulary = Vocabulary()
    ids = [np.fromiter(map(vocabulary.__getitem__, w), np.int64) for w in split]
    px, pc = net.projection()
    table = net.inputs(vocabulary.fresh)[0] @ px + pc
    at, mask, owner = _laid_out(ids, table)
    best = np.full(len(split), -np.inf, np.float32)
    for k in range(0, at.shape[1], WINDOWS_AT_ONCE):
        part = slice(k, k + WINDOWS_AT_ONCE)
        np.maximum.at(best, owner[part], net.forward(table[at[:, part]] * mask[:, part, None], mask[:, part]))
    return best


def scorer(net: Network):
    """Scores of documents (doc_id, text): every window, in blocks of bounded size."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        px, pc = net.projection()
        vocabulary, table, filled = Vocabulary(), np.empty((VOCABULARY, 6 * HIDDEN), np.float32), 0
        for batch in batches:
            best = np.full(batch.num_rows, -np.inf, np.float32)
            ids, docs, held = [], [], 0

            def settle():
                nonlocal table, filled
                if vocabulary.fresh:
                    if len(vocabulary) > len(table):
                        table = np.concatenate([table, np.empty((len(vocabulary), 6 * HIDDEN), np.float32)])
                    table[filled : len(vocabulary)] = net.inputs(vocabulary.fresh)[0] @ px + pc
                    vocabulary.fresh, filled = [], len(vocabulary)
                at, mask, owner = _laid_out(ids, table)
                for k in range(0, at.shape[1], WINDOWS_AT_ONCE):
                    part = slice(k, k + WINDOWS_AT_ONCE)
                    logit = net.forward(table[at[:, part]] * mask[:, part, None], mask[:, part])
                    np.maximum.at(best, np.array(docs)[owner[part]], logit)

            for i, text in enumerate(batch.column(1)):
                ids.append(np.fromiter(map(vocabulary.__getitem__, tokens(text.as_py())), np.int64))
                docs.append(i)
                held += len(windows(len(ids[-1])))
                if held >= WINDOWS_AT_ONCE:
                    settle()
                    ids, docs, held = [], [], 0
                    if len(vocabulary) > VOCABULARY - 50_000:
                        vocabulary, table, filled = Vocabulary(), table[:VOCABULARY], 0
            if ids:
                settle()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(best).astype(np.float64))], ["doc_id", "score"])

    return score


def train(docs: DataFrame, marked: DataFrame, most: int = MAX_PER_CLASS, seed: int = 11) -> Network:
    """Fits on labelled rows (doc_id, toxic): at most ``most`` documents of each class come to the driver."""
    clean = marked.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    order = F.xxhash64("doc_id", F.lit(seed))
    picked = [clean.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(most) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    # At most 2 * most rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"]))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows], seed)


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row; only the text is looked at."""
    return docs.select("doc_id", "text").mapInArrow(scorer(net), "doc_id long, score double")

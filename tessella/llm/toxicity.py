"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs are words (hashed embeddings) and their characters (hashed embeddings of 3- to 5-grams, pooled by the maximum). A forward
and a backward gated recurrent layer read a window of words, attention pools their states, and a logistic unit scores the
window. Windows overlap and cover a whole text; a text's score is that of its worst window, calibrated on a part of the
training rows that the network did not see.

Training takes a bounded sample of labelled rows (`FitLimits`) to the driver. Only a text's label says that some window is toxic,
so each round trains on the windows that score highest so far; the first round takes the windows with the largest log-odds of
words and character grams. Scoring is one pass over the texts without a shuffle, with the network in the task's closure.

Defined results for odd input: null, empty and wordless texts score 0; labels without a document are not used; rows are
scored by their text alone, so repeated rows repeat their score and labels, languages, sources and ids are no inputs; without
labelled rows of both classes every score is 0. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded, released, ship, texts

THRESHOLD = 0.3
WINDOW, STRIDE = 32, 24
HIDDEN, ATTENTION = 8, 8
BATCH = 128
#: Share of a batch's distinct words that go without their word embedding while training.
WORD_DROP = 0.5
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 16
WORD_DIM, GRAM_DIM = 8, 8
GRAMS = (3, 4, 5)
PUNCTUATION = b".,;:!?\"'()[]{}<>*#$%&|-_/\\~"
CLEAN = bytes(32 if i in PUNCTUATION else ASCII_LOWER[i] for i in range(256))


@dataclass(frozen=True)
class FitLimits:
    """The bounds of the training sample: rows of each class, by a hash of their ids, and the bytes of a text.

    A round takes `epochs` passes over its windows, or more until it has made `round_steps` steps.
    """

    positives: int = 1500
    negatives: int = 2400
    text_bytes: int = 1 << 15
    rounds: int = 4
    epochs: int = 2
    round_steps: int = 80
    seed: int = 3


class Words:
    """Distinct words of a batch of texts, and the texts as their numbers."""

    def __init__(self, data: list[bytes]):
        index: dict[bytes, int] = {}
        self.docs = []
        for d in data:
            words = d.translate(CLEAN).split()
            self.docs.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
        self.words = list(index)
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        # each word stands between a 1 and a 2
        raw = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in self.words), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(self.words), dtype=np.int32), lengths + 2)
        grams, whose = [], []
        for n in GRAMS:
            if len(raw) < n:
                continue
            h = np.full(len(raw) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ raw[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = owner[: len(h)] == owner[n - 1 :]
            grams.append((h[inside] % np.uint64(GRAM_ROWS)).astype(np.int32))
            whose.append(owner[: len(h)][inside])
        self.grams, self.whose = (np.concatenate(grams), np.concatenate(whose)) if grams else (np.zeros(0, np.int32),) * 2
        by = np.argsort(self.whose, kind="stable")
        self.grams, self.whose = self.grams[by], self.whose[by]
        # every word has a 3-gram: even one letter between its marks
        self.first = np.searchsorted(self.whose, np.arange(len(self.words)))
        self.rows = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in self.words), np.int64, len(self.words))


def windows(docs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows of word numbers, padded with `pad`, and each window's text."""
    out, owner = [], []
    for i, d in enumerate(docs):
        if not len(d):
            continue
        count = 1 + max(0, -(-(len(d) - WINDOW) // STRIDE))
        at = np.arange(count)[:, None] * STRIDE + np.arange(WINDOW)
        out.append(np.append(d, pad)[np.minimum(at, len(d))].astype(np.int32))
        owner.append(np.full(count, i))
    if not out:
        return np.zeros((0, WINDOW), np.int32), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The network's parameters, its forward pass and its gradients."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        d, h, a = WORD_DIM + GRAM_DIM, HIDDEN, ATTENTION

        def random(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "word": (rng.standard_normal((WORD_ROWS, WORD_DIM)) * 0.1).astype(np.float32),
            "gram": (rng.standard_normal((GRAM_ROWS, GRAM_DIM)) * 0.1).astype(np.float32),
            "att": random(2 * h, a), "att_b": np.zeros(a, np.float32), "att_c": random(a), "out": random(2 * h), "out_b": np.zeros(1, np.float32),
        }
        for way in "fb":
            self.p |= {f"w{way}": random(d, 3 * h), f"b{way}": np.zeros(3 * h, np.float32), f"u{way}": random(h, 3 * h)}

    def inputs(self, w: Words) -> np.ndarray:
        """One row per distinct word, and a row of zeros for padding."""
        x = np.zeros((len(w.words) + 1, WORD_DIM + GRAM_DIM), np.float32)
        if w.words:
            x[:-1, :WORD_DIM] = self.p["word"][w.rows]
            ends = np.append(w.first, len(w.grams))
            for lo in range(0, len(w.words), 8192):  # all words' grams at once would be large
                hi = min(lo + 8192, len(w.words))
                a, b = ends[lo], ends[hi]
                x[lo:hi, WORD_DIM:] = np.maximum.reduceat(self.p["gram"][w.grams[a:b]], w.first[lo:hi] - a)
        return x

    def forward(self, x: np.ndarray, win: np.ndarray, keep: bool = False):
        """Logits of windows; with `keep`, what the gradients need."""
        p, h = self.p, HIDDEN
        mask = (win != len(x) - 1).astype(np.float32)
        n, steps = win.shape
        states = np.zeros((steps, n, 2 * h), np.float32)
        cache: dict = {}
        for way, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            proj = x @ p[f"w{way}"] + p[f"b{way}"]
            s, u = np.zeros((n, h), np.float32), p[f"u{way}"]
            seen = []
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                i, r_ = proj[win[:, t]], s @ u
                zr = sigmoid(i[:, : 2 * h] + r_[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(i[:, 2 * h :] + r * r_[:, 2 * h :])
                m = mask[:, t, None]
                nxt = s + m * (1 - z) * (new - s)
                if keep:
                    seen.append((t, s, z, r, new, r_[:, 2 * h :]))
                s = nxt
                states[t, :, at] = s
            cache[way] = seen
        att = np.tanh(states @ p["att"] + p["att_b"])
        e = att @ p["att_c"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        alpha = np.exp(e - e.max(0))
        alpha /= alpha.sum(0)
        pooled = (alpha[:, :, None] * states).sum(0)
        logits = pooled @ p["out"] + p["out_b"]
        return (logits, (mask, states, cache, att, alpha, pooled)) if keep else logits

    def gradients(self, w: Words, x: np.ndarray, win: np.ndarray, target: np.ndarray, weight: np.ndarray, kept: np.ndarray | None = None) -> tuple[float, dict]:
        """Loss and gradients; words that are not `kept` had no embedding of their own in `x`."""
        p, h = self.p, HIDDEN
        logits, (mask, states, cache, att, alpha, pooled) = self.forward(x, win, True)
        prob = sigmoid(logits)
        loss = float((weight * (np.logaddexp(0, logits) - target * logits)).sum())
        d = (weight * (prob - target)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["out"]
        d_states = alpha[:, :, None] * d_pooled
        d_alpha = (states * d_pooled).sum(2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        d_att = d_e[:, :, None] * p["att_c"] * (1 - att**2)
        g["att_c"] = np.einsum("tna,tn->a", att, d_e)
        g["att"] = np.einsum("tns,tna->sa", states, d_att)
        g["att_b"] = d_att.sum((0, 1))
        d_states = d_states + d_att @ p["att"].T
        d_x = np.zeros_like(x)
        for way, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, d_u = p[f"u{way}"], np.zeros_like(p[f"u{way}"])
            d_proj = np.zeros((len(x), 3 * h), np.float32)
            d_s = np.zeros((len(win), h), np.float32)
            for t, s, z, r, new, ru in reversed(cache[way]):
                d_s = d_s + d_states[t, :, at]
                m = mask[:, t, None]
                d_z = d_s * m * (s - new) * z * (1 - z)
                d_new = d_s * m * (1 - z) * (1 - new**2)
                d_r = d_new * ru * r * (1 - r)
                d_in = np.concatenate([d_z, d_r, d_new], axis=1)
                d_rec = np.concatenate([d_z, d_r, d_new * r], axis=1)
                np.add.at(d_proj, win[:, t], d_in)
                d_u += s.T @ d_rec
                d_s = d_s * (1 - m * (1 - z)) + d_rec @ u.T
            g[f"u{way}"], g[f"w{way}"], g[f"b{way}"] = d_u, x.T @ d_proj, d_proj.sum(0)
            d_x += d_proj @ p[f"w{way}"].T
        d_x[-1] = 0
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        used = np.unique(win)
        used = used[used < len(w.words)]
        whole = used if kept is None else used[kept[used]]
        np.add.at(g["word"], w.rows[whole], d_x[whole, :WORD_DIM])
        picked = np.zeros(len(w.words), np.bool_)
        picked[used] = True
        some = picked[w.whose]
        grams, whose = w.grams[some], w.whose[some]
        top = p["gram"][grams] == x[whose, WORD_DIM:]  # equal grams of a word share its gradient twice at most
        np.add.at(g["gram"], grams, np.where(top, d_x[whose, WORD_DIM:], 0))
        return loss, g


def log_odds(w: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds of each row of the word and the gram table, by the labels of the texts that have it."""

    def odds(rows_of, size: int) -> np.ndarray:
        counts = np.ones((2, size))
        for d, y in zip(w.docs, labels.tolist()):
            counts[int(y), rows_of(np.unique(d))] += 1
        share = counts / (np.array([[(labels == 0).sum()], [(labels == 1).sum()]]) + 2)
        return np.log(share[1]) - np.log(share[0])

    ends = np.append(w.first[1:], len(w.grams))

    def grams(words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        n = ends[words] - w.first[words]
        at = np.repeat(w.first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.unique(w.grams[at])

    return odds(lambda d: np.unique(w.rows[d]), WORD_ROWS), odds(grams, GRAM_ROWS)


@dataclass
class Model:
    network: Network | None
    slope: float = 1.0
    offset: float = 0.0

    def logits(self, data: list[bytes]) -> np.ndarray:
        """Each text's largest logit of a window; minus infinity without words."""
        out = np.full(len(data), -np.inf)
        if self.network is None:
            return out
        w = Words(data)
        win, owner = windows(w.docs, len(w.words))
        x = self.network.inputs(w)
        for lo in range(0, len(win), 2048):
            np.maximum.at(out, owner[lo : lo + 2048], self.network.forward(x, win[lo : lo + 2048]))
        return out

    def scores(self, data: list[bytes]) -> np.ndarray:
        logits = self.logits(data)
        found = np.isfinite(logits)
        out = np.zeros(len(data))
        out[found] = 1 / (1 + np.exp(-np.clip(self.slope * logits[found] + self.offset, -500, 500)))
        return out


def train(data: list[bytes], labels: list[int], limits: FitLimits = FitLimits()) -> Model:
    """A model of these rows; a fifth of them calibrates it."""
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return Model(None)
    rng = np.random.default_rng(limits.seed)
    held = np.array([zlib.crc32(d) % 5 == 0 for d in data])
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held = np.zeros(len(y), np.bool_)
    fit = np.flatnonzero(~held)
    net = Network(limits.seed)
    w = Words([data[i] for i in fit])
    target = y[fit]
    words, grams = log_odds(w, target)
    net.p["word"][:, 0] = np.clip(words, -3, 6) / 3
    net.p["gram"][:, 0] = np.clip(grams, -3, 6) / 3
    win, owner = windows(w.docs, len(w.words))
    of_word = np.append((words[w.rows] + (np.maximum.reduceat(grams[w.grams], w.first) if len(w.words) else 0)).astype(np.float32), np.float32(-9))
    best = of_word[win].max(1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    balance = np.array([1.0, max(1.0, (target == 0).sum() / max(1, (target == 1).sum()) / 2)])
    for turn in range(limits.rounds):
        if turn:
            x = net.inputs(w)
            best = np.concatenate([net.forward(x, win[lo : lo + 4096]) for lo in range(0, len(win), 4096)])
        order = np.lexsort((-best, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        top = order[place < np.where(target[owner[order]] == 1, 1, 3)]
        for _ in range(max(limits.epochs, -(-limits.round_steps * BATCH // len(top)))):
            every = rng.permutation(top)
            for lo in range(0, len(every), BATCH):
                at = every[lo : lo + BATCH]
                rows = target[owner[at]]
                used, small = np.unique(win[at], return_inverse=True)
                part = _part(w, used[used < len(w.words)])
                xs = net.inputs(part)
                kept = rng.random(len(part.words)) >= WORD_DROP  # the rest has to be told by its characters
                xs[:-1][~kept, :WORD_DIM] = 0
                numbers = np.where(used < len(w.words), np.arange(len(used)), len(part.words))[small].reshape(win[at].shape)
                _, g = net.gradients(part, xs, numbers, rows.astype(np.float32), (balance[rows] / len(at)).astype(np.float32), kept)
                step += 1
                _adam(net.p, g, moments, step, 0.004)
    model = Model(net)
    check = np.flatnonzero(held) if held.any() else fit
    model.slope, model.offset = calibrate(model.logits([data[i] for i in check]), y[check])
    return model


def _part(w: Words, used: np.ndarray) -> Words:
    """`w` cut down to some of its words, in ascending order."""
    out = object.__new__(Words)
    out.words = [w.words[i] for i in used.tolist()]
    ends = np.append(w.first[1:], len(w.grams))
    n = ends[used] - w.first[used]
    at = np.repeat(w.first[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    out.grams, out.whose, out.first, out.rows = w.grams[at], np.repeat(np.arange(len(used)), n), np.cumsum(n) - n, w.rows[used]
    return out


def _adam(p: dict, g: dict, moments: dict, step: int, rate: float) -> None:
    scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
    for k, grad in g.items():
        m, v = moments[k]
        if k in ("word", "gram"):  # only rows that were used move
            rows = np.flatnonzero(grad.any(1))
            gr = grad[rows]
            m[rows] = 0.9 * m[rows] + 0.1 * gr
            v[rows] = 0.999 * v[rows] + 0.001 * gr**2
            p[k][rows] -= scale * m[rows] / (np.sqrt(v[rows]) + 1e-8)
            continue
        m += 0.1 * (grad - m)
        v += 0.001 * (grad**2 - v)
        p[k] -= (scale * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with targets kept off 0 and 1."""
    ok = np.isfinite(logits)
    s, y = logits[ok].astype(np.float64), y[ok]
    pos, neg = (y == 1).sum(), (y == 0).sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def loss(a: float, b: float) -> float:
        z = a * s + b
        return float((np.logaddexp(0, z) - t * z).sum() + 5e-4 * (a - 1) ** 2)

    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * s + b, -500, 500)))
        r = q * (1 - q) + 1e-9
        grad = np.array([((q - t) * s).sum() + 1e-3 * (a - 1), (q - t).sum()])
        hess = np.array([[(r * s * s).sum() + 1e-3, (r * s).sum()], [(r * s).sum(), r.sum() + 1e-6]])
        move, size, before = np.linalg.solve(hess, grad), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * move[0], b - size * move[1]) > before:
            size /= 2
        a, b = a - size * move[0], b - size * move[1]
        if np.abs(size * move).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text has the remainder 2 by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limits: FitLimits = FitLimits(), *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Trains on labelled rows whose CRC-32 of the id, modulo 4, is not 2: a hash sample of each class within the limits."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    picked = None
    for value, bound in ((1, limits.positives), (0, limits.negatives)):
        some = marks.where(F.col("label") == value).orderBy(F.xxhash64("doc_id", F.lit(limits.seed)), "doc_id").limit(bound)
        picked = some if picked is None else picked.unionAll(some)
    # `picked` has at most positives + negatives rows
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") <= limits.text_bytes)
    rows = body.join(F.broadcast(picked), "doc_id").orderBy("doc_id", "label", "text").limit(2 * (limits.positives + limits.negatives)).collect()
    return train([r["text"].encode() for r in rows], [r["label"] for r in rows], limits)


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of `docs` with a score and a prediction, named `names`; they replace columns of those names."""
    ship(docs.sparkSession)
    columns = [c for c in docs.columns if c not in names]
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch.column(at), 2 << 20):
                s = model.scores(texts(batch.column(at)[part]))
                yield pa.RecordBatch.from_arrays(
                    [*[c[part] for c in batch.columns], pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*columns, *names]
                )

    kinds = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns], f"`{names[0]}` double, `{names[1]}` int"])
    return docs.select(*columns).mapInArrow(released(run), kinds)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

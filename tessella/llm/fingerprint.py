"""Document fingerprints: an improbable-feature digest.

Every 64-byte window of a document has an entropy; how improbable that entropy is in ordinary text ranks the window.
In each run of 64 neighbouring windows the most improbable (leftmost of equals) gains a point, and windows with
enough points are the features. A feature's SHA-1 sets five bits of a 2,048-bit Bloom filter; after 160 features the
next filter of the chain begins. Two digests are compared filter by filter: shared bits beyond those that chance gives,
normalised to 0..1, best match for each filter of the shorter digest, weighted by features.

The entropies of a whole batch of documents are updated together: comparing the buffer with itself at the 63 shifts
inside a window counts every byte's equals before and after it, and a running sum of entropy terms follows.

Defined results for odd input: a null text is empty; an empty text has no features, and is like another empty text (1)
and unlike any other (0); texts under 1,024 bytes also or only take smaller windows and runs, under 128 bytes also or only every four
bytes; ids may repeat or be null (nulls come last); a lone document is its own next one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, released, ship

FILTER_BITS = 2048
FILTER_FEATURES = 160
_UNIT = 1 << 16
_BUFFER = 1 << 18
#: Bytes of text of a block and of a task.
BLOCK_BYTES, TASK_BYTES = 2 << 20, 32 << 20


class Scale:
    """Windows of `window` bytes, runs of `run` windows, `points` that make a feature.

    `typical` and `spread`: ordinary text has windows of about this share of the possible entropy, so far apart.
    Windows below `least` (runs, padding, tables) say little and are never features.
    """

    def __init__(self, window: int, run: int, points: int, typical: float, spread: float, least: float):
        self.window, self.run, self.points = window, run, points
        c = np.arange(window + 1, dtype=np.float64)
        term = np.zeros(window + 1)
        term[1:] = c[1:] * np.log2(c[1:])
        #: steps of c log2 c in fixed point
        self.step = np.rint(np.diff(term) * _UNIT).astype(np.int64)
        h = np.arange(1001) / 1000
        odd = np.abs(h - typical) / spread
        #: the rank of each entropy in thousandths, improbable first
        self.rank = np.argsort(np.argsort(-odd, kind="stable"), kind="stable").astype(np.int64)
        self.rank[h < least] = 1001


LARGE = Scale(64, 64, 16, 0.70, 0.08, 0.35)
SMALL = Scale(16, 8, 2, 0.82, 0.08, 0.35)
#: The large scale is for texts from `SHORT` bytes on, the small one from `TINY` to twice `SHORT`, and below twice `TINY` all
#: `TINY_WINDOW`-byte windows are features: texts of which one has up to twice the other's bytes always share a kind of features.
SHORT, TINY, TINY_WINDOW = 512, 64, 4


def window_entropy(data: np.ndarray, scale: Scale = LARGE) -> np.ndarray:
    """The entropy in thousandths of each window of a byte array of at least one window."""
    n, window = len(data), scale.window
    before, after, same = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.empty(n, np.bool_)
    for d in range(1, window):
        eq = np.equal(data[d:], data[:-d], out=same[: n - d]).view(np.uint8)
        np.add(before[d:], eq, out=before[d:])
        np.add(after[: n - d], eq, out=after[: n - d])
    change = scale.step[before]
    # a byte's leaving takes back the term of its equals among those after it in the window
    change[window:] -= scale.step[after[: n - window]]
    # while the first window fills, `before` counts from the start, so the sum is exact from its end on
    total = np.cumsum(change)[window - 1 :]
    most = np.log2(window)
    return np.clip(np.rint((most - total / (_UNIT * window)) * (1000 / most)), 0, 1000).astype(np.int64)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` (a power of two) neighbours."""
    step = 1
    while step < width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return keys


def _groups(docs: list[bytes]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, d in enumerate(docs):
        if group and size + len(d) > _BUFFER:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(d)
    if group:
        yield group


def feature_places(docs: list[bytes], scale: Scale = LARGE) -> list[np.ndarray]:
    """For each document, of at least a window, the starts of its features."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(docs)
    for chosen in _groups(docs):
        data = np.frombuffer(b"".join(docs[i] for i in chosen), np.uint8)
        ends = np.cumsum([len(docs[i]) for i in chosen])
        starts = ends - [len(docs[i]) for i in chosen]
        rank = scale.rank[window_entropy(data, scale)]
        keys = (rank << 40) | np.arange(len(rank))
        points = np.zeros(len(data), np.int64)
        if len(keys) >= scale.run:
            best = _least(keys, scale.run)
            # only runs inside one document count: up to its last window
            ok = np.zeros(len(best) + 1, np.int64)
            windows = ends - starts - scale.window + 1
            for a, w in zip(starts[windows >= scale.run], windows[windows >= scale.run]):
                ok[a] += 1
                ok[a + w - scale.run + 1] -= 1
            best = best[np.cumsum(ok[:-1]) > 0]
            best = best[(best >> 40) <= 1000] & ((1 << 40) - 1)
            points = np.bincount(best, minlength=len(data))
        for i, a, b in zip(chosen, starts, ends):
            w = b - a - scale.window + 1
            if w < scale.run:
                out[i] = np.array([int(keys[a : a + w].argmin())])
                continue
            own = points[a : a + w]
            found = np.flatnonzero(own >= scale.points)
            out[i] = found if len(found) else np.array([int(own.argmax())])
    return out


def features(docs: list[bytes]) -> list[list[bytes]]:
    out: list[list[bytes]] = [[] for _ in docs]
    for scale, low, high in ((LARGE, SHORT, None), (SMALL, TINY, 2 * SHORT)):
        chosen = [i for i, d in enumerate(docs) if low <= len(d) and (high is None or len(d) < high)]
        for i, places in zip(chosen, feature_places([docs[i] for i in chosen], scale)):
            out[i] += [docs[i][p : p + scale.window] for p in places.tolist()]
    for i, d in enumerate(docs):
        if 0 < len(d) < 2 * TINY:
            out[i] += [d[p : p + TINY_WINDOW] for p in range(max(1, len(d) - TINY_WINDOW + 1))]
    return out


def digest(docs: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """Each document's number of features and its chain of filters (rows of 256 bytes)."""
    out = []
    for found in features(docs):
        n = len(found)
        chain = np.zeros((-(-n // FILTER_FEATURES), FILTER_BITS), np.bool_)
        if n:
            sha = np.frombuffer(b"".join(hashlib.sha1(x).digest() for x in found), ">u4").reshape(n, 5)
            chain[np.repeat(np.arange(n) // FILTER_FEATURES, 5), (sha % FILTER_BITS).ravel()] = True
        out.append((n, np.packbits(chain, axis=1)))
    return out


def to_string(d: tuple[int, np.ndarray]) -> str:
    return f"{d[0]}:{d[1].tobytes().hex()}"


def from_string(s: str) -> tuple[int, np.ndarray]:
    n, _, hexa = s.partition(":")
    return int(n), np.frombuffer(bytes.fromhex(hexa), np.uint8).reshape(-1, FILTER_BITS // 8)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1: the bits that the filters share, beyond chance."""
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    if len(a[1]) > len(b[1]) or (len(a[1]) == len(b[1]) and a[0] > b[0]):
        a, b = b, a
    x, y = (np.ascontiguousarray(d[1]).view(np.uint64) for d in (a, b))
    ex, ey = (np.bitwise_count(f).sum(1, dtype=np.int64).astype(np.float64) for f in (x, y))
    weights = np.full(len(x), FILTER_FEATURES, np.float64)
    weights[-1] = a[0] - FILTER_FEATURES * (len(x) - 1)
    total = 0.0
    for i, row in enumerate(x):
        common = np.concatenate([np.bitwise_count(row & y[j : j + 4096]).sum(1, dtype=np.int64) for j in range(0, len(y), 4096)])
        most = np.minimum(ex[i], ey)
        chance = ex[i] * ey / FILTER_BITS
        floor = chance + 0.3 * (most - chance)
        total += weights[i] * float(np.clip((common - floor) / (most - floor), 0, 1).max())
    return min(1.0, total / float(weights.sum()))


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
ROUTED = pa.schema([("block", pa.int64()), ("tail", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())])


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _router(bounds: np.ndarray, heads: dict):
    """Sends each row to its block, and a block's first rows also to the end of the block before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            block = block_of(bounds, ids)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.zeros(len(ids), np.int32)), ids, batch.column(1)], schema=ROUTED)
            hit = [(heads[x], i) for i, x in enumerate(ids.to_pylist()) if x in heads]
            if hit:
                take = pa.array([i for _, i in hit])
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in hit], pa.int64()), pa.array(np.ones(len(hit), np.int32)), ids.take(take), batch.column(1).take(take)], schema=ROUTED)

    return run


def block_of(bounds: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Blocks number descending ids from 0; nulls are after the last."""
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    block = len(bounds) - np.searchsorted(bounds, values, side="right")
    return np.where(np.asarray(ids.is_null()), len(bounds) + 1, block).astype(np.int64)


def _paired(limit: int):
    """Rows in order, each with the one after it, to fingerprints."""

    def batch_out(chain: list[tuple], known: tuple | None) -> tuple[pa.RecordBatch, tuple]:
        """`chain`: (doc_id, text) in order; the last is only the next of the one before it. `known`: the first's digest."""
        raw = [t.encode() for _, t in chain]
        digests = [known, *digest(raw[1:])] if known else digest(raw)
        edits = [edited(t, u) for (_, t), (_, u) in zip(chain, chain[1:])]
        coded = [e.encode() for e in edits]
        changed = digest(coded)
        columns = [
            [d for d, _ in chain[:-1]],
            [len(t) for _, t in chain[:-1]],
            [hashlib.sha256(e).hexdigest() for e in coded],
            [to_string(d) for d in digests[:-1]],
            [to_string(d) for d in changed],
            [likeness(d, e) for d, e in zip(digests, changed)],
            [likeness(d, e) for d, e in zip(digests, digests[1:])],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, OUT.types)], schema=OUT), digests[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, size, known, block, closed = [], 0, None, None, False
        for batch in batches:
            for b, tail, doc, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), range(len(batch))):
                if b != block:
                    chain, size, known, block, closed = [], 0, None, b, False
                if closed:  # another of several equal first rows of the next block
                    continue
                text = batch.column(3)[at].as_py() or ""
                chain.append((doc, text))
                size += len(text)
                closed = bool(tail)
                if len(chain) > 1 and (closed or size >= limit):
                    out, last = batch_out(chain, known)
                    yield out
                    chain, size, known = ([], 0, None) if closed else ([chain[-1]], len(text), last)

    return run


def fingerprint_edits(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, which takes its last third from the next document.

    The next document is the one of the next smaller id, after the smallest the largest. Documents are dealt by blocks of
    neighbouring ids, cut at quantiles of the id column; the first row of each block also goes to the end of the block
    before it, so the texts travel once and no task needs more than one block's rows, which it streams. Blocks are as many as the texts'
    bytes ask for, `BLOCK_BYTES` each, and a task has about `TASK_BYTES` of them. The driver holds two numbers a block, 20,000 blocks at most
    by default.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(parallelism(spark), -(-size // TASK_BYTES))
    blocks = blocks or min(max(16 * tasks, -(-size // BLOCK_BYTES)), 20_000)
    cuts = [i / blocks for i in range(1, blocks)]
    found = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, cuts)), F.lit(10 * blocks)).alias("q")).first()["q"] if cuts else []
    bounds = np.unique(np.array(found or [], np.int64))
    # each block's largest id: one row a block
    place = F.lit(0) if not len(bounds) else None
    firsts = _block_heads(rows, bounds) if place is None else {0: rows.agg(F.max("doc_id")).first()[0]}
    order = sorted(firsts)
    heads: dict = {}
    for b, after in zip(order, [*order[1:], *order[:1]]):
        heads[firsts[after]] = b
    routed = rows.mapInArrow(released(_router(bounds, heads)), "block long, tail int, doc_id long, text string")
    dealt = routed.repartition(tasks, "block").sortWithinPartitions(
        "block", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text"
    )
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(released(_paired(2 << 20)), kinds)


def _block_heads(rows: DataFrame, bounds: np.ndarray) -> dict[int, int | None]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            ids = batch.column(0)
            blocks = block_of(bounds, ids)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((values, blocks))
            last = np.flatnonzero(np.r_[blocks[order][1:] != blocks[order][:-1], True]) if len(order) else []
            for i in order[last] if len(order) else []:
                b, v = int(blocks[i]), int(values[i]) if ids[int(i)].is_valid else None
                if b not in best or (v is not None and v > best[b]):
                    best[b] = v
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(best), pa.int64()), "head": pa.array(list(best.values()), pa.int64())})

    found = rows.select("doc_id").mapInArrow(released(run), "block long, head long").groupBy("block").agg(F.max("head").alias("head")).collect()
    return {x["block"]: x["head"] for x in found}


def op4_improbable_features(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def edited_texts(spark, sf_dir: str) -> DataFrame:
    """What of `op4_improbable_features` SQL can tell: which text each document was compared with."""
    return op4_improbable_features(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS u FROM d WINDOW w AS (ORDER BY doc_id DESC))
SELECT doc_id, n::BIGINT AS n_chars, sha256(left(t, n - n // 3) || left(u, n // 3)) AS edited_sha256 FROM e
"""

"""SimHash near-duplicate detection by bit-sliced comparison.

A document's fingerprint has a bit set where most of its shingles' hashes have. Equal fingerprints are merged first.
Distinct ones meet in buckets: of `radius + 3` blocks of bits, two fingerprints at most `radius` bits apart agree on three, so one
bucket for every three blocks loses no link and has long keys. For a wide radius, where blocks would be too short to part anything,
buckets are keyed by seeded samples of `key_bits` bits instead, as many as find a pair at the wanted similarity with the wanted chance.

A bucket is compared as vertical bit planes: 64 fingerprints to a word of each plane, carry-save counters (ones, twos,
fours, ...) that a few logic operations update for 64 distances at once, and a block of lanes is abandoned once all its
counters have passed the radius. Small buckets are laid side by side in one set of planes, and every lane meets the lane one, two, ...
places on. In large ones the links are walked breadth first: matched lanes leave the planes. Either way a bucket gives one row for each
linked fingerprint, never its pairs. A bucket above `cell` fingerprints is split by a hash into parts, and every two parts
meet in a task of their own, so no task holds more than two parts and no pair is missed.

With a wanted similarity, these groups only tell which texts to compare: every link inside one is then decided by the exact Jaccard
similarity of the shingle sets, each distinct set once, and the components are taken of those links alone.

Defined results for odd input: null, empty and wordless texts have the fingerprint zero and link like any other; fewer
words than a shingle are one shingle; ids may repeat (their rows get the same answer for the same text) and
null ids are ignored when the smallest id is sought; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, bounded, discard, materialise, released, ship, spare, texts
from .components import components

#: Largest bucket that one task compares at once.
CELL = 4096
#: Largest cell of shingle sets that one task compares, in sets and in shingles.
SET_CELL, SET_SHINGLES = 1024, 4 << 20
#: The words of plane blocks that are abandoned together.
BLOCK_WORDS = 8
#: Buckets up to so many fingerprints share planes, of so many lanes.
SMALL, LANES = 128, 1 << 14
#: The walks that a larger bucket begins with.
WALKS = 8
_ONES = np.uint64(2**64 - 1)
_CHUNK = 1 << 15


def _mix(h: np.ndarray, turn: int) -> np.ndarray:
    """Further 64-bit hashes from one."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * (turn + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(data: bytes, size: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = data.translate(ASCII_LOWER).split()
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([xxh64_intdigest(text[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """The fingerprint as a big-endian number."""
    n = len(hashes)
    if not n:
        return bytes(bits // 8)
    out = []
    for word in range(bits // 64):
        count = np.zeros(64, np.int64)
        for lo in range(0, n, _CHUNK):
            h = hashes[lo : lo + _CHUNK]
            h = _mix(h, word) if word else h
            count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits((2 * count > n).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)[::-1]


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64, seed: int = 42, sets: bool = False) -> DataFrame:
    """`(doc_id, mark, fp)` for every row; the mark is a hash of the text.

    With `sets` also `node`, the fingerprint with a hash of the set of shingles, and `size`, the number in the set.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_digest

        for batch in batches:
            for part in bounded(batch.column(2)):
                hashes = [shingle_hashes(d, shingle, seed) for d in texts(batch.column(2)[part])]
                found = [fingerprint(h, bits) for h in hashes]
                columns = [batch.column(0)[part], batch.column(1)[part], pa.array(found, pa.binary())]
                if sets:
                    distinct = [np.unique(h) for h in hashes]
                    columns += [pa.array([f + xxh64_digest(x.tobytes()) for f, x in zip(found, distinct)], pa.binary()), pa.array(map(len, distinct), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "fp", "node", "size"][: len(columns)])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_mark(text).alias("mark"), F.col(text).alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {kind}, mark long, fp binary" + (", node binary, size long" if sets else ""))


def text_mark(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def passed(difference: Callable[[int], np.ndarray], planes: int, radius: int, over: np.ndarray) -> np.ndarray:
    """The lanes whose distance passes the radius, beside those already `over`; abandoned once all lanes are.

    `difference(j)` is plane j of the differing bits. The counters start so that they overflow past the radius.
    """
    size = (radius + 1).bit_length()
    start = (1 << size) - 1 - radius
    counter = [np.full(over.shape, _ONES if start >> k & 1 else np.uint64(0)) for k in range(size)]
    for i in range(0, planes, 3):
        x = [difference(j) for j in range(i, min(i + 3, planes))]
        if len(x) == 3:  # a carry-save adder turns three planes into a one and a two
            ab = x[0] ^ x[1]
            adds = [ab ^ x[2], (x[0] & x[1]) | (ab & x[2])]
        else:
            adds = [x[0] ^ x[1], x[0] & x[1]] if len(x) == 2 else x
        for level, add in enumerate(adds):
            for k in range(level, size):
                add, counter[k] = counter[k] & add, counter[k] ^ add
            over |= add
        if i >= radius and i % 6 == 0 and (over == _ONES).all():
            break
    return over


class Planes:
    """Fingerprints as bit planes, `(bits, words)` of 64 lanes a word."""

    def __init__(self, fps: np.ndarray):
        n, width = fps.shape
        self.n = n
        self.words = -(-n // 64)
        padded = np.zeros((self.words * 64, width), np.uint8)
        padded[:n] = fps
        lanes = np.unpackbits(padded, axis=1, bitorder="little")
        self.bits = lanes[:n]
        self.planes = np.ascontiguousarray(np.packbits(lanes.T, axis=1, bitorder="little")).view(np.uint64).reshape(width * 8, self.words)

    def flips(self, queries: np.ndarray) -> np.ndarray:
        """The queries' bits as whole words, `(bits, queries, 1)`."""
        return np.where(self.bits[queries].T != 0, _ONES, np.uint64(0))[:, :, None]

    def within(self, queries: np.ndarray, radius: int, live: np.ndarray) -> np.ndarray:
        """Of the live lanes, those within the radius of any of the queries (lane numbers), as words."""
        found = np.zeros(self.words, np.uint64)
        flips = self.flips(queries)
        for lo in range(0, self.words, BLOCK_WORDS):
            block = live[lo : lo + BLOCK_WORDS]
            if block.any():
                planes = self.planes[:, lo : lo + BLOCK_WORDS]
                over = np.broadcast_to(~block, (len(queries), len(block))).copy()
                over = passed(lambda j: planes[j] ^ flips[j], len(planes), radius, over)
                found[lo : lo + BLOCK_WORDS] = np.bitwise_or.reduce(~over, axis=0)
        return found & live

    def accompanied(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Whether each query has another lane within the radius."""
        hit = np.zeros(len(queries), np.bool_)
        full = packed(np.arange(self.words * 64) < self.n)
        flips = self.flips(queries)
        for lo in range(0, self.words, BLOCK_WORDS):
            planes = self.planes[:, lo : lo + BLOCK_WORDS]
            over = np.broadcast_to(~full[lo : lo + BLOCK_WORDS], (len(queries), planes.shape[1])).copy()
            own = queries - lo * 64
            inside = np.flatnonzero((own >= 0) & (own < planes.shape[1] * 64))
            over[inside, own[inside] >> 6] |= np.uint64(1) << (own[inside] & 63).astype(np.uint64)
            hit |= (passed(lambda j: planes[j] ^ flips[j], len(planes), radius, over) != _ONES).any(axis=1)
        return hit


def packed(lanes: np.ndarray) -> np.ndarray:
    """Flags of a multiple of 64 lanes as words."""
    return np.packbits(lanes, bitorder="little").view(np.uint64)


def clusters(fps: np.ndarray, radius: int, walks: np.ndarray | None = None) -> np.ndarray:
    """Each fingerprint's cluster: the number of its first member in the walk. With `walks`, only from these; -1 for the rest."""
    planes = Planes(fps)
    n = len(fps)
    live = packed(np.arange(planes.words * 64) < n)
    root = np.full(n, -1, np.int64)
    for first in range(n) if walks is None else walks.tolist():
        if root[first] >= 0:
            continue
        root[first] = first
        live[first >> 6] &= ~(np.uint64(1) << np.uint64(first & 63))
        frontier = np.array([first])
        while len(frontier):
            found = []
            for lo in range(0, len(frontier), 32):
                near = planes.within(frontier[lo : lo + 32], radius, live)
                live &= ~near
                found.append(np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")))
            frontier = np.concatenate(found)
            root[frontier] = first
    return root


def large_first(fps: np.ndarray, radius: int) -> np.ndarray:
    """`clusters`, in an order that suits large buckets: some walks, which clear a bucket of near copies; then one pass for all lanes
    left at once that finds those without any neighbour; then walks for what is left."""
    root = clusters(fps, radius, np.unique(np.linspace(0, len(fps) - 1, WALKS).astype(np.int64)))
    rest = np.flatnonzero(root < 0)
    if len(rest):
        planes = Planes(fps[rest])
        beside = rest[np.concatenate([planes.accompanied(np.arange(lo, min(len(rest), lo + 256)), radius) for lo in range(0, len(rest), 256)])]
        root[rest] = rest
        if len(beside):
            root[beside] = beside[clusters(fps[beside], radius)]
    return root


def side_by_side(fps: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """`clusters` of several buckets at once: `sizes` of consecutive buckets, the largest first; no link leaves a bucket."""
    n = len(fps)
    x = Planes(fps)
    lanes = x.words * 64
    left = np.zeros(lanes, np.int64)  # the lanes of its bucket after each
    left[:n] = np.repeat(np.cumsum(sizes), sizes) - np.arange(n) - 1
    ones, others = [], []
    for s in range(1, int(sizes[0])):
        words = -(-int(sizes[sizes > s].sum()) // 64)
        whole, bit = divmod(s, 64)
        at = x.planes[:, whole : whole + words + 1]
        at = np.pad(at, ((0, 0), (0, words + 1 - at.shape[1])))
        moved = at[:, :words] if not bit else (at[:, :words] >> np.uint64(bit)) | (at[:, 1:] << np.uint64(64 - bit))
        over = passed(lambda j: x.planes[j, :words] ^ moved[j], len(moved), radius, ~packed(left[: words * 64] >= s))
        near = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little"))
        ones.append(near)
        others.append(near + s)
    root = np.arange(n)
    if ones and len(a := np.concatenate(ones)):
        b = np.concatenate(others)
        while True:
            least = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return root


def block_masks(bits: int, radius: int) -> list[list[int]]:
    """The bit positions of every three of `radius + 3` blocks."""
    cuts = [round(i * bits / (radius + 3)) for i in range(radius + 4)]
    return [[p for a, b in three for p in range(a, b)] for three in combinations(list(zip(cuts, cuts[1:])), 3)]


def bit_rate(similarity: float) -> float:
    """The chance that a fingerprint bit differs between sets of a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampled_masks(bits: int, rate: float, key_bits: int, recall: float, seed: int) -> list[list[int]]:
    """Bit samples, as many that a pair of which each bit differs with the chance `rate` agrees on one with the chance `recall`."""
    chance = np.array([math.comb(bits, d) * rate**d * (1 - rate) ** (bits - d) for d in range(bits + 1)])
    meets = np.array([math.comb(bits - d, key_bits) / math.comb(bits, key_bits) for d in range(bits + 1)])
    tables = 1
    while (chance * (1 - meets) ** tables).sum() > 1 - recall:
        tables += 1
    rng, out, pool = np.random.default_rng(seed), [], []
    for _ in range(tables):
        if len(pool) < key_bits:
            pool = rng.permutation(bits).tolist()
        out.append(sorted(pool[:key_bits]))
        pool = pool[key_bits:]
    return out


def _keys(masks: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            n = len(column)
            if not n:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1), axis=1, bitorder="little")
            for t, mask in enumerate(masks):
                weights = np.uint64(1) << np.arange(len(mask), dtype=np.uint64)
                key = (bits[:, mask].astype(np.uint64) * weights).sum(1, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(key), column], names=["t", "k", "fp"])

    return run


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_pylist()
            starts = np.concatenate([[0], np.cumsum(sizes)])
            fps = np.frombuffer(b"".join(flat), np.uint8).reshape(len(flat), -1)
            root = np.arange(len(flat))
            small = np.flatnonzero(sizes <= SMALL)
            small = small[np.argsort(-sizes[small], kind="stable")]
            for chosen in np.split(small, np.flatnonzero(np.diff(np.cumsum(sizes[small]) // LANES)) + 1) if len(small) else []:
                at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in chosen])
                root[at] = at[side_by_side(fps[at], sizes[chosen], radius)]
            for i in np.flatnonzero(sizes > SMALL):
                root[starts[i] : starts[i + 1]] = starts[i] + large_first(fps[starts[i] : starts[i + 1]], radius)
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array([flat[i] for i in moved], pa.binary()), pa.array([flat[root[i]] for i in moved], pa.binary())], names=["a", "b"])

    return run


def links(distinct: DataFrame, masks: list[list[int]], radius: int, cell: int = CELL) -> DataFrame:
    """Edges `(a, b)` that join all distinct fingerprints `fp` linked inside some bucket."""
    keyed = distinct.select("fp").mapInArrow(released(_keys(masks)), "t int, k long, fp binary")
    # a bucket of more than a cell is parted, and the rows of a part go to its meetings with every part
    large = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    large = materialise(large.select("t", "k", F.ceil(F.col("n") * 2 / cell).cast("int").alias("parts")), "simhash-large")
    met = keyed.join(large, ["t", "k"], "left") if not large.isEmpty() else keyed.withColumn("parts", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    pairs = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(meets)
    cells = met.withColumn("own", own).select("t", "k", "fp", F.explode(pairs).alias("c"))
    grouped = cells.groupBy("t", "k", "c").agg(F.sort_array(F.collect_list("fp")).alias("members")).where(F.size("members") > 1)
    return grouped.select("members").mapInArrow(released(_linked(radius)), "a binary, b binary").distinct()


def set_clusters(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Each set's cluster under links of the Jaccard similarity or more: the number of its first member in the walk."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    count = np.bincount(codes)
    bounds = np.cumsum(sizes)[:-1]
    own = np.split(codes, bounds)
    owner = np.repeat(np.arange(n), sizes)
    shared = count[codes] > 1  # a shingle of one set alone is in no intersection
    codes, owner = codes[shared], owner[shared]
    flags = np.zeros(len(count), np.bool_)
    live = np.ones(n, np.bool_)
    root = np.arange(n)
    for first in range(n):
        if not live[first]:
            continue
        live[first] = False
        frontier = [first]
        while frontier and len(codes):
            q = frontier.pop()
            flags[own[q]] = True
            both = np.bincount(owner[flags[codes]], minlength=n)
            flags[own[q]] = False
            found = np.flatnonzero(live & (both > 0) & (both / np.maximum(1, sizes + sizes[q] - both) >= similarity))
            if len(found):
                root[found] = first
                live[found] = False
                frontier += found.tolist()
                keep = live[owner]
                codes, owner = codes[keep], owner[keep]
    return root


def _verified(similarity: float, shingle: int, seed: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node").combine_chunks()
        nodes = rows.column("node").to_pylist()
        column = rows.column("text").chunk(0) if len(rows) else pa.array([], pa.string())
        sets = [np.unique(shingle_hashes(d, shingle, seed)) for part in bounded(column) for d in texts(column[part])]
        root = set_clusters(sets, similarity)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array([nodes[i] for i in moved], pa.binary()), "b": pa.array([nodes[root[i]] for i in moved], pa.binary())})

    return run


def verified_links(docs: DataFrame, fps: DataFrame, loose: DataFrame, *, text: str, shingle: int, seed: int, similarity: float, cell: int) -> DataFrame:
    """Edges `(a, b)` of nodes that join all whose sets are so similar inside a loose group `(node, root)` of fingerprints.

    Texts travel, not their sets: these take more bytes and hardly compress. One text a mark is left by each task that reads them.
    """
    nodes = fps.groupBy("node").agg(F.first("fp").alias("fp"), F.min("mark").alias("mark"), F.min("size").alias("size"))
    rooted = nodes.join(loose.withColumnsRenamed({"node": "fp"}), "fp", "left").select("node", "mark", "size", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-rooted")
    sizes = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
    # a group of more than a cell is parted, and the rows of a part go to its meetings with every part
    few = (F.col("n") <= cell) & (F.col("total") <= SET_SHINGLES)
    parts = F.when(few, 1).otherwise(F.greatest(F.ceil(F.col("n") * 2 / cell), F.ceil(F.col("total") * 2 / SET_SHINGLES))).cast("int")
    met = rooted.join(materialise(sizes.select("root", parts.alias("parts")), "simhash-sizes"), "root")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    cells = met.withColumn("own", own).select("root", "node", "mark", meets.alias("meets"))
    bodies = docs.select(text_mark(text).alias("mark"), F.col(text).alias("text")).groupBy("mark").agg(F.first("text").alias("text"))
    held = bodies.join(materialise(cells, "simhash-cells"), "mark").select("root", "node", "text", F.explode("meets").alias("c"))
    return held.select("root", F.col("c.i").alias("i"), F.col("c.j").alias("j"), "node", "text").groupBy("root", "i", "j").applyInArrow(_verified(similarity, shingle, seed), "a binary, b binary").distinct()


def near_groups(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 3,
    bits: int = 64,
    radius: int = 2,
    seed: int = 42,
    similarity: float | None = None,
    recall: float = 0.98,
    key_bits: int = 14,
    cell: int = CELL,
) -> DataFrame:
    """`(doc_id, mark, fp, root, component_id)`: each row's text mark and fingerprint, its group, and the smallest id in it.

    With `radius` alone the result is exact. With `similarity` (a Jaccard similarity of shingle sets) rows are linked by that similarity
    itself. Which are compared is found at a radius of the number of bits at which texts so similar differ, plus two standard
    deviations, in buckets sampled for `recall` at that similarity (more so above it); take 256 bits or more then. `key_bits` and so the
    samples don't depend on the table: a bucket has about one distinct fingerprint in 2^`key_bits`, so take more bits for more than 10^8
    documents. The recall stays, the number of samples grows.
    """
    fps = materialise(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, bits=bits, seed=seed, sets=similarity is not None), "simhash")
    firsts = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    node = "fp"
    if similarity is None:
        roots = components(links(firsts, block_masks(bits, radius), radius, cell))
    else:
        rate = bit_rate(similarity)
        radius = round(bits * rate + 2 * math.sqrt(bits * rate * (1 - rate)))
        masks = sampled_masks(bits, rate, key_bits, recall, seed)
        loose = materialise(components(links(firsts, masks, radius, cell)), "simhash-loose")
        roots = components(verified_links(docs, fps, loose, text=text, shingle=shingle, seed=seed, similarity=similarity, cell=min(cell, SET_CELL)))
        discard(loose)
        node, firsts = "node", materialise(fps.groupBy("node").agg(F.min("doc_id").alias("first_id")), "simhash-firsts")
    linked = firsts.join(roots.withColumnsRenamed({"node": node}), node)
    reach = linked.groupBy("root").agg(F.min("first_id").alias("reach_id"))
    answers = linked.join(reach, "root").select(node, "root", "reach_id")
    every = firsts.join(answers, node, "left").select(node, F.coalesce("root", node).alias("root"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("reach_id")).alias("component_id"))
    # both sides are tables, so Spark may split a fingerprint that many copies share
    return fps.join(materialise(every, "simhash-groups"), node).select("doc_id", "mark", "fp", "root", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each group with the smallest id (nulls last), then the smallest mark of its text; of equal rows one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("k")
    kept = groups.groupBy("root").agg(first).select(F.col("k.doc_id").alias("kept_id"), F.col("k.mark").alias("kept_mark"))
    mark = spare("own_mark", docs.columns)
    marked = docs.withColumn(mark, text_mark(text))
    rows = marked.join(kept, marked[doc_id].eqNullSafe(kept["kept_id"]) & (marked[mark] == kept["kept_mark"]), "left_semi")
    return rows.dropDuplicates([doc_id, mark]).drop(mark)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")

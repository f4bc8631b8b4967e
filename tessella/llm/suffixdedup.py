"""Exact-substring deduplication with suffix arrays built by induced sorting.

Every byte that lies in a `length`-byte string which starts at two places or more of the whole corpus is removed.

1. Anchors. Each text's `GRAM`-byte windows are hashed and the least hash of every run of neighbouring windows inside
   `length` bytes is an anchor, so equal strings of `length` bytes hold the same anchor at the same place. An anchor's snippet
   is all the bytes that such strings can reach from it. Only anchors that occur twice or more go on.
2. Occurrences of an anchor with equal snippets are repeated as a whole. What is left are anchors with several distinct
   snippets; one of each is kept, whatever the number of copies.
3. Shards. Each anchor goes with the first place that has it, in blocks of `BLOCK` bytes, so that a text's neighbouring anchors
   stay together and overlapping snippets are joined; blocks are dealt to shards by hash. A shard joins its pieces, builds their
   suffix array by induced sorting and the permuted longest common prefixes, and marks each suffix that shares `length` bytes with
   a neighbour from another place. An anchor with more than `hot` distinct snippets is first parted into cells of
   neighbouring windows: windows of a cell share a core, so only snippets with equal cores meet, and equal spans settle a cell at
   once. What is left of a cell goes to a shard, or, above `hot_cell`, is parted again, down to single windows if need be.
4. The marked places of each document are joined with the text once more, merged and cut out.

Texts are shuffled by document; nothing is collected, and each table the steps share is written to the shared folder.

Defined results for odd input: a null text is empty; texts shorter than `length` keep all; equal rows count as several
places, also when their ids are equal; ids may be null, which is an id of its own; an empty table gives no rows; other columns pass
through `clean_documents`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, materialise, release, released, ship, spare, texts
from .suffixarray import permuted_lcp, suffix_array

GRAM = 96
HOT = 300
HOT_CELL = 800
BLOCK = 2048
BLOCK_PIECES = 1000
CELLS = 4
#: Tables of keys, 8 to 60 bytes a row, are broadcast up to so many rows.
BROADCAST_KEYS = 100_000
SHARD_BYTES = 600_000
SHARD_TASKS = 20_000
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to a piece."""
    if not _powers:
        for b in (_BASE, _INVERSE):
            x = np.ones(_PIECE + 1, np.uint64)
            x[1:] = np.uint64(b)
            _powers.append(np.cumprod(x, dtype=np.uint64))
    return _powers


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each window of `gram` bytes of at most a piece of text."""
    up, down = _tables()
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:n], out=total[1:])
    h = (total[gram:] - total[:-gram]) * up[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """The places of the leftmost least of each `width` neighbours, each place once."""
    n = len(h) - width + 1
    step, low, at = 1, h, np.arange(len(h))
    while step * 2 <= width:
        left = low[:-step] <= low[step:]
        at = np.where(left, at[:-step], at[step:])
        low = np.where(left, low[:-step], low[step:])
        step *= 2
    rest = width - step
    left = low[:n] <= low[rest : rest + n]
    places = np.where(left, at[:n], at[rest : rest + n])
    return places[np.concatenate([[True], places[1:] != places[:-1]])]


def anchors(data: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's anchors."""
    n, width = len(data), length - gram + 1
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    hashes, places = [], []
    for lo in range(0, n - length + 1, _PIECE - length):
        piece = raw[lo : lo + _PIECE]
        if len(piece) < length:
            break
        h = gram_hashes(piece, gram)
        at = _leftmost_least(h, width)
        hashes.append(h[at])
        places.append(at + lo)
    h, p = np.concatenate(hashes), np.concatenate(places)
    p, first = np.unique(p, return_index=True)
    return h[first], p


def reach(place: int, n: int, length: int, gram: int) -> tuple[int, int]:
    return max(0, place - (length - gram)), min(n, place + length)


def _anchor_rows(length: int, gram: int):
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch.column(2)):
                h_, sh_, doc_, t_, pos_ = [], [], [], [], []
                ids, marks = batch.column(0)[part].to_pylist(), batch.column(1)[part].to_pylist()
                for doc, t, data in zip(ids, marks, texts(batch.column(2)[part])):
                    h, p = anchors(data, length, gram)
                    if not len(h):
                        continue
                    n = len(data)
                    h_.append(h)
                    pos_.append(p)
                    for x in p.tolist():
                        a, b = reach(x, n, length, gram)
                        sh_.append(xxh3_64_intdigest(data[a:b], x - a))
                    doc_ += [doc] * len(p)
                    t_ += [t] * len(p)
                if h_:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(h_).view(np.int64)), pa.array(np.array(sh_, np.uint64).view(np.int64)), pa.array(doc_, pa.int64()), pa.array(t_, pa.int64()), pa.array(np.concatenate(pos_))],
                        names=["h", "sh", "doc", "t", "pos"],
                    )

    return run


PIECE_SCHEMA = "g long, h long, doc long, t long, a long, pos long, piece binary"


def _piece_rows(length: int, gram: int):
    """Of each text, what its anchors reach: joined by group `g`, or one piece an anchor where there is no group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            for part in bounded(batch.column(2), 2 << 20):
                out: list[tuple] = []
                for i, data in zip(range(part.start, part.stop), texts(batch.column(2)[part])):
                    groups: dict[int, list[tuple[int, int]]] = {}
                    for x in found[i].as_py():
                        a, b = reach(x["pos"], len(data), length, gram)
                        if x["g"] is None:
                            out.append((None, x["h"], ids[i], marks[i], a, x["pos"], data[a:b]))
                        else:
                            groups.setdefault(x["g"], []).append((a, b))
                    out += [(g, None, ids[i], marks[i], a, None, data[a:b]) for g, spans in groups.items() for a, b in merged(spans)]
                    if len(out) >= 2048:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["g", "h", "doc", "t", "a", "pos", "piece"])

    return run


def cells(pos: int, a: int, end: int, length: int, low: int, high: int, count: int = CELLS) -> list[tuple[int, int, int, int, int, int]]:
    """The windows of a piece [a, end) that start `low` to `high` bytes before the anchor, in up to `count` cells.

    For each cell with a window: its first and last such distance, the core that all its windows hold, and the span of those that
    the piece has.
    """
    n = high - low + 1
    edges = sorted({low + round(i * n / count) for i in range(count + 1)})
    out = []
    for r0, r1 in zip(edges, (e - 1 for e in edges[1:])):
        if max(r0, pos + length - end) <= min(r1, pos - a):
            out.append((r0, r1, pos - r0, pos + length - r1, max(a, pos - r1), min(end, pos + length - r0)))
    return out


CELL_SCHEMA = "h long, r0 int, r1 int, core binary, span binary, doc long, t long, pos long, s long, e long"


def _cell_rows(length: int):
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, low, high, doc, t, pos, a, piece in zip(*(c.to_pylist() for c in batch.columns)):
                for r0, r1, x, y, s, e in cells(pos, a, a + len(piece), length, low, high):
                    out.append((h, r0, r1, xxh3_128_digest(piece[x - a : y - a]), xxh3_128_digest(piece[s - a : e - a], pos - s), doc, t, pos, s, e))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["h", "r0", "r1", "core", "span", "doc", "t", "pos", "s", "e"])

    return run


def _small(keys: DataFrame) -> DataFrame:
    """Marks a table of keys for broadcast if, counted, it has few rows; else it is shuffled."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _parted(pieces: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of parting hot groups into cells: `(whole spans, pieces for shards, pieces of cells that are still hot)`.

    `pieces`: `(h, low, high, doc, t, pos, a, piece)`; the last two have the same columns, with the cell as `h`.
    """
    by_cell = materialise(pieces.mapInArrow(released(_cell_rows(length)), CELL_SCHEMA), "cells")
    key = ["h", "r0", "r1", "core"]
    one = F.min(F.struct("doc", "t", "pos", "s", "e")).alias("one")
    kinds = materialise(by_cell.groupBy(*key, "span").agg(F.count(F.lit(1)).alias("n"), one), "cell-kinds")
    whole = by_cell.join(_small(kinds.where("n > 1").select(*key, "span")), [*key, "span"], "left_semi").select("doc", "t", F.col("s").alias("a"), F.col("e").alias("b"))
    mixed = kinds.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").drop("least")
    picks = kinds.join(materialise(mixed, "cell-mixed"), key).select(*key, "m", "one.*")
    at = pieces.withColumnsRenamed({"doc": "doc2", "t": "t2", "pos": "pos2", "h": "h2"})
    cut_out = F.substring("piece", (F.col("s") - F.col("a") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int"))
    held = picks.join(at, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("t") == F.col("t2")) & (F.col("pos") == F.col("pos2")) & (F.col("h") == F.col("h2")))
    held = held.select(F.xxhash64(*key).alias("h"), F.col("r0").alias("low"), F.col("r1").alias("high"), "m", "doc", "t", "pos", F.col("s").alias("a"), cut_out.alias("piece"))
    held = materialise(held, "cell-pieces")
    return whole, held.where(F.col("m") <= hot).drop("m"), held.where(F.col("m") > hot).drop("m")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_in(segments: list[tuple[tuple, int, bytes]], length: int) -> list[tuple[tuple, int, int]]:
    """`segments`: (document, place, bytes). The spans of their strings of `length` bytes that start at two places or more."""
    parts, owner, place = [], [], []
    for i, (_, a, data) in enumerate(segments):
        parts.append(np.frombuffer(data, np.uint8).astype(np.uint16) + np.uint16(2))
        parts.append(np.ones(1, np.uint16))  # no string goes past a segment's end
        owner.append(np.full(len(data) + 1, i, np.int32))
        left = np.arange(a, a + len(data) + 1)
        left[max(0, len(data) - length + 1) :] = -1  # too near the end
        place.append(left)
    s = np.concatenate([*parts, np.zeros(1, np.uint16)])
    owner_, place_ = np.concatenate([*owner, np.zeros(1, np.int32)]), np.concatenate([*place, [-1]])
    del parts, owner, place
    documents = {d: i for i, d in enumerate(dict.fromkeys(d for d, _, _ in segments))}
    number = np.array([documents[d] for d, _, _ in segments])
    sa = suffix_array(s)
    shared = permuted_lcp(s, sa)[sa] >= length
    # runs of suffixes that share `length` bytes; a string counts if its run has two different places
    run = np.cumsum(~shared)
    valid = place_[sa] >= 0
    sa, run = sa[valid], run[valid]
    if not len(sa):
        return []
    where = (number[owner_[sa]].astype(np.int64) << 40) | place_[sa]
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    twice = np.minimum.reduceat(where, first) != np.maximum.reduceat(where, first)
    hit = np.sort(sa[np.repeat(twice, np.diff(np.concatenate([first, [len(sa)]])))])
    if not len(hit):
        return []
    cut = np.flatnonzero(np.concatenate([[True], (hit[1:] > hit[:-1] + length) | (owner_[hit[1:]] != owner_[hit[:-1]])]))
    ends = np.concatenate([cut[1:], [len(hit)]]) - 1
    return [(segments[owner_[hit[i]]][0], int(place_[hit[i]]), int(place_[hit[j]]) + length) for i, j in zip(cut, ends)]


def _groups(rows: pd.DataFrame) -> Iterator[list[tuple[tuple, int, bytes]]]:
    """Each group's pieces, overlapping ones of a document joined."""
    rows = rows.sort_values(["g", "none", "doc", "t", "a"], kind="stable")
    out: list[tuple[tuple, int, bytes]] = []
    last = None
    for g, doc, none, t, a, data in zip(rows["g"].tolist(), rows["doc"].tolist(), rows["none"].tolist(), rows["t"].tolist(), rows["a"].tolist(), rows["piece"]):
        if g != last and out:
            yield out
            out = []
        last, key = g, (None if none else doc, t)
        if out and out[-1][0] == key and a <= out[-1][1] + len(out[-1][2]):
            _, start, held = out[-1]
            out[-1] = (key, start, held + data[max(0, start + len(held) - a) :])
        else:
            out.append((key, a, data))
    if out:
        yield out


def _shard(length: int, most: int):
    """Groups are whole by themselves: a suffix array is built for as many as have `most` bytes, or for one larger group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        spans, held, size = [], [], 0
        for segments in _groups(rows):
            n = sum(len(data) for _, _, data in segments)
            if held and size + n > most:
                spans += repeated_in(held, length)
                held, size = [], 0
            held += segments
            size += n
        spans += repeated_in(held, length)
        del held, rows
        release()
        return pd.DataFrame(
            {"doc": pd.array([k[0] for k, _, _ in spans], "Int64"), "t": np.array([k[1] for k, _, _ in spans], np.int64), "a": np.array([a for _, a, _ in spans], np.int64), "b": np.array([b for _, _, b in spans], np.int64)}
        )

    return run


def _text_mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_spans(docs: DataFrame, *, doc_id: str, text: str, length: int, gram: int = GRAM, hot: int = HOT, hot_cell: int = HOT_CELL, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """`(rows, spans)`: rows `(doc, t, body)` and, for documents that have any, `(doc, t, spans)` with unmerged spans (a, b)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), _text_mark(F.col(text)).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    found = rows.mapInArrow(released(_anchor_rows(length, gram)), "h long, sh long, doc long, t long, pos long")
    every = materialise(found, "anchors")
    often = materialise(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "anchors-often")
    again = materialise(every.join(_small(often), "h", "left_semi"), "anchors-again")
    discard(every, often)
    one = F.min(F.struct("doc", "t", "pos")).alias("one")
    kinds = materialise(again.groupBy("h", "sh").agg(F.count(F.lit(1)).alias("n"), one), "snippet-kinds")
    whole = again.join(_small(kinds.where("n > 1").select("h", "sh")), ["h", "sh"], "left_semi")
    whole = whole.select("doc", "t", (F.col("pos") - (length - gram)).alias("a"), (F.col("pos") + length).alias("b"))
    # several snippets, one of them without an equal: only there can a suffix array add anything
    mixed = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.min("one").alias("lead"))
    mixed = mixed.where("m > 1 and least = 1").select("h", "m", F.xxhash64("lead.doc", "lead.t", F.floor(F.col("lead.pos") / BLOCK)).alias("g"))
    # a block has at most BLOCK anchors, so this window is bounded; a block that would be too much goes anchor by anchor
    load = F.sum(F.when(F.col("m") <= hot, F.col("m"))).over(Window.partitionBy("g"))
    group = F.when(F.col("m") <= hot, F.when(load <= BLOCK_PIECES, F.col("g")).otherwise(F.xxhash64("h", "g")))
    mixed = materialise(mixed.select("h", group.alias("g")), "mixed")
    picks = kinds.join(mixed, "h").select("g", "h", "one.doc", "one.t", "one.pos")
    wanted = picks.groupBy("doc", "t").agg(F.collect_list(F.struct("g", "h", "pos")).alias("found"))
    joined = rows.join(wanted.withColumnsRenamed({"doc": "doc2", "t": "t2"}), F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("t") == F.col("t2")))
    pieces = materialise(joined.select("doc", "t", "body", "found").mapInArrow(released(_piece_rows(length, gram)), PIECE_SCHEMA), "pieces")

    dealt = pieces.where("g is not null").select("g", "doc", "t", "a", "piece")
    still = pieces.where("g is null").select("h", F.lit(0).alias("low"), F.lit(length - gram).alias("high"), "doc", "t", "pos", "a", "piece")
    while not still.isEmpty():  # each round quarters the cells; a cell of one window is settled by its digest
        more, ready, still = _parted(still, length, hot_cell)
        whole = whole.unionByName(more)
        dealt = dealt.unionByName(ready.select(F.col("h").alias("g"), "doc", "t", "a", "piece"))
    total = dealt.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    marked = (
        dealt.withColumns({"none": F.col("doc").isNull(), "doc": F.coalesce("doc", F.lit(0))})  # pandas has no null integers
        .withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(shards)))
        .repartition(min(shards, SHARD_TASKS), "shard")  # by number, as shards are small and slow: Spark is not to merge their tasks
        .groupBy("shard")
        .applyInPandas(_shard(length, shard_bytes), "doc long, t long, a long, b long")
    )
    spans = whole.unionByName(marked)
    return rows, spans.groupBy("doc", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def whole_words(data: bytes, a: int, b: int) -> int:
    """The words that lie in data[a:b] as a whole."""
    inside = data[a:b]
    n = len(inside.split())
    n -= n > 0 and a > 0 and not data[a - 1 : a].isspace() and not inside[:1].isspace()
    return n - (n > 0 and b < len(data) and not data[b : b + 1].isspace() and not inside[-1:].isspace())


def cut(data: bytes, spans: list[tuple[int, int]], min_words: int = 0) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left, and the maximal removed runs; runs of fewer whole words than `min_words` stay."""
    runs = merged([(max(0, a), min(len(data), b)) for a, b in spans])
    if min_words:
        runs = [(a, b) for a, b in runs if whole_words(data, a, b) >= min_words]
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), runs


def _joined(rows: DataFrame, spans: DataFrame, doc: str, t: str, name: str) -> DataFrame:
    """`rows` with their spans in column `name`."""
    named = spans.select(*[F.col(c).alias(spare(f"sd_{c}", rows.columns)) for c in ("doc", "t")], F.col("spans").alias(name))
    doc2, t2, _ = named.columns
    return rows.join(named, F.col(doc).eqNullSafe(F.col(doc2)) & (F.col(t) == F.col(t2)), "left").drop(doc2, t2)


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400, min_words: int = 0, **options) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans` for every row."""
    rows, spans = repeated_spans(docs, doc_id=doc_id, text=text, length=length, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(2)
            for part in bounded(batch.column(1)):
                out = []
                for i, data in zip(range(part.start, part.stop), texts(batch.column(1)[part])):
                    mine = found[i].as_py() or []
                    kept, runs = cut(data, [(x["a"], x["b"]) for x in mine], min_words)
                    out.append((ids[i], len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": b} for a, b in runs]))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    joined = _joined(rows, spans, "doc", "t", "spans").select("doc", "body", "spans")
    return joined.mapInArrow(released(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a: long, b: long>>")


def clean_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400, min_words: int = 0, **options) -> DataFrame:
    """`docs` with the repeated bytes cut out of their texts; characters of which a part is cut lose the rest too.

    With `min_words`, only runs of so many whole words or more are cut. Null and untouched texts stay as they are. Every row is kept.
    """
    _, spans = repeated_spans(docs, doc_id=doc_id, text=text, length=length, **options)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            found = batch.column(len(columns))
            if found.null_count < len(found):
                out = columns[at].to_pylist()
                for i, x in enumerate(found.to_pylist()):
                    if x and out[i] is not None:
                        kept, runs = cut(out[i].encode(), [(y["a"], y["b"]) for y in x], min_words)
                        out[i] = kept.decode("utf-8", "ignore") if runs else out[i]
                columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    own, mark, spans_at = (spare(c, docs.columns) for c in ("own_doc", "own_mark", "own_spans"))
    marked = docs.withColumns({own: F.col(doc_id).cast("long"), mark: _text_mark(F.col(text))})
    return _joined(marked, spans, own, mark, spans_at).select(*docs.columns, spans_at).mapInArrow(released(run), kinds)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, p, md5(array_slice(b, p + 1, p + 400)::BLOB) AS h FROM d, unnest(range(0, octet_length(b) - 399)) x(p) WHERE octet_length(b) >= 400),
hit AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
mark AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 400, true) AS fresh FROM hit),
runs AS (SELECT r, min(p) AS a, max(p) + 400 AS z FROM (SELECT r, p, sum(fresh::INT) OVER (PARTITION BY r ORDER BY p) AS g FROM mark) GROUP BY r, g),
edges AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS s, a AS e FROM runs
  UNION ALL SELECT d.r, coalesce(max(z), 0), any_value(octet_length(b)) FROM d LEFT JOIN runs USING (r) GROUP BY d.r),
kept AS (SELECT r, string_agg(hex(array_slice(b, s + 1, e)::BLOB), '' ORDER BY s) AS k FROM edges JOIN d USING (r) GROUP BY r),
sums AS (SELECT r, sum(z - a) AS gone, count(*) AS n FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
"""

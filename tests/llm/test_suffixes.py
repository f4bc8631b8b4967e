import hashlib

import numpy as np
import pytest
from text_maker import words
from hypothesis import given, settings
from hypothesis import strategies as st
from tessella.llm import suffixdedup as D
from tessella.llm import suffixarray
from tessella.llm.suffixarray import permuted_lcp, suffix_array


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=70), st.booleans())
def test_suffix_arrays(letters, by_entry):
    s = np.array([*letters, 0])
    limit, suffixarray.BY_BUCKET = suffixarray.BY_BUCKET, 0 if by_entry else 1024
    try:
        sa = suffix_array(s)
    finally:
        suffixarray.BY_BUCKET = limit
    t = s.tolist()
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    shared = permuted_lcp(s, sa)
    for a, b in zip(sa.tolist(), sa.tolist()[1:]):
        n = 0
        while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
            n += 1
        assert shared[b] == n


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = {}
    for _, b in texts:
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] = count.get(b[p : p + length], 0) + 1
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], cut.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~cut]) if len(b) else b""
        out.append((d, len(b), int(cut.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def repeated(spark):
    shared, other = words(60, 1), words(50, 2)
    rows = [(i, f"{words(30, 100 + i)} {shared} {words(20, 200 + i)}") for i in range(12)]
    rows += [(20 + i, f"{words(10, 300 + i)} {other}{shared}") for i in range(6)]
    near = words(200, 3).split()
    for i in range(10):
        w = list(near)
        w[17 * i] = f"edit{i}"
        rows.append((40 + i, " ".join(w)))
    rows += [(60, "ab" * 400), (61, "x" * 900), (62, ""), (63, None), (64, "short"), (40, rows[0][1]), (65, rows[3][1]), rows[4], (None, shared * 2), (66, "é" * 300)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("length, options", [(100, {}), (100, {"hot": 2, "hot_cell": 2}), (150, {"hot": 1, "hot_cell": 3, "shard_bytes": 2000}), (120, {"gram": 40})])
def test_against_brute_force(repeated, length, options):
    options = {"gram": 48} | options
    got = D.dedup(repeated, length=length, **options).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == brute([tuple(r) for r in repeated.collect()], length)


def test_on_documents(docs):
    got = D.dedup(docs).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 400)


def test_odd_rows(messy, empty):
    got = D.dedup(messy).drop("spans").collect()
    rows = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted((x[:3] for x in brute([(d, t if t is None or len(t) < 10**5 else t[:0] + t) for d, t in rows], 400)), key=str)
    clean = D.clean_documents(messy)
    assert clean.columns == messy.columns and clean.count() == messy.count()
    assert D.dedup(empty).count() == 0 and D.clean_documents(empty).count() == 0


def test_anchors_are_where_equal_strings_are():
    a, b = words(2000, 1).encode(), words(700, 2).encode()
    text = a[:5000] + b[:400] + a[5000:]
    other = b[:400] + a[:300]
    ha, pa_ = D.anchors(text, 400)
    hb, pb = D.anchors(other, 400)
    mine = {(int(h), int(p) - 5000) for h, p in zip(ha, pa_) if 5000 <= p <= 5400 - D.GRAM}
    assert mine & {(int(h), int(p)) for h, p in zip(hb, pb)}


def test_long_texts_are_read_in_pieces(monkeypatch):
    data = words(3000, 9).encode()
    whole = D.anchors(data, 100, 40)
    monkeypatch.setattr(D, "_PIECE", 2000)
    parts = D.anchors(data, 100, 40)
    assert set(zip(*map(list, parts))) == set(zip(*map(list, whole)))

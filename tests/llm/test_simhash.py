import re

import numpy as np
import pytest
from tessella.llm import simhash as S
from tessella.llm.components import components
from xxhash import xxh64_intdigest


def brute_fingerprint(text, size=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, fps, radius):
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


@pytest.mark.parametrize("kind", ["docs", "messy"])
def test_against_brute_force(request, kind):
    df = request.getfixturevalue(kind)
    got = S.near_groups(df).select("doc_id", "mark", "fp", "component_id").collect()
    rows = df.select("doc_id", "text", S.text_mark("text").alias("mark")).collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = brute_groups([r.doc_id for r in rows], fps, 2)
    expected = sorted(((r.doc_id, r.mark, f, w) for r, f, w in zip(rows, fps, want)), key=str)
    assert sorted(((r.doc_id, r.mark, int.from_bytes(r.fp, "big"), r.component_id) for r in got), key=str) == expected


def test_empty_table(empty):
    assert S.near_groups(empty).count() == 0
    assert S.keep_one(empty, S.near_groups(empty)).count() == 0


def test_keep_one_leaves_a_row_of_each_group(messy):
    groups = S.near_groups(messy)
    kept = S.keep_one(messy, groups)
    assert kept.columns == messy.columns
    assert kept.count() == groups.select("root").distinct().count()


@pytest.mark.parametrize("n, width, radius", [(1, 8, 2), (2, 8, 2), (700, 8, 2), (300, 32, 44), (301, 32, 50)])
def test_bit_slices(n, width, radius):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 256, (n, width), dtype=np.uint8)
    for i in range(n // 2):  # chains of near fingerprints
        x[i] = x[max(0, i - 1)]
        x[i, i % width] ^= 1
    root = S.large_first(x, radius)
    sizes = np.sort(np.random.default_rng(1).multinomial(n, [0.4, 0.3, 0.2, 0.1]))[::-1]
    sizes = sizes[sizes > 0]
    apart = S.side_by_side(x, sizes, radius)
    words = x.view(np.uint64)
    near = np.bitwise_count(words[:, None] ^ words[None]).sum(2) <= radius
    label = np.arange(n)
    for _ in range(n):
        new = np.where(near, label[None], n).min(1)
        if (new == label).all():
            break
        label = new
    names = {}
    assert [names.setdefault(r, i) for i, r in enumerate(root.tolist())] == label.tolist()
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    near &= bucket[:, None] == bucket[None]
    own = np.arange(n)
    for _ in range(n):
        new = np.where(near, own[None], n).min(1)
        if (new == own).all():
            break
        own = new
    assert (apart == own).all()


def test_hot_buckets_are_split_without_losing_a_link(spark):
    rows = [(i, f"w{i} a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(tuple, S.near_groups(df, cell=c).select("doc_id", "component_id").collect())) for c in (4096, 4))
    assert one == many


def test_wide_fingerprints_find_similar_texts(spark):
    from text_maker import words

    base = words(400, 5).split()
    rows = []
    for i in range(20):
        w = list(base)
        w[i * 15] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words(400, 50 + i)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(S.near_groups(df, shingle=5, bits=256, similarity=0.8).select("doc_id", "component_id").collect())
    assert all(got[i] == 0 for i in range(20)) and all(got[100 + i] == 100 + i for i in range(50))


@pytest.mark.parametrize("cell", [4096, 8])
def test_similar_texts_are_those_of_brute_force(spark, cell):
    from text_maker import words

    texts = []
    for i, share in enumerate(np.repeat(np.arange(0.005, 0.06, 0.0025), 6)):  # graded from 0.95 to below 0.6
        w = words(300, 1000 + i).split()
        at = np.random.default_rng(i).choice(300, max(1, round(300 * share)), replace=False)
        texts += [" ".join(w), " ".join("changed" + str(j) if j in at else x for j, x in enumerate(w))]
    texts += [texts[0], "", None, "one", "one"]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    root = list(range(len(texts)))
    likes = []
    for i in range(len(texts)):
        for j in range(i):
            like = len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) if sets[i] or sets[j] else 1
            likes += [like] if like > 0.5 else []
            if like >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    assert sum(0.6 < x < 0.8 for x in likes) > 20 < sum(0.8 <= x < 0.95 for x in likes)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(S.near_groups(df, shingle=5, bits=256, similarity=0.8, cell=cell).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == root


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 30)] + [(50, 51), (51, 52), (52, 50), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).distinct().collect())
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(5, 30)} == {5} and {got[i] for i in (50, 51, 52)} == {50}

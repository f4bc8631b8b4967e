"""The operators that run without Python: sharding, mixing, licence scans."""

import textwrap
import zlib

import pytest
from text_maker import words
from tessella.llm import kdshard, licenses, mixing


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["docs", "messy"])
def test_shards(request, kind):
    df = request.getfixturevalue(kind)
    out = kdshard.shard(df)
    assert not any(x in plan_of(out) for x in ("Python", "Pandas", "Arrow"))
    got = out.toPandas()
    rows = df.collect()
    assert len(got) == len(rows)
    sizes = sorted(len((r.text or "").encode()) + 1 for r in rows)
    assert sorted(got["size"]) == sizes
    assert sorted(got["text_crc32"]) == sorted(zlib.crc32((r.text or "").encode()) for r in rows)
    assert got["shard"].between(0, 15).all()
    for _, x in got.groupby("shard"):
        assert sorted(x["slot"]) == list(range(len(x)))
    if kind == "docs":
        by = got.groupby("shard")["size"].sum()
        assert by.max() - by.min() <= max(sizes) + 0.05 * by.mean()


def test_shards_by_target_bytes_and_groups(spark):
    rows = [(i, words(20, i % 40), "en", 100 + i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = kdshard.shard(df, target_bytes=8000, tolerance=0.2).toPandas()
    assert got.groupby("shard")["size"].sum().max() <= 8000 and got["shard"].nunique() > 4
    with pytest.raises(ValueError):
        kdshard.shard(df, n_shards=6)


@pytest.mark.parametrize("options", [{"n_shards": 16}, {"n_shards": 1, "target_bytes": 9000}])
def test_tree_is_that_of_brute_force(spark, options):
    rows = [(i, words(3 + i * i % 90, i % 150), "en" if i % 3 else "de", i * 7919 % 1000) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    meta, n_dims = kdshard.metadata(df, doc_id="doc_id", text="text", dimensions=("n_chars", "lang"))
    meta = spark.createDataFrame(meta.collect(), meta.schema)
    got = kdshard.grow(meta, n_dims, options["n_shards"], options.get("target_bytes"), 0.0).toPandas()
    points = [(tuple(r[f"kd_d{i}"] for i in range(n_dims)), r.kd_h, r.kd_r, r.kd_size, r.doc_id) for r in meta.collect()]
    whole = [max(1, max(p[0][i] for p in points) - min(p[0][i] for p in points)) for i in range(n_dims)]
    leaves = []

    def split(node, level):
        size = sum(p[3] for p in node)
        if len(node) < 2 or (size <= options["target_bytes"] if "target_bytes" in options else 2**level >= 16):
            leaves.append(frozenset(p[4] for p in node))
            return
        dim = max(range(n_dims), key=lambda i: ((max(p[0][i] for p in node) - min(p[0][i] for p in node)) / whole[i], -i))
        node = sorted(node, key=lambda p: (p[0][dim], p[1], p[2]))
        before = 0
        for i, p in enumerate(node):
            if before + p[3] >= size / 2:
                break
            before += p[3]
        i += not (size / 2 - before <= before + p[3] - size / 2 and before > 0)
        split(node[:i], level + 1)
        split(node[i:], level + 1)

    split(points, 0)
    assert {frozenset(x) for _, x in got.groupby("kd_node")["doc_id"]} == {x for x in leaves if x}
    order = dict(kdshard.numbered_leaves(spark.createDataFrame(got)).collect())
    by_shard = {order[n]: frozenset(x) for n, x in got.groupby("kd_node")["doc_id"]}
    assert [by_shard[i] for i in range(len(by_shard))] == [x for x in leaves if x]


def test_shards_of_nothing(empty):
    assert kdshard.shard(empty).count() == 0


def test_mixing_follows_weights(spark):
    rows = [(i, "t", "big" if i % 10 else "small") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights={"big": 1.0, "small": 1.0, "absent": 5.0 * 0}).groupBy("source").count().toPandas().set_index("source")["count"]
    assert abs(got["big"] - 3000) < 250 and abs(got["small"] - 3000) < 250
    large = mixing.mix(df.limit(50), weights={"small": 1.0}, budget=5000.0)
    assert 4000 < large.count() < 6000 and large.where("source <> 'small'").count() == 0
    assert not any(x in plan_of(large) for x in ("Python", "Pandas", "Arrow"))


def test_mixing_of_odd_rows(messy, empty):
    out = mixing.mix(messy, alpha=1.0)
    assert set(messy.columns) <= set(out.columns) and out.where("mix_copy >= mix_copies").count() == 0
    assert mixing.mix(empty).count() == 0
    first = [tuple(r) for r in mixing.mix(messy).select("doc_id", "mix_key").collect()]
    assert sorted(first, key=str) == sorted((tuple(r) for r in mixing.mix(messy).select("doc_id", "mix_key").collect()), key=str)


def brute_scan(text, threshold=0.8):
    units = (text or "").split("\n")
    units += [text] if len(units) > 1 else []
    names = licenses.template_rows()
    dice = lambda g, t: 2 * len(g & set(t)) / (len(g) + len(t))
    good, n, runs = [], 0, 0
    for u in units:
        g = set(licenses.bigram_set(u))
        here = [s for s in ((dice(g, t), -i, name) for i, (name, t) in enumerate(names) if g) if s[0] >= threshold]
        n, good = n + bool(here), good + here
    w = licenses.normal(text or "").split(" ")
    for i, ((name, t), of) in enumerate(zip(names, licenses.template_words())):
        at = {k - o for o in range(min(3, len(of) - 1)) for k in range(len(w) - 1) if w[k : k + 2] == of[o : o + 2] and k >= o}
        for a in at:
            d = dice(set(licenses.bigram_set(" ".join(w[a : a + len(of)]))), t)
            if d >= threshold:
                runs, good = runs + 1, [*good, (d, -i, name)]
    best = max([(0.0, 0, None), *good], key=lambda s: (s[0], s[1]))
    return best[2], round(best[0], 6), n, runs


def wrapped(text, width=60):
    return "\n    ".join(textwrap.wrap(text, width))


def test_markers_lose_no_match():
    for threshold in (0.5, 0.8, 0.95):
        signs = licenses.markers(licenses.TEMPLATES, threshold)
        for _, grams in licenses.template_rows():
            free = [g for g in grams if not any(m in w for m in signs for w in g.split(" "))]
            assert len(free) < len(grams) * threshold / (2 - threshold)  # a match has so many, so not of these alone


def test_licences_of_odd_rows(spark, messy, empty):
    apache = licenses.TEMPLATES["Apache-2.0"][1]
    rows = [(1, apache), (2, apache.upper().replace(" ", "\n\n ")), (3, "All rights reserved"), (4, "rights"), (5, words(40) + "\nreleased under the mit license!!"), (6, None), (7, " \n ")]
    rows += [(10 + i, t) for i, each in enumerate(licenses.TEMPLATES.values()) for t in (wrapped(each[-1]), f"{words(300, i)}\n# {wrapped(each[-1])}\n{words(200, i + 50)}")]
    rows += [(50, "Released under the MIT License by Jane Doe, who likes it."), (51, "under the mit license " * 400), (52, "mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licenses.scan(df).collect():
        assert (r.license, round(r.dice, 6), r.n_matches, r.n_runs) == brute_scan(r.text), r.doc_id
        if 10 <= r.doc_id < 50:
            assert r.license in licenses.TEMPLATES and r.dice == 1
    assert licenses.scan(messy).count() == messy.count() and licenses.scan(empty).count() == 0
    assert licenses.scan(messy).columns.count("license") == 1

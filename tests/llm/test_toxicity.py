import zlib

import numpy as np
import pytest
from text_maker import words
from tessella.llm import toxicity as T


def test_gradients():
    net = T.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    w = T.Words([b"ab cd efg hi ab", b"zz yy idiot"])
    win, _ = T.windows(w.docs, len(w.words))
    win, y, weight = win[:, :7], np.array([0.0, 1.0]), np.ones(2)

    def inputs():
        x = np.zeros((len(w.words) + 1, T.WORD_DIM + T.GRAM_DIM))
        x[:-1, : T.WORD_DIM] = net.p["word"][w.rows]
        x[:-1, T.WORD_DIM :] = np.maximum.reduceat(net.p["gram"][w.grams], w.first)
        return x

    _, g = net.gradients(w, inputs(), win, y, weight)
    for k, grad in g.items():
        flat, i = net.p[k].reshape(-1), int(np.abs(grad).argmax())
        old, e = flat[i], 1e-4
        flat[i] = old + e
        up = net.gradients(w, inputs(), win, y, weight)[0]
        flat[i] = old - e
        down = net.gradients(w, inputs(), win, y, weight)[0]
        flat[i] = old
        assert (up - down) / (2 * e) == pytest.approx(float(grad.reshape(-1)[i]), rel=0.02, abs=1e-4), k


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    data, labels = [], []
    for i in range(600):
        t = words(int(rng.integers(5, 600)), i).split()
        bad = i % 3 == 0
        if bad:
            t[int(rng.integers(len(t)))] = "vile" + "abcdefgh"[i % 8]
        data.append(" ".join(t).encode())
        labels.append(int(bad))
    return T.train(data, labels)


def test_finds_a_word_anywhere_in_long_texts(model):
    clean = [words(n, 1000 + n).encode() for n in (3, 50, 400, 3000)]
    bad = [b" ".join([*c.split()[:-1], b"vileb"]) for c in clean]
    s = model.scores(clean + bad)
    assert (s[:4] < T.THRESHOLD).all() and (s[4:] >= T.THRESHOLD).all()


def test_windows_cover_every_word():
    for n in (1, 31, 32, 33, 56, 57, 200):
        win, owner = T.windows([np.arange(n)], n)
        assert set(win.ravel()) - {n} == set(range(n)) and (owner == 0).all()


def test_odd_rows(spark, messy, empty, model):
    out = T.score(messy, model)
    assert set(messy.columns) <= set(out.columns) and out.count() == messy.count()
    got = out.select("text", "score", "predicted").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= T.THRESHOLD) for r in got)
    assert all(r.score == 0 for r in got if not (r.text or "").split())
    assert T.score(empty, model).count() == 0
    nothing = T.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert T.score(messy, nothing).where("score <> 0").count() == 0


def test_learns_only_from_the_rest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = T.op3_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all() and len(got) == docs.count()
    flipped = labels.withColumn("toxic", (labels.toxic + T.held_out(labels.doc_id).cast("int")) % 2)
    a, b = (T.fit(docs, x, T.FitLimits(rounds=1)).network.p["out"] for x in (labels, flipped))
    assert (a == b).all()


def test_held_out_documents_are_told(spark):
    """Labelled rows that no model has seen, of the largest table that a test can wait for."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = T.op3_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("toxic", "predicted").toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert len(bad) >= 100 and len(good) >= 500
    assert bad.predicted.mean() >= 0.8 and good.predicted.mean() <= 0.04  # 104 of 120 and 19 of 870 when this was written

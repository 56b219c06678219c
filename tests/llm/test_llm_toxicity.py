"""Toxicity: counts and risk over all unlabelled text against plain loops."""

import numpy as np

from larder.llm import toxicity as TX


def test_document_frequencies_count_every_text(spark):
    texts = ["bad word", "bad bad", None, "", "badly worded", "fine"] * 7
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)

    def counted(wanted):
        rows = df.mapInPandas(TX._document_frequencies(wanted), "feature string, n long").collect()
        out = {}
        for r in rows:
            out[r.feature] = out.get(r.feature, 0) + r.n
        return out
    want = {}
    for t in texts:
        for f in {f for w in TX.words(t) for f in TX.word_features(w)}:
            want[f] = want.get(f, 0) + 1
    assert counted(None) == want
    some = ["=bad", "^badl", "=absent"]
    assert counted(some) == {f: want[f] for f in some if f in want}


def test_risk_terms_equal_a_plain_sum(spark):
    rng = np.random.default_rng(4)
    d, thetas = 6, rng.normal(size=(3, 7))
    rows = []
    for i in range(60):
        at = sorted(rng.choice(d, rng.integers(0, 4), replace=False).tolist())
        rows.append((at, [float(v) for v in rng.random(len(at))]))
    df = spark.createDataFrame(rows, "at array<int>, x array<double>").repartition(4)
    total, grad = TX.risk_terms(df, thetas)
    want_t, want_g = np.zeros(3), np.zeros((3, 7))
    for at, x in rows:
        dense = np.zeros(7)
        dense[at], dense[6] = x, 1
        for i, theta in enumerate(thetas):
            s = 1 / (1 + np.exp(-theta @ dense))
            want_t[i] += s
            want_g[i] += s * (1 - s) * dense
    assert np.allclose(total, want_t) and np.allclose(grad, want_g)
    total, grad = TX.risk_terms(df.limit(0), thetas)
    assert not total.any() and not grad.any()


def test_full_steps_use_every_row(spark):
    """What the start's rows do not show is learned from the rest: a word of many unlabelled
    texts must not stay toxic for want of it among the first rows."""
    docs = spark.createDataFrame(
        [(i, "vile muck" if i % 10 == 3 else f"calm text {i % 7} muck" if i % 3 else "calm")
         for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 3)) for i in range(0, 600, 1)],
                                   "doc_id long, toxic int")
    one = TX.fit(docs, labels, start=5, full_steps=0)
    two = TX.fit(docs, labels, start=5, full_steps=40)
    score = two.scorer()
    assert score("vile muck") > 0.5 > score("calm text") and score("calm text muck") < 0.5
    assert one.features == two.features and not np.allclose(one.weights, two.weights)

"""The output layer of the language model against plain softmax."""

import tracemalloc

import numpy as np

from larder.llm import neural_lm as M


def _model(scale, n=9_000, kinds=8, seed=3):
    rng = np.random.default_rng(seed)
    words = [(b"w%d" % i + b"%02d" % (i % kinds), 900 - i) for i in range(400)]
    heavy = {M.ending(w): (400_000 // kinds, 90) for w, _ in words[:kinds]}
    v = M.build_vocabulary(words, heavy, 400_000, 9_000, 500)
    p = M.start_parameters(v)
    p["c"] = rng.normal(0, scale, p["c"].shape).astype(np.float32)
    p["s"] = rng.normal(0, scale, p["s"].shape).astype(np.float32)
    states = np.tanh(rng.normal(0, 1, (n, M.HIDDEN))).astype(np.float32)
    return p, v, states, rng.integers(0, len(v.slot_class), n)


def _plain(p, v, states, slots):
    """Log probabilities and gradients in double precision, class by class and row by row."""
    states, p = states.astype(float), {k: x.astype(float) for k, x in p.items()}
    softmax = lambda x: np.exp(x - x.max(1, keepdims=True)) / np.exp(       # noqa: E731
        x - x.max(1, keepdims=True)).sum(1, keepdims=True)
    own = v.slot_class[slots]
    rows = np.arange(len(slots))
    of = softmax(states @ p["c"] + p["cb"])
    logp = np.log(of[rows, own])
    d = -of
    d[rows, own] += 1
    grads = {"c": states.T @ d, "cb": d.sum(0), "s": np.zeros_like(p["s"]), "sb": np.zeros_like(p["sb"])}
    back = d @ p["c"].T
    for k in range(v.n_classes):
        at, members = np.flatnonzero(own == k), np.flatnonzero(v.slot_class == k)
        inner = softmax(states[at] @ p["s"][members].T + p["sb"][members])
        place = slots[at] - members[0]
        logp[at] += np.log(inner[np.arange(len(at)), place])
        d = -inner
        d[np.arange(len(at)), place] += 1
        if len(members) > 1:
            grads["s"][members], grads["sb"][members] = d.T @ states[at], d.sum(0)
            back[at] += d @ p["s"][members]
    return logp, grads, back


def test_output_equals_plain_softmax():
    for scale in (0.1, 0.8, 9.0):                        # the last one is beyond SAFE
        p, v, states, slots = _model(scale)
        want, want_grads, want_back = _plain(p, v, states, slots)
        logp, grads, back = M.output(p, v, states, slots, True)
        assert np.allclose(logp, want, rtol=1e-4, atol=2e-4)
        assert np.allclose(M.output(p, v, states, slots, False), logp)
        assert np.allclose(back, want_back, rtol=1e-3, atol=2e-3)
        for k, g in want_grads.items():
            assert np.allclose(grads[k], g, rtol=1e-3, atol=2e-2), k


def test_output_works_in_parts_that_fit_the_cache():
    p, v, states, slots = _model(0.1, n=60_000, kinds=96)
    M.output(p, v, states[:10], slots[:10], True)
    tracemalloc.start()
    M.output(p, v, states, slots, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # states, places, sums and gradients, but no table of all tokens by all classes beside them
    assert peak < 60_000 * 4 * 150

"""Words of the language model: numbered as the contract says, without calls for each token."""

import sys

import numpy as np
import pyarrow as pa
import pyspark

from larder.llm import neural_lm as M
from larder.llm.common import words_of

TEXTS = ["", None, "  ", "One two  ONE\n", "\x0bÉt\xe9 \x85x\xa0y z \x1ca\x00b\t", "ends, ends. .. É. €,",
         "two"]


def _vocabulary():
    words = [(b"two", 9), (b"one", 5), (b"ends", 3)]
    return M.build_vocabulary(words, {b"wo": (9, 1), b"ds": (6, 2), b"\x82\xac": (1, 1)}, 30, 12, 7)


def test_words_as_by_plain_split():
    parts = [pa.array(TEXTS[:4]), pa.array([], pa.string()), pa.array(["x", *TEXTS[4:]])[1:]]
    numbers, lengths, words = M.numbered_words(parts)
    words = words.cast(pa.large_binary()).to_pylist()
    want = [words_of(x) for x in TEXTS]
    assert lengths.tolist() == [len(x) for x in want]
    assert [words[i] for i in numbers] == sum(want, [])
    assert words == list(dict.fromkeys(sum(want, [])))
    for nothing in ([], [pa.array([None, " "], pa.string())]):
        numbers, lengths, words = M.numbered_words(nothing)
        assert len(numbers) == lengths.sum() == len(words) == 0


def test_input_numbers_as_by_plain_lookup():
    v = _vocabulary()
    words = list(dict.fromkeys(sum((words_of(x) for x in TEXTS), []))) + [b",", b"seeds.,", b"o"]
    known = {w: i + 1 for i, w in enumerate(v.words)}
    want = [known.get(w, 1 + len(known) + v.class_of(w)) for w in words]
    array = M._word_array([len(w) for w in words], b"".join(words))
    assert v.numbers(array).tolist() == want
    assert len(set(want)) > 4
    assert v.numbers(M._word_array([], b"")).tolist() == []


def _calls(task, text):
    """Calls of Python and C functions in a task over one training document."""
    doc_id = next(i for i in range(9) if M.id_remainder(i, M.MODULUS) != M.HELD_OUT)
    batch = pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([text])], names=["i", "t"])
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        list(task(iter([batch])))
    finally:
        sys.setprofile(None)
    return calls[0]


def test_no_calls_for_each_token(monkeypatch):
    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(pyspark, "TaskContext", Context)
    v = _vocabulary()
    tasks = [M._explode(M.BLOCK_CHARS, 8),
             M._train(v, M.start_parameters(v), 0, 1, M.BLOCK_CHARS)]
    text = "one two ends seeds other, words "
    for task in tasks:
        _calls(task, text)                               # imports
        few, many = (_calls(task, text * n) for n in (4_000, 16_000))
        assert many < few + 20_000                       # 72,000 more tokens


def test_documents_one_by_one():
    """Side by side in windows or alone, by a plain loop over time in double precision."""
    v = _vocabulary()
    p = M.start_parameters(v)
    rng = np.random.default_rng(5)
    p = {k: (x + rng.normal(0, 0.2, x.shape)).astype(np.float32) for k, x in p.items()}
    lengths = np.array([3, 1, 50, 3, 20])
    numbers = rng.integers(0, len(p["x"]), lengths.sum())
    got = M.document_scores(p, v, numbers, np.zeros(len(numbers)), lengths)
    q = {k: x.astype(float) for k, x in p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))             # noqa: E731
    at = 0
    for length, score in zip(lengths, got):
        h, last, want, n = np.zeros(M.HIDDEN), M.END, 0.0, M.HIDDEN
        for number in numbers[at:at + length]:
            x, a = q["x"][last], h @ q["u"]
            z, r = sigmoid(x[:n] + a[:n]), sigmoid(x[n:2 * n] + a[n:2 * n])
            h = (1 - z) * np.tanh(x[2 * n:] + r * a[2 * n:]) + z * h
            slot = v.slots(np.array([number]))[0]
            own, logits = v.slot_class[slot], h @ q["c"] + q["cb"]
            inner = np.flatnonzero(v.slot_class == own)
            of = q["s"][inner] @ h + q["sb"][inner]
            want += (logits[own] - np.log(np.exp(logits).sum())
                     + of[slot - inner[0]] - np.log(np.exp(of).sum())) / np.log(10)
            last = number
        assert abs(score - want) < 1e-4 * abs(want)
        at += length

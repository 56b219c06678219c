"""LM scoring (operator 2): a gated recurrent language model in numpy.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end.

*Model.*  A GRU reads the tokens; the next token's probability is factored
over classes, P(class | state) P(word | class, state).  A word's class is its
last two bytes (punctuation aside): the ``CLASSES`` heaviest endings, one
class for the rest and one for the end.  Within its class each of the
``FREQUENT`` most frequent words has a softmax slot of its own; the other
words share the class's rare slot in proportion to their exact corpus count
plus one half, where one unseen word a class counts one half.  So every word
that ever occurs has a probability, whatever the vocabulary.

*Training.*  Truncated backpropagation through time in windows of ``WINDOW``
tokens, state carried from window to window and reset at each document's
start.  Every training document is read once, whole: the documents are dealt
over ``ROUNDS`` rounds by id hash, in each round every input partition trains
its own replica (Adam), and replicas are averaged by tokens read (in a tree
of groups of ``FAN``, so no task and not the driver holds more than ``FAN``
replicas).  Biases start at the logarithms of the corpus frequencies.

*Counts.*  Words are counted exactly over the whole corpus by the same
distinct-word shuffle as byte-level BPE uses: a block of documents sends each
distinct word once, with its count among training rows, and gets the corpus
count back; positions never leave the block.

*Scoring.*  The documents of a block run side by side, longest first; states
are carried across windows to the very end of every text.

Defined results: null and empty texts consist of the end alone.  Rows with a
null id are training rows.  Repeated rows count and score one by one.  An
empty table gives no rows; without training rows every count is zero.
Floats may differ in the last digits between runs, as replicas are summed in
any order.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import pack, planes, table_of, unpack, unplaned
from .common import id_remainder, stored

BLOCK_CHARS = 24_000_000
FREQUENT = 2_048
CLASSES = 96
HIDDEN = 16
WINDOW = 16
STREAMS = 768                             # texts read side by side in training, at most
LEAST_WINDOWS = 64                        # and in windows: fewer streams where a block is small
BATCH = 65_536                            # tokens scored whose output layer is computed at once
ROWS_AT_ONCE = 2_048                      # of the output layer, so that they stay in the cache
TEXTS_AT_ONCE = 500                       # cut into words
SAFE = 60.0                               # logits up to this need no lowering in float32
ROUNDS = 2
FAN = 32
RATE = 0.01
MODULUS, HELD_OUT = 5, 1
END = 0                                   # input number of the end (and of a text's beginning)

_EXPLODED = T.StructType([
    T.StructField("key", T.StringType()),          # "w" and the shard, or "d" and the block
    T.StructField("block", T.LongType()),
    T.StructField("shard", T.IntegerType()),
    T.StructField("packed", T.BinaryType()),       # words, or the block's positions
    T.StructField("counts", T.BinaryType()),       # the words' counts in the block's training rows
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.ArrayType(T.LongType())),
])
_COUNTED = T.StructType([
    T.StructField("key", T.StringType()),          # "d" and the block, or "top"
    T.StructField("shard", T.IntegerType()),
    T.StructField("packed", T.BinaryType()),
    T.StructField("counts", T.BinaryType()),
    T.StructField("endings", T.BinaryType()),      # of "top": endings of all the shard's words
    T.StructField("totals", T.ArrayType(T.LongType())),
])
_SCORED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
])


def ending(word: bytes) -> bytes:
    """What classes are made of: the last two bytes, trailing full stops and commas aside."""
    return (word.rstrip(b".,") or word)[-2:]


def _word_array(sizes, body) -> pa.Array:
    """Words of these byte counts that stand end to end."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_string(), len(sizes),
                                 [None, pa.py_buffer(ends), pa.py_buffer(body)])


def _sizes_and_body(words: pa.Array) -> tuple[np.ndarray, bytes]:
    """The opposite of ``_word_array``."""
    ends = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    body = words.buffers()[2]
    return np.diff(ends), body[int(ends[0]):int(ends[-1])].to_pybytes() if body else b""


def numbered_words(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all texts, words of each text, and the distinct words by number.

    As ``words_of``: ``ascii_lower`` touches only A-Z, and ``ascii_split_whitespace`` splits on
    the six characters (with an empty string where a text begins or ends with one).
    """
    words, lengths = [], [np.empty(0, np.int64)]
    for part in texts:
        for at in range(0, len(part), TEXTS_AT_ONCE):
            # taken, not sliced: casts of slices keep offsets that ascii_lower misreads
            piece = part.take(pa.array(np.arange(at, min(at + TEXTS_AT_ONCE, len(part)))))
            split = pc.ascii_split_whitespace(pc.ascii_lower(piece.fill_null("")))
            flat = split.flatten()
            full = pc.greater(pc.binary_length(flat), 0)
            ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
            lengths.append(np.diff(ends[np.concatenate([
                [0], np.cumsum(pc.list_value_length(split).to_numpy())])]))
            words.append(flat.filter(full).cast(pa.large_string()))
    lengths = np.concatenate(lengths)
    if not lengths.sum():
        return np.empty(0, np.int32), lengths, pa.array([], pa.large_string())
    coded = pa.chunked_array(words).dictionary_encode()  # all chunks get the same dictionary
    del words
    numbers = np.concatenate([x.indices.to_numpy() for x in coded.chunks])
    distinct = coded.chunk(0).dictionary
    del coded
    pa.default_memory_pool().release_unused()
    return numbers, lengths, distinct


def _blocks(batches, block_chars: int, after: bool, wanted=lambda doc_id: True):
    """Ids and texts of consecutive wanted documents, cut so that they have ``block_chars``
    characters at most (``after``: cut after the document that exceeds them)."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        own, column = batch.column(0).to_pylist(), batch.column(1)
        sizes = pc.utf8_length(column).fill_null(0).to_pylist()
        rows = []
        for row, doc_id in enumerate(own):
            if not wanted(doc_id):
                continue
            if not after and ids and chars + sizes[row] > block_chars:
                yield ids, [*texts, column.take(pa.array(rows, pa.int64()))]
                ids, texts, chars, rows = [], [], 0, []
            ids.append(doc_id)
            rows.append(row)
            chars += sizes[row]
            if after and chars > block_chars:
                yield ids, [*texts, column.take(pa.array(rows, pa.int64()))]
                ids, texts, chars, rows = [], [], 0, []
        if rows:
            texts.append(column.take(pa.array(rows, pa.int64())))
    if ids:
        yield ids, texts


def _explode(block_chars: int, n_shards: int):
    def rows_of(block, ids, texts):
        numbers, lengths, words = numbered_words(texts)
        sizes, body = _sizes_and_body(words)
        ends = np.cumsum(sizes).tolist()
        shard = np.fromiter((zlib.crc32(body[a:b]) for a, b in zip([0, *ends], ends)), np.int64,
                            len(words)) % n_shards
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        at = place[numbers]
        learn = np.array([id_remainder(i, MODULUS) != HELD_OUT for i in ids])
        counts = np.bincount(at[np.repeat(learn, lengths)], minlength=len(order))
        cuts = np.searchsorted(shard[order], np.arange(n_shards + 1))
        sizes, body = _sizes_and_body(words.take(pa.array(order)))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        rows = []
        for s in range(n_shards):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                rows.append((f"w{s}", block, s, pack(sizes[a:b], body[ends[a]:ends[b]]),
                             pack(counts[a:b], b""), None, None))
        rows.append((f"d{block}", block, None, zstandard.compress(planes(at), 3), None, ids,
                     lengths.tolist()))
        return table_of(rows, _EXPLODED).to_batches()

    def run(batches):
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        for n, (ids, texts) in enumerate(_blocks(batches, block_chars, after=False)):
            yield from rows_of(first + n, ids, texts)

    return run


def _count(frequent: int):
    """All blocks' words of one shard: corpus counts for every block, and the shard's totals."""

    def run(group: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        blocks = []
        for block, shard, packed, counts in zip(*(group.column(c).to_pylist() for c in (
                "block", "shard", "packed", "counts"))):
            sizes, body = unpack(packed)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            words = [body[a:b] for a, b in zip([0, *ends], ends)]
            blocks.append((block, shard, packed, words))
            for word, n in zip(words, unpack(counts)[0].tolist()):
                total[word] = total.get(word, 0) + n
        rows = [(f"d{block}", shard, packed, pack([total[w] for w in words], b""), None, None)
                for block, shard, packed, words in blocks]
        seen = [(w, n) for w, n in total.items() if n]
        top = sorted(seen, key=lambda x: (-x[1], x[0]))[:frequent]
        mass: dict[bytes, list[int]] = {}
        for word, n in seen:
            own = mass.setdefault(ending(word), [0, 0])
            own[0] += n
            own[1] += 1
        keys = sorted(mass)
        flat = np.array([mass[k] for k in keys], np.int64).reshape(-1, 2)
        rows.append(("top", blocks[0][1], pack([len(w) for w, _ in top],
                                               b"".join(w for w, _ in top)),
                     pack([n for _, n in top], b""),
                     pack([len(k) for k in keys], flat.tobytes() + b"".join(keys)),
                     [sum(n for _, n in seen), len(seen)]))
        return table_of(rows, _COUNTED)

    return run


@dataclass
class Vocabulary:
    """Input numbers and output slots of words; the same in every task."""

    words: list[bytes]                    # frequent words, by input number from 1
    endings: dict[bytes, int]             # ending to class; others fall into class 0
    slot_class: np.ndarray                # class of each slot; slots of a class stand together
    slot_count: np.ndarray                # corpus count behind each slot
    word_slot: np.ndarray                 # slot of each input number (END and frequent words)
    rare_slot: np.ndarray                 # rare slot of each class (-1 for the end's class)
    rare_mass: np.ndarray                 # of each class: sum of (count + 1/2) of its rare words
    n_tokens: int
    n_distinct: int
    n_ends: int

    @property
    def n_classes(self) -> int:
        return len(self.rare_slot)

    def class_of(self, word: bytes) -> int:
        return self.endings.get(ending(word), 0)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Input number of each word: a frequent word's, or its class's."""
        trimmed = pc.ascii_rtrim(words, ".,")
        trimmed = pc.if_else(pc.equal(pc.binary_length(trimmed), 0), words, trimmed)
        endings = pc.binary_slice(trimmed.cast(pa.large_binary()), -2)
        place = lambda x, among: pc.index_in(           # noqa: E731
            x, pa.array(among, x.type)).fill_null(-1).to_numpy().astype(np.int64)
        known = place(words.cast(pa.large_binary()), self.words)
        own = np.concatenate([list(self.endings.values()), [0]]).astype(np.int64)[
            place(endings, list(self.endings))]
        return np.where(known >= 0, known + 1, 1 + len(self.words) + own)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """Output slot of each input number."""
        first = 1 + len(self.words)
        table = np.concatenate([self.word_slot, self.rare_slot[:-1]])
        assert len(table) == first + self.n_classes - 1
        return table[numbers]


def _words_of_tops(batches):
    for batch in batches:
        for packed, counts in zip(*(c.to_pylist() for c in batch.columns)):
            sizes, body = unpack(packed)
            ends = np.cumsum(sizes, dtype=np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([body[a:b] for a, b in zip([0, *ends], ends)], pa.binary()),
                 pa.array(unpack(counts)[0].astype(np.int64))], names=["word", "n"])


def _endings_of_tops(batches):
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            sizes, body = unpack(packed)
            flat = np.frombuffer(body, np.int64, 2 * len(sizes)).reshape(-1, 2)
            ends = (16 * len(sizes) + np.cumsum(sizes, dtype=np.int64)).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([body[a:b] for a, b in zip([16 * len(sizes), *ends], ends)],
                          pa.binary()), pa.array(flat[:, 0]), pa.array(flat[:, 1])],
                names=["ending", "n", "k"])


def gather_vocabulary(counted: DataFrame, n_ends: int, frequent: int = FREQUENT,
                      classes: int = CLASSES) -> Vocabulary:
    """The vocabulary from the shards' counts: ``frequent`` + ``classes`` + 1 rows to the driver."""
    tops = counted.where("key = 'top'")
    words = (tops.select("packed", "counts").mapInArrow(_words_of_tops, "word binary, n long")
             .orderBy(F.desc("n"), "word").limit(frequent).collect())
    endings = stored(tops.select("endings").mapInArrow(
        _endings_of_tops, "ending binary, n long, k long").groupBy("ending")
        .agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "lm-endings")
    heavy = endings.orderBy(F.desc("n"), "ending").limit(classes).collect()
    total = endings.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                        F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    return build_vocabulary([(bytes(r.word), r.n) for r in words],
                            {bytes(r.ending): (r.n, r.k) for r in heavy}, total["n"], total["k"],
                            n_ends)


def build_vocabulary(candidates: list[tuple[bytes, int]], heavy: dict[bytes, tuple[int, int]],
                     n: int, v: int, n_ends: int) -> Vocabulary:
    """``candidates``: frequent words and counts, by falling count; ``heavy``: the classes'
    endings with the tokens and distinct words they have; ``n``, ``v``: of all words."""
    endings = {k: i + 1 for i, k in enumerate(heavy)}
    n_classes = 1 + len(heavy) + 1                       # the rest, the endings, the end
    rare_n, rare_k = np.zeros(n_classes - 1), np.zeros(n_classes - 1)
    for k, (c, d) in heavy.items():
        rare_n[endings[k]], rare_k[endings[k]] = c, d
    rare_n[0], rare_k[0] = n - rare_n.sum(), v - rare_k.sum()
    members: list[list[int]] = [[] for _ in range(n_classes)]
    for i, (word, c) in enumerate(candidates):
        own = endings.get(ending(word), 0)
        members[own].append(i)
        rare_n[own] -= c
        rare_k[own] -= 1
    slot_class, slot_count = [], []
    word_slot, rare_slot = np.zeros(1 + len(candidates), np.int64), np.full(n_classes, -1)
    for own in range(n_classes - 1):
        for i in members[own]:
            word_slot[i + 1] = len(slot_class)
            slot_class.append(own)
            slot_count.append(candidates[i][1])
        rare_slot[own] = len(slot_class)
        slot_class.append(own)
        slot_count.append(rare_n[own])
    word_slot[END] = len(slot_class)
    slot_class.append(n_classes - 1)
    slot_count.append(n_ends)
    return Vocabulary([w for w, _ in candidates], endings, np.array(slot_class),
                      np.array(slot_count, float), word_slot, rare_slot,
                      rare_n + 0.5 * rare_k + 0.5, n + n_ends, v + (n_ends > 0), n_ends)


def start_parameters(vocabulary: Vocabulary, hidden: int = HIDDEN, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    inputs = 1 + len(vocabulary.words) + vocabulary.n_classes - 1
    slots, classes = len(vocabulary.slot_class), vocabulary.n_classes
    mass = np.bincount(vocabulary.slot_class, vocabulary.slot_count + 0.5, classes)
    p = {
        "x": rng.normal(0, 0.3, (inputs, 3 * hidden)),
        "u": rng.normal(0, 0.6 / np.sqrt(hidden), (hidden, 3 * hidden)),
        "c": np.zeros((hidden, classes)), "cb": np.log(mass / mass.sum()),
        "s": np.zeros((slots, hidden)),
        "sb": np.log((vocabulary.slot_count + 0.5) / mass[vocabulary.slot_class]),
    }
    p["x"][:, :hidden] += 1.0                            # update gates start towards keeping
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x):
    """In place."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _step(gx, h, ut):
    """One GRU step: new state and what backpropagation needs.

    ``gx`` [stream, 3 hidden]; states and all else [hidden, stream], so that numpy's inner loops
    run over the streams.  ``ut``: the transposed recurrent weights.
    """
    hidden = len(h)
    a = ut @ h
    gx = gx.T
    zr = a[:2 * hidden]
    zr += gx[:2 * hidden]
    _sigmoid(zr)
    z, r, q = zr[:hidden], zr[hidden:], a[2 * hidden:]
    n = r * q
    n += gx[2 * hidden:]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, q, n


def _exp(states, weights, lower, targets, at):
    """``e``, its row sums and the targets' logits, of logits ``states @ weights``, which are
    lowered by their row's greatest where they could leave float32 (``lower``)."""
    e = states @ weights                                 # the states' last column is 1
    if lower:
        e -= e.max(1, keepdims=True)
    chosen = e[at, targets]
    np.exp(e, out=e)
    return e, e @ np.ones(e.shape[1], e.dtype), chosen


def _softmax_gradient(states, e, total, weights, targets, at):
    """Gradients of the sum of the targets' log probabilities: weights (biases in the last row)
    and states (with a last column for their 1).  Overwrites ``e``."""
    share = -1 / total[:, None]
    e[at, targets] -= total
    back = e @ weights.T
    back *= share
    return (states * share).T @ e, back


def output(p: dict, vocabulary: Vocabulary, states, slots, gradient: bool):
    """Natural log probabilities of ``slots`` given states; with the gradients of their sum."""
    order = np.argsort(vocabulary.slot_class[slots].astype(np.int16), kind="stable")
    slots = slots[order]
    own = vocabulary.slot_class[slots]
    n, hidden = states.shape
    ordered = np.ones((n, hidden + 1), states.dtype)
    ordered[:, :-1] = states[order]
    states, n_classes = ordered, vocabulary.n_classes
    kind = np.result_type(states, p["c"])
    sorted_logp, grads = np.empty(n, kind), {}
    of_class = np.vstack([p["c"], p["cb"]])
    of_slots = np.column_stack([p["s"], p["sb"]])
    starts = np.searchsorted(vocabulary.slot_class, np.arange(n_classes + 1))
    # no state leaves [-1, 1], so that no logit leaves these
    reach = np.maximum.reduceat(np.abs(of_slots).sum(1), starts[:-1]) > SAFE
    class_reach = np.abs(of_class).sum(0).max() > SAFE
    rows = np.arange(min(n, ROWS_AT_ONCE))
    if gradient:
        d_states = np.empty((n, hidden + 1), kind)
        d_c, d_s = np.zeros_like(of_class), np.zeros_like(of_slots)
    for a in range(0, n, ROWS_AT_ONCE):
        part = slice(a, a + ROWS_AT_ONCE)
        x, target = states[part], own[part]
        at = rows[:len(x)]
        e, total, chosen = _exp(x, of_class, class_reach, target, at)
        sorted_logp[part] = chosen - np.log(total)
        if gradient:
            d, d_states[part] = _softmax_gradient(x, e, total, of_class, target, at)
            d_c += d
    cuts = np.searchsorted(own, np.arange(n_classes + 1)).tolist()
    starts, inside = starts.tolist(), slots - starts[own]
    for k in range(n_classes):
        a, b = starts[k], starts[k + 1]
        if b - a == 1:
            continue
        weights = of_slots[a:b].T
        for first in range(cuts[k], cuts[k + 1], ROWS_AT_ONCE):
            part = slice(first, min(first + ROWS_AT_ONCE, cuts[k + 1]))
            x, target = states[part], inside[part]
            at = rows[:len(x)]
            e, total, chosen = _exp(x, weights, reach[k], target, at)
            chosen -= np.log(total)
            sorted_logp[part] += chosen
            if gradient:
                d, back = _softmax_gradient(x, e, total, weights, target, at)
                d_s[a:b] += d.T
                d_states[part] += back
    logp = np.empty_like(sorted_logp)
    logp[order] = sorted_logp
    if not gradient:
        return logp
    unsorted = np.empty_like(d_states)
    unsorted[order] = d_states
    grads = {"s": d_s[:, :-1], "sb": d_s[:, -1], "c": d_c[:-1], "cb": d_c[-1]}
    return logp, grads, unsorted[:, :-1]


def window_gradient(p, vocabulary, inputs, targets, fresh, h):
    """Log likelihood of one window [time, stream] and its gradients, truncated at its start."""
    steps, streams = inputs.shape
    hidden = h.shape[1]
    u, ut = p["u"], np.ascontiguousarray(p["u"].T)
    kind = np.result_type(h, u)
    keep = (~fresh).astype(kind)
    h = h.T
    kept, befores = [], np.empty((steps, hidden, streams), kind)
    states = np.empty((steps, streams, hidden), kind)
    for t in range(steps):
        before = np.multiply(h, keep[t], out=befores[t])  # a document starts: empty state
        h, z, r, q, n = _step(p["x"][inputs[t]], before, ut)
        kept.append((z, r, q, n))
        states[t] = h.T
    logp, grads, d_out = output(p, vocabulary, states.reshape(-1, hidden), targets.ravel(), True)
    d_out = d_out.reshape(steps, streams, hidden)
    grads["u"] = np.zeros_like(u)
    d_gx = np.empty((3 * hidden, steps, streams), kind)
    dh = np.zeros((hidden, streams), kind)
    d_a = np.empty((3 * hidden, streams), kind)
    for t in reversed(range(steps)):
        before, (z, r, q, n) = befores[t], kept[t]
        dh += d_out[t].T
        d = dh * (1 - z)
        dz, dr, da = d_a[:hidden], d_a[hidden:2 * hidden], d_a[2 * hidden:]
        np.subtract(before, n, out=dz)
        dz *= z
        dz *= d
        n *= n
        d *= np.subtract(1, n, out=n)                    # of the candidate's input from the word
        np.multiply(d, r, out=da)
        q *= np.subtract(1, r, out=r)
        np.multiply(da, q, out=dr)
        d_gx[:2 * hidden, t], d_gx[2 * hidden:, t] = d_a[:2 * hidden], d
        grads["u"] += before @ d_a.T
        dh *= z
        dh += u @ d_a
        dh *= keep[t]
    flat = inputs.ravel()
    grads["x"] = np.empty_like(p["x"])
    for i, d in enumerate(d_gx.reshape(3 * hidden, -1)):
        grads["x"][:, i] = np.bincount(flat, d, len(p["x"]))
    return float(logp.sum()), grads, np.ascontiguousarray(h.T)


class Replica:
    """One task's model in training."""

    def __init__(self, params: dict, vocabulary: Vocabulary, rate: float = RATE):
        self.p = {k: v.copy() for k, v in params.items()}
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}
        self.vocabulary, self.rate, self.step, self.tokens = vocabulary, rate, 0, 0

    def learn(self, numbers: np.ndarray, fresh: np.ndarray, streams: int = STREAMS,
              window: int = WINDOW):
        """Reads tokens once.  ``fresh`` marks the first token of a document."""
        n = len(numbers)
        if not n:
            return
        streams = max(1, min(streams, n // (window * LEAST_WINDOWS)))
        length = -(-n // streams)
        before = np.concatenate([[END], numbers[:-1]])
        before[fresh] = END
        # the last stream is filled up with tokens from the beginning
        wrap = np.arange(streams * length) % n
        fresh = fresh.copy()
        grid = lambda a: a[wrap].reshape(streams, length).T          # noqa: E731
        inputs, slots = grid(before), grid(self.vocabulary.slots(numbers))
        fresh = grid(fresh)
        fresh[0] = True
        h = np.zeros((streams, self.p["u"].shape[0]), np.float32)
        for t in range(0, length, window):
            part = slice(t, t + window)
            _, grads, h = window_gradient(self.p, self.vocabulary, inputs[part], slots[part],
                                          fresh[part], h)
            self._update(grads, inputs[part].size)
        self.tokens += n

    def _update(self, grads, n):
        self.step += 1
        a, b = 1 - 0.9 ** self.step, 1 - 0.999 ** self.step
        for k, g in grads.items():
            g = g * np.float32(1 / n)
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            self.p[k] += np.float32(self.rate / a) * m / (np.sqrt(v * np.float32(1 / b))
                                                          + np.float32(1e-7))


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unflat(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _train(vocabulary: Vocabulary, params: dict, round_no: int, rounds: int, block_chars: int):
    def run(batches):
        from pyspark import TaskContext
        replica = Replica(params, vocabulary)

        def wanted(doc_id):
            return id_remainder(doc_id, MODULUS) != HELD_OUT and \
                zlib.crc32(f"round {doc_id}".encode()) % rounds == round_no

        for _, texts in _blocks(batches, block_chars, after=True, wanted=wanted):
            numbers, lengths, words = numbered_words(texts)
            ends = np.cumsum(lengths)
            tokens = np.insert(vocabulary.numbers(words)[numbers], ends, END)
            fresh = np.zeros(len(tokens), bool)
            fresh[ends - lengths + np.arange(len(ends))] = True
            replica.learn(tokens, fresh)
        if replica.tokens:
            flat = _flat(replica.p).astype(np.float64) * replica.tokens
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()]), pa.array([replica.tokens]),
                 pa.array([flat.tobytes()], pa.binary())], names=["part", "tokens", "total"])
    return run


_REPLICA = "part long, tokens long, total binary"


def _add(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in group.column("total").to_pylist())
    return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN]),
                     "tokens": pa.array([sum(group.column("tokens").to_pylist())]),
                     "total": pa.array([total.tobytes()], pa.binary())})


def fit(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS,
        block_chars: int = BLOCK_CHARS) -> dict:
    """Parameters after every training document was read once."""
    params = start_parameters(vocabulary)
    n_parts = texts.rdd.getNumPartitions()
    for r in range(rounds):
        replicas = texts.mapInArrow(_train(vocabulary, params, r, rounds, block_chars), _REPLICA)
        left = n_parts
        while left > FAN:
            replicas = replicas.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_add, _REPLICA)
            left = -(-left // FAN)
        rows = replicas.collect()                        # at most FAN replicas
        tokens = sum(x.tokens for x in rows)
        if tokens:
            total = sum(np.frombuffer(x.total, np.float64) for x in rows)
            params = _unflat(total / tokens, params)
    return params


def document_scores(p: dict, vocabulary: Vocabulary, numbers: np.ndarray, extra: np.ndarray,
                    lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Log10 probability of each document.

    ``numbers``: input numbers of all documents' tokens, ends included;
    ``extra``: log10 share of the token in its slot (0 but for rare words).
    """
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    size, start = lengths[order], starts[order]
    rising = -size
    of_number = vocabulary.slots(np.arange(len(p["x"])))
    ut = np.ascontiguousarray(p["u"].T)
    hidden = len(p["u"])
    h = np.zeros((hidden, len(order)), np.result_type(np.float32, p["u"]))
    score = np.add.reduceat(extra, starts) if len(starts) else np.zeros(0)
    score = score[order]
    t, active = 0, len(order)
    while active:
        # enough steps to fill a window's worth of rows, however few documents are left
        steps = int(min(max(window, BATCH // active), size[0] - t))
        # of each step, the documents that still have a token: the first ones
        counts = np.searchsorted(rising, -np.arange(t, t + steps + 1), side="left")
        active = int(counts[-1])
        counts = counts[:-1]
        cuts = np.concatenate([[0], np.cumsum(counts)])
        owner = np.arange(cuts[-1]) - np.repeat(cuts[:-1], counts)
        at = start[owner] + np.repeat(np.arange(t, t + steps), counts)
        targets = of_number[numbers[at]]
        inputs = numbers[at - 1]                         # the token before; END before the first
        if t == 0:
            inputs[:counts[0]] = END
        states = np.empty((len(at), hidden), h.dtype)
        cuts = cuts.tolist()
        for a, b in zip(cuts, cuts[1:]):
            h = _step(p["x"][inputs[a:b]], h[:, :b - a], ut)[0]
            states[a:b] = h.T
        logp = output(p, vocabulary, states, targets, False)
        score += np.bincount(owner, logp, len(score)) / np.log(10)
        t += steps
    out = np.empty(len(order))
    out[order] = score
    return out


def _score(vocabulary: Vocabulary, params: dict):
    def run(counted: pa.Table, block: pa.Table) -> pa.Table:
        if not block.num_rows or not block.column("key")[0].as_py().startswith("d"):
            return table_of([], _SCORED)
        n, v = vocabulary.n_tokens, vocabulary.n_distinct
        first = 1 + len(vocabulary.words)
        parts = sorted(zip(*(counted.column(c).to_pylist()
                             for c in ("shard", "packed", "counts"))))
        inputs, counts = [np.zeros(1, np.int64)], [np.array([vocabulary.n_ends])]
        for _, packed, count in parts:
            inputs.append(vocabulary.numbers(_word_array(*unpack(packed))))
            counts.append(unpack(count)[0].astype(np.int64))
        inputs, counts = np.concatenate(inputs), np.concatenate(counts)      # 0 is the end
        base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
        share = np.zeros(len(inputs))
        rare = inputs >= first
        share[rare] = np.log10((counts[rare] + 0.5) / vocabulary.rare_mass[inputs[rare] - first])
        rows = []
        for doc_ids, lengths, packed in zip(*(block.column(c).to_pylist()
                                              for c in ("doc_ids", "lengths", "packed"))):
            lengths = np.array(lengths, np.int64)
            words = unplaned(zstandard.decompress(packed)).astype(np.int64) + 1
            tokens = np.insert(words, np.cumsum(lengths), 0)
            starts = np.cumsum(lengths + 1) - (lengths + 1)
            scores = document_scores(params, vocabulary, inputs[tokens], share[tokens],
                                     lengths + 1)
            bases = np.add.reduceat(base[tokens], starts)
            known = np.add.reduceat((counts[tokens] > 0).astype(np.int64), starts)
            rows += [(i, id_remainder(i, MODULUS) == HELD_OUT, int(k) + 1, int(m), n, float(b),
                      float(s))
                     for i, k, m, b, s in zip(doc_ids, lengths, known, bases, scores)]
        return table_of(rows, _SCORED)

    return run


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_shards = max(8, texts.rdd.getNumPartitions())
    exploded = stored(texts.mapInArrow(_explode(block_chars, n_shards), _EXPLODED), "lm-blocks")
    counted = stored(exploded.where("key LIKE 'w%'").groupBy("key")
                     .applyInArrow(_count(FREQUENT), _COUNTED), "lm-counts")
    learn = (F.col("doc_id").isNull()
             | (F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS != HELD_OUT))
    n_ends = texts.where(learn).count()
    vocabulary = gather_vocabulary(counted, n_ends)
    params = fit(texts, vocabulary, block_chars=block_chars)
    blocks = exploded.where("key LIKE 'd%'")
    return (counted.where("key LIKE 'd%'").groupBy("key").cogroup(blocks.groupBy("key"))
            .applyInArrow(_score(vocabulary, params), _SCORED))

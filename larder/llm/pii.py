"""PII: spans of personal data (operator 13).

Method: a character-level bidirectional LSTM with CRF transitions, trained in
numpy from labelled spans.

1. Base rules find the certain spans of each kind.  They run in linear time:
   no pattern looks at a character more than a few times.
2. Labelled spans: each task takes excerpts around base spans and around
   digits and signs outside of them, and keeps those with the least hashes
   of each kind, which are then ranked on Spark; at most ``EXCERPTS`` a kind
   (bound of the labelled sample) reach the driver.  Excerpts with digits
   that have the shape of a kind but fail its check (a card number with a
   wrong check digit) are no labels, neither for nor against.  Written
   variants of the spans ("name at mail dot example", spaced or dotted
   numbers, other prefixes), with fresh letters and digits, are added with
   their spans.
3. The network reads a window of ``WIDTH`` characters at a time, each half
   covered by the next one; the CRF's legal tag sequences are decoded by
   Viterbi, and forward-backward marginals give each span a confidence.
4. A document's windows are reconciled globally: spans cut by a window's edge
   are put together with their other part, and of all candidates the
   non-overlapping set with the greatest expected number of rightly tagged
   characters is kept (weighted interval scheduling).  Base spans always
   stay; a found span that meets one is dropped.

A span must hold a digit, an at sign, a bracketed or dotted "at" or a written
"dot", so windows without any hold no span and are not decoded: this changes
no result.  A found span must also have its kind's form and pass the check of
its digits (a card's check digit, an address' parts), as base spans do; long
numbers that fail it are left alone.  All texts are read whole, in batches of
windows whatever a text's length.

Defined results: null and empty texts have no spans.  Repeated rows and
repeated or null ids give one row each; ids are never inputs.  Without any
base span in the corpus nothing is learned and only base spans are returned.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.topk import top_k_per_group
from .common import stored

KINDS = ("email", "ip", "card", "phone")
EXCERPTS = 200                 # labelled excerpts a kind; three times as many without a span
VARIANTS = 5
WIDTH, STRIDE = 96, 48
EMBED, HIDDEN = 12, 20
EPOCHS, BATCH, RATE = 8, 64, 0.01
CONFIDENCE = 0.5
WINDOWS = 512                  # windows decoded at a time
SEED = 13


# --------------------------------------------------------------------------
# base rules
# --------------------------------------------------------------------------

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL = frozenset(map(chr, _LOCAL))
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive, and only from the start of a run of digits: no character is tried again.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SIGN = re.compile(r"[0-9]+|@|[\[({<] ?(?:at|AT|dot|DOT) ?[\])}>]|\b(?:dot|DOT)\b"
                   r"|\b(?:at|AT) [A-Za-z0-9-]++\.[A-Za-z]")
_EDGE = " \t\r\n.,;:!?\"'*%&$#|"
_WORD, _TAIL = re.compile("[A-Za-z0-9]+"), re.compile("[A-Za-z0-9]+$")
# What a found span of a kind looks like, however its parts are set apart.
_AT = r" ?(?:@|[\[({<]? ?(?:at|AT) ?[\])}>]?) ?"
_DOT = r" ?(?:\.|[\[({<]? ?(?:dot|DOT|\.) ?[\])}>]?) ?"
_NAME = "[A-Za-z0-9-]+"
_FORMS = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+{_AT}{_NAME}(?:{_DOT}{_NAME})*{_DOT}[A-Za-z]+"),
    "ip": re.compile(rf"[0-9]+(?:{_DOT}[0-9]+){{3}}"),
    "card": re.compile(r"[0-9](?:[ ._/-]{0,3}[0-9])+"),
    "phone": re.compile(r"[+(]? ?[0-9][ ()./0-9-]+[0-9]"),
}


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run of its characters before the sign, up to the match before."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            last = m.end()
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def shapes(text: str) -> list[tuple[str, int, int, bool]]:
    """Every match of a kind's pattern and whether it passes the kind's check."""
    found = []
    if "@" in text:
        found += [("email", s, e, True) for s, e in emails(text)]
    for m in _IP.finditer(text):
        found.append(("ip", *m.span(), all(map(_small, m.group().split(".")))))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        fits = 13 <= len(digits) <= 19
        if fits or len(digits) > 19:
            found.append(("card", *m.span(), fits and luhn(digits)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            found.append(("phone", *m.span(), 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15))
    return found


def plausible(kind: str, span: str) -> bool:
    """Whether a found span has its kind's form and passes the kind's check of its digits."""
    if not _FORMS[kind].fullmatch(span):
        return False
    digits = _NOT_DIGIT.sub("", span)
    return {"email": lambda: True,
            "ip": lambda: all(map(_small, re.findall("[0-9]+", span))),
            "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base rules, by kind and start."""
    return [x[:3] for x in shapes(text) if x[3]] if text else []


# --------------------------------------------------------------------------
# labelled excerpts and their variants
# --------------------------------------------------------------------------

Example = tuple[str, list[tuple[str, int, int]]]      # text of at most WIDTH characters, spans


def excerpts(text: str):
    """(kind or "none", text, spans): pieces whose spans are certain."""
    found = shapes(text)
    signs = list(_SIGN.finditer(text))
    starts = sorted((s, e, k, ok) for k, s, e, ok in found)
    begins = [x[0] for x in starts]

    def inside(lo, hi):
        first = bisect.bisect_left(begins, lo - WIDTH)
        return [x for x in starts[first:bisect.bisect_left(begins, hi)] if x[1] > lo]

    def piece(lo, hi):
        near = inside(lo, hi)
        if all(ok and lo <= s and e <= hi for s, e, _, ok in near):
            ends = sorted((s - lo, e - lo, k) for s, e, k, _ in near)
            if all(a[1] <= b[0] for a, b in zip(ends, ends[1:])):
                return text[lo:hi], [(k, s, e) for s, e, k in ends]
        return None

    centres = [(k, s, e) for s, e, k, ok in starts if ok and e - s <= STRIDE]
    last = -WIDTH
    for m in signs:
        if m.start() - last >= WIDTH and not inside(m.start(), m.end()):
            centres.append(("none", m.start(), min(m.end(), m.start() + 1)))
            last = m.start()
    for kind, s, e in centres:
        lo = max(0, (s + e) // 2 - STRIDE)
        got = piece(lo, min(len(text), lo + WIDTH))
        if got:
            yield kind, *got


def fresh(span: str, rng) -> str:
    """The same shape with other letters and digits."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return "".join(
        letters[rng.integers(26)] if "a" <= c <= "z" else letters[rng.integers(26)].upper()
        if "A" <= c <= "Z" else str(rng.integers(10)) if "0" <= c <= "9" else c for c in span)


def _pick(rng, choices):
    return choices[int(rng.integers(len(choices)))]


def variant(kind: str, span: str, rng) -> str:
    """A way in which people write such a span that the base rules do not know."""
    span = fresh(span, rng)
    digits = _NOT_DIGIT.sub("", span)
    if kind == "email":
        at = _pick(rng, [" @ ", " at ", "[at]", "(at)", " [at] ", " (at) ", " AT "])
        dot = _pick(rng, [" dot ", "[dot]", "(dot)", " [dot] ", " . ", ".", "."])
        local, _, domain = span[-STRIDE:].partition("@")
        local = _pick(rng, [local.split(".")[-1] or "x", fresh("abc.defgh", rng),
                            fresh("abcd", rng)])
        domain = _pick(rng, [domain, fresh("abcdef.com", rng), fresh("abc-defg.example.org", rng)])
        return local + at + domain.replace(".", dot if "at" in at.lower() or dot != "." else " . ")
    if kind == "ip":
        parts = [str(rng.integers(256)) for _ in range(4)]
        return _pick(rng, ["[.]", " . ", "(.)", ". ", "[dot]", " dot "]).join(parts)
    if kind == "card":
        cut = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return _pick(rng, [".", "/", "  ", " - ", "_", "", " ", "-"]).join(cut)
    form = _pick(rng, ["00{0} {1} {2} {3}", "({1}) {2}-{3}", "{1}-{2}-{3}", "{1}.{2}.{3}",
                       "+{0}/{1}/{2}{3}", "+ {0} {1} {2} {3}", "00{0}-{1}-{2}-{3}"])
    return form.format(rng.integers(1, 99), rng.integers(100, 999), rng.integers(100, 999),
                       rng.integers(1000, 9999))


def with_variants(examples: list[Example], variants: int = VARIANTS,
                  seed: int = SEED) -> list[Example]:
    """The examples, and copies whose spans are rewritten (spans move along)."""
    rng, out = np.random.default_rng(seed), []
    for text, spans in examples:
        out.append((text, spans))
        if not spans:
            continue
        for v in range(variants):
            parts, moved, at, length = [], [], 0, 0
            for kind, s, e in spans:
                new = variant(kind, text[s:e], rng) if v else fresh(text[s:e], rng)
                parts += [text[at:s], new]
                start = length + s - at
                moved.append((kind, start, start + len(new)))
                length, at = start + len(new), e
            whole = "".join(parts) + text[at:]
            # windows also begin and end near spans
            cut = int(rng.integers(0, max(1, min(moved[0][1], STRIDE))))
            whole = whole[cut:cut + WIDTH]
            moved = [(k, s - cut, min(e - cut, WIDTH)) for k, s, e in moved if s - cut < WIDTH]
            out.append((whole, moved))
    return out


# --------------------------------------------------------------------------
# the network
# --------------------------------------------------------------------------

# Symbols: padding, white space, line end, digit, letter, other ASCII signs, beyond ASCII.
_SYMBOLS = np.zeros(129, np.int64)
for _i in range(1, 128):
    _c = chr(_i)
    _SYMBOLS[_i] = (3 if _c.isdigit() else 2 if _c in "\n\r" else 1 if _c.isspace()
                    else ord(_c.lower()) - 29)
_SYMBOLS[0], _SYMBOLS[128] = 1, 99
N_SYMBOLS = 100
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
N_TAGS = len(TAGS)
# An inside tag follows the same kind's first or inside tag only.
LEGAL = np.array([[b[0] != "I" or a[2:] == b[2:] for b in TAGS] for a in TAGS])
LEGAL_FIRST = np.array([t[0] != "I" for t in TAGS])


def symbols(texts: list[str]) -> np.ndarray:
    """A row of WIDTH symbols a text; zero is padding."""
    out = np.zeros((len(texts), WIDTH), np.int64)
    for row, text in zip(out, texts):
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        row[:len(codes)] = _SYMBOLS[np.minimum(codes, 128)]
    return out


def tags_of(examples: list[Example]) -> np.ndarray:
    out = np.zeros((len(examples), WIDTH), np.int64)
    for row, (_, spans) in zip(out, examples):
        for kind, s, e in spans:
            row[s:e] = 2 + 2 * KINDS.index(kind)
            row[s] -= 1
    return out


def initial(rng, hidden: int = HIDDEN, embed: int = EMBED, dtype=np.float32) -> dict:
    def normal(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(dtype)
    p = {"embed": normal(N_SYMBOLS, embed) * 3, "out": normal(2 * hidden, N_TAGS),
         "out_b": np.zeros(N_TAGS, dtype), "trans": np.zeros((N_TAGS, N_TAGS), dtype),
         "first": np.zeros(N_TAGS, dtype)}
    for d in ("f", "b"):
        p["x" + d], p["h" + d] = normal(embed, 4 * hidden), normal(hidden, 4 * hidden)
        p["c" + d] = np.zeros(4 * hidden, dtype)
        p["c" + d][hidden:2 * hidden] = 1                       # remember at first
    return p


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, p: dict, d: str):
    """States of all steps for inputs (steps, batch, size); gates: in, forget, out, new."""
    steps, batch, _ = x.shape
    n = p["h" + d].shape[0]
    gates = x @ p["x" + d] + p["c" + d]
    h, c = np.zeros((batch, n), x.dtype), np.zeros((batch, n), x.dtype)
    hs, cs = np.empty((steps, batch, n), x.dtype), np.empty((steps, batch, n), x.dtype)
    for t in range(steps):
        g = gates[t]
        g += h @ p["h" + d]
        g[:, :3 * n] = _sigmoid(g[:, :3 * n])
        g[:, 3 * n:] = np.tanh(g[:, 3 * n:])
        c = g[:, n:2 * n] * c + g[:, :n] * g[:, 3 * n:]
        h = g[:, 2 * n:3 * n] * np.tanh(c)
        hs[t], cs[t] = h, c
    return hs, cs, gates


def lstm_back(dhs, x, p, d, hs, cs, gates, grads):
    """Adds the parameters' gradients; returns the inputs'."""
    steps, batch, n = hs.shape
    dh_next, dc = np.zeros((batch, n), x.dtype), np.zeros((batch, n), x.dtype)
    dgates = np.empty_like(gates)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t][:, k * n:(k + 1) * n] for k in range(4))
        dh, tc = dhs[t] + dh_next, np.tanh(cs[t])
        dc = dc + dh * o * (1 - tc * tc)
        before = cs[t - 1] if t else np.zeros_like(dc)
        dg = dgates[t]
        dg[:, :n] = dc * g * i * (1 - i)
        dg[:, n:2 * n] = dc * before * f * (1 - f)
        dg[:, 2 * n:3 * n] = dh * tc * o * (1 - o)
        dg[:, 3 * n:] = dc * i * (1 - g * g)
        dc = dc * f
        dh_next = dg @ p["h" + d].T
    flat = dgates.reshape(-1, 4 * n)
    grads["x" + d] += x.reshape(-1, x.shape[-1]).T @ flat
    grads["h" + d] += hs[:-1].reshape(-1, n).T @ dgates[1:].reshape(-1, 4 * n)
    grads["c" + d] += flat.sum(0)
    return dgates @ p["x" + d].T


def emissions(ids: np.ndarray, p: dict):
    """Tag scores (steps, batch, tags) of symbol rows; padding is tag O."""
    seq = ids.T
    x = p["embed"][seq]
    fwd, bwd = lstm(x, p, "f"), lstm(x[::-1], p, "b")
    both = np.concatenate([fwd[0], bwd[0][::-1]], axis=2)
    scores = both @ p["out"] + p["out_b"]
    scores[seq == 0, 1:] = -30
    return scores, (seq, x, fwd, bwd, both)


def marginals(scores: np.ndarray, p: dict):
    """CRF by scaled forward-backward: log Z, tag marginals and the expected transitions."""
    steps, batch, k = scores.shape
    link = np.where(LEGAL, np.exp(p["trans"]), 0)
    top = scores.max(2, keepdims=True)
    local = np.exp(scores - top)
    alpha, scale = np.empty_like(local), np.empty((steps, batch, 1), scores.dtype)
    a = local[0] * np.where(LEGAL_FIRST, np.exp(p["first"]), 0)
    for t in range(steps):
        if t:
            a = (a @ link) * local[t]
        scale[t] = a.sum(1, keepdims=True)
        a = alpha[t] = a / scale[t]
    beta, pairs = np.ones((batch, k), scores.dtype), np.zeros((k, k), np.float64)
    post = np.empty_like(alpha)
    post[-1] = alpha[-1]
    for t in range(steps - 1, 0, -1):
        ahead = local[t] * beta / scale[t]
        pairs += link * (alpha[t - 1].T @ ahead)
        beta = ahead @ link.T
        post[t - 1] = alpha[t - 1] * beta
    return (np.log(scale[..., 0]) + top[..., 0]).sum(0), post, pairs


def loss_and_gradients(ids: np.ndarray, tags: np.ndarray, p: dict):
    """Mean negative log-likelihood a window, and its gradients."""
    scores, (seq, x, fwd, bwd, both) = emissions(ids, p)
    log_z, post, pairs = marginals(scores, p)
    gold, batch = tags.T, len(ids)
    row = np.arange(batch)
    score = (np.take_along_axis(scores, gold[..., None], 2)[..., 0].sum(0)
             + p["first"][gold[0]] + p["trans"][gold[:-1], gold[1:]].sum(0))
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["first"] += post[0].sum(0) / batch
    np.subtract.at(grads["first"], gold[0], 1 / batch)
    counts = np.zeros((N_TAGS, N_TAGS))
    np.add.at(counts, (gold[:-1], gold[1:]), 1)
    grads["trans"] += ((pairs - counts) / batch).astype(grads["trans"].dtype)
    d = post.copy()
    d[np.arange(len(gold))[:, None], row, gold] -= 1
    d /= batch
    d[seq == 0, 1:] = 0                                        # these scores are fixed
    flat = d.reshape(-1, N_TAGS)
    grads["out"] += both.reshape(-1, both.shape[-1]).T @ flat
    grads["out_b"] += flat.sum(0)
    dboth = d @ p["out"].T
    n = p["hf"].shape[0]
    dx = lstm_back(dboth[..., :n], x, p, "f", *fwd, grads)
    dx = dx + lstm_back(dboth[::-1, :, n:], x[::-1], p, "b", *bwd, grads)[::-1]
    np.add.at(grads["embed"], seq, dx)
    return float((log_z - score).mean()), grads


def train(examples: list[Example], epochs: int = EPOCHS, seed: int = SEED) -> dict | None:
    """The network fitted to the examples with Adam; None without any span."""
    if not any(spans for _, spans in examples):
        return None
    rng = np.random.default_rng(seed)
    ids, tags, p = symbols([t for t, _ in examples]), tags_of(examples), initial(rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    steps, done = epochs * -(-len(ids) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(ids), BATCH):
            own = order[lo:lo + BATCH]
            _, grads = loss_and_gradients(ids[own], tags[own], p)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            done += 1
            rate = RATE * (1 - 0.9 * done / steps)
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-12))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** done)) / (
                    np.sqrt(v[k] / (1 - 0.99 ** done)) + 1e-8)).astype(np.float32)
    return p


# --------------------------------------------------------------------------
# decoding
# --------------------------------------------------------------------------

def viterbi(scores: np.ndarray, p: dict) -> np.ndarray:
    """The best legal tag sequence of every window, (batch, steps)."""
    steps, batch, _ = scores.shape
    link = np.where(LEGAL, p["trans"], -1e9)
    best = scores[0] + np.where(LEGAL_FIRST, p["first"], -1e9)
    back = np.empty(scores.shape, np.int8)
    for t in range(1, steps):
        through = best[:, :, None] + link
        back[t] = through.argmax(1)
        best = through.max(1) + scores[t]
    out = np.empty((batch, steps), np.int64)
    out[:, -1] = best.argmax(1)
    row = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t][row, out[:, t]]
    return out


def decode(texts: list[str], p: dict) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, mean marginal) of every span of each window's best tags."""
    scores, _ = emissions(symbols(texts), p)
    # a window's first tag may also continue a span that began before it
    open_first = dict(p, first=np.zeros_like(p["first"]))
    tags, post = viterbi(scores, open_first), marginals(scores, open_first)[1]
    out = []
    for b, (row, text) in enumerate(zip(tags, texts)):
        own, spans = np.flatnonzero(row), []
        for t in own.tolist():
            tag = int(row[t])
            if tag % 2 or not spans or spans[-1][2] != t:
                spans.append([(tag - 1) // 2, t, t, 0.0])
            spans[-1][2] = t + 1
            spans[-1][3] += float(post[t, b, tag])
        out.append([(KINDS[k], s, min(e, len(text)), w / (e - s)) for k, s, e, w in spans])
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or sign; every text has one grid of windows."""
    found: set[int] = set()
    for m in _SIGN.finditer(text):
        found.update(range(max(0, m.start() // STRIDE - 1), (m.end() - 1) // STRIDE + 1))
    return [k * STRIDE for k in sorted(found)]


def at_words(text: str, s: int, e: int) -> tuple[int, int]:
    """The span without marks at its edges, out to the ends of words and numbers it cuts;
    an empty span if such a word goes on for more than STRIDE characters."""
    piece = text[s:e]
    s, e = s + len(piece) - len(piece.lstrip(_EDGE)), e - len(piece) + len(piece.rstrip(_EDGE))
    if s >= e:
        return s, s
    before = _TAIL.search(text[max(0, s - STRIDE):s]) if _WORD.match(text, s) else None
    after = _WORD.match(text[e:e + STRIDE]) if _WORD.match(text, e - 1) else None
    left, right = (len(m.group()) if m else 0 for m in (before, after))
    return (s, s) if max(left, right) == STRIDE else (s - left, e + right)


def reconcile(text: str, found, base) -> list[tuple[str, int, int]]:
    """One set of spans from all windows' spans (kind, start, end, confidence, cut)."""
    whole = [x[:4] for x in found if not x[4]]
    chains: list[list] = []
    for kind, s, e, w, _ in sorted(x for x in found if x[4]):
        if chains and chains[-1][0] == kind and s <= chains[-1][2]:
            old = chains[-1]
            old[2], old[3] = max(old[2], e), min(old[3], w)
        else:
            chains.append([kind, s, e, w])
    best: dict[tuple, float] = {}                              # distinct candidates
    for kind, s, e, w in [*whole, *map(tuple, chains)]:
        s, e = at_words(text, s, e)
        if (s < e and w >= CONFIDENCE and _SIGN.search(text, s, e)
                and plausible(kind, text[s:e])):
            best[s, e, kind] = max(w, best.get((s, e, kind), 0))
    fixed = sorted((s, e) for _, s, e in base)
    reach, ends = [], 0
    for s, e in fixed:
        ends = max(ends, e)
        reach.append(ends)                                     # furthest end so far
    begins = [s for s, _ in fixed]

    def free(s, e):
        i = bisect.bisect_left(begins, e)
        return not i or reach[i - 1] <= s

    options = sorted((e, s, k, w * (e - s)) for (s, e, k), w in best.items() if free(s, e))
    stops, value, choice = [o[0] for o in options], [0.0], []
    for i, (_, s, _, w) in enumerate(options):
        j = bisect.bisect_right(stops, s, 0, i)
        choice.append((value[j] + w > value[i], j))
        value.append(max(value[i], value[j] + w))
    out, i = [], len(options)
    while i:
        take, j = choice[i - 1]
        if take:
            out.append((options[i - 1][2], options[i - 1][1], options[i - 1][0]))
        i = j if take else i - 1
    return sorted([*base, *out], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find_spans(texts: list[str | None], p: dict | None):
    """(base spans, all spans) of every whole text."""
    base = [base_spans(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    waiting: list[tuple[int, int]] = []

    def flush():
        pieces = [texts[i][s:s + WIDTH] for i, s in waiting]
        for (i, start), piece, spans in zip(waiting, pieces, decode(pieces, p)):
            for kind, s, e, w in spans:
                cut = s == 0 and start > 0 or e == len(piece) and start + e < len(texts[i])
                found[i].append((kind, start + s, start + e, w, cut))
        waiting.clear()

    for i, text in enumerate(texts):
        for start in window_starts(text) if p is not None and text else ():
            waiting.append((i, start))
            if len(waiting) == WINDOWS:
                flush()
    if waiting:
        flush()
    return [(b, reconcile(t, f, b) if f else b) for t, f, b in zip(texts, found, base)]


# --------------------------------------------------------------------------
# on Spark
# --------------------------------------------------------------------------

_EXCERPT = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("hash", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("spans", T.StringType()),
])
_RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
])


def _quota(kind: str, n: int) -> int:
    return 3 * n if kind == "none" else n


def spelled(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def unspelled(spans: str) -> list[tuple[str, int, int]]:
    parts = (x.split(":") for x in spans.split(",") if x)
    return [(k, int(s), int(e)) for k, s, e in parts]


def _sample(n: int):
    """Each task's distinct excerpts with the least hashes of each kind."""
    def run(frames):
        least: dict[str, list] = {k: [] for k in (*KINDS, "none")}
        held: dict[str, set] = {k: set() for k in least}
        for frame in frames:
            for text in frame.iloc[:, 0]:
                for kind, piece, spans in excerpts(text) if text else ():
                    key = xxhash.xxh64_intdigest(piece.encode("utf-8", "replace")) >> 1
                    heap, own = least[kind], held[kind]
                    if key in own or len(heap) >= _quota(kind, n) and -heap[0][0] < key:
                        continue
                    own.add(key)
                    heapq.heappush(heap, (-key, piece, spelled(spans)))
                    if len(heap) > _quota(kind, n):
                        own.discard(-heapq.heappop(heap)[0])
        yield pd.DataFrame([(k, -h, t, s) for k, heap in least.items() for h, t, s in heap],
                           columns=_EXCERPT.names)
    return run


def labelled(docs: DataFrame, text: str = "text", n: int = EXCERPTS) -> list[Example]:
    """The corpus' labelled excerpts: those of the least hashes, ``n`` a kind."""
    drawn = stored(docs.select(F.col(text).cast("string").alias("text"))
                   .mapInPandas(_sample(n), _EXCERPT), "pii-excerpts")
    drawn = drawn.dropDuplicates(["kind", "hash"])
    ranked = top_k_per_group(drawn, ["kind"], [F.col("hash")], 3 * n, "hash")
    rows = ranked.where((F.col("rank") <= n) | (F.col("kind") == "none")).orderBy(
        "kind", "hash").collect()
    return [(r["text"], unspelled(r["spans"])) for r in rows]


def fit(docs: DataFrame, text: str = "text", n: int = EXCERPTS) -> dict | None:
    return train(with_variants(labelled(docs, text, n)))


def find(docs: DataFrame, model: dict | None, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """doc_id, counts of base spans, their digest and all spans of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)    # a few thousand numbers

    def run(frames):
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            rows = []
            for key, (base, every) in zip(frame["doc_id"], find_spans(texts, shared.value)):
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((None if pd.isna(key) else int(key), *counts,
                             hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(every)))
            out = pd.DataFrame(rows, columns=_RESULT.names)
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text")).mapInPandas(run, _RESULT)

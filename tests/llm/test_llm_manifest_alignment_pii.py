"""Merkle manifest, cross-tokenizer alignment and personal data against brute force."""

import bisect
import collections
import hashlib
import itertools
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from larder.llm import alignment, byte_bpe, merkle, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def key(row):
    return tuple((x is not None, x) if not isinstance(x, bool) else (True, int(x)) for x in row)


# --------------------------------------------------------------------------
# Merkle manifest
# --------------------------------------------------------------------------

def plain_manifest(rows):
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return h(*map(field, (r[0], r[3], r[2], r[4], text)))

    def grow(level):
        levels = [level]
        while len(level) > 1:
            level = [h(*level[i:i + 16]) for i in range(0, len(level), 16)]
            levels.append(level)
        return levels

    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: grow([leaf(r, r[1]) for r in by[s]]) for s in sources}
    top = grow([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            value, proof = leaf(r, text), ""
            for levels, at in ((trees[s], i), (top, n)):
                for level in levels[:-1]:
                    lo = at // 16 * 16
                    left, right = "".join(level[lo:at]), "".join(level[at + 1:lo + 16])
                    value, proof, at = h(left, value, right), proof + left + right, at // 16
            root = top[-1][0]
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, h(proof), value,
                        value == root))
    return sorted(out, key=key)


def documents(n_hot, n_sources):
    rows = [(i, f"Text {i} É" if i % 7 else None, "en" if i % 3 else None, "hot", i)
            for i in range(n_hot)]
    rows += [(1000 + i, "" if i % 2 else "UPPER", "de", f"s{i}", None) for i in range(n_sources)]
    rows += [(None, "no id", "en", None, 5), (None, "no id", "en", None, 5),
             (7, "same id", "en", "hot", 1), (7, "same id", "en", "hot", 1)]
    return rows


@pytest.mark.parametrize("n_hot,n_sources", [(300, 20), (17, 300)])
def test_manifest_equals_plain_trees_and_sql(spark, monkeypatch, n_hot, n_sources):
    monkeypatch.setattr(merkle, "SPAN", 4)
    rows = documents(n_hot, n_sources)
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=key)
    assert got == plain_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=[c.split()[0] for c in DOCS.split(", ")])
                 .astype({"doc_id": "Int64", "n_chars": "Int64"}))
    assert sorted(con.sql(merkle.ORACLE_SQL).fetchall(), key=key) == got


@pytest.mark.parametrize("rows", [
    [], [(5, "One", "en", "a", 3)], [(None, None, None, None, None)],
    [(1, "x", "en", "a", 1), (2, "y", "en", "a", 1)],
    [(i, "x", "en", f"s{i}", 1) for i in range(5)],
    [(1, "Long " * 200_000, "en", "a", 1)] * 3])
def test_manifest_of_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).selectExpr(
        "*", "'x' AS leaf", "1 AS place", "2 AS size", "'k' AS key", "3 AS tree", "0 AS tampered")
    got = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=key)
    assert got == plain_manifest(rows)


# --------------------------------------------------------------------------
# alignment
# --------------------------------------------------------------------------

TEXTS = [None, "", " ", "The cat sat on the mat, naïvely.", "a<|endoftext|>b <s> </s> <0x41>",
         "▁ is lost", "word" * 400, "日本語テキスト 😀 é" * 20, "a\n\nb\r\n c\t  d", "\x00a",
         "The cat sat on the mat, naïvely."] + [f"unequal thing number {i} est" for i in range(30)]


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    public = byte_bpe.public_tokenizers()
    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    letters, rows, per_doc = alignment.byte_letters(), [], []
    for text in texts:
        links, n, string = collections.Counter(), (0, 0, 0), ""
        if text:
            found = a.encode(" " + text, add_special_tokens=False)
            ids_b = b.encode(text)
            bytes_a = [bytes(letters[c] for c in t) for t in found.tokens]
            bytes_b = [alignment.Vocabularies._piece(b.id_to_piece(i)) for i in ids_b]
            if b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
                ends_a = list(itertools.accumulate(map(len, bytes_a)))
                ends_b = list(itertools.accumulate(map(len, bytes_b)))
                cuts = sorted(set(ends_a) & set(ends_b))
                groups = [([], []) for _ in cuts]
                for i, e in zip(found.ids, ends_a):
                    groups[bisect.bisect_left(cuts, e)][0].append(i)
                for i, e in zip(ids_b, ends_b):
                    groups[bisect.bisect_left(cuts, e)][1].append(i)
                for own_a, own_b in groups:
                    links.update(itertools.product(own_a, own_b))
                string = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y))
                                  for x, y in groups)
                n = len(found.ids), len(ids_b), len(cuts)
        rows.append((n, string))
        per_doc.append(links)
    count = collections.Counter(p for links in per_doc for p in links)
    highest = collections.Counter()
    for (i, _), c in count.items():
        highest[i] = max(highest[i], c)
    return [(*n, sum(links.values()), sum(m for p, m in links.items() if count[p] == highest[p[0]]),
             sum(m * count[p] for p, m in links.items()),
             hashlib.sha256(s.encode()).hexdigest() if s else "")
            for (n, s), links in zip(rows, per_doc)]


@pytest.mark.parametrize("sizes", [{}, dict(block_chars=300, slice_chars=100, blocks_a_salt=2)])
def test_alignment_equals_plain_loops(spark, sizes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr(
        "*", "1 AS pair", "'x' AS block", "2 AS docs").repartition(3)
    public = byte_bpe.public_tokenizers()
    got = alignment.align_documents(docs, public.path("byte_bpe_50k.json"),
                                    public.path("piece_bpe_32k.model"), public.PATTERN, **sizes)
    got = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert [got[i] for i in range(len(TEXTS))] == plain_alignment(TEXTS)


def test_alignment_of_odd_tables(spark):
    rows = [(None, "same"), (1, "same"), (1, "same"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.align_public(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_a"] > 0) for r in got) == [
        (0, True), (1, True), (1, True), (2, False)]
    assert {r["count_sum"] for r in got if r["n_a"]} == {3 * got[0]["n_links"] or 3}
    assert alignment.align_public(docs.limit(0)).collect() == []
    assert [tuple(r)[1:] for r in alignment.align_public(docs.where("text is null")).collect()] \
        == [(0, 0, 0, 0, 0, 0, "")]


def test_row_products_equal_dense_products():
    rng = np.random.default_rng(1)
    for products in (1, 7, 10_000):
        for _ in range(20):
            m, k, n = rng.integers(1, 9, 3)
            rows = [(rng.integers(m, size=12), rng.integers(k, size=12)),
                    (rng.integers(k, size=15), rng.integers(n, size=15))]
            a, b = alignment.csr(*rows[0], m, k), alignment.csr(*rows[1], k, n)
            dense = [np.zeros(s, np.int64) for s in ((m, k), (k, n))]
            for d, (r, c) in zip(dense, rows):
                np.add.at(d, (r, c), 1)
            got = alignment.row_products(a, b, products)
            full = np.zeros((m, n), np.int64)
            full[np.repeat(np.arange(m), np.diff(got.starts)), got.indices] = got.data
            assert (full == dense[0] @ dense[1]).all()


# --------------------------------------------------------------------------
# personal data
# --------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            passes = {"email": True,
                      "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                      "card": 13 <= len(digits) <= 19
                      and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                      "phone": 9 <= len(digits) <= 15}[kind]
            if passes:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(5)
    letters = np.array(list("a1+@. -()9.@é\n%4"))
    for _ in range(4000):
        text = "".join(rng.choice(letters, rng.integers(40)))
        assert pii.base_spans(text) == plain_spans(text), text
    text = "x 4111 1111-11111111 y a@b.c@d.e 1.2.3.4.5.6.7.8 +1 (017) 555-7713."
    assert pii.base_spans(text) == plain_spans(text) and len(pii.base_spans(text)) == 5
    assert pii.base_spans(None) == pii.base_spans("") == []


def test_base_rules_take_linear_time():
    start = time.time()
    for text in ("1" * 10 ** 6, "a" * 10 ** 6 + "@", "a@" * 500_000, "1.2.3." * 200_000,
                 "+1 " * 300_000, "+1" + " " * 10 ** 6, "1 -" * 300_000):
        pii.base_spans(text)
        pii.window_starts(text)
    assert time.time() - start < 30


def small_net(seed=0):
    rng = np.random.default_rng(seed)
    p = pii.initial(rng, 4, 3, np.float64)
    for k in ("trans", "first", "out_b"):
        p[k] = rng.standard_normal(p[k].shape)
    return rng, p


def test_crf_equals_enumeration():
    rng, p = small_net()
    scores = rng.standard_normal((4, 2, pii.N_TAGS)) * 2
    log_z, post, _ = pii.marginals(scores, p)
    best = pii.viterbi(scores, p)
    for b in range(2):
        paths = []
        for path in itertools.product(range(pii.N_TAGS), repeat=4):
            if pii.LEGAL_FIRST[path[0]] and all(pii.LEGAL[i, j] for i, j in zip(path, path[1:])):
                paths.append((p["first"][path[0]] + sum(scores[t, b, k] for t, k in enumerate(path))
                              + sum(p["trans"][i, j] for i, j in zip(path, path[1:])), path))
        total = np.logaddexp.reduce([s for s, _ in paths])
        assert abs(total - log_z[b]) < 1e-9
        assert tuple(best[b]) == max(paths)[1]
        for t in range(4):
            for k in range(pii.N_TAGS):
                own = [np.exp(s - total) for s, path in paths if path[t] == k]
                assert abs(sum(own) - post[t, b, k]) < 1e-9


def test_gradients_equal_differences():
    rng, p = small_net(3)
    examples = [("call +1 (017) 555-7713 now", [("phone", 5, 22)]), ("v 4.0", []),
                ("a.b@c.example.com", [("email", 0, 17)])]
    ids, tags = pii.symbols([t for t, _ in examples]), pii.tags_of(examples)
    _, grads = pii.loss_and_gradients(ids, tags, p)
    for name, values in p.items():
        for _ in range(5):
            at = tuple(rng.integers(n) for n in values.shape)
            if name == "embed":
                at = (int(ids[0, rng.integers(20)]), at[1])
            old, found = values[at], []
            for move in (1e-5, -1e-5):
                values[at] = old + move
                found.append(pii.loss_and_gradients(ids, tags, p)[0])
            values[at] = old
            assert abs((found[0] - found[1]) / 2e-5 - grads[name][at]) < 1e-5


def test_windows_are_reconciled_globally():
    rng = np.random.default_rng(8)
    text = "9" * 60
    for _ in range(200):
        found = []
        for _ in range(rng.integers(1, 8)):
            s = int(rng.integers(0, 50))
            found.append(("card", s, s + int(rng.integers(1, 10)), float(rng.uniform(.5, 1)), False))
        base = [("ip", 20, 24)] if rng.integers(2) else []
        at_words, plausible = pii.at_words, pii.plausible
        pii.at_words, pii.plausible = (lambda t, s, e: (s, e)), (lambda k, x: True)
        try:
            got = [x for x in pii.reconcile(text, found, base) if x not in base]
        finally:
            pii.at_words, pii.plausible = at_words, plausible
        weight = {}
        for k, s, e, w, _ in found:
            if all(e <= a or b <= s for _, a, b in base):
                weight[s, e] = max(weight.get((s, e), 0), w * (e - s))
        best = max(sum(weight[x] for x in some) for n in range(len(weight) + 1)
                   for some in itertools.combinations(weight, n)
                   if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2)))
        assert abs(sum(weight[s, e] for _, s, e in got) - best) < 1e-9
    # parts that two windows cut are one span
    card = "x" * 40 + " 4111.1111.1111.1111 " + "y" * 40
    parts = [("card", 41, 48, .9, True), ("card", 46, 60, .8, True)]
    assert pii.reconcile(card, parts, []) == [("card", 41, 60)]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(2, 9))) for _ in range(300)]

    def digits(k):
        return "".join(map(str, rng.integers(0, 10, k)))

    def card():
        body = digits(15)
        return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))
    kinds = [lambda: f"{pii.fresh('abc', rng)}.{digits(2)}@mail{digits(1)}.example.com",
             lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)), card,
             lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: "license version 3.0",
             lambda: f'token = "{hashlib.sha256(bytes([i % 250])).hexdigest()[:40]}"']
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words, 40)).split()
        text[20:20] = [kinds[i % len(kinds)]()]
        out.append(" ".join(text))
    return out


def test_model_finds_written_variants_and_leaves_clean_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(600, 1))],
                                 "doc_id long, text string")
    model = pii.train(pii.with_variants(pii.labelled(docs)))
    held_out = pii.with_variants([x for t in corpus(240, 2) for x in
                                  ((text, spans) for _, text, spans in pii.excerpts(t))], seed=7)
    right = wrong = missed = 0
    for (text, spans), got in zip(held_out, pii.decode([t for t, _ in held_out], model)):
        found = {x[:3] for x in got}
        right += len(found & set(spans))
        wrong += len(found - set(spans))
        missed += len(set(spans) - found)
    assert 2 * right / (2 * right + wrong + missed) > 0.85
    clean = [t for i, t in enumerate(corpus(300, 3)) if i % 6 > 3]
    assert all(not every for _, every in pii.find_spans(clean, model))
    text = "she wrote server 10[.]0[.]0[.]12 is down and call back"
    assert [text[s:e] for _, s, e in pii.find_spans([text], model)[0][1]] == ["10[.]0[.]0[.]12"]
    # the query's rows: base counts and digests, base spans kept
    odd = [(None, None), (1, ""), (2, "x@y.zz 4111111111111111"), (2, "x@y.zz 4111111111111111"),
           (3, "1" * 50_000), (4, "a " * 50_000 + "+1 (017) 555-7713")]
    frame = spark.createDataFrame(odd, "doc_id long, text string").selectExpr(
        "*", "'x' AS spans", "1 AS n_email")
    for r in pii.find(frame, model).collect():
        text = dict(odd)[r["doc_id"]]
        base = plain_spans(text)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(pii.spelled(base).encode()).hexdigest()
        assert set(pii.spelled(base).split(",")) <= set(r["spans"].split(","))
    assert pii.find(frame, model).count() == len(odd)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "plain words"), (2, None)], "doc_id long, text string")
    assert pii.fit(docs) is None and pii.fit(docs.limit(0)) is None
    assert [r["spans"] for r in pii.find(docs, None).collect()] == ["", ""]

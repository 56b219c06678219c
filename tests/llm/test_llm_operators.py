"""The operators against brute force, exact round trips and held-out accuracy."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
import tiktoken
import xxhash
import zlib
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import (byte_bpe, chat, html_text, mixing, neural_lm, quality_mil, quality_rules,
                        queries, simhash, toxicity, winnowing)

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


# --- 1: HTML -----------------------------------------------------------------------------------

def test_html_article_alone():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <aside>Side words here</aside><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Head &amp; line</h1><p>by someone</p></header>
    <p>First   paragraph with <b>bold<b> words, long enough to count as content.<br>More.
    <p>Short.</p><form><label>Mail</label><input></form><script>if (a<b) x("</p>")</script>
    <div class="ad">Buy now</div><p>Last paragraph, again with a good number of words in it.</p>
    <section id="comments"><p>Great article, I liked reading all of it very much.</p></section>
    </article><footer>&copy; 2026</footer></body></html>"""
    assert html_text.extract(page) == (
        "Head & line\nFirst paragraph with bold words, long enough to count as content. More.\n"
        "Short.\nLast paragraph, again with a good number of words in it.")


@pytest.mark.parametrize("name", ["page-with-sidebar", "sidebar-layout", "social-page",
                                  "notice-board"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_html_misleading_wrapper(name, tag):
    body = "A long paragraph of running text that is the main content of this page. " * 3
    page = (f'<div class="{name}"><{tag}><h1>Title</h1><p>{body}</p></{tag}>'
            '<div class="sidebar"><p>Side words</p></div></div><div class="social">Share</div>')
    assert html_text.extract(page) == "Title\n" + body.strip()


@pytest.mark.parametrize("tag", ["div", "header"])
def test_html_hinted_header_keeps_heading(tag):
    page = (f'<article><{tag} class="entry-header"><h1>Title</h1><p>by someone</p></{tag}>'
            "<p>A long paragraph of running text that is the main content.</p></article>")
    assert html_text.extract(page) == (
        "Title\nA long paragraph of running text that is the main content.")


def test_html_without_article_element():
    page = ("<div class=top><a href=a>Home</a> <a href=b>News</a></div><div><h2>Title</h2>"
            "<p>A long paragraph of running text that is the main content of this page.</p>"
            "<p>ok</p></div><div><a href=c>More</a></div>")
    assert html_text.extract(page) == (
        "Title\nA long paragraph of running text that is the main content of this page.\nok")


def test_html_chunks_and_cut_pages():
    page = "<article><p>" + "word &eacute; " * 20_000 + "</p><p>end</p></article>"
    out = html_text.extract(page)
    assert out == " ".join(["word é"] * 20_000) + "\nend"
    for cut in range(1, 60):
        whole = "<article><p>some text</p><!-- c --><p class='x'>more</p></article>"
        assert "<" not in html_text.extract(whole[:cut])


def test_html_query(spark):
    rows = queries.op1_html_extraction(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and r.n_chars > 0 for r in rows)


# --- 2: language model -------------------------------------------------------------------------

def _tiny_vocabulary():
    words = collections.Counter("the cat the dog the end a cat at hand a hat".encode().split())
    total = [(w, n) for w, n in sorted(words.items())]
    mass = collections.defaultdict(lambda: [0, 0])
    for w, n in total:
        mass[neural_lm.ending(w)][0] += n
        mass[neural_lm.ending(w)][1] += 1
    heavy = sorted(mass, key=lambda k: (-mass[k][0], k))[:3]
    top = sorted(total, key=lambda x: (-x[1], x[0]))[:4]
    return neural_lm.build_vocabulary(top, {k: tuple(mass[k]) for k in heavy},
                                      sum(words.values()), len(words), 2)


def _params(vocabulary, hidden=5):
    p = neural_lm.start_parameters(vocabulary, hidden)
    rng = np.random.default_rng(1)
    return {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in p.items()}


def test_lm_gradients_match_differences():
    vocabulary = _tiny_vocabulary()
    p = _params(vocabulary)
    rng = np.random.default_rng(2)
    inputs = rng.integers(0, p["x"].shape[0], (6, 3))
    slots = rng.integers(0, len(vocabulary.slot_class), (6, 3))
    fresh = rng.random((6, 3)) < 0.2
    h = rng.normal(0, 0.3, (3, 5))

    def value(q):
        return neural_lm.window_gradient(q, vocabulary, inputs, slots, fresh, h.copy())[0]

    _, grads, _ = neural_lm.window_gradient(p, vocabulary, inputs, slots, fresh, h.copy())
    for name in p:
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in p[name].shape)
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-3
            down[name][at] -= 1e-3
            assert grads[name][at] == pytest.approx((value(up) - value(down)) / 2e-3, abs=2e-3)


def test_lm_is_a_distribution():
    vocabulary = _tiny_vocabulary()
    p = _params(vocabulary)
    states = np.random.default_rng(3).normal(0, 1, (4, 5))
    n = len(vocabulary.slot_class)
    logp = neural_lm.output(p, vocabulary, np.repeat(states, n, 0), np.tile(np.arange(n), 4), False)
    assert np.exp(logp).reshape(4, n).sum(1) == pytest.approx(np.ones(4))


def test_lm_windows_do_not_matter():
    vocabulary = _tiny_vocabulary()
    p = _params(vocabulary)
    rng = np.random.default_rng(4)
    lengths = np.array([1, 40, 3, 17, 17, 90])
    numbers = rng.integers(0, p["x"].shape[0], lengths.sum())
    extra = rng.normal(0, 1, lengths.sum())
    together = neural_lm.document_scores(p, vocabulary, numbers, extra, lengths, window=7)
    start = 0
    for length, score in zip(lengths, together):
        part = slice(start, start + length)
        alone = neural_lm.document_scores(p, vocabulary, numbers[part], extra[part],
                                          np.array([length]), window=1000)
        assert alone[0] == pytest.approx(score, rel=1e-4)
        start += length


def test_lm_query(spark):
    rows = queries.op2_lm_scoring(spark, MEDIUM).collect()
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r.doc_id: [w.translate(LOWER) for w in WORD.findall(r.text or "")] for r in docs}
    count, ends = collections.Counter(), 0
    for i, words in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(words)
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    base = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))      # noqa: E731
    for r in rows:
        words = tokens[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.train_tokens) == (len(words) + 1, n)
        assert r.n_known == sum(w in count for w in words) + 1
        assert r.base_score == pytest.approx(sum(base(count[w]) for w in words) + base(ends))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# --- 3 and 5: classifiers ----------------------------------------------------------------------

def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = queries.op3_quality_classifier(spark, MEDIUM).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_attention_gradient_learns_from_one_passage():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(200):
        bag = rng.normal(0, 0.1, (rng.integers(1, 6), quality_mil.DIMS)).astype(np.float32)
        if i % 2:
            bag[rng.integers(len(bag)), :10] += 1
        bags.append(bag)
        labels.append(float(i % 2))
    model = quality_mil.train(bags, np.array(labels))
    right = [(model.forward(b, np.array([0]))[0][0] >= 0.5) == y for b, y in zip(bags, labels)]
    assert np.mean(right) > 0.95


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = queries.op5_toxicity(spark, MEDIUM).join(labels, "doc_id").collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    toxic = [r.predicted for r in rows if r.toxic == 1]
    assert np.mean(clean) < 0.02 and np.mean(toxic) > 0.6


def test_pu_risk_finds_the_negatives():
    rng = np.random.default_rng(0)
    x_p = np.zeros((100, 4))
    x_p[np.arange(100), rng.integers(0, 3, 100)] = 1
    x_u = np.zeros((1000, 4))
    hidden = rng.random(1000) < 0.1
    x_u[hidden, rng.integers(0, 3, hidden.sum())] = 1
    x_u[:, 3] = rng.random(1000) < 0.5
    w, b = toxicity.nnpu_fit(x_p, x_u, 0.1, 0)
    assert (((x_u @ w + b) > 0) == hidden).mean() > 0.98


# --- 4: SimHash --------------------------------------------------------------------------------

def _fingerprint(text):
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, bits=4):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_all_pairs(spark, texts):
    prints = {i: _fingerprint(t) for i, t in texts.items()}
    groups = _components(prints)
    for r in queries.op4_simhash_dedup(spark, SMALL).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", groups[r.doc_id])


@pytest.mark.parametrize("max_bits, bucket", [(4, 4_000_000), (4, 20_000), (3, 4_000), (2, 500)])
def test_simhash_links_lose_nothing(spark, max_bits, bucket):
    """Dense clusters, chains and random prints, with and without prefix bits."""
    rng = random.Random(max_bits)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    step = rng.getrandbits(64)
    for _ in range(12):
        prints.add(step)
        step ^= sum(1 << b for b in rng.sample(range(64), max_bits))
    prints |= {rng.getrandbits(64) for _ in range(60)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "fp long")
    links = simhash.links(df, max_bits, bucket).collect()
    unsigned = [(a % (1 << 64), b % (1 << 64)) for a, b in links]
    assert all((a ^ b).bit_count() <= max_bits for a, b in unsigned)
    groups = _components({x: x for x in prints}, max_bits)
    roots = {r.node % (1 << 64): r.root % (1 << 64)
             for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    mine = collections.defaultdict(set)
    for x in prints:
        mine[roots.get(x, x)].add(x)
    true = collections.defaultdict(set)
    for x in prints:
        true[groups[x]].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, true.values()))


# --- 6: winnowing ------------------------------------------------------------------------------

def test_winnowing_guarantee_and_positions(spark):
    rng = random.Random(0)
    shared = [f"w{rng.randint(0, 9)}" for _ in range(winnowing.K + winnowing.W - 1)]
    rows = []
    for i in range(40):
        front = [f"a{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))]
        back = [f"b{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(front + shared + back)))
    df = winnowing.with_selections(spark.createDataFrame(rows, "i int, text string"),
                                   F.col("text"), "sel")
    got = df.select("text", winnowing.hashes("sel").alias("h"),
                    winnowing.positions("sel").alias("p"), "sel").collect()
    common = set.intersection(*[set(r.h) for r in got])
    assert common
    for r in got:
        n = len(r.text.split()) - winnowing.K + 1
        assert r.p == sorted(r.p) and all(0 <= p < n for p in r.p)
        for start in range(n - winnowing.W + 1):
            assert any(start <= p < start + winnowing.W for p in r.p)


def test_winnowing_rightmost_on_ties(spark):
    df = spark.createDataFrame([(" ".join(["same"] * 20),)], "text string")
    got = winnowing.with_selections(df, F.col("text"), "sel").select(
        winnowing.positions("sel").alias("p")).first().p
    assert got == list(range(winnowing.W - 1, 20 - winnowing.K + 1))


# --- 7: chat -----------------------------------------------------------------------------------

def _least_cost(roles):
    """Exhaustive search over every sequence of actions."""
    best = {chat.START: 0.0}
    for role in roles:
        reached = {}
        for state, cost in best.items():
            for path in itertools.chain([()], *(itertools.product((1, 2, 3), repeat=k)
                                                for k in (1, 2, 3))):
                at, ok = state, True
                for step in path:
                    ok = ok and step in chat.NEXT[at]
                    at = step
                if not ok:
                    continue
                filled = cost + chat.COSTS["insert"] * len(path)
                for new in (1, 2, 3):
                    named = 0 if new == role else chat.COSTS["relabel"]
                    if new in chat.NEXT[at]:
                        reached[new] = min(reached.get(new, 1e9), filled + named)
                    if new == at:
                        reached[new] = min(reached.get(new, 1e9),
                                           filled + named + chat.COSTS["merge"])
        best = reached
    return min(c + chat.COSTS["insert"] * len(chat.ENDS[s]) for s, c in best.items())


def test_chat_costs_and_legality(spark):
    rng = random.Random(5)
    names = ["tool", "system", "user", "assistant"]
    roles = {c: [rng.randint(0, 3) for _ in range(rng.randint(1, 9))] for c in range(60)}
    rows = [(c, i, names[r], f"t{i}") for c, own in roles.items() for i, r in enumerate(own)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for bits in (12, 1):                      # whole conversations, and segments of two turns
        pieces = collections.defaultdict(list)
        for r in chat.repair(df, bits).collect():
            pieces[r.conv_id].append(r)
        for c, own in roles.items():
            rows = sorted(pieces[c], key=lambda r: (r.turn_no, r.piece))
            cost = sum(chat.COSTS["insert"] * (r.action == "insert")
                       + chat.COSTS["merge"] * r.action.startswith("merge")
                       + chat.COSTS["relabel"] * r.action.endswith(("relabel", "relabelled"))
                       for r in rows)
            assert cost == _least_cost(own)
            whole = "".join(r.rendered for r in rows)
            said = re.findall(r"<\|(system|user|assistant)\|>\n", whole)
            assert whole.count(chat.END_MARK) == len(said) and said[-1] == "assistant"
            if said[0] == "system":
                said = said[1:]
            assert said == ["user", "assistant"] * (len(said) // 2)
            assert [int(t) for t in re.findall(r"t(\d+)", whole.replace("assistant", ""))] == \
                list(range(len(own)))


# --- 8: mixing ---------------------------------------------------------------------------------

def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3] * 3, 500)
    n = rng.integers(1, 100, 500)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)],
                                    "n long, p array<double>")
    residuals, step, target, reached = mixing.fit_rates(members, 3, np.array([0.2, 0.3, 0.5]),
                                                        keep_all=False)
    assert reached == pytest.approx(target, abs=0.01)
    # the same least squares by a plain projected gradient over all rates at once
    rate, a = np.ones(500), (p * n[:, None] / n.sum())
    for _ in range(len(residuals)):
        gap = a.T @ rate - target
        rate = np.maximum(0, rate - step * (p @ gap + mixing.RIDGE * (rate - 1)))
    assert a.T @ rate == pytest.approx(reached, abs=1e-9)
    assert target == pytest.approx([0.2, 0.3, 0.5])


@pytest.mark.parametrize("shares", [(0.9, 0.07, 0.02, 0.01), (0.6, 0.3, 0.099, 0.001)])
def test_mixing_meets_rare_targets(spark, shares):
    rows = [(int(round(1e6 * s)), [0.997 * (i == d) + 0.003 * share for i, share
                                   in enumerate(shares)]) for d, s in enumerate(shares)]
    members = spark.createDataFrame(rows, "n long, p array<double>")
    _, _, target, reached = mixing.fit_rates(members, 4)
    assert target[3] > 2 * shares[3]
    assert reached == pytest.approx(target, rel=0.01)
    mixing.require_met(target, reached, list("abcd"))
    with pytest.raises(RuntimeError, match="d: "):
        mixing.require_met(target, np.array([*target[:3], 0.2 * target[3]]), list("abcd"))


def test_mixing_query(spark):
    rows = queries.op8_mixing(spark, MEDIUM).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    assert len(rows) == len(langs)
    assert np.mean([r.top_domain == langs[r.doc_id] for r in rows]) > 0.97


# --- 9: BPE ------------------------------------------------------------------------------------

def test_bpe_matches_tiktoken(spark, texts):
    tokenizers = byte_bpe.public_tokenizers()
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN,
                                mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = byte_bpe.encode_documents(docs, path, tokenizers.PATTERN, block_chars=50_000).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    merger, rng = byte_bpe.Merger(byte_bpe.load_ranks(path)), random.Random(1)
    for n in (1, 3, 20, 63, 64, 65, 500, 3_000):
        piece = "".join(rng.choice("aabé$ the") for _ in range(n)).replace(" ", "").encode()
        if piece:
            assert merger.encode(piece) == library._encode_single_piece(piece)


# --- 10: quality rules -------------------------------------------------------------------------

def test_repeated_words_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        runs = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1
                  for j in range(i, i + 8)}
        assert quality_rules.repeated_words(np.array([ord(w) - 97 for w in words])) == len(inside)


def test_rules_counts(spark, texts):
    for r in queries.op10_quality_rules(spark, SMALL).collect():
        text = texts[r.doc_id]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r.n_words == len(words) and r.word_chars == sum(map(len, words))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_mcd_resists_outliers(spark):
    """A fifth of a group far away neither moves the estimate nor is kept."""
    rng = np.random.default_rng(0)
    d = len(quality_rules.DIMS)
    x = rng.normal(0.0, 1.0, (1_000, d))
    x[:200] += 25
    rows = [("g", *map(float, v)) for v in x]
    vectors = spark.createDataFrame(rows, "group string, " + ", ".join(
        f"{c} double" for c in quality_rules.DIMS))
    estimate = quality_rules.robust_estimates(vectors).first()
    assert np.abs(np.array(estimate.centre)).max() < 0.3
    precision = np.array(estimate.precision).reshape(d, d)
    gap = x - np.array(estimate.centre)
    distance = np.einsum("ni,ij,nj->n", gap, precision, gap)
    assert (distance[:200] > quality_rules.CUTOFF).all()
    assert (distance[200:] <= quality_rules.CUTOFF).all()


def test_mcd_resists_a_third_of_copies(spark):
    rng = np.random.default_rng(1)
    d = len(quality_rules.DIMS)
    x = rng.normal(0.0, 1.0, (1_000, d))
    x[:340] = 4.0
    vectors = spark.createDataFrame([("g", *map(float, v)) for v in x], "group string, " + ", ".join(
        f"{c} double" for c in quality_rules.DIMS))
    estimate = quality_rules.robust_estimates(vectors).first()
    gap = x - np.array(estimate.centre)
    distance = np.einsum("ni,ij,nj->n", gap, np.array(estimate.precision).reshape(d, d), gap)
    assert (distance[:340] > quality_rules.CUTOFF).all()
    assert (distance[340:] <= quality_rules.CUTOFF).all()


def test_rules_judge_rare_groups(spark):
    """A rare source, language or null language is judged by its language or the corpus."""
    rng = random.Random(4)
    words = "the of and stone river garden winter people market mountain house letter".split()

    def clean():
        return " ".join(rng.choice(words) for _ in range(60))

    rows = [("en", "big", clean()) for _ in range(150)]
    for lang, source in (("en", "rare"), ("xx", "a"), (None, None)):
        rows += [(lang, source, clean()) for _ in range(10)]
        rows += [(lang, source, clean().upper().replace(" ", " ## "))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "doc_id long, lang string, source string, text string")
    found = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(found) == len(rows)
    for i, (_, _, text) in enumerate(rows):
        assert not found[i].base_failed and found[i].distance is not None
        assert found[i].kept == ("##" not in text)


def test_rules_keep_good_documents(spark):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    rows = queries.op10_quality_rules(spark, MEDIUM).join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.3


def test_rules_reject_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality_rules.judge(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.99
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.01


# --- pipeline ----------------------------------------------------------------------------------

def test_pipeline_decisions(spark):
    docs = corpus_pipeline.table(spark, MEDIUM, "documents")
    labels = {r.doc_id: r for r in corpus_pipeline.table(spark, MEDIUM, "labels").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "tokens" else None
        docs = corpus_pipeline.stored(stage(spark, docs, MEDIUM), f"test-{name}")
        kept[name] = [r.doc_id for r in docs.collect()]
        if name == "near_dedup":
            groups = _components({i: _fingerprint(t) for i, t in before.items()})
            assert sorted(kept[name]) == sorted(set(groups.values()))
        if name == "mixing":
            assert set(kept[name]) == set(before) and len(kept[name]) > len(before)
    good = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert np.mean([i in set(kept["toxicity"]) for i in good]) > 0.97
    assert not [i for i, r in labels.items() if r.quality == 0 and i in set(kept["quality"])][3:]
    assert sorted(kept["tokens"]) == sorted(kept["mixing"])

"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import (byte_bpe, chat, html_text, mixing, neural_lm, quality_mil, quality_rules,
                        simhash, toxicity, winnowing)

CLASH = ("score", "fp", "group", "n", "_mix", "root", "word", "key", "sel", "positive")
DOCS = [
    (1, "the cat sat on the mat and looked at the quiet garden", "en", "a", 53),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "de", "b", 4),
    (5, "word " * 30_000, "en", "a", 150_000),
    (6, "x" * 60_000, "en", "a", 60_000),
    (7, "the cat sat on the mat and looked at the quiet garden", "en", "a", 53),
    (8, "naïve café — über 漢字 \U0001f600 straße", "fr", "c", 35),
    (8, "naïve café — über 漢字 \U0001f600 straße", "fr", "c", 35),
    (9, "one", "en", "a", 3),
    (None, "a row without an id but with text", "en", "a", 33),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = [(1, 1, 0), (7, 1, 0), (5, 0, 1), (6, 0, None), (9, None, 1), (9, 1, 0), (None, 1, 1),
          (77, 1, 1), (8, 1, 0), (4, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn(
        "text", F.lit("clash"))


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=str)


WANTED = sorted((d[0] for d in DOCS), key=str)


def test_html(spark):
    pages = spark.createDataFrame([
        (1, "u", "<p>a  b</p><p>&amp; c"), (2, None, None), (3, "u", ""), (None, "u", "plain"),
        (1, "u", "<p>a  b</p><p>&amp; c"), (4, "u", "<p>" + "long " * 200_000)],
        "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_text.extract_pages(pages).collect()
    assert len(rows) == 6
    assert [r.text for r in rows if r.page_id == 1] == ["a b\n& c"] * 2
    assert [(r.text, r.n_chars) for r in rows if r.page_id in (2, 3)] == [("", 0)] * 2
    assert next(r.n_chars for r in rows if r.page_id == 4) == 999_999
    assert html_text.extract_pages(pages.where("false")).count() == 0


def test_lm(docs, none):
    rows = neural_lm.score_documents(docs).collect()
    assert sorted((r.doc_id for r in rows), key=str) == WANTED
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert all(r.score < 0 and r.base_score < 0 for r in rows)
    same = [r.score for r in rows if r.doc_id in (1, 7)]
    assert same[0] == pytest.approx(same[1])
    assert neural_lm.score_documents(none).count() == 0


def test_lm_without_training_rows(spark):
    held = [i for i in range(200) if neural_lm.id_remainder(i, 5) == 1][:3]
    df = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    rows = neural_lm.score_documents(df).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0 for r in rows)


@pytest.mark.parametrize("module", [quality_mil, toxicity])
def test_classifiers(docs, none, labels, module):
    model = module.fit(docs, labels)
    rows = module.score(docs, model).collect()
    assert sorted((r.doc_id for r in rows), key=str) == WANTED
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 7)}) == 1
    keep = quality_mil.keep_good if module is quality_mil else toxicity.drop_toxic
    assert keep(docs, model).columns == docs.columns
    empty = module.fit(none, labels)
    assert module.score(none, empty).count() == 0
    unlabelled = module.fit(docs, labels.where("false"))
    assert module.score(docs, unlabelled).count() == len(DOCS)


def test_simhash(docs, none):
    found = simhash.near_duplicates(docs)
    rows = found.collect()
    assert sorted((r.doc_id for r in rows), key=str) == WANTED
    zero = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert {(r.fingerprint, r.component_id) for r in zero} == {("0" * 16, 2)}
    assert {r.component_id for r in rows if r.doc_id in (1, 7)} == {1}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted([1, 2, 5, 6, 8, 9, None], key=str)
    assert simhash.keep_one(none).count() == 0


def test_winnowing(docs, none):
    rows = winnowing.fingerprint_documents(docs).collect()
    assert sorted((r.doc_id for r in rows), key=str) == WANTED
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 7)}) == 1
    # in order: null ids, 1 ... 8 (one place for both rows), 9, and round again
    texts = {d[0]: d[1] or "" for d in DOCS if d[0] is not None}
    order = sorted(texts)
    for a, b in zip(order[:-1], order[1:]):
        n = len(texts[a]) // 4
        edited = texts[a][:len(texts[a]) - n] + texts[b][:n]
        got = {(r.n_chars, r.edited_sha256) for r in rows if r.doc_id == a}
        assert got == {(len(texts[a]), hashlib.sha256(edited.encode()).hexdigest())}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert winnowing.fingerprint_documents(none).count() == 0


def test_winnowing_single_document(spark):
    df = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    row = winnowing.fingerprint_documents(df).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, 0, " User ", "hi"), (1, 1, None, "who?"), (1, None, "assistant", None),
         (None, 0, "user", "x"), (None, 0, "user", "x"), (2, 5, "system", "s")],
        "conv_id long, turn long, role string, text string").withColumn("a", F.lit("clash"))
    rows = chat.repair(turns).collect()
    assert {r.conv_id for r in rows} == {1, 2, None}
    assert sum(r.action not in ("insert", "end") for r in rows) == 6
    assert sum(r.action == "end" for r in rows) == 3
    assert chat.repair(turns.where("false")).count() == 0


def test_mixing(docs, none, labels):
    rows = mixing.rates(docs, labels).collect()
    assert sorted((r.doc_id for r in rows), key=str) == WANTED
    assert all(r.rate >= 0 and sum(r.posterior) == pytest.approx(1) for r in rows)
    mixed = mixing.resample(docs, labels)
    assert mixed.columns == docs.columns
    assert set(ids(mixed)) == set(WANTED)
    assert mixing.rates(none, labels).count() == 0
    assert {r.rate for r in mixing.rates(docs, labels.where("false")).collect()} == {1.0}


def test_bpe(docs, none):
    tokenizers = byte_bpe.public_tokenizers()
    args = (tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    rows = byte_bpe.encode_documents(docs, *args, block_chars=1_000).collect()
    assert sorted((r.doc_id for r in rows), key=str) == WANTED
    texts = {d[0]: d[1] or "" for d in DOCS if d[0] is not None}
    assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in rows if r.doc_id is not None)
    digests = byte_bpe.encode_documents(docs, *args, digests=True).collect()
    by_id = {r.doc_id: r for r in rows}
    for r in digests:
        if r.doc_id is not None:
            own = by_id[r.doc_id].ids
            assert r.n_tokens == len(own)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
    assert byte_bpe.encode_documents(none, *args).count() == 0


def test_quality_rules(docs, none):
    rows = quality_rules.judge(docs).collect()
    assert sorted((r.doc_id for r in rows), key=str) == WANTED
    assert all(r.base_failed and not r.kept for r in rows)
    assert {(r.n_words, r.n_repeat_words) for r in rows if r.doc_id == 5} == {(30_000, 30_000)}
    assert quality_rules.judge(none).count() == 0


def test_pipeline_stages(spark, docs, none, labels, tmp_path):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels.select("doc_id", "quality", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    for start in (base, none.select(*base.columns)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = corpus_pipeline.stored(stage(spark, at, str(tmp_path)), f"test-{name}")
            if name != "tokens":
                assert at.columns == base.columns
        assert at.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

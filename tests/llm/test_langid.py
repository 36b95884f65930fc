import random
from itertools import product

import numpy as np
import pytest
import zlib

from litspark.llm import langid as L


def brute_viterbi(scores, penalty):
    best = None
    for path in product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(scores[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        best = value if best is None else max(best, value)
    return best


def test_labels_are_an_optimal_path():
    rng = np.random.default_rng(1)
    for _ in range(150):
        scores = rng.normal(0, 4, (rng.integers(1, 8), 3))
        path, penalty = L.label_words(scores, 5.0), 5.0
        value = scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()
        assert value == pytest.approx(brute_viterbi(scores, penalty))


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("crc32(cast(doc_id AS string)) % 5 <> 0")
    return L.train(docs.select("lang", "text"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixed_text_is_labelled_in_spans(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("crc32(cast(doc_id AS string)) % 5 = 0")
    text = {}
    for r in docs.where("lang in ('en', 'fr', 'de', 'es') and n_chars between 600 and 4000").collect():
        text.setdefault(r["lang"], r["text"])
    parts = [(lang, L.tokens_of(text[lang])[:80]) for lang in ("en", "fr", "en", "de")]
    mixed = " ".join(w.decode() for _, words in parts for w in words)
    spans = L.spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).orderBy("first_word").collect()
    truth = [lang for lang, words in parts for _ in words]
    got = [r["lang"] for r in spans for _ in range(r["end_word"] - r["first_word"])]
    assert sum(a == b for a, b in zip(got, truth)) / len(truth) > 0.95 and len(got) == len(truth)


def test_scripts_narrow_the_candidates(spark):
    rows = [("ru", "привет как дела мир"), ("el", "καλημέρα κόσμε τι κάνεις"), ("en", "hello how are you world")] * 5
    m = L.train(spark.createDataFrame(rows, "lang string, text string"))
    out = L.predict(spark.createDataFrame([(1, "дела"), (2, "κόσμε"), (3, "world"), (4, "日本")], "doc_id long, text string"), m)
    got = {r["doc_id"]: r["lang_pred"] for r in out.collect()}
    assert got[1] == "ru" and got[2] == "el" and got[3] == "en" and got[4] in ("ru", "el", "en")


def test_messy_rows(messy, nothing, spark, model):
    out = L.identify(messy)
    rows = out.collect()
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(rows) == messy.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[4]["lang_pred"] == by[5]["lang_pred"] == by[6]["lang_pred"] == "und" and by[4]["score"] == 0
    assert L.identify(nothing).count() == 0
    blank = L.train(nothing.select("lang", "text"))
    assert {r["lang_pred"] for r in L.predict(messy, blank).collect()} == {"und"}
    signs = spark.createDataFrame([(1, "123 … — 45")], "doc_id long, text string")
    assert L.predict(signs, model).first()["lang_pred"] == "und"


def test_model_size_is_bounded():
    for n in (1, 4, 200, 20_000):
        assert 2 * n * L.model_cells(n) <= max(L.MODEL_CELLS, 4 * n)


def test_cache_limit_does_not_change_results(model, monkeypatch, sample):
    texts = [r["text"] for r in sample.limit(30).collect()]
    want = [L.Tagger(model, 16.0).predict(t) for t in texts]
    monkeypatch.setattr(L, "KNOWN_WORDS", 50)
    tagger = L.Tagger(model, 16.0)
    random.Random(1).shuffle(texts)
    assert sorted(map(str, want)) == sorted(str(tagger.predict(t)) for t in texts)

import math
import random
from collections import Counter, defaultdict

import pytest

from litspark.llm import common
from litspark.llm import kneser_ney as K
from litspark.llm.common import stratum_of


class Brute:
    """Interpolated modified Kneser-Ney over the symbols of texts, from plain dictionaries."""

    def __init__(self, texts, order):
        self.order, self.c = order, {order: Counter()}
        for text in texts:
            for gram in self.grams(text):
                self.c[order][gram] += 1
        for k in range(order - 1, 0, -1):
            self.c[k] = Counter()
            for g, n in self.c[k + 1].items():
                self.c[k][g[1:]] += n if g[1] == 2 else 1
        self.d, self.ctx = {}, {}
        for k, c in self.c.items():
            n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
            self.d[k] = [min(i + 1.0, max(0.0, i + 1 - (i + 2) * y * n[i + 1] / n[i])) if n[i] and n[0] else 0.0 for i in range(3)]
            ctx = defaultdict(list)
            for g, v in c.items():
                ctx[g[:-1]].append(v)
            self.ctx[k] = ctx

    def grams(self, text):
        words = " ".join((text or "").split())
        s = [2] * (self.order - 1) + [ord(x) % 4096 for x in words] + [3]
        return [tuple(s[i - self.order + 1:i + 1]) for i in range(self.order - 1, len(s))] if words else []

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / 4096
        seen = self.ctx[k].get(g[:-1])
        lower = self.p(g[1:])
        if not seen:
            return lower
        d = lambda n: self.d[k][min(n, 3) - 1]
        n = self.c[k].get(g, 0)
        return ((n - d(n)) if n else 0) / sum(seen) + sum(map(d, seen)) / sum(seen) * lower

    def perplexity(self, text):
        grams = self.grams(text)
        return math.exp(-sum(math.log(self.p(g)) for g in grams) / len(grams)) if grams else None


@pytest.mark.parametrize("order,chunk", [(2, 16_000_000), (4, 3000), (5, 16_000_000)])
def test_perplexities_match_plain_dictionaries(spark, sample, order, chunk, monkeypatch):
    monkeypatch.setattr(K, "CHUNK_CHARS", chunk)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r["doc_id"] for r in K.trusted_ids(labels).collect()}
    rows = sample.select("doc_id", "text").limit(60).collect()
    scored = K.perplexities(sample, labels, order).collect()
    got = {r["doc_id"]: r["perplexity"] for r in scored}
    held = {r["doc_id"] for r in scored if r["held_out"]}
    assert len(got) == sample.count() and 0 < len(held & good) < len(good - held)
    brute = Brute([r["text"] for r in sample.collect() if r["doc_id"] in good - held], order)
    for r in rows:
        assert got[r["doc_id"]] == pytest.approx(brute.perplexity(r["text"]), rel=1e-9)


def test_probabilities_sum_to_one(spark, sample):
    order = 3
    model = K.Orders(K.count_ngrams(sample.limit(20), order), order)
    for context in ((2, 2), (ord("t"), ord("h")), (ord("~"), ord("~"))):
        grams = [((context[0] << 12 | context[1]) << 12) | c for c in range(4096)]
        out = model.probabilities(spark.createDataFrame([(g,) for g in grams], "gram long"))
        assert sum(math.exp(r["logp"]) for r in out.collect()) == pytest.approx(1.0)


def test_blocks_cover_each_symbol_once(monkeypatch):
    texts = [None, "one two  three", "", "\n", "a", "b" * 50, "four\nfive"]
    whole = [(o, g) for owner, grams in K.gram_blocks(texts, 3) for o, g in zip(owner.tolist(), grams.tolist())]
    want = [(i, sum(s << 12 * (2 - j) for j, s in enumerate(g))) for i, t in enumerate(texts) for g in Brute([], 3).grams(t)]
    assert whole == want
    monkeypatch.setattr(K, "BLOCK_SYMBOLS", 7)
    parts = list(K.gram_blocks(texts, 3))
    assert len(parts) > 5 and [(o, g) for owner, grams in parts for o, g in zip(owner.tolist(), grams.tolist())] == want


def test_shuffled_words_score_worse(spark):
    """The same words in another order: a model that reads across words tells them apart."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = {r["doc_id"] for r in K.trusted_ids(labels).collect()}
    shuffle = random.Random(5)
    mixed = []
    for r in rows:
        words = (r["text"] or "").split()
        if r["doc_id"] in good and len(words) >= 20:
            shuffle.shuffle(words)
            mixed.append((-r["doc_id"] - 1, " ".join(words), r["lang"]))
    docs = common.materialise(spark.createDataFrame([*map(tuple, rows), *mixed], "doc_id long, text string, lang string"), "mixed")
    got = {r["doc_id"]: r for r in K.perplexities(docs, labels).collect()}
    pairs = [(got[i]["perplexity"], got[-i - 1]["perplexity"]) for i, *_ in mixed if got[-i - 1]["held_out"]]
    assert len(pairs) > 20 and sum(a > b for a, b in pairs) >= 0.9 * len(pairs)


def test_junk_is_rejected_and_good_text_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r["doc_id"]: r for r in K.classify(docs, labels).collect()}
    truth = [(r["quality"], out[r["doc_id"]]["kept"]) for r in labels.collect()]
    assert len(out) == 1000
    assert sum(k for q, k in truth if q) / sum(q for q, _ in truth) > 0.97
    assert sum(not k for q, k in truth if not q) / sum(not q for q, _ in truth) > 0.85


def test_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    docs = common.materialise(messy.select("doc_id", "text", "lang", "stratum", "chunk", "gram"), "messy")
    rows = K.classify(docs, labels).collect()
    assert len(rows) == messy.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[4]["perplexity"] is None and not by[4]["kept"] and by[1]["kept"]
    assert by[8]["stratum"] == stratum_of("xx-long-code") == "other"
    assert K.classify(nothing, labels).count() == 0
    untrained = K.classify(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (r["perplexity"] is not None) for r in untrained)
    assert {round(r["perplexity"], 6) for r in untrained if r["perplexity"]} == {4096.0}

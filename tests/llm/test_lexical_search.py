"""Reversed search against a plain scorer over all pairs of item and document."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from litspark.llm import lexical_search
from tests.llm.conftest import CLASHING

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall(text.translate(FOLD)) if text else []


def plain_search(docs, items, k=10):
    bags = [(doc, terms(text)) for doc, text in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(w in b for _, b in bags) + 1))) for w in words}
        found = []
        for doc, bag in bags:
            m = 10 + (90 * len(bag) * n_docs) // max(total, 1)
            score = sum(weight[w] * ((10 ** 9 * bag.count(w)) // (1000 * bag.count(w) + 8 * m)) for w in words if w in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    return [x.withColumns({c: F.lit(c) for c in CLASHING + ["term", "n", "item"]}) for x in (d, i)]


DOCS = [(i, " ".join(random.Random(i).choices(["Red", "grün", "ünï", "b2", "x_y", "Été", "the", "a.b"], k=i % 23))) for i in range(150)]
MESSY = DOCS + [(900, None), (901, ""), (902, "…-–"), (None, "red the the"), (None, "red the the"), (903, "red the the"), (903, "red the the"),
                (904, "long " * 30_000 + "red")]
ITEMS = [(1, "The RED b2"), (2, "grün x"), (2, "y ünï"), (3, None), (4, "!!"), (None, "été a"), (5, "absent words"), (6, "the the the")]


@pytest.mark.parametrize("block_terms", [1, 4, 500_000])
def test_same_as_all_pairs(spark, block_terms):
    docs, items = frames(spark, MESSY, ITEMS)
    assert rows_of(lexical_search.search(docs, items, block_terms=block_terms)) == plain_search(MESSY, ITEMS)


def test_small_score_blocks_and_k(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SCORES", 7)
    docs, items = frames(spark, DOCS, ITEMS)
    assert rows_of(lexical_search.search(docs, items, k=3)) == plain_search(DOCS, ITEMS, 3)


def test_ties_go_to_the_smallest_ids_whatever_the_task(spark):
    docs = [(i, "same words here") for i in range(400, 0, -1)] + [(1000 + i, f"other {i}") for i in range(400)]
    given, items = frames(spark, docs, [(1, "words")])
    assert [r[2] for r in sorted(map(tuple, lexical_search.search(given, items).collect()), key=lambda r: r[1])] == list(range(1, 11))


def test_empty_tables(spark):
    docs, items = frames(spark, DOCS, ITEMS)
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0


def test_products_beyond_64_bits():
    import numpy as np
    lengths, n_docs, total = np.array([10 ** 9, 5]), 10 ** 12, 10 ** 13
    assert lexical_search.lengths_of(lengths, n_docs, total).tolist() == [10 + 90 * n * n_docs // total for n in lengths.tolist()]

"""Ranked lexical search, reversed: items wait in an index, documents stream past.

The items' terms become an inverted index (term → items), which is sent to the
tasks. Each task counts the terms of its documents, looks the counts up in the
index, adds up the scores of (document, item) pairs and keeps the best ``k``
documents of each item in a bounded heap. A task returns its heaps only; they are
merged in two steps, first within groups of tasks, so no item's rows meet in one
task in proportion to the tasks there are.

A first pass over the documents counts what the weights need: documents with a
term, their terms, and the documents that hold each of the items' terms.

Terms are the maximal runs of ASCII letters, digits and non-ASCII characters, with
A-Z in lower case. In UTF-8 these are runs of bytes, so texts are taken as bytes.

The items are a stated query set. They are read in blocks of at most
``block_terms`` terms; each block is one index and one pair of passes, so a larger
set means more passes and never a larger broadcast. An item with more terms is a
block by itself. In a batch the scores are held for at most ``SCORES`` (document,
item) pairs at a time.

Defined cases: null texts have no terms; an item without a term, or none of whose
terms is in a document, has no rows; rows that share an item_id (null included) are one
item with the terms of all; every document row is a document of its own, so a
repeated row is ranked as often as it occurs; a null doc_id comes after every other
of the same score; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.llm import common

K = 10
BLOCK_TERMS = 500_000
SCORES = 4 << 20
MERGE_GROUPS = 256
NO_ID = np.iinfo(np.int64).max
RESULT = "item_id long, rank int, doc_id long, score long"

#: every byte that belongs to no term becomes a space, A-Z become a-z
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass
class Index:
    """A bounded part of the items: their ids, the numbers of their terms, and the items of each term."""

    items: list
    terms: dict[bytes, int]
    starts: np.ndarray
    postings: np.ndarray

    @staticmethod
    def build(items: dict) -> "Index":
        terms: dict[bytes, int] = {}
        of_term, of_item = [], []
        for i, words in enumerate(items.values()):
            for word in sorted(words):
                of_term.append(terms.setdefault(word, len(terms)))
                of_item.append(i)
        numbers = np.array(of_term, np.int64)
        order = np.argsort(numbers, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(numbers, minlength=len(terms)))]).astype(np.int64)
        return Index(list(items), terms, starts, np.array(of_item, np.int64)[order])


def index_blocks(items: DataFrame, block_terms: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The items in blocks, rows of one id together, read one partition at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))
    block: dict = {}
    size = 0
    for row in rows.orderBy("item").toLocalIterator():
        words = set(terms_of(row["text"]))
        if size and size + len(words) > block_terms and row["item"] not in block:
            yield Index.build(block)
            block, size = {}, 0
        size += len(words - block.get(row["item"], set()))
        block.setdefault(row["item"], set()).update(words)
    if size:
        yield Index.build(block)


def batch_counts(texts: pa.Array, terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each document with repeats, and (document, term number, occurrences) of those in ``terms``."""
    lengths, found = [], []
    for i, text in enumerate(texts.to_pylist()):
        words = terms_of(text)
        lengths.append(len(words))
        numbers = np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))
        numbers, tf = np.unique(numbers[numbers >= 0], return_counts=True)
        found.append((np.full(len(numbers), i, np.int64), numbers, tf))
    doc, term, tf = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    return np.array(lengths, np.int64), doc, term, tf


def corpus_counts(docs: DataFrame, terms: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """N, L and the document count of each of ``terms``, over all documents (rows: text as bytes)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            lengths, _, term, _ = batch_counts(batch.column("text"), shared.value)
            n, total = n + int((lengths > 0).sum()), total + int(lengths.sum())
            df += np.bincount(term, minlength=len(df))
        some = np.flatnonzero(df)
        rows = [np.concatenate([[-1, -2], some]), np.concatenate([[n, total], df[some]])]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["term", "n"])

    rows = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, said = np.zeros(len(terms), np.int64), {-1: 0, -2: 0}
    for term, n in rows:  # at most one row per term of the block
        if term < 0:
            said[term] = n
        else:
            df[term] = n
    return said[-1], said[-2], df


def weights_of(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def lengths_of(lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of each document; in Python's integers where 64 bits would not hold the product."""
    if 90 * n_docs * int(lengths.max(initial=0)) < 1 << 63:
        return 10 + (90 * n_docs * lengths) // max(total, 1)
    return np.array([10 + (90 * n * n_docs) // total for n in lengths.tolist()], np.int64)


class Heaps:
    """The best ``k`` documents of each item so far; equal scores by ascending id."""

    def __init__(self, n_items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n_items)]
        # score and id that a document must beat
        self.score, self.doc = np.zeros(n_items, np.int64), np.full(n_items, -1 << 63, np.int64)

    def update(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: one row per document, one column per item."""
        better = (scores > self.score) | ((scores == self.score) & (docs[:, None] < self.doc))
        for row, item in zip(*(x.tolist() for x in np.nonzero(better))):
            heap, entry = self.heaps[item], (int(scores[row, item]), -int(docs[row]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.score[item], self.doc[item] = heap[0][0], -heap[0][1]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for item, heap in enumerate(self.heaps):
            for score, doc in heap:
                yield item, -doc, score


def _search_block(docs: DataFrame, index: Index, k: int) -> DataFrame:
    n_docs, total, df = corpus_counts(docs, index.terms)
    shared = docs.sparkSession.sparkContext.broadcast((index, weights_of(n_docs, df)))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight = shared.value
        heaps, n_items = Heaps(len(own.items), k), len(own.items)
        step, fan = max(1, SCORES // n_items), np.diff(own.starts)
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").fill_null(NO_ID))
            lengths, doc, term, tf = batch_counts(batch.column("text"), own.terms)
            m = lengths_of(lengths, n_docs, total)
            gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            for first in range(0, len(ids), step):
                lo, hi = np.searchsorted(doc, [first, first + step])
                many, scores = fan[term[lo:hi]], np.zeros((min(step, len(ids) - first), n_items), np.int64)
                place = np.repeat(own.starts[term[lo:hi]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                np.add.at(scores.reshape(-1), np.repeat((doc[lo:hi] - first) * n_items, many) + own.postings[place],
                          np.repeat(gain[lo:hi], many))
                heaps.update(ids[first: first + step], scores)
        rows = list(zip(*heaps.rows())) or [[]] * 3
        group = TaskContext.get().partitionId() % MERGE_GROUPS
        found = pa.array(rows[1], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([own.items[i] for i in rows[0]], pa.int64()), pa.array([group] * len(found), pa.int32()),
             pa.array([None if d == NO_ID else d for d in rows[1]], pa.int64()), pa.array(rows[2], pa.int64())],
            names=["item_id", "part", "doc_id", "score"])

    heaps = docs.mapInArrow(stream, "item_id long, part int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(
        F.col("rank") <= k)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score above 0 of every item."""
    common.bound_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    out = None
    for index in index_blocks(items, block_terms):
        part = _search_block(given, index, k)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
tot AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM len),
item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, tot GROUP BY term, nn),
m AS (SELECT doc_id, 10 + (90 * n * nn) // ll AS m FROM len, tot),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM item_terms JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

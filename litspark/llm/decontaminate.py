"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are the ``\\w+`` runs of the lower-cased text. Each n-gram of a test item
is a seed. A first pass over all documents counts how many of them hold each
seed; a seed is rare when that count is at most ``RARE_FACTOR`` times the median
over its item's seeds that any document holds (or at most ``RARE_FLOOR``). The
second pass joins the documents' n-grams to the seeds and aligns the words
around each cluster of hits with the item: match +1, mismatch and gap -1,
divided by the item's length. Documents at ``MIN_SCORE`` or above are
contaminated.

Rarity decides the cost, not the result: an item of which a document holds only
common seeds is aligned with it too where the document holds enough of the
item's words. The score is at most the share of the item's words that are in
the text, so the words left out by that test could not have reached the limit.

The benchmark is a stated query set and is taken in blocks of at most
``block_words`` words, each broadcast to one pass over the documents; a larger
benchmark means more passes, never a larger broadcast. Documents are not
shuffled, so a passage that a third of them share costs no skew.

Seeds are ``SEED_WORDS`` (three) words of an item, or two where it has no more than
``SHORT_ITEM`` (eight), found in a document in a row or with one more word before
the last. In a copy that scores 0.5 some seed is always left (README), so the seeds
miss nothing that the alignment would find.

Texts are hashed and searched in groups laid end to end, so the cost of a step is
shared by many short texts.

Defined cases: null, empty and wordless texts or items match nothing; items
shorter than a seed use one seed of their own length; an item of any length is
aligned whole and scored against its whole length, and one of more than
``block_words`` words is a block by itself; equal items are reported each under its own id; of
repeated rows with one doc_id the best score is reported; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from litspark.llm import common

SEED_WORDS = 3
SHORT_ITEM = 8
MIN_SCORE = 0.5
RARE_FACTOR = 20
RARE_FLOOR = 100
BLOCK_WORDS = 500_000
FILTER_BITS = 22

#: Texts are searched in groups of about this many words.
GROUP_WORDS = 1 << 19

_WORD = re.compile(r"\w+")
_SIGN = re.compile(r"[^\w\x00-\x7f]")
#: ASCII characters outside words become spaces; the bytes of all others stay
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """word in UTF-8 → 64-bit hash, forgetting everything when it holds ``most`` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def hash_words(text: str | None, known: WordHash) -> np.ndarray:
    """Hashes of ``words_of(text)``, split as bytes."""
    if not text:
        return np.empty(0, np.uint64)
    low = text.lower()
    words = (low if low.isascii() else _SIGN.sub(" ", low)).encode().translate(_SPACED).split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def ngram_hashes(hashes: np.ndarray, n: int, gaps: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """For each gap, one hash per run of n words of which the last is ``gap`` words further on."""
    start = hashes[: max(0, len(hashes) - n + 1)].copy()
    for i in range(1, n - 1):
        start = (start ^ (start >> np.uint64(29))) * _MIX + hashes[i: len(start) + i]
    if n == 1:
        return [start ^ (start >> np.uint64(32))]
    start = (start ^ (start >> np.uint64(29))) * _MIX
    out = []
    for gap in gaps:
        last = hashes[n - 1 + gap:]
        total = start[: len(last)] + last
        out.append(total ^ (total >> np.uint64(32)))
    return out


def seed_length(words: int) -> int:
    """Words of a seed of an item of that many words."""
    return min(SEED_WORDS if words > SHORT_ITEM else SEED_WORDS - 1, words)


@dataclass
class Block:
    """A bounded part of the benchmark: items, their words, their seeds and which of these are rare."""

    items: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)
    is_rare: dict[int, np.ndarray] = field(default_factory=dict)

    def build(self) -> "Block":
        """Per seed length: hashes sorted, with the item's number and the position of each."""
        found = defaultdict(list)
        for p, words in enumerate(self.words):
            n = seed_length(len(words))
            grams = ngram_hashes(words, n)[0]
            found[n].append((grams, np.full(len(grams), p, np.int32), np.arange(len(grams), dtype=np.int32)))
        for n, parts in found.items():
            grams, piece, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(grams, kind="stable")
            self.seeds[n] = grams[order], piece[order], pos[order]
        return self

    def ranked(self, counts: dict[tuple[int, int], int]) -> "Block":
        """The same block with the seeds that any document holds; at least half of each item's are rare."""
        kept, is_rare = {}, {}
        for n, (grams, piece, pos) in self.seeds.items():
            seen = np.fromiter((counts.get((n, g), 0) for g in grams.view(np.int64).tolist()), np.int64, len(grams))
            there = seen > 0
            grams, piece, pos, seen = grams[there], piece[there], pos[there], seen[there]
            order = np.lexsort((seen, piece))
            starts = np.flatnonzero(np.diff(piece[order], prepend=-1))
            sizes = np.diff(np.append(starts, len(order)))
            median = np.zeros(len(self.words), np.int64)
            median[piece[order][starts]] = seen[order][starts + (sizes - 1) // 2]
            kept[n] = grams, piece, pos
            is_rare[n] = seen <= np.maximum(RARE_FLOOR, RARE_FACTOR * median[piece])
        return Block(self.items, self.words, kept, is_rare)


class SeedIndex:
    """Finds a block's seeds in a document: a small bit table first, then binary search."""

    def __init__(self, block: Block):
        self.tables = []
        for n, (grams, piece, pos) in sorted(block.seeds.items()):
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[grams & np.uint64((1 << FILTER_BITS) - 1)] = True
            self.tables.append((n, grams, piece, pos, bits))

    def hits(self, hashes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(n, places, first and end rows of the equal seeds) in texts laid end to end;
        ``ends`` has for each word the end of its text, which no seed crosses."""
        for n, grams, _, _, bits in self.tables:
            own, at = [], []
            for gap, found in enumerate(ngram_hashes(hashes, n, (0, 1))):
                where = np.flatnonzero(bits[found & np.uint64((1 << FILTER_BITS) - 1)])
                where = where[where + n + gap <= ends[where]]
                own.append(found[where])
                at.append(where)
            own, at = np.concatenate(own), np.concatenate(at)
            if len(at):
                lo, hi = np.searchsorted(grams, own), np.searchsorted(grams, own, side="right")
                real = hi > lo
                if real.any():
                    yield n, at[real], lo[real], hi[real]


@dataclass
class Texts:
    """Some texts as word hashes, end to end; text i is ``hashes[starts[i]: starts[i + 1]]``."""

    hashes: np.ndarray
    starts: np.ndarray

    @staticmethod
    def groups(texts: list[str | None], known: WordHash) -> Iterator["Texts"]:
        parts, size = [], 0
        for text in texts:
            parts.append(hash_words(text, known))
            size += len(parts[-1])
            if size >= GROUP_WORDS:
                yield Texts.of(parts)
                parts, size = [], 0
        if parts:
            yield Texts.of(parts)

    @staticmethod
    def of(parts: list[np.ndarray]) -> "Texts":
        return Texts(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))

    def ends(self) -> np.ndarray:
        return np.repeat(self.starts[1:], np.diff(self.starts))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences and where it ends in ``text``."""
    columns = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(text == word, 1, -1), row[1:] - 1)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + columns) - columns  # gaps along the text
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def align_copy(item: np.ndarray, text: np.ndarray, starts: np.ndarray) -> tuple[int, int]:
    """``align``, at once where the text has the whole item at the first of ``starts``."""
    start, m = int(starts.min()), len(item)
    if start >= 0 and np.array_equal(text[start: start + m], item):
        return m, start + m
    return align(item, text)


def present(item: np.ndarray, words: np.ndarray) -> int:
    """How many of the item's words are among the sorted distinct ``words``; no alignment scores more."""
    at = np.searchsorted(words, item)
    return int((words[np.minimum(at, len(words) - 1)] == item).sum())


def text_matches(texts: Texts, index: SeedIndex, block: Block, min_score: float) -> list[dict]:
    """Per text: item → (score, end word) of the best alignment with its words, of scores from ``min_score`` on."""
    tables = {t[0]: t for t in index.tables}
    out: list[dict] = [{} for _ in range(len(texts.starts) - 1)]
    hits = []
    for n, at, lo, hi in index.hits(texts.hashes, texts.ends()):
        _, _, piece, pos, _ = tables[n]
        rows = np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange((hi - lo).sum())
        hits.append((np.repeat(texts.text_of(at), hi - lo), piece[rows], np.repeat(at, hi - lo), pos[rows], block.is_rare[n][rows]))
    if not hits:
        return out
    text, pieces, at, pos, rare = (np.concatenate(x) for x in zip(*hits))
    order = np.lexsort((pos, at, pieces, text))
    text, pieces, at, pos, rare = text[order], pieces[order], at[order], pos[order], rare[order]
    starts = np.flatnonzero((np.diff(pieces, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    opened, own, own_of = np.logical_or.reduceat(rare, starts), None, -1
    for first, last, is_open in zip(starts.tolist(), np.append(starts[1:], len(pieces)).tolist(), opened.tolist()):
        p, t = int(pieces[first]), int(text[first])
        words, begin = block.words[p], int(texts.starts[t])
        hashes, m = texts.hashes[begin: texts.starts[t + 1]], len(block.words[p])
        if not is_open:
            own, own_of = (own, t) if own_of == t else (np.unique(hashes), t)
            if present(words, own) < min_score * m:
                continue
        a, q, best = at[first:last] - begin, pos[first:last], out[t]
        for c in np.split(np.arange(last - first), np.flatnonzero(np.diff(a) > m) + 1):
            lo = max(0, int((a[c] - q[c]).min()) - m // 2)
            hi = min(len(hashes), int((a[c] - q[c]).max()) + m + m // 2)
            if present(words, np.unique(hashes[lo:hi])) < min_score * m:
                continue
            score, end = align_copy(words, hashes[lo:hi], a[c] - q[c] - lo)
            if score / m >= min_score and score / m > best.get(block.items[p], (0.0, 0))[0]:
                best[block.items[p]] = score / m, lo + end
    return out


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks, read one partition at a time."""
    known, block, size = WordHash(), Block(), 0
    rows: Iterator[Row] = benchmark.select(F.col("item_id").alias("item"), F.col("text").cast("string").alias("text")
                                           ).toLocalIterator()
    for row in rows:
        words = hash_words(row["text"], known)
        if size and size + len(words) > block_words:
            yield block.build()
            block, size = Block(), 0
        if len(words):
            block.items.append(row["item"])
            block.words.append(words)
            size += len(words)
    if size:
        yield block.build()


def seed_counts(docs: DataFrame, block: Block, text_col: str) -> dict[tuple[int, int], int]:
    """Documents that hold each seed, over all documents; at most one row per seed of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = WordHash(), SeedIndex(shared.value)
        totals = {t[0]: np.zeros(len(t[1]), np.int64) for t in index.tables}
        for batch in batches:
            for texts in Texts.groups(batch.column(0).to_pylist(), known):
                for n, at, lo, _ in index.hits(texts.hashes, texts.ends()):
                    once = np.unique(texts.text_of(at) * len(totals[n]) + lo) % len(totals[n])
                    totals[n] += np.bincount(once, minlength=len(totals[n]))
        for n, grams, *_ in index.tables:
            some = np.flatnonzero(totals[n])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n, np.int32)), pa.array(grams[some].view(np.int64)),
                                              pa.array(totals[n][some])], names=["n", "seed", "docs"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "n int, seed long, docs long")
    return {(r["n"], r["seed"]): r["total"] for r in counted.groupBy("n", "seed").agg(F.sum("docs").alias("total")).collect()}


def _scan(docs: DataFrame, benchmark: DataFrame, min_score: float, text_col: str, block_words: int, schema, emit) -> DataFrame | None:
    """``emit(batch, texts' matches per row)`` over one pass per block; matches score ``min_score`` or more."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    out, texts = None, docs.columns.index(text_col)
    for block in blocks_of(benchmark, block_words):
        shared = spark.sparkContext.broadcast(block.ranked(seed_counts(docs, block, text_col)))

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, index = WordHash(), SeedIndex(shared.value)
            for batch in batches:
                yield emit(batch, [found for group in Texts.groups(batch.column(texts).to_pylist(), known)
                                   for found in text_matches(group, index, shared.value, min_score)])

        source = docs if out is None or schema is not None else out
        part = source.mapInArrow(match, schema or docs.schema)
        out = part if out is None or schema is None else out.unionByName(part)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id",
                       text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, end_word) of every document and test item aligned at
    ``min_score`` or above; end_word: the words of the document before the match's end."""
    schema = "doc_id long, item_id long, score double, end_word long"

    def emit(batch: pa.RecordBatch, matches: list[dict]) -> pa.RecordBatch:
        rows = [(d, i, s, e) for d, found in zip(batch.column(0).to_pylist(), matches)
                for i, (s, e) in found.items()]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "score", "end_word"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _scan(given, benchmark, min_score, "text", block_words, schema, emit)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    # repeated rows, and equal ids in two blocks, are found twice
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("m")).select(
        "doc_id", "item_id", "m.score", "m.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, text_col: str = "text",
                      block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that no test item reaches; columns unchanged, text not shuffled."""

    def emit(batch: pa.RecordBatch, matches: list[dict]) -> pa.RecordBatch:
        return batch.filter(pa.array([not found for found in matches], pa.bool_()))

    kept = _scan(docs, benchmark, min_score, text_col, block_words, None, emit)
    return docs if kept is None else kept

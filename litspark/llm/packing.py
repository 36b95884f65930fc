"""Vector best-fit packing of tokenised documents into training sequences.

A piece of L tokens asks for the vector (L tokens, 1 document, L² attention
cost), and a sequence offers a capacity in each of the three. Pieces are placed
longest first; among the sequences that can still take a piece under every
constraint the one with the smallest weighted residual norm after placing it
(or the smallest weighted dot product of piece and residual) is chosen, and a
new sequence is opened only when none can. The weights are the corpus' demand
for each capacity.

What a piece asks for depends on its length alone, so best fit over the whole
corpus needs only the number of pieces of each length: at most ``capacity``
rows, whatever the corpus holds. The driver packs these counts; sequences in the
same state are handled as one range of sequence numbers, so a decision covers
many pieces. Its result, ranges of (length, rank) → (sequence, offset), is sent
to the tasks. A piece's rank among those of its length is its place in its own
task plus the counts of the tasks before it, so no length is ever gathered or
sorted, however many pieces share it.

The token ids come from ``tokenizers``. A text's ids are its white-space
chunks' ids one after another, so each distinct chunk is tokenised once per
worker and then looked up (the table is bounded). Texts with a special token's
string are tokenised whole.

Defined cases: null text is an empty document of one end id; documents longer
than a sequence are cut, the last piece may be shorter; repeated rows are
packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspark.llm import common

TOKENS = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
KNOWN_CHUNKS = 400_000

#: Letters up to here are their own normal form and belong to the same classes
#: in every Unicode version; chunks beyond are left to the tokenizer as a whole.
_PLAIN = "ɐ"
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_SIMPLE = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def byte_letters() -> dict[int, str]:
    """The usual one-letter names of bytes: printable ones stand for themselves,
    the others are numbered from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Encoder(dict):
    """chunk of text without white space → its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str, most: int = KNOWN_CHUNKS):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer, self.most, self.letters = Tokenizer.from_file(path), most, byte_letters()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: str) -> bytes:
        """One word, digit or run of signs, already lower-case."""
        known = self.get(piece)
        if known is None:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tokenizer.model.tokenize(spelled)]
            known = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if _SIMPLE.fullmatch(chunk):
            value = b"".join(map(self.piece, _PIECE.findall(chunk.lower())))
        else:
            value = self.whole(chunk)
        self[chunk] = value
        return value

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. The default document and attention capacities
    are those that its tokens imply, so they bind only when set lower."""

    tokens: int = TOKENS
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens ** 2], np.int64)

    def longest(self) -> int:
        """Tokens of the longest piece that one sequence takes."""
        return min(self.tokens, int(self.vector()[2] ** 0.5))


def plan(counts: dict[int, int], capacity: Capacity = Capacity(), score: str = "norm") -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, offset): the pieces of that
    length with those ranks go, one each, to consecutive sequences at that offset."""
    limit = capacity.vector()
    demand = np.zeros(3)
    for length, count in counts.items():
        demand += count * np.array([length, 1, length ** 2]) / limit
    weight = demand / max(demand.sum(), 1e-300) / limit.astype(float) ** 2
    # open sequences: first number, how many, used capacity
    first, many, used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        ask = np.array([length, 1, length ** 2], np.int64)
        if (ask > limit).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        spare = limit - used - ask
        able = np.flatnonzero((spare >= 0).all(axis=1))
        rest = spare[able].astype(float)
        value = (rest ** 2 if score == "norm" else (rest + ask) * ask) @ weight
        # equal pieces go on to the next sequence only when the best one is full, so one order serves them all
        for g in able[np.argsort(value, kind="stable")]:
            if not left:
                break
            fits = int(((limit - used[g]) // ask).min())
            whole = min(int(many[g]), left // fits)
            parts = [(whole, fits)] if whole else []
            if whole < many[g] and left - whole * fits:
                parts.append((1, min(fits, left - whole * fits)))
            start, total = int(first[g]), int(many[g])
            before = used[g].copy()
            pieces = []
            for bins, each in parts:
                for j in range(each):
                    rows.append((length, rank, rank + bins, start, int(before[0]) + j * length))
                    rank += bins
                left -= bins * each
                pieces.append((start, bins, before + each * ask))
                start += bins
                total -= bins
            if total:
                pieces.append((start, total, before))
            first[g], many[g], used[g] = pieces[0]
            for more in pieces[1:]:
                first, many = np.append(first, more[0]), np.append(many, more[1])
                used = np.vstack([used, more[2]])
        while left:
            fits = int((limit // ask).min())
            bins, each = (left // fits, fits) if left >= fits else (1, left)
            for j in range(each):
                rows.append((length, rank, rank + bins, opened, j * length))
                rank += bins
            left -= bins * each
            first, many = np.append(first, opened), np.append(many, bins)
            used = np.vstack([used, each * ask])
            opened += bins
    return np.array(rows, np.int64).reshape(-1, 5)


def tokenised_pieces(docs: DataFrame, tokenizer: str, longest: int = TOKENS, end_id: int = END_ID,
                     id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, its task and its rank
    among the task's pieces of that length (and the ids themselves if asked for)."""
    common.bound_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer).encode, TaskContext.get().partitionId()
        end, seen = struct.pack("<I", end_id), np.zeros(longest + 1, np.int64)
        for batch in batches:
            rows, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = encode(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * longest)):
                    part = data[at: at + 4 * longest]
                    n = len(part) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(part), task, int(seen[n])))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    seen[n] += 1
            if rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "task_rank"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, task int, task_rank long"
              + ", ids array<int>" * with_ids)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(cut, schema)


def place(pieces: DataFrame, capacity: Capacity = Capacity(), score: str = "norm") -> DataFrame:
    """``pieces`` (written rows of ``tokenised_pieces``) with ``sequence_id`` and ``offset``."""
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(counts, capacity, score)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = pieces.sparkSession.sparkContext.broadcast(rows)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        starts = np.searchsorted(table[:, 0], np.arange(capacity.tokens + 2))
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            found = np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                own, n = order[lo:hi], int(length[order[lo]])
                found[own] = starts[n] + np.searchsorted(table[starts[n]: starts[n + 1], 1], rank[own], side="right") - 1
            rule = table[found]
            arrays = [batch.column(i) for i in keep] + [pa.array(rule[:, 3] + rank - rule[:, 1]), pa.array(rule[:, 4])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    ranked = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")
    keep = [i for i, c in enumerate(ranked.columns) if c not in ("task", "task_rank", "base", "rank")]
    names = [ranked.columns[i] for i in keep] + ["sequence_id", "offset"]
    schema = ranked.select(*names[:-2], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    return ranked.mapInArrow(look, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: Capacity = Capacity(), score: str = "norm",
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ``ids``); the pieces are tokenised once and written to the shared folder."""
    pieces = tokenised_pieces(docs, tokenizer or default_tokenizer(), capacity.longest(), id_col=id_col,
                              text_col=text_col, with_ids=with_ids)
    return place(common.materialise(pieces, "pieces"), capacity, score)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from rows with ``ids``: sequence_id, ids, and
    the length of each document in it (at most ``capacity.tokens`` ids a row)."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"),
                       F.transform("parts", lambda p: F.size(p["ids"])).alias("lengths"))

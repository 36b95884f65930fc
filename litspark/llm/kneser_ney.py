"""Quality classifier: interpolated modified Kneser-Ney n-gram model, perplexity quantiles.

The model spells texts: symbols are the characters of the words, one space
between two words and an end, contexts are the ``order - 1`` symbols before,
across words, padded at the text's start. Characters are folded into 4096
classes (the code point modulo 4096), so an n-gram of up to five symbols is one
long. It is trained on the documents labelled good, but for a fifth of their
texts (by a hash of the text, so equal texts stay together), with continuation
counts for the lower orders (raw counts where the n-gram starts a text) and
three discounts per order from the counts of counts.

Counts live in Spark tables keyed by n-gram and are never brought to one place.
Documents are scored in chunks of one input task: a chunk asks for its distinct
n-grams, the distinct requests of all chunks are joined order by order to the
counts (p = discounted count + backoff weight * lower order), and the answers
are brought back to the chunks together with their documents. So the joins
carry each n-gram once per chunk, not once per occurrence.

A document's perplexity is that of its symbols. A language code's threshold is a
quantile over its trusted documents held out of the counts; a code without
``MIN_TRUSTED`` of them takes the threshold over all.

``docs`` is read twice and must give the same rows in the same partitions each
time, as a file scan does; otherwise a chunk misses an answer and the job fails.

Defined cases: texts without words have no perplexity (null) and are rejected;
null ids are scored like others; a document is trusted if all its labels are
good; repeated rows are each scored and trained on; without trusted text every
symbol is equally likely, and without any held out all documents with words are
kept; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm import common

ORDER = 5
CLASSES, SHIFT = 4096, 12
START, END = 2, 3
QUANTILE, MIN_TRUSTED = 0.99, 100
#: One in so many trusted texts is kept out of the counts and sets the thresholds.
HELD_OUT = 5
CHUNK_CHARS = 64_000_000
BLOB_CHARS = 1_000_000
BLOCK_SYMBOLS = 4_000_000
#: Positions of the filter that keeps the unlabelled texts out of the training join.
FILTER_POSITIONS = 1 << 20


def ngrams(pieces: list[str], owners: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, n-gram) for every symbol of every piece but its first ``order - 1``, the context."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).astype(np.int64) % CLASSES
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    inside = np.ones(len(codes), bool)
    for back in range(1, order):
        inside[np.cumsum(lengths) - back] = False
    windows = len(codes) - order + 1
    grams = reduce(lambda total, at: (total << SHIFT) | codes[at:at + windows], range(order), np.zeros(windows, np.int64))
    return np.repeat(owners, lengths - order + 1), grams[inside[:windows]]


def gram_blocks(texts: Iterable[str | None], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, n-gram) of whole texts, in blocks of about ``BLOCK_SYMBOLS`` symbols."""
    pieces, owners, size = [], [], 0
    for number, text in enumerate(texts):
        words = " ".join((text or "").split())
        if not words:
            continue
        symbols = chr(START) * (order - 1) + words + chr(END)
        for at in range(0, len(symbols) - order + 1, BLOCK_SYMBOLS):
            pieces.append(symbols[at:at + BLOCK_SYMBOLS + order - 1])
            owners.append(number)
            size += len(pieces[-1])
            if size >= BLOCK_SYMBOLS:
                yield ngrams(pieces, owners, order)
                pieces, owners, size = [], [], 0
    if pieces:
        yield ngrams(pieces, owners, order)


def count_ngrams(texts: DataFrame, order: int) -> DataFrame:
    """(gram, n) over ``texts(text)``; each task adds up the n-grams of a block first."""
    common.bound_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams in gram_blocks((text for batch in batches for text in batch.column(0).to_pylist()), order):
            distinct, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return texts.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of documents all of whose labels are good."""
    return (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
            .where("q > 0").select(F.col("doc_id").cast("long").alias("doc_id")))


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of the trusted documents. A filter of at most ``FILTER_POSITIONS``
    hashed ids keeps most other texts out of the join, which then decides exactly.
    The join is a shuffle at every size: the labels grow with the documents."""
    good = trusted_ids(labels)
    position = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_POSITIONS)).alias("position")
    maybe = docs.select("doc_id", "text", position).join(F.broadcast(good.select(position).distinct()), "position", "left_semi")
    return maybe.join(good.hint("merge"), "doc_id", "left_semi").select("text")


class Orders:
    """The count tables of every order and their discounts."""

    def __init__(self, counts: DataFrame, order: int, scratch: list[str] | None = None):
        self.order = order
        self.counts = {order: common.materialise(counts, f"kn-counts-{order}", scratch)}
        for k in range(order - 1, 0, -1):
            higher = self.counts[k + 1]
            suffix = F.col("gram").bitwiseAND(F.lit((1 << SHIFT * k) - 1))
            starts_text = F.shiftright(suffix, SHIFT * (k - 1)) == START
            lower = higher.select(suffix.alias("gram"), F.when(starts_text, F.col("n")).otherwise(F.lit(1)).alias("n"))
            self.counts[k] = common.materialise(lower.groupBy("gram").agg(F.sum("n").cast("long").alias("n")), f"kn-counts-{k}", scratch)
        self.discounts = {k: self._discounts(k) for k in self.counts}

    def _discounts(self, k: int) -> tuple[float, float, float]:
        """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more; 0 where undefined."""
        n = [int(x or 0) for x in self.counts[k].agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first()]
        if not n[0]:
            return 0.0, 0.0, 0.0
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(i + 1.0, max(0.0, i + 1 - (i + 2) * y * n[i + 1] / n[i])) if n[i] else 0.0 for i in range(3))

    def discount(self, k: int) -> Column:
        one, two, more = self.discounts[k]
        return F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)

    def contexts(self, k: int) -> DataFrame:
        """(context, shares, total, back): the discounted count of each symbol seen after a context (at
        most ``CLASSES``), the sum of counts, and the weight left to the lower order."""
        one, two, more = self.discounts[k]
        share = F.struct(F.col("gram").bitwiseAND(F.lit(CLASSES - 1)).alias("symbol"), (F.col("n") - self.discount(k)).alias("share"))
        return self.counts[k].groupBy(F.shiftright("gram", SHIFT).alias("context")).agg(
            F.map_from_entries(F.collect_list(share)).alias("shares"), F.sum("n").alias("total"),
            ((F.count_if(F.col("n") == 1) * one + F.count_if(F.col("n") == 2) * two
              + F.count_if(F.col("n") > 2) * more) / F.sum("n")).alias("back"))

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(gram, logp) of the distinct ``wanted(gram)``: one join by context per order."""
        rows = wanted.select("gram", F.lit(0.0).alias("p"), F.lit(1.0).alias("rest"))
        symbol = F.col("gram").bitwiseAND(F.lit(CLASSES - 1))
        for k in range(self.order, 1, -1):
            context = F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << SHIFT * k) - 1)), SHIFT)
            seen = F.try_element_at("shares", symbol) / F.col("total")
            rows = (rows.withColumn("context", context).join(self.contexts(k), "context", "left")
                    .select("gram", (F.col("p") + F.col("rest") * F.coalesce(seen, F.lit(0.0))).alias("p"),
                            (F.col("rest") * F.coalesce("back", F.lit(1.0))).alias("rest")))
        # order 1 has the one context without symbols: at most CLASSES counts and two numbers
        one, two, more = self.discounts[1]
        total, ones, twos, threes = self.counts[1].agg(F.sum("n"), *[F.count_if(c) for c in (
            F.col("n") == 1, F.col("n") == 2, F.col("n") > 2)]).first()
        total = float(total or 0)
        spare = (ones * one + twos * two + threes * more) / total if total else 1.0
        unigrams = self.counts[1].select(F.col("gram").alias("own"), ((F.col("n") - self.discount(1)) / max(total, 1.0)).alias("seen"))
        return (rows.withColumn("own", F.col("gram").bitwiseAND(F.lit(CLASSES - 1))).join(F.broadcast(unigrams), "own", "left")
                .select("gram", F.log(F.col("p") + F.col("rest") * (F.coalesce("seen", F.lit(0.0)) + spare / CLASSES)).alias("logp")))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, part of a batch): chunks of about ``CHUNK_CHARS`` characters of one task, cut between documents."""
    task, chunk, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        lengths = [len(t or "") for t in batch.column("text").to_pylist()]
        first = 0
        for i, n in enumerate(lengths):
            if size and size + n > CHUNK_CHARS:
                if i > first:
                    yield (task << 24) + chunk, batch.slice(first, i - first)
                chunk, size, first = chunk + 1, 0, i
            size += n
        if len(lengths) > first:
            yield (task << 24) + chunk, batch.slice(first)


def chunk_requests(docs: DataFrame, order: int) -> DataFrame:
    """(chunk, gram): the distinct n-grams that each chunk needs."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, []

        def emit() -> Iterator[pa.RecordBatch]:
            if seen:
                grams = np.unique(np.concatenate(seen))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), current)), pa.array(grams)], names=["chunk", "gram"])

        for chunk, part in _chunks(batches):
            if chunk != current:
                yield from emit()
                current, seen = chunk, []
            seen.extend(pd.unique(grams) for _, grams in gram_blocks(part.column("text").to_pylist(), order))
        yield from emit()

    return docs.select("text").mapInArrow(ask, "chunk long, gram long")


def chunk_documents(docs: DataFrame) -> DataFrame:
    """(chunk, blob): the documents of each chunk as compressed Arrow data."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for chunk, part in _chunks(batches):
            # a blob holds about BLOB_CHARS characters: slices of the rows in proportion
            chars = max(1, sum(len(t or "") for t in part.column("text").to_pylist()))
            step = max(1, part.num_rows * BLOB_CHARS // chars)
            for at in range(0, part.num_rows, step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                    out.write_batch(part.slice(at, step))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                 names=["chunk", "blob"])

    return docs.mapInArrow(pack, "chunk long, blob binary")


def score_chunk(documents: pa.Table, answers: pa.Table, order: int) -> pa.Table:
    """doc_id, stratum, held_out, n_symbols, logp of a chunk's documents."""
    grams, logp = answers["gram"].to_numpy(), answers["logp"].to_numpy()
    sort = np.argsort(grams)
    grams, logp = grams[sort], logp[sort]
    out = []
    for blob in documents["blob"].to_pylist():
        table = pa.ipc.open_stream(blob).read_all()
        symbols, total = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows)
        for owner, wanted in gram_blocks(table["text"].to_pylist(), order):
            code, distinct = pd.factorize(wanted)
            at = np.searchsorted(grams, distinct)
            if at.max() >= len(grams) or (grams[at] != distinct).any():
                raise RuntimeError("a chunk misses n-grams: its input changed between two reads")
            symbols += np.bincount(owner, minlength=table.num_rows)
            total += np.bincount(owner, logp[at][code], table.num_rows)
        out.append(pa.table({"doc_id": table["doc_id"], "stratum": table["stratum"], "held_out": table["held_out"],
                             "n_symbols": pa.array(symbols), "logp": pa.array(total)}))
    return pa.concat_tables(out)


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", scratch: list[str] | None = None) -> DataFrame:
    """(doc_id, stratum, held_out, n_symbols, perplexity) of every document. The paths of the
    tables that the result reads are added to ``scratch``."""
    common.bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       common.language_stratum(F.col(lang_col)).alias("stratum"))
    docs = docs.withColumn("held_out", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0)
    model = Orders(count_ngrams(trusted_texts(docs.where("NOT held_out"), labels), order), order, scratch)
    requests = common.materialise(chunk_requests(docs, order), "kn-requests", scratch)
    answers = common.materialise(requests.join(model.probabilities(requests.select("gram").distinct()), "gram")
                                 .select("chunk", "gram", "logp"), "kn-answers", scratch)
    scored = chunk_documents(docs).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda left, right: score_chunk(left, right, order),
        "doc_id long, stratum string, held_out boolean, n_symbols long, logp double")
    return scored.select("doc_id", "stratum", "held_out", "n_symbols",
                         F.when(F.col("n_symbols") > 0, F.exp(-F.col("logp") / F.col("n_symbols"))).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, held_out, n_symbols, perplexity, threshold, kept)."""
    scratch: list[str] = []
    scores = common.materialise(perplexities(docs, labels, order, id_col, text_col, lang_col, scratch), "kn-scores")
    for path in scratch:
        common.remove(docs.sparkSession, path)
    trusted = scores.where("held_out AND perplexity IS NOT NULL").join(trusted_ids(labels), "doc_id", "left_semi")
    value = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000))
    per_code = trusted.groupBy("stratum").agg(value.alias("threshold"), F.count("*").alias("n")).where(F.col("n") >= MIN_TRUSTED)
    overall = trusted.agg(value).first()[0]
    limits = F.broadcast(per_code.select("stratum", "threshold"))  # one row per language code at most
    out = scores.join(limits, "stratum", "left").withColumn("threshold", F.coalesce(
        "threshold", F.lit(overall).cast("double"), F.lit(float("inf"))))
    return out.select("doc_id", "stratum", "held_out", "n_symbols", "perplexity", "threshold",
                      F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))

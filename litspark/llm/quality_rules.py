"""Quality rules with risk-controlled thresholds.

Every rule is a ratio of one text statistic, higher meaning worse, divided by a
usual limit for it; a document's badness is the largest of these. Labelled
holdouts decide the cutoff of each stratum (language code): the cutoffs of a
fixed path are tested from the loosest to the strictest with the exact binomial
(Clopper-Pearson) bound on what all rules reject together. A cutoff is certified while

    P(Binomial(n_good, alpha) <= good documents it rejects) <= delta / open strata

The path is a fixed sequence (testing stops at the first cutoff that is not
certified), so only the strata need a correction: Holm's, in which a stratum
whose whole path is certified hands its share of delta to those still open.
With probability 1 - delta no stratum rejects more than ``alpha`` of its good
documents by its rules. Among the certified cutoffs the one with the best
difference between rejected bad and rejected good documents is used, the
loosest on ties; without a certified, useful cutoff the rules are off in that
stratum. With four strata and none of the good ones rejected, 42 good labelled
documents certify a cutoff.

Defined cases: null text has no words and fails the base rule; null or unusual
language codes share the stratum ``other``; a document labelled twice counts
as good only if every label says so; labels without a document are ignored; a
repeated document row is judged and counted as often as it occurs; with no
labels every rule is off; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm import common

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ALPHA = 0.1
DELTA = 0.05

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
RULES = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio")
#: Usual limits of the ratios, in the order of ``RULES`` (fixed values, not learned).
LIMITS = (0.1, 0.3, 0.3, 0.3, 0.1)
#: Cutoffs of the badness, in limits, from the loosest to the strictest.
PATH = (3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1)
#: Positions of the filter that keeps unlabelled texts out of the fit.
FILTER_POSITIONS = 1 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    size = len(code)
    if size == n:
        return 0
    pair = ids[:-2] * size + ids[1:-1]
    if size ** 3 >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, counts = np.unique(pair * size + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five counts and the rule ratios of one whole text."""
    if not text:
        return (0,) * len(COUNTS), (0.0,) * len(RULES)
    words = text.encode().split()  # bytes.split splits on space and \x09-\x0D only
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, WHITE))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeat_words(words)
    upper = sum(map(bytes.isupper, words))
    marks = text.count("!") + text.count("?")
    ratios = (n_symbols / max(word_chars, 1), n_dup / max(len(lines), 1), n_repeat / max(n_words, 1),
              upper / max(n_words, 1), marks / max(n_words, 1))
    return (n_words, word_chars, n_symbols, n_dup, n_repeat), ratios


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One narrow row per document: id, stratum, the counts, ``base_failed`` and the rule ratios."""
    common.bound_batches(docs.sparkSession)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_stats(t) for t in batch.column(1).to_pylist()]
            counts, ratios = [r[0] for r in rows], [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2)]
                + [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(COUNTS))]
                + [pa.array([base_failed(c) for c in counts], pa.bool_())]
                + [pa.array([r[i] for r in ratios], pa.float64()) for i in range(len(RULES))], names=names)

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                        common.language_stratum(F.col(lang_col)).alias("stratum"))
    names = ["doc_id", "stratum", *COUNTS, "base_failed", *RULES]
    schema = ("doc_id long, stratum string, " + "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, "
              + ", ".join(f"{r} double" for r in RULES))
    return given.mapInArrow(stats, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed exactly in log space."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
            + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(k: int, n: int, p: float, delta: float) -> bool:
    """Whether the exact upper bound for a rate, k of n seen, is at most ``p`` at level ``delta``."""
    return k < n * p and binomial_tail(k, n, p) <= delta


def choose_cutoffs(tally: dict[str, tuple[list[int], list[int]]], alpha: float, delta: float) -> dict[str, float | None]:
    """Stratum → cutoff. ``tally``: per stratum the good and the bad labelled documents at each
    level; level k is above the k strictest cutoffs, the last of ``PATH``."""
    # above[i]: documents above PATH[i]; the last number counts all
    above = {s: tuple(np.cumsum(n[::-1]).tolist() for n in both) for s, both in tally.items()}
    length = dict.fromkeys(above, 0)  # certified cutoffs
    still_open = set(above)
    while still_open:
        level = delta / len(still_open)
        for s in still_open:
            good = above[s][0]
            while length[s] < len(PATH) and certified(good[length[s]], good[-1], alpha, level):
                length[s] += 1
        done = {s for s in still_open if length[s] == len(PATH)}
        if not done:
            break
        still_open -= done
    chosen = {}
    for s, (good, bad) in above.items():
        best, chosen[s] = 0.0, None
        for i in range(length[s]):
            gain = bad[i] / max(bad[-1], 1) - good[i] / max(good[-1], 1)
            if gain > best:
                best, chosen[s] = gain, PATH[i]
    return chosen


def badness(ratios: tuple[float, ...]) -> float:
    return max(r / limit for r, limit in zip(ratios, LIMITS))


def badness_column() -> Column:
    return F.greatest(*[F.col(rule) / F.lit(limit) for rule, limit in zip(RULES, LIMITS)])


def labelled_documents(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of every labelled document."""
    return (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg((F.min("quality") > 0).alias("good")))


def fit_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, float | None]:
    """Stratum → cutoff, or None. What reaches the driver is one row per language code,
    verdict and level, counted over all labelled documents."""
    bad = badness_column()
    level = sum((bad > F.lit(c)).cast("int") for c in PATH).alias("level")
    rows = (stats.join(labelled_documents(labels), "doc_id").groupBy("stratum", "good", level).agg(F.count("*").alias("n"))
            .collect())
    tally = {row["stratum"]: ([0] * (len(PATH) + 1), [0] * (len(PATH) + 1)) for row in rows}
    for row in rows:
        tally[row["stratum"]][0 if row["good"] else 1][row["level"]] += row["n"]
    return choose_cutoffs(tally, alpha, delta)


def judge(stats: DataFrame, cutoffs: dict[str, float | None]) -> DataFrame:
    """``stats`` with ``cutoff`` and ``kept``; the cutoffs are joined as a table of at most one row per language code."""
    limits = stats.sparkSession.createDataFrame(sorted(cutoffs.items()), "stratum string, cutoff double")
    over = F.coalesce(badness_column() > F.col("cutoff"), F.lit(False))
    return stats.join(F.broadcast(limits), "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over)


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Statistics and verdict of every document: counts, ratios, cutoff of its stratum, ``kept``."""
    stats = common.materialise(document_stats(docs), "quality-stats")
    return judge(stats, fit_cutoffs(stats, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
              id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged. The verdict is
    taken where the text is read, so no text is shuffled. The cutoffs come from the labelled
    documents: a broadcast filter of at most ``FILTER_POSITIONS`` hashed ids passes them and a
    few others, whose statistics then meet the labels."""
    position = common.free_name(docs, "position")
    wanted = labelled_documents(labels).select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_POSITIONS)).alias(position)).distinct()
    maybe = (docs.withColumn(position, F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(FILTER_POSITIONS)))
             .join(F.broadcast(wanted), position, "left_semi"))
    cutoffs = fit_cutoffs(document_stats(maybe, id_col, text_col, lang_col), labels, alpha, delta)
    texts, langs = docs.columns.index(text_col), docs.columns.index(lang_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = []
            for text, lang in zip(batch.column(texts).to_pylist(), batch.column(langs).to_pylist()):
                counts, ratios = text_stats(text)
                cutoff = cutoffs.get(common.stratum_of(lang))
                verdicts.append(not base_failed(counts) and (cutoff is None or badness(ratios) <= cutoff))
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

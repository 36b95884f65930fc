"""Language identification of mixed-language text, word by word.

A word's script (Unicode ranges of its first letter) narrows the candidates to
the languages seen in that script. Each candidate scores the word with a
character trigram model, log P(c3 | c1 c2) over the padded word, learned from
labelled documents. Viterbi over the words, with a penalty for every switch of
language, labels spans; the document's language is the one with most letters,
its score the share of letters times the odds against the runner-up.

Counts are taken over all training documents: each task adds up its distinct
words and emits one row per language and cell. Cells are hashed; their number is
chosen so that the model never exceeds ``MODEL_CELLS`` numbers, whatever the
count of languages and documents.

A path that never leaves the best language l is optimal if no other language
gains more than half the penalty over l on any run of words: k runs gain at most
k/2 penalties and cost at least k - 1 (k = 1 reaching a text's both ends is
the constant path itself). This is checked with running minima, and the full
Viterbi recursion is left for the texts that fail it.

Defined cases: null texts and texts without letters are ``und`` with score 0;
tokens without letters take the label around them and carry no weight; without
training rows every text is ``und``; ties go to the alphabetically first
language; repeated rows are each returned; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspark.llm import common

UNKNOWN = "und"
SWITCH_PENALTY = 16.0
MODEL_CELLS = 1 << 20
MOST_CELLS = 1 << 16
SMOOTHING = 0.05
TRAIN_WORDS = 400_000
KNOWN_WORDS = 200_000
#: Score of a word under a language never seen in its script.
OUT_OF_SCRIPT = -40.0

#: First code point of each range and its script (Unicode blocks), "" where no letters are expected.
SCRIPT_STARTS = [
    (0x0000, ""), (0x0041, "Latin"), (0x0250, "Other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFF66, "Kana"), (0xFFA0, "Other"),
    (0x20000, "Han"), (0x30000, "Other"),
]
_STARTS = [s for s, _ in SCRIPT_STARTS]

#: ASCII characters that are no letters become spaces; bytes of other characters stay.
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def script_of(char: str) -> str:
    return SCRIPT_STARTS[bisect_right(_STARTS, ord(char)) - 1][1]


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and non-ASCII characters, as UTF-8."""
    return text.lower().encode().translate(_LETTERS_ONLY).split() if text else []


def letters_of(token: bytes) -> str:
    """The token's letters; empty for a run of non-ASCII signs."""
    word = token.decode()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def trigram_cells(words: list[str], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, trigram cell, context cell) of every padded trigram of ``words``."""
    joined = "\x02\x02" + "\x03\x02\x02".join(words) + "\x03"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 2) // 2 - 1
    at = np.flatnonzero(codes[2:] != 2) + 2
    context = codes[at - 2] * np.uint64(0x9E3779B1) + codes[at - 1] * np.uint64(0x85EBCA6B)
    whole = context + codes[at] * np.uint64(0xC2B2AE3D27D4EB4F)
    spread = lambda x: (((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) & np.uint64(cells - 1)
    return owner[at], spread(whole).astype(np.int64), spread(context).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    trigrams: np.ndarray  # languages x cells: log counts
    contexts: np.ndarray
    scripts: dict[str, np.ndarray]  # script → which languages

    @property
    def cells(self) -> int:
        return self.trigrams.shape[1]

    def score(self, words: list[str]) -> np.ndarray:
        """words x languages."""
        owner, tri, ctx = trigram_cells(words, self.cells)
        parts = (self.trigrams[:, tri] - self.contexts[:, ctx]).T
        out = np.add.reduceat(parts, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
        for i, word in enumerate(words):
            allowed = self.scripts.get(script_of(word[0]))
            if allowed is not None and not allowed.all():
                out[i, ~allowed] = out[i].max() + OUT_OF_SCRIPT
        return out


def model_cells(n_languages: int) -> int:
    """Largest power of two that keeps both tables of all languages within ``MODEL_CELLS``."""
    cells = MOST_CELLS
    while cells > 2 and 2 * cells * n_languages > MODEL_CELLS:
        cells //= 2
    return cells


def count_features(texts: DataFrame, cells: int) -> DataFrame:
    """(lang, kind, cell, n) over ``texts(lang, text)``; kind: 3 trigram, 2 context, 0 letters by script."""
    scripts = sorted({s for _, s in SCRIPT_STARTS})
    number = {s: i for i, s in enumerate(scripts)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        totals: dict[str, dict[int, np.ndarray]] = {}

        def add(lang: str) -> None:
            found = Counter()
            for token, n in seen.pop(lang).items():
                if word := letters_of(token):
                    found[word] += n
            if not found:
                return
            sums = totals.setdefault(lang, {3: np.zeros(cells), 2: np.zeros(cells), 0: np.zeros(len(scripts))})
            words, counts = list(found), np.fromiter(found.values(), np.float64, len(found))
            owner, tri, ctx = trigram_cells(words, cells)
            sums[3] += np.bincount(tri, counts[owner], cells)
            sums[2] += np.bincount(ctx, counts[owner], cells)
            for word, n in found.items():
                sums[0][number[script_of(word[0])]] += n

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(tokens_of(text))
            for lang in [k for k, v in seen.items() if len(v) > TRAIN_WORDS]:
                add(lang)
        for lang in list(seen):
            add(lang)
        for lang, sums in totals.items():
            for kind, values in sums.items():
                some = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), kind, np.int32)),
                     pa.array(some.astype(np.int32)), pa.array(values[some].astype(np.int64))], names=["lang", "kind", "cell", "n"])

    return texts.select("lang", "text").mapInArrow(count, "lang string, kind int, cell int, n long").groupBy(
        "lang", "kind", "cell").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, smoothing: float = SMOOTHING) -> Model:
    """Model from ``labelled(lang, text)`` rows with neither null; at most ``MODEL_CELLS``
    counts and one number per language and script reach the driver."""
    common.bound_batches(labelled.sparkSession)
    languages = [r["lang"] for r in labelled.select("lang").distinct().orderBy("lang").collect()]
    cells = model_cells(max(1, len(languages)))
    scripts = sorted({s for _, s in SCRIPT_STARTS})
    counts = {3: np.zeros((len(languages), cells)), 2: np.zeros((len(languages), cells)),
              0: np.zeros((len(languages), len(scripts)))}
    place = {lang: i for i, lang in enumerate(languages)}
    table = count_features(labelled, cells).toArrow()
    which = np.array([place[x] for x in table["lang"].to_pylist()], np.int64)
    kind, cell, n = (table[c].to_numpy() for c in ("kind", "cell", "n"))
    for k, sums in counts.items():
        rows = kind == k
        sums[which[rows], cell[rows]] = n[rows]
    letters = max(1, int((counts[3] > 0).any(axis=0).sum()))
    share = counts[0] / np.maximum(counts[0].sum(axis=1, keepdims=True), 1)
    return Model(languages, np.log(counts[3] + smoothing).astype(np.float32),
                 np.log(counts[2] + smoothing * min(letters, 200)).astype(np.float32),
                 {s: share[:, i] > 0.001 for i, s in enumerate(scripts) if (share[:, i] > 0.001).any()})


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best label per row of ``scores``, each change of label costing ``penalty``."""
    width = scores.shape[1]
    value, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(value)
        best, jump = value.index(top), top - penalty
        back.append([i if value[i] >= jump else best for i in range(width)])
        value = [s + (v if v >= jump else jump) for s, v in zip(row, value)]
    label = value.index(max(value))
    path = [label]
    for step in reversed(back):
        label = step[label]
        path.append(label)
    return np.array(path[::-1])


def label_words(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    total = scores.sum(axis=0, dtype=np.float64)
    best = int(total.argmax())
    gain = np.cumsum(scores - scores[:, best: best + 1], axis=0, dtype=np.float64)
    low = np.minimum.accumulate(np.vstack([np.zeros(gain.shape[1]), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty / 2:
        return np.full(len(scores), best)
    return viterbi(scores, penalty)


class Tagger:
    """Scores words, remembering the last ``KNOWN_WORDS`` distinct ones."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int64)

    def learn(self, tokens: list[bytes]) -> None:
        new = [t for t in set(tokens) if t not in self.place]
        if not new:
            return
        if len(self.place) + len(new) > KNOWN_WORDS and self.place:
            self.forget()
            return self.learn(tokens)
        first, end = len(self.place), len(self.place) + len(new)
        if end > len(self.letters):
            more = max(end, 2 * len(self.letters)) - len(self.letters)
            self.scores = np.vstack([self.scores, np.zeros((more, self.scores.shape[1]), np.float32)])
            self.letters = np.append(self.letters, np.zeros(more, np.int64))
        words = [letters_of(t) for t in new]
        real = [i for i, w in enumerate(words) if w]
        self.scores[first:end] = 0
        self.letters[first:end] = [len(w) for w in words]
        if real:
            self.scores[first + np.array(real)] = self.model.score([words[i] for i in real])
        self.place.update(zip(new, range(first, end)))

    def tag(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(label, letters, scores) per word; None without letters."""
        tokens = tokens_of(text)
        if not tokens or not self.model.languages:
            return None
        self.learn(tokens)
        rows = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        letters = self.letters[rows]
        if not letters.any():
            return None
        scores = self.scores[rows]
        return label_words(scores, self.penalty), letters, scores

    def predict(self, text: str | None) -> tuple[str, float]:
        tagged = self.tag(text)
        if tagged is None:
            return UNKNOWN, 0.0
        labels, letters, scores = tagged
        weight = np.bincount(labels, letters, len(self.model.languages))
        best = int(weight.argmax())
        total = scores[labels == best].sum(axis=0, dtype=np.float64)
        lead = total[best] - np.delete(total, best).max() if len(total) > 1 else 30.0
        return self.model.languages[best], float(weight[best] / weight.sum() / (1 + np.exp(-np.clip(lead, -30, 30))))


def predict(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value, penalty)
        for batch in batches:
            found = [tagger.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, end_word, lang): the labelled spans of every document with letters."""
    common.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value, penalty)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (tagged := tagger.tag(text)) is not None:
                    labels = tagged[0]
                    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
                    rows += [(doc, a, b, shared.value.languages[labels[a]]) for a, b in zip(cuts, cuts[1:])]
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "first_word", "end_word", "lang"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, first_word long, end_word long, lang string")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the other four folds' labelled texts."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labelled = docs.where((fold != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    out = predict(docs, train(labelled))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

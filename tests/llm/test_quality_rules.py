import re
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest

from litspark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = (text or "").split("\n")
    dup = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit))


def test_counts_match_brute_force(messy, sample):
    for docs in (messy, sample):
        texts = [r["text"] for r in docs.select("text").collect()]
        for text in [t for t in texts if t is None or len(t) < 20_000]:
            assert Q.text_stats(text)[0] == brute(text)
    assert brute("a b c a b c")[4] == 6 and Q.repeat_words(b"a b c a b c".split()) == 6
    assert Q.repeat_words(b"a a a a".split()) == 4


def test_rows_for_messy_input(messy, nothing, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, None, 1), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.quality_rules(messy, labels).collect()
    assert len(out) == messy.count()
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[4]["base_failed"] and not by[4]["kept"] and by[4]["n_words"] == 0
    assert by[1]["kept"] and by[8]["n_words"] == 30_000
    assert Q.quality_rules(nothing, labels).count() == 0
    kept = Q.keep_good(messy, labels)
    assert kept.columns == messy.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3}
    assert Q.keep_good(messy, labels.limit(0)).count() == kept.count()  # no labels: base rule only


def test_binomial_bound_is_exact():
    for k, n, p in [(0, 10, 0.1), (3, 20, 0.2), (20, 20, 0.5)]:
        assert Q.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert not Q.certified(0, 100, 0.02, 0.0025) and Q.certified(0, 400, 0.02, 0.0025)


def test_cutoffs_are_certified_and_useful(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(600)]
    bad = [(1000 + i, " ".join(f"b{i}x{j}###" for j in range(60)), "en") for i in range(60)]
    few = [(5000 + i, " ".join(f"f{i}x{j}###" for j in range(60)), "fr") for i in range(20)]
    docs = spark.createDataFrame(good + bad + few, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 1000 or d >= 5000)) for d, *_ in good + bad + few], "doc_id long, quality int")
    out = {r["doc_id"]: r["kept"] for r in Q.quality_rules(docs, labels).collect()}
    assert all(out[d] for d, *_ in good) and not any(out[d] for d, *_ in bad)
    assert all(out[d] for d, *_ in few)  # too few labels there to certify anything


def levels(total, *above):
    """Documents per level, from the documents above each cutoff (the last one repeated)."""
    above = [*above, *[above[-1] if above else 0] * (len(Q.PATH) - len(above))]
    return np.diff([0, *above, total])[::-1].tolist()


def test_cutoffs_stop_at_the_first_uncertified():
    chosen = Q.choose_cutoffs({"en": (levels(1000, 0, 0, 500), levels(50, 0, 1, 50))}, 0.1, 0.05)
    assert chosen == {"en": Q.PATH[1]}
    assert Q.choose_cutoffs({"en": (levels(1000, 0), levels(10, 0))}, 0.1, 0.05) == {"en": None}
    assert Q.choose_cutoffs({}, 0.1, 0.05) == {}
    # 42 clean good documents suffice with four strata, 41 do not; bad ones alone certify nothing
    for n, cutoff in ((42, Q.PATH[0]), (41, None)):
        strata = {s: (levels(n, 0, n), levels(5, 5)) for s in ("de", "en", "es", "fr")}
        assert set(Q.choose_cutoffs(strata, 0.1, 0.05).values()) == {cutoff}
    assert Q.choose_cutoffs({"en": (levels(0), levels(9, 9))}, 0.1, 0.05) == {"en": None}


def test_a_finished_stratum_hands_its_share_on():
    small = (levels(33, 0, 33), levels(5, 5))
    assert Q.choose_cutoffs({"fr": small, "en": (levels(500, 0), levels(5, 5))}, 0.1, 0.05)["fr"] == Q.PATH[0]
    assert Q.choose_cutoffs({"fr": small, "en": (levels(500, 0, 400), levels(5, 5))}, 0.1, 0.05)["fr"] is None


def test_good_documents_are_rejected_within_the_risk():
    """Four strata whose true rejection passes alpha at a known cutoff: seldom is one of them over it."""
    draw = np.random.default_rng(3)
    rate = np.minimum(1.0, 0.01 * 1.6 ** np.arange(len(Q.PATH)))  # good documents above each cutoff
    share = np.diff([0, *rate, 1])[::-1]  # per level, the documents above no cutoff first
    failures, runs = 0, 400
    for _ in range(runs):
        tally = {}
        for s, n in (("de", 60), ("en", 900), ("es", 150), ("fr", 300)):
            counts = draw.multinomial(n, share).tolist()
            tally[s] = (counts, levels(40, *range(3, 40, 3)))
        over = [rate[Q.PATH.index(c)] > 0.1 for c in Q.choose_cutoffs(tally, 0.1, 0.05).values() if c is not None]
        failures += any(over)
    assert failures <= 0.05 * runs + 9  # two standard deviations of 400 runs


def plain_verdicts(docs, labels):
    """The verdicts of (doc_id, text, lang) rows from loops over lists and exact fractions."""
    by_id = {}
    for i, q in labels:
        if i is not None and q is not None:
            by_id[i] = min(by_id.get(i, 1), q)
    facts = []
    for i, text, lang in docs:
        words, text = WORD.findall(text or ""), text or ""
        n, _, symbols, dup, repeat = brute(text)
        lines = sum(1 for line in text.split("\n") if WORD.search(line))
        chars = sum(map(len, words))
        upper = sum(w.encode().isupper() for w in words)
        ratios = (symbols / max(chars, 1), dup / max(lines, 1), repeat / max(n, 1), upper / max(n, 1),
                  sum(c in "!?" for c in text) / max(n, 1))
        stratum = lang if lang and re.fullmatch("[a-z]{2,3}", lang) else "other"
        facts.append((i, stratum, n < 50 or 100 * repeat > 50 * n, max(r / x for r, x in zip(ratios, Q.LIMITS))))
    strata = {s for i, s, *_ in facts if i in by_id}

    def passes(stratum, cutoff, level):
        scores = [bad for i, s, _, bad in facts if s == stratum and by_id.get(i) == 1]
        k, n = sum(x > cutoff for x in scores), len(scores)
        tail = sum(Fraction(comb(n, j)) * Fraction(1, 10) ** j * Fraction(9, 10) ** (n - j) for j in range(k + 1))
        return n > 0 and 10 * k < n and tail <= level

    waiting, certified = set(strata), {s: [] for s in strata}
    for _ in range(len(strata) + 1):
        level = Fraction(1, 20) / max(1, len(waiting))
        for s in waiting:
            certified[s] = []
            for cutoff in Q.PATH:
                if not passes(s, cutoff, level):
                    break
                certified[s].append(cutoff)
        waiting = {s for s in waiting if len(certified[s]) < len(Q.PATH)}
    cutoffs = {}
    for s in strata:
        of = {q: [bad for i, t, _, bad in facts if t == s and by_id.get(i) == q] for q in (0, 1)}
        rejected = {q: {c: sum(bad > c for bad in of[q]) / max(1, len(of[q])) for c in Q.PATH} for q in (0, 1)}
        gains = [(rejected[0][c] - rejected[1][c], c) for c in certified[s]]
        best = max([g for g, _ in gains], default=0)
        cutoffs[s] = next(c for g, c in gains if g == best) if best > 0 else float("inf")
    return {i: not base and bad <= cutoffs.get(s, float("inf")) for i, s, base, bad in facts}, cutoffs


def test_verdicts_match_plain_loops_and_reject_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    marks = [(r["doc_id"], r["quality"]) for r in labels.collect()]
    want, cutoffs = plain_verdicts(rows, marks)
    got = {r["doc_id"]: r["kept"] for r in Q.quality_rules(docs, labels).collect()}
    assert got == want and any(c < float("inf") for c in cutoffs.values())
    assert {r["doc_id"] for r in Q.keep_good(docs, labels).collect()} == {i for i, kept in want.items() if kept}
    english = {i for i, _, lang in rows if lang == "en"}
    base = {r["doc_id"] for r in Q.document_stats(docs).where("base_failed").collect()}
    bad = [want[i] for i, q in marks if q == 0 and i in english]
    good = [want[i] for i, q in marks if q == 1 and i in english and i not in base]
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.95 * len(good)

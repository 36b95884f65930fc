import random

import numpy as np
from litspark.llm import decontaminate as D

from .conftest import PROSE


def naive_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_the_textbook_recursion():
    rng = random.Random(1)
    for _ in range(200):
        a = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 12))], np.uint64)
        b = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 20))], np.uint64)
        assert D.align(a, b)[0] == naive_align(a.tolist(), b.tolist())


def item(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randint(0, 400)}" for _ in range(n)]


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [w, "extra"] if x < 2 * share / 3 else ["changed"] if x < share else [w]
    return out


def test_finds_exact_and_edited_copies_only(spark):
    rng = random.Random(5)
    items = [item(rng, rng.randint(15, 60)) for _ in range(30)] + [["tiny", "item"]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    docs, want = [], set()
    for d in range(200):
        words = item(rng, 200)
        if d % 4 == 0:
            i = d % len(items)
            words[50:50] = edited(rng, items[i], 0.15) if d % 8 else [w.upper() + "," for w in items[i]]
            number = {w: n for n, w in enumerate(sorted(set(words) | set(items[i])))}
            plain = D.words_of(" ".join(words))
            if naive_align([number.get(w, -1) for w in items[i]], [number.get(w, -2) for w in plain]) >= D.MIN_SCORE * len(items[i]):
                want.add((d, i))
        docs.append((d, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for block_words in (D.BLOCK_WORDS, 200):  # one block, many blocks
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.find_contamination(table, bench, block_words=block_words).collect()}
        assert set(got) == want and len(want) > 40
        for (d, i), score in got.items():
            words = D.words_of(docs[d][1])
            number = {w: n for n, w in enumerate(sorted(set(words) | set(items[i])))}
            full = naive_align([number[w] for w in items[i]], [number[w] for w in words])
            assert abs(score - full / len(items[i])) < 1e-9
        clean = {r["doc_id"] for r in D.drop_contaminated(table, bench, block_words=block_words).collect()}
        assert clean == {d for d, _ in docs} - {d for d, _ in got}


def test_a_passage_in_every_document_is_still_rare(spark):
    words = item(random.Random(6), 40)
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"start {d} " + " ".join(words) + f" end {d}") for d in range(500)], "doc_id long, text string")
    assert D.find_contamination(docs, bench).count() == 500 and D.drop_contaminated(docs, bench).count() == 0


def aligned_fully(docs, items):
    out = {}
    for d, text in docs:
        plain = D.words_of(text)
        for i, words in items:
            score = naive_align(words, plain) / len(words)
            if score >= D.MIN_SCORE:
                out[d, i] = score
    return out


def test_hundreds_of_equal_edited_copies_are_found(spark):
    rng = random.Random(8)
    words = item(rng, 40)
    sevenths = [f"new{n}" if n % 7 == 6 else w for n, w in enumerate(words)]
    copies = [(d, f"start {d} " + " ".join(sevenths) + f" end {d}") for d in range(300)]
    # alone, beside a whole copy, and beside many texts with one seed each, which lower the median
    others = [[], [(900, " ".join(words))], [(1000 + n, f"other {n} " + " ".join(words[n: n + D.SEED_WORDS])) for n in range(30)]]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    one = aligned_fully(copies[:1], [(1, words)])
    for more in others:
        docs = copies + more
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.find_contamination(spark.createDataFrame(
            docs, "doc_id long, text string"), bench).collect()}
        assert got == {(d, 1): one[0, 1] for d, _ in copies} | aligned_fully(more, [(1, words)]) and len(got) >= 300


def test_evenly_edited_copies_are_found(spark):
    rng = random.Random(10)
    items = [(n, item(rng, n)) for n in (9, 10, 11, 12, 40, 41, 42, 43, 60)]
    new = lambda n: f"new{n}"
    docs = []
    for n, w in items:
        for k in (1, 2, 3, 4, 5):
            docs.append([x for i, y in enumerate(w) for x in ([y, new(i)] if i % k == k - 1 else [y])])  # one more after every k
            docs.append([new(i) if i % k == k - 1 else y for i, y in enumerate(w)])  # every k-th replaced
            docs.append([y for i, y in enumerate(w) if i % k != k - 1])  # every k-th left out
        docs += [edited(rng, w, share) for share in (0.3, 0.35, 0.4, 0.45) for _ in range(8)]
    docs = [(d, " ".join(item(rng, 20) + w + item(rng, 20))) for d, w in enumerate(docs)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.find_contamination(spark.createDataFrame(
        docs, "doc_id long, text string"), bench).collect()}
    assert got == aligned_fully(docs, items) and len(got) > 150


def test_long_items_are_scored_whole(spark):
    rng = random.Random(9)
    items = [(n, item(rng, n)) for n in (1001, 1003, 1007, 2500)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    docs = [(n, " ".join(item(rng, 30) + w[1000:1008] + item(rng, 30))) for n, w in items]  # the words after the first 1000
    docs += [(n + 1, " ".join(edited(rng, w, 0.15))) for n, w in items]
    docs += [(5000, " ".join(items[3][1][:1200])), (5001, " ".join(items[3][1][:1300]))]  # less and more than half
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for block_words in (D.BLOCK_WORDS, 1500):
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.find_contamination(table, bench, block_words=block_words).collect()}
        assert set(got) == {(n + 1, n) for n, _ in items} | {(5001, 2500)} and got[5001, 2500] == 1300 / 2500
        full = naive_align(items[0][1], D.words_of(docs[4][1])) / 1001
        assert abs(got[1002, 1001] - full) < 1e-9


def test_long_items_and_messy_rows(spark, messy, nothing):
    long_words = item(random.Random(7), 2500)
    bench = spark.createDataFrame([(1, " ".join(long_words)), (2, PROSE), (2, PROSE), (3, None)], "item_id long, text string")
    docs = messy.unionByName(messy.limit(1).selectExpr(*[
        "77L AS doc_id" if c == "doc_id" else f"'{' '.join(long_words)}' AS text" if c == "text" else c for c in messy.columns]))
    got = {(r["doc_id"], r["item_id"]) for r in D.find_contamination(docs, bench).collect()}
    assert got == {(1, 2), (2, 2), (3, 2), (None, 2), (77, 1)}
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 8, 9, 10, None}
    assert D.find_contamination(nothing, bench).count() == 0
    assert D.drop_contaminated(messy, bench.limit(0)).count() == messy.count()
    assert D.find_contamination(messy, bench.limit(0)).count() == 0


def test_short_items_with_every_third_word_replaced(spark):
    """Items of three to eight words keep a seed in every copy that scores 0.5."""
    rng = random.Random(11)
    items = [(n, item(rng, n)) for n in range(3, 9)]
    docs = []
    for n, words in items:
        for start in range(3):
            copy = [("changed" if k % 3 == start else w) for k, w in enumerate(words)]
            docs.append((len(docs), " ".join(item(rng, 30) + copy + item(rng, 30))))
            docs.append((len(docs), " ".join(item(rng, 30) + [x for k, w in enumerate(words) for x in ([w, "more"] if k % 2 == start % 2 else [w])])))
    want = aligned_fully(docs, items)
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    found = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found.collect()} == want and len(want) > 10


def test_words_as_bytes_are_the_words():
    known = D.WordHash()
    for text in ("Plain ASCII_9, text-with.signs\x1f\x00!", "Größe “quoted” — naïve… ÉTÉ\u00a0x", "İstanbul ǅ ½ ² ٣ 中文，字 a\u0301b", "", None, "…"):
        import xxhash
        assert D.hash_words(text, known).tolist() == [xxhash.xxh64_intdigest(w.encode()) for w in D.words_of(text)]

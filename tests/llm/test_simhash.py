import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from litspark.llm import components, simhash as S


def brute_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids_prints):
    rows, label = list(ids_prints), list(range(len(list(ids_prints))))
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 4 and label[i] != label[j]:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    out = {}
    for i, x in enumerate(label):
        members = [rows[j][0] for j, y in enumerate(label) if y == x and rows[j][0] is not None]
        out[i] = min(members, default=None)
    return sorted((rows[i][0] or -1, out[i] or -1) for i in out)


def test_masks_cover_every_pattern_within_the_radius():
    masks = S.covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(3000):
        differs = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & differs == 0 for m in masks)
    assert any(all(m & d for m in masks) for d in (sum(1 << i for i in rng.sample(range(64), 5)) for _ in range(3000)))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB é\n\t-ß\x0b\x85", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_print(text)


def test_bucket_links_span_components():
    rng = random.Random(2)
    for _ in range(20):
        base = [rng.getrandbits(64) for _ in range(4)]
        fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)}
        links = S.bucket_links(np.array(sorted(fps), np.uint64), 4)
        parent = {f: f for f in fps}
        for a, b in links:
            parent[a] = b
        groups = {}
        for f in fps:
            groups.setdefault(parent[f], set()).add(f)
        want = brute_groups([(i + 1, f) for i, f in enumerate(sorted(fps))])
        assert len(groups) == len({c for _, c in want})


@pytest.mark.parametrize("bucket_rows, crowd", [(S.BUCKET_ROWS, S.CROWD), (4, 1), (S.BUCKET_ROWS, 12)])
def test_groups_match_brute_force(spark, bucket_rows, crowd, monkeypatch):
    """Fingerprints put in place of texts' own: chains, crowds, copies and loners. All keys
    of so few rows are crowds, none is, and some are."""
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = random.Random(3)
    prints = []
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(10):
            prints.append(base ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))))
            base = prints[-1] if rng.random() < 0.3 else base
    prints += [rng.getrandbits(64) for _ in range(20)] + prints[:5] + prints[:1] * 20 + [0, 1, (1 << 64) - 1, (1 << 64) - 2]
    rows = [(i if i % 9 else None, S.signed(p)) for i, p in enumerate(prints, 100)]
    table = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(S, "fingerprints", lambda *a, **k: table)
    out = S.near_duplicates(table, bucket_rows=bucket_rows)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in out.collect())
    assert got == brute_groups([(d, p) for (d, _), p in zip(rows, prints)])


def test_messy_rows(messy, nothing, sample):
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in S.near_duplicates(messy).collect())
    assert got == brute_groups([(d, brute_print(t)) for d, t in rows])
    assert S.near_duplicates(nothing).count() == 0
    real = [(r["doc_id"], r["text"]) for r in sample.collect()]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in S.near_duplicates(sample).collect())
    assert got == brute_groups([(d, brute_print(t)) for d, t in real])


def test_keep_one(messy, nothing):
    out = S.keep_one(messy)
    assert out.columns == messy.columns
    groups = {(r["root"], r["component_id"]) for r in S.near_duplicates(messy).collect()}
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(x or -1 for x in kept) == sorted(c or -1 for _, c in groups)
    assert S.keep_one(nothing).count() == 0


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 100), (1, 0)]
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["vertex"]: r["root"] for r in out.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 150)}, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_column_named_like_the_key_is_kept(spark):
    from litspark.llm.simhash import keep_one
    docs = spark.createDataFrame([(1, "same text here now", 5, 6), (2, "same text here now", 5, 6), (3, "another one altogether", 5, 6)],
                                 "doc_id long, text string, near_key int, _near_key int")
    assert sorted(tuple(r) for r in keep_one(docs).collect()) == [(1, "same text here now", 5, 6), (3, "another one altogether", 5, 6)]

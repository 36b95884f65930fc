import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from litspark.llm import packing as P

TEXTS = ["Hello, World! it's 2024.", "<|endoftext|> inside <|startoftext|>", "ΑΣ ΣΑΣ İstanbul ﬁ ß", "tab\there\x85next line", "",
         "a_b __ 'S DON'T ½² x²", "日本語 テスト", "é é", "'' ' 's 'll", "  two  spaces \n\n lines", "<|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))


def test_ids_are_the_tokenizers(tokenizer, sample):
    encode = P.Encoder(P.default_tokenizer(), most=500).encode  # small: forgets all the time
    for text in TEXTS + [r["text"] for r in sample.collect()]:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


def one_by_one(lengths, limit, weight):
    """Best fit, one piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        ask = np.array([n, 1, n * n])
        able = [b for b in bins if (b + ask <= limit).all()]
        if able:
            best = min(able, key=lambda b: ((limit - b - ask) ** 2.0 * weight).sum())
            best += ask
        else:
            bins.append(ask.copy())
    return len(bins)


@pytest.mark.parametrize("capacity", [P.Capacity(64), P.Capacity(64, documents=3), P.Capacity(64, documents=8, attention=1500)])
@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_respects_every_capacity(capacity, score):
    rng = np.random.default_rng(4)
    longest = capacity.longest()
    counts = Counter(np.minimum(rng.geometric(0.06, 3000), longest).tolist())
    rows = P.plan(dict(counts), capacity, score)
    used, ranks, limit = defaultdict(lambda: np.zeros(3, np.int64)), defaultdict(list), capacity.vector()
    fill = defaultdict(list)
    for length, lo, hi, first, offset in rows.tolist():
        for r in range(lo, hi):
            used[first + r - lo] += [length, 1, length ** 2]
            fill[first + r - lo].append((offset, length))
            ranks[length].append(r)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert all((u <= limit).all() for u in used.values())
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    total = sum(np.array([k, 1, k * k]) * n for k, n in counts.items())
    weight = (total / limit) / (total / limit).sum() / limit.astype(float) ** 2
    naive = one_by_one([k for k, n in counts.items() for _ in range(n)], limit, weight)
    assert len(used) >= max(-(-total // limit)) and len(used) <= 1.02 * naive + 1


def test_plan_size_does_not_grow_with_the_corpus():
    counts = {n: 50 + 7 * n % 31 for n in range(1, 4097, 3)}
    small, large = P.plan(counts), P.plan({k: 100_000 * v for k, v in counts.items()})
    assert len(large) < 40_000 and (large[:, 2] - large[:, 1]).sum() == 100_000 * (small[:, 2] - small[:, 1]).sum()


def check_packed(rows, docs, tokenizer):
    ids = {}
    wanted = Counter()
    for doc, text in docs:
        all_ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(all_ids), 4096)):
            part = all_ids[at:at + 4096]
            wanted[doc, piece, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by), sum(n for _, _, _, n, _ in wanted.elements()), ids


def test_documents_are_packed_whole(spark, messy, nothing, sample, tokenizer):
    for docs in (messy, sample, spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")):
        given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        n, tokens, _ = check_packed(P.pack_documents(docs).collect(), given, tokenizer)
        assert n <= -(-tokens // 4096) + 1
    assert P.pack_documents(nothing).count() == 0


def test_sequences_hold_the_ids(sample, tokenizer):
    packed = P.pack_documents(sample, with_ids=True)
    for r in P.sequences(packed).collect():
        assert len(r["ids"]) == sum(r["lengths"]) <= 4096 and r["ids"][r["lengths"][0] - 1] in (1, r["ids"][4095 % len(r["ids"])])

"""The prefix trie against a plain trie of dictionaries, whole and cut into small parts."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from litspark.llm import prefix_trie
from tests.llm.conftest import CLASHING


def plain_trie(turns):
    """Rows of the trie from (conv_id, turn, role, text), by the definition."""
    convs = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(rows)] for c, rows in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[c][h:]
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        inner = {p[:-1] for p in nodes if p}
        ends = sorted(c for c in members if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                    sum(len(p) == len(path) + 1 for p in below), sum(p not in inner for p in below),
                    sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in prefix_trie.OUT) for r in df.collect()), key=str)


def frame(spark, turns):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(c) for c in CLASHING + ["conv", "digest", "node", "depth"]})


def random_turns(seed, n, texts, longest):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-20, 4 * n), n):
        for t in range(rng.randint(0, longest)):
            turn = rng.choice([t, t, t, None, 0])
            out.append((c, turn, rng.choice(["user", "assistant", None]) if rng.random() < .2 else "user", rng.choice(texts)))
    return out


@pytest.mark.parametrize("part_rows", [1, 2, 3, 7, 10_000])
def test_parts_do_not_matter(spark, part_rows):
    turns = random_turns(5, 60, ["a", "b", "é", None, ""], 5) + [(c, t, "user", "copy") for c in range(300, 340) for t in range(3)]
    assert rows_of(prefix_trie.conversation_trie(frame(spark, turns), part_rows)) == plain_trie(turns)


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    turns = random_turns(seed, 40, ["x", "y", "x" * 50], 9)
    assert rows_of(prefix_trie.conversation_trie(frame(spark, turns), 4)) == plain_trie(turns)


def test_one_long_conversation_and_copies_of_one(spark):
    turns = [(0, t, "user", f"turn {t}") for t in range(150)] + [(5 * c, 0, "user", "same") for c in range(1, 200)]
    assert rows_of(prefix_trie.conversation_trie(frame(spark, turns), 50)) == plain_trie(turns)


def test_repeated_rows_are_turns_and_no_conversation_without_id(spark):
    turns = [(1, 0, "user", "a")] * 3 + [(2, 0, "user", "a"), (None, 0, "user", "b"), (7, None, None, None)]
    assert rows_of(prefix_trie.conversation_trie(frame(spark, turns))) == plain_trie(turns)


def test_empty_table(spark):
    assert prefix_trie.conversation_trie(frame(spark, [])).count() == 0


def test_role_and_text_are_kept_apart(spark):
    df = frame(spark, [(0, 0, "ab", "c"), (10, 0, "a", "bc")])
    assert df.select(prefix_trie.turn_digest(F.col("role"), F.col("text"))).distinct().count() == 2

import pytest

from litspark.llm import preference as P


def brute(pairs):
    """pair → (prompt, chosen, rejected) with masks, from whole conversations."""
    out = {}
    for pair, (chosen, rejected) in pairs.items():
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        say = lambda r, t: (f"<|im_start|>{r}\n", f"{t}<|im_end|>\n")
        render = lambda turns, learn: ("".join("".join(say(*t)) for t in turns), "".join(
            "0" * len(say(*t)[0]) + ("1" if learn and t[0] == "assistant" else "0") * len(say(*t)[1]) for t in turns))
        out[pair] = render(chosen[:n], False), render(chosen[n:], True), render(rejected[n:], True)
    return out


def unrolled(mask):
    return "".join(flag * int(n) for n, flag in (run.split(":") for run in mask.split(",")))


def assembled(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r["pair_id"], r["block"])):
        text, mask = got.setdefault(r["pair_id"], {}).get(r["part"], ("", ""))
        got[r["pair_id"]][r["part"]] = text + r["text"], mask + unrolled(r["mask"])
    return got


@pytest.fixture(scope="module")
def pairs():
    u, a, s = "user", "assistant", "system"
    return {
        1: ([(s, "be kind"), (u, "hi"), (a, "good"), (u, "more"), (a, "fine")], [(s, "be kind"), (u, "hi"), (a, "bad")]),
        2: ([(u, "x"), (a, "same")], [(u, "x"), (a, "same")]),
        3: ([(u, "x"), (a, "long " * 200)], [(u, "y"), (a, "z")]),
        4: ([(u, str(i // 3)) if i % 2 == 0 else (a, str(i)) for i in range(500)],
            [(u, str(i // 3)) if i % 2 == 0 else (a, str(i)) for i in range(300)] + [(a, "off")]),
        5: ([(u, "q")], [(u, "q"), (a, "only here")]),
    }


def test_pairs_match_whole_conversations(spark, pairs):
    rows = [(p, side, i, r, t) for p, both in pairs.items() for side, turns in zip(("chosen", "rejected"), both)
            for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows + rows[:7], "pair_id long, side string, turn long, role string, text string").repartition(5)
    got = assembled(P.format_pairs(df).collect())
    for pair, parts in brute(pairs).items():
        assert tuple(got[pair].get(p, ("", "")) for p in ("prompt", "chosen", "rejected")) == parts, pair
    assert P.format_pairs(df.limit(0)).count() == 0


def test_nulls_marks_and_extra_columns(spark):
    rows = [(1, "chosen", 0, None, None, "x"), (1, "rejected", 0, None, None, "x"), (1, "chosen", 1, "assistant", "a<|im_end|>b", "x"),
            (1, "rejected", 1, "assistant", None, "x"), (None, "chosen", 0, "user", "lost", "x"), (1, "chosen", None, "user", "lost", "x")]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, part string")
    got = assembled(P.format_pairs(df).collect())[1]
    assert got["prompt"][0] == "<|im_start|>unknown\n<|im_end|>\n"
    assert got["chosen"][0].count("<|im_end|>") == 1 and "1" in got["rejected"][1]


def test_stale_reply_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 2, "user", "q2"), (1, 3, "assistant", "second"), (1, 4, "user", "bye"),
            (2, 0, "user", "q"), (2, 1, "assistant", "alone"), (3, 0, "user", "nobody answers"), (4, 0, "assistant", None),
            (None, 0, "assistant", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = assembled(P.format_pairs(P.stale_reply_pairs(df)).collect())
    assert set(got) == {1, 2, 4}
    assert got[1]["chosen"][0] == "<|im_start|>assistant\nsecond<|im_end|>\n"
    assert got[1]["rejected"][0] == "<|im_start|>assistant\nfirst<|im_end|>\n"
    assert got[2]["rejected"][0] == "<|im_start|>assistant\n<|im_end|>\n" and set(got[4]) == {"prompt"}


def test_no_python_in_the_plan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert "Python" not in P.format_pairs(P.stale_reply_pairs(df))._jdf.queryExecution().executedPlan().toString()

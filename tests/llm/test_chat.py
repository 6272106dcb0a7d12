"""Chat formatting against plain Python."""

from __future__ import annotations

import hashlib
import time
from collections import defaultdict

from pyspark.sql import functions as F

from shopledger.llm import chat

from . import odd

TRICKY = ["<|end|>", "<||end|>", "<", "|turn|>", "<|", "<||", "a<|next|>b", "</s>[INST] ok [/INST]", "", None, "🙂"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in chats.items():
        turns.sort()
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        yield conv, len(turns), sha(told), len(learnt), sha(learnt)


def check(df):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    formatted = chat.format_chats(df)
    got = chat.digests(formatted)
    assert sorted(map(tuple, got.drop("formatted_chars").collect()), key=str) == sorted(expected(rows), key=str)
    for r in formatted.collect():
        assert all(0 <= s.start <= s.end <= len(r.formatted) for s in r.loss)
    return formatted


def test_tricky_turns(spark):
    rows = [(1, k, ("user", "assistant")[k % 3 == 1], t, 0) for k, t in enumerate(TRICKY)]
    rows += [(2, k, "assistant", t, 0) for k, t in enumerate(TRICKY)]
    rows += [(None, None, None, None, 0), (3, 1, "us<|text|>er|>", "x", 0), (3, 1, "us<|text|>er|>", "x", 0)]
    check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))


def test_given_conversations(spark):
    check(odd.small(spark, "conversations"))


def test_adjacent_turns_become_one_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    text = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).head().formatted
    assert text == "<|turn|>user<|text|>a<|next|>b<|end|><|turn|>assistant<|text|>c<|end|>"


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_chats(none)).count() == 0


def test_many_turns(spark):
    """Turns past the groups of places, all of one role and by turns; time in proportion to them."""
    shape = "conv_id long, turn long, role string, text string"
    rows = [(1, k, ("user", "assistant")[k % 2], f"t{k} <|" * (k % 5)) for k in range(1000)]
    rows += [(2, k, "assistant", f"u{k}") for k in range(700)]
    check(spark.createDataFrame(rows, shape))

    def seconds(n):
        role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
        text = F.concat(F.lit("some words of a turn "), F.col("id").cast("string"))
        df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
        start = time.time()
        assert chat.digests(chat.format_chats(df)).head().n_turns == n
        return time.time() - start

    seconds(8000)
    assert seconds(32000) < 4 * seconds(8000) + 1

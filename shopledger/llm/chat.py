"""Chat formatting by sorting, merging and joining turn structs, in Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role
become one block, in which a mark keeps the turns apart; blocks are joined to one text.
Control strings start with ``<|`` and a letter; in roles and texts, ``<|`` becomes ``<||``,
which no control string contains, so texts can be read back whatever they hold.

The loss mask is the spans of assistant texts in the formatted text, in code points.

Defined cases: a null text is empty, a null role is the empty role, rows without a
``conv_id`` form one conversation; turns with equal numbers are ordered by role and text,
null numbers come first; repeated rows stay; an empty table gives no rows; other columns
are ignored. A conversation is one text, so its turns meet in one task at the end; they
are collected in every map task first. Time is in proportion to the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import in_groups, let, running

#: The template's control strings.
OPEN, BODY, NEXT, CLOSE = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as (role, texts): slices between the places where the role changes."""

    def cut(turns: Column) -> Column:
        role = lambda i: F.get(turns, i)["role"]
        places = F.sequence(F.lit(0), F.size(turns) - 1)
        opens = F.filter(places, lambda i: (i == 0) | (role(i - 1) != role(i)))

        def block(at: Column, i: Column, k: Column) -> Column:
            own = F.slice(turns, i + 1, F.coalesce(F.get(at, k + 1), F.size(turns)) - i)
            texts = F.transform(own, lambda t: escape(t["text"]))
            return F.struct(role(i).alias("role"), texts.alias("texts"))

        return let(opens, lambda at: F.transform(at, lambda i, k: block(at, i, k)))

    return let(turns, cut)


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the text, and the spans under the loss mask, a conversation a row."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = gathered.select("conv_id", _blocks(F.col("turns")).alias("blocks"))
    head = lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(BODY))
    written = F.transform(
        "blocks",
        lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE)),
    )
    lead = lambda b, k, i: F.when(i > 0, len(NEXT)).otherwise(
        F.length(head(b)) + F.when(k > 0, len(CLOSE)).otherwise(0)
    )
    steps = F.flatten(
        F.transform(
            "blocks",
            lambda b, k: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    lead(b, k, i).alias("lead"), F.length(t).alias("n"), (b["role"] == ASSISTANT).alias("learnt")
                ),
            ),
        )
    )

    def spans(steps: Column) -> Column:
        at = running(F.transform(steps, lambda s: s["lead"] + s["n"]))
        found = F.zip_with(
            steps,
            at,
            lambda s, p: F.struct(
                (p + s["lead"]).alias("start"), (p + s["lead"] + s["n"]).alias("end"), s["learnt"].alias("learnt")
            ),
        )
        learnt = F.filter(found, lambda s: s["learnt"])
        return F.transform(learnt, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    loss = let(steps, spans)
    return blocks.select("conv_id", F.array_join(written, "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The (role, text) turns of a formatted text, unescaped."""
    closed = F.split(formatted, r"<\|end\|>", -1)
    blocks = F.slice(closed, 1, F.size(closed) - 1)

    def turns(head: Column) -> Column:
        role = F.substring(head[0], F.lit(len(OPEN) + 1), F.length(head[0]))
        return let(
            unescape(role),
            lambda r: F.transform(
                F.split(head[1], r"<\|next\|>", -1),
                lambda t: F.struct(r.alias("role"), unescape(t).alias("text")),
            ),
        )

    return F.flatten(F.transform(blocks, lambda b: let(F.split(b, r"<\|text\|>", 2), turns)))


def learnt_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped; each group of spans is cut out before its spans are."""

    def cut(text: Column, spans: Column) -> Column:
        first, last = F.get(spans, F.lit(0))["start"], F.get(spans, F.size(spans) - 1)["end"]
        return let(
            F.struct(F.substring(text, first + 1, last - first).alias("text"), first.alias("from")),
            lambda p: F.transform(
                spans, lambda s: unescape(F.substring(p["text"], s["start"] - p["from"] + 1, s["end"] - s["start"]))
            ),
        )

    return F.flatten(let(formatted, lambda text: F.transform(in_groups(loss), lambda spans: cut(text, spans))))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted texts and their loss spans."""
    df = formatted.withColumn("_turns", read_back(F.col("formatted")))
    told = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join(learnt_texts(F.col("formatted"), F.col("loss")), "")
    df = df.withColumn("_learnt", learnt)
    return df.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("_learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

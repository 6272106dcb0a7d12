"""Line-first quality rules, in Spark expressions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines are
removed, and a document that loses too much of its text is rejected. Before that, two
rules on the whole text reject documents that are very short or mostly repeat themselves.

Defined cases: a null text has no words and is rejected; so is a text of white space;
lines without a word are neither kept nor counted; repeated rows are judged alike; a
table without rows gives none; columns of the input other than ``doc_id`` and ``text``
are left alone by ``clean``, whatever their names, and ignored by ``measures``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import SPACE, WORD, whole_rows

#: Marks that end a sentence, and marks that part the entries of a menu.
SENTENCE_END = r"[.!?…。！？।][\"'”’»)\]]*"
MENU_MARKS = "|»›•·→"
#: Phrases of notices that belong to a site and not to a text.
BOILERPLATE = (
    "cookie policy", "use of cookies", "we use cookies", "accept cookies", "privacy policy",
    "terms of use", "terms of service", "terms and conditions", "all rights reserved",
    "lorem ipsum", "enable javascript", "javascript is disabled", "sign up for our newsletter",
    "subscribe to our newsletter", "click here to", "share on facebook", "powered by wordpress",
)


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    most_repeated_percent: int = 30
    #: a line passes the punctuation rule with a sentence end per so many words
    words_per_end: int = 80
    #: a line of so many words fails if more than every second one ends a sentence
    shout_words: int = 8
    #: a menu holds this many marks, and one per so many words at least
    menu_marks: int = 3
    words_per_mark: int = 3
    #: notices are short; a long line that mentions one is prose
    notice_words: int = 40
    #: a document goes if lines with more than this share of its words went
    most_lost_percent: int = 60
    symbols: str = "#*$%&|<>"
    #: a line also fails if it has this many of the symbols for each hundred words
    symbols_per_100_words: int = 60


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _line_fails(line: Column, n: Column, r: Rules) -> Column:
    ends = F.size(F.split(line, rf"{SENTENCE_END}(?=[\x20\x09-\x0D]|$)", -1)) - 1
    marks = _count(line, MENU_MARKS)
    lowered = F.lower(line)
    notice = F.lit(False)
    for phrase in BOILERPLATE:
        notice = notice | lowered.contains(phrase)
    unpunctuated = (ends * r.words_per_end < n) | ((n >= r.shout_words) & (ends * 2 > n))
    menu = (marks >= r.menu_marks) & (marks * r.words_per_mark >= n)
    symbols = _count(line, r.symbols) * 100 >= n * r.symbols_per_100_words
    return unpunctuated | menu | symbols | ((n <= r.notice_words) & notice)


def _with_repeated(df: DataFrame, window: int = 8) -> DataFrame:
    """``_repeated``: the words of ``_words`` in windows that occur twice or more.

    Equal windows have equal hashes; only texts that have some go on to sort (hash,
    place), mark the places whose neighbour has the same hash, and add up the union
    of the windows there. Nothing leaves the row.
    """
    n = F.col("_n")
    places = F.sequence(F.lit(1), n - (window - 1))
    df = df.withColumn(
        "_hashes",
        F.when(n > window, F.transform(places, lambda i: F.xxhash64(F.slice("_words", i, window)))),
    )
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    pairs = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    df = df.withColumn("_pairs", F.when(twice, pairs))
    following = F.slice("_pairs", 2, F.size("_pairs"))
    df = df.withColumn(
        "_same",
        F.when(
            F.col("_pairs").isNotNull(),
            F.zip_with("_pairs", following, lambda p, q: F.coalesce(p["h"] == q["h"], F.lit(False))),
        ),
    )
    hit = F.zip_with("_same", F.concat(F.array(F.lit(False)), "_same"), lambda a, b: a | b)
    at = F.filter(F.zip_with("_pairs", hit, lambda p, s: F.when(s, p["i"])), F.isnotnull)
    covered = F.aggregate(
        F.array_sort(at),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total")),
        lambda acc, i: F.struct(
            (i + window).alias("end"),
            (acc["total"] + i + window - F.greatest(i, acc["end"])).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return df.withColumn("_repeated", F.when(F.col("_same").isNotNull(), covered).otherwise(F.lit(0)).cast("long"))


def _judged(docs: DataFrame, r: Rules) -> DataFrame:
    """The rows with all measures in columns that start with an underscore."""
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumn("_words", _words(text)).withColumn("_n", F.size("_words"))
    df = _with_repeated(df)
    df = df.withColumn(
        "_lines",
        F.transform(
            F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)),
            lambda x: F.struct(x.alias("line"), F.size(_words(x)).alias("n")),
        ),
    )
    df = df.withColumn("_good", F.filter("_lines", lambda x: ~_line_fails(x["line"], x["n"], r)))
    left = F.aggregate("_good", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    base = (F.col("_n") < r.least_words) | (F.col("_repeated") * 100 > F.col("_n") * r.most_repeated_percent)
    lost = (F.col("_n") - left) * 100 > F.col("_n") * r.most_lost_percent
    # the row number keeps the optimizer from moving a filter on the verdict below these
    # columns, where it would work them out again inside every lambda
    here = F.monotonically_increasing_id() >= 0
    return df.withColumns({"_base": base, "_kept": ~base & ~lost & here})


def measures(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Measures and verdict of every row, under its ``doc_id``."""
    df = _judged(docs.select("doc_id", "text"), rules)
    text = F.coalesce("text", F.lit(""))
    lines = F.transform("_lines", lambda x: x["line"])
    return df.select(
        "doc_id",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        _count(text, rules.symbols).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.col("_repeated").alias("n_repeat_words"),
        F.col("_base").alias("base_failed"),
        F.col("_kept").alias("kept"),
    )


@whole_rows
def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents, without their failing lines, in the columns they came with.

    A text none of whose lines fail is handed on unchanged, blank lines included.
    """
    names = docs.columns
    df = _judged(docs, rules).where("_kept")
    good = F.array_join(F.transform("_good", lambda x: x["line"]), "\n")
    text = F.when(F.size("_good") < F.size("_lines"), good).otherwise(F.col("text"))
    return df.withColumn("text", text).select(*names)

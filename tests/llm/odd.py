"""Rows that every operator must bear: nulls, empty and very long texts, repeated rows, clashing columns."""

from __future__ import annotations

SHAPE = "doc_id long, text string, lang string, n_chars long, n_words long, kept boolean"

PROSE = "The quick brown fox jumps over the lazy dog near the old stone bridge, and then it rests. "

OTHER = "Every river in that valley was once a road for boats, as the older maps of the town still show. "

TEXTS = [
    None,
    "",
    " \t\n\r\x0b\x0c ",
    "word",
    PROSE * 3,
    PROSE * 3,
    PROSE * 400,
    "x" * 30000,
    "1 " * 12000 + "@" * 3000,
    "naïve ÇA Σίσυφος ΣΑΣ 日本語 🙂 \u0085 é <|endoftext|> I'LL don't !!'s",
    "Write to a@b.c_d@e.fg, or x@y, from 10.0.0.256 or 010.2.3.4.5 today.",
    "Card 4111 1111 1111 1111 and 4111-1111-1111-1112, call +1 (555) 010-9999 9 or +12 3. "
    "Account GB82 WEST 1234 5698 7654 32 is a bank one; ssn 078-05-1120; not 078-05-1121x.",
    "Home | News | About | Contact\nUse of cookies: accept cookies.\n" + PROSE + "\n\n" + OTHER,
    "a b c d e f g h i j a b c d e f g h i j a b c d e f g h k",
]


def documents(spark, texts=None):
    texts = TEXTS if texts is None else texts
    rows = [(k, t, None, 7, 1, False) for k, t in enumerate(texts)]
    rows += [(3, "word", "en", None, None, None)] * 2 + [(None, PROSE, None, None, None, None)]
    return spark.createDataFrame(rows, SHAPE)


def empty(spark):
    return spark.createDataFrame([], SHAPE)


def small(spark, table="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")

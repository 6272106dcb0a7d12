"""Interpolated modified Kneser-Ney n-gram scores of texts.

N-grams are counted by Spark: each task hashes the words of its training texts and counts
the n-grams of its own part, the counts are dealt by context hash and added up, and each
of the dealt parts becomes a sorted array of context hashes with the words seen after them.
The arrays are files in the folder all executors share; a worker maps them into memory and
reads only the pages its lookups touch. Nothing of the model passes the driver but its
totals: counts of counts, tokens and distinct words.

Words are 64-bit hashes of lower-cased bytes. Texts end in one end token, and are preceded
by start marks that are context but are never scored. A word never seen in training gets
the share of the uniform distribution that the lowest order leaves.

Defined cases: a null text is an empty one and scores its end token alone; a null ``doc_id``
is written as the empty text for the choice of training rows; repeated rows count as often
as they occur; with nothing to learn from, every token gets the uniform share; an empty
table gives no rows; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .tables import as_text, exact_ids, keep, parts_for
from .textblock import TextBlock, U64, batches, mix

END, START = U64(0x656E64), U64(0x7374617274)
_ENTRY = np.dtype([("context", "<u8"), ("word", "<u8"), ("count", "<u4")])
#: What the order below counts of a word: the distinct contexts it follows, and all its places.
_WORD = np.dtype([("word", "<u8"), ("contexts", "<u4"), ("count", "<u8")])
#: Rows of a model file: context hash; sum of its counts; words with count 1, 2, 3 or more.
_CONTEXT = np.dtype([("context", "<u8"), ("total", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])
_COUNT = np.dtype([("gram", "<u8"), ("count", "<u4")])
_ONCE = np.dtype([("gram", "<u8")])
_KINDS = {"contexts": _CONTEXT, "grams": _COUNT, "once": _ONCE, "words": _WORD}
#: A task adds up so many entries before it hands them on.
_GATHER = 4_000_000
#: A worker keeps so many files mapped; from a store without maps, so many in memory, of some 30 MB at most.
_MAPS, _FETCHED = 4096, 8


def is_held_out(doc_ids) -> np.ndarray:
    """Which ids, as longs or as texts, stand for held-out rows."""
    return np.array([zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d in doc_ids], bool)


@dataclass(frozen=True)
class Level:
    """One order's files and discounts."""

    folder: str
    parts: int
    discounts: tuple[float, float, float]


@dataclass(frozen=True)
class Model:
    low: Level  # words: by the contexts they follow, and plainly
    high: Level  # words after one other word
    tokens: int
    words: int
    #: sum and counts of counts of the low level, as for one context
    below: tuple[float, float, float, float]


def token_stream(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with one end token a text, index of each text's first token, tokens of each)."""
    hashes, first = TextBlock(texts).words()
    n = np.diff(first)
    stream = np.empty(len(hashes) + len(n), np.uint64)
    ends = first[1:] + np.arange(len(n))
    is_end = np.zeros(len(stream), bool)
    is_end[ends] = True
    stream[is_end] = END
    stream[~is_end] = hashes
    return stream, first[:-1] + np.arange(len(n)), n + 1


def contexts(stream: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the words before each token, for orders 1 to ``order``."""
    n = len(stream)
    start = np.zeros(n, np.int64)
    start[first] = first
    start = np.maximum.accumulate(start)
    place = np.arange(n) - start
    out = [np.zeros(n, np.uint64)]
    for k in range(1, order):
        before = np.full(n, START, np.uint64)
        inside = place >= k
        before[inside] = stream[np.flatnonzero(inside) - k]
        out.append(mix(out[-1] * U64(3) + before + U64(k)))
    return out


def gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context ^ (word * U64(0x9E3779B97F4A7C15)))


def _add_up(entries: np.ndarray) -> np.ndarray:
    """Entries with equal context and word made one, in order of both."""
    if not len(entries):
        return entries
    entries = entries[np.lexsort((entries["word"], entries["context"]))]
    new = np.ones(len(entries), bool)
    new[1:] = (entries["context"][1:] != entries["context"][:-1]) | (entries["word"][1:] != entries["word"][:-1])
    at = np.flatnonzero(new)
    out = entries[at]
    out["count"] = np.add.reduceat(entries["count"].astype(np.uint64), at)
    return out


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of sorted keys start."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])


def _packed(entries: np.ndarray) -> bytes:
    """Sorted entries in few bytes: contexts once a run, words as places in a sorted list."""
    import zstandard

    at = _starts(entries["context"])
    words, place = np.unique(entries["word"], return_inverse=True)
    parts = (
        np.array([len(entries), len(at), len(words)], "<u8"), entries["context"][at],
        np.diff(np.r_[at, len(entries)]).astype("<u4"), words, place.astype("<u4"), entries["count"],
    )
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).tobytes() for x in parts))


def _unpacked(block: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(block)
    n, runs, words = (int(x) for x in np.frombuffer(raw, "<u8", 3))
    at, parts = 24, []
    for kind, size in (("<u8", runs), ("<u4", runs), ("<u8", words), ("<u4", n), ("<u4", n)):
        parts.append(np.frombuffer(raw, kind, size, at))
        at += parts[-1].nbytes
    out = np.empty(n, _ENTRY)
    out["context"] = np.repeat(parts[0], parts[1])
    out["word"] = parts[2][parts[3]]
    out["count"] = parts[4]
    return out


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U64(20)) % U64(parts)).astype(np.int64)


def _dealt(rows: np.ndarray, key: str, parts: int):
    """(part, rows of it), in the order the rows had."""
    part = _parts_of(rows[key], parts)
    by = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[by], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), rows[by[edges[p] : edges[p + 1]]]


def _store(folder: str, name: str, array: np.ndarray) -> None:
    """Write a file whole: tasks may run twice, so it gets its name only when complete."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(array.tobytes())
    system.move(own, f"{path}/{name}")


def _opened(folder: str, kind: str, part: int) -> np.ndarray:
    """The rows of a model file; one that isn't there raises, since every part writes all of its files."""
    return (_mapped if folder.startswith("file:") else _fetched)(folder, kind, part)


@lru_cache(_MAPS)
def _mapped(folder: str, kind: str, part: int) -> np.ndarray:
    """The file mapped into memory; the map stays when the file is closed, so no descriptor is held."""
    import pyarrow as pa
    from pyarrow import fs

    path = fs.FileSystem.from_uri(folder)[1]
    with pa.memory_map(f"{path}/{kind}-{part}") as file:
        return np.frombuffer(file.read_buffer(), _KINDS[kind]) if file.size() else np.zeros(0, _KINDS[kind])


@lru_cache(_FETCHED)
def _fetched(folder: str, kind: str, part: int) -> np.ndarray:
    """The file read into memory, from a store that has no maps."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(f"{path}/{kind}-{part}") as source:
        return np.frombuffer(source.read(), _KINDS[kind])


def _uri(spark) -> str:
    folder = shared_folder(spark)
    return folder if "://" in folder else f"file://{folder}"


def _seen(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, those from 3 on, and their sum."""
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)] + [
        int(np.count_nonzero(counts >= 3)), int(counts.sum(dtype=np.int64)), len(counts),
    ]


def _store_high(part: int, pieces: list[bytes], folder: str, parts: int):
    """Write a part of the high level; its counts of counts, and what the low level counts."""
    entries = _add_up(np.concatenate([np.zeros(0, _ENTRY), *(_unpacked(p) for p in pieces)]))
    counts = entries["count"]
    at = _starts(entries["context"])
    by = np.zeros(len(at), _CONTEXT)
    by["context"] = entries["context"][at]
    by["total"] = np.add.reduceat(counts.astype(np.int64), at)
    for name, hit in (("n1", counts == 1), ("n2", counts == 2), ("n3", counts >= 3)):
        by[name] = np.add.reduceat(hit.astype(np.int64), at)
    _store(folder, f"contexts-{part}", by)
    grams = gram(entries["context"], entries["word"])
    order = np.argsort(grams)
    order_1 = order[counts[order] == 1]
    order_n = order[counts[order] > 1]
    _store(folder, f"once-{part}", grams[order_1])
    often = np.empty(len(order_n), _COUNT)
    often["gram"], often["count"] = grams[order_n], counts[order_n]
    _store(folder, f"grams-{part}", often)
    words, place = np.unique(entries["word"], return_inverse=True)
    below = np.empty(len(words), _WORD)
    below["word"] = words
    below["contexts"] = np.bincount(place, minlength=len(words))
    below["count"] = np.bincount(place, weights=counts, minlength=len(words))
    yield None, None, [*_seen(counts), 0]
    for p, rows in _dealt(below, "word", parts):
        yield p, rows.tobytes(), None


def _store_low(part: int, pieces: list[bytes], folder: str, parts: int):
    """Write a part of the low level; its counts of counts."""
    rows = np.concatenate([np.zeros(0, _WORD), *(np.frombuffer(p, _WORD) for p in pieces)])
    rows = rows[np.argsort(rows["word"], kind="stable")]
    at = _starts(rows["word"])
    out = rows[at]
    out["contexts"] = np.add.reduceat(rows["contexts"].astype(np.int64), at)
    out["count"] = np.add.reduceat(rows["count"], at)
    _store(folder, f"words-{part}", out)
    yield None, None, [*_seen(out["contexts"]), int(out["count"].sum())]


def _reduce(blocks: DataFrame, folder: str, parts: int, store) -> DataFrame:
    """Add up and store the blocks of each part; what ``store`` yields, as (part, block, seen).

    Every part gets an empty block too, so that one without entries writes its files like any other.
    """

    def run(frames):
        import pandas as pd

        got: dict[int, list[bytes]] = {}
        for frame in frames:
            for part, block in zip(frame["part"], frame["block"]):
                got.setdefault(int(part), []).extend([block] if len(block) else [])
        for part in list(got):
            rows = list(store(part, got.pop(part), folder, parts))
            made = pd.DataFrame(rows, columns=["part", "block", "seen"])
            yield made.assign(part=made["part"].astype("Int32"))

    every = blocks.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(b"").alias("block"))
    dealt = blocks.select("part", "block").unionByName(every).repartition(parts, "part")
    return keep(dealt.mapInPandas(run, "part int, block binary, seen array<long>"), "lm-level")


def _totals(out: DataFrame) -> np.ndarray:
    """The sums of the counts of counts; one row comes to the driver."""
    sums = out.where("seen IS NOT NULL").agg(*[F.sum(F.col("seen")[k]).alias(f"n{k}") for k in range(8)])
    return np.array([n or 0 for n in sums.head()], np.int64)


def _discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; where those are too few, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(found))


def train(docs: DataFrame, each: int = 1_500_000) -> Model:
    """A bigram model of the rows' texts; ``each`` is about the number of entries a file holds."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("text")).alias("n")).head().n or 0
    parts = max(parts_for(size // 8, each), 1)
    folder = f"{_uri(spark)}/lm-{uuid.uuid4().hex}"

    def count(frames):
        import pandas as pd

        def handed_on(gathered):
            entries = _add_up(np.concatenate(gathered))
            rows = [(p, _packed(x)) for p, x in _dealt(entries, "context", parts)]
            return pd.DataFrame(rows, columns=["part", "block"])

        gathered, held = [], 0
        for frame in batches(frames, "text"):
            stream, first, _ = token_stream(frame["text"].tolist())
            entries = np.empty(len(stream), _ENTRY)
            entries["context"], entries["word"], entries["count"] = contexts(stream, first, 2)[1], stream, 1
            gathered.append(entries)
            held += len(entries)
            if held >= _GATHER:
                yield handed_on(gathered)
                gathered, held = [], 0
        if gathered:
            yield handed_on(gathered)

    blocks = docs.select("doc_id", "text").mapInPandas(count, "part int, block binary")
    high = _reduce(blocks, f"{folder}/high", parts, _store_high)
    seen_high = _totals(high)
    seen = _totals(_reduce(high.where("part IS NOT NULL"), f"{folder}/low", parts, _store_low))
    return Model(
        Level(f"{folder}/low", parts, _discounts(seen)),
        Level(f"{folder}/high", parts, _discounts(seen_high)),
        int(seen[7]), int(seen[6]),
        (float(seen[5]), float(seen[0]), float(seen[1]), float(seen[4])),
    )


def _find(level: Level, kind: str, part: np.ndarray, keys: np.ndarray, names) -> dict[str, np.ndarray]:
    """Fields of the row of each key, 0 where there is none; sorted keys touch each page once."""
    out = {n: np.zeros(len(keys)) for n in names}
    by = np.lexsort((keys, part))
    edges = np.searchsorted(part[by], np.arange(level.parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        own = by[edges[p] : edges[p + 1]]
        rows = _opened(level.folder, kind, int(p))
        if not len(rows):
            continue
        column = rows[rows.dtype.names[0]]
        at = np.searchsorted(column, keys[own])
        at[at == len(column)] = 0
        hit = column[at] == keys[own]
        for n in names:
            out[n][own[hit]] = 1 if kind == "once" else rows[n][at[hit]]
    return out


def token_scores(model: Model, stream: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of each token's probability, count of each token's word in training)."""
    before = contexts(stream, first, 2)[1]
    words, w_at = np.unique(stream, return_inverse=True)
    own = _find(model.low, "words", _parts_of(words, model.low.parts), words, ["contexts", "count"])
    below = dict(zip(("total", "n1", "n2", "n3"), model.below))
    p1 = _interpolated(own["contexts"], below, model.low.discounts, 1.0 / (model.words + 1))
    heads, h_at = np.unique(before, return_inverse=True)
    head_part = _parts_of(heads, model.high.parts)
    ctx = _find(model.high, "contexts", head_part, heads, ["total", "n1", "n2", "n3"])
    grams, one, g_at = np.unique(gram(before, stream), return_index=True, return_inverse=True)
    part = head_part[h_at[one]]
    count = sum(_find(model.high, k, part, grams, ["count"])["count"] for k in ("grams", "once"))[g_at]
    p2 = _interpolated(count, {n: v[h_at] for n, v in ctx.items()}, model.high.discounts, p1[w_at])
    return np.log10(p2), own["count"][w_at]


def _interpolated(count, context, discounts, lower):
    """Discounted share of the counts, and what the discounts leave times the lower order."""
    d = np.array([0.0, *discounts])[np.minimum(count, 3).astype(np.int64)]
    total = np.asarray(context["total"], float)
    left = discounts[0] * context["n1"] + discounts[1] * context["n2"] + discounts[2] * context["n3"]
    safe = np.where(total > 0, total, 1.0)
    return np.where(total > 0, np.maximum(count - d, 0) / safe + left / safe * lower, lower)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: its tokens, those known from training, and the base and the model's log10 probability."""
    def run(frames):
        import pandas as pd

        for frame in batches(frames, "text"):
            stream, first, n = token_stream(frame["text"].tolist())
            logs, counts = token_scores(model, stream, first)
            base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            yield pd.DataFrame(
                {
                    "doc_id": exact_ids(frame["doc_id"]),
                    "held_out": is_held_out(frame["doc_id"].tolist()),
                    "n_tokens": n,
                    "n_known": np.add.reduceat((counts > 0).astype(np.int64), first),
                    "train_tokens": np.full(len(n), model.tokens),
                    "base_score": np.add.reduceat(base, first),
                    "score": np.add.reduceat(logs, first),
                }
            )

    shape = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double"
    )
    return as_text(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, shape)


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, then score all."""
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    return score(docs, train(docs.where(chosen)))

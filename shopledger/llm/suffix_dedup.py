"""Removal of byte stretches that occur earlier, by sampled, named and merged suffixes.

The steps are those of difference-cover suffix sorting, kept to the 100 bytes that matter:

1. Sample. Of every 100-byte window one place is sampled, the one with the least hash of 32
   bytes. The choice hangs on the window's bytes alone, so equal windows are sampled at equal
   places, which is what a difference cover is for; a cover by remainders of the place would
   sample two of three bytes, this one about three of a hundred.
2. Name. Samples are sorted by their key and then by all the bytes they stand for; adjacent
   ones with equal bytes get one name. A name that is not the first of its kind marks a
   stretch that occurs earlier; a key with a single name needs no more work.
3. Merge. For keys with several names, the first bearer of each name sends its bytes, whose
   windows are sorted by content and place; adjacent equal ones are compared.

Windows never cross texts, and are judged on the input. Order is by ``doc_id``, then place.
Sorting all suffixes instead would move some 20 bytes for each byte of text.

Bytes are compared by 64-bit hashes of random polynomials. Keys of passages that very many
documents share are spread by row over many tasks, where all but one row a name is settled.
A key with very many names is taken apart into its windows, which Spark groups, so that no
task holds a whole key.

Defined cases: a null text is empty, and texts under 100 bytes keep every byte; rows that
repeat a ``doc_id`` are ordered by a number given once; null ids come first; an empty table
gives no rows; columns of the input are kept by ``deduplicate``, which also drops what is left
of a character cut in two.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import SPAN, anchors
from .tables import keep, numbered, whole_rows, width
from .textblock import MOST_CHARS, TextBlock, U64, batches, mix, slices

#: Bits of the table of open samples, and of the blocks that tasks put together.
BITS_LOG2, BLOCK_LOG2 = 26, 18
#: Names of one key that one task compares.
MOST_NAMES = 50_000
_SAMPLES = "key long, name long, _row long, start int, places int, salt int"
#: One document in so many is looked at for frequent keys, of which so many at most are spread over so many tasks each.
LOOKED_AT, MOST_HOT, SALTS, SEEN = 64, 2_000, 64, 32


def _bit(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (mix(row.view(np.uint64) * U64(0x9E3779B97F4A7C15) + start.astype(np.uint64))) & U64((1 << BITS_LOG2) - 1)


def _samples(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """The samples; those of the keys in ``hot`` carry a salt of 1 or more, taken from their row."""

    def run(frames):
        import pandas as pd

        for frame in batches(frames, "text", MOST_CHARS):
            text, start, places, key, name, _, _ = anchors(frame["text"].tolist())
            key, rows = key.view(np.int64), frame["_row"].to_numpy(np.int64)[text]
            salt = 1 + (_bit(rows, np.zeros(len(rows), np.int64)) % U64(SALTS)).astype(np.int32)
            yield pd.DataFrame(
                {
                    "key": key, "name": name.view(np.int64), "_row": rows,
                    "start": start.astype(np.int32), "places": places.astype(np.int32),
                    "salt": np.where(np.isin(key, hot), salt, 0).astype(np.int32),
                }
            )

    return docs.select("_row", "text").mapInPandas(run, _SAMPLES)


def _frequent(docs: DataFrame) -> np.ndarray:
    """Keys that many documents are likely to have, at most ``MOST_HOT``.

    They only decide which rows are spread: a key that is missed costs time, not results.
    """
    some = docs.where(F.pmod(F.xxhash64("_row"), F.lit(LOOKED_AT)) == 0)
    counts = _samples(some, np.zeros(0, np.int64)).groupBy("key").count().where(F.col("count") >= SEEN)
    top = counts.orderBy(F.desc("count"), "key").limit(MOST_HOT).select("key").toPandas()
    return top["key"].to_numpy(np.int64)


def _named(samples: DataFrame) -> DataFrame:
    """Samples that are not the first with their bytes (``again``), and first ones whose key has other bytes too.

    A frequent key is compared inside each of its salts first. What is first there, one row
    for a name and salt, is compared again by key and name.
    """
    part = Window.partitionBy("key", "salt")
    again = F.coalesce(F.lag("name").over(part.orderBy("name", "_row", "start")) == F.col("name"), F.lit(False))
    several = F.min("name").over(part) != F.max("name").over(part)
    rows = samples.withColumns({"again": again, "several": several}).where("again OR several OR salt > 0")
    return rows.select("key", "name", "_row", "start", "places", "again", "salt")


def _settled(named: DataFrame) -> DataFrame:
    """The rows of ``_named`` with frequent keys compared across their salts."""
    columns = ["key", "_row", "start", "places", "again"]
    firsts = named.where("salt > 0 AND NOT again")
    same = Window.partitionBy("key", "name").orderBy("_row", "start")
    firsts = firsts.withColumn("again", F.row_number().over(same) > 1)
    names = firsts.groupBy("key").agg((F.min("name") != F.max("name")).alias("several"))  # MOST_HOT rows at most
    firsts = firsts.join(F.broadcast(names), "key").where("again OR several")
    return named.where("salt = 0 OR again").select(*columns).union(firsts.select(*columns))


def _open_bits(opened: DataFrame) -> np.ndarray:
    """A table of fixed size with a bit for each sample that must send its bytes.

    Tasks put together a block of it each; the driver gets the blocks packed.
    """
    block = min(BITS_LOG2, BLOCK_LOG2)

    def place(frames):
        import pandas as pd

        for frame in frames:
            bit = _bit(frame["_row"].to_numpy(np.int64), frame["start"].to_numpy(np.int64)).view(np.int64)
            yield pd.DataFrame({"block": (bit >> block).astype(np.int32), "bit": (bit & ((1 << block) - 1)).astype(np.int32)})

    def fill(frames):
        import pandas as pd
        import zstandard

        found: dict[int, np.ndarray] = {}
        for frame in frames:
            blocks, bits = frame["block"].to_numpy(), frame["bit"].to_numpy()
            for k in np.unique(blocks).tolist():
                found.setdefault(k, np.zeros(1 << block, bool))[bits[blocks == k]] = True
        packer = zstandard.ZstdCompressor(level=1)
        rows = [(k, packer.compress(np.packbits(x, bitorder="little").tobytes())) for k, x in found.items()]
        yield pd.DataFrame(rows, columns=["block", "bits"])

    import zstandard

    placed = opened.select("_row", "start").mapInPandas(place, "block int, bit int")
    packed = placed.repartition(width(opened), "block").mapInPandas(fill, "block int, bits binary")
    out, size = np.zeros(1 << (BITS_LOG2 - 6), np.uint64), 1 << (block - 6)
    for r in packed.collect():  # a row a block, 2**(BITS_LOG2 - BLOCK_LOG2) of them
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.bits), "<u8")
    return out


def _sent(docs: DataFrame, bits) -> DataFrame:
    """(key, _row, start, places, bytes) of the samples whose bit is set."""

    def run(frames):
        import pandas as pd

        for frame in batches(frames, "text", MOST_CHARS):
            text, start, places, key, _, _, block = anchors(frame["text"].tolist())
            rows = frame["_row"].to_numpy(np.int64)[text]
            bit = _bit(rows, start)
            hit = np.flatnonzero((bits.value[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1))
            data, base = block.data.tobytes(), block.offsets[text[hit]] + start[hit]
            yield pd.DataFrame(
                {
                    "key": key[hit].view(np.int64), "_row": rows[hit],
                    "start": start[hit].astype(np.int32), "places": places[hit].astype(np.int32),
                    "bytes": [data[a : a + n] for a, n in zip(base.tolist(), (places[hit] + SPAN - 1).tolist())],
                }
            )

    return docs.select("_row", "text").mapInPandas(run, "key long, _row long, start int, places int, bytes binary")


def _windows(frame):
    """(row of the frame, place in its text, hash) of every window of the bytes sent."""
    raw = frame["bytes"].tolist()
    block = TextBlock([])
    block.raw = raw
    block.offsets = np.r_[0, np.cumsum([len(b) for b in raw])].astype(np.int64)
    block.data = np.frombuffer(b"".join(raw), np.uint8)
    places = frame["places"].to_numpy(np.int64)
    owner = np.repeat(np.arange(len(raw)), places)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places, places)
    at = block.offsets[owner] + shift
    hashes = block.bytes_prefix().windows(SPAN)[at]
    return owner, frame["start"].to_numpy(np.int64)[owner] + shift, hashes


def _stretches(rows: np.ndarray, starts: np.ndarray):
    """(row, start, end) of the union of the windows at these places, by row."""
    import pandas as pd

    by = np.lexsort((starts, rows))
    rows, starts = rows[by], starts[by]
    if not len(rows):
        return pd.DataFrame({"_row": rows, "start": starts.astype(np.int32), "end": starts.astype(np.int32)})
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + SPAN)])
    last = np.r_[new[1:], len(rows)] - 1
    return pd.DataFrame({"_row": rows[new], "start": starts[new].astype(np.int32), "end": (starts[last] + SPAN).astype(np.int32)})


_STRETCH = "_row long, start int, end int"


def _merged(sent: DataFrame, parts: int) -> DataFrame:
    """Stretches of the sent windows that occur earlier. Windows that are equal have the same key."""

    def run(frames):
        import pandas as pd

        def told(frame):
            owner, place, hashes = _windows(frame)
            row = frame["_row"].to_numpy(np.int64)[owner]
            by = np.lexsort((place, row, hashes))
            again = np.zeros(len(by), bool)
            again[1:] = hashes[by][1:] == hashes[by][:-1]
            return _stretches(row[by][again], place[by][again])

        held, count = [], 0
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            count += len(frame)
            if count > MOST_NAMES:  # what holds no more of the last key is done
                frame = pd.concat(held, ignore_index=True)
                last = frame["key"].to_numpy() == frame["key"].iloc[-1]
                if not last.all():
                    yield told(frame[~last].reset_index(drop=True))
                held = [frame[last]]
                count = int(last.sum())
        if held:
            yield told(pd.concat(held, ignore_index=True))

    return sent.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(run, _STRETCH)


def _taken_apart(sent: DataFrame) -> DataFrame:
    """The same for keys with very many names: every window is a row, and Spark finds the first of each."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            if len(frame):
                owner, place, hashes = _windows(frame)
                rows = frame["_row"].to_numpy(np.int64)[owner]
                yield pd.DataFrame({"hash": hashes.view(np.int64), "_row": rows, "place": place.astype(np.int32)})

    rows = sent.select("_row", "start", "places", "bytes").mapInPandas(run, "hash long, _row long, place int")
    rows = keep(rows, "windows")
    first = rows.groupBy("hash").agg(F.min(F.struct("_row", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.join(first, "hash").where("NOT (_row = first._row AND place = first.place)")
    return again.select("_row", F.col("place").alias("start"), (F.col("place") + SPAN).alias("end"))


def repeated(docs: DataFrame) -> DataFrame:
    """(_row, start, end) of the byte stretches that occur earlier; they may overlap."""
    hot = _frequent(docs)
    named = keep(_named(_samples(docs, hot)), "named")
    if len(hot):
        named = keep(_settled(named), "settled")
    opened = named.where("NOT again")
    bits = docs.sparkSession.sparkContext.broadcast(_open_bits(opened))
    sent = _sent(docs, bits)
    crowded = keep(opened.groupBy("key").count().where(F.col("count") > MOST_NAMES).select("key"), "crowded")
    again = named.where("again").select("_row", "start", (F.col("start") + F.col("places") + (SPAN - 1)).alias("end"))
    if crowded.limit(1).count():
        sent = keep(sent, "sent")
        again = again.union(_taken_apart(sent.join(crowded, "key", "left_semi")))
        sent = sent.join(crowded, "key", "left_anti")
    return again.union(_merged(sent, width(docs)))


def _with_stretches(docs: DataFrame) -> DataFrame:
    """The rows with ``_cut``: their stretches in order, null if there are none."""
    cut = repeated(docs.select("_row", "text")).groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cut")
    )
    cut = cut.select("_row", F.transform("_cut", lambda c: c["start"]).alias("_from"), F.transform("_cut", lambda c: c["end"]).alias("_to"))
    return docs.join(cut, "_row", "left")


def _runs(starts, ends) -> list[tuple[int, int]]:
    """Maximal stretches of sorted, overlapping ones."""
    if starts is None or not len(starts):
        return []
    starts, ends = np.asarray(starts, np.int64), np.maximum.accumulate(np.asarray(ends, np.int64))
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return list(zip(starts[new].tolist(), ends[np.r_[new[1:], len(ends)] - 1].tolist()))


def _kept(raw: bytes, runs) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the digest of the bytes left."""

    def run(batches_):
        import pyarrow as pa

        for batch in slices(batches_, "text"):
            rows = []
            for text, starts, ends in zip(*(batch.column(n).to_pylist() for n in ("text", "_from", "_to"))):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = _runs(starts, ends)
                gone = sum(b - a for a, b in runs)
                rows.append((len(raw), gone, len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()))
            told = [pa.array(x) for x in zip(*rows)] or [pa.array([], t) for t in (*[pa.int64()] * 3, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *told], names)

    rows = _with_stretches(numbered(docs).select("_row", "doc_id", "text"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_from", "_to")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@whole_rows
def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows without the bytes that occur earlier, in the columns they came with."""

    def run(batches_):
        import pyarrow as pa

        for batch in slices(batches_, "text"):
            texts = batch.column("text").to_pylist()
            froms, tos = batch.column("_from").to_pylist(), batch.column("_to").to_pylist()
            for k, (text, starts, ends) in enumerate(zip(texts, froms, tos)):
                if starts:
                    texts[k] = _kept(text.encode("utf-8", "surrogatepass"), _runs(starts, ends)).decode("utf-8", "ignore")
            at = names.index("text")
            columns = [batch.column(n) for n in names]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    rows = _with_stretches(numbered(docs)).select(*names, "_from", "_to")
    return rows.mapInArrow(run, docs.schema)

"""Packing documents into sequences by best fit decreasing.

Overlong documents are first cut into full windows, which are sequences of their own.
The remainders are dealt evenly over shards of bounded size; in each shard they are
placed from the longest down into the open window with the least room that still holds
them, found in a segment tree over remaining capacity.

Defined cases: a null text is an empty one and holds the end id alone; repeated rows
are packed like different ones; an empty table gives no rows; extra columns are ignored.
A hot ``doc_id`` does no harm, since rows are dealt without regard to it.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .tables import as_text, exact_ids, keep, parts_for
from .textblock import slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class Room:
    """Open windows by remaining capacity; a segment tree tells which capacities occur."""

    def __init__(self, most: int):
        self._size = 1 << most.bit_length()
        self._any = [False] * (2 * self._size)
        self._open: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, window: int) -> None:
        if not self._open[room]:
            k = room + self._size
            while k and not self._any[k]:
                self._any[k] = True
                k >>= 1
        self._open[room].append(window)

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window with at least ``need`` room, removed: (room, window)."""
        some, k = self._any, need + self._size
        if not some[k]:
            while k > 1 and (k & 1 or not some[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self._size:
                k = 2 * k if some[2 * k] else 2 * k + 1
        room = k - self._size
        window = self._open[room].pop()
        if not self._open[room]:
            some[k] = False
            while k > 1 and not (some[k] or some[k ^ 1]):
                k >>= 1
                some[k] = False
        return room, window


def best_fit(lengths: list[int], most: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length; lengths come from the longest down."""
    room, windows, offsets, opened = Room(most), [], [], 0
    for n in lengths:
        found = room.take(n)
        if found is None:
            found = (most, opened)
            opened += 1
        left, window = found
        windows.append(window)
        offsets.append(most - left)
        if left > n:
            room.add(left - n, window)
    return windows, offsets


def cut(docs: DataFrame, path: str, most: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces of every document's ids and end id: full windows and one remainder."""

    def run(parts):
        import pyarrow as pa

        use = encoder(path)
        for part in slices(parts, "text"):
            rows = []
            for k, ids in enumerate(use.texts(part.column("text").to_pylist())):
                raw = memoryview(ids.tobytes() + np.array([end_id], "<u4").tobytes())
                total = len(raw) // 4
                for a in range(0, total, most):
                    b = min(a + most, total)
                    rows.append((k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), total))
            owner, *told = (pa.array(x, pa.int64()) for x in zip(*rows))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(owner), *told], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, most: int = 2048, end_id: int = 1, shard: int = 40_000) -> DataFrame:
    """A row a piece with its place: ``sequence_id`` (shard above, window below) and ``offset``.

    ``shard`` is the number of pieces packed in one task; the shards grow in number with
    the input, not in size.
    """
    pieces = keep(cut(docs, path, most, end_id), "pieces")

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        parts = list(frames)
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        rows["doc_id"] = exact_ids(rows["doc_id"])
        rows = rows.sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True]
        )
        windows, offsets = best_fit(rows["length"].tolist(), most)
        rows["sequence_id"] = np.array(windows, np.int64) + (TaskContext.get().partitionId() << 32)
        rows["offset"] = np.array(offsets, np.int64)
        yield rows

    dealt = as_text(pieces, "doc_id").repartition(parts_for(pieces.count(), shard))
    return dealt.mapInPandas(run, PACKED)

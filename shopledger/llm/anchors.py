"""Content-defined sample places of byte texts: equal stretches hold equal samples."""

from __future__ import annotations

import numpy as np

from .textblock import TextBlock

#: A sample is the least hash of ``KEY`` bytes among ``REACH`` places in a row, so every
#: stretch of ``SPAN`` bytes holds one, at the same place as in every equal stretch.
SPAN, KEY = 100, 32
REACH = SPAN - KEY + 1


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of ``values[i:i+width]``, the first of equal ones, by doubling."""
    at, low, have = np.arange(len(values), dtype=np.int32), values, 1
    while have < width:
        step = min(have, width - have)
        n = len(low) - step
        later = low[step:] < low[:n]
        at = np.where(later, at[step:], at[:n])
        low = np.minimum(low[:n], low[step:])
        have += step
    return at


def anchors(texts):
    """Runs of places whose SPAN bytes share a sample: (text, start in it, places, sample hash, hash of all their bytes), and the block's hashes."""
    block = TextBlock(texts)
    sums = block.bytes_prefix()
    none = np.zeros(0, np.int64)
    n = len(block.data) - SPAN + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), sums, block
    keys = sums.windows(KEY)
    at = _least(keys, REACH)[:n]
    owner = np.repeat(np.arange(len(block.raw)), np.diff(block.offsets))[:n]
    whole = np.arange(n) + SPAN <= block.offsets[1:][owner]
    place = np.flatnonzero(whole)
    if not len(place):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), sums, block
    at, owner = at[place], owner[place]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    count = np.diff(np.r_[new, len(place)])
    start = place[new]
    text = owner[new]
    return text, start - block.offsets[text], count, keys[at[new]], sums.stretch(start, start + count - 1 + SPAN), sums, block

"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the last 48 bytes says so, at white
space, so that a passage shared by many documents yields the same chunks in each. A
worker encodes a chunk once and words that a new chunk shares with earlier ones once,
in whatever case they are written; both memories are bounded and outlive a task. At every
join of two chunks the words around it are encoded again together, all joins of a batch
in one go; where that doesn't agree, in growing stretches, until the ids agree exactly
with those of the chunks. A join that never agrees makes the two chunks one.

Nothing is shuffled: moving every chunk to the one task that encodes it, and its ids
back, would move more bytes than the text itself has.

Defined cases: a null text is an empty one and has no ids; repeated rows are encoded
like any other; an empty table gives no rows; extra columns are ignored; a text without
white space is one chunk, however long.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import cache
from itertools import pairwise
from sys import getsizeof

import numpy as np
from pyspark.sql import DataFrame

from .tables import as_text, exact_ids
from .textblock import MOST_CHARS, TextBlock, U64, _SPACE, batches

ROLL = 48
#: One white-space position in 128 ends a chunk.
MASK = U64(127)
#: Bytes that a worker's memories of words, odd words, chunks and joins may take. Two workers share an executor
#: with a heap that earlier stages have filled.
WORDS_MOST, ODD_MOST, CHUNKS_MOST, JOINS_MOST = 72 << 20, 12 << 20, 16 << 20, 8 << 20
#: Bytes that the place of an entry takes in a map, about.
PLACE = 60
#: Characters the short cut may hold: printable ASCII and Latin-1 letters. They are stable
#: under canonical composition and have one-to-one lower case.
#: White space between words goes with them.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
#: A word with any other character, found from its start, so that long words are read once.
_ODD = re.compile(r"(?<![^\t-\r ])([!-~À-ÖØ-öø-ÿ]*+[^\t-\r -~À-ÖØ-öø-ÿ][^\t-\r ]*)")
#: The vocabulary's own split of a lower-cased plain word.
_SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^0-9a-zß-öø-ÿ]+")
_WORD_END_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary, by code."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _cost(key, value) -> int:
    """Bytes that an entry of a map takes, with its place there."""
    return getsizeof(key) + getsizeof(value) + PLACE


class Memory:
    """A map of so many bytes: when the young half is full, the old half is forgotten; what exceeds a half is not kept."""

    def __init__(self, most: int):
        self._most, self._young, self._old, self._size = most // 2, {}, {}, 0

    def get(self, key):
        found = self._young.get(key)
        if found is None and (found := self._old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        cost = _cost(key, value)
        if cost > self._most:
            return
        self._size += cost
        if self._size > self._most:
            self._old, self._young, self._size = self._young, {}, cost
        self._young[key] = value


class Known(dict):
    """A map that works out what it misses, bounded like ``Memory`` in entries and in bytes; long keys are not kept."""

    def __init__(self, find, most: int, room: int = 16 << 20):
        super().__init__()
        self._find, self._most, self._room, self._old, self._size = find, most // 2, room // 2, {}, 0

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._find(key)
        if len(key) < 200:
            cost = _cost(key, value)
            self._size += cost
            if len(self) >= self._most or self._size > self._room:
                self._old, self._size = dict(self), cost
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of texts under a vocabulary file of the tokenizers library, little-endian uint32."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._model = self.library.model
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        # the short cut holds for vocabularies with just this split and normalisation
        self._plain = (
            steps[0].get("pattern", {}).get("Regex") == _WORD_END_SPLIT
            and [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
            == ["NFC", "Replace", "Lowercase"]
        )
        controls = [re.escape(t["content"]) for t in told.get("added_tokens", [])]
        self._control = re.compile("|".join(controls) or "(?!)")
        self._letters = _byte_letters()
        self._words, self._odd = Known(self._word, 1_200_000, WORDS_MOST), Known(self.whole, 400_000, ODD_MOST)
        self._chunks, self._joins = Memory(CHUNKS_MOST), Memory(JOINS_MOST)
        # without a decoder, the library joins the ids' own strings by spaces
        self._strings = None
        if told.get("decoder") is None:
            top = self.library.get_vocab_size(with_added_tokens=True)
            self._strings = [self.library.id_to_token(i) or "" for i in range(top)]
        self._numbers = [str(i) for i in range(self.library.get_vocab_size(True))]

    def whole(self, text: str) -> bytes:
        """The library's own ids of a text."""
        ids = self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a lower-cased plain word; its bits are such words too."""
        if not word.isalpha():
            bits = _SPLIT.findall(word)
            if len(bits) > 1:
                return b"".join(map(self._words.__getitem__, bits))
        if not word.isascii():
            word = "".join(map(self._letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self._model.tokenize(word)]).tobytes()

    def _plainly(self, text: str) -> bytes:
        """Ids of plain text, one word after the other."""
        return b"".join(map(self._words.__getitem__, text.lower().split()))

    def _of(self, raw: bytes) -> bytes:
        """Ids of the words of a stretch, one after the other."""
        text = raw.decode("utf-8", "surrogatepass")
        if self._plain and ("<" not in text or self._control.search(text) is None):
            if _PLAIN.fullmatch(text):
                return self._plainly(text)
            out = _ODD.split(text)  # plain text and odd words by turns
            out[::2] = map(self._plainly, out[::2])
            out[1::2] = map(self._odd.__getitem__, out[1::2])
            return b"".join(out)
        return b"".join([self._odd[w.decode("utf-8", "surrogatepass")] for w in raw.split()])

    def _chunk(self, raw: bytes) -> bytes:
        ids = self._chunks.get(raw)
        if ids is None:
            ids = self._of(raw)
            self._chunks.put(raw, ids)
        return ids

    def _settle(self, texts: list[list[bytes]]) -> None:
        """Encode the words at all new joins again in one go; if that doesn't agree, each is left to be looked at alone."""
        keys = set()
        for chunks in texts:
            for left, right in pairwise(chunks):
                keys.add(b" ".join(left.rsplit(None, 1)[-1:] + right.split(None, 1)[:1]))
        new = [k for k in keys if self._joins.get(k) is None]
        if self.whole(b" ".join(new).decode("utf-8", "surrogatepass")) == b"".join(map(self._of, new)):
            for key in new:
                self._joins.put(key, True)

    def _agree(self, left: bytes, right: bytes) -> bool:
        """Whether the ids around a join are those of both sides, one after the other."""
        near = 1
        while True:
            tail, head = left.rsplit(None, near)[-near:], right.split(None, near)[:near]
            key = b" ".join(tail + head)
            same = self._joins.get(key)
            if same is None:
                same = self.whole(key.decode("utf-8", "surrogatepass")) == self._of(key)
                self._joins.put(key, same)
            if same:
                return True
            if near >= 64:
                return False
            near *= 4

    def encode(self, chunks: list[bytes]) -> bytes:
        """Ids of the text whose chunks are given."""
        out: list[bytes] = []
        before = b""
        for chunk in chunks:
            if before and chunk.strip() and before.strip() and not self._agree(before, chunk):
                chunk = before + chunk
                out[-1] = self.whole(chunk.decode("utf-8", "surrogatepass"))
            else:
                out.append(self._chunk(chunk))
            before = chunk
        return b"".join(out)

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        block = TextBlock(texts)
        ends = np.flatnonzero(_SPACE[block.data[ROLL - 1 :]]) + ROLL
        rolled = block.bytes_prefix().windows(ROLL, ends - ROLL)
        cuts = ends[(rolled & MASK) == 0]
        owner = np.searchsorted(block.offsets, cuts - 1, "right") - 1
        cuts = cuts[cuts - ROLL >= block.offsets[owner]]
        first = np.searchsorted(cuts, block.offsets[:-1], "right")
        last = np.searchsorted(cuts, block.offsets[1:], "left")
        texts = []
        for k, raw in enumerate(block.raw):
            at = [0, *(cuts[first[k] : last[k]] - block.offsets[k]).tolist(), len(raw)]
            texts.append([raw[a:b] for a, b in zip(at[:-1], at[1:])])
        if self._plain:
            self._settle(texts)
        return [np.frombuffer(self.encode(chunks), "<u4") for chunks in texts]

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives."""
        if self._strings is None:
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        strings = self._strings
        return " ".join([strings[i] for i in ids.tolist()])

    def numbers(self, ids: np.ndarray) -> str:
        numbers = self._numbers
        return " ".join([numbers[i] for i in ids.tolist()])


@cache
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file; workers serve many tasks."""
    return Encoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of each row."""

    def run(frames):
        import pandas as pd

        use = encoder(path)
        for frame in batches(frames, "text", MOST_CHARS):
            ids = use.texts(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": exact_ids(frame["doc_id"]), "ids": [i.astype(np.int64) for i in ids]})

    return as_text(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), as the library decodes; null ids decode to an empty text."""

    def run(frames):
        import pandas as pd

        use = encoder(path)
        for frame in frames:
            texts = [use.decode(np.asarray(i, np.int64)) if i is not None else "" for i in frame["ids"]]
            yield pd.DataFrame({"doc_id": exact_ids(frame["doc_id"]), "text": texts})

    return as_text(encoded.select("doc_id", "ids"), "doc_id").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; count and digests of both results, one row a row."""

    def run(frames):
        import pandas as pd

        use = encoder(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for frame in batches(frames, "text", MOST_CHARS):
            ids = use.texts(frame["text"].tolist())
            yield pd.DataFrame(
                {
                    "doc_id": exact_ids(frame["doc_id"]),
                    "n_tokens": [len(i) for i in ids],
                    "ids_sha256": [sha(use.numbers(i)) for i in ids],
                    "decoded_sha256": [sha(use.decode(i)) for i in ids],
                }
            )

    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return as_text(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, shape)

"""Near-duplicate documents by a prefix-tree join on sets of word n-grams.

1. Each text becomes the set of hashes of its five-word shingles. Texts with equal sets are
   one class from here on, named by a hash of the set.
2. In the global order, rare shingles come first. All shingles are counted, by 40 bits of
   their hash; a table of fixed size keeps how common those are that occur more than once.
   Two sets that are similar enough
   share a shingle among their first ones, so only those meet, and of these only shingles
   that the table has. Sizes split what meets at one shingle into runs. The connected runs
   are candidate groups.
3. The sets of a candidate group are stored one after the other in a trie in global order.
   A new set walks the trie, adding up what it shares with each branch once for all sets
   behind it, and leaves a branch when what remains of the longest set there can't reach the
   threshold, or when all sets there are in its component already.

Groups too large for one task are cut into blocks of sets of like size. Each block is linked
in itself; then one set of its largest component visits other blocks, and then every set
outside the group's largest component does, so that no link between components is lost.
A set visits the blocks that hold a set of fitting size with which it shares a first
shingle. Visitors are not stored, and a block with very many is copied, so that a task holds
one block and the names of as many visitors.

Defined cases: texts with fewer than five words have their whole word sequence as the only
shingle; null and wordless texts have none and are linked with nothing; repeated rows share
a class; ties go to the smaller id; an empty table gives no rows; columns other than those
named are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import as_text, exact_ids, keep, numbered, whole_rows, width
from .textblock import MOST_CHARS, Prefix, TextBlock, U64, batches, mix

WORDS = 5
#: Slots of the table of common shingles (a byte each), and bits of the candidates' table:
#: fixed, so that both may be broadcast whatever the input. A fuller table costs work only.
SLOTS_LOG2, BITS_LOG2, BLOCK = 24, 24, 1 << 16
#: Bits of a shingle's hash that tell it from others when it is counted, shingles that a task
#: counts before it sends them, and parts of the hash range for each partition.
KEY_BITS, HELD, RANGES = 40, 3_000_000, 4
#: Sets in one block of a candidate group.
MOST_SETS = 3000


def shingle_sets(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash) of every distinct shingle, in order of both; size and class of each text's set."""
    hashes, first = TextBlock(texts).words()
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    sums = Prefix(hashes)
    place = np.arange(len(hashes))
    full = place + WORDS <= first[1:][owner] if len(hashes) else np.zeros(0, bool)
    windows = sums.windows(WORDS)
    at = place[full]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    text = np.concatenate([owner[at], few])
    shingle = np.concatenate([windows[at], sums.stretch(first[few], first[few + 1])])
    by = np.lexsort((shingle, text))
    text, shingle = text[by], shingle[by]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    text, shingle = text[new], shingle[new]
    size = np.bincount(text, minlength=len(n))
    total = np.zeros(len(n), np.uint64)
    np.add.at(total, text, mix(shingle ^ U64(0xA5A5A5A5A5A5A5A5)))
    return text, shingle, size, mix(total + size.astype(np.uint64)).view(np.int64)


def _measured(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, n, set): size and name of every row's set."""

    def run(frames):
        import pandas as pd

        for frame in batches(frames, "text", MOST_CHARS):
            _, _, size, name = shingle_sets(frame["text"].tolist())
            doc = exact_ids(frame["doc_id"])
            yield pd.DataFrame({"_row": frame["_row"], "doc_id": doc, "n": size, "set": name})

    rows = as_text(docs.select("_row", "doc_id", "text"), "doc_id")
    return rows.mapInPandas(run, "_row long, doc_id long, n long, set long")


def _pack(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys as differences, and their counts, byte by byte of the numbers; equal bytes cost little."""
    import zstandard

    planes = [np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T, n.astype(np.int64).view(np.uint8).reshape(-1, 8).T]
    return zstandard.ZstdCompressor(level=1).compress(np.vstack(planes).tobytes())


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(16, -1)
    steps, n = (np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in (planes[:8], planes[8:]))
    return np.cumsum(steps), n.view(np.int64)


def _keys(shingle: np.ndarray) -> np.ndarray:
    return shingle >> U64(64 - KEY_BITS)


def _counts(docs: DataFrame) -> DataFrame:
    """(range, packed): shingles and their counts by range of the hash, from every task."""
    ranges = U64(RANGES * width(docs))

    def run(frames):
        import pandas as pd

        def told():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            part = (keys * ranges) >> U64(KEY_BITS)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
            rows = [(int(part[a]), _pack(keys[a:b], n[a:b])) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
            return pd.DataFrame(rows, columns=["range", "packed"])

        held = []
        for frame in batches(frames, "text", MOST_CHARS):
            held.append(_keys(shingle_sets(frame["text"].tolist())[1]))
            if sum(map(len, held)) > HELD:
                yield told()
                held = []
        if held:
            yield told()

    return docs.select("text").mapInPandas(run, "range int, packed binary")


def _slots(shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of each shingle, from different bits of its scrambled key."""
    return _slots_of(_keys(shingle))


def _slots_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask, mixed = U64((1 << SLOTS_LOG2) - 1), mix(keys + U64(1))
    return (mixed & mask).astype(np.int64), ((mixed >> U64(SLOTS_LOG2)) & mask).astype(np.int64)


def _levels(docs: DataFrame) -> np.ndarray:
    """How common the commonest shingle of each slot is, 0 for slots without a shared one.

    A shingle's level is the lesser of its two slots': it is shared by texts only if both are set.
    """

    def fill(frames):
        import pandas as pd
        import zstandard

        table = np.zeros(1 << SLOTS_LOG2, np.uint8)

        def add(packed):
            keys, n = (np.concatenate(x) for x in zip(*map(_unpack, packed)))
            by = np.argsort(keys)
            keys, n = keys[by], n[by]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, n = keys[new], np.add.reduceat(n, new)
            level = np.minimum(np.log2(n[n > 1]) * 4, 250).astype(np.uint8)
            for slot in _slots_of(keys[n > 1]):
                np.maximum.at(table, slot, level)

        now, held = None, []
        for frame in frames:
            for part, packed in zip(frame["range"].tolist(), frame["packed"]):
                if part != now and held:
                    add(held)
                    held = []
                now = part
                held.append(packed)
        if held:
            add(held)
        packer, rows = zstandard.ZstdCompressor(level=1), []
        for k in range(0, len(table), BLOCK):
            if table[k : k + BLOCK].any():
                rows.append((k // BLOCK, packer.compress(table[k : k + BLOCK].tobytes())))
        yield pd.DataFrame(rows, columns=["block", "levels"])

    def merge(frames):
        import pandas as pd
        import zstandard

        found: dict[int, np.ndarray] = {}
        for frame in frames:
            for block, levels in zip(frame["block"], frame["levels"]):
                got = np.frombuffer(zstandard.ZstdDecompressor().decompress(levels), np.uint8)
                found[block] = np.maximum(found[block], got) if block in found else got
        packer = zstandard.ZstdCompressor(level=1)
        rows = [(block, packer.compress(levels.tobytes())) for block, levels in found.items()]
        yield pd.DataFrame(rows, columns=["block", "levels"])

    import zstandard

    shape = "block int, levels binary"
    dealt = _counts(docs).repartition(width(docs), "range").sortWithinPartitions("range")
    blocks = dealt.mapInPandas(fill, shape).repartition(width(docs), "block").mapInPandas(merge, shape)
    out = np.zeros(1 << SLOTS_LOG2, np.uint8)
    for r in blocks.collect():  # a row a block of the table
        found = zstandard.ZstdDecompressor().decompress(r.levels)
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(found, np.uint8)
    return out


def _classes_of(shingle: np.ndarray, levels) -> np.ndarray:
    """The first key of the global order: rare shingles first."""
    one, other = _slots(shingle)
    return np.minimum(levels.value[one], levels.value[other])


def _n_first(size):
    """How many first shingles of a set of this size, one of which any similar set has among its own."""
    return size - (4 * size + 4) // 5 + 1


def _prefixes(docs: DataFrame, levels) -> DataFrame:
    """(shingle, set, n) of the first shingles of each set in global order, but for those that no other text has."""

    def run(frames):
        import pandas as pd

        seen: set[int] = set()
        for frame in batches(frames, "text", MOST_CHARS):
            text, shingle, size, name = shingle_sets(frame["text"].tolist())
            fresh = np.zeros(len(size), bool)
            for k, s in enumerate(name.tolist()):
                if size[k] and s not in seen:
                    seen.add(s)
                    fresh[k] = True
            if len(seen) > 500_000:
                seen.clear()
            own = fresh[text]
            text, shingle = text[own], shingle[own]
            rank = _classes_of(shingle, levels)
            by = np.lexsort((shingle, rank, text))
            text, shingle, rank = text[by], shingle[by], rank[by]
            start = np.searchsorted(text, np.arange(len(size)))
            first = np.arange(len(text)) - start[text] < _n_first(size[text])
            first &= rank > 0
            text = text[first]
            yield pd.DataFrame({"shingle": shingle[first].view(np.int64), "set": name[text], "n": size[text].astype(np.int32)})

    return docs.select("text").mapInPandas(run, "shingle long, set long, n int")


def _candidates(prefixes: DataFrame) -> DataFrame:
    """(node, root): the sets that share a first shingle with a set of similar size, by candidate group."""
    order = Window.partitionBy("shingle").orderBy("n", "set")
    runs = prefixes.withColumn("cut", F.coalesce(5 * F.lag("n").over(order) < 4 * F.col("n"), F.lit(True)).cast("int"))
    runs = runs.withColumn("lead", F.last(F.when(F.col("cut") == 1, F.col("set")), ignorenulls=True).over(order))
    return components(runs.where("set <> lead").select(F.col("set").alias("a"), F.col("lead").alias("b")))


def _bits(names: DataFrame) -> np.ndarray:
    """A table with a bit set for each name; its size is fixed."""
    low = F.col("node").bitwiseAND((1 << BITS_LOG2) - 1)
    words = names.groupBy(F.shiftright(low, 6).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(node & 63 as int))")).alias("bits")
    )
    got = words.toPandas()
    out = np.zeros(1 << (BITS_LOG2 - 6), np.int64)
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _sets(docs: DataFrame, bits, levels) -> DataFrame:
    """(set, n, shingles in global order) of the sets whose bit is set; a set once a task."""

    def run(frames):
        import pandas as pd

        seen: set[int] = set()
        for frame in batches(frames, "text", MOST_CHARS):
            text, shingle, size, name = shingle_sets(frame["text"].tolist())
            low = name.view(np.uint64) & U64((1 << BITS_LOG2) - 1)
            may = (bits.value[(low >> U64(6)).astype(np.int64)] >> (low & U64(63))) & U64(1)
            own = (may[text] == 1) & (size[text] > 0)
            text, shingle = text[own], shingle[own]
            by = np.lexsort((shingle, _classes_of(shingle, levels), text))
            text, shingle = text[by], shingle[by]
            at = np.searchsorted(text, np.arange(len(size) + 1))
            rows = []
            for k in np.flatnonzero((may == 1) & (size > 0)):
                s = int(name[k])
                if s not in seen:
                    seen.add(s)
                    rows.append((s, int(size[k]), shingle[at[k] : at[k + 1]].tobytes()))
            if len(seen) > 500_000:
                seen.clear()
            yield pd.DataFrame(rows, columns=["set", "n", "shingles"])

    return docs.select("text").mapInPandas(run, "set long, n int, shingles binary")


class _Node:
    __slots__ = ("part", "deep", "next", "least", "most", "one", "alike", "ends")

    def __init__(self, part, deep, one, n):
        self.part, self.deep = part, deep  # shingles on the way here from the parent; how many up to here
        self.next: dict[int, _Node] = {}
        self.least = self.most = n
        self.one, self.alike, self.ends = one, True, []


class Trie:
    """Sets in global order; walks share what a set has in common with each branch."""

    def __init__(self):
        self.sizes: list[int] = []
        self._up: list[int] = []
        self._root = _Node((), 0, None, 0)
        self._root.alike = False

    def top(self, k: int) -> int:
        up = self._up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def known(self, n: int, like: int | None = None) -> int:
        """A number for a set of ``n`` shingles, in the component of ``like``; it is not stored."""
        self.sizes.append(n)
        self._up.append(len(self._up) if like is None else self.top(like))
        return len(self.sizes) - 1

    def link(self, me: int, shingles: tuple[int, ...]) -> list[int]:
        """The stored sets of other components that this one is similar to, one a component, which are linked with it."""
        n, out = len(shingles), []
        mine = frozenset(shingles)
        ways = [(c, 0) for c in self._root.next.values()]
        while ways:
            node, shared = ways.pop()
            if 5 * node.most < 4 * n or 4 * node.least > 5 * n:
                continue
            if node.alike and self.top(node.one) == self.top(me):
                continue
            shared += len(mine.intersection(node.part))
            # of the longest set behind, all that remains may be shared
            if 5 * node.most < 4 * n + 9 * (node.deep - shared):
                continue
            for k in node.ends:
                if 9 * shared >= 4 * (n + self.sizes[k]) and self.top(k) != self.top(me):
                    self._up[self.top(k)] = self.top(me)
                    out.append(k)
            ways += [(c, shared) for c in node.next.values()]
        return out

    def add(self, shingles: tuple[int, ...]) -> int:
        """Link a set with those of other components it is similar to, and store it."""
        me = self.known(len(shingles))
        self.link(me, shingles)
        self.store(me, shingles)
        return me

    def store(self, me: int, shingles: tuple[int, ...]) -> None:
        node, at, n = self._root, 0, len(shingles)
        while at < n:
            child = node.next.get(shingles[at])
            if child is None:
                child = _Node(shingles[at:], n, me, n)
                node.next[shingles[at]] = child
                node, at = child, n
                break
            part, same = child.part, 1
            while same < len(part) and at + same < n and part[same] == shingles[at + same]:
                same += 1
            if same < len(part):  # the branch forks here
                fork = _Node(part[:same], child.deep - len(part) + same, child.one, child.most)
                fork.least, fork.alike = child.least, child.alike
                fork.next[part[same]] = child
                child.part = part[same:]
                node.next[shingles[at]] = fork
                child = fork
            child.least, child.most = min(child.least, n), max(child.most, n)
            child.alike = child.alike and self.top(child.one) == self.top(me)
            node, at = child, at + same
        node.ends.append(me)


def _linked(blocks: DataFrame) -> DataFrame:
    """(a, b): each set and one of its component, from a trie for each (group, block)."""

    def run(frames):
        import pandas as pd

        key, trie, names, out = None, Trie(), {}, []

        def told():
            tops = {k: s for s, k in names.items()}
            return [(s, tops[trie.top(k)]) for s, k in names.items() if trie.top(k) != k]

        for frame in frames:
            for group, block, s, raw in zip(frame["root"], frame["block"], frame["set"], frame["shingles"]):
                if (group, block) != key:
                    out += told()
                    key, trie, names = (group, block), Trie(), {}
                if s not in names:
                    names[s] = trie.add(tuple(np.frombuffer(raw, np.uint64).tolist()))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out + told(), columns=["a", "b"])

    dealt = blocks.select("root", "block", "set", "shingles").repartition(width(blocks), "root", "block")
    return dealt.sortWithinPartitions("root", "block", F.length("shingles"), "set").mapInPandas(run, "a long, b long")


def _crossed(hosts: DataFrame, visits: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): visitors and a set of each other component of the block they visit that they are similar to.

    ``visits`` (root, block, set, mine) are dealt over so many copies of a block that each meets
    about as many as it holds.
    """

    def run(frames):
        import pandas as pd

        key, trie, names, tops, out = None, Trie(), [], {}, []
        for frame in frames:
            columns = ("root", "block", "copy", "guest", "set", "mine", "shingles")
            for *place, guest, s, mine, raw in zip(*(frame[c] for c in columns)):
                if place != key:
                    key, trie, names, tops = place, Trie(), [], {}
                shingles = tuple(np.frombuffer(raw, np.uint64).tolist())
                me = trie.known(len(shingles), tops.get(mine))
                tops.setdefault(mine, me)
                names.append(s)
                if guest:
                    out += [(s, names[k]) for k in trie.link(me, shingles)]
                else:
                    trie.store(me, shingles)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"])

    shape = ["root", "block", "copy", "guest", "set", "mine", "shingles"]
    loads = visits.groupBy("root", "block").agg(F.ceil(F.count("*") / MOST_SETS).alias("copies"))
    guests = visits.join(loads, ["root", "block"]).join(sets.select("set", "shingles"), "set")
    guests = guests.withColumns({"copy": F.pmod(F.xxhash64("set"), "copies"), "guest": F.lit(True)})
    hosts = hosts.join(loads, ["root", "block"]).join(sets.select("set", "shingles"), "set")
    hosts = hosts.withColumns({"copy": F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)), "guest": F.lit(False)})
    dealt = hosts.select(*shape).union(guests.select(*shape)).repartition(width(sets), "root", "block", "copy")
    dealt = dealt.sortWithinPartitions("root", "block", "copy", "guest", F.length("shingles"), "set")
    return dealt.mapInPandas(run, "a long, b long")


def _firsts(sets: DataFrame, levels) -> DataFrame:
    """(set, shingle): the first shingles of stored sets, but for those that no other text has."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [np.frombuffer(raw, np.uint64)[: _n_first(len(raw) // 8)] for raw in frame["shingles"]]
            if rows:
                shingle, owner = np.concatenate(rows), np.repeat(frame["set"].to_numpy(np.int64), [len(r) for r in rows])
                shared = _classes_of(shingle, levels) > 0
                yield pd.DataFrame({"set": owner[shared], "shingle": shingle[shared].view(np.int64)})

    return sets.select("set", "shingles").mapInPandas(run, "set long, shingle long")


def _placed(sets: DataFrame) -> DataFrame:
    """(set, root, n, block): blocks hold about ``MOST_SETS`` sets, in the order of their sizes."""
    sizes = sets.groupBy("root", "n").agg(F.count("*").alias("m"))
    before = Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    at = F.col("before") + F.pmod(F.xxhash64("set"), "m")
    return sets.select("set", "root", "n").join(sizes, ["root", "n"]).select("set", "root", "n", F.floor(at / MOST_SETS).alias("block"))


def _roots(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """The sets with the root of their component so far."""
    found = components(edges).select(F.col("node").alias("set"), F.col("root").alias("mine"))
    return sets.join(found, "set", "left").withColumn("mine", F.coalesce("mine", "set"))


def _visits(now: DataFrame, firsts: DataFrame, go: DataFrame) -> DataFrame:
    """(root, block, set, mine): the blocks of its group that each set of ``go`` visits.

    ``now`` has ``large``, true in the component whose sets don't visit each other or anyone;
    of two other sets, the one in the later block visits.
    """
    met = firsts.join(now, "set").groupBy("shingle", "root", "block", "large").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    own = firsts.join(go, "set").select("shingle", "root", "set", "mine", "n", F.col("block").alias("home"))
    fits = "block <> home AND (large OR block < home) AND 5 * most >= 4 * n AND 4 * least <= 5 * n"
    return own.join(met, ["shingle", "root"]).where(fits).select("root", "block", "set", "mine").distinct()


def _classes(docs: DataFrame, levels) -> DataFrame:
    """(node, root) of the sets that are linked with another one."""
    spark = docs.sparkSession
    groups = keep(_candidates(_prefixes(docs, levels)), "groups")
    bits = spark.sparkContext.broadcast(_bits(groups))
    place = groups.select(F.col("node").alias("set"), "root")
    sets = keep(_sets(docs, bits, levels).join(place, "set"), "sets")
    crowded = keep(groups.groupBy("root").count().where(F.col("count") > MOST_SETS).select("root"), "crowded")
    if not crowded.limit(1).count():
        return components(keep(_linked(sets.withColumn("block", F.lit(0))), "links"))
    few = sets.join(crowded, "root", "left_anti").withColumn("block", F.lit(0).cast("long"))
    many = keep(sets.join(crowded, "root", "left_semi").dropDuplicates(["set"]), "many")
    placed = keep(_placed(many), "placed")
    within = many.join(placed.select("set", "block"), "set")
    edges = keep(_linked(few.unionByName(within)), "links")
    firsts = keep(_firsts(many, levels), "firsts")
    for every in (False, True):
        now = keep(_roots(placed, edges), "roots")
        if every:  # every set outside the largest component of its group
            sizes = now.groupBy("root", "mine").agg(F.count("*").alias("n"))
            largest = sizes.groupBy("root").agg(F.max_by("mine", F.struct("n", "mine")).alias("largest"))
            now = keep(now.join(largest, "root").withColumn("large", F.col("mine") == F.col("largest")), "outside")
            go = now.where("NOT large")
        else:  # one set of the largest component of each block, if that has several
            sizes = now.groupBy("root", "block", "mine").agg(F.count("*").alias("m"), F.min("set").alias("set")).where("m > 1")
            chosen = sizes.groupBy("root", "block").agg(F.max_by("set", F.struct("m", "set")).alias("set"))
            now = now.withColumn("large", F.lit(True))
            go = now.join(chosen.select("set"), "set", "left_semi")
        visits = keep(_visits(now, firsts, go), "visits")
        edges = edges.union(keep(_crossed(now.select("root", "block", "set", "mine"), visits, many), "links"))
    return components(edges)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: ``_row`` (unique), doc_id, n_shingles, component_id and ``first``, the component's least ``_row``."""
    return _named_rows(numbered(docs))


def _named_rows(docs: DataFrame) -> DataFrame:
    """The same for a numbered table. Numbers may differ between two numberings, so who joins on them gives its own."""
    levels = docs.sparkSession.sparkContext.broadcast(_levels(docs))
    rows = keep(_measured(docs), "shingles")
    classes = _classes(docs, levels).select(F.col("node").alias("set"), "root")
    least = [F.min("_row").alias("_row"), F.min("doc_id").alias("doc_id")]
    some = rows.where("n > 0").groupBy("set").agg(*least)
    some = some.join(classes, "set", "left").withColumn("root", F.coalesce("root", "set"))
    named = some.groupBy("root").agg(F.min("_row").alias("first"), F.min("doc_id").alias("component_id"))
    named = some.select("set", "root").join(named, "root").select("set", "first", "component_id")
    found = rows.where("n > 0").join(named, "set").select("_row", "doc_id", "n", "component_id", "first")
    alone = rows.where("n = 0").select("_row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("_row").alias("first"))
    return found.union(alone).withColumnRenamed("n", "n_shingles")


def similar(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; a component has the name of its smallest doc_id."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


@whole_rows
def one_of_each(docs: DataFrame) -> DataFrame:
    """The first row of every component, whole, in the columns the rows came with."""
    rows = numbered(docs)
    first = _named_rows(rows).where("_row = first").select("_row")
    return rows.join(first, "_row", "left_semi").select(*docs.columns)

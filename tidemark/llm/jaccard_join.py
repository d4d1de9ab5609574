"""Exact n-gram Jaccard join with signature trees.

A document's set holds its distinct k-word shingles (all its words as one shingle if they are
fewer). Documents link when den * |x & y| >= num * |x | y|; the result is the connected component
of each document. Nothing is sampled, capped or approximated: every link between different sets is
found or is implied by links that are.

1. Documents of equal sets form a class; only classes go on, copies join again at the end.
2. Blocks. A shingle is shared if two classes hold it. Since a link needs ceil(num * n / den) common
   shingles, a class with fewer shared ones than that links with nothing. Of the others, the rarest
   shingles up to and including the first one that no link can miss are keys; linked classes have a key
   in common, so classes joined by keys, directly or through others, form a block. Shingles
   travel as packed arrays, by ranges of their hash that hold RANGE_TOKENS each whatever the corpus. A batch of
   texts is dealt to FAN buckets at most: beyond FAN ranges, tasks deal the buckets on to their ranges in a second hop,
   and the ranges' shared shingles to shards of classes likewise, so steps and rows for each batch have a fixed bound.
   Hot shingles, which HOT or more classes hold, come last in the order and are not sent about at all: a class tells how many it has.
3. Signature trees. A block's classes are the leaves of a tree whose nodes hold the OR of the token
   bitmaps beneath, and their size range. A dual traversal descends pairs of nodes and drops
   those whose largest possible overlap (common bits, plus what hash folding may hide) is below what their smallest
   sizes need, and those all of whose leaves are in one component already. Leaf pairs that remain are
   compared exactly.
4. Large blocks, beyond BLOCK classes, are never compared as a whole. First each class goes to the cells of two of its keys,
   those of least hash under two seeds; near copies meet there, and cells of any size are split, since
   this round need not find all. Then only keys whose classes are still in two or more components count: of each, the classes
   outside its largest component meet one another and the rest, part by part. A link that is not implied yet has such a key.
5. Components of the links by star steps, then the smallest doc_id of each.

Defined cases: null and empty texts have an empty set and stand alone; repeated rows are copies and
link; a null doc_id takes part and gets its component's smallest id; an empty table gives an empty result. A text of any
length is one set, packed in pieces. Ties don't show: components don't depend on the order of links, and of rows tied for the
smallest doc_id any one stays, being equal in it. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, let_go, map_texts, table
from tidemark.llm.components import components
from tidemark.llm.tokens import Words, shingle_sets

RANGE_TOKENS = 2_000_000
#: Ranges at least, so that small corpora are many tasks' work too.
LEAST_RANGES = 24
#: Buckets that one batch or range is dealt to at most; with more ranges, a second hop deals the buckets on.
FAN = 4096
#: Shingles that a task of the second hop holds before it sends them on.
HELD = 4_000_000
#: Tasks that ranges are dealt to at most, if the session asks for no more.
MOST_TASKS = 4096
#: A shingle that this many classes hold (counting those of batches in which LOCAL or more do) is hot; more are needed where that would give over HOT_MOST.
HOT = 200_000
HOT_MOST = 1_000_000
LOCAL = 4
#: Classes, and shingles, that meet in one tree; smaller groups are bundled into tasks of BUNDLE classes.
BLOCK = 1024
BLOCK_TOKENS = 1_000_000
BUNDLE = 256
#: The filter of members has 16 bits for each, within these bounds: 32 MB at most.
FILTER_BITS = (1 << 20, 1 << 28)
_U = np.uint64


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    return shingle_sets(Words(texts, lower=True), k)


def _class_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=12).digest()


_CLASS = np.dtype([("a", "<u8"), ("b", "<u4")])


def _ids(classes: np.ndarray, wide: bool) -> np.ndarray:
    """What classes go by while shingles are counted: their first 64 bits if no two classes share them, else (wide) all."""
    return classes if wide else np.ascontiguousarray(classes["a"])


def _kind(wide: bool) -> np.dtype:
    return _CLASS if wide else np.dtype("<u8")


def _places(ids: np.ndarray) -> np.ndarray:
    """What deals each class to its shard."""
    return ((ids if ids.dtype.names is None else ids["a"]) >> _U(1)).astype(np.int64)


def needed(n, num: int, den: int):
    """The least overlap that a set of n has with any set it links with."""
    return -(-num * n // den)


def set_sizes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, key (hash of the text), n (set size), cls (digest of the set) and place (first bits of it) of every row.

    common, in one row of each batch: the shingles that LOCAL or more classes of it hold, and how many do.
    """

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        sets = _sets(texts, k)
        every = np.concatenate(list({_class_of(s): s for s in sets}.values()))
        token, count = np.unique(every, return_counts=True)
        token, count = token[count >= LOCAL], count[count >= LOCAL]
        common = [np.concatenate([token, count.astype(_U)]).tobytes()] + [None] * (len(texts) - 1)
        cls = [_class_of(s) for s in sets]
        place = _places(np.frombuffer(b"".join(cls), _CLASS))
        yield {"doc_id": batch.column(0), "key": batch.column(1), "n": pa.array([len(s) for s in sets], pa.int64()), "cls": pa.array(cls, pa.binary()), "place": pa.array(place), "common": pa.array(common, pa.binary())}

    return map_texts(docs.select("doc_id", F.xxhash64("text").alias("key"), "text"), ["doc_id", "key"], "doc_id long, key long, n long, cls binary, place long, common binary", work)


def hot_shingles(common: DataFrame, total: int) -> np.ndarray:
    """The shingles that very many classes hold, sorted: at most HOT_MOST, since each stands for a millionth of all shingles at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for both in batch.column(0).to_pylist():
                token, count = np.frombuffer(both, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"token": pa.array(token), "c": pa.array(count)})

    counted = common.mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    found = counted.where(F.col("c") >= max(HOT, total // HOT_MOST)).select("token").toArrow()
    return np.sort(np.asarray(found.column(0).to_numpy(), np.int64).view(_U))


def _pack(bucket: np.ndarray, own: np.ndarray, classes: np.ndarray, **tokens: np.ndarray) -> Iterator[dict]:
    """One row for each bucket that occurs: its classes, how many tokens of each (a byte; 255: as large says), and arrays by token.

    bucket, own (place in classes) and tokens go by token.
    """
    order = np.lexsort((own, bucket))
    bucket, own = bucket[order], own[order]
    tokens = {c: v[order] for c, v in tokens.items()}
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
    for lo, hi in pairwise(edge):
        here, count = np.unique(own[lo:hi], return_counts=True)
        yield {
            "bucket": int(bucket[lo]),
            "classes": classes[here].tobytes(),
            "counts": np.minimum(count, 255).astype(np.uint8).tobytes(),
            "large": count[count >= 255].astype(np.uint32).tobytes(),
            **{c: v[lo:hi].tobytes() for c, v in tokens.items()},
        }


_PACKED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("classes", "counts", "large", "tokens", "ranks"))])
_PACKED_SQL = "bucket int, classes binary, counts binary, large binary, tokens binary, ranks binary"


def _joined(rows: list[bytes | None], kind) -> np.ndarray:
    return np.frombuffer(b"".join(r or b"" for r in rows), kind)


def _entries(counts: list[bytes], large: list[bytes]) -> np.ndarray:
    """How many tokens each class of packed rows has."""
    out = _joined(counts, np.uint8).astype(np.int64)
    out[out == 255] = _joined(large, np.uint32)
    return out


def _range_of(tokens: np.ndarray, ranges: int) -> np.ndarray:
    return ((tokens >> _U(32)) % _U(ranges)).astype(np.int64)


def packed_tokens(docs: DataFrame, k: int, ranges: int, hot: np.ndarray, num: int, den: int, wide: bool = True) -> DataFrame:
    """The shingles of all classes, packed by range: their low 32 bits (beyond FAN ranges by range modulo FAN: whole). Hot ones
    stay behind: a class's row in bucket -1-shard has their number in large, and the first of them as far as they can be keys, in
    the order of _keys: by their low 63 bits.
    """
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        own = {}
        for s in _sets(texts, k):
            if len(s):
                own.setdefault(_class_of(s), s)  # copies here count once already
        if not own:
            return
        classes, sets = _ids(np.frombuffer(b"".join(own), _CLASS), wide), list(own.values())
        warm = [s[np.isin(s, sent.value)] for s in sets] if len(sent.value) else []
        cold = [s[~np.isin(s, h)] if len(h) else s for s, h in zip(sets, warm, strict=True)] if warm else sets
        tokens = np.concatenate(cold)
        place = np.repeat(np.arange(len(cold)), [len(s) for s in cold])
        part = _range_of(tokens, ranges)
        rows = list(_pack(part % FAN, place, classes, tokens=tokens) if ranges > FAN else _pack(part, place, classes, tokens=tokens.astype(np.uint32)))
        shards = _places(classes) % ranges
        for i, h in enumerate(warm):
            if len(h):
                n = len(sets[i])
                first = h[np.argsort(h << _U(1), kind="stable")][: n - needed(n, num, den) + 1]
                rows.append({"bucket": int(-1 - shards[i]), "classes": classes[i].tobytes(), "large": np.uint32(len(h)).tobytes(), "tokens": first.tobytes()})
        for lo in range(0, len(rows), 256):
            yield {c: pa.array([r.get(c) for r in rows[lo : lo + 256]], t) for c, t in zip(_PACKED.names, _PACKED.types, strict=True)}

    return map_texts(docs, [], _PACKED_SQL, work)


def dealt_on(rows: DataFrame, tasks: int, split: Callable[[list[dict]], Iterator[dict]]) -> DataFrame:
    """The second hop: rows of each bucket, HELD tokens at a time, through split, which deals them to finer buckets.

    A bucket's rows come in any number of tasks, so none has to hold it. Negative buckets pass as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        total = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    yield pa.RecordBatch.from_pylist([row], schema=_PACKED)
                    continue
                held.setdefault(row["bucket"], []).append(row)
                total += len(row["tokens"]) // 4
                if total >= HELD:
                    for own in held.values():
                        yield pa.RecordBatch.from_pylist(list(split(own)), schema=_PACKED)
                    held, total = {}, 0
        for own in held.values():
            yield pa.RecordBatch.from_pylist(list(split(own)), schema=_PACKED)

    salts = max(1, tasks // FAN)
    return rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("classes"), F.lit(salts))).mapInArrow(run, _PACKED_SQL)


def _to_ranges(rows: list[dict], ranges: int, wide: bool) -> Iterator[dict]:
    counts = _entries([r["counts"] for r in rows], [r["large"] for r in rows])
    tokens = _joined([r["tokens"] for r in rows], _U)
    own = np.repeat(np.arange(len(counts)), counts)
    return _pack(_range_of(tokens, ranges), own, _joined([r["classes"] for r in rows], _kind(wide)), tokens=tokens.astype(np.uint32))


def _to_shards(rows: list[dict], shards: int, wide: bool) -> Iterator[dict]:
    counts, classes = _entries([r["counts"] for r in rows], [r["large"] for r in rows]), _joined([r["classes"] for r in rows], _kind(wide))
    own = np.repeat(np.arange(len(counts)), counts)
    shard = (_places(classes) % shards)[own]
    return _pack(shard, own, classes, tokens=_joined([r["tokens"] for r in rows], np.int64), ranks=_joined([r["ranks"] for r in rows], np.uint8))


def _shared(key: tuple, group: pa.Table, shards: int, fan: int, wide: bool) -> pa.Table:
    """The shared tokens of one range as longs, each with the rank of its class count, by shard of their class (beyond fan shards: modulo fan).

    A rank of eight steps for each doubling is as good as the count: all that matters is one order for all classes.
    """
    r = key[0].as_py()
    if r < 0:  # hot shingles go on as they are, a row for each class
        names = group.column("classes").to_pylist()
        return group.take(pa.array(sorted({name: i for i, name in enumerate(names)}.values())))
    columns = {c: group.column(c).to_pylist() for c in ("classes", "counts", "large", "tokens")}
    classes, counts = _joined(columns["classes"], _kind(wide)), _entries(columns["counts"], columns["large"])
    _, first = np.unique(classes, return_index=True)
    keep = np.zeros(len(classes), bool)
    keep[first] = True
    both = _joined(columns["tokens"], np.uint32).astype(_U)
    del columns
    both <<= _U(32)
    both |= np.repeat(np.arange(len(classes), dtype=np.uint32), counts)
    both = both[np.repeat(keep, counts)]
    both.sort()
    token = (both >> _U(32)).astype(np.uint32)
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    df = np.diff(edge)
    shared = np.repeat(df > 1, df)  # most shingles are held once
    both, df = both[shared], np.repeat(df[df > 1], df[df > 1])
    del token, edge, shared
    token, own = (both >> _U(32)).astype(np.int64) | (r << 32), (both & _U(0xFFFFFFFF)).astype(np.int64)
    shard = (_places(classes) % shards)[own]
    rank = np.minimum(8 * np.log2(df), 255).astype(np.uint8)
    return pa.Table.from_pylist(list(_pack(shard % fan if shards > fan else shard, own, classes, tokens=token, ranks=rank)), schema=_PACKED)


def _keys(group: pa.Table, sizes: pa.Table, num: int, den: int, wide: bool) -> pa.Table:
    """(id, token) of the keys of the classes of one shard: shared shingles by rank and id, then hot ones by id. sizes: cls, id and n of its classes."""
    warm = np.asarray(group.column("bucket").to_numpy(), np.int64) < 0
    hot, group = group.filter(pa.array(warm)), group.filter(pa.array(~warm))
    names = _joined(sizes.column("cls").to_pylist(), _CLASS)
    order = np.argsort(_ids(names, wide))
    n, ids = (np.asarray(sizes.column(c).to_numpy(), np.int64)[order] for c in ("n", "id"))
    every, kind = _ids(names[order], wide), _kind(wide)
    columns = {c: group.column(c).to_pylist() for c in ("classes", "counts", "large", "tokens", "ranks")}
    counts = _entries(columns["counts"], columns["large"])
    own = np.repeat(np.searchsorted(every, _joined(columns["classes"], kind)), counts)
    token, rank = _joined(columns["tokens"], np.int64), _joined(columns["ranks"], np.uint8).astype(np.int64)
    of_hot = np.searchsorted(every, _joined(hot.column("classes").to_pylist(), kind))
    held = np.bincount(of_hot, _joined(hot.column("large").to_pylist(), np.uint32), minlength=len(n)).astype(np.int64)
    listed = [len(x) // 8 for x in hot.column("tokens").to_pylist()]
    cold = np.bincount(own, minlength=len(n))
    own = np.concatenate([own, np.repeat(of_hot, listed)])
    token = np.concatenate([token, (_joined(hot.column("tokens").to_pylist(), _U) | _U(1 << 63)).view(np.int64)])
    rank = np.concatenate([rank, np.full(sum(listed), 256)])
    keys = cold + held - needed(n, num, den) + 1  # the rarest of the shared; classes below 1 have too few
    live = (keys > 0)[own]
    own, token, rank = own[live], token[live], rank[live]
    order = np.lexsort((token, rank, own))
    own, token = own[order], token[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    use = place < keys[own]
    own, token = own[use], token[use]
    return pa.table({"id": pa.array(ids[own]), "token": pa.array(token)})


def _tasks(spark: SparkSession, ranges: int) -> int:
    """One for each range, as far as Spark can bear that many; then each has as many ranges as the others."""
    return min(ranges, max(MOST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def keys_of(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, total: int, hot: np.ndarray, wide: bool = True) -> DataFrame:
    """(id, token) of the keys of all classes that may link; linked classes have a key in common.

    classes: cls, id, place, n. wide: whether two of them may have the same place.
    """
    ranges, fan = max(LEAST_RANGES, -(-total // RANGE_TOKENS)), FAN
    packed = packed_tokens(docs, k, ranges, hot, num, den, wide)
    if ranges > fan:
        packed = dealt_on(packed, -(-total // HELD), lambda rows: _to_ranges(rows, ranges, wide))
    # a range is a task's, not as many as hash to one
    tasks = _tasks(docs.sparkSession, ranges)
    packed = packed.repartitionById(tasks, "bucket")
    shared = packed.groupBy("bucket").applyInArrow(lambda key, group: _shared(key, group, ranges, fan, wide), _PACKED_SQL)
    if ranges > fan:
        shared = dealt_on(shared, -(-total // HELD), lambda rows: _to_shards(rows, ranges, wide))
    shard = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    shared = shared.withColumn("shard", shard).repartitionById(tasks, "shard")
    sizes = classes.select("cls", "id", "n", (F.col("place") % ranges).cast("int").alias("shard")).repartitionById(tasks, "shard")
    both = shared.groupBy("shard").cogroup(sizes.groupBy("shard"))
    return cut(both.applyInArrow(lambda group, sizes: _keys(group, sizes, num, den, wide), "id long, token long"))


def blocks(keys: DataFrame) -> DataFrame:
    """(id, block) of the classes that share keys, directly or through others; blocks of two or more."""
    hubs = keys.groupBy("token").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    return components(keys.join(hubs, "token").select(F.col("id").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("block"))


class Tree:
    """Signature tree over sets: levels of nodes, each with the OR of its members' bitmaps and their size range."""

    LEAF, FAN, MAX_BITS = 16, 8, 1 << 14

    def __init__(self, sets: list[np.ndarray], sides: np.ndarray) -> None:
        n = np.array([len(s) for s in sets])
        every = np.concatenate(sets)
        names, ids, df = np.unique(every, return_inverse=True, return_counts=True)
        common = df > 1
        place = np.cumsum(common) - 1
        own = np.repeat(np.arange(len(sets)), n)[common[ids]]
        ids = place[ids[common[ids]]]
        bits = int(min(max(64, common.sum()), self.MAX_BITS))
        # neighbours in the tree share their least common token, and then are of like size
        least = np.full(len(sets), np.iinfo(np.int64).max)
        np.minimum.at(least, own, ids)
        self.order = np.lexsort((n, least, sides))
        rank = np.empty(len(sets), np.int64)
        rank[self.order] = np.arange(len(sets))
        self.n, self.side = n[self.order], sides[self.order]
        self.exact = common.sum() <= self.MAX_BITS
        self.sets = [sets[i] for i in self.order]
        words = -(-bits // 64)
        maps = np.zeros(len(sets) * words, np.uint64)
        bit = ids % bits
        np.bitwise_or.at(maps, rank[own] * words + bit // 64, _U(1) << (bit % 64).astype(_U))
        self.maps = maps.reshape(len(sets), words)
        # tokens that folding hides behind another one of the same set
        self.hidden = np.bincount(rank[own], minlength=len(sets)) - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        level = (self.maps, self.n, self.n, self.hidden)
        self.levels = []
        width = self.LEAF
        while True:
            at = np.arange(0, len(level[1]), width)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)
            if len(at) == 1:
                break
            width = self.FAN

    def children(self, depth: int, pairs: np.ndarray) -> np.ndarray:
        """The pairs of children of node pairs at a level (depth 0: of leaves, so pairs of sets), each once."""
        width, count = (self.LEAF, len(self.n)) if depth == 0 else (self.FAN, len(self.levels[depth - 1][1]))
        step = np.arange(width)
        a = (pairs[:, 0, None, None] * width + step[:, None]).repeat(width, 2).reshape(-1)
        b = (pairs[:, 1, None, None] * width + step[None, :]).repeat(width, 1).reshape(-1)
        good = (a < count) & (b < count) & ((a < b) | ((a == b) & (depth > 0)))
        return np.stack([a[good], b[good]], 1)


def _overlap(a: np.ndarray, b: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    out = np.empty(len(pairs), np.int64)
    step = max(1, (1 << 21) // max(1, a.shape[1]))
    for lo in range(0, len(pairs), step):
        x = pairs[lo : lo + step]
        out[lo : lo + step] = np.bitwise_count(a[x[:, 0]] & b[x[:, 1]]).sum(1, dtype=np.int64)
    return out


def tree_links(sets: list[np.ndarray], sides: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that span every component of the sets' links; with two sides only links across count.

    known: sets of one number are in one component already and need no link.
    """
    if len(sets) < 2:
        return []
    tree = Tree(sets, sides)
    across = len(np.unique(sides)) > 1
    label = np.arange(len(sets))
    if known is not None:
        _, first, at = np.unique(known[tree.order], return_index=True, return_inverse=True)
        label = first[at]
    links: list[tuple[int, int]] = []

    def may(pairs: np.ndarray, maps: np.ndarray, small: np.ndarray, large: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        a, b = pairs.T
        pairs = pairs[(den * large[a] >= num * small[b]) & (den * large[b] >= num * small[a])]
        a, b = pairs.T
        most = np.minimum(_overlap(maps, maps, pairs) + np.minimum(hidden[a], hidden[b]), np.minimum(large[a], large[b]))
        return pairs[(den + num) * most >= num * (small[a] + small[b])]

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def flat() -> np.ndarray:
        out = label
        while (out != (out := out[out])).any():
            pass
        return out

    def descend(depth: int, pairs: np.ndarray) -> None:
        at = np.arange(0, len(label), tree.LEAF * tree.FAN**depth)
        now = flat()
        least, most = np.minimum.reduceat(now, at), np.maximum.reduceat(now, at)
        # nodes all of whose leaves are in one component have nothing to link
        pairs = pairs[(least[pairs[:, 0]] != most[pairs[:, 1]]) | (most[pairs[:, 0]] != least[pairs[:, 1]])]
        pairs = may(pairs, *tree.levels[depth])
        most = 1 << (14 if depth else 9)
        for lo in range(0, len(pairs), most):
            below = tree.children(depth, pairs[lo : lo + most])
            if depth:
                descend(depth - 1, below)
                continue
            now = flat()
            below = below[now[below[:, 0]] != now[below[:, 1]]]
            if across:
                below = below[tree.side[below[:, 0]] != tree.side[below[:, 1]]]
            for a, b in may(below, tree.maps, tree.n, tree.n, tree.hidden).tolist():
                if (ra := root(a)) != (rb := root(b)):
                    if not tree.exact:
                        same = len(np.intersect1d(tree.sets[a], tree.sets[b], assume_unique=True))
                        if (den + num) * same < num * (len(tree.sets[a]) + len(tree.sets[b])):
                            continue
                    label[max(ra, rb)] = min(ra, rb)
                    links.append((int(tree.order[a]), int(tree.order[b])))

    top = len(tree.levels) - 1
    # leaves against themselves first: what they link need not be compared again
    count = len(tree.levels[0][1])
    descend(0, np.stack([np.arange(count)] * 2, 1))
    descend(top, np.array([[0, 0]]))
    return links


def _cell_links(group: pa.Table, num: int, den: int) -> pa.Table:
    """Links of one task, cell by cell: of the cell's classes that are not in one component (label) already, across its sides if it has two."""
    a, b = [], []
    group = group.sort_by("cell")
    cell, ids, label = (group.column(c).to_pylist() for c in ("cell", "id", "label"))
    side = np.asarray(group.column("side").to_numpy(), np.int64)
    tokens = group.column("tokens").to_pylist()
    edge = [i for i in range(len(cell) + 1) if i in (0, len(cell)) or cell[i] != cell[i - 1]]
    for lo, hi in pairwise(edge):
        names = {x: i for i, x in enumerate(dict.fromkeys(label[lo:hi]))}
        known = np.array([names[x] for x in label[lo:hi]])
        for i, j in tree_links([np.frombuffer(t, _U) for t in tokens[lo:hi]], side[lo:hi], num, den, known):
            a.append(ids[lo + i])
            b.append(ids[lo + j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def cell_links(cells: DataFrame, sets: DataFrame, num: int, den: int, rows: int | None = None) -> DataFrame:
    """(a, b) links inside the cells. cells: id, cell, size (classes in the cell), side, label; a class's label is its component so far. rows: how many they are at most."""
    cells = cut(cells, rows)
    few = F.col("size") < BUNDLE
    bundles = max(1, -(-int(cells.where(few).count()) // BUNDLE))
    task = F.when(few, F.pmod(F.xxhash64("cell"), F.lit(bundles)).cast("string")).otherwise(F.col("cell"))
    rows = cells.withColumn("task", task).join(sets, "id").select("task", "cell", "id", "side", "label", "tokens")
    return rows.groupBy("task").applyInArrow(lambda group: _cell_links(group, num, den), "a long, b long")


def _parts(count: str, tokens: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(tokens) / BLOCK_TOKENS))


def near_cells(keys: DataFrame, large: DataFrame) -> DataFrame:
    """Cells of two keys for each class of large blocks, those of least hash; cells beyond BLOCK are split by a hash of the class."""
    own = keys.join(large.select("id", "n"), "id")
    picks = [F.struct(F.lit(seed).alias("seed"), F.min_by("token", F.xxhash64("token", F.lit(seed))).alias("token")) for seed in (1, 2)]
    own = own.groupBy("id").agg(F.first("n").alias("n"), F.array(*picks).alias("picks")).select("id", "n", F.inline("picks"))
    sizes = own.groupBy("seed", "token").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    own = own.join(sizes.where("c > 1").withColumn("parts", _parts("c", "t")), ["seed", "token"])
    part = F.pmod(F.xxhash64("id", "seed"), "parts")
    return own.select("id", F.concat_ws(":", "seed", "token", part).alias("cell"), F.ceil(F.col("c") / F.col("parts")).alias("size"), F.lit(0).cast("long").alias("side"), F.col("id").alias("label"))


def open_cells(keys: DataFrame, large: DataFrame, links: DataFrame) -> DataFrame:
    """Cells of the keys whose classes are still in two or more components: classes outside a key's largest component meet one another and the rest.

    The parts of the former come first, 0 up to m; cell (i, j) holds parts i < m and j > i, and has two sides but for j = m, where part i meets itself too.
    """
    found = components(links).select(F.col("node").alias("id"), F.col("component").alias("c"))
    labelled = large.select("id", "n").join(found, "id", "left").select("id", "n", F.coalesce("c", "id").alias("label"))
    own = cut(keys.join(labelled, "id"))
    by_label = own.groupBy("token", "label").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    largest = F.max(F.struct("c", "t", "label"))
    still = by_label.groupBy("token").agg(F.count("*").alias("labels"), F.sum("c").alias("all_c"), F.sum("t").alias("all_t"), largest.alias("major")).where("labels > 1")
    still = still.select("token", F.col("major.label").alias("major"), F.col("major.c").alias("c1"), F.col("major.t").alias("t1"), (F.col("all_c") - F.col("major.c")).alias("c0"), (F.col("all_t") - F.col("major.t")).alias("t0"))
    # two parts meet in a cell, so each has half of what a tree takes
    still = still.select("token", "major", "c0", "c1", (2 * _parts("c0", "t0")).alias("m"), (2 * _parts("c1", "t1")).alias("rest"))
    whole = (F.col("c0") + F.col("c1") <= BLOCK // 2)
    still = still.withColumns({"m": F.when(whole, 1).otherwise(F.col("m")), "rest": F.when(whole, 1).otherwise(F.col("rest"))})
    rows = own.join(still, "token").withColumn("is_major", F.col("label") == F.col("major"))
    part = F.when(F.col("is_major"), F.col("m") + F.pmod(F.xxhash64("id"), "rest")).otherwise(F.pmod(F.xxhash64("id"), "m"))
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.expr("sequence(0L, IF(is_major, m, m + rest) - 1)"))).where("other <> part")
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    size = F.ceil(F.col("c0") / F.col("m")) + F.ceil(F.greatest("c0", "c1") / F.least("m", "rest"))
    return rows.select("id", F.concat_ws(":", "token", lo, hi).alias("cell"), size.alias("size"), F.when(hi == F.col("m"), 0).otherwise(F.col("part")).cast("long").alias("side"), "label")


def sets_of(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(id, tokens) of the members (cls, id, rep): each class's set once, the other texts staying where they are."""
    least, most = FILTER_BITS
    bits = min(most, max(least, 1 << (16 * members.count()).bit_length()))
    # a bitmap of the members' ids spares other texts; the join that follows decides
    bit = F.pmod(F.xxhash64("rep"), F.lit(bits))
    words = members.select((bit / 64).cast("int").alias("w"), (bit % 64).cast("int").alias("m")).select("w", F.expr("shiftleft(1L, m)").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[np.asarray(words.column("w").to_numpy(), np.int64)] = words.column("m").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(filled.view(_U))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        bit = np.asarray(batch.column(0).to_numpy(), np.int64)
        use = np.flatnonzero((sent.value[bit // 64] >> (bit % 64).astype(_U)) & _U(1))
        own = {_class_of(s): s.tobytes() for s in _sets([texts[i] for i in use], k)} if len(use) else {}
        yield {"cls": pa.array(own, pa.binary()), "tokens": pa.array(own.values(), pa.binary())}

    keyed = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("bit"), "text")
    found = map_texts(keyed, ["bit"], "cls binary, tokens binary", work)
    own = found.join(members.select("cls", "id"), "cls").groupBy("cls", "id").agg(F.first("tokens").alias("tokens"))
    return cut(own.select("id", "tokens"))  # texts' worth of bytes: not in few files


def class_links(docs: DataFrame, classes: DataFrame, count: int, keys: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links that span the components of the count classes, by id. classes: cls, id, rep, n; keys: id, token."""
    let_go(docs.sparkSession)  # the shuffles of all shingles
    members = cut(blocks(keys).join(classes, "id").select("id", "cls", "block", "rep", "n"), count)
    count = members.count()
    sets = sets_of(docs, members, k)
    let_go(docs.sparkSession)
    sizes = members.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    placed = cut(members.join(sizes.select("block", "c", _parts("c", "t").alias("parts")), "block").select("id", "block", "n", "c", "parts"), count)
    large = placed.where("parts > 1")
    cells = placed.where("parts = 1").select("id", F.col("block").cast("string").alias("cell"), F.col("c").alias("size"), F.lit(0).cast("long").alias("side"), F.col("id").alias("label"))
    if not large.limit(1).count():
        return cell_links(cells, sets, num, den, count)
    links = cut(cell_links(cells.unionByName(near_cells(keys, large)), sets, num, den, 2 * count))
    return links.unionByName(cell_links(open_cells(keys, large, links), sets, num, den))


def numbered(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(classes of rows: cls, id, place, rep and n; whether two of them have one place). A class's id is its place if that is its own."""
    classes = cut(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("place").alias("place")))
    wide = bool(classes.groupBy("place").count().where("count > 1").limit(1).count())
    return (cut(classes.withColumn("id", F.monotonically_increasing_id())) if wide else classes.withColumn("id", F.col("place"))), wide


def components_of(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, key, n, component (a class of it; null for empty sets) and component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    rows = cut(set_sizes(docs, k))
    classes, wide = numbered(rows)
    total, count = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = hot_shingles(rows.where("common IS NOT NULL").select("common"), total)
    links = class_links(docs, classes, count, keys_of(docs, classes, k, num, den, total, hot, wide), k, num, den)
    found = components(links)
    own = classes.join(found, F.col("id") == F.col("node"), "left").select("cls", "rep", F.coalesce("component", "id").alias("component"))
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = own.join(least, "component").select("cls", "component", "component_id")
    return rows.join(ids, "cls", "left").drop("cls", "place", "common")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach, itself included) of every row."""
    out = components_of(docs, k, num, den)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (nulls first), with all columns as they are; rows without words stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # the caller's own names may clash
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    found = cut(components_of(docs, k, num, den).where("n > 0").select("component", F.col("doc_id").alias("id"), "key"))
    first = found.groupBy("component").agg(F.min(F.struct("id", "key")).alias("first"))
    # of rows in found, only a component's first stays; rows repeated in full are told apart below
    gone = found.join(first, "component").where(~F.struct("id", "key").eqNullSafe(F.col("first"))).select("id", "key").distinct()
    same = doc_id.cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("key"))
    kept = docs.toDF(*names).join(gone, same, "left_anti")
    twice = cut(found.groupBy("id", "key").count().where("count > 1").join(gone.withColumnsRenamed({"id": "i", "key": "k"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_anti"))
    if twice.limit(1).count():
        many = kept.join(twice.select("id", "key"), same, "left_semi").withColumn("key", F.xxhash64(text))
        kept = kept.join(twice.select("id", "key"), same, "left_anti").unionByName(many.dropDuplicates([names[docs.columns.index("doc_id")], "key"]).drop("key"))
    return kept.toDF(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)

"""Benchmark decontamination by spaced seeds.

A mask is a fixed set of word positions; a seed is the hash of the words at those positions,
whatever stands at the others. The two masks of MASKS together hit every window of 13 words with
at most two substitutions. Seeds of benchmark items are looked up among the seeds of every
position of every text; a hit fixes an item and an alignment, and along it the longest run with
four fifths of its words equal is the overlap. An overlap of MIN_WORDS words is a leak; an item of no more words than that leaks
where it lies whole in a text, four fifths of its words equal.

Items of fewer than 13 words have masks over their whole length: with s substitutions allowed (two from ten
words on, one from eight on, else none), the s + 1 masks take every s + 1th word from the first, the second ... on, so
one of them misses all substitutions. An item of fewer than MIN_ITEM words says too little to be told from chance and is left
out.

Words are compared in lower case, with ASCII punctuation as space. A benchmark of up to BROADCAST_BYTES
goes to the executors as an index; the texts are never shuffled. A larger one stays distributed: texts give their seeds as
far as they are in a bitmap (32 MB at most) of the benchmark's, seeds join by equality, and the words under each hit are verified against the
item, all in three passes however large the benchmark is.

Defined cases: null and empty texts and items match nothing; a text of any length is searched whole; equal items are all
reported, a null item_id as -1; of overlaps of one text and item with equally many equal words, the first one counts, then the
longer; repeated rows get their own results; an empty table gives no leak. Only doc_id, item_id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, filter_texts, map_texts, table
from tidemark.llm.tokens import PLAIN, Words, encode, mix

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
MIN_WORDS = 13
MIN_ITEM = 3
BROADCAST_BYTES = 4 << 20
_STEP = np.uint64(0xD1342543DE82EF95)
_FILTER_BITS = 22
_WIDE_BITS = 28


def masks_for(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of n words; those of short items span it whole."""
    if n >= MIN_WORDS:
        return MASKS
    if n < MIN_ITEM:
        return ()
    parts = 3 if n >= 10 else 2 if n >= 8 else 1
    return tuple(tuple(range(r, n, parts)) for r in range(parts))


def seeds(hashes: np.ndarray, mask: tuple[int, ...], n: int) -> np.ndarray:
    """The seed of a mask for items of n words (13: or more) at each position where the mask fits."""
    h = np.full(max(0, len(hashes) - mask[-1]), n, np.uint64)
    for i in mask:
        h = h * _STEP + hashes[i : i + len(h)]
    return mix(h + np.uint64(1 + mask[0] + 16 * mask[1] + 256 * mask[2]))


class Index:
    """The seeds of some items: where each lies, and a bitmap that most other seeds fail."""

    def __init__(self, ids: list[int], texts: list[bytes]) -> None:
        w = Words(texts, fold=PLAIN)
        self.ids = np.array(ids, np.int64)
        self.words = [w.hash[w.at[i] : w.at[i + 1]] for i in range(len(texts))]
        self.sizes = sorted({min(len(x), MIN_WORDS) for x in self.words if len(x) >= MIN_ITEM})
        found = [np.zeros(0, np.uint64)]
        item, at = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        for i, own in enumerate(self.words):
            for s in item_seeds(own):
                found.append(s)
                item.append(np.full(len(s), i))
                at.append(np.arange(len(s)))
        seed = np.concatenate(found)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.item = np.concatenate(item[1:])[order]
        self.at = np.concatenate(at[1:])[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, w: Words) -> np.ndarray:
        """(text, item, alignment) of each hit, distinct; alignment: word of w under the item's first."""
        text = w.text_of()
        out = [np.zeros((0, 3), np.int64)]
        for near, s in text_seeds(w, text, self.sizes, self.maybe):
            lo, hi = (np.searchsorted(self.seed, s, side) for side in ("left", "right"))
            n = hi - lo
            at = np.repeat(near, n)
            k = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            out.append(np.stack([text[at], self.item[k], at - self.at[k]], 1))
        return np.unique(np.concatenate(out), axis=0)

    def leaks(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item id, first word, words, equal words): the longest overlap of each text and item that is a leak."""
        w = Words(texts, fold=PLAIN)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for text, item, at in self.hits(w).tolist():
            lo = max(at, w.at[text])
            found = overlap(w.hash[lo : min(at + len(self.words[item]), w.at[text + 1])], lo - at, self.words[item])
            if found:
                first, n, equal = found
                new = (equal, int(-(at + first - w.at[text])), n)
                best[text, item] = max(best.get((text, item), new), new)
        for (text, item), (equal, start, n) in sorted(best.items()):
            yield text, int(self.ids[item]), -start, n, equal


def item_seeds(words: np.ndarray) -> list[np.ndarray]:
    """The seeds of an item by mask, at each position."""
    return [seeds(words, mask, min(len(words), MIN_WORDS)) for mask in masks_for(len(words))]


def text_seeds(w: Words, text: np.ndarray, sizes: list[int], maybe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, seeds) that maybe lets pass, by mask for items of sizes; masks don't reach into the next text."""
    bits = np.uint64(64 - (len(maybe).bit_length() - 1))
    for n in sizes:
        for mask in masks_for(n):
            s = seeds(w.hash, mask, n)
            near = np.flatnonzero(maybe[(s >> bits).astype(np.int64)])
            near = near[text[near] == text[near + mask[-1]]]
            yield near, s[near]


def overlap(words: np.ndarray, at: int, item: np.ndarray) -> tuple[int, int, int] | None:
    """(first, words, equal words) of the longest run of words that lie on item from at on, if it is a leak; first counts from the item's first word."""
    same = words == item[at : at + len(words)]
    if len(item) <= MIN_WORDS:  # the whole item, first and last word too, with four fifths equal
        equal = int(same.sum())
        return (0, len(item), equal) if len(words) == len(item) and 5 * equal >= 4 * len(item) else None
    first, last = longest_run(same)
    equal = int(same[first:last].sum())
    if last - first >= MIN_WORDS and 5 * equal >= 4 * (last - first):
        return at + first, last - first, equal
    return None


def longest_run(same: np.ndarray) -> tuple[int, int]:
    """The bounds of the longest run with four fifths of it equal, from its first match to its last."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])  # a run is good if this does not fall over it
    first = np.searchsorted(-np.minimum.accumulate(total), -total, side="left")
    end = int(np.argmax(np.arange(len(total)) - first))
    start = int(first[end])
    hits = np.flatnonzero(same[start:end])
    return (start + int(hits[0]), start + int(hits[-1]) + 1) if len(hits) else (0, 0)


def small_index(benchmark: DataFrame) -> Index | None:
    """The benchmark's index if it has BROADCAST_BYTES at most; its size is summed up first."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text")
    if (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > BROADCAST_BYTES:
        return None
    rows = items.collect()
    return Index([r[0] for r in rows], encode([r[1] for r in rows]))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words and n_equal of each leak: the best overlap of a document and an item."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = small_index(benchmark)
    if index is None:
        return wide_leaks(rows, benchmark).select("doc_id", *_LEAK)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        columns = np.array(list(sent.value.leaks(texts)), np.int64).reshape(-1, 5).T
        yield {"doc_id": batch.column(0).take(pa.array(columns[0])), **{k: pa.array(c) for k, c in zip(_LEAK, columns[1:], strict=True)}}

    return map_texts(rows, ["doc_id"], f"doc_id long, {_LEAK_SQL}", work)


_LEAK = ("item_id", "first_word", "n_words", "n_equal")
_LEAK_SQL = ", ".join(f"{k} long" for k in _LEAK)


def wide_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """find_leaks, with key (hash of the text), for a benchmark too large to send: seeds and windows are joined instead.

    A text is known by its key and length, so copies of a text are searched once and get their results by a join.
    """
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text")
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))

    def of_items(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        w = Words(texts, fold=PLAIN)
        rows = []
        for i in range(len(texts)):
            own = w.hash[w.at[i] : w.at[i + 1]]
            rows += [(x, batch.column(0)[i].as_py(), a, len(own)) for s in item_seeds(own) for a, x in enumerate(s.view(np.int64).tolist())]
        yield {c: pa.array(v, pa.int64()) for c, v in zip(("seed", "item", "at", "size"), zip(*rows, strict=True) if rows else [[]] * 4, strict=True)}

    indexed = cut(map_texts(items, ["item"], "seed long, item long, at long, size long", of_items))
    sizes = sorted(r[0] for r in indexed.select(F.least("size", F.lit(MIN_WORDS))).distinct().collect())  # MIN_WORDS rows at most
    bit = F.shiftrightunsigned("seed", 64 - _WIDE_BITS)
    words = indexed.select((bit / 64).cast("int").alias("w"), (bit % 64).cast("int").alias("m")).select("w", F.expr("shiftleft(1L, m)").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    filled = np.zeros((1 << _WIDE_BITS) // 64, np.int64)  # 32 MB, whatever the benchmark's size
    filled[np.asarray(words.column("w").to_numpy(), np.int64)] = words.column("m").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    def of_texts(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        w = Words(texts, fold=PLAIN)
        text = w.text_of()
        at, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for near, s in text_seeds(w, text, sizes, _Bitmap(sent.value)):
            at.append(near)
            seed.append(s)
        at = np.concatenate(at)
        yield {"key": batch.column(0).take(pa.array(text[at])), "bytes": batch.column(1).take(pa.array(text[at])), "place": pa.array(at - w.at[text[at]]), "seed": pa.array(np.concatenate(seed).view(np.int64))}

    known = docs.select("doc_id", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("bytes"), "text")
    found = map_texts(known, ["key", "bytes"], "key long, bytes long, place long, seed long", of_texts).distinct()
    hits = cut(found.join(indexed, "seed").select("key", "bytes", "item", "size", (F.col("place") - F.col("at")).alias("start")).distinct())
    lists = hits.groupBy("key", "bytes").agg(F.collect_list(F.struct("item", "size", "start")).alias("hits"))

    def windows(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        w = Words(texts, fold=PLAIN)
        rows = []
        for i, own in enumerate(batch.column(2).to_pylist()):
            for h in own:
                lo = max(h["start"], 0)
                part = w.hash[w.at[i] + lo : min(w.at[i] + h["start"] + h["size"], w.at[i + 1])]
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), h["item"], h["start"], lo - h["start"], part.tobytes()))
        types = [pa.int64()] * 5 + [pa.binary()]
        yield {c: pa.array(v, t) for c, v, t in zip(("key", "bytes", "item", "start", "lo", "words"), zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)}

    texts = known.groupBy("key", "bytes").agg(F.first("text").alias("text")).join(lists, ["key", "bytes"])
    parts = map_texts(texts, ["key", "bytes", "hits"], "key long, bytes long, item long, start long, lo long, words binary", windows)

    def hashed(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        w = Words(texts, fold=PLAIN)
        yield {"item": batch.column(0), "item_id": batch.column(1), "own": pa.array([w.hash[a:b].tobytes() for a, b in zip(w.at[:-1], w.at[1:], strict=True)], pa.binary())}

    both = parts.join(map_texts(items, ["item", "item_id"], "item long, item_id long, own binary", hashed), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if got := overlap(np.frombuffer(r["words"], np.uint64), r["lo"], np.frombuffer(r["own"], np.uint64)):
                    rows.append({c: r[c] for c in ("key", "bytes", "item", "item_id")} | {"first_word": r["start"] + got[0], "n_words": got[1], "n_equal": got[2]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in ("key", "bytes", "item", *_LEAK)]))

    leaks = both.mapInArrow(verify, f"key long, bytes long, item long, {_LEAK_SQL}")
    best = F.max_by(F.struct(*_LEAK), F.struct("n_equal", -F.col("first_word"), "n_words"))
    leaks = leaks.groupBy("key", "bytes", "item").agg(best.alias("leak")).select("key", "bytes", "leak.*")
    return known.drop("text").join(leaks, ["key", "bytes"])


class _Bitmap:
    """Packed bits, looked up like an array of booleans."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __len__(self) -> int:
        return 64 * len(self.words)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) != 0


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no leak with the benchmark, with all columns as they are."""
    index = small_index(benchmark)
    if index is None:
        names = [f"c{i}" for i in range(len(docs.columns))]  # the caller's own names may clash
        text = F.col(names[docs.columns.index("text")])
        gone = wide_leaks(docs.select(F.lit(0).alias("doc_id"), "text"), benchmark).select("key", "bytes").distinct()
        same = (F.xxhash64(text) == F.col("key")) & (F.octet_length(text) == F.col("bytes"))
        return docs.toDF(*names).join(gone, same, "left_anti").toDF(*docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def keep(texts: list[bytes]) -> np.ndarray:
        clean = np.ones(len(texts), bool)
        clean[[x[0] for x in sent.value.leaks(texts)]] = False
        return clean

    return filter_texts(docs, keep)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Best-fit packing into bins of several permitted sizes.

Texts are cut into pieces of at most the largest size; pieces go, longest first, into the open
bin that they fill best. When none has room, a new bin opens at the size whose cost per filled
place is least, its filling being tried with the pieces still to come, so all sizes are weighed
together. At the end each bin shrinks to the smallest size that holds its contents.

Pieces are dealt to shards of about SHARD pieces by a hash of document, text and piece; each shard packs
alone, so a bin never waits for rows elsewhere, and only the last few bins of a shard go
unfilled. Lengths travel, texts don't, unless they are asked for. The number of shards follows from the
number of pieces, and copies of a row are numbered by counting them, so bins depend on the rows alone: not on files,
partitions or the cluster.

Defined cases: a null or empty text is one piece of length 0 and takes no room; a text longer than
the largest size fills whole bins of its own and packs the rest; repeated rows are packed each; pieces tied in
length go by doc_id (null first), text and piece, and bins tied in room by the last one filled; an
empty table gives no bins. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, map_texts, table
from tidemark.llm.tokens import Words

#: Permitted lengths in words, and what a sequence of each costs: a fixed part, its length and attention's square.
SIZES = (256, 512, 1024, 2048)
SHARD = 50_000


def default_cost(size: int) -> float:
    return 16 + size + size * size / 16_384


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, cost=default_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, size of each bin, used places of each bin); no length exceeds the largest size."""
    sizes = tuple(sorted(sizes))
    order = np.argsort(-lengths, kind="stable")
    bin_of = np.full(len(lengths), -1, np.int64)
    left = Counter(lengths.tolist())
    mask = 0  # bit n: a piece of length n is still to come
    for n in left:
        mask |= 1 << n
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by free places
    free_mask = 0
    size_of: list[int] = []
    used: list[int] = []

    def take(n: int) -> None:
        nonlocal mask
        left[n] -= 1
        if not left[n]:
            mask &= ~(1 << n)

    def rate(size: int, first: int) -> float:
        """Cost per filled place of a bin that holds first and then, again and again, the longest piece to come that fits."""
        filled, rest = first, mask & ~1
        while fits := rest & ((1 << (size - filled + 1)) - 1):
            n = fits.bit_length() - 1
            filled += n * min(left[n], (size - filled) // n)
            rest = fits & ((1 << n) - 1)
        return cost(size) / max(filled, 1)

    for i in order:
        n = int(lengths[i])
        take(n)
        able = free_mask >> n
        if able:
            free = n + (able & -able).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                free_mask &= ~(1 << free)
        else:
            size = min((s for s in sizes if s >= n), key=lambda s: (rate(s, n), s))
            b, free = len(size_of), size
            size_of.append(size)
            used.append(0)
        bin_of[i] = b
        used[b] += n
        free -= n
        room[free].append(b)
        free_mask |= 1 << free
    fill = np.array(used, np.int64)
    final = np.asarray(sizes)[np.searchsorted(sizes, fill)] if len(fill) else np.zeros(0, np.int64)
    return bin_of, final, fill


def pieces(docs: DataFrame, largest: int, texts_too: bool = False) -> DataFrame:
    """doc_id, key (hash of the text), piece, start and length in words of each piece of each text; texts_too: its text.

    A piece's text ends where the next one's first word starts, so a text's pieces in order are the text.
    """

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        w = Words(texts)
        n = np.diff(w.at)
        count = np.maximum(1, -(-n // largest))
        row = np.repeat(np.arange(len(texts)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(largest, n[row] - piece * largest)
        out = {c: batch.column(c).take(pa.array(row)) for c in ("doc_id", "key")} | {"piece": pa.array(piece), "start": pa.array(piece * largest), "length": pa.array(length)}
        if texts_too:
            begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            first = np.where(piece == 0, begin[row], w.start[np.minimum(w.at[row] + piece * largest, max(0, len(w.start) - 1))] if len(w.start) else begin[row])
            last = np.append(first[1:], begin[-1])
            last = np.where(np.append(piece[1:], 0) == 0, begin[row + 1] - 1, last)
            out["text"] = pa.array([texts[r][a - begin[r] : b - begin[r]].decode("utf-8", "replace") for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)], pa.string())
        yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    return map_texts(rows, ["doc_id", "key"], "doc_id long, key long, piece long, start long, length long" + ", text string" * texts_too, work)


def copies(counted: DataFrame, step: int = 1 << 16) -> DataFrame:
    """Each row count times, numbered by copy; no more than step numbers stand in one array."""
    some = counted.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / step))))
    last = F.least(F.col("count"), (F.col("some") + 1) * step) - 1
    return some.withColumn("copy", F.explode(F.sequence(F.col("some") * step, last))).drop("some", "count")


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = SIZES, cost=default_cost, shard: int = SHARD) -> DataFrame:
    """doc_id, key, piece, start, length, bin_id, capacity, used and place (first free place before) of each piece."""
    counted = cut(pieces(docs, max(sizes)).groupBy("doc_id", "key", "piece", "start", "length").count())
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))
    # copies of a row are dealt by their number, so that none of a third of all rows lands in one shard
    rows = copies(counted).withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", "piece", "copy"), F.lit(shards))).drop("copy")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("key", "ascending"), ("piece", "ascending")])
        bin_of, final, fill = pack(np.asarray(group.column("length").to_numpy(), np.int64), sizes, cost)
        order = np.argsort(bin_of, kind="stable")
        group, bin_of = group.take(pa.array(order)), bin_of[order]
        length = group.column("length").to_numpy()
        before = np.cumsum(length) - length
        place = before - before[np.searchsorted(bin_of, bin_of)] if len(bin_of) else before
        out = group.drop_columns(["shard"])
        name = (key[0].as_py() << 32) + bin_of
        return pa.table({**{c: out.column(c) for c in out.column_names}, "bin_id": pa.array(name), "capacity": pa.array(final[bin_of]), "used": pa.array(fill[bin_of]), "place": pa.array(place)})

    return rows.groupBy("shard").applyInArrow(run, "doc_id long, key long, piece long, start long, length long, bin_id long, capacity long, used long, place long")


def packed_texts(docs: DataFrame, sizes: tuple[int, ...] = SIZES, cost=default_cost, shard: int = SHARD) -> DataFrame:
    """pack_documents with the text of each piece: the texts of a bin, by place, are one training sequence."""
    own = pieces(docs, max(sizes), texts_too=True).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("piece").alias("p"), "text")
    own = own.groupBy("d", "k", "p").agg(F.first("text").alias("text"))  # copies are equal
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("piece") == F.col("p"))
    return pack_documents(docs, sizes, cost, shard).join(own, same).drop("d", "k", "p")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts each word from the two words on either side: position-wise
embeddings of the neighbours sum up, tanh makes them a hidden layer, and a two-step softmax
(class of the symbol, then symbol in class) gives the probability of its symbol. The most frequent words of the
corpus are symbols of their own; others share a symbol by their last letters, and then the word's share among them, by its
count in the whole corpus, is a factor too, so every word has its own conditional probability. A document's score is the sum of
the log-probabilities of all its words, each predicted with the word itself masked.

The network is trained in NumPy on the whole corpus: every word of every document is predicted once, by Adagrad steps on small
batches. Documents go as symbols (two bytes a word) to shards of SHARD_WORDS words by a hash of id and text, as many
shards as the corpus needs. In each of ROUNDS rounds a part of the shards trains, a copy of the network each, and the
copies' weights are averaged by words in a tree of groups; the next round starts from there. So the result depends on the
rows alone, not on files, partitions or the cluster, and one lost task costs one shard's work.

Counts grow with the corpus and stay distributed, but for TOP words at most, which all tasks know. A
document's other words travel to their counts as packed arrays, by ranges of their hash, and sums of logarithms come back.
One more count in each shared symbol is left to words that the counts don't hold.

Defined cases: a null or empty text has no word, a log-likelihood of 0 and a null mean; a text of any length is scored whole, and
trained on in pieces that see their neighbours' ends; repeated rows are scored each, and train as one row with their number as
weight; words tied in frequency go by hash; an empty corpus leaves the starting weights; words beyond a text's ends count as
one boundary symbol. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, map_texts, table
from tidemark.llm.tokens import Words, mix

CLASSES, MEMBERS, HIDDEN, SIDE = 32, 64, 16, 2
SYMBOLS = CLASSES * MEMBERS
ENDINGS = 256
KNOWN = SYMBOLS - ENDINGS - 1  # symbol 0 is the boundary
BATCH = 8192
RATE = 0.15
SHARD_WORDS = 2_000_000
ROUNDS = 2
#: Words of a long text that train as one row.
PIECE_WORDS = 50_000
#: Words whose counts all tasks know at most: 8 MB.
TOP = 500_000
RANGE_WORDS = 2_000_000
#: Parts of the weights that are averaged apart, and how many copies' parts meet in a group.
PARTS, MEET = 256, 1024
_U = np.uint64
_OFFSETS = tuple(d for d in range(-SIDE, SIDE + 1) if d)
_SHAPES = (
    ("context", (len(_OFFSETS), SYMBOLS, HIDDEN)),
    ("hidden", (HIDDEN,)),
    ("classes", (HIDDEN, CLASSES)),
    ("class_bias", (CLASSES,)),
    ("members", (CLASSES, HIDDEN, MEMBERS)),
    ("member_bias", (CLASSES, MEMBERS)),
)
N_WEIGHTS = sum(int(np.prod(shape)) for _, shape in _SHAPES)


class Network:
    def __init__(self, flat: np.ndarray) -> None:
        self.flat, at = flat.astype(np.float32), 0
        for name, shape in _SHAPES:
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def start(cls, counts: np.ndarray | None = None, seed: int = 11) -> Network:
        """Random weights, and biases by which symbols are as likely as they are frequent."""
        out = cls(np.random.default_rng(seed).normal(0, 0.1, N_WEIGHTS))
        counts = np.zeros(SYMBOLS) if counts is None else counts
        out.member_bias[:] = np.log(counts + 0.5).reshape(CLASSES, MEMBERS)
        out.class_bias[:] = np.log((counts + 0.5).reshape(CLASSES, MEMBERS).sum(1))
        return out

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        z = self.context[0][around[0]] + self.hidden
        for p in range(1, len(_OFFSETS)):
            z += self.context[p][around[p]]
        return np.tanh(z)

    def log_probability(self, symbols: np.ndarray, around: np.ndarray) -> np.ndarray:
        """log P(symbol | its neighbours); around: neighbours by offset and place."""
        h = self._hidden(around)
        group, member = symbols // MEMBERS, symbols % MEMBERS
        z = h @ self.classes + self.class_bias
        out = z[np.arange(len(z)), group] - _log_sum(z)
        for c, at in _by_group(group):
            z = h[at] @ self.members[c] + self.member_bias[c]
            out[at] += z[np.arange(len(at)), member[at]] - _log_sum(z)
        return out

    def gradient(self, symbols: np.ndarray, around: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Of the mean log-probability of the symbols, each counting as often as times says."""
        n = len(symbols)
        times = (times / times.sum()).astype(np.float32)[:, None]
        h = self._hidden(around)
        group, member = symbols // MEMBERS, symbols % MEMBERS
        step = Network(np.zeros(N_WEIGHTS))
        error = -_softmax(h @ self.classes + self.class_bias)
        error[np.arange(n), group] += 1
        error *= times
        step.classes[:] = h.T @ error
        step.class_bias[:] = error.sum(0)
        back = error @ self.classes.T
        for c, at in _by_group(group):
            own = h[at]
            error = -_softmax(own @ self.members[c] + self.member_bias[c])
            error[np.arange(len(at)), member[at]] += 1
            error *= times[at]
            step.members[c] = own.T @ error
            step.member_bias[c] = error.sum(0)
            back[at] += error @ self.members[c].T
        back *= 1 - h * h
        step.hidden[:] = back.sum(0)
        for p in range(len(_OFFSETS)):
            order = np.argsort(around[p].astype(np.uint16), kind="stable")
            there = around[p][order]
            first = np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]]))
            step.context[p][there[first]] = np.add.reduceat(back[order], first, axis=0)
        return step.flat

    def learn(self, symbols: np.ndarray, around: np.ndarray, times: np.ndarray, power: np.ndarray) -> None:
        """One Adagrad step on a batch; power: squared gradients so far, of the shape of flat."""
        step = self.gradient(symbols, around, times)
        power += step * step
        self.flat += RATE * step / np.sqrt(power + 1e-8)


def _by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(group[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        if cuts[c] < cuts[c + 1]:
            yield c, order[cuts[c] : cuts[c + 1]]


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    e /= e.sum(1, keepdims=True)
    return e


def endings(w: Words) -> np.ndarray:
    """Which of ENDINGS each word has: a hash of its last three bytes."""
    n = w.end - w.start
    last = w.buf[w.end - 1].astype(_U)
    for k, shift in ((2, 8), (3, 16)):
        last |= np.where(n >= k, w.buf[np.maximum(w.end - k, 0)], 0).astype(_U) << _U(shift)
    return (mix(last) % _U(ENDINGS)).astype(np.int64)


@dataclass
class Lexicon:
    """What all tasks know of the corpus's words.

    vocabulary: the words with symbols of their own, most frequent first. words: those whose counts are at hand, sorted, with the
    logarithms of the counts. held: by ending, the count of all words outside the vocabulary. least: words with fewer are not at
    hand; rest is how many there are in all texts.
    """

    vocabulary: np.ndarray
    words: np.ndarray
    logs: np.ndarray
    held: np.ndarray
    symbol_counts: np.ndarray
    least: int
    total: int
    rest: int

    def symbols(self, w: Words) -> np.ndarray:
        """The symbol of each word."""
        out = 1 + KNOWN + endings(w)
        if len(self.vocabulary):
            order = np.argsort(self.vocabulary)
            names = self.vocabulary[order]
            at = np.minimum(np.searchsorted(names, w.hash), len(names) - 1)
            known = names[at] == w.hash
            out[known] = 1 + order[at[known]]
        return out

    def shares(self, w: Words, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log of each word's share of its symbol, as far as its count is at hand, which words' counts are not)."""
        other = np.flatnonzero(symbols > KNOWN)
        out, rest = np.zeros(len(symbols)), np.zeros(len(symbols), bool)
        out[other] = -np.log(self.held + 1)[symbols[other] - KNOWN - 1]  # one count is left to words that were not seen
        rest[other] = True
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, w.hash[other]), len(self.words) - 1)
            found = self.words[at] == w.hash[other]
            out[other[found]] += self.logs[at[found]]
            rest[other[found]] = False
        return out, rest


def neighbours(text: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """By offset and word: the symbol there, or the boundary's; text: which one each word belongs to."""
    out = np.zeros((len(_OFFSETS), len(symbols)), np.int64)
    for p, d in enumerate(_OFFSETS):
        lo, hi = max(0, -d), len(symbols) - max(0, d)
        if lo < hi:
            same = text[lo:hi] == text[lo + d : hi + d]
            out[p, lo:hi] = np.where(same, symbols[lo + d : hi + d], 0)
    return out


def symbol_logs(network: Network, w: Words, symbols: np.ndarray) -> np.ndarray:
    """The log-probability of each word's symbol."""
    around = neighbours(w.text_of(), symbols)
    logs = np.empty(len(symbols))
    for lo in range(0, len(symbols), BATCH):
        logs[lo : lo + BATCH] = network.log_probability(symbols[lo : lo + BATCH], around[:, lo : lo + BATCH])
    return logs


def by_text(w: Words, values: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[w.at[1:]] - total[w.at[:-1]]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, n): hash (as a long), ending and count of every word of all documents."""

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        w = Words(texts, lower=True)
        word, first, n = np.unique(w.hash, return_index=True, return_counts=True)
        yield {"word": pa.array(word.view(np.int64)), "ending": pa.array(endings(w)[first].astype(np.int16)), "n": pa.array(n)}

    return map_texts(docs, [], "word long, ending short, n long", work).groupBy("word", "ending").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, most: int = TOP) -> Lexicon:
    """The lexicon of counts: words down to the least count that gives no more than most words.

    One aggregate by magnitude finds that count, so no task has to rank the corpus's words.
    """
    size = F.floor(F.log2("n") * 16).cast("int")
    bins = counts.groupBy(size.alias("size")).agg(F.count("*").alias("words"), F.min("n").alias("least"), F.sum("n").alias("n")).collect()  # a thousand rows at most
    least, at_hand, total = np.iinfo(np.int64).max, 0, sum(r.n for r in bins)
    rest = total
    for r in sorted(bins, key=lambda r: -r["size"]):
        if at_hand + r.words > most:
            break
        at_hand, least, rest = at_hand + r.words, r.least, rest - r.n
    rows = counts.where(F.col("n") >= int(least)).toArrow()
    word = np.asarray(rows.column("word").to_numpy(), np.int64).view(_U)
    ending, n = np.asarray(rows.column("ending").to_numpy(), np.int64), np.asarray(rows.column("n").to_numpy(), np.int64)
    held = np.zeros(ENDINGS)
    for e, x in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect():
        held[e] = x
    first = np.lexsort((word.view(np.int64), -n))[:KNOWN]
    np.subtract.at(held, ending[first], n[first])
    symbol_counts = np.concatenate([[0], n[first], np.zeros(KNOWN - len(first)), held])
    order = np.argsort(word)
    return Lexicon(word[first], word[order], np.log(n[order].astype(np.float64)), held, symbol_counts, int(least), int(total), int(rest))


def shard_rows(docs: DataFrame, known: Lexicon, shards: int) -> DataFrame:
    """(shard, key, piece, lead, n, symbols, times): the documents' symbols, rows repeated in full once with their number.

    A piece begins with lead words and may end with words that only are neighbours of its n own ones.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        w = Words(texts, lower=True)
        symbols = sent.value.symbols(w).astype(np.uint16)
        rows = []
        for i, key in enumerate(batch.column(0).to_pylist()):
            a, b = int(w.at[i]), int(w.at[i + 1])
            for piece, lo in enumerate(range(a, b, PIECE_WORDS)):
                hi, begin = min(lo + PIECE_WORDS, b), max(a, lo - SIDE)
                rows.append((key, piece, lo - begin, hi - lo, symbols[begin : min(b, hi + SIDE)].tobytes()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield {c: pa.array(v, t) for c, v, t in zip(("key", "piece", "lead", "n", "symbols"), zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)}

    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text")
    rows = map_texts(keyed, ["key"], "key long, piece long, lead long, n long, symbols binary", work)
    rows = rows.groupBy("key", "piece").agg(F.first("lead").alias("lead"), F.first("n").alias("n"), F.first("symbols").alias("symbols"), F.count("*").alias("times"))
    return rows.withColumn("shard", F.pmod(F.xxhash64("key", "piece"), F.lit(shards)))


def trained(start: np.ndarray, lead: list[int], n: list[int], symbols: list[bytes], times: list[int]) -> tuple[np.ndarray, int]:
    """(weights, words) of a copy that has learnt the rows in their order, from the weights start."""
    own, power = Network(start.copy()), np.full(N_WEIGHTS, 1e-6, np.float32)
    every = np.frombuffer(b"".join(symbols), np.uint16).astype(np.int64)
    sizes = np.array([len(x) // 2 for x in symbols])
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lead, n, times = (np.array(x, np.int64) for x in (lead, n, times))
    inner = np.flatnonzero((place >= lead[row]) & (place < (lead + n)[row]))
    around = neighbours(row, every)
    for lo in range(0, len(inner), BATCH):
        at = inner[lo : lo + BATCH]
        own.learn(every[at], around[:, at], times[row[at]], power)
    return own.flat, int((n * times).sum())


_COPY = pa.schema([("part", pa.int64()), ("copy", pa.int64()), ("weights", pa.binary()), ("words", pa.int64())])
_COPY_SQL = "part long, copy long, weights binary, words long"


def _summed(key: tuple, group: pa.Table) -> pa.Table:
    """One part's weights of some copies, summed in their order."""
    group = group.sort_by("copy")
    total = sum(np.frombuffer(x, np.float64) for x in group.column("weights").to_pylist())
    row = {"part": key[0].as_py(), "copy": group.column("copy")[0].as_py(), "weights": total.tobytes(), "words": sum(group.column("words").to_pylist())}
    return pa.Table.from_pylist([row], schema=_COPY)


def train(docs: DataFrame, known: Lexicon, shard_words: int = SHARD_WORDS) -> Network:
    """The network, from all words of all documents."""
    network = Network.start(known.symbol_counts)
    if not known.total:
        return network
    shards = ROUNDS * -(-known.total // (ROUNDS * shard_words))
    rows = cut(shard_rows(docs, known, shards))
    for turn in range(ROUNDS):
        start = docs.sparkSession.sparkContext.broadcast(network.flat)

        def run(key: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by([("key", "ascending"), ("piece", "ascending")])
            flat, words = trained(start.value, *(group.column(c).to_pylist() for c in ("lead", "n", "symbols", "times")))
            parts = np.array_split(flat.astype(np.float64) * words, PARTS)
            return pa.Table.from_pylist([{"part": i, "copy": key[0].as_py(), "weights": x.tobytes(), "words": words} for i, x in enumerate(parts)], schema=_COPY)

        copies = rows.where(F.col("shard") % ROUNDS == turn).groupBy("shard").applyInArrow(run, _COPY_SQL)
        some = copies.groupBy("part", F.floor(F.col("copy") / MEET).alias("some")).applyInArrow(_summed, _COPY_SQL)
        means = sorted(some.groupBy("part").applyInArrow(_summed, _COPY_SQL).collect(), key=lambda r: r.part)
        if means:
            network = Network(np.concatenate([np.frombuffer(r.weights, np.float64) / r.words for r in means]))
    return network


def _range(word: np.ndarray, ranges: int) -> np.ndarray:
    return ((word >> _U(20)) % _U(ranges)).astype(np.int64)


def _log_counts(packed: pa.Table, counts: pa.Table) -> pa.Table:
    """Of one range of words: for each piece of texts, the sum of log(n) of its words by row. Words not counted have n = 1."""
    word = np.asarray(counts.column("word").to_numpy(), np.int64).view(_U)
    order = np.argsort(word)
    word, log = word[order], np.log(np.asarray(counts.column("n").to_numpy(), np.float64)[order])
    rows = []
    for piece, own, row in zip(*(packed.column(c).to_pylist() for c in ("piece", "words", "rows")), strict=True):
        own, row = np.frombuffer(own, _U), np.frombuffer(row, np.uint32)
        logs = np.zeros(len(own))
        if len(word):
            at = np.minimum(np.searchsorted(word, own), len(word) - 1)
            logs = np.where(word[at] == own, log[at], 0.0)
        here, place = np.unique(row, return_inverse=True)
        rows.append({"piece": piece, "rows": here.tobytes(), "logs": np.bincount(place, logs, len(here)).tobytes()})
    return pa.Table.from_pylist(rows, schema=_LOGS)


_LOGS = pa.schema([("piece", pa.string()), ("rows", pa.binary()), ("logs", pa.binary())])
_PACKED = "range long, piece string, words binary, rows binary, doc_ids array<long>, n_words array<long>, logs array<double>"
_NAMES = ("range", "piece", "words", "rows", "doc_ids", "n_words", "logs")
_TYPES = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()))


def score_documents(docs: DataFrame, network: Network, known: Lexicon, counts: DataFrame) -> DataFrame:
    """doc_id, n_words, log_likelihood and mean_log_likelihood of every row. counts: word and n, as of count_words."""
    sent = docs.sparkSession.sparkContext.broadcast((network.flat, known))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def base(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        w = Words(texts, lower=True)
        symbols = sent.value[1].symbols(w)
        logs, rest = sent.value[1].shares(w, symbols)
        return w, np.diff(w.at), by_text(w, logs + symbol_logs(Network(sent.value[0]), w, symbols)), rest

    def whole(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        _, n, total, _ = base(texts)
        yield {"doc_id": batch.column(0), "n_words": pa.array(n), "log_likelihood": pa.array(total)}

    ranges = max(1, -(-known.rest // RANGE_WORDS))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        w, n, total, rest = base(texts)
        word, text = w.hash[rest], w.text_of()[rest].astype(np.uint32)
        piece = uuid.uuid4().hex
        rows = [(-1, piece, None, None, batch.column(0).to_pylist(), n.tolist(), total.tolist())]
        part = _range(word, ranges)
        order = np.argsort(part, kind="stable")
        part, word, text = part[order], word[order], text[order]
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            rows.append((int(part[lo]), piece, word[lo:hi].tobytes(), text[lo:hi].tobytes(), None, None, None))
        yield {c: pa.array(v, t) for c, v, t in zip(_NAMES, zip(*rows, strict=True), _TYPES, strict=True)}

    def total(pieces: pa.Table, parts: pa.Table) -> pa.Table:
        row = pieces.to_pylist()[0]
        logs = np.array(row["base"])
        for at, own in sorted(zip(parts.column("rows").to_pylist(), parts.column("logs").to_pylist(), strict=True)):
            logs[np.frombuffer(at, np.uint32)] += np.frombuffer(own, np.float64)
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(row["n_words"], pa.int64()), "log_likelihood": pa.array(logs)})

    schema = "doc_id long, n_words long, log_likelihood double"
    if not known.rest:
        out = map_texts(rows, ["doc_id"], schema, whole)
    else:
        packed = cut(map_texts(rows, ["doc_id"], _PACKED, work))  # kept: pieces have names of their own
        place = F.pmod(F.shiftrightunsigned("word", 20), F.lit(ranges)).alias("range")
        words = packed.where("range >= 0").select("range", "piece", "words", "rows").groupBy("range")
        found = words.cogroup(counts.where(F.col("n") < known.least).select(place, "word", "n").groupBy("range"))
        parts = found.applyInArrow(_log_counts, "piece string, rows binary, logs binary")
        bases = packed.where("range < 0").select("piece", "doc_ids", "n_words", F.col("logs").alias("base"))
        out = bases.groupBy("piece").cogroup(parts.groupBy("piece")).applyInArrow(total, schema)
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = cut(count_words(docs))
    known = lexicon(counts)
    return score_documents(docs, train(docs, known), known, counts)

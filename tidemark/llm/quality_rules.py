"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

``rule_stats`` measures each text in one Arrow pass; each rule then votes good, bad or abstains.
Documents with equal votes are alike, so EM runs over the counts of vote patterns (at most
3^rules rows, whatever the corpus holds): a latent good/bad class with, for each rule, the
probability of each vote in each class. The posterior of a pattern goes back by a broadcast join of that
bounded table.

Defined cases: a null or blank text has no words, all counts 0, base_failed true and kept false;
a text of any length is measured whole; a posterior of just the threshold keeps, and documents of equal votes tie always;
repeated rows get a result each and count each in the statistics; an empty table gives an empty result; null ids stay null. Only
doc_id and text are read, so other columns can't clash.

Two stages follow each other: EM learns what each vote tells of a class, then DOUBT bounds it. Rules are not independent as EM
takes them to be, so without the bound one vote could outweigh all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, map_texts, table
from tidemark.llm.tokens import Words, _IS_SPACE, mix, windows

REPEAT_WINDOW = 8
MIN_WORDS = 20
DOUBT = 0.02
GOOD, BAD, ABSTAIN = 1, 0, 2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ENDING = b".?!:\"'"

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_ended long, n_letters long, n_upper long, n_distinct long, n_bare long"


def _per_text(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def text_stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures in STATS of each text."""
    w = Words(texts)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    starts = (buf & 0xC0) != 0x80  # the first byte of a code point
    letters = starts & _LETTER[buf]

    text = w.text_of()
    h, at = windows(w, REPEAT_WINDOW)
    h = mix(h ^ (text[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + REPEAT_WINDOW, -1)
    repeated = np.cumsum(edge[:-1]) > 0

    # distinct words by text: the first of each equal (text, word) group, in text order
    order = np.lexsort((w.hash, text))
    new = np.ones(len(order), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (text[order][1:] != text[order][:-1])
    letter_sum = np.concatenate([[0], np.cumsum(_LETTER[buf], dtype=np.int64)])
    bare = letter_sum[w.end] == letter_sum[w.start]  # words without a letter

    dup, lines, ended = [], [], []
    for t in texts:
        own = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(own) - len(set(own)))
        lines.append(len(own))
        ended.append(sum(x.rstrip()[-1] in _ENDING for x in own))
    by_text = lambda flags: np.bincount(text[flags], minlength=len(texts))
    return {
        "n_words": np.diff(w.at),
        "word_chars": _per_text(starts & ~_IS_SPACE[buf], first),
        "n_symbols": _per_text(_SYMBOL[buf], first),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": by_text(repeated),
        "n_lines": np.array(lines, np.int64),
        "n_ended": np.array(ended, np.int64),
        "n_letters": _per_text(letters, first),
        "n_upper": _per_text(_UPPER[buf], first),
        "n_distinct": np.bincount(text[order][new], minlength=len(texts)),
        "n_bare": by_text(bare),
    }


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every row."""

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        yield {"doc_id": batch.column(0), **{k: pa.array(v.astype(np.int64)) for k, v in text_stats(texts).items()}}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], f"doc_id long, {STATS}", work)


def rules() -> dict[str, tuple[Column, Column]]:
    """By rule: when it votes bad and when it votes good; else it abstains."""
    c, ratio = F.col, lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "length": (c("n_words") < 20, c("n_words").between(40, 200_000)),
        "word_length": (~ratio("word_chars", "n_words").between(2.5, 12), ratio("word_chars", "n_words").between(3, 9)),
        "symbols": (ratio("n_symbols", "n_words") > 0.1, ratio("n_symbols", "n_words") <= 0.02),
        # one rule, for repeated lines are repeated windows too: EM takes rules to be independent in each class
        "repetition": (
            (ratio("n_dup_lines", "n_lines") > 0.3) | (ratio("n_repeat_words", "n_words") > 0.2),
            (ratio("n_dup_lines", "n_lines") <= 0.1) & (ratio("n_repeat_words", "n_words") <= 0.1),
        ),
        "endings": (ratio("n_ended", "n_lines") < 0.2, ratio("n_ended", "n_lines") > 0.6),
        "letters": (ratio("n_letters", "word_chars") < 0.7, ratio("n_letters", "word_chars") > 0.85),
        "shouting": (ratio("n_upper", "n_letters") > 0.4, ratio("n_upper", "n_letters") < 0.15),
        "variety": ((c("n_words") >= 40) & (c("n_distinct") < 10), ratio("n_distinct", "n_words") > 0.3),
        "bare_words": (ratio("n_bare", "n_words") > 0.2, ratio("n_bare", "n_words") < 0.05),
    }


def vote_pattern() -> Column:
    """All votes of a row as one number, a base-3 digit for each rule."""
    total = F.lit(0).cast("long")
    for bad, good in rules().values():
        total = total * 3 + F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)
    return total


def fit_votes(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 200) -> np.ndarray:
    """EM over pattern counts: the posterior probability of good for each pattern.

    Starts from the share of good votes, so the classes can't swap names. Votes are smoothed by one
    document's worth in each class. In the end each vote gets a probability of DOUBT at least in either class: no rule
    counts as all but certain, so a single one that disagrees with all others does not decide.
    """
    digits = (patterns[:, None] // 3 ** np.arange(n_rules - 1, -1, -1)) % 3
    votes = np.stack([digits == v for v in (BAD, GOOD, ABSTAIN)], 2).astype(float)  # pattern, rule, vote
    good, bad = votes[:, :, GOOD].sum(1), votes[:, :, BAD].sum(1)
    post = np.clip((good + 0.5) / (good + 3 * bad + 1), 0.02, 0.98)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post], 1)  # pattern, class
        prior = (weight.sum(0) + 1) / (counts.sum() + 2)
        table = np.einsum("pc,prv->crv", weight, votes) + 1
        table /= table.sum(2, keepdims=True)
        logs = np.log(prior) + np.einsum("crv,prv->pc", np.log(table), votes)
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    table = np.maximum(table, DOUBT)
    logs = np.log(prior) + np.einsum("crv,prv->pc", np.log(table / table.sum(2, keepdims=True)), votes)
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every document with its measures, base_failed, posterior quality probability and kept."""
    spark = docs.sparkSession
    stats = cut(rule_stats(docs).withColumn("pattern", vote_pattern()))
    found = stats.groupBy("pattern").count().toArrow()  # bounded: 3^rules rows
    patterns, counts = (np.asarray(found.column(i).to_numpy(), np.int64) for i in (0, 1))
    post = fit_votes(patterns, counts, len(rules()))
    posts = spark.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, post, strict=True)], "pattern long, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        stats.join(F.broadcast(posts), "pattern", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
        .drop("pattern")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )

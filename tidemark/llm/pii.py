"""PII by bootstrapped contextual extraction.

Base spans (email, ip, card, phone) come from fixed patterns. They are the seeds: an identifier's
neighbouring words form lexical patterns, and a pattern is worth what the identifiers it surrounds
are worth. Spark scores that pattern-instance graph round by round: patterns by the share of known
instances among all identifiers they surround, identifiers by the best pattern that surrounds
them; identifiers of high-confidence patterns become known and vouch for further patterns. At the
end every identifier under an accepted pattern is a span of the pattern's kind. Base spans stay.

An identifier is a word, stripped of edge punctuation, with four digits or more, or with an @ or
(at) inside, or a run of several words on one line: numbers with four digits or more in all, or words around a
written-out at and dots. It overlaps no base span. Rounds end when no new instance appears; a text's start is a left
context like others. Tables carry identifiers and their neighbours, never
texts; the graph is aggregated, so a pattern shared by a third of all rows is one counter. Accepted patterns, each vouched for
by several known identifiers, go back to the texts as a lookup if there are MAX_SENT at most, and through joins beyond; so
texts are never shuffled for them.

Defined cases: a null or empty text has no span (counts 0, spans ''); a text of any length is searched whole; neighbours
of over LONG characters are known by their length, such identifiers by a digest; a pattern whose best kinds tie takes the last in the alphabet, an
identifier under patterns of two kinds the first; repeated rows get a result each and count once as evidence; an empty table
gives an empty result; offsets are code points, end exclusive. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, map_texts, table

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: IP's matches, which start at the start of a run of digits: no run is tried from each of its digits.
IP_RUNS = re.compile(r"(?<![0-9])" + IP.pattern)
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
IDENTIFIER = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@(\[][^\x20\x09-\x0D]*")
EDGE = ".,;:!?\"'()[]{}<>"
HIDDEN = re.compile(r"[@]|\(at\)|\[at\]", re.I)
NUMBERS = re.compile(r"(?<![+(](?=[+(]))(?<![^\x20\x09-\x0D(\[{<\"'])[+(]*[0-9][0-9()./+-]*(?:[\x20\x09]+[(]?[0-9][0-9()./+-]*)+(?![^\x20\x09-\x0D,;:!?\"'\]}>])")
#: A run with written-out at: (at) or [at] between words, then further names, joined by (dot) or [dot] or as they are.
SPELT = re.compile(r"(?<![\w.%+-])[\w.%+-]+[\x20\x09]*[(\[]at[)\]][\x20\x09]*[\w.-]+(?:[\x20\x09]*[(\[]dot[)\]][\x20\x09]*[\w-]+)*", re.I)

#: Accepted patterns that are sent to all tasks at most: 64 MB as strings of LONG characters for each word.
MAX_SENT = 100_000
LONG = 64

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = int(x) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans by kind as listed, then start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # as EMAIL from the left: a match's name is the run of name characters before its @
        lo = at
        while lo > free and text[lo - 1] in EMAIL_NAME:
            lo -= 1
        if lo < at and (m := EMAIL_HOST.match(text, at + 1)):
            out.append(("email", lo, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if DIGITS.search(text):
        out += [("ip", *m.span()) for m in IP_RUNS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


def digits_of(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def shape(instance: str) -> str:
    """What an identifier looks like: digits as 9, letters as a, runs as one."""
    return re.sub(r"a+", "a", re.sub(r"9+", "9", re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", instance))))


def contexts(text: str, base: list[Span]) -> Iterator[tuple[str, int, int, str, str, str]]:
    """(kind or '', start, end, identifier, left words, right word) of base spans and other identifiers."""
    if not base and not DIGITS.search(text) and not HIDDEN.search(text):
        return
    words = _Neighbours(text)
    spans = sorted((s, e, k) for k, s, e in base)
    for s, e, kind in spans:
        yield kind, s, e, *words.around(s, e)
    runs, free, bases = [], 0, iter([*spans, (len(text) + 1, len(text) + 1, "")])
    s0, e0, _ = next(bases)
    both = [m for pattern in (NUMBERS, SPELT) if pattern is NUMBERS or HIDDEN.search(text) for m in pattern.finditer(text)]
    for lo, hi in sorted((m.start(), m.start() + len(m.group().rstrip(".-/+"))) for m in both if m.re is SPELT or digits_of(m.group()) >= 4):
        while e0 <= lo:
            s0, e0, _ = next(bases)
        if lo >= free and not s0 < hi:
            yield "", lo, hi, *words.around(lo, hi)
            runs.append((lo, hi, ""))
            free = hi
    spans = sorted(spans + runs)
    taken = iter(spans + [(len(text) + 1, len(text) + 1, "")])
    s0, e0, _ = next(taken)
    for m in IDENTIFIER.finditer(text):
        word = m.group()
        if digits_of(word) < 4 and not HIDDEN.search(word):
            continue
        lo = m.start() + len(word) - len(word.lstrip(EDGE))
        hi = m.end() - len(word) + len(word.rstrip(EDGE))
        while e0 <= lo:
            s0, e0, _ = next(taken)
        if lo < hi and not s0 < hi:
            yield "", lo, hi, *words.around(lo, hi)


def known_as(word: str) -> str:
    return word if len(word) <= LONG else hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


class _Neighbours:
    """The words of a text, found once, to look up what stands around a span."""

    def __init__(self, text: str) -> None:
        self.text = text
        spans = [m.span() for m in WORD.finditer(text)]
        self.start, self.end = [s for s, _ in spans], [e for _, e in spans]

    def around(self, lo: int, hi: int) -> tuple[str, str, str]:
        """The span, the two words before it and the word after it, in lower case; a word the span begins or ends in counts as far as it is outside."""
        i = bisect_left(self.start, lo)
        left = [self._word(self.start[k], min(self.end[k], lo)) for k in range(max(0, i - 2), i)]
        k = bisect_right(self.end, hi)
        right = self._word(max(self.start[k], hi), self.end[k]) if k < len(self.end) else ""
        return known_as(self.text[lo:hi]), " ".join(left), right

    def _word(self, lo: int, hi: int) -> str:
        return self.text[lo:hi].lower() if hi - lo <= LONG else f"({hi - lo})"


def patterns_of(left: str, right: str) -> tuple[str, str]:
    """The patterns that _patterns() makes of a context."""
    return f"L {left}", f"B {left.split(' ')[-1]} _ {right}"


def spans_by(patterns: dict[str, str], found: Iterator[tuple]) -> list[Span]:
    """The spans that accepted patterns give to the identifiers among found that have no kind."""
    out = []
    for kind, start, end, _, left, right in found:
        kinds = [patterns[p] for p in patterns_of(left, right) if p in patterns] if not kind else []
        if kinds:
            out.append((min(kinds), start, end))
    return out


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key (digest of the text), base (array of spans) and found (identifiers in context) of every row."""

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        keys, base, found = [], [], []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            own = base_spans(text)
            keys.append(hashlib.sha256(raw).hexdigest())
            base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in own])
            found.append([dict(zip(_FOUND, x, strict=True)) for x in contexts(text, own)])
        yield {"doc_id": batch.column(0), "key": pa.array(keys, pa.string()), "base": pa.array(base, _SPANS), "found": pa.array(found, _CONTEXTS)}

    return map_texts(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        ["doc_id"],
        "doc_id long, key string, base array<struct<kind:string,start:long,end:long>>, "
        "found array<struct<kind:string,start:long,end:long,instance:string,left:string,right:string>>",
        work,
    )


_FOUND = ("kind", "start", "end", "instance", "left", "right")
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_CONTEXTS = pa.list_(pa.struct([(n, pa.int64() if n in ("start", "end") else pa.string()) for n in _FOUND]))


def _patterns() -> Column:
    """The two words on the left, and the word on either side."""
    last = F.element_at(F.split("left", " "), -1)
    return F.array(F.concat(F.lit("L "), "left"), F.concat(F.lit("B "), last, F.lit(" _ "), "right"))


def _accepted(edges: DataFrame, known: DataFrame, min_known: int, min_score: float) -> DataFrame:
    """(pattern, kind) with min_known distinct known instances of a kind, which are min_score of all its instances."""
    total = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    by_kind = edges.drop("kind").join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
    good = by_kind.where(F.col("n") >= min_known).join(total, "pattern").where(F.col("n") >= min_score * F.col("total"))
    return good.groupBy("pattern").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))


def bootstrap(found: DataFrame, min_known: int = 5, min_score: float = 0.8) -> DataFrame:
    """(pattern, kind) of the patterns accepted in the end.

    found: kind ('' if unknown), instance, left, right. Each round accepts patterns by the
    instances known so far, and every instance of an accepted pattern becomes known, until none is new.
    """
    edges = found.select("instance", "kind", F.explode(_patterns()).alias("pattern"))
    edges = cut(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    known = edges.where("kind <> ''").groupBy("instance").agg(F.min("kind").alias("kind"))
    while True:
        good = _accepted(edges, known, min_known, min_score)
        more = edges.where("kind = ''").drop("kind").join(good, "pattern").groupBy("instance").agg(F.min("kind").alias("kind"))
        more = cut(more.join(known.select("instance"), "instance", "left_anti"))
        if not more.limit(1).count():
            break
        known = cut(known.unionByName(more))
    return _accepted(edges, known, min_known, min_score)


def discovered(spans: DataFrame) -> DataFrame:
    """(doc_id, key, more): the spans that accepted patterns add, one row for each text that gains any."""
    found = spans.where(F.size("found") > 0).select("doc_id", "key", F.explode("found").alias("f")).select("doc_id", "key", "f.*")
    found = cut(found.dropDuplicates(["doc_id", "key", "start", "end", "kind"]))
    good = bootstrap(found.select("kind", "instance", "left", "right"))
    hits = found.where("kind = ''").withColumn("pattern", F.explode(_patterns())).drop("kind").join(good, "pattern")
    one = hits.groupBy("doc_id", "key", "start", "end").agg(F.min("kind").alias("kind"))
    return one.groupBy("doc_id", "key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))


def _sent(good: DataFrame) -> dict[str, str] | None:
    """The accepted patterns and their kinds, if they are few enough to send."""
    good = cut(good)
    return None if good.count() > MAX_SENT else {r.pattern: r.kind for r in good.collect()}


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, base and spans (base and discovered, by kind as listed, then start) of every row."""
    spans = cut(find_spans(docs))
    evidence = spans.where(F.size("found") > 0).select("doc_id", "key", F.inline("found"))
    patterns = _sent(bootstrap(evidence.select("kind", "instance", "left", "right")))
    empty = F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint>>)")
    if patterns is None:
        more = discovered(spans).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "more")
        joined = spans.drop("found").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    elif not patterns:
        joined = spans.withColumn("more", empty)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(patterns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                more = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in spans_by(sent.value, (tuple(f.values()) for f in found))] for found in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(more, _SPANS)], names=["doc_id", "key", "base", "more"])

        of = "array<struct<kind:string,start:long,end:long>>"
        joined = spans.select("doc_id", "key", "base", "found").mapInArrow(run, f"doc_id long, key string, base {of}, more {of}")
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.sort_array(F.transform(F.concat("base", F.coalesce("more", empty)), rank))
    return joined.select("doc_id", "key", "base", F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by [KIND] and n_chars, if there, brought up to date. Null texts stay null."""
    spans = cut(find_spans(docs).where(F.size("found") > 0))
    patterns = _sent(bootstrap(spans.select("doc_id", "key", F.inline("found")).select("kind", "instance", "left", "right")))
    names = [f"c{i}" for i in range(len(docs.columns))]  # a caller's own names may clash
    rows = docs.toDF(*names).withColumn("more", F.lit(None).cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    text, doc_id = (names[docs.columns.index(c)] for c in ("text", "doc_id"))
    if patterns is None:
        more = discovered(spans).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "more")
        same = F.col(doc_id).cast("long").eqNullSafe(F.col("d")) & (F.sha2(F.coalesce(text, F.lit("")), 256) == F.col("k"))
        rows = rows.drop("more").join(more, same, "left").select(*names, "more")
    at = names.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(patterns or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, more in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if t is not None:
                    base = base_spans(t)
                    own = spans_by(sent.value, contexts(t, base)) if sent.value else []
                    t = masked(t, base + own + [(x["kind"], x["start"], x["end"]) for x in more or ()])
                texts.append(t)
            columns = [*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rows.mapInArrow(run, rows.drop("more").schema).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def masked(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by the name of its first span's kind."""
    out, at = [], 0
    for kind, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if lo >= at:
            out += [text[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))

"""WARC archives: written by Spark's own text writer, read back by boundary-chain verification.

Writing. A record is a string that ends in a blank line; the writer's line separator is the CRLF CRLF
that closes each record, so any file system Spark can write will do. Of the records with equal
payloads of at least ``least`` bytes the one with the largest page_id holds the payload, the others are
revisits that refer to it.

Reading. Files are split at the magic ``WARC/1.1``, which payloads may hold too, so a fragment is only a
candidate record. A running sum of fragment lengths within splits and of split lengths within
a file gives each candidate's offset; its header gives its length and thus its successor's offset.
Pointer jumping from offset 0 keeps the candidates that the chain reaches: tasks jump pointers to where
they leave a split, and in round k the entered splits are joined with pointers 2^k splits long, so
a file of n splits takes log2 n rounds. Magic inside a payload is never reached; the fragments up to the next reached record are its payload.
Tables of offsets and headers go through the joins, payload bytes only where a record has to be put together.

Defined cases: a null payload counts as empty, a null URL as an empty one; a URL comes back as it was, blanks, controls and %
being percent-encoded in the archive; a payload or URL of any length is one record's; rows repeated in full are records of
their own, and of equal payloads those tied for the largest page_id are all responses; an empty table makes empty archives; a
null page_id never wins over a number. Only page_id, url and html are read, so other columns can't clash. A response holds the
payload alone, without an HTTP block.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shared_folder, stored, table

MAGIC = "WARC/1.1\r\n"
CLOSE = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
LEAST = 1000


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


#: Characters that a URL can't bear in a header line, % first, since the others are written with it.
_UNFIT = ("%", *map(chr, range(33)), "\x7f")


def encoded(url: Column) -> Column:
    """A URL fit for a header line: blanks, controls and % percent-encoded."""
    out = url
    for c in _UNFIT:
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(url.rlike(r"[%\x00-\x20\x7F]"), out).otherwise(url)


def decoded(url: Column) -> Column:
    """The URL that encoded() was given."""
    out = url
    for c in reversed(_UNFIT):
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(F.contains(url, F.lit("%")), out).otherwise(url)


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """One string for each page: a whole WARC record but for the CRLF CRLF that closes it."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    body = pages.withColumn("digest", F.sha1("html")).withColumn("bytes", F.octet_length("html").cast("long"))
    last = (
        body.where(F.col("bytes") >= least)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first_id")
    )
    last = stored(last)  # its size is known from here on, so payloads are shuffled only if it is too large to broadcast
    body = body.join(last, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = encoded(F.coalesce("url", F.lit("")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(
            again,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", _record_id(F.col("first_id"))),
                line("X-Payload-Length", F.col("bytes").cast("string")),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return body.select(F.concat(head, F.when(again, "").otherwise(F.col("html"))).alias("record"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes a WARC file for each partition of pages."""
    records(pages, least).write.mode("overwrite").option("lineSep", CLOSE).text(path)


def fragments(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """The files in path, split at the magic: file, split, inside (bytes before it in its split), n (bytes with the
    magic), head and length (of header and payload, if it begins like a record), header, got and digest (of the payload
    bytes in this fragment); whole: the fragment itself too.
    """
    lines = (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("fragment"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[str, int] | None = None
        inside = 0
        for batch in batches:  # a split's lines come in the file's order
            out = []
            for file, split, fragment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (file, split):
                    at, inside = (file, split), 0
                end = fragment.find(b"\r\n\r\n")
                m = _LENGTH.search(fragment[: end + 2]) if end >= 0 else None
                row = {"file": file, "split": split, "inside": inside, "n": len(fragment) + len(MAGIC), "fragment": fragment}
                if m:
                    body = fragment[end + 4 : end + 4 + int(m[1])]
                    row |= {"head": end + 4, "length": int(m[1]), "header": fragment[: end + 2].decode("utf-8", "replace"), "got": len(body), "digest": hashlib.sha1(body).hexdigest()}
                inside += row["n"]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_FRAGMENT if whole else _FRAGMENT_META)

    schema = "file string, split long, inside long, n long, head long, length long, header string, got long, digest string"
    return lines.mapInArrow(run, schema + ", fragment binary" * whole)


_LENGTH = re.compile(rb"(?i)(?:^|\n)Content-Length: *([0-9]{1,18}) *\r")
_FRAGMENT_META = pa.schema(
    [("file", pa.string()), *((n, pa.int64()) for n in ("split", "inside", "n", "head", "length")), ("header", pa.string()), ("got", pa.int64()), ("digest", pa.string())]
)
_FRAGMENT = _FRAGMENT_META.append(pa.field("fragment", pa.binary()))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """What fragments() tells of each fragment, with start (the offset of its magic) and next (its successor's, null if it is no record)."""
    rows = cut(fragments(spark, path, whole=False))
    splits = rows.groupBy("file", "split").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "split", F.coalesce(before, F.lit(0)).alias("before"))
    rows = rows.join(splits, ["file", "split"]).withColumn("start", F.col("before") + F.col("inside") - len(MAGIC)).where("start >= 0")
    return rows.withColumn("next", F.col("start") + len(MAGIC) + F.col("head") + F.col("length") + len(CLOSE))


def _exits(group: pa.Table) -> pa.Table:
    """Where the chain from each candidate of a split leaves the split: pointers jumped from the last candidate back."""
    start, after = (group.column(c).to_pylist() for c in ("start", "next"))
    leaves: dict[int, int] = {}
    for i in sorted(range(len(start)), key=lambda i: -start[i]):
        if after[i] is not None:
            leaves[start[i]] = leaves.get(after[i], after[i])
    return pa.table({"file": pa.array(group.column("file").to_pylist()[:1] * len(leaves), pa.string()), "start": pa.array(leaves, pa.int64()), "next": pa.array(leaves.values(), pa.int64())})


def _on_chain(group: pa.Table) -> pa.Table:
    """The candidates of a split that the chain from its entered one meets."""
    after = dict(zip(group.column("start").to_pylist(), group.column("next").to_pylist(), strict=True))
    met = []
    for at, entered in zip(group.column("start").to_pylist(), group.column("entered").to_pylist(), strict=True):
        while entered and at in after:
            met.append(at)
            at = after.pop(at)
    return pa.table({"file": pa.array(group.column("file").to_pylist()[:1] * len(met), pa.string()), "start": pa.array(met, pa.int64())})


def reached(pointers: DataFrame) -> DataFrame:
    """The (file, start) of the records on each file's chain from offset 0; pointers: file, split, start, next.

    Inside a split (of bounded size) a task jumps each candidate's pointer to where its chain leaves the
    split. From there pointers double in joins until the chain's entry into each split is known, then
    each split follows its chain.
    """
    pointers = pointers.select("file", "split", "start", "next")
    known = cut(pointers.where("start = 0").select("file", "start"))
    jump = cut(pointers.groupBy("file", "split").applyInArrow(_exits, "file string, start long, next long"))
    places = pointers.select("file", "start")
    while True:
        hop = known.join(jump, ["file", "start"]).select("file", F.col("next").alias("start"))
        more = cut(hop.join(places, ["file", "start"], "left_semi"))
        if not more.limit(1).count():
            break
        known = cut(known.unionByName(more))
        then = jump.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        jump = cut(jump.join(then, ["file", "next"]).select("file", "start", F.col("far").alias("next")))
    entered = pointers.join(known.withColumn("entered", F.lit(True)), ["file", "start"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    return entered.groupBy("file", "split").applyInArrow(_on_chain, "file string, start long")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """header, payload_bytes and payload_digest (SHA-1, hex) of each record of the files in path; payloads: the payload too."""
    rows = cut(candidates(spark, path))
    real = reached(rows).withColumn("real", F.lit(True))
    marked = rows.join(real, ["file", "start"], "left")
    # a fragment's owner is the last record before it: in its split, else the last one of the splits before, so no file is one task's work
    last = marked.where("real").groupBy("file", "split").agg(F.max("start").alias("last"))
    every = marked.select("file", "split").distinct().join(last, ["file", "split"], "left")
    ahead = F.max("last").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))  # a row for each split
    marked = marked.join(every.select("file", "split", ahead.alias("ahead")), ["file", "split"])
    inside = F.max(F.when(F.col("real"), F.col("start"))).over(Window.partitionBy("file", "split").orderBy("start"))
    owner = F.coalesce(inside, F.col("ahead"))
    # a record with magic in its payload lies in several fragments; the first one tells its owner's length
    first = marked.where("real")
    plain = first.where("got = length")
    parted = first.where("got < length").select("file", F.col("start").alias("owner"), F.col("head"), F.col("length"), "header")
    keys = marked.select("file", "split", "inside", "start", owner.alias("owner")).join(parted, ["file", "owner"])
    if payloads:
        keys = keys.unionByName(plain.select("file", "split", "inside", "start", F.col("start").alias("owner"), "head", "length", "header"))
    elif not parted.limit(1).count():
        return plain.select("header", F.col("got").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    text = fragments(spark, path, whole=True).select("file", "split", "inside", "fragment")
    parts = text.join(keys, ["file", "split", "inside"])
    # one record's fragments: as large as its payload, which is one value of the result
    own = parts.groupBy("file", "owner", "head", "length", "header").agg(F.sort_array(F.collect_list(F.struct("start", "fragment"))).alias("parts"))
    magic, none = F.lit(MAGIC).cast("binary"), F.lit("").cast("binary")
    bytes_ = F.aggregate("parts", none, lambda acc, p: F.concat(acc, F.when(p["start"] > F.col("owner"), magic).otherwise(none), p["fragment"]))
    own = own.select("header", F.substring(bytes_, (F.col("head") + 1).cast("int"), F.col("length").cast("int")).alias("payload"))
    own = own.select("header", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "payload")
    if payloads:
        return own
    return plain.select("header", F.col("got").alias("payload_bytes"), F.col("digest").alias("payload_digest")).unionByName(own.drop("payload"))


def field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?i)(?:^|\n){name}: *([^\r\n]*)\r", 1)


def page_records(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of read records."""
    again = F.col("record_type") == "revisit"
    page = lambda value: F.regexp_extract(value, r"<urn:page:(-?[0-9]+)>", 1)
    number = lambda value: F.when(value != "", value).cast("long")
    return (
        read.withColumn("record_type", field("WARC-Type"))
        .withColumn("refers_to", F.when(again, number(page(field("WARC-Refers-To")))))
        .select(
            number(page(field("WARC-Record-ID"))).alias("page_id"),
            F.when(again, number(field("X-Payload-Length"))).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
            F.when(again, F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1)).otherwise(F.col("payload_digest")).alias("payload_digest"),
            "record_type",
            "refers_to",
            decoded(field("WARC-Target-URI")).alias("url"),
        )
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return page_records(read_warc(spark, path, payloads=False))

"""Chat formatting over reply trees.

``best_paths`` takes messages with parents and enumerates root-to-leaf paths by iterative
self-joins on jump pointers: after k joins a node knows its 2^k-th ancestor and the scores on the
way, so a path of n turns takes log2 n joins. Leaves of a tree are ranked by their path's mean
score; the best paths, one or more, are read off the same pointers. Joins carry ids only, texts join once.
``format_chats`` writes each path as one string with a template that marks turns and a loss mask
of code-point spans; ``read_chats`` reads both back.

Escaping: in a role or text each ``<``, backslashes, ``|`` gains one backslash before the bar, so
none holds a control string; in roles a newline becomes ``<n`` and ``<``, backslashes, ``n`` gains
a backslash. Unescaping is the exact inverse for every string.

Defined cases: null role or text counts as empty; a null conversation id is an id of its own; a
null turn comes first; rows of equal turn follow by role, then text; repeated rows are turns of
their own; a text of any length is one turn; an empty table gives no conversation. A message whose parent is missing is a root;
messages whose parents form a cycle reach no root and give no path. In the query conversation -1 is added, and rows that bear
that id already are turns of it too. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = f"{END}{START}assistant ok"
LEARNT = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"<(\\*)n", r"<\1\\n", escape(role)).replace("\n", "<n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"<(\\*)\\n", r"<\1n", role.replace("<n", "\n")))


def best_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree_id, rank, msg_id, depth) of the messages on each tree's best root-to-leaf paths; rank from 1 up to top, root depth 0.

    messages: tree_id, msg_id (unique), parent_id, score. A better path has the larger mean score
    (null score: 0), then the more turns, then the smaller leaf.
    """
    n = messages.count()  # no frame here has more rows, so few files hold each
    ids = messages.select(F.col("msg_id").alias("up"))
    start = messages.join(ids, F.col("parent_id") == F.col("up"), "left")
    jumps = [cut(start.select("tree_id", "msg_id", F.col("up").alias("anc"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("steps")), n)]
    rounds = max(1, n).bit_length()  # a path is no longer than the table
    while len(jumps) <= rounds and jumps[-1].where("anc IS NOT NULL").limit(1).count():
        last = jumps[-1]
        up = last.select(F.col("msg_id").alias("a"), F.col("anc").alias("a_anc"), F.col("total").alias("a_total"), F.col("steps").alias("a_steps"))
        far = last.where("anc IS NOT NULL").join(up, F.col("anc") == F.col("a")).select(
            "tree_id", "msg_id", F.col("a_anc").alias("anc"), (F.col("total") + F.col("a_total")).alias("total"), (F.col("steps") + F.col("a_steps")).alias("steps")
        )
        jumps.append(cut(far.unionByName(last.where("anc IS NULL")), n))
    done = jumps[-1].where("anc IS NULL")
    inner = messages.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("msg_id")).distinct()
    leaves = done.join(inner, "msg_id", "left_anti")
    mean = F.col("total") / F.col("steps")
    if top == 1:  # an aggregate: a tree with most of the leaves is combined before the shuffle
        best = F.max_by("msg_id", F.struct(mean.alias("mean"), F.col("steps"), (-F.col("msg_id")).alias("first")))
        path = leaves.groupBy("tree_id").agg(best.alias("msg_id")).select(F.lit(1).alias("rank"), "msg_id")
    else:  # Spark keeps top rows of each tree before the shuffle
        order = Window.partitionBy("tree_id").orderBy(mean.desc(), F.desc("steps"), "msg_id")
        path = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("rank", "msg_id")
    for jump in jumps[:-1]:  # each distance up the path is one sum of powers of two, so no node comes twice in a path
        path = cut(path, n * top)
        path = path.unionByName(path.join(jump.where("anc IS NOT NULL").select("msg_id", "anc"), "msg_id").select("rank", F.col("anc").alias("msg_id")))
    return path.join(done, "msg_id").select("tree_id", "rank", "msg_id", (F.col("steps") - 1).alias("depth"))


def chain(conversations: DataFrame) -> DataFrame:
    """Conversation rows as messages: each turn answers the turn before it."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("msg_id", F.monotonically_increasing_id())
    order = Window.partitionBy("tree_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "msg_id")
    # cut once, after the window: ids stay what they are, and what reads them later sorts no texts again
    return cut(rows.withColumn("parent_id", F.lag("msg_id").over(order)).withColumn("score", F.lit(0.0)))


def format_chats(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree_id, rank, formatted, loss_mask) of each tree's best paths, each a conversation of its own; messages as in best_paths, with role and text."""
    turns = best_paths(messages, top).join(messages.select("msg_id", "role", "text"), "msg_id")
    whole = turns.groupBy("tree_id", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, rank, own in zip(batch.column("tree_id"), batch.column("rank"), batch.column("turns"), strict=True):
                out, mask, at = [], [], 0
                for turn in own.as_py():
                    head, body = f"{START}{escape_role(turn['role'] or '')}\n", escape(turn["text"] or "")
                    if turn["role"] == LEARNT:
                        mask.append({"start": at + len(head), "length": len(body)})
                    out.append(f"{head}{body}{END}\n")
                    at += len(out[-1])
                yield pa.RecordBatch.from_pylist([{"tree_id": tree.as_py(), "rank": rank.as_py(), "formatted": "".join(out), "loss_mask": mask}], schema=_FORMATTED)

    return whole.mapInArrow(run, "tree_id long, rank int, formatted string, loss_mask array<struct<start:long,length:long>>")


_FORMATTED = pa.schema([("tree_id", pa.int64()), ("rank", pa.int32()), ("formatted", pa.string()), ("loss_mask", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, rest = part.partition("\n")
        turns.append((unescape_role(role), unescape(rest[: rest.rindex(END)])))
    return turns


def read_chats(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, read back from the formatted strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, text, mask in zip(*(batch.column(c).to_pylist() for c in ("tree_id", "formatted", "loss_mask")), strict=True):
                turns = parse_chat(text)
                learnt = "".join(unescape(text[m["start"] : m["start"] + m["length"]]) for m in mask)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((tree, len(turns), _sha(whole), len(learnt), _sha(learnt), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _READ.types, strict=True)], schema=_READ)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_READ = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, LEARNT, CONTROL)], "conv_id long, turn long, role string, text string")
    return read_chats(format_chats(chain(rows.unionByName(extra))))

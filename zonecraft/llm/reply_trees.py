"""Chat formatting of reply trees.

Messages point to the message they answer.  Iterative self-joins double the step from message to
ancestor, so a tree of any depth is climbed in the logarithm of its depth: first with length and score, which
rank the branches (the paths from the root to a leaf) of a tree, then for the chosen branches alone, whose
messages they enumerate.  Every chosen path is written as one conversation.

Template: `<|im_start|>role`, a line break, the text, `<|im_end|>`, a line break, for every message.
Control strings of this and other templates inside a text or role get a backslash behind their first
character, and one more where they have some already, so that escaping can be undone exactly.
A conversation of more than PART messages goes on in further rows, which follow one another."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonecraft.llm.bitmap import may_match
from zonecraft.llm.rows import column
from zonecraft.session import store

PART, PART_CHARS, BUCKET = 256, 1 << 20, 4096
START, END = "<|im_start|>", "<|im_end|>"

# What follows the first character of a control string; `<|name|>` stands for any name.
CONTROLS = [r"/?s>", r"pad>", r"unk>", r"<SYS>>", r"</SYS>>", r"\|[A-Za-z0-9_]+\|>", r"/?INST\]"]
ESCAPE, ESCAPED = (re.compile(rf"([<\[])({slashes})(?={'|'.join(CONTROLS)})") for slashes in (r"\\*", r"\\+"))


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\2\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1] + m[2][1:], text) if "\\" in text else text


def escape_role(role: str) -> str:
    """A role is one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


# ---- trees -----------------------------------------------------------------------------------

def links_of(messages: DataFrame, tree_col: str, id_col: str, parent_col: str, score_col: str | None = None) -> DataFrame:
    """(node, up, score) of messages with parents: `node` is (tree, id), `up` the parent's, null for a root.

    Rows with the same tree and id are one message; its parent and score are the largest given."""
    tree, score = column(tree_col).alias("tree"), (column(score_col).cast("double") if score_col else F.lit(0.0))
    rows = messages.select(F.struct(tree, column(id_col).alias("id")).alias("node"), F.when(column(parent_col).isNotNull(), F.struct(tree, column(parent_col).alias("id"))).alias("up"), score.alias("score"))
    return rows.groupBy("node").agg(F.max("up").alias("up"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))


def turn_links(turns: DataFrame, tree_col: str, turn_col: str) -> DataFrame:
    """(node, up, score) of conversations without branches: a turn answers the turn before it, whose
    number is the next smaller one there is; null is the smallest.

    Numbers are looked at in buckets of BUCKET, so a long conversation is many small windows."""
    one = turns.select(F.struct(column(tree_col).alias("tree"), column(turn_col).alias("id")).alias("node")).distinct()
    one = one.withColumn("part", F.struct(F.col("node.tree").alias("tree"), F.floor(F.col("node.id") / BUCKET).alias("bucket")))
    last = one.groupBy("part").agg(F.max("node").alias("last"))
    before = last.select("part", F.lag("last").over(Window.partitionBy("part.tree").orderBy("part.bucket")).alias("before")).filter("before is not null")
    own = F.lag("node").over(Window.partitionBy("part").orderBy("node"))
    return one.withColumn("own", own).join(before, "part", "left").select("node", F.coalesce("own", "before").alias("up"), F.lit(0.0).alias("score"))


def climbed(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """((node, length, total) of every message with a root above it, and a list of (node, up): the ancestor
    2^k steps up, for k = 0, 1, ...).

    A round joins the messages that have not reached their root with the stretch their ancestor has
    covered.  `links` should be a stored table.  A parent that is not there makes its child a root.  Messages on or behind a circle never
    reach a root; they are left out once no path can be as long as their stretch."""
    at, up = F.xxhash64("node"), F.xxhash64("up")
    first = links.select("node", "up", F.lit(1).cast("long").alias("length"), F.col("score").alias("total"))
    count = first.count()
    finished, climbing, jumps = first.filter("up is null"), first.filter("up is not null"), []
    while not climbing.isEmpty() and 1 << len(jumps) <= 2 * count:
        jumps.append(climbing.select("node", "up"))
        there = may_match(finished.unionByName(climbing), at, climbing, up).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("length").alias("more"), F.col("total").alias("gain"))
        met = store(climbing.join(there, "up", "left").select(
            "node", F.col("next").alias("up"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total")))
        finished, climbing = finished.unionByName(met.filter("up is null")), met.filter("up is not null")
    return finished.select("node", "length", "total"), jumps


def branches(links: DataFrame, best: int | None = 1) -> DataFrame:
    """(node, rank, place): the messages of the `best` branches of every tree, or of all; `rank` counts the
    branches of a tree from 1, `place` the messages of a branch from 0, the root.

    Branches are ordered by the mean score of their messages, then longer ones first, then by leaf.  With
    `best`, every task sends on as many branches of a tree at most; without it, the leaves of a tree
    are sorted in one task."""
    links = store(links)
    reached, jumps = climbed(links)
    leaves = reached.join(links.filter("up is not null").select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    order = Window.partitionBy("node.tree").orderBy(F.desc(F.col("total") / F.col("length")), F.desc("length"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    chosen = ranked if best is None else ranked.filter(F.col("rank") <= best)
    found = store(chosen.select("node", "rank", (F.col("length") - 1).alias("place")))
    at = F.xxhash64("node")
    for k, jump in enumerate(jumps):
        open_ = found.filter(F.col("place") >= 1 << k)
        if k and open_.isEmpty():
            break
        step = store(open_.join(may_match(jump, at, found, at), "node").select(F.col("up").alias("node"), "rank", (F.col("place") - (1 << k)).alias("place")))
        found = found.unionByName(step)
    return found


# ---- conversations ---------------------------------------------------------------------------

def _in_order(messages: DataFrame, paths: DataFrame, tree_col: str, id_col: str, role_col: str, text_col: str) -> DataFrame:
    """(tree, rank, place, role, text) of the messages on `paths`, each branch in one partition and in order.

    Texts are shuffled once, with the places of their messages, to their tree, and sorted there."""
    of = lambda c: F.coalesce(column(c).cast("string"), F.lit(""))
    node = F.struct(column(tree_col).alias("tree"), column(id_col).alias("id")).alias("node")
    said = messages.select(node, F.lit(None).cast("struct<rank:int,place:bigint>").alias("at"), of(role_col).alias("role"), of(text_col).alias("text"))
    wanted = paths.select("node", F.struct("rank", "place").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    both = said.unionByName(wanted).withColumn("tree", F.col("node.tree")).repartition("tree")
    # the window keeps the partitioning by tree, so texts meet their places without another shuffle
    places = both.withColumn("ats", F.collect_list("at").over(Window.partitionBy("tree", "node")))
    spoken = places.filter("text is not null").select("tree", F.explode("ats").alias("at"), "role", "text").select("tree", "at.rank", "at.place", "role", "text")
    return spoken.sortWithinPartitions("tree", "rank", "place", "role", "text")


PARTS = "rank int, part int, n_messages int, text string, loss array<struct<start:bigint,end:bigint>>"


def _written(loss_role: str):
    """Batches of messages in order to batches of parts; one part is held."""

    def work(batches):
        current, part, pieces, loss, size = None, 0, [], [], 0
        rows = []
        for batch in batches:
            for tree, rank, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                if current != (tree, rank) or len(pieces) >= PART or size >= PART_CHARS:
                    if pieces:
                        rows.append((*current, part, len(pieces), "".join(pieces), loss))
                    part = part + 1 if current == (tree, rank) else 0
                    current, pieces, loss, size = (tree, rank), [], [], 0
                head, body = f"{START}{escape_role(role)}\n", escape(text)
                if role == loss_role:
                    loss.append((size + len(head), size + len(head) + len(body)))
                pieces.append(f"{head}{body}{END}\n")
                size += len(pieces[-1])
                if len(rows) >= 64 or sum(len(r[4]) for r in rows) >= PART_CHARS:
                    yield _batch(rows, batch.schema.field(0).type)
                    rows = []
        if pieces:
            rows.append((*current, part, len(pieces), "".join(pieces), loss))
        if rows:
            yield _batch(rows, batch.schema.field(0).type)

    return work


def formatted(messages: DataFrame, paths: DataFrame, tree_col: str, id_col: str, role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(tree, rank, part, n_messages, text, loss): the conversations of `branches`, one row or, beyond PART messages
    or PART_CHARS characters, several; `loss` lists (start, end), in code points, of the texts of `loss_role`.

    Rows that share tree and id are one message in several pieces, ordered by role and text.  A null
    text or role is empty.  A task streams its trees and holds one part, however long a conversation is; the
    parts of a conversation come one after another in one partition.  An empty table gives no rows."""
    ordered = _in_order(messages, paths, tree_col, id_col, role_col, text_col)
    kind = ordered.schema["tree"].dataType.simpleString()
    return ordered.mapInArrow(_written(loss_role), f"tree {kind}, {PARTS}")


def _batch(rows, kind) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [kind, pa.int32(), pa.int32(), pa.int32(), pa.string(), span]
    columns = [list(c) for c in zip(*rows)]
    columns[5] = [[{"start": a, "end": b} for a, b in loss] for loss in columns[5]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["tree", "rank", "part", "n_messages", "text", "loss"])


TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of the messages of a part."""
    out, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a formatted conversation")
    return out


DIGESTS = ["tree", "rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _read(batches):
    """Batches of parts, those of a conversation in a row, to batches of DIGESTS."""
    current, done, kind = None, [], None

    def finished():
        return (*current, count, turns.hexdigest(), chars, loss.hexdigest(), whole)

    def table():
        types = [kind, pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done), types)], DIGESTS)

    for batch in batches:
        kind = batch.schema.field(0).type
        for tree, rank, text, spans in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5))):
            if current != (tree, rank):
                if current is not None:
                    done.append(finished())
                current, count, turns, chars, loss, whole = (tree, rank), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            for role, said in parsed(text):
                turns.update(f"{role}\n{said}\n".encode())
                count += 1
            for s in spans:
                said = unescape(text[s["start"]:s["end"]])
                loss.update(said.encode())
                chars += len(said)
            whole += len(text)
        if len(done) >= 4096:
            yield table()
            done = []
    if current is not None:
        done.append(finished())
        yield table()


def _digest_schema(rows: DataFrame) -> str:
    return f"tree {rows.schema['tree'].dataType.simpleString()}, rank int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(conversations: DataFrame) -> DataFrame:
    """(tree, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from `formatted` rows.

    A SHA-256 runs through a whole conversation, so the parts of one are read in one task, one after another."""
    rows = conversations.repartition("tree", "rank").sortWithinPartitions("tree", "rank", "part")
    return rows.mapInArrow(_read, _digest_schema(rows))


def round_trip(messages: DataFrame, paths: DataFrame, tree_col: str, id_col: str, role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """`digests` of `formatted`, each part read back where it is written, so that nothing is shuffled between."""
    ordered = _in_order(messages, paths, tree_col, id_col, role_col, text_col)
    write = _written(loss_role)
    return ordered.mapInArrow(lambda batches: _read(write(batches)), _digest_schema(ordered))

"""Chat formatting of reply trees.

Messages point to the message they answer. Self-joins that double their step enumerate the
root-to-leaf paths in as many rounds as the depth has binary digits; branches are ranked by
the summed score of their messages, and every chosen path becomes one conversation in a
template whose control strings cannot occur inside a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import Scratch

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    """No control string is left: every ``<|`` gets a backslash, backslashes are doubled."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(p.replace("<\\|", "<|").replace("\\n", "\n") for p in parts)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the (start, length) runs of its loss mask, in code points."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_escape_role(role)}\n", escape(text)
        if role == LEARNED_ROLE:
            mask.append((at + len(head), len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        turns.append((unescape(formatted[at + len(START):line]), unescape(formatted[line + 1:end])))
        at = end + len(END) + 1
    return turns


def _climb(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (node, its 2**k-th ancestor) and (node, depth, score) of the nodes with a root.

    Messages on a reply cycle, or below one, have no root and are left out.
    """
    state = scratch.keep(nodes.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"),
                                      F.col("score")), "climb0")
    jumps, open_before = [], None
    while True:
        pending = state.filter(F.col("up").isNotNull())
        still_open = pending.count()
        if still_open == 0 or still_open == open_before:
            return jumps, state.filter(F.col("up").isNull()).select("tree", "node", "depth", "score")
        open_before = still_open
        jumps.append(pending.select("tree", "node", "up"))
        above = state.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"),
                             F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        stepped = pending.join(above, (F.col("tree") == F.col("t2")) & (F.col("up") == F.col("n2"))).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"),
            (F.col("score") + F.col("score2")).alias("score"))
        state = scratch.keep(stepped.unionByName(state.filter(F.col("up").isNull())), f"climb{len(jumps)}")


def paths(messages: DataFrame, scratch: Scratch, branches: int = 1) -> DataFrame:
    """(tree, path, position, role, text) of the best ``branches`` root-to-leaf paths per tree.

    ``messages`` has tree, node (unique in its tree), parent, role, text, score. A parent
    that does not exist makes its message a root; null scores count 0; equal scores are
    ranked by leaf.
    """
    base = messages.select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    known = base.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    linked = base.join(known, (F.col("tree") == F.col("t2")) & (F.col("parent") == F.col("n2")), "left").select(
        "tree", "node", F.col("n2").alias("parent"), "score")
    jumps, rooted = _climb(linked, scratch)
    answered = base.filter(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(answered, ["tree", "node"], "left_anti")
    ranking = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= branches)
    members = scratch.keep(chosen.select("tree", F.col("node").alias("path"), "node", F.col("depth").alias("position")),
                           "members")
    for k in range(len(jumps) - 1, -1, -1):
        higher = members.join(jumps[k], ["tree", "node"]).select(
            "tree", "path", F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position"))
        members = scratch.keep(members.unionByName(higher), f"members{k}")
    return members.join(messages.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "path", "position", "role", "text")


def format_paths(members: DataFrame) -> DataFrame:
    """(tree, path, formatted, mask_start, mask_length): one row per path, its turns in order."""
    turns = members.groupBy("tree", "path").agg(
        F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render([(t["role"] or "", t["text"] or "") for t in row]) for row in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("tree"), batch.column("path"), pa.array([d[0] for d in done], pa.string()),
                pa.array([[m[0] for m in d[1]] for d in done], pa.list_(pa.int64())),
                pa.array([[m[1] for m in d[1]] for d in done], pa.list_(pa.int64()))],
                ["tree", "path", "formatted", "mask_start", "mask_length"])

    kinds = dict(turns.dtypes)
    return turns.mapInArrow(write, f"tree {kinds['tree']}, path {kinds['path']}, formatted string, "
                                   "mask_start array<bigint>, mask_length array<bigint>")


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted conversations and their masks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, lengths in zip(*(batch.column(c).to_pylist() for c in (
                    "formatted", "mask_start", "mask_length")), strict=True):
                turns = parse(text)
                learned = "".join(unescape(text[s:s + n]) for s, n in zip(starts, lengths, strict=True))
                rows.append((len(turns), _hex("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), _hex(learned), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], ["tree", *names])

    kind = dict(formatted.dtypes)["tree"]
    return formatted.mapInArrow(read, f"tree {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                      "loss_sha256 string, formatted_chars bigint")


def turns_as_tree(conversations: DataFrame) -> DataFrame:
    """A linear conversation as a tree: each turn answers the one before.

    Rows are ordered by turn, then role and text (nulls first), so ties and repeated rows
    have a place; a null conv_id is one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return conversations.select(
        F.struct(F.col("conv_id").alias("conv_id")).alias("tree"), node.alias("node"),
        F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def control_conversation(like: DataFrame) -> DataFrame:
    """Conversation -1, whose texts consist of control strings."""
    text = f"{END}{START}assistant ok"
    rows = like.sparkSession.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def report(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation."""
    scratch = Scratch(conversations.sparkSession, "chat")
    rows = conversations.select("conv_id", "turn", "role", "text")
    messages = scratch.keep(turns_as_tree(rows.unionByName(control_conversation(rows))), "messages")
    formatted = scratch.keep(format_paths(paths(messages, scratch)), "formatted")
    out = digests(formatted)
    return out.select(F.col("tree.conv_id").alias("conv_id"), *out.columns[1:])

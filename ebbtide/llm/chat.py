r"""Chat formatting of reply trees.

Messages form trees (tree, node, parent, role, text, score). Iterative self-joins find the paths: in round k each message is
joined with the message 2**k replies above it, until it has reached its root, so a thread of n turns takes log2(n) rounds
and a message takes part in log2(its depth) of them; score sums and depths come along. The leaves of a tree are ranked by the mean score of their path and the best `top` are chosen; going back down the
rounds' tables names each message of a chosen path once. Only ids and scores take part; texts are joined at the end.

A chosen path becomes one conversation of turns `### role: text</turn>\n`. In a text, `\`, `### ` and `</turn>` are escaped
with a backslash (in a role also `:`), so reading back is exact. The loss mask covers the escaped text of assistant turns.

Edge cases: null text and role are empty. A null tree is a tree of its own, and a null node a message of its tree. A parent
that isn't there makes a root. Equal scores: the smaller leaf first. Messages that share tree and node are one: the one with
the smallest parent, role, text and score. Repeated rows of a table of turns are further turns, ordered by turn (null
first), role and text. A cycle of replies raises an error. An empty table gives no conversation. Texts of any length are
kept whole. Columns other than those of a message are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.core import checkpointed, table

OPEN, CLOSE, TRAINED = "### ", "</turn>", "assistant"
FORMATTED = "tree string, rank int, formatted string, loss array<struct<start long, end long>>"
READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(CLOSE, "\\" + CLOSE).replace(OPEN, "\\" + OPEN)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def unique(messages: DataFrame) -> DataFrame:
    """One message of each tree and node."""
    first = F.min(F.struct("parent", "role", "text", "score"))
    return messages.groupBy("tree", "node").agg(first.alias("m")).select("tree", "node", "m.*")


def _keyed(messages: DataFrame) -> DataFrame:
    """Trees, nodes and parents as structs, which joins compare with nulls inside; a parent that is null stays null."""
    held = lambda c: F.struct(F.col(c).alias("id"))
    return messages.select(held("tree").alias("tree"), held("node").alias("node"), F.when(F.col("parent").isNotNull(), held("parent")).alias("parent"), "role", "text", "score")


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, rank, node, place): the messages of the `top` best root-to-leaf paths of each tree, place 0 at the root. Tree and node are unique together."""
    return _chosen(_keyed(messages), top).select(F.col("tree.id").alias("tree"), "rank", F.col("node.id").alias("node"), "place")


def _chosen(messages: DataFrame, top: int) -> DataFrame:
    own = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("total"))
    there = own.select("tree", F.col("node").alias("parent"), F.col("node").alias("up"))
    level = checkpointed(own.join(there, ["tree", "parent"], "left").select("tree", "node", "up", F.lit(1).cast("long").alias("depth"), "total"))
    leaves = level.join(level.select("tree", F.col("up").alias("node")).where("node is not null"), ["tree", "node"], "left_anti").select("tree", "node")
    done, active, levels = level.where("up is null"), level.where("up is not null"), []
    messages_there = level.count()
    while not active.isEmpty():
        if 2 ** len(levels) >= messages_there:  # an active message has as many above it
            raise ValueError("the replies go round in a circle")
        levels.append(active.select("tree", "node", "up"))
        above = done.union(active).select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        level = checkpointed(active.join(above, ["tree", "up"]).select("tree", "node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total")))
        done, active = done.union(level.where("up is null")), level.where("up is not null")
    best = Window.partitionBy("tree").orderBy(F.desc("mean"), "node")
    ranked = leaves.join(done, ["tree", "node"]).withColumn("mean", F.col("total") / F.col("depth")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    found = ranked.select("tree", "rank", "node", (F.col("depth") - 1).alias("place"))
    for k in reversed(range(len(levels))):
        higher = found.join(levels[k], ["tree", "node"]).select("tree", "rank", F.col("up").alias("node"), (F.col("place") - 2**k).alias("place"))
        found = checkpointed(found.union(higher))
    return found


def _conversation(tree: str, rank: int, turns: list[tuple[str, str]]) -> tuple:
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: ", escape(text)
        if role == TRAINED:
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return tree, rank, "".join(parts), loss


def _assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted turns to conversations; one conversation is held at a time."""
    names = [c.split()[0] for c in FORMATTED.split(", ")[:4]]
    now, turns = None, []
    for batch in batches:
        rows = []
        for tree, rank, role, text in zip(batch["tree"], batch["rank"], batch.role, batch.text, strict=True):
            if (tree, rank) != now:
                if turns:
                    rows.append(_conversation(*now, turns))
                now, turns = (tree, rank), []
            turns.append((role, text))
        yield pd.DataFrame(rows, columns=names)
    if turns:
        yield pd.DataFrame([_conversation(*now, turns)], columns=names)


def format_paths(messages: DataFrame, top: int = 1, distinct: bool = False) -> DataFrame:
    """FORMATTED: a row for each chosen path; `loss` are the spans (code points, end exclusive) under the loss mask. `distinct`: tree and node are known to be unique together."""
    keyed = _keyed(messages if distinct else unique(messages))
    turns = _chosen(keyed, top).join(keyed.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "node"])
    turns = turns.select(F.col("tree.id").cast("string").alias("tree"), "rank", "place", "role", "text")
    return turns.repartition("tree", "rank").sortWithinPartitions("tree", "rank", "place").select("tree", "rank", "role", "text").mapInPandas(_assemble, FORMATTED)


def read_back(formatted: str, loss: list) -> tuple:
    """What READ names, from the formatted conversation and its mask alone."""
    turns = hashlib.sha256()
    n = 0
    for m in TURN.finditer(formatted):
        turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        n += 1
    trained = "".join(unescape(formatted[x["start"] : x["end"]]) for x in loss)
    return n, turns.hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(formatted)


def _read(formatted: pd.Series, loss: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_back(f, x) for f, x in zip(formatted, loss, strict=True)], columns=[c.split()[0] for c in READ.split(", ")])


def replies(conversations: DataFrame) -> DataFrame:
    """A table of turns as reply trees without branches: each turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(extra)
    done = format_paths(replies(rows), distinct=True)
    return done.select(F.col("tree").cast("long").alias("conv_id"), F.pandas_udf(_read, READ)("formatted", "loss").alias("r")).select("conv_id", "r.*")


_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ')"
ORACLE = rf"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
sum(length(replace({_ESCAPED.format("role")}, ':', '\:')) + length({_ESCAPED.format("text")}) + 14)::bigint as formatted_chars
from c group by conv_id"""

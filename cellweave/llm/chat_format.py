"""Chat formatting of reply trees.

Native: DataFrame expressions only.  Messages ``(conv_id, msg_id, parent_id, role, text, score)`` form a
forest per conversation.  Iterative self-joins enumerate the root-to-leaf paths, branches are ranked by
score, and each chosen path becomes one conversation in one string with a loss mask.

The self-joins double the pointers: after round k every message knows its ancestor 2^k steps up, its
depth and the score sum of the path to it, so a chain of 400 turns takes nine rounds, not 400, and no
path is stored until it is chosen.  The chosen paths are walked back through the kept jump tables, which
yields each path's messages once.  The number of rounds follows the largest conversation.

Template: ``<|im_start|>role`` line feed ``text<|im_end|>`` line feed.  A control string inside a text gets
one backslash after its first character, and one that already has n backslashes there gets n + 1;
``unescape`` takes one away, so the escape is reversible for every text and no control string is left
inside a text.  In a role ``%``, a line feed and ``<`` become ``%25``, ``%0A`` and ``%3C``.

Nulls: a null text or role is empty, a null score 0; rows of a null conv_id are one conversation; a
parent that is null or not there makes a root; a null msg_id is a message that none replies to.
Repeated msg_ids: the row of the highest score, then the first text and role, stays.  Messages in a
cycle have no root and appear in no path.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.storage import Scratch

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates, without their first character.
CONTROL = ["|im_start|>", "|im_end|>", "|endoftext|>", "|startoftext|>", "|system|>", "|user|>", "|assistant|>", "|end|>", "s>", "/s>", "INST]", "/INST]", "SYS>>", "/SYS>>"]
_REST = "|".join("\\Q" + c + "\\E" for c in CONTROL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(f"([<\\[])(\\\\*)({_REST})"), F.lit("$1\\\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(f"([<\\[])\\\\(\\\\*)({_REST})"), F.lit("$1$2$3"))


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chosen_paths(messages: DataFrame, scratch: Scratch, best: int = 1) -> DataFrame:
    """The ``best`` branches of each conversation: ``(conv_id, path, depth, role, text)``, a row a message.

    ``path`` is the rank of the branch by the sum of its scores (ties: longer, then smaller leaf id).
    """
    clean = messages.select(
        "conv_id", "msg_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    first = Window.partitionBy("conv_id", "msg_id").orderBy(F.desc("score"), "text", "role")
    ranked = clean.withColumn("__n", F.row_number().over(first)).where("__n = 1 or msg_id is null").drop("__n")
    nodes = scratch.write(ranked.withColumn("node", F.monotonically_increasing_id()), "nodes")
    thin = nodes.select("conv_id", "msg_id", "parent_id", "node", "score")
    up = thin.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), F.col("node").alias("up"))
    state = thin.join(up, F.expr("conv_id <=> c and parent_id = m and parent_id is not null"), "left").select(
        "conv_id", "msg_id", "node", "up", F.when(F.col("up").isNull(), 1).otherwise(0).alias("rooted"), F.lit(1).alias("len"), "score"
    )
    state = scratch.write(state, "jump")
    replies = state.where("up is not null").select(F.col("up").alias("node")).distinct()
    leaves = state.join(replies, "node", "left_anti").select("node")
    widest = thin.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps = [state]
    for _ in range(max(0, int(widest - 1).bit_length())):
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("rooted").alias("rooted2"), F.col("len").alias("len2"), F.col("score").alias("score2"))
        # only messages that have not reached their root yet are joined
        onward = state.where("up is not null").join(far, "up").select(
            "conv_id", "msg_id", "node", F.col("up2").alias("up"), F.col("rooted2").alias("rooted"), (F.col("len") + F.col("len2")).alias("len"), (F.col("score") + F.col("score2")).alias("score")
        )
        state = scratch.write(state.where("up is null").select(*onward.columns).union(onward), "jump")
        jumps.append(state)
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("len"), "msg_id", "node")
    ends = state.where("rooted = 1 and up is null").join(leaves, "node", "left_semi")
    ends = ends.withColumn("path", F.row_number().over(order)).where(F.col("path") <= best).select("node", "path", F.col("len").alias("depth"))
    walked = scratch.write(ends, "walk")
    for k in range(len(jumps) - 1, -1, -1):
        step = jumps[k].where("up is not null").select("node", "up")
        above = walked.join(step, "node").select(F.col("up").alias("node"), "path", (F.col("depth") - (1 << k)).alias("depth"))
        walked = scratch.write(walked.union(above), "walk")
    return walked.join(nodes.select("node", "conv_id", "role", "text"), "node").select("conv_id", "path", "depth", "role", "text")


def render(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """Chosen paths -> ``(conv_id, path, formatted, spans)``.

    ``spans`` are the ``(start, length)`` of the texts under the loss mask, in code points of ``formatted``.
    """
    turn = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END))
    text_at = F.length(F.lit(START)) + F.length(_escape_role(F.col("role"))) + 1
    rows = paths.select("conv_id", "path", F.struct("depth", turn.alias("turn"), text_at.alias("at"), (F.col("role") == learn).alias("learn")).alias("t"))
    told = rows.groupBy("conv_id", "path").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = told.withColumn("formatted", F.array_join("t.turn", ""))
    # one pass carries the running offset along the turns
    spans = F.expr(
        f"""aggregate(t, named_struct('at', 0, 'out', cast(array() as array<struct<start:int,length:int>>)),
        (s, x) -> named_struct('at', s.at + length(x.turn), 'out', if(x.learn,
            array_append(s.out, named_struct('start', s.at + x.at, 'length', length(x.turn) - x.at - {len(END)})), s.out)), s -> s.out)"""
    )
    return whole.select("conv_id", "path", "formatted", spans.alias("spans"))


def _head(part: Column) -> Column:
    return F.length(F.substring_index(part, "\n", 1))


def read_back(formatted: DataFrame) -> DataFrame:
    """Formatted conversations -> the same rows with ``turns``, an array of (role, text) parsed from the string alone, and ``loss_text``."""
    parts = F.expr(f"slice(split(formatted, '\\\\Q{START}\\\\E'), 2, 1000000000)")
    turns = F.transform(
        parts,
        lambda p: F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, _head(p) + 2, F.length(p) - _head(p) - 1 - len(END))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)


def turns_as_tree(turns: DataFrame) -> DataFrame:
    """A table of turns (``conv_id, turn, role, text``) as a reply tree in which each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "turn", "role", "text").withColumn("msg_id", F.row_number().over(order))
    return numbered.select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def format_chats(messages: DataFrame, scratch: Scratch, best: int = 1) -> DataFrame:
    """Messages of reply trees -> one formatted conversation for each of the ``best`` branches."""
    return render(chosen_paths(messages, scratch, best))

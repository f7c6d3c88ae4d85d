"""Reply trees to conversations: paths by self-joins, branches ranked by score, a reversible chat template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mixolve.llm.common import drop_scratch, scratch

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """No control string survives: & and <| become &amp; and &lt;|."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def paths(links: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): for each leaf its ancestors and itself, `up` replies below them.

    links: (tree, node, parent). By doubling self-joins, so a thread of n replies takes log2(n)
    rounds; every round is written to the shared folder. A parent that isn't in its tree counts as
    none. Replies on or below a cycle have no root and get no path. Null trees are a tree, null
    nodes are left out.
    """
    nodes = links.where(F.col("node").isNotNull()).select("tree", "node", "parent").distinct()
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    at = lambda a, b: F.col("tree").eqNullSafe(F.col("t")) & (F.col(a) == F.col(b))
    jump = scratch(nodes.join(known, at("parent", "n")).select("tree", "node", F.col("parent").alias("to")).distinct(), "jump")
    parents = jump.select(F.col("tree").alias("t"), F.col("to").alias("n")).distinct()
    leaves = known.select(F.col("t").alias("tree"), F.col("n").alias("node")).join(parents, at("node", "n"), "left_anti")
    found = scratch(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    most, far = nodes.count(), 1
    while jump.limit(1).count():
        if far > most:  # only cycles go on for longer than there are replies
            endless = jump.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
            return found.join(endless, at("leaf", "n"), "left_anti")
        step = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        longer = found.join(step, at("node", "n")).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + far).alias("up"))
        grown = scratch(found.unionAll(longer), "paths")
        ahead = scratch(jump.select("tree", "node", F.col("to").alias("mid")).join(step, at("mid", "n")).select("tree", "node", "to"), "jump")
        drop_scratch(found)
        drop_scratch(jump)
        found, jump, far = grown, ahead, 2 * far
    return found


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Format the best paths of reply trees, each as one conversation.

    messages: tree, node, parent, role, text, score (null: 0). Paths are ranked by the sum of their
    scores, ties by the smaller leaf; `branches` keeps so many a tree (None: all). Returns tree,
    leaf, branch (rank from 1), score, formatted, and loss: for each assistant turn its number, the
    place of its text in `formatted` (start) and in its turn (inner), and length, in code points
    from 0. Null roles and texts are empty; rows that share a node are set one after the other by
    role and text. Other columns are ignored; an empty table gives none.
    """
    told = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    found = paths(told.select("tree", "node", "parent"))
    scores = told.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score")
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    ranks = found.join(scores, same).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    ranks = ranks.withColumn("branch", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranks = ranks.where(F.col("branch") <= branches)
    chosen = found.join(ranks.select(F.col("tree").alias("t"), F.col("leaf").alias("n"), F.col("score").alias("path_score"), "branch"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("n"))).drop("t", "n")
    turns = chosen.join(told.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text"), same)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("tree", "leaf", "branch", "path_score", "up", "role", F.length(head).alias("inner"), F.length(escape(F.col("text"))).alias("length"), F.concat(head, escape(F.col("text")), F.lit(END + "\n")).alias("turn"))
    order = W.partitionBy("tree", "leaf").orderBy(F.desc("up"), "role", "turn").rowsBetween(W.unboundedPreceding, 0)
    turns = turns.withColumn("number", F.row_number().over(order) - 1).withColumn("start", F.sum(F.length("turn")).over(order) - F.length("turn") + F.col("inner"))
    turn = F.struct("number", "turn", F.when(F.col("role") == "assistant", F.struct("number", "start", "inner", "length")).alias("loss"))
    told = turns.groupBy("tree", "leaf", "branch", "path_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["loss"].isNotNull()), lambda t: t["loss"])
    return told.select("tree", "leaf", "branch", F.col("path_score").alias("score"), F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), loss.alias("loss"))


def threads(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages for conversations() from a table of turns: each turn replies to the one before it (null turns first)."""
    turn = F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 63)))
    told = rows.select(F.col(conv_col).alias("tree"), turn.alias("node"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    places = told.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    places = places.withColumn("parent", F.lag("n").over(W.partitionBy("t").orderBy("n")))
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    return told.join(places, same).select("tree", "node", "parent", "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add turns (array of role, text) and loss_text, both parsed from `formatted` and `loss` alone."""
    parts = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    out = formatted.withColumn("_parts", parts)
    body = lambda p: F.substring(p, len(START) + 1, 1 << 30)
    role = lambda p: F.substring_index(body(p), "\n", 1)
    text = lambda p: F.substring(body(p), F.length(role(p)) + 2, F.lit(1 << 30))
    turns = F.transform("_parts", lambda p: F.struct(unescape_role(role(p)).alias("role"), unescape(text(p)).alias("text")))
    masked = F.transform("loss", lambda m: unescape(F.substring(F.element_at(F.col("_parts"), m["number"] + 1), m["inner"] + 1, m["length"])))
    return out.select("*", turns.alias("turns"), F.array_join(masked, "").alias("loss_text")).drop("_parts")

"""Chat formatting of reply trees.

Messages point to the message they reply to.  Root-to-leaf paths come from
iterative self-joins: ancestors 1, 2, 4, 8 ... steps up are joined from the
round before (with the summed score of the steps between), so a chain of n
messages takes log2(n) rounds, and the paths of the chosen leaves are filled in
by the same tables.  Branches of a tree are ranked by the sum of their
messages' scores (ties: the smaller leaf id), the best ``branches`` are kept,
and each path becomes one text with a loss mask over the assistant's turns.

Template: ``[INST] user [/INST]``, ``<<SYS>> system <</SYS>>``,
``<s> assistant </s>`` and ``[ROLE] role [TEXT] text [/ROLE]`` for any other
role, one turn a line.  A control string inside a text or role gets a
backslash in front (and so does a run of backslashes before one), which
``unescape`` takes off again.

DataFrame functions only.  Rounds move ids and scores, not texts; every round
is written to the shared checkpoint folder.  A tree with a third of all
messages is many rows of the joins; its branches are cut to the best few
before the shuffle (group limit).  One path is one string, hence one row.

Defined results: null texts and roles count as empty; a message whose parent
is missing or null is a root; messages that (through their parents) run into a
circle belong to no path; repeated (tree, node) rows are one message, the
smallest by role and text; rows without a node id are left out by
``reply_paths`` and never occur in ``linear_messages``.  Null tree ids are one
tree.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

CONTROL = r"(?:</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[TEXT\])"
TURNS = {"user": ("[INST] ", " [/INST]\n"), "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
         "assistant": ("<s> ", " </s>\n")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]\n")
TURN = (r"(?s)(?:\[INST\] |<<SYS>>\n|<s> |\[ROLE\] ).*?"
        r"(?: \[/INST\]\n|\n<</SYS>>\n| </s>\n| \[/ROLE\]\n)")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{CONTROL})", "$1")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Turns as a tree without branches: each replies to the one before it, by
    turn; rows of the same turn follow one another by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return conversations.select(
        F.col("conv_id").alias("tree"), node.alias("node"), (node - 1).alias("parent"), "role",
        "text", F.lit(1.0).alias("score"))


def reply_paths(spark: SparkSession, messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, depth, role, text, path_score`` of the chosen paths.

    ``messages`` has ``tree, node, parent, role, text, score``.
    """
    name = F.to_json(F.struct("tree"))                      # a key that is never null
    messages = materialize(
        spark, messages.where(F.col("node").isNotNull())
        .groupBy(name.alias("t"), "tree", "node")
        .agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text"),
                            F.col("parent"), F.coalesce("score", F.lit(0.0)).alias("score")))
             .alias("m")).select("t", "tree", "node", "m.*"), "messages")
    ids = messages.select("t", "node", "parent", "score")
    known = ids.select("t", F.col("node").alias("parent"), F.lit(True).alias("known"))
    # up: the ancestor 2**k steps above, null beyond the root; total and steps up to there
    step = (ids.join(known, ["t", "parent"], "left")
            .select("t", "node", F.when(F.col("known"), F.col("parent")).alias("up"),
                    F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")))
    steps, before = [], None
    while True:
        step = materialize(spark, step, "steps")
        steps.append(step)
        live = step.where(F.col("up").isNotNull()).count()
        if live == 0 or live == before:                     # unchanged: only circles are left
            break
        before = live
        above = step.select("t", F.col("node").alias("up"), F.col("up").alias("up2"),
                            F.col("total").alias("total2"), F.col("steps").alias("steps2"))
        # only messages that have not reached their root move on
        moved = step.where(F.col("up").isNotNull()).join(above, ["t", "up"]).select(
            "t", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"),
            (F.col("steps") + F.col("steps2")).alias("steps"))
        step = step.where(F.col("up").isNull()).unionByName(moved)
    whole = steps[-1].where(F.col("up").isNull())           # all scores up to the root
    parents = ids.select("t", F.col("parent").alias("node")).where(F.col("node").isNotNull())
    best = Window.partitionBy("t").orderBy(F.desc("total"), "node")
    leaves = (whole.join(parents, ["t", "node"], "left_anti")
              .withColumn("place", F.row_number().over(best)).where(F.col("place") <= branches))
    path = leaves.select("t", F.col("node").alias("leaf"), "node", F.col("total").alias("path_score"))
    for step in reversed(steps[:-1]):
        up = step.where(F.col("up").isNotNull()).select("t", "node", F.col("up"))
        path = materialize(spark, path.unionByName(
            path.join(up, ["t", "node"]).select("t", "leaf", F.col("up").alias("node"),
                                                "path_score")), "paths")
    depth = whole.select("t", "node", F.col("steps").alias("depth"))
    return (path.join(depth, ["t", "node"]).join(messages, ["t", "node"])
            .select("tree", "t", "leaf", "depth", "role", "text", "path_score"))


def format_paths(paths: DataFrame) -> DataFrame:
    """``tree, leaf, path_score, formatted, loss_spans``: one row per path.

    ``loss_spans`` (array of start, end) are the code point ranges of
    ``formatted`` that hold the assistant's texts.
    """
    role, text = F.col("role"), escape(F.col("text"))
    turn = None
    for name, (left, right) in TURNS.items():
        one = F.concat(F.lit(left), F.col("escaped"), F.lit(right))
        turn = F.when(role == name, one) if turn is None else turn.when(role == name, one)
    turn = turn.otherwise(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]),
                                   F.col("escaped"), F.lit(OTHER[2])))
    so_far = Window.partitionBy("t", "leaf").orderBy("depth") \
        .rowsBetween(Window.unboundedPreceding, -1)
    opening = F.lit(len(TURNS["assistant"][0]))
    rows = (paths.withColumn("escaped", text).withColumn("turn", turn)
            .withColumn("at", F.coalesce(F.sum(F.length("turn")).over(so_far), F.lit(0)) + opening)
            .withColumn("span", F.when(role == "assistant", F.struct(
                F.col("at").alias("start"),
                (F.col("at") + F.length("escaped")).alias("end")))))
    made = rows.groupBy("t", "leaf").agg(
        F.first("tree").alias("tree"), F.first("path_score").alias("path_score"),
        F.array_sort(F.collect_list(F.struct("depth", "turn", "span"))).alias("turns"))
    return made.select(
        "tree", "leaf", "path_score", F.array_join("turns.turn", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    def one(turn):
        def inner(left, right):
            return F.substring(turn, F.lit(len(left) + 1),
                               F.length(turn) - (len(left) + len(right)))
        out = None
        for name, (left, right) in TURNS.items():
            pair = F.struct(F.lit(name).alias("role"), unescape(inner(left, right)).alias("text"))
            out = F.when(turn.startswith(left), pair) if out is None \
                else out.when(turn.startswith(left), pair)
        held = inner(OTHER[0], OTHER[2])
        cut = F.instr(held, OTHER[1])
        return out.otherwise(F.struct(
            unescape(F.substring(held, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(held, cut + len(OTHER[1]), F.length(held))).alias("text")))
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """The assistant's texts under the loss mask, one after the other."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, (s["start"] + 1).cast("int"),
                    (s["end"] - s["start"]).cast("int")))), "")

"""Chat formatting of reply trees with DataFrame operations only.

A forest of messages (tree, message, parent) is turned into its root-to-leaf paths by iterative self-joins that double
their reach: after k joins each message knows its ancestor 2^k replies up, so a path of n messages takes about log2 n
joins. A jump also carries the scores of the messages it passes, so a leaf adds up its path in one row, and branches of a
tree are ranked, by the mean score of their messages, before any path is listed. From each chosen leaf the tables are
applied from the longest jump to the shortest, which yields every ancestor once, and its path becomes one string.

Template: each turn is ``<s>[INST] role [/INST]text</s>``. A control string inside a role or text (``<s>``, ``</s>``,
``[INST]``, ``[/INST]``) gets one backslash after its first character, as does one that already has backslashes
there; taking one away again restores the text exactly. ``loss_spans`` holds (begin, length), in code points, of each
trained text inside the string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import stored

ESCAPE = (r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)(/?(?:s>|INST\]))", "$1$2$3")
BEGIN, CLOSE, END = "<s>[INST] ", " [/INST]", "</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def single(messages: DataFrame, *columns: str) -> DataFrame:
    """One row of each (tree, message), without null ones: of those that repeat, the smallest by parent, score and then
    the other ``columns``, nulls first."""
    rest = ("parent", "score", *columns)
    rows = messages.where("tree is not null and message is not null")
    return rows.groupBy("tree", "message").agg(F.min(F.struct(*rest)).alias("m")).select("tree", "message", *(F.col(f"m.{c}").alias(c) for c in rest))


def jumps_of(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(jumps, leaves). Jump table k has (tree, message, up, total): the ancestor 2^k replies up, and the scores of the
    2^k messages before it; only messages that the jump leads somewhere are there. Leaves: (tree, message, score).

    A parent that is not in the tree makes its child a root. Replies in a circle have no leaf or never end at a root,
    and are left out.
    """
    nodes = messages.select("tree", "message", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("message").alias("parent"), F.lit(True).alias("there"))
    up = stored(nodes.join(known, ["tree", "parent"], "left").select("tree", "message", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total")), "replies")
    jumps = [up.where("up is not null")]
    size = up.count()
    while 1 << (len(jumps) - 1) < max(1, size) and jumps[-1].limit(1).count():
        last = jumps[-1]
        further = last.select("tree", F.col("message").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"))
        jumps.append(stored(last.join(further, ["tree", "up"]).select("tree", "message", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total")), "jumps"))
    circles = jumps[-1].select("tree", "message")
    parents = jumps[0].select("tree", F.col("up").alias("message")).distinct()
    leaves = up.select("tree", "message", F.col("total").alias("score")).join(parents, ["tree", "message"], "left_anti").join(circles, ["tree", "message"], "left_anti")
    return jumps[:-1], leaves


def walked_leaves(jumps: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """(tree, leaf, root, sum, n): the messages on each leaf's path, and the sum of their scores but the root's."""
    walk = leaves.select("tree", F.col("message").alias("leaf"), "message", F.lit(0.0).alias("sum"), F.lit(1).alias("n"))
    for k in range(len(jumps) - 1, -1, -1):
        walk = walk.join(jumps[k], ["tree", "message"], "left")
        there = F.col("up").isNotNull()
        walk = walk.select("tree", "leaf", F.coalesce("up", "message").alias("message"), (F.col("sum") + F.coalesce("total", F.lit(0.0))).alias("sum"), (F.col("n") + F.when(there, 1 << k).otherwise(0)).alias("n"))
    return walk.select("tree", "leaf", F.col("message").alias("root"), "sum", "n")


def listed(jumps: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """(tree, leaf, rank, message, height): every message of the path of each leaf (tree, leaf, rank)."""
    found = leaves.select("tree", "leaf", "rank", F.col("leaf").alias("message"), F.lit(0).alias("height"))
    for k in range(len(jumps) - 1, -1, -1):
        found = found.join(jumps[k].select("tree", "message", "up"), ["tree", "message"], "left")
        here, there = F.struct("message", "height"), F.struct(F.col("up").alias("message"), (F.col("height") + (1 << k)).alias("height"))
        found = found.select("tree", "leaf", "rank", F.inline(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return found


def branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, message, height): the best branches of each tree by mean score, ties by smaller leaf.

    A null score counts as 0. ``best`` None keeps every branch. Height counts from the leaf, which has 0. Rows that
    repeat a (tree, message) count once; an empty table has no branches; a null tree or message is left out.
    """
    messages = single(messages)
    jumps, leaves = jumps_of(messages)
    walked = walked_leaves(jumps, leaves)
    roots = messages.select("tree", F.col("message").alias("root"), F.coalesce("score", F.lit(0.0)).alias("last"))
    scored = walked.join(roots, ["tree", "root"]).select("tree", "leaf", ((F.col("sum") + F.col("last")) / F.col("n")).alias("score"))
    order = F.struct(F.col("score"), (-F.col("leaf")).alias("leaf"))
    if best == 1:  # summed up before the shuffle, however many leaves a tree has
        chosen = scored.groupBy("tree").agg(F.max(order).alias("m")).select("tree", (-F.col("m.leaf")).alias("leaf"), F.lit(1).alias("rank"))
    else:
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
        chosen = ranked.where(F.col("rank") <= best) if best else ranked
        chosen = chosen.select("tree", "leaf", "rank")
    return listed(jumps, stored(chosen, "chosen"))


def formatted(messages: DataFrame, best: int | None = 1, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans): one string per chosen branch.

    ``messages``: tree, message, parent, role, text, score. Null roles and texts are empty; rows that repeat a (tree,
    message) count once; other columns are not looked at.
    """
    body = single(messages, "role", "text").select("tree", "message", escaped(F.coalesce("role", F.lit(""))).alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    turns = branches(messages, best).join(body, ["tree", "message"])
    turns = turns.withColumn("head", F.concat(F.lit(BEGIN), "role", F.lit(CLOSE)))
    turn = F.struct((-F.col("height")).alias("at"), "head", "text", F.length("head").alias("head_chars"), F.length("text").alias("text_chars"), F.col("role").isin(*trained).alias("loss"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END))), ""))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["head_chars"] + t["text_chars"] + len(END)).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head_chars"]).alias("begin"), t["text_chars"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return whole.select("tree", "leaf", "rank", "formatted", spans["spans"].alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns (role, text), parsed from the string, and loss_text, taken out by the loss spans; both unescaped."""
    pieces = F.slice(F.split("formatted", END), 1, F.size(F.split("formatted", END)) - 1)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), CLOSE, 1)).alias("role"),
            unescaped(F.substr(p, F.lit(len(BEGIN) + len(CLOSE) + 1) + F.length(F.substring_index(F.substr(p, F.lit(len(BEGIN) + 1)), CLOSE, 1)))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["begin"] + 1, s["length"]))), "")
    return chats.select("*", turns.alias("turns"), loss.alias("loss_text"))


def threads(conversations: DataFrame) -> DataFrame:
    """Reply trees from rows (conv_id, turn, role, text): each turn answers the one before it.

    Turns go by number, equal numbers by role and text, null first. Rows without conv_id belong to no conversation
    and are left out.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text")
    numbered = rows.withColumn("message", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return numbered.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(chats: DataFrame) -> DataFrame:
    """What was read back, per conversation, as counts and digests."""
    read = read_back(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

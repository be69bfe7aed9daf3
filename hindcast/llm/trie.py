"""Prefix trie of conversations, built level by level and rolled up from its leaves."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unstage

#: Turns are numbered within runs of this many turn numbers, so a long conversation isn't one group.
RUN = 4096
#: Members with ids within a range of this many make one piece of text on the way to a node's digest.
PIECE = 4096

NO_MEMBERS = sha256(b"").hexdigest()


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, at, t1, t2, chars): a conversation's turns, numbered from 1 in order of turn.

    A null turn comes first; turns with one number go by role, then the text's md5. A null role or text is empty.
    t1 and t2 stand for role and text (two 64-bit hashes); chars are the text's code points. Rows with
    a null conv_id are no conversation's. Numbers are counted by runs of turn numbers, so no task orders
    a whole long conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).filter("conv_id is not null")
    rows = rows.select("conv_id", "turn", "role", F.md5("text").alias("digest"), F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit(1), "role").alias("t2"), F.length("text").alias("chars"), F.floor(F.col("turn") / RUN).alias("run"))
    order = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    inside = stage(rows.select("conv_id", "run", F.row_number().over(order).cast("long").alias("at"), "t1", "t2", "chars"), "trie-turns")
    sizes = inside.groupBy("conv_id", "run").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy(F.col("run").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("offset", F.sum("size").over(before)).filter("offset > 0").select(F.col("conv_id").alias("c"), F.col("run").alias("r"), "offset")
    offset = stage(offset, "trie-offsets")
    if offset.isEmpty():  # every conversation within one run
        return inside.drop("run")
    met = inside.join(offset, (F.col("conv_id") == F.col("c")) & (F.col("run") == F.col("r")), "left")  # null runs are first
    return met.select("conv_id", (F.col("at") + F.coalesce("offset", F.lit(0))).alias("at"), "t1", "t2", "chars")


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns of conversation c - c % 100 in place of c's own, h = crc32(c) % 6.

    Returns the turns (conv_id, depth, t1, t2, chars) and the conversations (conv_id, n_turns). The head
    is as long as it is, or absent; c's own turns after its first h follow. turns: as from ``numbered``.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % 6, "base": F.col("conv_id") - F.col("conv_id") % 100})
    head = turns.filter("at <= 5").withColumnRenamed("conv_id", "base")
    first = convs.select("base").distinct().join(convs.select(F.col("conv_id").alias("base"), F.col("own").alias("has")), "base")
    plan = stage(convs.join(first, "base", "left").select("conv_id", "base", "h", "own", F.least("h", F.coalesce("has", F.lit(0))).alias("k")), "trie-plan")
    taken = plan.filter("k > 0").join(head, "base").filter("at <= h").select("conv_id", F.col("at").alias("depth"), "t1", "t2", "chars")
    kept = turns.join(plan.select("conv_id", "h", "k"), "conv_id").filter("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("k")).alias("depth"), "t1", "t2", "chars")
    return taken.unionByName(kept), plan.select("conv_id", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))


def _digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes with several members (node, depth, member) that end there.

    Ids are joined in pieces of a bounded number, and a node's pieces run through the hash in order, one
    at a time: the task that has a node holds one piece of it.
    """
    cut = ends.withColumn("piece", F.floor(F.col("member") / PIECE))
    joined = cut.groupBy("node", "depth", "piece").agg(F.array_join(F.sort_array(F.collect_list("member")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])
            out.clear()
            return made

        for batch in batches:
            for node, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ids"))):
                if (node, depth) != at:
                    if at:
                        out.append((*at, state.hexdigest()))
                    at, state = (node, depth), sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield rows()
        if at:
            out.append((*at, state.hexdigest()))
            yield rows()

    ordered = joined.repartition("node", "depth").sortWithinPartitions("node", "depth", "piece").select("node", "depth", "ids")
    return ordered.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie of conversations: a row for each distinct sequence of first turns.

    turns: (conv_id, depth, t1, t2, chars), depths from 1 without gaps; convs: (conv_id, n_turns), every
    conversation, those without turns too. Returns (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256). A node is named by its depth and smallest member; members are
    the conversations that start with it. n_leaves counts childless nodes of its subtree, itself
    included; saved_tokens sums (n_convs - 1) * chars of the last turn over the subtree (root: 0);
    ends_sha256 is over the ids of the members that end there. No conversations, no root.

    Levels: the conversations live at a depth, those that share their node, are grouped by node and next
    turn, and the group's smallest id names the child. A conversation alone in its node leaves: the rest
    of it is a chain whose rows follow at once. So there are as many levels as the longest prefix that
    two conversations share. Groups are aggregated before the shuffle; each level is staged. Then
    levels are joined in reverse, each with the sums of its children.
    """
    turns = turns.join(convs, "conv_id").select("conv_id", "depth", "t1", "t2", "chars", (F.col("depth") == F.col("n_turns")).alias("ends"))
    turns = stage(turns.sortWithinPartitions("depth"), "trie-rebuilt")  # a level reads its own pages
    convs = stage(convs, "trie-conversations")
    whole = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    root = F.lit(whole.root).cast("long")
    fields = ("conv_id", "parent", "n_convs", "chars", "more")
    levels = [stage(convs.filter(F.col("conv_id") == root).select("conv_id", F.lit(None).cast("long").alias("parent"), F.lit(whole.n).alias("n_convs"), F.lit(0).alias("chars"), (F.col("n_turns") > 0).alias("more")), "trie-level")]
    live = convs.select("conv_id", root.alias("node")).filter(F.lit(whole.n > 1))
    shared_ends = [convs.filter("n_turns = 0").select(root.alias("node"), F.lit(0).cast("long").alias("depth"), F.col("conv_id").alias("member"))]
    depth = 0
    while whole.n > 1:
        depth += 1
        at = turns.filter(F.col("depth") == depth).drop("depth")
        next_ = stage(at.join(live, "conv_id").withColumnRenamed("node", "parent"), "trie-live")
        groups = next_.groupBy("parent", "t1", "t2").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.max(~F.col("ends")).alias("more"))
        groups = stage(groups, "trie-level")
        level = groups.select(F.col("node").alias("conv_id"), "parent", "n_convs", "chars", "more")
        levels.append(level)
        several = groups.filter("n_convs > 1").select("parent", "t1", "t2", "node")
        live = stage(next_.join(several, ["parent", "t1", "t2"]).select("conv_id", "node", "ends"), "trie-live")
        unstage(next_)
        if live.isEmpty():
            break
        shared_ends.append(live.filter("ends").select("node", F.lit(depth).cast("long").alias("depth"), F.col("conv_id").alias("member")))
        live = live.select("conv_id", "node")

    rolled: list[DataFrame] = []
    below: DataFrame | None = None
    for d in range(len(levels) - 1, -1, -1):
        level = levels[d]
        if below is None:
            sums = level.select(F.col("conv_id").alias("of")).filter("false").withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")})
        else:
            sums = below.groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        alone = F.col("n_convs") == 1  # its subtree is a chain
        met = level.join(sums, level.conv_id == sums.of, "left")
        below = met.select(
            "conv_id", F.lit(d).cast("long").alias("depth"), "parent", F.col("n_convs").cast("long").alias("n_convs"),
            F.when(alone, F.col("more").cast("long")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
            F.when(alone, F.lit(1)).otherwise(F.coalesce("leaves", F.lit(1))).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("chars") + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"), "more",
        )
        below = stage(below, "trie-rolled")
        rolled.append(below)

    own = F.sha2(F.col("conv_id").cast("string"), 256)
    nodes = reduce(DataFrame.unionByName, rolled)
    alone = nodes.filter("n_convs = 1")
    digests = _digest(reduce(DataFrame.unionByName, shared_ends))
    several = nodes.filter("n_convs > 1").join(digests, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)))
    single = alone.withColumn("ends_sha256", F.when(F.col("more"), NO_MEMBERS).otherwise(own))
    chain = turns.join(alone.select("conv_id", F.col("depth").alias("from")), "conv_id").filter("depth > from")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    chain = chain.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("conv_id").alias("parent"), one.alias("n_convs"), F.when(F.col("ends"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(F.col("ends"), own).otherwise(NO_MEMBERS).alias("ends_sha256"))
    columns = ("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return several.select(*columns).unionByName(single.select(*columns)).unionByName(chain.select(*columns))

"""Interaction audit of document filters: what each filter removes in every order of applying them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, stage, unstage
from .ngramjoin import _filter_bits

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
#: Ends of a text's blocks in code points; a last block has the rest. Few, as each is a round.
BLOCK_ENDS = (64, 1024, 16384, 262144)
SPACES = r"[\x20\x09-\x0D]+"


def failing(docs: DataFrame) -> DataFrame:
    """``docs`` with ``mask``, the bits of the filters A to D that ``text`` fails.

    A: under 50 words. B: 100 * distinct words < 65 * words. C: 100 * capitals A-Z > 5 * code points.
    D: holds one of #$%&*|. Words are runs without white space, case-sensitive.
    """
    docs = docs.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    docs = docs.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))})
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = (F.col("n_words") < 50, 100 * F.col("n_distinct") < 65 * F.col("n_words"), 100 * capitals > 5 * F.length("text"), F.col("text").rlike(r"[#$%&*|]"))
    mask = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    return docs.withColumn("mask", mask).drop("words", "n_words", "n_distinct")


def _block(i: int) -> Column:
    """Hash of the i-th block of ``text``."""
    start = (0, *BLOCK_ENDS)[i]
    return F.xxhash64(F.substring("text", start + 1, BLOCK_ENDS[i] - start if i < len(BLOCK_ENDS) else 2**31 - 1))


def refined(rows: DataFrame) -> tuple[DataFrame | None, int]:
    """Those of (doc_id, n, blocks, ...) that another id equals in length and block hashes, with their class (key); and the rounds.

    The rows are parted by length, then each class by the hash of its next block; classes of one id are
    dropped after every split, so later rounds see fewer rows. Rounds end with the last block of the
    longest row that is left. A round counts classes by partial sums and joins them back to rows, where
    a large class is split.
    """
    live, ends = rows.withColumn("key", F.xxhash64("n")), (0, *BLOCK_ENDS)
    for i in range(len(ends) + 1):
        if i:
            live = live.withColumn("key", F.xxhash64("key", F.col("blocks")[i - 1]))
        shared = live.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("key")
        shared = stage(shared, "audit-classes")
        was, live = live, stage(live.join(shared, "key", "left_semi"), "audit-live")
        if i:
            unstage(was)
        unstage(shared)
        longest = live.agg(F.max("n")).first()[0]
        if longest is None:
            return None, i
        if i > 0 and (i == len(ends) or longest <= ends[i]):
            return live, i


def _of_classes(wanted):
    """Rows whose class passes a filter of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in chunks(batches, "text"):
            slot = batch.column("key").to_numpy() & (8 * len(bits) - 1)
            yield batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def duplicates(docs: DataFrame, live: DataFrame, rounds: int) -> DataFrame:
    """Distinct (doc_id, key) of the rows (doc_id, text) in the classes of ``live`` whose text a smaller id has too.

    Whole texts are compared: those of a class with the one of its smallest id. Texts that differ from
    it, which takes a collision of 64-bit hashes, are compared among themselves in a next turn.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(_filter_bits(live.select(F.col("key").alias("c")).distinct()))
    key = F.xxhash64(F.length("text"))
    for i in range(rounds):
        key = F.xxhash64(key, _block(i))
    keyed = docs.select("doc_id", key.alias("key"), "text")
    rest = stage(keyed.mapInArrow(_of_classes(wanted), keyed.schema), "audit-texts")
    wanted.destroy()
    found = None
    while True:
        least = rest.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select(F.col("key").alias("class"), "first")
        model = rest.join(least, (F.col("key") == F.col("class")) & (F.col("doc_id") == F.col("first"))).select("class", "first", F.col("text").alias("model"))
        model = stage(model.dropDuplicates(["class"]), "audit-models")
        told = rest.join(model, F.col("key") == F.col("class")).withColumn("same", F.col("text") == F.col("model"))
        told = stage(told.select("doc_id", "key", "first", "same", F.when(~F.col("same"), F.col("text")).alias("text")), "audit-told")
        same = told.filter("same and doc_id > first").select("doc_id", "key")
        found = same if found is None else found.unionByName(same)
        unstage(model)
        unstage(rest)
        rest = told.filter("not same").select("doc_id", "key", "text")
        if rest.isEmpty():
            return found.distinct()
        rest = stage(rest, "audit-texts")


def orders() -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, its bit, the bits of the filters before it) for all 120 orders and 5 steps."""
    bit = {name: 1 << i for i, name in enumerate(FILTERS)}
    return [("".join(p), i + 1, p[i], bit[p[i]], sum(bit[x] for x in p[:i])) for p in permutations(FILTERS) for i in range(len(FILTERS))]


def _grid(counts: DataFrame) -> DataFrame:
    """The 600 rows of each part from its counts (part, mask, n, good, toxic), at most 32 of a part."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    grid = counts.sparkSession.createDataFrame(orders(), "filter_order string, step int, filter string, bit int, before int")
    each = cells.join(F.broadcast(grid))  # 600 fixed rows, all of which a part has

    def total(of: str, when: str) -> Column:
        return F.expr(f"aggregate(filter(cells, x -> {when}), 0L, (s, x) -> s + x.{of})")

    here = "x.mask & bit != 0 and x.mask & before = 0"
    shares = F.expr("aggregate(filter(cells, x -> x.mask & bit != 0), 0L, (s, x) -> s + x.n * (120 div bit_count(x.mask)))")
    return each.select(
        "part", "filter_order", "step", "filter", total("n", "x.mask & (before | bit) = 0").alias("kept"), total("n", here).alias("removed"),
        total("n", "x.mask & bit != 0 and x.mask & before != 0").alias("redundant"), total("n", "x.mask = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), shares.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What each of five filters removes within each part, in all 120 orders of applying them.

    Filters A to D: see ``failing``. E: the text is identical to that of a smaller id anywhere in the
    table, be that removed or not. Returns (part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley), 600 rows for each part: documents kept after the
    step, removed by it, failing its filter but removed earlier, failing its filter alone, removed with
    a label quality = 1 or toxic = 1, and what its filter removes summed over all orders. In an order
    a document is removed by the first filter that it fails, so of the 120 orders each of its m failing
    filters gets 120 / m.

    A null part is the empty string; a null text is empty. Every row of ``docs`` is a document: rows
    that repeat an id are not each other's duplicates, and a row with a null id neither is one nor makes
    one. Of several labels of an id, any that says 1 counts. An empty table gives no rows. Of ``docs``
    and ``labels`` only the named columns are read.

    Plan: one pass over the texts takes bits, length and block hashes, which alone are shuffled to find
    duplicates (``refined``); a second pass fetches the texts of classes that are left, to compare them.
    What remains are counts by part and bits, at most 32 of a part, from which its 600 rows follow.
    """
    marked = lambda c: F.max((F.col(c) == 1).cast("int"))
    label = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(marked("quality").alias("good"), marked("toxic").alias("toxic"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    blocks = F.array(*(_block(i) for i in range(len(BLOCK_ENDS) + 1)))
    rows = stage(failing(docs).select("doc_id", "part", "mask", F.length("text").alias("n"), blocks.alias("blocks")), "audit-rows")
    named = rows.filter("doc_id is not null")
    live, rounds = refined(named.select("doc_id", "part", "mask", "n", "blocks"))

    def counted(some: DataFrame, mask: Column, sign: int) -> DataFrame:
        """Counts of rows by part and mask, those with labels among them."""
        held = some.filter("doc_id is not null").join(label, "doc_id", "left").select("part", "mask", "good", "toxic")
        held = held.unionByName(some.filter("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
        sums = {"n": F.lit(1), "good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}
        return held.groupBy("part", mask.alias("mask")).agg(*(F.sum(sign * x.cast("long")).alias(c) for c, x in sums.items()))

    counts = counted(rows, F.col("mask"), 1)
    if live is not None:
        twice = stage(duplicates(docs.filter("doc_id is not null").select("doc_id", "text"), live, rounds), "audit-duplicates")
        failed = stage(live.join(twice, ["doc_id", "key"], "left_semi").select("doc_id", "part", "mask"), "audit-failed")
        counts = counts.unionByName(counted(failed, F.col("mask"), -1)).unionByName(counted(failed, F.col("mask").bitwiseOR(F.lit(DUPLICATE)), 1))
    total = counts.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))).filter("n > 0")
    return _grid(total)

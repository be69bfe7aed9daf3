"""Benchmark decontamination by a Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, stage, text_buffers
from .words import ALNUM, LOWER, U64, hashes, mix, spans

#: Words in one block of patterns, about 60 bytes each; a larger benchmark is searched in several passes.
BLOCK_WORDS = 1_000_000
#: Words in one lane: long documents are searched in overlapping lanes side by side.
LANE = 256
SHIFT_BITS = 20


def _block(previous: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Slot of a block of two words in a shift table."""
    return (mix(previous * U64(0x9E3779B97F4A7C15) + last) >> U64(64 - SHIFT_BITS)).astype(np.int64)


class Benchmark:
    """The words of many items as flat arrays: their bytes, where each starts and ends, its hash and its item's number."""

    def __init__(self, texts: pa.Array):
        data, at = text_buffers(texts)
        self.data = LOWER[data]
        self.starts, self.ends, self.item = spans(self.data, at, ALNUM)
        self.word = hashes(self.data, self.starts, self.ends)

    def spelled(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


class Patterns:
    """Shift table and suffix buckets for all windows of one length (in words) of a benchmark.

    Equal windows are one pattern, which lists the items that have it.
    """

    def __init__(self, length: int, of: Benchmark, first: np.ndarray):
        self.length, self.of = length, of
        block = min(2, length)
        zero = np.zeros(len(first), np.uint64)
        self.shift = np.full(1 << SHIFT_BITS, length - block + 1, np.uint8)
        full = zero
        for j in range(length):
            word = of.word[first + j]
            full = mix(full * U64(0x9E3779B97F4A7C15) + word)
            if j >= block - 1:
                np.minimum.at(self.shift, _block(of.word[first + j - 1] if block == 2 else zero, word), length - 1 - j)
        suffix = self.suffix(of.word[first + length - 1], of.word[first + length - 2] if block == 2 else zero)
        order = np.lexsort((of.item[first], full, suffix))
        suffix, full = suffix[order], full[order]
        new = np.flatnonzero(np.r_[True, (suffix[1:] != suffix[:-1]) | (full[1:] != full[:-1])])
        self.bucket, self.first = suffix[new], first[order[new]]
        self.edge, self.items = np.r_[new, len(order)], of.item[first[order]]

    @staticmethod
    def suffix(last: np.ndarray, previous: np.ndarray) -> np.ndarray:
        return mix(previous * U64(0x9E3779B97F4A7C15) + last)

    def search(self, word: np.ndarray, doc: np.ndarray, spell) -> Iterator[tuple[int, list[int]]]:
        """First word and items of each occurrence; ``spell(i)`` gives the bytes of word i."""
        n, m = len(word), self.length
        if n < m:
            return
        ends = np.arange(m - 1, n, LANE)
        stop = np.minimum(ends + LANE, n)
        zero = np.zeros(1, np.uint64)
        found = []
        while len(ends):
            last = word[ends]
            previous = word[ends - 1] if m > 1 else zero
            shift = self.shift[_block(previous, last)].astype(np.int64)
            found.append(ends[shift == 0])
            ends = ends + np.maximum(shift, 1)
            on = ends < stop
            ends, stop = ends[on], stop[on]
        at = np.sort(np.concatenate(found))
        at = at[doc[at] == doc[at - m + 1]]
        suffix = self.suffix(word[at], word[at - 1] if m > 1 else np.zeros(len(at), np.uint64))
        low, high = np.searchsorted(self.bucket, suffix, "left"), np.searchsorted(self.bucket, suffix, "right")
        for end, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
            begin = end - m + 1
            for p in range(a, b):
                own = int(self.first[p])
                if (self.of.word[own : own + m] == word[begin : end + 1]).all() and all(self.of.spelled(own + i) == spell(begin + i) for i in range(m)):
                    yield begin, np.unique(self.items[self.edge[p] : self.edge[p + 1]]).tolist()


def compile_patterns(texts: pa.Array, window: int) -> list[Patterns]:
    """Windows of all items, by length; items are numbered by their place in ``texts``."""
    of = Benchmark(texts)
    if not len(of.word):
        return []
    count = np.bincount(of.item)
    size = np.minimum(count, window)[of.item]  # of the word's item
    ends = np.cumsum(count)[of.item]
    first = np.flatnonzero(np.arange(len(size)) + size <= ends)
    return [Patterns(int(n), of, first[size[first] == n]) for n in np.unique(size[first])]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Find every occurrence of a benchmark window of ``window`` words in the documents.

    Returns (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits, items), a row for each
    row of ``docs``: ``hits`` lists [first word, last word + 1] of the merged hit stretches, ``items``
    the item ids found, sorted as strings. Words are runs of digits, a-z (A-Z lower-cased) and
    non-ASCII characters. An item of fewer words is one window; an item without words, and a null
    text, has none. Items with a null id are not searched; repeated items count once. Of the other
    columns of ``docs`` only those in ``keep`` are read; they are returned as they are.

    Plan: the benchmark is a stated query set: its size is counted first, and it is searched in blocks
    of at most ``block_words`` words by a bound that needs no tokenising (an item is never cut). One
    block is one narrow pass over the documents, and nothing is shuffled. With several, each is a pass
    of its own, which leaves the documents that it hits, without their texts; its patterns are gone before
    the next block is made. What the passes found is then added up by document, told apart by id and
    text, and joined to all.
    """
    carried = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)
    names, kinds = docs.columns[2:], "".join(f", {name} {kind}" for name, kind in docs.dtypes[2:])
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")).filter("item is not null").distinct()
    sizes = items.select(F.col("item"), (F.octet_length("text") / 2 + 1).cast("long").alias("w"))
    total = sizes.agg(F.sum("w")).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_words))
    spark = docs.sparkSession
    schema = "doc_id long, hits array<long>, items array<string>, n_words long, n_hit long"
    if n_blocks == 1:
        out = docs.mapInArrow(_searcher(_shared(spark, items, window), names), schema + kinds)
    else:
        found = []
        keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
        for block in range(n_blocks):
            shared = _shared(spark, items.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block), window)
            made = keyed.mapInArrow(_searcher(shared, ["t1", "t2"]), schema + ", t1 long, t2 long")
            found.append(stage(made.filter("n_hit > 0").drop("n_words"), "decontamination-hits"))
            shared.destroy()
        words = docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}).mapInArrow(_searcher(None, [*names, "t1", "t2"]), f"{schema}{kinds}, t1 long, t2 long").drop("hits", "items", "n_hit")
        ranges = F.explode(F.transform(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), lambda i: F.struct(F.get("hits", i).alias("a"), F.get("hits", i + 1).alias("b"))))
        every = reduce(DataFrame.unionByName, found).withColumn("id", F.coalesce("doc_id", F.lit(0)))
        key = ["id", "t1", "t2"]
        # Stretches of a document are merged in order: a new one starts beyond the end of all before it.
        stretches = every.select(*key, F.col("doc_id").isNull().alias("no_id"), ranges.alias("r")).select(*key, "no_id", "r.a", "r.b").distinct()
        key.append("no_id")
        order = Window.partitionBy(*key).orderBy("a", "b")
        before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
        grouped = stretches.withColumn("new", F.coalesce(F.col("a") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        merged = grouped.groupBy(*key, "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).groupBy(*key).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("a", "b"))), lambda r: F.array(r["a"], r["b"]))).alias("hits"), F.sum(F.col("b") - F.col("a")).alias("n_hit"))
        named = every.withColumn("no_id", F.col("doc_id").isNull()).select(*key, F.explode("items").alias("item")).groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
        hit = stage(merged.join(named, key), "decontamination-merged")
        met = words.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "no_id": F.col("doc_id").isNull()}).join(hit, key, "left")
        out = met.select("doc_id", F.coalesce("hits", F.array().cast("array<long>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), *names)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "hits", "items", *(F.col(n).alias(c) for n, c in zip(names, keep))
    )


def _shared(spark, items: DataFrame, window: int):
    """A broadcast of the item ids and the compiled patterns of a block of items."""
    rows = items.orderBy("item", "text").toArrow().combine_chunks()  # a block's
    ids = rows.column("item").to_pylist()
    text = rows.column("text")
    text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
    return spark.sparkContext.broadcast((ids, compile_patterns(text, window)))


def _searcher(shared, carried: list[str]):
    """Rows (doc_id, hits, items, n_words, n_hit, carried); without ``shared`` words are only counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, patterns = shared.value if shared else ([], [])
        for batch in chunks(batches, "text"):
            data, at = text_buffers(batch.column("text"))
            data = LOWER[data]
            starts, ends, doc = spans(data, at, ALNUM)
            word = hashes(data, starts, ends) if patterns else None
            spell = lambda i: data[starts[i] : ends[i]].tobytes()
            first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            hit = np.zeros(len(doc) + 1, np.int64)
            found: dict[int, set[str]] = defaultdict(set)
            for pattern in patterns:
                for begin, items in pattern.search(word, doc, spell):
                    hit[begin] += 1
                    hit[begin + pattern.length] -= 1
                    found[int(doc[begin])].update(names[i] for i in items)
            hit = np.cumsum(hit)[: len(doc)] > 0
            hits, lists, counts = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)], np.zeros(batch.num_rows, np.int64)
            for i, own_items in found.items():
                own = hit[first[i] : first[i + 1]]
                hits[i] = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8))).tolist()
                counts[i], lists[i] = int(own.sum()), sorted(own_items)
            columns = [batch.column("doc_id"), pa.array(hits, pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.string())), pa.array(np.diff(first)), pa.array(counts)]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in carried], ["doc_id", "hits", "items", "n_words", "n_hit"] + carried)

    return run

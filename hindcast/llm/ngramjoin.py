"""Jaccard self-join on word n-grams with adaptive multi-match prefixes, and its connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, drop_shuffles, moved, stage, stage_buckets, text_buffers, unstage
from .graph import connected_components, contract, forest, labels
from .words import LOWER, NOT_SPACE, U64, hashes, mix, shingles, spans

#: Slots (a power of two) of the table of estimated frequencies.
FREQUENCY_BITS = 22
#: Least and most bits (powers of two) of the filter of candidates' sets; it has 16 bits a candidate
#: up to 16 MB, and lets more other sets through beyond that.
FILTER_BITS = (16, 27)
#: A task counts n-grams in runs of about this many; those seen once in a run aren't passed on.
RUN = 2_000_000
#: A candidate shares at most this many prefix n-grams of demand; prefixes grow by one less.
MOST_MATCHES = 8
#: Partners that an n-gram is expected to bring by chance, though none were counted, and the cost of
#: verifying a candidate in postings.
CHANCE, VERIFY_COST = 0.25, 32
#: An n-gram estimated in at least 2 ** HEAVY_LOG documents is never gathered in one place.
HEAVY_LOG = 10
#: Buckets of at most this many sets make all their pairs at once, which are short rows and few of them
#: candidates; larger ones go by a leader, which moves whole sets.
SMALL_BUCKET = 32
#: The same for buckets of differences, whose pairs also have to be in place before they are made.
SMALL_DIFFERENCE = 64
#: Levels of leaders; what is still large then makes its pairs, as far as their places allow a link.
LEVELS = 5

_K, _CHECK = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def _mark(own: np.ndarray, key: np.uint64) -> int:
    """A 64-bit fingerprint of a set of hashes."""
    size = np.full(1, len(own), np.uint64) * key
    return int(mix(np.add.reduce(mix(own ^ key), keepdims=True) + size).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, k: int, twins: frozenset[int] = frozenset()) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, sorted distinct n-gram hashes, class of that set) of the rows that have words.

    A class is a 64-bit fingerprint; where different sets have the same one (``twins``), a second
    fingerprint is mixed in.
    """
    data, at = text_buffers(batch.column("text"))
    data = LOWER[data]
    starts, ends, doc = spans(data, at, NOT_SPACE)
    value, owner = shingles(hashes(data, starts, ends), doc, k)
    edge = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    for row in np.flatnonzero(np.diff(edge)).tolist():
        own = np.sort(value[edge[row] : edge[row + 1]])
        own = own[np.r_[True, own[1:] != own[:-1]]]
        mark = _mark(own, _K)
        yield row, own, mark ^ _mark(own, _CHECK) if mark in twins else mark


def _statistics(k: int):
    """Rows of documents (doc_id, row, n, c, check) and of n-grams that repeat within a run (h, seen)."""
    names = ["doc_id", "row", "n", "c", "check", "h", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        held, total = [], 0

        def counted() -> pa.RecordBatch:
            h, seen = np.unique(np.concatenate(held), return_counts=True)
            h, seen = h[seen > 1].view(np.int64), seen[seen > 1]
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(h), pa.array(seen.astype(np.int64))], names)

        for batch in chunks(batches, "text"):
            n, c, check = np.zeros((3, batch.num_rows), np.int64)
            for row, own, mark in _sets(batch, k):
                n[row], c[row], check[row] = len(own), mark, _mark(own, _CHECK)
                if mark not in met:
                    met.add(mark)
                    held.append(own)
                    total += len(own)
            if total >= RUN:
                yield counted()
                held, total = [], 0
            none = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n), pa.array(c, mask=n == 0), pa.array(check), none, none], names)
        if held:
            yield counted()

    return run


def prefix_of(own: np.ndarray, log_count: np.ndarray, parts: int, of: int) -> tuple[np.ndarray, int]:
    """The n-grams to index a set by, rarest first, and how many of them a partner has to share.

    With the shortest prefix, n - ceil(t n) + 1, one shared n-gram makes a candidate; each further
    n-gram lets the demand rise by one. Of the partners that the prefix's n-grams bring in all, at
    most one in m shares m; the cost of verifying those, weighed against the length, picks m.
    """
    n = len(own)
    order = np.argsort(log_count, kind="stable")  # own is sorted: ties go by hash, for all sets alike
    shortest = n - -(-parts * n // of) + 1
    most = min(MOST_MATCHES, n - shortest + 1)
    brought = np.cumsum(np.maximum(np.exp2(log_count[order[: shortest + most - 1]].astype(np.float64)) - 1, CHANCE))
    m = 1 + int(np.argmin([VERIFY_COST * brought[shortest + j - 1] / (j + 1) + j for j in range(most)]))
    return order[: shortest + m - 1], m


def _postings(k: int, parts: int, of: int, frequency, twins: frozenset[int]):
    """Rows (h, c, nm, spread) of each set's prefix, once a task for equal sets.

    nm packs the set's size, the n-gram's place in the prefix (from 1) and the set's demand; spread
    cuts a heavy n-gram's postings into parts.
    """
    names = ["h", "c", "nm", "spread"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequency.value
        met: set[int] = set()
        for batch in chunks(batches, "text"):
            h, c, nm, spread = [], [], [], []
            for _, own, mark in _sets(batch, k, twins):
                if mark not in met:
                    met.add(mark)
                    log_count = table[(own >> U64(64 - FREQUENCY_BITS)).astype(np.int64)]
                    take, need = prefix_of(own, log_count, parts, of)
                    h.append(own[take].view(np.int64))
                    c.append(np.full(len(take), mark, np.int64))
                    nm.append((len(own) << 32 | need) + (np.arange(1, len(take) + 1, dtype=np.int64) << 8))
                    spread.append(np.where(log_count[take] >= HEAVY_LOG, 1 + mark % 1000, 0).astype(np.int16))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (h, c, nm, spread)], names)

    return run


def _members(k: int, wanted, frequency, twins: frozenset[int]):
    """Rows (c, own) of the sets whose fingerprint passes the filter, rarest n-gram first, once a task for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, table = wanted.value, frequency.value
        met: set[int] = set()
        for batch in chunks(batches, "text"):
            c, own = [], []
            for _, values, mark in _sets(batch, k, twins):
                slot = mark & 8 * len(bits) - 1
                if mark not in met and bits[slot >> 3] >> (slot & 7) & 1:
                    met.add(mark)
                    c.append(mark)
                    log_count = table[(values >> U64(64 - FREQUENCY_BITS)).astype(np.int64)]
                    own.append(values[np.argsort(log_count, kind="stable")].view(np.int64))
            if c:
                ends = np.cumsum([0] + [len(x) for x in own]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], ["c", "own"])

    return run


def _frequency_table(counts: DataFrame, least: int = 4) -> np.ndarray:
    """log2 of the largest count in each slot; one fixed-size array, whatever the corpus."""
    slot = F.shiftrightunsigned("h", 64 - FREQUENCY_BITS)
    most = counts.groupBy("h").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= least).groupBy(slot.alias("slot")).agg(F.max("seen").alias("seen"))
    found = most.select(F.col("slot").cast("int"), F.floor(F.log2("seen")).cast("byte").alias("log")).toArrow()
    table = np.zeros(1 << FREQUENCY_BITS, np.uint8)
    table[found["slot"].to_numpy()] = found["log"].to_numpy()
    return table


def _filter_bits(wanted: DataFrame) -> np.ndarray:
    """A bitmap with a bit for the low end of each fingerprint c; its size is bounded by FILTER_BITS."""
    log = min(max((16 * wanted.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.col("c").bitwiseAND((1 << log) - 1) + 1  # Spark numbers the bits of its bitmaps from 1
    maps = wanted.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bits = np.zeros(1 << log - 3, np.uint8)
    for row in maps.toArrow().to_pylist():
        bits[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _candidate_sets(docs: DataFrame, small: DataFrame, large: DataFrame, k: int, frequency, twins: frozenset[int]) -> DataFrame:
    """(c, own): the sets of the classes (c) in small and in large buckets, staged in buckets by class; made anew
    from the texts in one pass, for documents that a filter of bounded size lets through."""
    wanted = stage(small.unionByName(large).distinct(), "ngram-candidates")
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted))
    made = docs.select("text").mapInArrow(_members(k, bits, frequency, twins), "c long, own array<long>")
    sets = made.groupBy("c").agg(F.any_value("own").alias("own")).join(moved(wanted), "c", "left_semi")
    sets = stage_buckets(sets, "ngram-sets", "c")
    bits.destroy()
    unstage(wanted)
    return sets


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their sets, own_a and own_b. The sets stand in buckets by class: of them only
    own_a is moved, once a pair."""
    left = moved(pairs).join(sets.select(F.col("c").alias("a"), F.col("own").alias("own_a")), "a")
    return moved(left).join(sets.select(F.col("c").alias("b"), F.col("own").alias("own_b")), "b")


def _verified(pairs: DataFrame, sets: DataFrame, parts: int, of: int) -> DataFrame | None:
    """Those of the staged pairs (a, b) whose sets reach the similarity; None if there are none."""
    shared = F.size(F.array_intersect("own_a", "own_b"))
    both = _beside(pairs.select("a", "b"), sets).select("a", "b", shared.cast("long").alias("i"), (F.size("own_a") + F.size("own_b")).cast("long").alias("s"))
    found = stage(both.filter(of * F.col("i") >= parts * (F.col("s") - F.col("i"))).select("a", "b"), "ngram-links")
    return None if found.isEmpty() else found


class _Links:
    """Links (a, b) found so far, and a label for each class that has one: classes of one label are connected."""

    def __init__(self):
        self.all: DataFrame | None = None
        self.label: DataFrame | None = None
        self._trees: DataFrame | None = None

    def add(self, found: DataFrame | None, label: bool = True) -> None:
        if found is None:
            return
        self.all = found if self.all is None else self.all.unionByName(found)
        if label:  # one step of contraction is enough to tell which pairs a link would be needless for
            grown = found if self._trees is None else found.unionByName(self._trees.select(F.col("u").alias("a"), F.col("v").alias("b")))
            self._trees = contract(forest(grown))
            old, self.label = self.label, stage(labels(self._trees, "c", "comp"), "ngram-labels")
            if old is not None:
                unstage(old)

    def labelled(self, df: DataFrame, c: str = "c", comp: str = "comp") -> DataFrame:
        if self.label is None:
            return df.withColumn(comp, F.col(c))
        named = self.label.select(F.col("c").alias(c), F.col("comp").alias(comp))
        return df.join(named, c, "left").withColumn(comp, F.coalesce(comp, c))


def _leaders(live: DataFrame) -> DataFrame:
    """Pairs (a, b) of the leader and each other member of buckets (g, h, band) of members (c, n, first, ratio, comp).

    The member with the smallest ``first`` leads. ratio: how many times its size a partner of the
    member can have, by this bucket; two members link only if the product of their ratios is 1 or more.
    """
    key = ["g", "h", "band"]
    order = F.struct("first", F.xxhash64("c"), "c")
    mixed = live.groupBy(*key).agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(order)["c"].alias("a"), F.max("ratio").alias("top")).filter("low < high")
    pairs = live.join(mixed.select(*key, "a", "top"), key).filter("c != a and ratio * top >= 0.999999").select("a", F.col("c").alias("b"))
    return stage(pairs.distinct(), "ngram-leaders")


def _by_leader(pairs: DataFrame, sets: DataFrame, links: _Links, parts: int, of: int, last: bool) -> DataFrame | None:
    """Add the links within large buckets, by pairs of a leader and a member; the buckets for a next level.

    With D the difference between a set
    and its leader's, two members A and B differ in |D_A| + |D_B| - 2 |D_A and D_B shared|, so they
    link if 2 (of + parts) shared >= s_A + s_B, where s = (of + parts) |D| - (of - parts) size. Of two
    that a link to the leader doesn't connect already, one has s > (of - parts) leader's size, so they
    share some of their differences. Those are indexed like sets: rarest first, as many as the
    least demand of a partner asks for. Members whose shared differences can't meet any partner's
    demand go first, most of a group of near copies that don't link; so no pairs of the whole
    bucket are made. Up to SMALL_DIFFERENCE such members of a leader are held against each other with their
    whole differences instead, which tells their links exactly.
    That serves members near the leader (|D| <= n), and those of which the leader holds so much that
    all that a link asks for may lie in it (common >= t n, t = parts / of), such as members inside a
    larger leader. Of members far from it (2 |D| > n) what the leader lacks is indexed, by the prefix that a link asks
    for, which finds every link that shares something outside of the leader; where a leader has up to
    SMALL_DIFFERENCE of them, those prefixes are compared pair by pair instead of listed.
    So no link is lost, if t >= 3 / 4 (else all differences are indexed): of two near ones the whole
    differences meet. If one is far only (|D| > n, common < t n), a link shares at least t n, so some of
    it outside of the leader; the other one is in that index too, for were it near only (2 |D| <= n), then
    |D_A| and |D_B|, which differ by (1 - t) / (1 + t) of both sizes at most, couldn't lie so far apart.
    """
    apart = F.concat(F.array_except("own_a", "own_b"), F.array_except("own_b", "own_a"))
    diffs = _beside(pairs, sets).select("a", "b", F.size("own_b").cast("long").alias("n"), F.size("own_a").cast("long").alias("n_a"), F.array_except("own_b", "own_a").alias("own"), apart.alias("diff"))
    diffs = diffs.withColumn("d", F.size("diff").cast("long")).withColumn("s", (of + parts) * F.col("d") - (of - parts) * F.col("n"))
    rings = 4 * parts >= 3 * of
    # A link shares ceil(t n) n-grams at least, and all but what the leader has of them are in ``own``.
    length = F.col("n") - F.greatest(F.ceil(F.col("n") * parts / of), F.col("n") - F.size("own") + 1) + 1
    diffs = diffs.withColumns({
        "linked": F.col("s") <= (of - parts) * F.col("n_a"), "common": (F.col("n") - F.size("own")).cast("long"),
        "own": F.when((2 * F.col("d") > F.col("n")) & F.lit(rings), F.slice("own", 1, length.cast("int"))), "diff": F.when((F.col("d") <= F.col("n")) | (of * (F.col("n") - F.size("own")) >= parts * F.col("n")) | F.lit(not rings), F.col("diff")),
    })
    diffs = stage(diffs, "ngram-differences")
    found = stage(diffs.filter("linked").select("a", "b"), "ngram-links")
    links.add(None if found.isEmpty() else found)

    # Members inside are connected with the leader: of a pair at least one is outside.
    live = links.labelled(links.labelled(diffs, "b", "comp"), "a", "comp_a")
    live = live.select("a", "b", "n", "d", "s", "diff", "own", "common", "comp", (F.col("linked") | (F.col("comp") == F.col("comp_a"))).alias("inside"))
    live = stage(live.join(live.filter("not inside").select("a").distinct(), "a", "left_semi"), "ngram-differences")  # several plans read it
    unstage(diffs)
    fields = ("n", "d", "s", "common", "comp", "inside")
    far = live.filter("own is not null").select("a", F.col("b").alias("c"), *fields, "own")
    beyond = stage(far.join(far.groupBy("a").agg(F.count("*").alias("many")).filter("many > 1"), "a"), "ngram-differences")
    # Few members far from a leader are held against each other as whole rows; only those of many are listed.
    few = beyond.filter(F.col("many") <= SMALL_DIFFERENCE).drop("many")
    few2 = few.select("a", *(F.col(x).alias(f"{x}2") for x in ("c", *fields, "own")))
    alike = of * F.least("n", "n2") >= parts * F.greatest("n", "n2")
    few = moved(few).join(few2, "a").filter((F.col("c") < F.col("c2")) & (F.col("comp") != F.col("comp2")) & ~(F.col("inside") & F.col("inside2")) & alike)
    # Lists are in one order for all, so the first n-gram that two share is the first of both that is shared.
    few = few.withColumn("e", F.get(F.array_intersect("own", "own2"), F.lit(0))).filter("e is not null")
    rest, rest2 = (F.col(f"n{x}") - F.col(f"common{x}") - F.array_position(f"own{x}", F.col("e")) + 1 for x in ("", "2"))
    few = few.filter((of + parts) * (F.least(rest, rest2) + F.least("common", "common2")) >= parts * (F.col("n") + F.col("n2")))
    far = beyond.filter(F.col("many") > SMALL_DIFFERENCE)
    listed = far.select("a", "c", F.posexplode("own").alias("at", "e"))
    listed = moved(listed).join(listed.groupBy("a", "e").agg(F.count("*").alias("held")).filter("held > 1"), ["a", "e"])
    far = moved(listed).join(far.select("a", "c", *fields), ["a", "c"]).withColumns({"band": F.lit(1), "left": F.col("n") - F.col("common") - F.col("at")})
    live, outer = live.filter("diff is not null").drop("own"), live
    out = lambda x: F.when(~F.col("inside"), F.col(x))

    def able(live: DataFrame, r: Column) -> DataFrame:
        """Members that can meet some partner's demand, if they share at most r of their differences with any."""
        live = live.withColumn("q", 2 * (of + parts) * r - F.col("s"))
        bounds = live.groupBy("a").agg(F.min("s").alias("s_all"), F.min(out("s")).alias("s_out"), F.max("q").alias("q_all"), F.max(out("q")).alias("q_out"))
        meets = F.when(F.col("inside"), (F.col("q") >= F.col("s_out")) & (F.col("s") <= F.col("q_out"))).otherwise((F.col("s") <= F.col("q_all")) & (F.col("q") >= F.col("s_all")))
        return live.join(bounds, "a").filter(meets).drop("q", "s_all", "s_out", "q_all", "q_out")

    def demand() -> Column:
        """The differences that a member shares with any partner at least."""
        least = F.col("s") + F.when(F.col("inside"), F.col("s_out")).otherwise(F.col("s_all"))
        return F.ceil(F.greatest(least, F.lit(1)) / (2 * (of + parts)))

    near = able(live, F.col("d"))
    near = stage(near.join(near.groupBy("a").agg(F.count("*").alias("many")), "a"), "ngram-differences")
    # Few members near a leader are held against each other as whole rows too, and all is known of them then.
    pick = near.filter(F.col("many") <= SMALL_DIFFERENCE).select("a", "b", "d", "s", "comp", "inside", "diff")
    pick2 = pick.select("a", *(F.col(x).alias(f"{x}2") for x in ("b", "d", "s", "comp", "inside", "diff")))
    apart = (F.col("b") < F.col("b2")) & (F.col("comp") != F.col("comp2")) & ~(F.col("inside") & F.col("inside2"))
    meets = lambda shared: 2 * (of + parts) * shared >= F.col("s") + F.col("s2")
    pick = moved(pick).join(pick2, "a").filter(apart & meets(F.least("d", "d2"))).filter(meets(F.size(F.array_intersect("diff", "diff2"))))
    close = stage(pick.select(F.col("b").alias("a"), F.col("b2").alias("b")).distinct(), "ngram-links")
    names = ("a", "e", "band", "c", *fields, "left")
    posted = far.select(*names)
    live = near.filter(F.col("many") > SMALL_DIFFERENCE).drop("many")
    if not live.isEmpty():
        bounds = live.groupBy("a").agg(F.min("s").alias("s_all"), F.min(out("s")).alias("s_out"))
        # Of differences in one order for all, the first that a pair shares is among the first d - demand + 1 of
        # each. Members that share none of those with another one go, before whole differences are listed.
        first = live.join(bounds, "a").select("a", "b", F.explode(F.slice(F.array_sort("diff"), F.lit(1), F.greatest(F.col("d") - demand() + 1, F.lit(0)).cast("int"))).alias("e"))
        met = moved(first).join(first.groupBy("a", "e").agg(F.count("*").alias("held")).filter("held > 1"), ["a", "e"]).select("a", "b").distinct()
        live = stage(live.join(met, ["a", "b"], "left_semi"), "ngram-differences")
        own = live.select("a", "b", F.explode("diff").alias("e"))
        held = moved(own).join(own.groupBy("a", "e").agg(F.count("*").alias("held")).filter("held > 1"), ["a", "e"])
        several = stage(held.groupBy("a", "b").agg(F.count("*").alias("r")), "ngram-differences")
        live = moved(live).join(several, ["a", "b"])  # r: the differences that several hold
        live = stage(able(live, F.col("r")).drop("r"), "ngram-differences")
        unstage(several)
        own = live.select("a", "b", F.explode("diff").alias("e"))
        held = moved(own).join(own.groupBy("a", "e").agg(F.count("*").alias("held")).filter("held > 1"), ["a", "e"])
        mine = Window.partitionBy("a", "b")
        placed = held.withColumns({"turn": F.row_number().over(mine.orderBy("held", "e")), "r": F.count("*").over(mine)})
        bounds = live.groupBy("a").agg(F.min("s").alias("s_all"), F.min(out("s")).alias("s_out"))
        placed = moved(placed).join(live.drop("diff"), ["a", "b"]).join(bounds, "a").withColumn("at", F.col("d") - F.col("r") + F.col("turn"))
        placed = placed.withColumns({"left": F.col("d") - F.col("at") + 1, "band": F.lit(0), "c": F.col("b")})
        least = F.col("s") + F.when(F.col("inside"), F.col("s_out")).otherwise(F.col("s_all"))
        listed = placed.filter(2 * (of + parts) * F.col("left") >= F.greatest(least, F.lit(1)))
        posted = listed.select(*names).unionByName(posted)
    posted = stage(posted, "ngram-difference-postings")
    unstage(outer)
    unstage(near)
    size = posted.groupBy("a", "e", "band").agg(F.count("*").alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    posted = moved(posted).join(size.select("a", "e", "band", (F.lit(not last) & (F.col("held") > SMALL_DIFFERENCE)).alias("large")), ["a", "e", "band"])
    one = posted.filter("not large")
    two = one.select("a", "e", "band", *(F.col(x).alias(f"{x}2") for x in ("c", *fields, "left")))
    # What is left from the shared place on (and, of far ones, what the leader may have of both) meets the demand.
    left = F.least("left", "left2")
    meets = F.when(F.col("band") == 0, 2 * (of + parts) * left >= F.col("s") + F.col("s2")).otherwise((of + parts) * (left + F.least("common", "common2")) >= parts * (F.col("n") + F.col("n2")))
    fits = (F.col("c") < F.col("c2")) & (F.col("comp") != F.col("comp2")) & ~(F.col("inside") & F.col("inside2")) & meets
    both = moved(one).join(two, ["a", "e", "band"]).filter(fits).select("c", "c2").unionByName(few.select("c", "c2"))
    pairs = stage(both.select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct(), "ngram-pairs")
    unstage(beyond)
    found = None if pairs.isEmpty() else _verified(pairs, sets, parts, of)
    if not close.isEmpty():
        found = close if found is None else close.unionByName(found)
    links.add(found, label=not last)
    rest = stage(posted.filter("large").select(F.col("a").alias("g"), F.col("e").alias("h"), "band", "c", "n", (F.col("d") / F.col("n")).alias("first"), F.lit(1.0).alias("ratio")), "ngram-live")
    return None if rest.isEmpty() else rest


def ngram_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, parts: int = 80, of: int = 100, exact: bool = False, row_col: str | None = None) -> DataFrame:
    """Groups of documents that links of Jaccard similarity >= parts / of connect.

    Returns a row for each row of ``docs``: (doc_id, n_shingles, component_id, class_id, group_id), n_links
    with ``exact`` and with ``row_col`` the whole number that tells rows of one id apart. group_id names
    the group by its smallest class: null without words.
    A set holds the distinct k-word sequences (words: runs outside of [\\x20\\x09-\\x0D], A-Z
    lower-cased); with fewer words, the whole text as one; a null text or one without words has an
    empty set, links with nothing and is its own component. component_id is the smallest id that
    links reach. Rows that repeat an id are rows of their own; a null id is in its group but never
    names it. class_id tells equal sets (a 64-bit fingerprint, widened where two sets share one). Links that a group's connectedness
    makes needless are not verified, but with ``exact`` all are: n_links is then the number of other
    classes that a row's class links with.
    Extra columns are not read. Sets are compared by 64-bit hashes of their n-grams.

    How it scales: texts are read again for each step and never shuffled.
    1. Sets are hashed; n-grams that repeat within a task are counted over all documents into a
       frequency table of fixed size, which orders every set rarest first.
    2. Each class posts its adaptive prefix. N-grams with one holder go at once; the others form
       buckets. Postings of heavy n-grams are spread, so no task gathers them.
    3. Small buckets make all their pairs; those that share as many prefix n-grams as their prefixes
       demand are verified. A large bucket has a leader: its members' sets are compared with the
       leader's alone, and members of different components are then found by an index of their
       differences from it (``_by_leader``), in turn with leaders where that has large buckets. So a
       group of copies costs rows in proportion to its size, and no link is lost.
       With ``exact`` all buckets make all their pairs, whose number, like that of the links, grows with
       the square of a group of near copies.
    4. Components of the links, by contraction.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row"))
    read = stage(docs.mapInArrow(_statistics(k), "doc_id long, row long, n long, c long, check long, h long, seen long"), "ngram-statistics")
    counts, known = read.filter("h is not null").select("h", "seen"), read.filter("h is null").select("doc_id", "row", "n", "c", "check")
    # Different sets of one fingerprint: about documents ** 2 / 2 ** 65 of them.
    shared = known.filter("c is not null").groupBy("c").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low < high")
    twins = frozenset(r.c for r in shared.select("c").collect())
    if twins:
        known = known.withColumn("c", F.when(F.col("c").isin(*twins), F.col("c").bitwiseXOR(F.col("check"))).otherwise(F.col("c")))
    frequency = spark.sparkContext.broadcast(_frequency_table(counts))

    posted = docs.select("text").mapInArrow(_postings(k, parts, of, frequency, twins), "h long, c long, nm long, spread short")
    bucket = Window.partitionBy("h", "spread")
    posted = posted.withColumns({"low": F.min("c").over(bucket), "high": F.max("c").over(bucket)}).filter("spread > 0 or low < high")
    # Equal sets were posted once a task: one of each stays.
    raw = stage(posted.select("h", "spread", "c", "nm").distinct(), "ngram-postings")
    drop_shuffles(spark)
    posted = raw.select("h", "spread", "c", F.shiftright("nm", 32).alias("n"), F.shiftright("nm", 8).bitwiseAND((1 << 24) - 1).alias("at"), F.col("nm").bitwiseAND(255).alias("m"))
    held = stage(posted.groupBy("h").agg(F.count("*").alias("held"), F.min("m").alias("low")), "ngram-held")
    # How far a set can reach: of its n-grams up to place ``at`` only those that others hold are shared,
    # and a partner shares at least the lowest demand among its buckets. That bounds any overlap, and
    # an overlap bounds the size of the partner.
    own = Window.partitionBy("c")
    turned = posted.join(held, "h").withColumns({"turn": F.row_number().over(own.orderBy("at", "h")), "low": F.min("low").over(own)})
    most = F.max(F.when(F.col("turn") >= F.col("low"), F.col("turn") + F.col("n") - F.col("at"))).over(own)
    reach = F.floor(most * (of + parts) / parts).cast("long") - F.col("n")
    sized = turned.withColumn("reach", reach).filter(of * F.col("reach") >= parts * F.col("n"))
    sized = sized.withColumn("large", F.lit(not exact) & ((F.col("spread") > 0) | (F.col("held") > SMALL_BUCKET)))
    # N-grams that no other set holds come first: a set with few of them stands in the middle of its copies.
    sized = sized.withColumn("lone", F.max(F.col("at") - F.col("turn")).over(own) / F.col("n"))
    sized = sized.withColumn("g", F.sum(F.col("large").cast("long")).over(own))
    parted = stage(sized.select("h", "c", "n", "at", "m", "reach", "large", "g", "lone"), "ngram-buckets")
    unstage(held)
    unstage(raw)
    small, large = parted.filter("not large"), parted.filter("large")

    # The first n-gram that a pair shares is in a small bucket or in a large one. Of what it shares in
    # small ones the pair's large buckets (g) may be missing.
    two = small.select("h", *(F.col(x).alias(f"{x}2") for x in ("c", "n", "at", "m", "reach", "g")))
    near = (of * F.least("n", "n2") >= parts * F.greatest("n", "n2")) & (F.col("n2") <= F.col("reach")) & (F.col("n") <= F.col("reach2"))
    # N-grams stand in one order for all: what two sets share lies before the shared one's place in both, or behind it.
    around = F.least("at", "at2") + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    near = near & ((of + parts) * around >= parts * (F.col("n") + F.col("n2")))
    more = F.least(F.min("g"), F.min("g2"))
    # What lies behind the last shared n-gram may all be shared.
    rest = F.least(F.min(F.col("n") - F.col("at")), F.min(F.col("n2") - F.col("at2"))) + more
    counted = moved(small).join(two, "h").filter((F.col("c") < F.col("c2")) & near).groupBy(F.col("c").alias("a"), F.col("c2").alias("b")).agg(
        F.count("*").alias("shared"), (F.least(F.min("m"), F.min("m2")) - more).alias("need"), rest.alias("rest"), F.min(F.col("n") + F.col("n2")).alias("size")
    )
    enough = (F.col("shared") >= F.col("need")) & ((of + parts) * (F.col("shared") + F.col("rest")) >= parts * F.col("size"))
    pairs = stage(counted.filter(enough).select("a", "b"), "ngram-pairs")
    # A first shared n-gram at a late place leaves little to share, which bounds the partner's size.
    ratio = (F.floor((F.col("n") - F.col("at") + 1) * (of + parts) / parts) - F.col("n")) / F.col("n")
    large = large.withColumn("ratio", F.least(ratio, F.col("reach") / F.col("n"))).filter(of * F.col("ratio") >= parts * 0.999999)
    # Two sets that can link are in a common band of sizes, so a leader is about its members' size.
    band = F.sequence(F.floor(F.log2("n")).cast("int"), F.floor(F.log2(F.col("n") * of / parts)).cast("int"))
    live = large.select(F.lit(0).cast("long").alias("g"), "h", F.explode(band).alias("band"), "c", "n", F.col("lone").alias("first"), "ratio")
    led = _leaders(live.withColumn("comp", F.col("c")))
    unstage(parted)
    sets = _candidate_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("c")), led.select(F.explode(F.array("a", "b")).alias("c")), k, frequency, twins)
    links = _Links()
    links.add(_verified(pairs, sets, parts, of))
    unstage(pairs)

    level = 0
    while not led.isEmpty():
        level += 1
        live = _by_leader(led, sets, links, parts, of, last=level == LEVELS)
        unstage(led)
        if live is None:
            break
        led = _leaders(links.labelled(live))
        unstage(live)

    unstage(sets)
    component = None if links.all is None else connected_components(links.all, "c", "comp")
    links = links.all
    classes = known.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    if component is None:
        named = classes.filter("rows > 1").select("c", F.col("first").alias("component_id"), F.col("c").alias("comp"), F.lit(0).cast("long").alias("n_links"))
    else:
        degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count("*").alias("n_links"))
        linked = classes.join(moved(component), "c", "left").filter("rows > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "c"))
        smallest = linked.groupBy("comp").agg(F.min("first").alias("component_id"))
        named = linked.join(smallest, "comp").join(degree, "c", "left").select("c", "component_id", "comp", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = stage(named, "ngram-named")
    # A key that can't match spreads the rows without words.
    own = known.withColumn("key", F.coalesce("c", F.xxhash64("doc_id")))
    out = own.join(moved(named.withColumnRenamed("c", "key")), "key", "left")
    none = F.col("c").isNull()
    out = out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(none, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.col("c").alias("class_id"), F.coalesce("comp", "c").alias("group_id"), *(["row"] if row_col else []), F.when(none, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
    )
    return out if exact else out.drop("n_links")

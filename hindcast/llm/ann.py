"""Nearest neighbours by cross-polytope hashing: pseudo-rotations, multiprobe tables, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Components (vectors times their length) of candidates and of queries that meet in one task's block.
CANDIDATE_BLOCK, QUERY_BLOCK = 1 << 22, 1 << 18
#: Classes that a bucket holds on average: more vectors make longer hashes, not fuller buckets.
BUCKET = 3
#: Cross-polytopes that a hash has at most.
MOST_LEVELS = 8
#: Pairs that are scored at once, and sums of projections that are ranked at once.
PAIRS, SUMS = 1 << 16, 1 << 22


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-rotation H D3 H D2 H D1 with random signs that depend on the table."""
    signs = np.random.default_rng([seed, table, x.shape[1]]).choice([-1.0, 1.0], (3, x.shape[1]))
    for d in signs:
        x = hadamard(x * d)
    return x


def prepare(v: np.ndarray, norms: tuple[float, float], query: bool) -> np.ndarray:
    """Unit vectors whose angles order candidates by inner product, padded to a power of two.

    Where lengths differ, candidates get one more component that fills them up to the largest length.
    """
    least, most = norms
    v = v / most if not query else v / np.linalg.norm(v, axis=1, keepdims=True)
    if most - least > 1e-6 * most:
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))
        v = np.concatenate([v, rest[:, None]], axis=1)
    width = 1 << max(0, v.shape[1] - 1).bit_length()
    return np.pad(v, ((0, 0), (0, width - v.shape[1])))


def levels(width: int, classes: int) -> list[int]:
    """Signed axes of each cross-polytope of a hash, so that a bucket holds about ``BUCKET`` classes.

    All but the last look at a whole rotation; the last one looks at as many coordinates as are needed.
    """
    want, out = max(2.0, classes / BUCKET), []
    while want >= 2 and len(out) < MOST_LEVELS:
        out.append(min(2 * width, 1 << int(np.log2(want))))
        want /= out[-1]
    return out


def probe_count(axes: list[int], probes: float) -> int:
    """Buckets of a table that a query looks into: ``probes`` times the square root of all."""
    every = int(np.prod(axes, dtype=np.float64))
    return min(every, max(1, int(np.ceil(probes * every**0.5))))


def _signed(x: np.ndarray, axes: list[int], table: int, seed: int) -> Iterator[np.ndarray]:
    """Projections on the signed axes of each level of a table."""
    for level, n in enumerate(axes):
        turned = rotate(x, table * MOST_LEVELS + level, seed)[:, : n // 2]
        yield np.concatenate([turned, -turned], axis=1)


def place_candidates(x: np.ndarray, axes: list[int], table: int, seed: int) -> np.ndarray:
    """Buckets of prepared vectors in a table: the number formed by the nearest axis of each level."""
    at = np.zeros(len(x), np.int64)
    for n, near in zip(axes, _signed(x, axes, table, seed), strict=True):
        at = at * n + np.argmax(near, axis=1)
    return at


def place_queries(x: np.ndarray, axes: list[int], table: int, probes: int, seed: int) -> np.ndarray:
    """A row for each prepared vector: the ``probes`` buckets of a table that lose least projection in all levels together."""
    rows = max(1, SUMS // (probes * max(axes)))
    found = []
    for i in range(0, len(x), rows):
        at, total = np.zeros((len(x[i : i + rows]), 1), np.int64), 0.0
        for n, near in zip(axes, _signed(x[i : i + rows], axes, table, seed), strict=True):
            sums = (total + near[:, None, :] if np.isscalar(total) else total[:, :, None] + near[:, None, :]).reshape(len(near), -1)
            keys = (at[:, :, None] * n + np.arange(n)).reshape(len(near), -1)
            if sums.shape[1] > probes:
                best = np.argpartition(-sums, probes - 1, axis=1)[:, :probes]
                sums, keys = np.take_along_axis(sums, best, 1), np.take_along_axis(keys, best, 1)
            at, total = keys, sums
        found.append(at)
    return np.concatenate(found) if found else np.zeros((0, probes), np.int64)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length in a column."""
    length = np.asarray(pa.compute.list_value_length(column))
    out = []
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        out.append((rows, np.asarray(column.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), n)))
    return out


def _place(df: DataFrame, query: bool, norms: dict, tables: int, probes: float, seed: int) -> DataFrame:
    """Rows (dim, part, buckets, cls, first, v): where each vector is kept or looked up.

    The buckets of a table are dealt to parts of about a block of candidates, by all levels of
    the hash but the last; a query goes once to each part in which it probes any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                rest = batch.slice(i, 2000)
                for rows, v in _matrix(rest.column("v")):
                    least, most, classes = norms[v.shape[1]]
                    x = prepare(v, (least, most), query)
                    axes = levels(x.shape[1], classes)
                    parts = -(-classes // max(1, CANDIDATE_BLOCK // v.shape[1]))
                    for table in range(tables):
                        found = place_queries(x, axes, table, probe_count(axes, probes), seed) if query else place_candidates(x, axes, table, seed)[:, None]
                        row, bucket = np.repeat(rows, found.shape[1]), found.ravel()
                        piece = table * parts + bucket // axes[-1] % parts
                        order = np.lexsort((bucket, piece, row))
                        row, bucket, piece = row[order], bucket[order], piece[order]
                        starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])))
                        row, piece = row[starts], piece[starts]
                        kept = rest.take(pa.array(row))
                        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(bucket)).astype(np.int32)), pa.array(bucket))
                        head = [pa.array(np.full(len(row), v.shape[1], np.int32)), pa.array(piece), lists]
                        yield pa.RecordBatch.from_arrays([*head, *(kept.column(c) for c in ("cls", "first", "v"))], ["dim", "part", "buckets", "cls", "first", "v"])

    kind = dict(df.dtypes)["v"]
    return df.select("cls", "first", "v").mapInArrow(run, f"dim int, part long, buckets array<long>, cls long, first long, v {kind}")


def _meeting(c: pd.DataFrame, q: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query row, candidate row) of the pairs with a common bucket, about ``PAIRS`` at a time, a query's all together; candidates are ordered by bucket."""
    place = c["bucket"].to_numpy()
    row, probe = np.repeat(np.arange(len(q)), q["buckets"].map(len)), np.concatenate(q["buckets"].to_list())
    first = np.searchsorted(place, probe)
    size = np.searchsorted(place, probe, side="right") - first
    at = np.append(0, np.cumsum(np.bincount(row, size, len(q)).astype(np.int64)))
    i = 0
    while i < len(q):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PAIRS, side="right")) - 1)
        use = (row >= i) & (row < j)
        n, start = size[use], first[use]
        yield np.repeat(row[use], n), np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        i = j


def _score(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (q, cls, first, score): the best k candidates of each query in each block, by exact inner product."""

    def block(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"q": [], "cls": [], "first": [], "score": []}).astype({"q": "int64", "cls": "int64", "first": "int64", "score": "float64"})]
        if c.empty or q.empty:
            return found[0]
        c = c.assign(bucket=c["buckets"].str[0]).sort_values("bucket", kind="stable")
        cv, qv = np.stack(c["v"].to_numpy()).astype(np.float64), np.stack(q["v"].to_numpy()).astype(np.float64)
        cls, first, asked = c["cls"].to_numpy(), c["first"].to_numpy(), q["cls"].to_numpy()
        for qi, ci in _meeting(c, q):
            # One fixed order of summation: a score doesn't depend on the block it was found in.
            score = (qv[qi] * cv[ci]).sum(axis=1)
            order = np.lexsort((cls[ci], first[ci], -score, qi))
            qi, ci, score = qi[order], ci[order], score[order]
            near = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            found.append(pd.DataFrame({"q": asked[qi[near]], "cls": cls[ci[near]], "first": first[ci[near]], "score": score[near]}))
        return pd.concat(found)

    key = ["dim", "part", "c_block", "q_block"]
    return candidates.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(block, "q long, cls long, first long, score double")


def _cut(candidates: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with (c_block, q_block): parts over a block's size are cut, and each block of a side meets every one of the other.

    The list of such parts stays a table; the size it has decides how it is joined.
    """
    def blocks(df: DataFrame, most: int, name: str) -> DataFrame:
        n = F.ceil(F.col("count") / F.greatest(F.lit(1), F.floor(most / F.col("dim")))).cast("int")
        return df.groupBy("dim", "part").count().select("dim", "part", n.alias(name)).filter(F.col(name) > 1)

    counts = [blocks(candidates, CANDIDATE_BLOCK, "n_c"), blocks(queries, QUERY_BLOCK, "n_q")]
    large = stage(counts[0].join(counts[1], ["dim", "part"], "full"), "ann-large")

    def side(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        n = lambda c: F.coalesce(c, F.lit(1))
        df = df.join(large, ["dim", "part"], "left").withColumn(own, F.pmod(F.xxhash64("cls"), n(F.col(own_n))).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), n(F.col(other_n)) - 1))).drop("n_c", "n_q")

    return side(candidates, "c_block", "n_c", "q_block", "n_q"), side(queries, "q_block", "n_q", "c_block", "n_c")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = 16, probes: float = 0.85, seed: int = 7) -> DataFrame:
    """The k nearest rows of each query row by inner product: (query_id, rank, vec_id, score).

    is_query: which rows are queries. Candidates are all rows with another id; fewer than k are
    returned only if there are fewer. Nearest first, ties to the smaller id. Vectors that are null,
    empty, zero or hold a null or non-finite component, and null ids, take no part; vectors meet
    only those of their length. Repeated rows (same id and vector) count once. Scores are exact, in
    double precision. Extra columns are not read.

    Equal vectors form one class that keeps its k + 1 smallest ids: no other id of it can be among
    the k nearest. So a vector that a third of the rows share is hashed and scored once. Every class
    is indexed, in each of ``tables`` tables, by cross-polytopes of as many pseudo-rotations as keep
    about ``BUCKET`` classes in a bucket. A query looks into ``probes`` times the square root of a
    table's number of buckets, those that lose least projection over all levels. Parts over
    a block's size are cut before vectors meet; a query that found fewer than k + 1 ids is then scored
    against all classes, in blocks.
    """
    kind = dict(vectors.dtypes)[vector_col]
    e = F.col(vector_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})

    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    ids = ranked.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.max("is_q").alias("is_q")).join(ids, ["h1", "h2"])
    classes = stage(classes.withColumns({"cls": F.monotonically_increasing_id(), "first": F.col("ids")[0]}), "ann-classes")
    length = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    counted = classes.groupBy(F.size("v").alias("dim")).agg(F.min(length).alias("least"), F.max(length).alias("most"), F.count("*").alias("n"))
    norms = {r.dim: (r.least, r.most, r.n) for r in counted.collect()}
    queries = classes.filter("is_q")

    def best(pairs: DataFrame) -> DataFrame:
        """(q, near): the k + 1 nearest ids of each query class; a pair found in several tables has one rank."""
        pairs = pairs.withColumn("r", F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), "first", "cls"))).filter(F.col("r") <= k + 1)
        pairs = pairs.select("q", "cls", "score").distinct().join(classes.select("cls", "ids"), "cls")
        near = pairs.select("q", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("down"), i.alias("vec_id")))).alias("n"))
        return near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k + 1).alias("near"))

    place = lambda df, query: _place(df, query, norms, tables, probes, seed)
    result = stage(best(_score(*_cut(place(classes, False), place(queries, True)), k + 1)), "ann-found")
    few = queries.join(result, queries.cls == result.q, "left").filter(F.coalesce(F.size("near"), F.lit(0)) < k + 1).select("cls", "first", "v")
    few = stage(few, "ann-few")
    if not few.isEmpty():
        whole = lambda df: df.select(F.size("v").alias("dim"), F.lit(0).cast("long").alias("part"), F.array(F.lit(0).cast("long")).alias("buckets"), "cls", "first", "v")
        result = result.join(few.select(F.col("cls").alias("q")), "q", "left_anti").unionByName(best(_score(*_cut(whole(classes), whole(few)), k + 1)))

    asked = rows.filter("is_q").select("vec_id", "h1", "h2").distinct().join(queries.select("h1", "h2", F.col("cls").alias("q")), ["h1", "h2"])
    own = asked.join(result, "q").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("vec_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("p", "n")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.down")).alias("score"))

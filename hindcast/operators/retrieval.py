"""Nearest past states: distance, pool, constrained selection and what followed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import HORIZONS, LEAST_POOL, MAX_PER_DATE, METRIC, MIN_COVERAGE, MIN_GAP, MIN_HISTORY, POOL_MULTIPLE, distance_weights

#: Queries are sent to the library in blocks of at most this many (25 floats each).
QUERY_BLOCK = 4_000
#: A task scores this many of them at a time.
QUERY_SLICE = 64


def weights_table(spark, weights: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((weights or distance_weights()).items()), "feature string, w double")


def distances(library: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, entity, session_idx, dist) of the library rows that one or a few queries may see.

    library: (entity, session_idx, z array of METRIC); queries: (query_id, z array, j_low, j_high), with the
    session bounds of embargo and restriction: a request's few rows, sent to the library's tasks. Features
    count where both sides have them; a row with less than MIN_COVERAGE of the weight is rejected. Every
    step is within a library row, so nothing is shuffled. For many queries see ``batched_pool``.
    """
    weights = distance_weights()
    asked = queries.select("query_id", F.col("z").alias("qz"), "j_low", "j_high")
    met = library.join(F.broadcast(asked), F.col("session_idx").between(F.col("j_low"), F.col("j_high")))
    both = [F.col("z")[i].isNotNull() & F.col("qz")[i].isNotNull() for i in range(len(METRIC))]
    gaps = [F.col("qz")[i].cast("double") - F.col("z")[i].cast("double") for i in range(len(METRIC))]
    total = sum((F.when(b, F.lit(weights[f])).otherwise(0.0) for b, f in zip(both, METRIC)), F.lit(0.0))
    square = sum((F.when(b, F.lit(weights[f]) * g * g).otherwise(0.0) for b, g, f in zip(both, gaps, METRIC)), F.lit(0.0))
    summed = met.select("query_id", "entity", "session_idx", square.alias("s"), total.alias("ws"))
    return summed.filter(F.col("ws") >= MIN_COVERAGE - 1e-12).select("query_id", "entity", "session_idx", F.sqrt(F.col("s") / F.col("ws")).alias("dist"))


def query_vectors(long: DataFrame) -> DataFrame:
    """(query_id, z array of METRIC, j_low, j_high) of a few queries with a row for each feature (query_id, feature, z, j_low, j_high)."""
    as_map = F.map_from_entries(F.collect_list(F.struct("feature", F.col("z").cast("float"))))
    wide = long.filter(F.col("feature").isin(METRIC)).groupBy("query_id", "j_low", "j_high").agg(as_map.alias("m"))  # 25 rows of a query at most
    return wide.select("query_id", F.array(*(F.col("m")[f] for f in METRIC)).alias("z"), "j_low", "j_high")


def pool_size(k: int) -> int:
    return max(k * POOL_MULTIPLE, LEAST_POOL)


def pool(found: DataFrame, k: int) -> DataFrame:
    """The nearest rows of each query, with their rank; ties go by entity and session.

    With the session's window group limit at the pool's size or more, each task keeps its own nearest
    before the shuffle.
    """
    limit = "spark.sql.optimizer.windowGroupLimitThreshold"
    conf = found.sparkSession.conf
    if int(conf.get(limit)) < pool_size(k):
        conf.set(limit, str(pool_size(k)))
    w = Window.partitionBy("query_id").orderBy("dist", "entity", "session_idx")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= pool_size(k))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of arrays of one length, NaN where an element is null."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def batched_pool(library: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The pool of many queries at once: (query_id, entity, session_idx, dist, rn).

    library: (entity, session_idx, z array); queries: (query_id, z array, j_low, j_high). Queries, a
    stated set, go to the library's tasks in blocks of QUERY_BLOCK; each task keeps its own nearest,
    so what is shuffled is bounded by tasks x pool, not by pairs. Squared distances of a slice of
    queries to a batch of rows come from matrix products; those that may be among the nearest are
    then computed as differences.
    """
    weights = np.array([distance_weights()[f] for f in METRIC])
    most, spark = pool_size(k), library.sparkSession
    asked = queries.select("query_id", F.col("j_low").cast("int"), F.col("j_high").cast("int"), F.col("z").cast("array<double>").alias("z"))
    out = None
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for block in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).toArrow().combine_chunks()
        column = lambda c, rows=rows: rows.column(c).combine_chunks()
        shared = spark.sparkContext.broadcast((*(column(c).to_numpy() for c in ("query_id", "j_low", "j_high")), _matrix(column("z"), len(METRIC))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, low, high, q = shared.value
            has_q, q0 = np.isfinite(q).astype(float), np.nan_to_num(q)
            for batch in batches:
                c = _matrix(batch.column("z"), len(METRIC))
                j, entity = batch.column("session_idx").to_numpy(), np.array(batch.column("entity").to_pylist(), object)
                has_c, c0 = np.isfinite(c).astype(float), np.nan_to_num(c)
                found = [[], [], []]
                for first in range(0, len(ids), QUERY_SLICE):
                    part = slice(first, first + QUERY_SLICE)
                    covered = (has_q[part] * weights) @ has_c.T
                    near = ((q0[part] ** 2 * weights) @ has_c.T + (has_q[part] * weights) @ (c0**2).T - 2 * (q0[part] * weights) @ c0.T) / np.maximum(covered, 1e-9)
                    near[(covered < MIN_COVERAGE - 1e-12) | (j < low[part, None]) | (j > high[part, None])] = np.inf
                    for i, row in enumerate(near):
                        bound = np.partition(row, most - 1)[most - 1] if len(row) > most else np.inf
                        at = np.flatnonzero(row <= min(bound + 1e-6, 1e300))
                        both = has_c[at] * has_q[first + i]
                        gap = (c0[at] - q0[first + i]) * both
                        dist = np.sqrt((gap * gap * weights).sum(axis=1) / covered[i, at])
                        if len(at) > most:
                            keep = np.lexsort((j[at], entity[at].astype(str), dist))[:most]
                            at, dist = at[keep], dist[keep]
                        for held, x in zip(found, (np.full(len(at), ids[first + i]), at, dist)):
                            held.append(x)
                if found[1]:
                    query, at, dist = map(np.concatenate, found)
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(entity[at], pa.string()), pa.array(j[at], pa.int32()), pa.array(dist, pa.float64())], ["query_id", "entity", "session_idx", "dist"])

        made = library.select("entity", "session_idx", "z").mapInArrow(run, "query_id long, entity string, session_idx int, dist double")
        out = made if out is None else out.unionByName(made)
    return pool(out, k)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, rank) of the k nearest (vec_id, v) to each of (query_id, v) by Euclidean distance, itself left out.

    Queries, a stated set, go to the vectors' tasks in blocks of QUERY_BLOCK; a task keeps its own k nearest
    of each query, so what is shuffled is bounded by tasks x queries x k. Matrix products find what may
    be among them, and differences decide; ties go to the smaller vec_id.
    """
    spark, n_blocks, out = vectors.sparkSession, max(1, -(-queries.count() // QUERY_BLOCK)), None
    for block in range(n_blocks):
        rows = queries.select("query_id", F.col("v").cast("array<double>").alias("v")).filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).toArrow().combine_chunks()
        ids = rows.column("query_id").to_numpy()
        shared = spark.sparkContext.broadcast((ids, _matrix(rows.column("v").combine_chunks(), len(rows.column("v")[0]) if len(ids) else 1)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches if len(ids) else ():
                own, c = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), q.shape[1])
                found = [[], [], []]
                for first in range(0, len(ids), QUERY_SLICE):
                    part = q[first : first + QUERY_SLICE]
                    near = (part**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * part @ c.T
                    near[own == ids[first : first + QUERY_SLICE, None]] = np.inf
                    for i, row in enumerate(near):
                        bound = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
                        at = np.flatnonzero(row <= min(bound * (1 + 1e-9) + 1e-9, 1e300))
                        d = ((c[at] - q[first + i]) ** 2).sum(axis=1)
                        keep = np.lexsort((own[at], d))[:k]
                        for held, x in zip(found, (np.full(len(keep), ids[first + i]), own[at[keep]], d[keep])):
                            held.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], ["query_id", "vec_id", "d"])

        made = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "query_id long, vec_id long, d double")
        out = made if out is None else out.unionByName(made)
    w = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank")


def greedy(pooled: DataFrame, k: int, most_a_session: int = MAX_PER_DATE, gap: int = MIN_GAP) -> DataFrame:
    """The k chosen of each query's pool: in order of rank, at most ``most_a_session`` of one session and
    none within ``gap`` sessions of a chosen one of its entity.

    The choice depends on what was chosen, so it is a fold over one query's pool, which pool() bounds.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rn")
        by_session: dict[int, int] = {}
        by_entity: dict[str, list[int]] = {}
        kept = []
        for at, (entity, j) in enumerate(zip(rows["entity"], rows["session_idx"])):
            if len(kept) >= k:
                break
            if by_session.get(j, 0) < most_a_session and all(abs(j - other) >= gap for other in by_entity.get(entity, ())):
                by_session[j] = by_session.get(j, 0) + 1
                by_entity.setdefault(entity, []).append(j)
                kept.append(at)
        return rows.iloc[kept]

    return pooled.groupBy("query_id").applyInPandas(choose, pooled.schema)


def outcomes(grid: DataFrame, horizon: int, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(entity, session_idx, fwd_<h>..., mae, mfe) on the dense calendar.

    Forward returns are on the adjusted close; excursions are traded lows and highs of the next
    ``horizon`` sessions over the traded close. Nothing is there without a positive adjusted close.
    """
    by = Window.partitionBy("entity").orderBy("session_idx")
    ahead = by.rowsBetween(1, horizon)
    a, c = F.col("a"), F.col("c")
    fwd = [F.when((a > 0) & (F.lead("a", h).over(by) > 0), F.lead("a", h).over(by) / a - 1).alias(f"fwd_{h}") for h in horizons]
    excursion = lambda agg: F.when((a > 0) & (c > 0), agg / c - 1)
    return grid.select("entity", "session_idx", *fwd, excursion(F.min("l").over(ahead)).alias("mae"), excursion(F.max("h").over(ahead)).alias("mfe"))


def bounds(calendar: DataFrame, q: Column, horizon: int, date_from=None, date_to=None) -> tuple[Column, Column]:
    """Session bounds of what a query at session q may see, given the calendar's dates.

    A limit that no session meets is ignored.
    """
    low, high = F.lit(MIN_HISTORY), q - horizon
    row = calendar.agg(F.min(F.when(F.col("session_date") >= F.lit(date_from), F.col("session_idx"))).alias("a"), F.max(F.when(F.col("session_date") <= F.lit(date_to), F.col("session_idx"))).alias("b")).first() if date_from or date_to else None
    if row and row.a is not None:
        low = F.greatest(low, F.lit(row.a))
    if row and row.b is not None:
        high = F.least(high, F.lit(row.b))
    return low, high


def group_counts(picks: DataFrame, dates: DataFrame) -> DataFrame:
    """(kind, value, n, n_sessions, n_entities) of chosen states by entity, by year and over all.

    dates: (session_idx, session_date).
    """
    rows = picks.join(dates, "session_idx").select("entity", "session_idx", F.year("session_date").cast("string").alias("year"))
    each = rows.select("entity", "session_idx", F.explode(F.create_map(F.lit("entity"), F.col("entity"), F.lit("year"), F.col("year"), F.lit("all"), F.lit("all"))).alias("kind", "value"))
    return each.groupBy("kind", "value").agg(F.count("*").alias("n"), F.countDistinct("session_idx").alias("n_sessions"), F.countDistinct("entity").alias("n_entities"))

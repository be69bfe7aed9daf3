"""Requests that carry over from turn to turn of a conversation, each value with its owner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields that carry over and are reported, and what describes a field and goes with it.
NAMED = ("symbol", "horizon", "date", "k", "tolerance", "direction")
PROVENANCE = {"horizon_raw": "horizon", "horizon_how": "horizon", "date_how": "date", "direction_matched": "direction", "sector_proxy": "symbol", "ambiguous_alias": "symbol"}


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def carry_context(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each turn's request with what it inherits: (conv, order, NAMED, PROVENANCE, language, inherited, changed).

    turns: (conv, order, NAMED and PROVENANCE as strings, elsewhere boolean, language, language_request).
    A field that a turn leaves empty (null or '') has the conversation's last value; one that describes a
    field comes from the turn that the field comes from, or a later one that gives it anew, and never stays
    with another turn's value. A turn that names something not held (``elsewhere``) without a symbol breaks the topic:
    nothing is inherited, and later turns inherit from it on. inherited and changed list the NAMED
    fields that a turn took over, and those that it gave another value; both are empty at the first turn
    and at a break. A requested language holds from its turn on, across breaks; before any, each turn has its own.

    Turns of one place are ordered by their fields. Everything is a running value over a conversation's
    turns, in windows that stream through them and can spill.
    """
    fields = (*NAMED, *PROVENANCE)
    rows = turns.select(conv, order, *(_filled(F.col(c)).alias(c) for c in fields), F.coalesce("elsewhere", F.lit(False)).alias("elsewhere"), "language", _filled(F.col("language_request")).alias("language_request"))
    along = Window.partitionBy(conv).orderBy(F.col(order).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in (*fields, "elsewhere", "language", "language_request"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.col("elsewhere") & F.col("symbol").isNull()
    rows = rows.withColumns({"place": F.count("*").over(along), "topic": F.sum(broken.cast("int")).over(along), "broken": broken, "asked": F.last("language_request", True).over(along)})
    topic = Window.partitionBy(conv, "topic").orderBy("place")
    so_far = topic.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"now_{c}": F.last(c, True).over(so_far) for c in NAMED} | {f"owner_{c}": F.count(c).over(so_far) for c in NAMED})
    rows = rows.withColumns({f"was_{c}": F.lag(f"now_{c}").over(topic) for c in NAMED})
    kept = {}
    for c, owner in PROVENANCE.items():
        own = Window.partitionBy(conv, "topic", f"owner_{owner}").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        kept[f"now_{c}"] = F.when(F.col(f"owner_{owner}") > 0, F.last(c, True).over(own)).otherwise(F.col(c))
    rows = rows.withColumns(kept)
    taken = F.array(*(F.when(F.col(c).isNull() & F.col(f"was_{c}").isNotNull(), F.lit(c)) for c in NAMED))
    new = F.array(*(F.when(F.col(c) != F.col(f"was_{c}"), F.lit(c)) for c in NAMED))
    return rows.select(conv, order, *(F.col(f"now_{c}").alias(c) for c in fields), F.coalesce("asked", "language").alias("language"), F.array_compact(taken).alias("inherited"), F.array_compact(new).alias("changed"))


# --- repairs of misspelt names ------------------------------------------------------------------

#: Words up to this length are indexed by deletions (191 of the longest), longer ones by three pieces.
LONG = 20
LEAST_TOKEN, LEAST_SYMBOL, SHORT = 4, 3, 5


def _without_one(s: Column) -> Column:
    return F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(2), F.length(s)), lambda i: F.concat(F.substring(s, 1, i - 1), F.substring(s, i + 1, F.lit(LONG + 9))))).otherwise(F.array().cast("array<string>"))


def deletions(s: Column) -> Column:
    """The distinct strings that s becomes by leaving out up to two characters, its first never among them."""
    one = _without_one(s)
    return F.array_distinct(F.concat(F.array(s), one, F.flatten(F.transform(one, _without_one))))


def _piece(s: Column, n: Column, i: int, shift: int = 0) -> Column:
    """The i-th third of a word of n characters, keyed with both; read ``shift`` characters on."""
    start, end = F.floor(n * i / 3).cast("int"), F.floor(n * (i + 1) / 3).cast("int")
    return F.when(start + shift >= 0, F.concat_ws(":", F.lit(str(i)), n.cast("string"), F.substring(s, start + shift + 1, end - start)))


def suggest(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """(token, symbol, distance): the only symbol nearest to each token, for tokens that have one.

    tokens, symbols: (word) in capitals, repeats and nulls allowed. A token has at least LEAST_TOKEN
    characters out of A-Z, 0-9, dot and dash; a symbol has at least LEAST_SYMBOL and the token's first character.
    Up to one edit is repaired in tokens of SHORT characters or fewer, up to two in longer ones; two
    symbols at the same least distance repair nothing.

    Words within two edits share a string that both become by two deletions at most, or, if long, one of
    three pieces of the symbol shifted by up to two. So tokens and symbols meet by such keys, an equi-join, and
    only what meets is compared.
    """
    asked = tokens.select(F.col("word").alias("token")).filter(F.col("token").rlike(r"^[A-Z0-9.\-]+$") & (F.length("token") >= LEAST_TOKEN)).distinct()
    known = symbols.select(F.col("word").alias("symbol")).filter(F.length("symbol") >= LEAST_SYMBOL).distinct()
    n, m = F.length("token"), F.length("symbol")
    by_deletion = [asked.filter(n <= LONG).select("token", F.explode(deletions(F.col("token"))).alias("key")), known.filter(m <= LONG + 2).select("symbol", F.explode(deletions(F.col("symbol"))).alias("key"))]
    probes = F.array(*(_piece(F.col("token"), n + d, i, shift) for d in range(-2, 3) for i in range(3) for shift in range(-2, 3)))
    by_piece = [asked.filter(n > LONG).select("token", F.explode(F.array_distinct(F.array_compact(probes))).alias("key")), known.filter(m > LONG - 2).select("symbol", F.explode(F.array(*(_piece(F.col("symbol"), m, i) for i in range(3)))).alias("key"))]
    met = reduce(DataFrame.unionByName, (a.join(b, "key").select("token", "symbol") for a, b in (by_deletion, by_piece)))
    met = met.filter(F.substring("token", 1, 1) == F.substring("symbol", 1, 1)).distinct()
    most = F.when(F.length("token") <= SHORT, 1).otherwise(2)
    near = met.withColumn("distance", F.levenshtein("token", "symbol")).filter(F.col("distance") <= most)
    best = near.groupBy("token").agg(F.min(F.struct("distance", "symbol")).alias("first"), F.collect_list("distance").alias("all"))  # symbols within two edits
    alone = F.size(F.filter("all", lambda d: d == F.col("first.distance"))) == 1
    return best.filter(alone).select("token", F.col("first.symbol").alias("symbol"), F.col("first.distance").alias("distance"))

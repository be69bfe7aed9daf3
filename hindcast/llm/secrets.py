"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Kinds in their listed order: pattern, group that holds the value, least length of that value.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    # A run of 20 or more; with a letter and a digit it is a span if few own it.
    "opaque": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")


def find_matches(text: Column, kind: str) -> Column:
    """Array of (kind_no, pos, before, length, value) of a kind's matches: ``before`` is the length of
    the piece of text between the match and the one before it. Lengths are in code points.

    Positions are sums over these, which are left to a window: a fold within the row would copy its
    list for each match.
    """
    pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("before"), whole.alias("whole"), value.alias("value"))
    matches = F.transform(parts, lambda p, i: F.struct(
        F.lit(list(KINDS).index(kind)).alias("kind_no"), i.alias("pos"), F.length(p["before"]).cast("long").alias("before"), F.length(p["whole"]).cast("long").alias("length"), p["value"].alias("value")
    ))
    none = F.array().cast("array<struct<kind_no:int,pos:int,before:bigint,length:bigint,value:string>>")
    quick = F.contains(text, F.lit("AKIA")) if kind == "access" else F.rlike(text, F.lit(pattern))
    return F.when(quick, matches).otherwise(none)


def _spans(matches: DataFrame) -> DataFrame:
    """Rows (row, owner, repository, kind_no, start, end, hash) of the matches that count: long enough
    values and, of opaque ones, those with a letter and a digit that overlap no base span."""
    before = Window.partitionBy("row", "kind_no").orderBy("pos")
    start = F.sum(F.col("before") + F.col("length")).over(before) - F.col("length")
    least = F.element_at(F.array(*(F.lit(x[2]) for x in KINDS.values())), F.col("kind_no") + 1)
    opaque = F.lit(list(KINDS).index("opaque"))
    whole = (F.length("value") >= least) & ((F.col("kind_no") < opaque) | (F.rlike("value", F.lit("[0-9]")) & F.rlike("value", F.lit("[A-Za-z]"))))
    spans = matches.withColumn("start", start).filter(whole)
    spans = spans.select("row", "owner", "repository", "kind_no", "start", (F.col("start") + F.col("length")).alias("end"), F.sha2("value", 256).alias("hash"))
    # The base spans that begin before an opaque run, and the next one that begins after it.
    here = Window.partitionBy("row").orderBy("start", "kind_no")
    base = lambda x: F.when(F.col("kind_no") < opaque, F.col(x))
    reached = F.max(base("end")).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    follows = F.min(base("start")).over(Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    apart = (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(follows, F.col("end")) >= F.col("end"))
    return spans.withColumn("apart", apart).filter((F.col("kind_no") < opaque) | F.col("apart")).drop("apart")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, most_owners: int = 2, most_repositories: int = 4) -> DataFrame:
    """Find secrets and tell owner-specific ones from widely copied examples.

    Returns, a row for each row of ``docs``: (doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_opaque, n_live, n_shared, found). Base spans always stay. A value whose hash at most
    ``most_owners`` distinct owners and ``most_repositories`` distinct repositories hold is live-looking,
    any other is shared; ``n_live`` and
    ``n_shared`` count the document's candidates of each sort. An opaque run (20 or more characters
    with a letter and a digit, outside of every base span) is added to ``spans`` if it is live.
    ``found`` has all spans with value hash, owners, repositories and verdict.
    A null text is empty; a null owner or repository counts as one of its own. Repeated rows are
    scanned each. Extra columns are not read.

    Plan: texts are scanned once and never shuffled; the staged scan holds matches alone. Their
    positions and overlaps are windows by row, linear in its matches. Distinct (hash, repository,
    owner) are combined before the shuffle, so a key in a third of all documents costs a row for each
    repository; verdicts join back by hash (AQE splits a hot one).
    """
    owner = F.lit("") if owner is None else F.coalesce(owner.cast("string"), F.lit(""))
    repository = owner if repository is None else F.coalesce(repository.cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    scan = docs.select(F.col(id_col).cast("long").alias("doc_id"), owner.alias("owner"), repository.alias("repository"), text.alias("text"))
    scan = scan.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", F.concat(*(find_matches(F.col("text"), k) for k in KINDS)).alias("matches"))
    scan = stage(scan, "secret-scan")  # row is fixed from here on

    each = stage(_spans(scan.select("row", "owner", "repository", F.inline("matches"))), "secret-spans")
    held = each.select("hash", "repository", "owner").distinct().groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    held = stage(held, "secret-owners")
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind_no") + 1)
    judged = (
        each.join(held, "hash")
        .withColumns({"live": live, "kind": kind})
        .filter("kind != 'opaque' or live")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind", "hash", "owners", "repositories", "live"))).alias("found"))
    )
    all_of = F.coalesce(F.col("found"), F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string,hash:string,owners:bigint,repositories:bigint,live:boolean>>"))
    of_kind = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return (
        scan.select("row", "doc_id")
        .join(judged, "row", "left")
        .withColumn("found", all_of)
        .select(
            "doc_id", *(of_kind(k).alias(f"n_{k}") for k in BASE), F.sha2(_listed(F.filter("found", lambda s: s["kind"] != "opaque")), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"),
            of_kind("opaque").alias("n_opaque"), F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_shared"), "found",
        )
    )

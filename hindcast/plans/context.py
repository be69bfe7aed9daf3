"""Queries over the turns of conversations and the words of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.context import NAMED, PROVENANCE, carry_context, suggest
from .queries import query
from .tables import Panel

#: SQL of the request that a turn's text stands for: some of its words and its length give the fields.
FIELDS = {
    "symbol": "regexp_extract(text, ' the ([a-z]{2,6}) ', 1)",
    "horizon": "CASE WHEN length(text) % 7 < 2 THEN CAST(5 * (1 + length(text) % 3) AS VARCHAR(9)) END",
    "date": "CASE WHEN length(text) % 11 = 3 THEN concat('2024-01-', CAST(10 + length(text) % 20 AS VARCHAR(9))) END",
    "k": "CASE WHEN length(text) % 5 = 1 THEN CAST(10 + length(text) % 190 AS VARCHAR(9)) END",
    "tolerance": "CASE WHEN length(text) % 13 = 4 THEN CAST(1 + length(text) % 50 AS VARCHAR(9)) END",
    "direction": "CASE WHEN text LIKE '% and %' THEN 'long' WHEN text LIKE '% not %' THEN 'short' END",
    "horizon_raw": "CASE WHEN length(text) % 7 = 1 THEN substr(text, 1, 4) END",
    "horizon_how": "CASE WHEN length(text) % 7 < 2 THEN 'count' END",
    "date_how": "CASE WHEN length(text) % 22 = 3 THEN 'iso' WHEN length(text) % 19 = 1 THEN 'rule' END",
    "direction_matched": "CASE WHEN text LIKE '% and %' AND length(text) % 2 = 0 THEN 'and' END",
    "sector_proxy": "CASE WHEN length(text) % 4 = 0 THEN substr(text, 1, 2) END",
    "ambiguous_alias": "CASE WHEN length(text) % 9 = 2 THEN substr(text, 3, 2) END",
    "elsewhere": "text LIKE '% of %'",
    "language": "CASE WHEN text LIKE '%é%' THEN 'fr' WHEN text LIKE '%ü%' THEN 'de' ELSE 'en' END",
    "language_request": "CASE WHEN length(text) % 29 = 5 THEN 'zh' WHEN length(text) % 31 = 7 THEN 'en' END",
}
_OWN = ", ".join(f"{sql} AS {c}" if c in ("elsewhere", "language") else f"nullif({sql}, '') AS {c}" for c, sql in FIELDS.items())
_NEXT = ", ".join(f"CASE WHEN o.broken THEN o.{c} ELSE coalesce(o.{c}, s.{c}) END AS {c}" for c in NAMED)
_WITH_OWNER = ", ".join(f"CASE WHEN NOT o.broken AND o.{c} IS NULL AND o.{owner} IS NULL AND s.{owner} IS NOT NULL THEN s.{c} ELSE o.{c} END AS {c}" for c, owner in PROVENANCE.items())
_TAKEN = " || ".join(f"CASE WHEN NOT o.broken AND o.{c} IS NULL AND s.{c} IS NOT NULL THEN ['{c}'] ELSE [] END" for c in NAMED)
_CHANGED = " || ".join(f"CASE WHEN NOT o.broken AND o.{c} <> s.{c} THEN ['{c}'] ELSE [] END" for c in NAMED)


@query(f"""WITH RECURSIVE parsed AS MATERIALIZED (SELECT *, elsewhere AND symbol IS NULL AS broken, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT conv_id, turn, {_OWN} FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations))),
fold AS (SELECT conv_id, turn, place, {", ".join((*NAMED, *PROVENANCE))}, coalesce(language_request, language) AS language, language_request AS sticky, CAST([] AS VARCHAR[]) AS inherited, CAST([] AS VARCHAR[]) AS changed FROM parsed WHERE place = 1
UNION ALL SELECT o.conv_id, o.turn, o.place, {_NEXT}, {_WITH_OWNER}, coalesce(o.language_request, CASE WHEN s.sticky IS NOT NULL THEN s.language ELSE o.language END), coalesce(o.language_request, s.sticky), {_TAKEN}, {_CHANGED} FROM fold s JOIN parsed o ON o.conv_id = s.conv_id AND o.place = s.place + 1)
SELECT conv_id, turn, {", ".join((*NAMED, *PROVENANCE))}, language, array_to_string(inherited, ',') AS inherited, array_to_string(changed, ',') AS changed FROM fold""")
def carried_context(p: Panel) -> DataFrame:
    """The request of every turn of every conversation, with the fields that it takes over from earlier ones."""
    text = F.coalesce("text", F.lit(""))
    parsed = p.table("conversations").select("conv_id", "turn", text.alias("text")).select("conv_id", "turn", *(F.expr(sql).alias(c) for c, sql in FIELDS.items()))
    lists = {c: F.array_join(c, ",") for c in ("inherited", "changed")}
    return carry_context(parsed).withColumns(lists)


_WORDS = r"SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z0-9.-]+'))) AS word FROM {}"


@query(f"""WITH t AS ({_WORDS.format("conversations")}), s AS ({_WORDS.format("benchmark")}),
d AS (SELECT t.word AS token, s.word AS symbol, levenshtein(t.word, s.word) AS distance FROM t JOIN s ON left(t.word, 1) = left(s.word, 1) WHERE length(t.word) >= 4 AND length(s.word) >= 3 AND abs(length(t.word) - length(s.word)) <= 2 AND levenshtein(t.word, s.word) <= CASE WHEN length(t.word) <= 5 THEN 1 ELSE 2 END)
SELECT token, any_value(symbol) AS symbol, CAST(any_value(distance) AS INT) AS distance FROM d WHERE distance = (SELECT min(distance) FROM d e WHERE e.token = d.token) GROUP BY token HAVING count(*) = 1""")
def suggested_symbols(p: Panel) -> DataFrame:
    """For each word of the conversations the one word of the benchmark's vocabulary that it may be a misspelling of."""
    words = lambda name: p.table(name).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9.-]+"), F.lit(0))).alias("w")).select(F.upper("w").alias("word")).distinct()
    return suggest(words("conversations"), words("benchmark"))

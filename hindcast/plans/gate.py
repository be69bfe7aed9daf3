"""Queries that hold numerals of prose against stated numbers, and cited figures against the rows they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import gate
from .predictors import _ROWS, states, sweep
from .queries import HORIZON, K, query
from .tables import Panel

#: What any text may say: the retrieval's settings.
STRUCTURE = (HORIZON, K, 80)

_BLANKED = "array_to_string(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] || repeat(' ', coalesce(length({1}[i]), 0))), '')"
_DATED = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}:\d{2}(?::\d{2})?\b|\b\d{4}/\d{1,2}/\d{1,2}\b"
_TOKEN = r"^(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?|-?\d+(?:\.\d+)?)(?:[^0-9A-Za-z_]|$)"


def _tokens(name: str, table: str, key: str) -> str:
    """SQL of the numerals (id, place, numeral, percent, text) of a table's texts: runs of word and number characters, in which one starts at the start or after a comma."""
    return f"""{name}_code AS (SELECT {key} AS id, row_number() OVER () AS row, text, string_split_regex(text, '`[^`]*`') AS a, regexp_extract_all(text, '`[^`]*`') AS b FROM {table} WHERE text IS NOT NULL),
{name}_date AS (SELECT id, row, text, string_split_regex(m, '{_DATED}') AS a, regexp_extract_all(m, '{_DATED}') AS b FROM (SELECT *, {_BLANKED.format("a", "b")} AS m FROM {name}_code)),
{name}_run AS (SELECT id, row, text, string_split_regex(m, '[0-9A-Za-z_.,:/-]+') AS a, regexp_extract_all(m, '[0-9A-Za-z_.,:/-]+') AS b FROM (SELECT *, {_BLANKED.format("a", "b")} AS m FROM {name}_date)),
{name}_each AS (SELECT id, row, text, i, b[i] AS run, list_sum(list_transform(a[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(b[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM {name}_run) WHERE regexp_matches(b[i], '[0-9]')),
{name}_try AS (SELECT *, regexp_extract(substr(run, c, 400), '{_TOKEN}', 1) AS numeral FROM (SELECT *, unnest(range(1, length(run) + 1)) AS c FROM {name}_each) WHERE c = 1 OR substr(run, c - 1, 1) = ','),
{name} AS MATERIALIZED (SELECT id, CAST(start + c - 1 AS BIGINT) AS place, numeral, regexp_matches(substr(text, CAST(start + c + length(numeral) AS BIGINT), 14), '^\\s*(%|percent|pp|percentage points)', 'i') AS percent, text FROM (
  SELECT *, max(c + length(numeral)) OVER (PARTITION BY row, i ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM {name}_try WHERE numeral <> '') WHERE coalesce(covered <= c, true))"""


@query(f"WITH {_tokens('tokens', 'documents', 'doc_id')} SELECT id AS doc_id, place, numeral, percent, trim(regexp_replace(substr(text, greatest(place - 60, 0) + 1, place + length(numeral) + 60 - greatest(place - 60, 0)), '\\s+', ' ', 'g')) AS context FROM tokens")
def numeral_tokens(p: Panel) -> DataFrame:
    """Every numeral of the documents outside of code, dates and times, with its place and surroundings."""
    return gate.numeral_tokens(p.table("documents"), "doc_id").select(F.col("id").alias("doc_id"), "place", "numeral", "percent", "context")


_NEAR = "({0} = {1} OR abs({0} - {1}) / greatest(abs({0}), abs({1}), 1e-9::DOUBLE) <= 0.005::DOUBLE)"
_ROUNDED = lambda v: ", ".join([v, *(f"floor({v} * {10**d} + 0.5::DOUBLE) / {10**d}" for d in range(4))])
_FORMS = f"SELECT DISTINCT form FROM (SELECT unnest([{_ROUNDED('v')}] || [{_ROUNDED('(v * 100)')}] || CASE WHEN abs(v) >= 1 THEN [{_ROUNDED('(v / 100)')}] ELSE [] END) AS form FROM "
_VALUE = "CAST(replace(numeral, ',', '') AS DOUBLE)"
_JUDGED = f"""{_tokens("tokens", "documents", "doc_id")}, {_tokens("says", "benchmark", "item_id")},
forms AS MATERIALIZED ({_FORMS} (SELECT DISTINCT {_VALUE} AS v FROM says))), frame AS MATERIALIZED ({_FORMS} (SELECT unnest({list(STRUCTURE)})::DOUBLE AS v))),
kinds AS MATERIALIZED (SELECT DISTINCT {_VALUE} AS v, percent, CASE WHEN percent THEN {_VALUE} / 100 ELSE {_VALUE} * 100 END AS o FROM tokens),
judged AS MATERIALIZED (SELECT v, percent, CASE WHEN EXISTS (SELECT 1 FROM forms WHERE {_NEAR.format("v", "form")}) THEN 'stated' WHEN EXISTS (SELECT 1 FROM frame WHERE {_NEAR.format("v", "form")}) THEN 'structural' WHEN EXISTS (SELECT 1 FROM forms WHERE {_NEAR.format("o", "form")}) THEN 'stated' ELSE 'unsupported' END AS verdict FROM kinds)"""


@query(f"WITH {_JUDGED} SELECT id AS doc_id, count(*) AS total, count(*) FILTER (WHERE verdict = 'unsupported') AS unsupported, count(*) FILTER (WHERE verdict = 'structural') AS structural, round(1 - count(*) FILTER (WHERE verdict = 'unsupported') / count(*), 6) AS pass_rate FROM tokens JOIN judged ON v = {_VALUE} AND judged.percent = tokens.percent GROUP BY id")
def numeral_gate(p: Panel) -> DataFrame:
    """Which numerals of each document trace to a number that some benchmark text states, printed in whatever form."""
    tokens = p.once("document-numerals", lambda p: gate.numeral_tokens(p.table("documents"), "doc_id"))
    stated = gate.numeral_tokens(p.table("benchmark"), "item_id").select("value").distinct()
    structure = p.spark.createDataFrame([(float(x),) for x in STRUCTURE], "value double")
    return gate.verify_numerals(tokens, stated, structure).withColumnRenamed("id", "doc_id")


# --- figures cited with a date ------------------------------------------------------------------

#: States that a query's paragraph tells of, and one in how many tells of another's distance, day or symbol.
TOLD, OTHER_DISTANCE, OTHER_DAY, OTHER_SYMBOL = 5, 7, 11, 13
_SYMBOL = r"Brand#\d+"
_BAD = "CASE WHEN (q * 5 + turn) % {} = 0 THEN {} ELSE {} END"
_PROSE = f"""{_ROWS}, ranked20 AS MATERIALIZED (SELECT s.query_id, s.entity, s.session_idx, m.dist, o.y, o.mae, k.session_date, row_number() OVER (PARTITION BY s.query_id ORDER BY m.dist, s.entity, s.session_idx) AS turn FROM states s JOIN met m ON m.query_id = s.query_id AND m.entity = s.entity AND m.session_idx = s.session_idx JOIN outcomes5 o ON o.entity = s.entity AND o.session_idx = s.session_idx JOIN calendar k ON k.session_idx = s.session_idx WHERE o.y IS NOT NULL AND o.mae IS NOT NULL),
told AS (SELECT w.entity AS asked, w.q, turn, {_BAD.format(OTHER_SYMBOL, "'Brand#0'", "r.entity")} || ' on ' || CAST({_BAD.format(OTHER_DAY, "session_date + 1", "session_date")} AS VARCHAR) || ' stood at a distance of ' || printf('%.3f', {_BAD.format(OTHER_DISTANCE, "dist + 0.1", "dist")}) || ' and returned ' || printf('%.2f', 100 * y) || '% after a maximum adverse move of ' || printf('%.2f', 100 * mae) || '%. ' AS line FROM ranked20 r JOIN sweep w USING (query_id) WHERE turn <= {TOLD}),
paragraphs AS (SELECT asked, q, string_agg(line, '' ORDER BY turn) AS text FROM told GROUP BY ALL)"""
_NUMBER_AFTER = r"nullif(replace(regexp_extract(ahead, '(?is)(?:{}).*?(-?\d+(?:,\d{{3}})*(?:\.\d+)?)', 1), ',', ''), '')::DOUBLE"
_CITED = rf"""cut AS (SELECT asked, q, string_split_regex(text, '\d{{4}}-\d{{2}}-\d{{2}}') AS a, regexp_extract_all(text, '\d{{4}}-\d{{2}}-\d{{2}}') AS d FROM paragraphs),
spot AS (SELECT asked, q, i - 1 AS place, d[i] AS date, left(regexp_extract(a[i + 1], '(?s)^(.*?)(?:[。！？!?\n]|\.\s+[A-Z"''(]|$)', 1), 140) AS ahead, regexp_replace(right(a[i], 80), '(?s)^.*(?:[。！？!?\n]|\.\s+([A-Z"''(]))', '\1') AS behind FROM (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM cut)),
cites AS (SELECT *, regexp_extract_all(behind, '{_SYMBOL}')[-1] AS symbol, {", ".join(f"{_NUMBER_AFTER.format(w)} AS {k}" for k, w in (("distance", "距离|distance"), ("ret", "returned"), ("mae", r"max(?:imum)?\s*adverse")))} FROM spot)"""


@query(f"""{_PROSE}, {_CITED}
SELECT c.asked AS entity, CAST(c.q AS INT) AS q, CAST(place AS INT) AS place, date, CASE WHEN count(r.entity) = 0 THEN 'unknown_date' WHEN any_value(c.distance) IS NULL AND any_value(c.ret) IS NULL AND any_value(c.mae) IS NULL THEN 'date_only'
WHEN bool_or((c.symbol IS NULL OR c.symbol = r.entity) AND (c.distance IS NULL OR abs(c.distance - r.dist) <= 0.002) AND (c.ret IS NULL OR abs(c.ret - 100 * r.y) <= 0.03) AND (c.mae IS NULL OR abs(c.mae - 100 * r.mae) <= 0.03)) THEN 'explained' ELSE 'spliced' END AS verdict
FROM cites c JOIN sweep w ON w.entity = c.asked AND w.q = c.q LEFT JOIN ranked20 r ON r.query_id = w.query_id AND CAST(r.session_date AS VARCHAR) = c.date GROUP BY c.asked, c.q, place, date""")
def date_pairs(p: Panel) -> DataFrame:
    """Paragraphs on each query's nearest states, some of which tell of another distance, day or symbol, held against the states."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "entity", "session_idx"))  # K rows of a query
    own = states(p).filter("y is not null and mae is not null").withColumn("turn", turn)
    own = own.join(p.calendar, "session_idx").join(sweep(p).select("query_id", F.col("entity").alias("asked"), "q"), "query_id")
    own = own.withColumns({"symbol": F.col("entity"), "date": F.col("session_date"), "distance": F.col("dist"), "ret": 100 * F.col("y"), "mae": 100 * F.col("mae"), "mfe": F.lit(None).cast("double")})
    bad = lambda n: (F.col("q") * 5 + F.col("turn")) % n == 0
    line = F.format_string(
        "%s on %s stood at a distance of %.3f and returned %.2f%% after a maximum adverse move of %.2f%%. ",
        F.when(bad(OTHER_SYMBOL), "Brand#0").otherwise(F.col("symbol")), F.when(bad(OTHER_DAY), F.date_add("date", 1)).otherwise(F.col("date")).cast("string"),
        F.when(bad(OTHER_DISTANCE), F.col("distance") + 0.1).otherwise(F.col("distance")), F.col("ret"), F.col("mae"),
    )
    told = own.filter(F.col("turn") <= TOLD).select("query_id", F.struct("turn", line.alias("line")).alias("x"))
    prose = told.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "").alias("text"))
    verdicts = gate.verify_citations(gate.citations(prose, "query_id", _SYMBOL), own.select(F.col("query_id").alias("id"), "symbol", "date", *gate.FIGURES))
    named = sweep(p).select(F.col("query_id").alias("id"), "entity", "q")
    return verdicts.join(named, "id").select("entity", "q", "place", "date", "verdict")

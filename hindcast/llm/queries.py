"""Queries of the corpus operators over the synthetic tables, and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .audit import audit_filters
from .decontam import decontaminate
from .linededup import line_dedup
from .ngramjoin import ngram_groups
from .packing import pack
from .pii import replace_pii
from .secrets import scan_secrets
from .token_edits import count_after_edits
from .toxicity import score_toxicity
from .trie import numbered, prefix_trie, shared_heads
from .urlfilter import Rule, judge_urls
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by keyed surrogates, and the number of entities of each kind."""
    return replace_pii(table(spark, sf_dir, "documents"), key=b"a key for these synthetic tables")


def op2_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight edits for each document, at places that a hash of its id picks: words come, go and change."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = lambda i, j, most: F.pmod(F.xxhash64("doc_id", F.lit(i), F.lit(j)), most)
    texts = F.array(*map(F.lit, ("", " ", "x", "the edit", "\n\n", "  '", "2024-01-31, ", "Straße ", "don't ", "of a longer passage that replaces another one. ")))
    edits = F.array(
        *(
            F.struct(drawn(i, 0, F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1).alias("start"), drawn(i, 1, F.lit(30).cast("long")).alias("length"), F.element_at(texts, (drawn(i, 2, F.lit(10).cast("long")) + 1).cast("int")).alias("replacement"))
            for i in range(8)
        )
    )
    return count_after_edits(docs.withColumn("edits", edits), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for each page, written and read back: payload size and digest, and response or revisit. Null html is an empty payload."""
    back = warc_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document, and how many are live-looking or shared by how widely owners and repositories hold them."""
    owner = F.col("source")  # a source's texts in one language stand for a repository
    found = scan_secrets(table(spark, sf_dir, "documents"), owner=owner, repository=F.concat_ws("/", "source", "lang"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_opaque", "n_live", "n_shared")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents' token ids in sequences of at most 4096."""
    return pack(table(spark, sf_dir, "documents"), word_bpe_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document from a network that learns from labels that aren't held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after dropping those that at least three documents share."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of every document's set of four-word shingles, and the smallest id that links of 0.85 or more reach."""
    return ngram_groups(table(spark, sf_dir, "documents"), k=4, parts=85, of=100).select("doc_id", "n_shingles", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of the benchmark, and the items found."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The rules that decide a URL before the models do.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block for every page's URL, by rule or by the models of its characters."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes within each source, in all 120 orders."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of the conversations rebuilt with shared heads."""
    return prefix_trie(*shared_heads(numbered(table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences that the whole pipeline makes of the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_token_edits": op2_token_edits,
    "op3_warc": op3_warc,
    "op4_secrets": op4_secrets,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_nearest": op7_nearest,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_decontamination": op10_decontamination,
    "op11_url_filter": op11_url_filter,
    "op12_filter_audit": op12_filter_audit,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}


def _spans_sql(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT doc_id, source, lang, '{kind}' AS kind, {number} AS no, v[i] AS value,
         CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, source, lang, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v
    FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)))
  WHERE length(v[i]) >= {least}"""


_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule_sql(field: int) -> str:
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    return "CASE " + " ".join(f"WHEN {fits.format(r.host, r.path)} THEN '{(r.name, r.verdict)[field]}'" for r in sorted(RULES, key=lambda r: -len(r.name))) + " END"


def _order_sql(k: int) -> str:
    """Likelihoods of the last of k + 1 characters: counts by gram and by context, mixed with the next shorter context's."""
    mix = lambda x: f"CASE WHEN n_{x} >= 4 THEN (o.{x} + t_{x} * {'1.0::DOUBLE / 256' if k == 0 else f'b.p_{x}'}) / (n_{x} + t_{x}) ELSE {'1.0::DOUBLE / 256' if k == 0 else f'b.p_{x}'} END AS p_{x}"
    return f"""o{k} AS (SELECT right(gram, {k + 1}) AS g, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1),
h{k} AS (SELECT left(g, {k}) AS head, sum(a) AS n_a, sum(r) AS n_r, count(*) FILTER (WHERE a > 0) AS t_a, count(*) FILTER (WHERE r > 0) AS t_r FROM o{k} GROUP BY 1),
p{k} AS (SELECT o.g, {mix("a")}, {mix("r")} FROM o{k} o JOIN h{k} h ON h.head = left(o.g, {k}){f" JOIN p{k - 1} b ON b.g = right(o.g, {k})" if k else ""})"""


ORACLES: dict[str, str] = {
    "op11_url_filter": f"""
WITH parted AS (
  SELECT page_id, coalesce(url, '') AS url, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), ruled AS (SELECT *, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS ruled FROM parted
), urls AS (SELECT DISTINCT url, ruled, left(md5(url), 1) IN ('0', '1', '2') AS held FROM ruled
), chars AS (SELECT *, [chr(2), chr(2), chr(2), chr(2)] || list_filter(string_split({_LOWER.format("url")}, ''), lambda c: c <> '') || [chr(3)] AS c FROM urls
), grams AS (SELECT url, ruled, held, array_to_string(c[i : i + 4], '') AS gram FROM (SELECT *, unnest(range(1, len(c) - 3)) AS i FROM chars)
), counts AS MATERIALIZED (SELECT gram, count(*) FILTER (WHERE NOT held AND ruled = 'allow') AS a, count(*) FILTER (WHERE NOT held AND ruled = 'block') AS r FROM grams GROUP BY gram
), {", ".join(_order_sql(k) for k in range(5))},
model AS (SELECT g AS gram, CAST(greatest(-16000, least(16000, round(1000 * (ln(p_a) - ln(p_r))))) AS BIGINT) AS ratio FROM p4
), scores AS MATERIALIZED (SELECT url, any_value(ruled) AS ruled, CAST(floor(CAST(sum(ratio) AS DOUBLE) / count(*)) AS BIGINT) AS score FROM grams JOIN model USING (gram) WHERE ruled IS NULL OR held GROUP BY url
), per AS (SELECT score, count(*) FILTER (WHERE ruled = 'allow') AS a, count(*) FILTER (WHERE ruled = 'block') AS r FROM scores WHERE ruled IS NOT NULL GROUP BY score
), best AS (
  SELECT score AS t FROM (SELECT score, (sum(a) OVER () - sum(a) OVER w + a) * sum(r) OVER () + (sum(r) OVER w - r) * sum(a) OVER () AS parted, sum(a) OVER () * sum(r) OVER () AS weight FROM per WINDOW w AS (ORDER BY score))
  WHERE weight > 0 ORDER BY parted DESC, score LIMIT 1
)
SELECT page_id, host, path, rule, CASE WHEN r.ruled IS NOT NULL THEN r.ruled WHEN score >= coalesce((SELECT t FROM best), 0) THEN 'allow' ELSE 'block' END AS verdict, CASE WHEN r.ruled IS NULL THEN score END AS score
FROM ruled r LEFT JOIN scores USING (url)
""",
    "op12_filter_audit": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents
), firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text
), marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS failed
  FROM d JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
), cells AS MATERIALIZED (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM m GROUP BY part, failed
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter
), orders AS (SELECT letter AS filter_order FROM letters UNION ALL SELECT filter_order || letter FROM orders, letters WHERE NOT contains(filter_order, letter)
), steps AS MATERIALIZED (SELECT filter_order, CAST(step AS INT) AS step, substr(filter_order, step, 1) AS filter, left(filter_order, step - 1) AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE length(filter_order) = 5)
), each AS MATERIALIZED (
  SELECT part, filter_order, step, filter, n, n_good, n_toxic, contains(failed, filter) AS fails, failed = filter AS alone, regexp_matches(failed, '[0' || before || ']') AS gone FROM cells, steps
), sums AS (
  SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n_good) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n_toxic) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM each GROUP BY part, filter_order, step, filter
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM sums
""",
    "op13_prefix_trie": r"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS s FROM conversations WHERE conv_id IS NOT NULL
), lists AS (SELECT conv_id, list(s ORDER BY place) AS s FROM own GROUP BY conv_id
), heads AS (
  SELECT conv_id, s, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda b, i: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END))) % 6 AS h FROM lists
), built AS MATERIALIZED (
  SELECT c.conv_id, coalesce(b.s, [])[1 : h] || c.s[h + 1 :] AS s FROM heads c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100
), steps AS MATERIALIZED (SELECT conv_id, s, d, md5(CAST(s[1 : d] AS VARCHAR)) AS node FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)
), nodes AS MATERIALIZED (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN d = 0 THEN 0 ELSE length(s[d].t) END) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = len(s)) AS ends, any_value(s) AS s FROM steps GROUP BY node, d
), edges AS MATERIALIZED (SELECT node, md5(CAST(s[1 : d - 1] AS VARCHAR)) AS parent FROM nodes WHERE d > 0
), kids AS (SELECT parent AS node, count(*) AS n_children FROM edges GROUP BY parent
), above AS (SELECT n.node, n.n_convs, n.chars, k.node IS NULL AS leaf, md5(CAST(n.s[1 : a] AS VARCHAR)) AS top, a FROM nodes n LEFT JOIN kids k USING (node), range(0, 2000) t(a) WHERE a <= n.d
), sums AS (SELECT top AS node, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM above GROUP BY top)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN edges e USING (node) LEFT JOIN nodes p ON p.node = e.parent
""",
    "op3_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
""",
    "op4_secrets": f"""
WITH base AS ({_spans_sql("assign", 0, _ASSIGN, 2, 8)} UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]+", 0, 16)} UNION ALL {_spans_sql("hex", 2, "[0-9a-f]+", 0, 32)}
), opaque AS (
  SELECT * FROM ({_spans_sql("opaque", 3, "[A-Za-z0-9+/_=-]+", 0, 20)}) o
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = o.doc_id AND b.s < o.s + o.n AND o.s < b.s + b.n)
), each AS (
  SELECT *, kind || ':' || s || ':' || (s + n) AS label FROM (FROM base UNION ALL FROM opaque)
), held AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repositories FROM each GROUP BY value
), judged AS (SELECT each.*, owners <= 2 AND repositories <= 4 AS live FROM each JOIN held USING (value) WHERE no < 3 OR (owners <= 2 AND repositories <= 4)
), per AS (
  SELECT doc_id, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
         string_agg(label, ',' ORDER BY s, no) FILTER (WHERE no < 3) AS base, string_agg(label, ',' ORDER BY s, no) AS spans,
         count(*) FILTER (WHERE no = 3) AS n_opaque, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_shared
  FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_opaque, 0) AS n_opaque, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM documents LEFT JOIN per USING (doc_id)
""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_az(line) AS key FROM (
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, s.key IS NOT NULL AND s.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN shared s ON l.key = s.key)
GROUP BY doc_id
""".replace("lower_az(line)", r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
    "op9_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
""",
    "op10_decontamination": r"""
WITH raw AS (
  SELECT 'd' AS side, CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), coalesce(text, '') FROM benchmark
), parts AS (
  SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw
), items AS (
  SELECT id AS item, w, least(10, len(w)) AS size FROM parts WHERE side = 'b' AND len(w) > 0
), patterns AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS pattern
  FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)
), sizes AS (SELECT DISTINCT size FROM patterns), docs AS (
  SELECT CAST(id AS BIGINT) AS doc_id, w FROM parts WHERE side = 'd'
), windows AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS pattern
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)
), found AS (
  SELECT doc_id, i, size, item FROM windows JOIN patterns USING (size, pattern)
), hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
}

"""The fold over turns, repairs of names, path risk, growing quantiles, parsers and the dataset sink, against brute force."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hindcast.operators import closed, distribution, pathrisk, standardise, validation
from hindcast.operators.context import NAMED, PROVENANCE, carry_context, deletions, suggest
from hindcast.sources import datasets, parsers

FIELDS = (*NAMED, *PROVENANCE)
SCHEMA = "conv_id long, turn long, " + ", ".join(f"{c} string" for c in FIELDS) + ", elsewhere boolean, language string, language_request string, place string"


def folded(rows):
    """Turn by turn, as a request is merged into the one before it."""
    out, prev, last = [], None, None
    for r in rows:
        own = {c: r[c] or None for c in FIELDS}
        now, taken, new = dict(own), [], []
        fresh = last != r["conv_id"]
        if fresh:
            prev = None
        broken = bool(r["elsewhere"]) and not own["symbol"]
        if prev and not broken:
            carried = {c for c in NAMED if own[c] is None and prev[c] is not None}
            taken = [c for c in NAMED if c in carried]
            new = [c for c in NAMED if own[c] is not None and prev[c] is not None and own[c] != prev[c]]
            now |= {c: prev[c] for c in carried}
            now |= {c: prev[c] for c, owner in PROVENANCE.items() if own[c] is None and owner in carried}
        sticky = r["language_request"] or (prev or {}).get("sticky")
        now["sticky"], now["language"] = sticky, sticky or r["language"]
        out.append((r["conv_id"], r["turn"], *(now[c] for c in FIELDS), now["language"], tuple(taken), tuple(new)))
        prev, last = now, r["conv_id"]
    return out


def turns_of(rng, conv, n):
    for turn in range(n):
        row = {c: rng.choice([None, None, None, "", f"{c[0]}{rng.randrange(3)}"]) for c in FIELDS}
        yield row | {"conv_id": conv, "turn": turn, "elsewhere": rng.random() < 0.15 or None, "language": rng.choice(["en", "zh"]), "language_request": rng.choice([None] * 9 + ["zh", "en"]), "place": "x"}


def carried(spark, rows):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    return [(r.conv_id, r.turn, *(r[c] for c in FIELDS), r.language, tuple(r.inherited), tuple(r.changed)) for r in carry_context(df).collect()]


def test_context_equals_the_fold(spark):
    rng = random.Random(1)
    rows = [r for conv in range(40) for r in turns_of(rng, conv, rng.choice([1, 2, 5, 30]))]
    assert Counter(carried(spark, rows)) == Counter(folded(rows))
    assert carried(spark, []) == []


def test_context_of_a_long_conversation(spark):
    df = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), *(F.when(F.col("id") % 1000 == i, F.concat(F.lit(c), F.col("id").cast("string"))).alias(c) for i, c in enumerate(FIELDS)), (F.col("id") % 7777 == 5).alias("elsewhere"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("language_request"))
    began = time.time()
    out = carry_context(df)
    assert out.count() == 100_000 and out.filter("turn = 99999").first().symbol == "symbol99000"
    assert time.time() - began < 60


# --- repairs ------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_suggestions_equal_all_pairs(spark):
    rng = random.Random(3)
    symbols = {"".join(rng.choice("ABC.") for _ in range(rng.randrange(2, 9))) for _ in range(150)} | {"".join(rng.choice("ABCDEFG") for _ in range(n)) for n in (18, 19, 20, 21, 22, 23, 40, 60) for _ in range(6)}
    tokens = {"ABC", "AAAA", "ab1x", "A B C", "ÄBCD"}
    for s in sorted(symbols):
        for _ in range(3):
            t = list(s)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randrange(2)] = rng.choice(["", "A", "Z"])
            tokens.add("".join(t))
    df = lambda xs: spark.createDataFrame([(x,) for x in sorted(xs)] + [(None,), ("A",)], "word string")
    got = {r.token: (r.symbol, r.distance) for r in suggest(df(tokens), df(symbols)).collect()}
    want = {}
    for t in tokens:
        if len(t) >= 4 and set(t) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.-"):
            near = sorted((d, s) for s in symbols if len(s) >= 3 and s[0] == t[0] and (d := distance(t, s)) <= (1 if len(t) <= 5 else 2))
            if near and (len(near) == 1 or near[0][0] < near[1][0]):
                want[t] = near[0][::-1]
    assert got == want and any(len(t) > 20 for t in got)
    assert spark.range(1).select(deletions(F.lit("ABC")).alias("d")).first().d == ["ABC", "AC", "AB", "A"]


# --- path risk ----------------------------------------------------------------------------------

PROBED = "era string, entity string, q int, mae double, sigma_h double, p05 double, p10 double, p20 double"


def test_path_risk_drops_by_reason_and_falls_back(spark):
    calibration = [("calibration", "a", i, -0.11 if i % 2 else -0.01, 0.1, 0.5, 0.5, 0.5) for i in range(12)] + [("calibration", "b", i, -0.3, None, None, None, None) for i in range(3)] + [("calibration", "a", 99, None, 0.1, 0.5, 0.5, 0.5)]
    test = [("test", "a", 200, -0.1, 0.1, 0.2, 0.3, 0.4), ("test", "b", 200, -0.2, 0.2, 0.2, 0.3, 0.4), ("test", "a", 201, None, None, None, None, None), ("test", "a", 202, -0.1, None, None, 0.3, None), ("test", "a", 203, -0.1, 0.0, 0.1, 0.1, 0.1)]
    rows = pathrisk.breach_rows(spark.createDataFrame(calibration + test, PROBED))
    reasons = Counter({(r.level, r.reason): r.n for r in pathrisk.dropped(rows).collect()})
    assert reasons[0.1, "used"] == 2 and reasons[0.1, "no_path"] == 1 and reasons[0.1, "no_volatility"] == 2 and reasons[0.05, "no_excursion"] == 1
    got = {(r.level, r.entity): r for r in pathrisk.predictions(rows).collect()}
    assert got[0.1, "a"].y == 1 and got[0.2, "a"].y == 0 and got[0.2, "b"].y == 1  # at the level counts as beyond it
    assert got[0.1, "a"].same_name == 0.5 and not got[0.1, "a"].fallback
    assert got[0.1, "b"].fallback and got[0.1, "b"].same_name == got[0.1, "b"].pooled == pytest.approx(9 / 15)
    assert got[0.1, "a"].vol_reflection == pytest.approx(2 * 0.158655, abs=1e-5)
    assert pathrisk.predictions(rows.filter("era = 'test'")).count() == 0


def test_bootstrap_equals_its_draws(spark):
    import hashlib

    rng = random.Random(8)
    rows = [(0.1, "e", q, rng.randrange(2), *(rng.random() for _ in range(4))) for q in range(9) for _ in range(1 + q % 3)]
    df = spark.createDataFrame(rows, "level double, entity string, q int, y int, analog_mae double, vol_reflection double, same_name double, pooled double")
    got = {r.predictor: r for r in pathrisk.paired_bootstrap(df, 50, 7).collect()}
    per = {}
    for _, _, q, y, *p in rows:
        s = per.setdefault(q, [0, 0.0, 0.0, 0.0, 0.0])
        s[0] += 1
        for i, x in enumerate(p, 1):
            s[i] += (x - y) ** 2
    spots = [per[q] for q in sorted(per)]
    for i, name in enumerate(pathrisk.PREDICTORS[1:], 2):
        d = []
        for resample in range(50):
            picked = [spots[int(hashlib.md5(f"7:{resample}:{t}".encode()).hexdigest()[:12], 16) % 9] for t in range(9)]
            d.append((sum(x[1] for x in picked) - sum(x[i] for x in picked)) / sum(x[0] for x in picked))
        d.sort()
        at = 49 * 0.025
        assert got[name].low == pytest.approx(d[int(at)] + (d[int(at) + 1] - d[int(at)]) * (at - int(at)))
        assert got[name].share_better == pytest.approx(sum(x < 0 for x in d) / 50)


def test_growing_quantiles_equal_all_pairs(spark):
    import numpy as np

    rng = random.Random(6)
    grid = [(e, i, None if rng.random() < 0.2 else rng.uniform(1, 9)) for e in "ab" for i in range(120)]
    queries = [(e, q) for e in "abz" for q in (0, 33, 60, 119, 200)]
    got = {(r.entity, r.q): r for r in distribution.unconditional_band(spark.createDataFrame(grid, "entity string, session_idx int, a double"), 5, spark.createDataFrame(queries + queries[:2], "entity string, q int")).collect()}
    price = {(e, i): a for e, i, a in grid}
    for e, q in queries:
        own = [price[e, i + 5] / a - 1 for (f, i), a in price.items() if f == e and i + 5 <= q and a and price.get((e, i + 5))]
        if len(own) < 30:
            assert (e, q) not in got
        else:
            r = got[e, q]
            assert r.n == len(own) and [r.lo, r.median, r.hi] == pytest.approx(list(np.quantile(own, [0.1, 0.5, 0.9])))


def test_matched_multiplier_is_an_order_statistic(spark):
    df = spark.createDataFrame([("p", float(i), 2.0) for i in range(1, 11)] + [("p", 1.0, 0.0), ("p", None, 1.0), ("tiny", 0.001, 1.0)], "k string, off double, half double")
    got = {r.k: r for r in validation.matched_multiplier(df, ["k"], "off", "half").collect()}
    assert (got["p"].n, got["p"].multiplier, got["p"].coverage, got["p"].width) == (10, 4.0, 0.8, 16.0) and got["tiny"].multiplier == 0.05
    cuts = validation.floor_cuts(df.filter("off is not null"), "off", (1 / 3, 2 / 3)).first().cuts
    ordered = sorted([*map(float, range(1, 11)), 1.0, 0.001])
    assert cuts == [ordered[int(11 / 3)], ordered[int(22 / 3)]]
    assert validation.floor_cuts(df.filter("false"), "off", (0.5,)).count() == 0


def test_tracking_and_books(spark):
    rows = [("s", d, 10.0 + d % 3, 20.0 + 2 * (d % 3)) for d in range(8)] + [("s", 99, None, 1.0), ("flat", 0, 1.0, 1.0), ("flat", 1, 1.0, 2.0), ("flat", 2, 1.0, 3.0), ("flat", 3, 1.0, 1.0), ("one", 0, 1.0, 1.0)]
    got = {r.symbol: r for r in closed.tracking(spark.createDataFrame(rows, "symbol string, d int, x double, y double")).collect()}
    assert (got["s"].n, round(got["s"].correlation, 9), round(got["s"].error_bp, 6), got["s"].p50) == (7, 1.0, 0.0, -0.5)
    assert got["flat"].correlation is None and got["one"].n == 0
    books = spark.createDataFrame([("ok", [(99.0, 1.0), (99.9, 2.0)], [(100.1, 3.0), (105.0, 9.0)]), ("crossed", [(101.0, 1.0)], [(100.0, 1.0)]), ("half", [(1.0, 1.0)], []), ("bad", [(0.0, 5.0), (-1.0, 1.0)], [(2.0, 1.0)])], "instrument string, bids array<struct<price:double,amount:double>>, asks array<struct<price:double,amount:double>>")
    one = {r.instrument: r for r in closed.order_book(books, ["instrument"], False, True).collect()}
    assert one["ok"].mid == pytest.approx(100) and one["ok"].spread_bp == pytest.approx(20) and one["ok"].depth_near == pytest.approx(500) and one["ok"].depth_far == pytest.approx(600) and one["ok"].top == pytest.approx(199.8)
    assert one["crossed"].spread_bp is None and one["half"].mid is None and one["bad"].mid is None
    other = {r.instrument: r for r in closed.order_book(books, ["instrument"], True, False).collect()}
    assert other["crossed"].spread_bp < 0 and other["ok"].depth_near == pytest.approx(2 * 99.9 + 3 * 100.1)


# --- parsers and sink ---------------------------------------------------------------------------


def test_rss_items_and_their_reasons(spark):
    xml = """<rss><channel><title>no item</title><item><title><![CDATA[A & B]]></title><link>http://x/1</link><pubDate>Tue, 5 Mar 2024 10:00:00 +0200</pubDate></item>
<item><title type="t"> a &amp;lt; b &#39;c&#39; </title><link rel="r" href='http://x/2?a=1&amp;b=2'/><dc:date>2024-03-05T10:00:00Z</dc:date></item><item><link>http://x/3</link></item><item><title>t</title><pubDate>when</pubDate></item></channel></rss>"""
    df = spark.createDataFrame([(1, xml, "x"), (2, None, "x"), (3, "<rss/>", "x")], "i long, xml string, title string")
    got = [(r.id, r.position, r.title, r.link, str(r.published_at), r.reason) for r in parsers.parse_rss(df, "i").orderBy("position").collect()]
    assert got[0] == (1, 1, "A & B", "http://x/1", "2024-03-05 08:00:00", None)
    assert got[1] == (1, 2, "a < b 'c'", "http://x/2?a=1&b=2", "2024-03-05 10:00:00", None)
    assert got[2][5] == "no_title" and got[3][4:] == ("None", None) and len(got) == 4


def test_streams_keep_what_is_no_json_apart(spark):
    df = spark.createDataFrame([(1, 'event: m\r\ndata: {"a": 1}\r\n\r\ndata:{bad\n\ndata:\ndata:  [1]  \nnodata: 3'), (2, None), (3, "")], "i long, text string")
    got = [(r.id, r.position, r.payload, r.reason) for r in parsers.parse_sse(df, "i").orderBy("position").collect()]
    assert got == [(1, 1, '{"a": 1}', None), (1, 2, "{bad", "not_json"), (1, 3, "[1]", None)]


def test_candles_by_position_and_echo(spark):
    df = spark.createDataFrame([("s", ["1709632800", "5", "2", "3", "1", "x"]), ("s", ["NaN", "1"]), ("s", []), ("s", None)], "k string, row array<string>")
    got = sorted(((str(r.ts), r.qv, r.c, r.o, r.bv, r.reason) for r in parsers.parse_candles(df, ["k"]).collect()), key=str)
    assert got[0] == ("2024-03-05 10:00:00", 5.0, 2.0, None, None, None) and [x[5] for x in got[1:]] == ["bad_time"] * 3
    rows = [("a", "1709632800000", "1", "1h", "v"), ("a", "1709632800", "2", "1h", None), ("a", "1709632800", "-2", "1h", "v"), ("b", "10", "1", "1d", "v"), ("c", "10", "1", None, None), ("d", "x", "1", "1d", "v"), ("d", "11", "NaN", "1d", "v")]
    checked = parsers.check_echo(spark.createDataFrame(rows, "request string, time string, close string, interval string, exchange string"), "request", "1h", "v")
    got = Counter((r.request, r.ts, r.reason) for r in checked.collect())
    assert got == Counter({("a", 1709632800, None): 2, ("a", 1709632800, None): 2, ("a", None, "bad_row"): 1, ("b", 10, "trap"): 1, ("c", 10, None): 1, ("d", None, "bad_row"): 2})


def test_numbers_of_payloads_to_the_depth_limit(spark):
    deep = lambda n: "[" * n + "1" + "]" * n
    texts = [deep(12), deep(13), '{"a": {"b": [1, true, null, "2020-03-23", "x2020-03-23", 2.5e3]}}', "no json", None, "7", '"1999-01-01T00:00"', "[]", "1e999", deep(50_000)]
    got = Counter((r.i, r.path, r.label, r.number) for r in parsers.payload_numbers(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, payload string"), "i").withColumnRenamed("id", "i").collect())
    assert got == Counter([(0, "$" + "[0]" * 12, "", 1.0), (2, "$.a.b[0]", "b", 1.0), (2, "$.a.b[3]", "b", 2020.0), (2, "$.a.b[5]", "b", 2500.0), (3, None, None, None), (5, "$", "", 7.0), (6, "$", "", 1999.0), (9, None, None, None)])


def test_a_killed_writer_leaves_the_set_as_it_was(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    with pytest.raises(FileNotFoundError):
        datasets.read_dataset(spark, path)
    one = {"a": spark.range(3), "b": spark.createDataFrame([("x", 1)], "k string, v int")}
    assert datasets.write_dataset(spark, path, one, {"b": ["k"]}) == 1
    broken = {"a": spark.range(9), "b": spark.range(5).select(F.raise_error(F.lit("killed")).alias("v"))}
    with pytest.raises(Exception, match="killed"):
        datasets.write_dataset(spark, path, broken)
    read = datasets.read_dataset(spark, path)
    assert read["a"].count() == 3 and [tuple(r) for r in read["b"].select("k", "v").collect()] == [("x", 1)]
    assert datasets.versions(spark, path) == [1] and datasets.write_dataset(spark, path, {"a": spark.range(4)}) == 2
    assert datasets.read_dataset(spark, path)["a"].count() == 4 and datasets.read_dataset(spark, path, 1)["a"].count() == 3
    taken = json.loads((tmp_path / "set" / datasets.MANIFESTS / "00000002.json").read_text())
    assert list(taken["tables"]) == ["a"]


def test_z_rows_keep_missing_features_missing(spark):
    from hindcast.schema import FEATURES

    panel = spark.createDataFrame([(e, i, True, *(None if f == "slope" else float(i) for f in FEATURES)) for e in "ab" for i in range(4)], "entity string, session_idx int, valid boolean, " + ", ".join(f"{f} float" for f in FEATURES))
    stats = standardise.session_stats(panel, spark.range(4).select(F.col("id").cast("int").alias("session_idx")))
    rows = standardise.z_rows(panel, stats).collect()
    assert all(r.z[FEATURES.index("slope")] is None and r.z[0] is not None for r in rows)
    assert {r.feature for r in standardise.z_scores(standardise.z_rows(panel, stats)).collect()} == set(FEATURES) - {"slope"}

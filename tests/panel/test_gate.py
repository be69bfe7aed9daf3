"""Numerals, near matches and citations against brute force."""

import itertools
import math
import random

from hindcast.operators import gate


def test_numerals_have_places_and_marks():
    text = "On 2020-03-23 at 10:30 `x = 5` it fell 1,234.50 %, then -7 pp; v2 and 3x don't count, 12:15 neither, but (0.5)."
    found = [(place, n, percent) for place, n, _, percent in gate.numerals(text)]
    assert [(n, p) for _, n, p in found] == [("1,234.50", True), ("-7", True), ("0.5", False)]
    assert all(text[place : place + len(n)] == n for place, n, _ in found)
    assert list(gate.numerals("")) == [] and list(gate.numerals("no number")) == []


def test_tokens_of_null_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "1 " * 20_000), (3, "7"), (None, "8")]
    got = gate.numeral_tokens(spark.createDataFrame([(*r, "x") for r in rows], "i long, text string, value string"), "i").collect()
    assert len(got) == 20_002 and {r.id for r in got} == {3, None} and max(r.place for r in got) == 39_998


def near(x, y):
    return x == y or abs(x - y) / max(abs(x), abs(y), 1e-9) <= 0.005


def forms(x):
    out = set()
    for v in [x, x * 100] + ([x / 100] if abs(x) >= 1 else []):
        out |= {v, *(math.floor(v * 10**d + 0.5) / 10**d for d in range(4))}
    return out


def test_near_values_equal_all_pairs(spark):
    rng = random.Random(2)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-10, 6) for _ in range(300)] + [0.0, 1.0, 1.005, 0.995, 1e-9, -1e-9, 1e-12]
    stated = [v * rng.choice([1, 1.0049, 0.9951, 1.006, -1]) for v in rng.sample(values, 120)] + [0.0, 100.0]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs] + [(None,)], "value double")
    got = {r.value for r in gate.near_values(df(values), df(stated)).collect()}
    assert got == {x for x in values if any(near(x, y) for y in stated)}


def test_verdicts_of_numerals(spark):
    texts = [(1, "10.73% and 0.107 and 11 and 10.5%"), (2, "20 sessions, 2,000 of 99"), (3, "none"), (4, None)]
    tokens = gate.numeral_tokens(spark.createDataFrame(texts, "i long, text string"), "i")
    stated, structure = [0.1073, 2000.0], [20.0]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "value double")
    got = {r.id: (r.total, r.unsupported, r.structural) for r in gate.verify_numerals(tokens, df(stated), df(structure)).collect()}
    want = {}
    for i, text in texts:
        kinds = []
        for _, n, _, percent in gate.numerals(text or ""):
            v = float(n.replace(",", ""))
            ok = lambda v, xs: any(near(v, f) for x in xs for f in forms(x))
            kinds.append("stated" if ok(v, stated) else "structural" if ok(v, structure) else "stated" if ok(v / 100 if percent else v * 100, stated) else "no")
        if kinds:
            want[i] = (len(kinds), kinds.count("no"), kinds.count("structural"))
    assert got == want and got[1][1] == 1
    assert gate.verify_numerals(tokens, df([]), df([])).filter("unsupported < total").count() == 0


def test_figures_belong_to_one_row(spark):
    rows = [(1, "AA", "2020-03-23", 0.512, 4.1, -9.0, 6.0), (1, "BB", "2020-03-23", 0.7, -2.0, -3.0, 1.0), (1, "AA", "2020-04-01", 0.9, 1.0, None, None)]
    cases = {
        "AA on 2020-03-23 at distance 0.512 returned 4.1%": "explained",
        "AA on 2020-03-23 at distance 0.7 returned -2%": "spliced",  # BB's figures
        "On 2020-03-23 at distance 0.512 it returned -2%": "spliced",  # of two rows
        "On 2020-03-23 at distance 0.5121 it returned 4.12%": "explained",
        "AA on 2020-03-24 returned 4.1%": "unknown_date",
        "AA on 2020-03-23, and later": "date_only",
        "AA on 2020-03-23. The distance 0.99 is of another sentence": "date_only",
        "AA on 2020-04-01 with MAE -3%": "spliced",  # the row has none
        "`on 2020-03-24` AA on 2020-04-01 returned 1%": "explained",
        "BB rose. On 2020-03-23 it returned 4.1%": "explained",  # BB is of another sentence
    }
    texts = [(i, t) for i, t in enumerate(cases)] + [(98, None), (99, "no date")]
    source = spark.createDataFrame([(i, *r[1:]) for i in range(len(cases)) for r in rows], "id long, symbol string, date string, distance double, ret double, mae double, mfe double")
    cited = gate.citations(spark.createDataFrame(texts, "i long, text string"), "i", r"\b[A-Z]{2}\b")
    got = {r.id: r.verdict for r in gate.verify_citations(cited, source).collect()}
    assert got == dict(enumerate(cases.values()))
    assert gate.verify_citations(cited, source.filter("false")).filter("verdict != 'unknown_date'").count() == 0


def test_bins_of_near_pairs_touch(spark):
    rng = random.Random(4)
    pairs = [(x, x * f) for x in (10 ** rng.uniform(-8, 8) for _ in range(200)) for f in (0.995, 0.9975, 1.0, 1 / 0.995)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pairs, "x double, y double").filter(gate.near(F.col("x"), F.col("y")))
    assert df.count() > 500 and df.filter(F.abs(gate._bin(F.col("x")) - gate._bin(F.col("y"))) > 1).count() == 0
    assert len(list(itertools.islice(gate.numerals("1 2 3"), 2))) == 2

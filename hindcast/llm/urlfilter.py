"""URL filter: stated rules, and a character language-model ratio for the URLs that no rule decides."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The first ``://``, what follows up to ``/``, ``?``, ``#``, and then up to ``?`` or ``#``.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Marks before the first and after the last character.
START, END = "\x02", "\x03"
#: Log-likelihood ratios are whole thousandths of a nat, within this bound: sums don't depend on their order.
UNIT, BOUND = 1000, 16000
#: Equally likely characters, which the shortest context backs off to.
ALPHABET = 256
#: A decided URL is held out for calibration if its md5 starts with one of these (3 of 16).
HELD_OUT = ("0", "1", "2")
#: The model is broadcast up to this many rows (about 20 MB); a larger one is joined by shuffle.
MOST_BROADCAST = 200_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def _first(rules: Sequence[Rule], field: str) -> Column:
    """The field of the longest rule that fits; of rules of one length the smaller name, then allow, wins."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict))
    return F.coalesce(*(F.when(_fits(r), F.lit(getattr(r, field))) for r in order), F.lit(None).cast("string"))


def _grams(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """(keep, gram): each character of ``text`` (and its end) after the ``order`` characters before it."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    urls = urls.select(*keep, F.concat(F.array_repeat(F.lit(START), order), chars, F.array(F.lit(END))).alias("chars"))
    each = F.transform(F.sequence(F.lit(1), F.size("chars") - order), lambda i: F.array_join(F.slice("chars", i, order + 1), ""))
    return urls.select(*keep, F.explode(each).alias("gram"))


def log_ratios(counts: DataFrame, order: int, least: int) -> DataFrame:
    """(gram, ratio): log likelihood of each gram's last character in accepted less that in rejected URLs.

    counts: (gram, a, r), every gram of order + 1 characters that occurs, with its number in accepted and
    in rejected URLs. Each class is a Markov model of variable order: a context counts only if the class
    has it ``least`` times, else the next shorter one speaks. A context's counts are mixed with the
    shorter context's estimate by its number of different followers (Witten and Bell); the shortest one's
    with equal chances. So no probability is 0.
    """
    below = None
    for k in range(order + 1):
        own = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        head = F.substring("g", 1, k)
        seen = own.groupBy(head.alias("head")).agg(
            F.sum("a").alias("n_a"), F.sum("r").alias("n_r"), F.count_if(F.col("a") > 0).alias("t_a"), F.count_if(F.col("r") > 0).alias("t_r")
        )
        if below is None:
            joined = own.join(F.broadcast(seen)).withColumns({"p_a": F.lit(1.0 / ALPHABET), "p_r": F.lit(1.0 / ALPHABET)})  # one row: the empty context
        else:
            joined = own.withColumns({"head": head, "tail": F.substring("g", 2, k)}).join(seen, "head").join(below.withColumnRenamed("g", "tail"), "tail")
        mixed = lambda x: F.when(F.col(f"n_{x}") >= least, (F.col(x) + F.col(f"t_{x}") * F.col(f"p_{x}")) / (F.col(f"n_{x}") + F.col(f"t_{x}"))).otherwise(F.col(f"p_{x}"))
        below = joined.select("g", mixed("a").alias("p_a"), mixed("r").alias("p_r"))
    ratio = F.round(UNIT * (F.ln("p_a") - F.ln("p_r")), 0).cast("long")
    return below.select(F.col("g").alias("gram"), F.greatest(F.least(ratio, F.lit(BOUND)), F.lit(-BOUND)).alias("ratio"))


def threshold(scored: DataFrame) -> int:
    """The score from which on URLs are accepted: the one that parts the held-out URLs (score, allowed) best.

    Best is the largest sum of the two classes' shares on their own side; of equal ones the smallest
    score. 0 if a class has no held-out URL. Scores are whole numbers within +-BOUND, so what is ordered
    here has at most 2 * BOUND + 1 rows, whatever the corpus.
    """
    per = scored.groupBy("score").agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("r"))
    whole = Window.partitionBy()
    upto = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_a, all_r = F.sum("a").over(whole), F.sum("r").over(whole)
    kept, gone = all_a - F.sum("a").over(upto) + F.col("a"), F.sum("r").over(upto) - F.col("r")
    parted = per.select("score", (kept * all_r + gone * all_a).alias("parted"), (all_a * all_r).alias("both"))
    best = parted.filter("both > 0").orderBy(F.desc("parted"), "score").first()
    return best.score if best else 0


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", order: int = 4, least: int = 4) -> DataFrame:
    """Allow or block every URL: by the longest rule that fits, else by two language models of its characters.

    Returns (page_id, host, path, rule, verdict, score), a row for each row of ``pages``. host: after the
    first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#``
    or the end. A null URL, and one without ``://``, has neither (both empty), so no rule fits it; a null
    one is judged as an empty text. Rows that repeat an id or a URL each get their verdict; a null id
    stays null. Other columns are not read.

    The URLs that rules allow and block are the accepted and rejected ones that the models learn from,
    each distinct URL once. ``score`` is the mean log-likelihood ratio of a URL's characters
    (``log_ratios``) in thousandths of a nat, rounded down; null where a rule decides. It is held
    against a threshold calibrated on decided URLs that the models haven't seen. Without any accepted
    or rejected URL the ratio is 0, which allows.

    Plan: distinct URLs are staged; their characters are exploded and counted with partial sums, so a
    host with a third of all rows costs no task more than others. The model has a row for each distinct
    run of order + 1 characters and is built by joins on those. Scores are sums by URL in the task that
    explodes it; only with a model of over MOST_BROADCAST rows do characters move to meet it.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"))
    read = read.withColumns({"host": F.translate(F.regexp_extract("url", PARTS, 1), AZ, az), "path": F.regexp_extract("url", PARTS, 2)})
    read = read.withColumns({"rule": _first(rules, "name"), "ruled": _first(rules, "verdict")})
    keys = {"k1": F.xxhash64("url"), "k2": F.xxhash64(F.lit(1), "url")}

    fold = F.substring(F.md5("url"), 1, 1).isin(*HELD_OUT)
    urls = read.select("url", (F.col("ruled") == "allow").alias("allowed")).distinct().withColumns({"text": F.translate("url", AZ, az), "held": fold, **keys}).drop("url")
    urls = stage(urls, "url-distinct")
    learn = ~F.col("held") & F.col("allowed").isNotNull()
    counts = _grams(urls.withColumns({"a": learn & F.col("allowed"), "r": learn & ~F.col("allowed")}), order, "a", "r")
    counts = stage(counts.groupBy("gram").agg(F.count_if("a").alias("a"), F.count_if("r").alias("r")), "url-grams")
    model = stage(log_ratios(counts, order, least), "url-model")

    asked = urls.filter(F.col("allowed").isNull() | F.col("held"))
    small = model.count() <= MOST_BROADCAST
    met = _grams(asked, order, "k1", "k2", "allowed").join(F.broadcast(model) if small else model, "gram")
    scores = met.groupBy("k1", "k2").agg(F.floor(F.sum("ratio") / F.count("*")).alias("score"), F.any_value("allowed").alias("allowed"))
    scores = stage(scores, "url-scores")
    least_score = threshold(scores.filter("allowed is not null"))

    ruled = read.filter("ruled is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("long").alias("score"))
    open_ = read.filter("ruled is null").withColumns(keys).drop("url").join(scores.filter("allowed is null").drop("allowed"), ["k1", "k2"])
    judged = open_.select("page_id", "host", "path", "rule", F.when(F.col("score") >= least_score, "allow").otherwise("block").alias("verdict"), "score")
    return ruled.unionByName(judged)

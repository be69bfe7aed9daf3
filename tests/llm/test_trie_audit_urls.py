"""The URL filter, the filter audit and the conversation trie against brute force, on nulls, ties, repeats and clashes."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from hindcast.llm import audit, trie, urlfilter
from hindcast.llm.queries import RULES

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- URL filter ---------------------------------------------------------------------------------


def parts_by_hand(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(AZ), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_by_hand(url):
    host, path = parts_by_hand(url)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name)) if fit else None


def scores_by_hand(urls, order=4, least=4):
    """Scores of the distinct URLs and the threshold, by walking each context down to the empty one."""
    held = {u: hashlib.md5(u.encode()).hexdigest()[0] in "012" for u in urls}
    seen = {v: [defaultdict(Counter) for _ in range(order + 1)] for v in ("allow", "block")}
    grams = {u: [(x[i : i + order], x[i + order]) for i in range(len(x) - order)] for u in urls for x in ["\x02" * order + u.translate(AZ) + "\x03"]}
    for u in urls:
        rule = rule_by_hand(u)
        if rule and not held[u]:
            for context, c in grams[u]:
                for k in range(order + 1):
                    seen[rule.verdict][k][context[order - k :]][c] += 1

    def p(v, context, c):
        value = 1 / 256
        for k in range(order + 1):
            own = seen[v][k].get(context[order - k :])
            if own and sum(own.values()) >= least:
                value = (own[c] + len(own) * value) / (sum(own.values()) + len(own))
        return value

    score = {}
    for u in urls:
        if rule_by_hand(u) is None or held[u]:
            each = [max(-16000, min(16000, round(1000 * (math.log(p("allow", *g)) - math.log(p("block", *g)))))) for g in grams[u]]
            score[u] = math.floor(sum(each) / len(each))
    decided = [(score[u], rule_by_hand(u).verdict == "allow") for u in urls if rule_by_hand(u) and held[u]]
    n_a, n_r = sum(a for _, a in decided), sum(not a for _, a in decided)
    if not n_a * n_r:
        return score, 0
    parted = {t: sum(a and s >= t for s, a in decided) * n_r + sum(not a and s < t for s, a in decided) * n_a for t, _ in decided}
    return score, min(t for t in parted if parted[t] == max(parted.values()))


def judged_by_hand(pages):
    score, least = scores_by_hand({u or "" for _, u in pages})
    out = []
    for i, u in pages:
        host, path = parts_by_hand(u)
        rule = rule_by_hand(u)
        own = None if rule else score[u or ""]
        out.append((i, host, path, rule and rule.name, rule.verdict if rule else "allow" if own >= least else "block", own))
    return Counter(out)


def some_urls(rng, n):
    hosts = ["www.example.com", "m.news.example.com", "Blog.Example.NET", "cheap-pills.example.org", "x.net", "com", "anet", "notcom"]
    for _ in range(n):
        yield f"{rng.choice(['http', 'https', 'ftp'])}://{rng.choice(hosts)}{rng.choice(['/en/', '/es/', '/fr/', '/', '', '?en', '#x', '/EN/'])}{rng.choice(['', '7', 'a/b', 'q?page=2', 'ü😀#t', '%20'])}"


@pytest.mark.parametrize("most", [0, 10**6])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(urlfilter, "MOST_BROADCAST", most)  # the model by shuffle, and by broadcast
    urls = [*some_urls(random.Random(5), 400), None, "", "no scheme", "a://b://c/d", "://", "x\n://Y.COM/en/\nz?q", "https://www.example.com/en/" + "long/" * 4000, "http://com/"]
    pages = list(enumerate(urls)) + [(3, urls[3]), (None, urls[0]), (4, "http://other.org/")]
    df = spark.createDataFrame([(i, u, "h", "clash", 1) for i, u in pages], "page_id long, url string, host string, rule string, score long").repartition(3)
    got = urlfilter.judge_urls(df, RULES).collect()
    assert Counter(tuple(r) for r in got) == judged_by_hand(pages)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_urls_without_any_to_learn_from(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert sorted((r.page_id, r.verdict, r.score) for r in urlfilter.judge_urls(df, RULES).collect()) == [(1, "allow", 0), (2, "allow", 0)]
    assert urlfilter.judge_urls(df.filter("false"), RULES).count() == 0


# --- filter audit -------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, part in docs:
        t = t or ""
        words = [w for w in SPACE.split(t) if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows.append((part or "", {x for x, y in fails.items() if y}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[part, x] += len(removed)
                out.append([part, "".join(order), step, x, len(left), len(removed), sum(x in r[1] for r in gone), sum(r[1] == {x} for r in rows if r[0] == part), sum(r[2] for r in removed), sum(r[3] for r in removed)])
                gone += removed
    return Counter((*r, shapley[r[0], r[3]]) for r in out)


def audited(spark, docs, labels):
    df = spark.createDataFrame([(i, t, p, "x", 1) for i, t, p in docs], "doc_id long, text string, source string, mask string, key long").repartition(3)
    lf = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    return Counter(tuple(r) for r in audit.audit_filters(df, lf).collect())


def some_documents():
    rng = random.Random(9)
    word = lambda: rng.choice(["one", "two", "Three", "FOUR", "ünf", "a$b", "#"] + [f"w{i}" for i in range(300)])
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 49, 50, 51, 120]))) for _ in range(60)]
    big = "b" * 70_000
    texts += [texts[5]] * 12 + [big + "x", big + "y", big + "x", "", None, "  \t\n", "same length 1", "same length 2", "same length 1", "word " * 60]
    docs = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts)]
    docs += [(5, texts[5], "a"), (5, "another text", "b"), (None, texts[5], "a"), (None, None, None), (-3, texts[7], "b")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 70, 2)] + [(4, 1, None), (None, 1, 1), (5, None, 1), (7, 0, 0), (7, 1, 1)]
    return docs, [(i, q, None if t is None else int(t)) for i, q, t in labels]


def test_audit(spark):
    docs, labels = some_documents()
    assert audited(spark, docs, labels) == audit_by_hand(docs, labels)


def test_audit_compares_texts_of_colliding_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(audit, "_block", lambda i: F.lit(i).cast("long"))  # all texts of one length are one class
    docs, labels = some_documents()
    assert audited(spark, docs, labels) == audit_by_hand(docs, labels)


def test_audit_of_no_documents(spark):
    docs, labels = some_documents()
    assert audited(spark, [], labels) == Counter()
    assert audited(spark, docs[:9], []) == audit_by_hand(docs[:9], [])


# --- conversation trie --------------------------------------------------------------------------


def trie_by_hand(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    leaves, saved, kids = Counter(), Counter(), Counter(k[:-1] for k in nodes if k)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    return Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)))) for k, m in nodes.items())


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth long").repartition(3)
    return Counter(tuple(r) for r in trie.prefix_trie(*trie.shared_heads(trie.numbered(df))).collect())


@pytest.mark.parametrize("run, piece", [(4096, 4096), (3, 2)])
def test_trie(spark, monkeypatch, run, piece):
    monkeypatch.setattr(trie, "RUN", run)
    monkeypatch.setattr(trie, "PIECE", piece)
    rng = random.Random(run)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 230), -7, -100, -101, 7000]:
        for turn in rng.sample(range(-3, 12), rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "ü😀", "a longer text"])))
    copied = [(0, "user", "the same"), (1, "assistant", "answer"), (2, "user", "x" * 5000)]
    rows += [(c, *t) for c in range(300, 340) for t in copied]
    rows += [(3, None, "user", "before all"), (3, None, None, None), (3, 5, "user", "tie b"), (3, 5, "user", "tie a"), (None, 0, "user", "no conversation")]
    rows += [(500, i, "user", f"turn {i}") for i in range(60)] + rows[:2]
    assert trie_of(spark, rows) == trie_by_hand(rows)


def test_trie_of_one_or_no_conversation(spark):
    for rows in ([], [(100, 0, "user", "a"), (100, 1, "user", "b")], [(None, 1, "a", "b")], [(7, 0, "user", "gone")]):
        assert trie_of(spark, rows) == trie_by_hand(rows)

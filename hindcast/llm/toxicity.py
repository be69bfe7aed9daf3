"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, release, text_buffers
from .words import ALNUM, LOWER, U64, hashes, mix, spans

#: Words in a window, and words from one window's start to the next one's: a passage of up to 17 words
#: lies whole in some window, a longer one fills half of one at least.
WINDOW, STRIDE = 32, 16
#: Times that the windows of a toxic text that take its label are halved.
HALVINGS = 3
#: Windows scored at a time, and bytes of text that are cut into words at a time (one text at least).
BATCH, SLICE = 4096, 1 << 20


@dataclass
class Sizes:
    word_slots: int = 1 << 14
    gram_slots: int = 1 << 14
    word_dim: int = 8
    gram_dim: int = 12
    hidden: int = 12
    attention: int = 8


@dataclass
class Vocabulary:
    """The distinct words of some texts: slot of each, and the slots of its character n-grams."""

    slot: np.ndarray
    grams: np.ndarray
    first: np.ndarray = field(default=None)  # offsets into grams, one more than words


def words_of(data: np.ndarray, at: np.ndarray, sizes: Sizes) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """Distinct words of lower-cased texts, the number of each word in order, and the offsets of the texts.

    Word 0 is the padding; it has no n-grams.
    """
    return _hashed_words(data, at, sizes)[:3]


def _hashed_words(data: np.ndarray, at: np.ndarray, sizes: Sizes) -> tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = spans(data, at, ALNUM)
    value, index, number = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    begin, length = starts[index], ends[index] - starts[index]
    # Every word with a mark before and after it, end to end.
    size = length + 2
    edge = np.r_[0, np.cumsum(size)]
    letters = np.full(edge[-1], 1, np.uint64)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    letters[np.repeat(edge[:-1] + 1, length) + inner] = data[np.repeat(begin, length) + inner] + U64(2)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    grams, owners = [], []
    for n in (3, 4, 5):
        m = len(letters) - n + 1
        if m > 0:
            total = np.zeros(m, np.uint64)
            for j in range(n):
                total = total * U64(1_000_003) + letters[j : j + m]
            whole = owner[:m] == owner[n - 1 :]
            grams.append((mix(total[whole] * U64(8) + U64(n)) % U64(sizes.gram_slots)).astype(np.int32))
            owners.append(owner[:m][whole])
    grams, owners = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (grams, owners))
    order = np.argsort(owners, kind="stable")
    first = np.r_[0, np.searchsorted(owners[order], np.arange(len(value) + 1))]
    slot = np.r_[0, 1 + (value % U64(sizes.word_slots - 1)).astype(np.int64)]
    return Vocabulary(slot, grams[order], first), number + 1, np.searchsorted(doc, np.arange(len(at))), value


def words_in_slices(texts: pa.Array, sizes: Sizes) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """As ``words_of``, from texts in slices, so that what is held beside the result is bounded by a slice."""
    slots, grams, counts, numbers, ends, values = [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)], []
    for part in chunks([pa.RecordBatch.from_arrays([texts], ["text"])], "text", SLICE):
        data, at = text_buffers(part.column(0))
        own, number, at, value = _hashed_words(LOWER[data], at, sizes)
        numbers.append(number + sum(map(len, values)))
        ends.append(at[1:] + ends[-1][-1])
        slots.append(own.slot[1:])
        grams.append(own.grams)
        counts.append(np.diff(own.first)[1:])
        values.append(value)
    if not values:
        return Vocabulary(slots[0], np.zeros(0, np.int32), np.zeros(2, np.int64)), np.zeros(0, np.int64), ends[0]
    every = Vocabulary(np.concatenate(slots), np.concatenate(grams), np.r_[0, np.cumsum(np.concatenate(counts))])
    if len(values) == 1:
        return every, numbers[0], np.concatenate(ends)
    _, index, inverse = np.unique(np.concatenate(values), return_index=True, return_inverse=True)
    once, _ = _part(every, index[None] + 1)
    place = np.r_[0, np.searchsorted(np.sort(index), index)[inverse] + 1]  # words of ``once`` stand as they came
    return once, place[np.concatenate(numbers)], np.concatenate(ends)


def windows(number: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows (rows of word numbers, 0 as padding) and the text of each.

    A text has windows at every STRIDE words and one that ends with it; a text of at most WINDOW
    words, an empty one included, has one.
    """
    count = np.diff(at)
    more = np.maximum(0, -(-(count - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(count)), more + 1)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    start = np.minimum(turn * STRIDE, np.maximum(0, count[text] - WINDOW))
    place = start[:, None] + np.arange(WINDOW)
    outside = place >= count[text][:, None]
    place += at[text][:, None]
    place[outside] = len(number)
    return np.r_[number, 0][place], text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Word and character embeddings, a gated recurrent layer each way, attention pooling, a logit."""

    def __init__(self, sizes: Sizes, seed: int):
        rng = np.random.default_rng(seed)
        self.sizes, d, h = sizes, sizes.word_dim + sizes.gram_dim, sizes.hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": draw(sizes.word_slots, sizes.word_dim, scale=0.01), "gram": draw(sizes.gram_slots, sizes.gram_dim, scale=0.02)}
        for way in "fb":
            self.p |= {f"{way}_in": draw(d, 3 * h, scale=d**-0.5), f"{way}_bias": np.zeros(3 * h, np.float32), f"{way}_rec": draw(h, 3 * h, scale=h**-0.5)}
        self.p |= {"att": draw(2 * h, sizes.attention, scale=(2 * h) ** -0.5), "att_bias": np.zeros(sizes.attention, np.float32), "att_to": draw(sizes.attention, scale=1.0)}
        self.p |= {"out": draw(2 * h, scale=0.3), "out_bias": np.zeros(1, np.float32)}

    def embed(self, vocabulary: Vocabulary, keep_word: np.ndarray | None = None) -> np.ndarray:
        """A row for each distinct word: its word vector beside the scaled sum of its n-gram vectors."""
        word = self.p["word"][vocabulary.slot]
        if keep_word is not None:
            word = word * keep_word[:, None]
        count = np.diff(vocabulary.first)
        gram = np.zeros((len(count), self.sizes.gram_dim), np.float32)
        full = np.flatnonzero(count)
        if len(full):
            gram[full] = np.add.reduceat(self.p["gram"][vocabulary.grams], vocabulary.first[full], axis=0) / np.sqrt(count[full])[:, None].astype(np.float32)
        return np.concatenate([word, gram], axis=1)

    def _run(self, way: str, gates: np.ndarray, rows: np.ndarray, tape: list | None) -> np.ndarray:
        """Hidden states (window, place, hidden). gates: input part of the three gates by word."""
        h, rec = self.sizes.hidden, self.p[f"{way}_rec"]
        out = np.empty((*rows.shape, h), np.float32)
        state = np.zeros((len(rows), h), np.float32)
        for t in range(rows.shape[1]) if way == "f" else range(rows.shape[1] - 1, -1, -1):
            a, u = gates[rows[:, t]], state @ rec
            gate = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
            z, r, q = gate[:, :h], gate[:, h:], u[:, 2 * h :]
            c = np.tanh(a[:, 2 * h :] + r * q)
            before, state = state, state + z * (c - state)
            out[:, t] = state
            if tape is not None:
                tape.append((t, before, z, r, q, c))
        return out

    def logits(self, embedded: np.ndarray, rows: np.ndarray, tape: dict | None = None) -> np.ndarray:
        p, states = self.p, []
        for way in "fb":
            steps = None if tape is None else tape.setdefault(way, [])
            states.append(self._run(way, embedded @ p[f"{way}_in"] + p[f"{way}_bias"], rows, steps))
        hidden = np.concatenate(states, axis=2)
        bent = np.tanh(hidden @ p["att"] + p["att_bias"])
        there = rows > 0
        there[:, 0] = True  # an empty text attends to its first place
        weight = np.where(there, bent @ p["att_to"], np.float32(-1e9))
        weight = np.exp(weight - weight.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", weight, hidden)
        if tape is not None:
            tape |= {"hidden": hidden, "bent": bent, "weight": weight, "pooled": pooled}
        return pooled @ p["out"] + p["out_bias"][0]

    def gradients(self, vocabulary: Vocabulary, rows: np.ndarray, label: np.ndarray, weight: np.ndarray, keep_word: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss over windows."""
        p, sizes, h, tape, g = self.p, self.sizes, self.sizes.hidden, {}, {}
        embedded = self.embed(vocabulary, keep_word)
        logit = self.logits(embedded, rows, tape)
        d_logit = ((_sigmoid(logit) - label) * weight / weight.sum()).astype(np.float32)
        g["out"], g["out_bias"] = tape["pooled"].T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        a, hidden, bent = tape["weight"], tape["hidden"], tape["bent"]
        d_a = np.einsum("nh,nth->nt", d_pooled, hidden)
        d_score = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
        g["att_to"] = np.einsum("nt,nta->a", d_score, bent)
        d_bent = d_score[:, :, None] * p["att_to"] * (1 - bent * bent)
        g["att"], g["att_bias"] = np.einsum("nth,nta->ha", hidden, d_bent), d_bent.sum(axis=(0, 1))
        d_hidden = a[:, :, None] * d_pooled[:, None, :] + d_bent @ p["att"].T
        d_embedded = np.zeros_like(embedded)
        for way, part in (("f", d_hidden[:, :, :h]), ("b", d_hidden[:, :, h:])):
            carry = np.zeros((len(rows), h), np.float32)
            d_gates = np.empty((*rows.shape, 3 * h), np.float32)
            g[f"{way}_rec"] = np.zeros_like(p[f"{way}_rec"])
            for t, before, z, r, q, c in reversed(tape[way]):
                d = part[:, t] + carry
                d_c = d * z * (1 - c * c)
                d_z, d_r = d * (c - before) * z * (1 - z), d_c * q * r * (1 - r)
                into = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g[f"{way}_rec"] += before.T @ into
                carry = d * (1 - z) + into @ p[f"{way}_rec"].T
                d_gates[:, t] = np.concatenate([d_z, d_r, d_c], axis=1)
            flat, to = d_gates.reshape(-1, 3 * h), rows.ravel()
            by_word = np.stack([np.bincount(to, flat[:, j], len(embedded)) for j in range(3 * h)], axis=1).astype(np.float32)
            g[f"{way}_bias"], g[f"{way}_in"] = flat.sum(axis=0), embedded.T @ by_word
            d_embedded += by_word @ p[f"{way}_in"].T
        d_word = d_embedded[:, : sizes.word_dim] * keep_word[:, None]
        g["word"] = np.stack([np.bincount(vocabulary.slot, d_word[:, j], sizes.word_slots) for j in range(sizes.word_dim)], axis=1)
        count = np.diff(vocabulary.first)
        d_gram = np.repeat(d_embedded[:, sizes.word_dim :] / np.sqrt(np.maximum(count, 1))[:, None], count, axis=0)
        g["gram"] = np.stack([np.bincount(vocabulary.grams, d_gram[:, j], sizes.gram_slots) for j in range(sizes.gram_dim)], axis=1)
        return g


def _part(vocabulary: Vocabulary, rows: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The words of these windows alone, and the windows in their numbers; 0 stays the padding."""
    used, inverse = np.unique(np.r_[0, rows.ravel()], return_inverse=True)
    count = vocabulary.first[used + 1] - vocabulary.first[used]
    first = np.r_[0, np.cumsum(count)]
    inner = np.arange(first[-1]) - np.repeat(first[:-1], count)
    return Vocabulary(vocabulary.slot[used], vocabulary.grams[np.repeat(vocabulary.first[used], count) + inner], first), inverse[1:].reshape(rows.shape)


class Scorer:
    """A trained network with the scale that turns a text's highest logit into a score."""

    def __init__(self, network: Network, slope: float = 1.0, shift: float = 0.0):
        self.network, self.slope, self.shift = network, slope, shift

    def raw(self, texts: pa.Array) -> np.ndarray:
        """The highest logit of each text over all of its windows."""
        vocabulary, number, at = words_in_slices(texts, self.network.sizes)
        rows, text = windows(number, at)
        embedded = self.network.embed(vocabulary)
        best = np.full(len(texts), -np.inf)
        for i in range(0, len(rows), BATCH):
            np.maximum.at(best, text[i : i + BATCH], self.network.logits(embedded, rows[i : i + BATCH]))
        return best

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.shift, -40, 40)))


def fit(texts: list[str], toxic: list[int], share_toxic: float, least_epochs: int = 4, least_steps: int = 250, windows_a_text: int = 16, batch: int = 256, seed: int = 11) -> Scorer:
    """Train on labelled texts; a fifth is held back to set the scale.

    Labels belong to texts, not windows: at first each of up to ``windows_a_text`` windows of a text
    takes its label; after each epoch only the higher half of what a toxic text has left does, down
    to an eighth (one window at least). Losses are weighted to
    balance the classes, and the scale to the share of toxic texts among all labels.
    Few windows are gone through more often, up to ``least_steps`` steps.
    ``windows_a_text`` bounds the training windows as ``train`` bounds the rows; scores take all windows.
    """
    rng, network = np.random.default_rng(seed), Network(Sizes(), seed)
    toxic = np.asarray(toxic, np.int64)
    if len(set(toxic.tolist())) < 2:  # nothing to learn: every text gets the share
        network.p["out"][:] = 0
        share = min(max(share_toxic, 1e-6), 1 - 1e-6)
        return Scorer(network, 1.0, float(np.log(share / (1 - share))))
    column = pa.array(texts, pa.string())
    back = np.zeros(len(toxic), bool)
    for kind in (0, 1):  # a fifth of either class, if it has enough
        own = rng.permutation(np.flatnonzero(toxic == kind))
        back[own[: len(own) // 5]] = True
    vocabulary, number, at = words_in_slices(column, network.sizes)
    rows, text = windows(number, at)
    order = rng.permutation(len(rows))
    order = order[np.argsort(text[order], kind="stable")]
    turn = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    use = order[(turn < windows_a_text) & ~back[text[order]]]
    rows, text = rows[use], text[use]
    del number, at, order, turn
    release()
    label = toxic[text].astype(np.float32)
    on = np.ones(len(rows), bool)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step, epochs = 0, max(least_epochs, -(-least_steps * batch // len(rows)))
    for epoch in range(min(epochs, 40)):
        if epoch:
            embedded = network.embed(vocabulary)
            logit = np.concatenate([network.logits(embedded, rows[i : i + BATCH]) for i in range(0, len(rows), BATCH)])
            by = np.lexsort((-logit, text))
            place = np.empty(len(rows), np.int64)
            place[by] = np.arange(len(by)) - np.searchsorted(text[by], text[by])
            on = (label == 0) | (place < -(-np.bincount(text)[text] // 2 ** min(epoch, HALVINGS)))
        use = rng.permutation(np.flatnonzero(on))
        balance = np.where(label == 1, (label[use] == 0).sum() / max(1, (label[use] == 1).sum()), 1.0).astype(np.float32)
        for i in range(0, len(use), batch):
            pick = use[i : i + batch]
            own, numbers = _part(vocabulary, rows[pick])
            keep = (rng.random(len(own.slot)) >= 0.7).astype(np.float32)  # so that n-grams learn too
            step += 1
            rate = 0.01 * (1 - 0.9 * min(1.0, (epoch + i / len(use)) / epochs))
            for k, g in network.gradients(own, numbers, label[pick], balance[pick], keep).items():
                if k in ("word", "gram"):  # what few texts show fades
                    g = g + 3e-4 * network.p[k]
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                network.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    scorer = Scorer(network)
    scale = np.flatnonzero(back) if len(set(toxic[back].tolist())) == 2 else np.arange(len(toxic))
    x, y = scorer.raw(column.take(pa.array(scale))), toxic[scale]
    share = min(max(share_toxic, 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum()) * len(y)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit, held near slope 1 and shift 0
        q = 1 / (1 + np.exp(-np.clip(slope * x + shift, -40, 40)))
        e, s = weight * (q - y), weight * q * (1 - q)
        gradient = np.array([(e * x).sum() + 0.1 * (slope - 1), e.sum() + 0.1 * shift])
        curve = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.1]])
        move = np.linalg.solve(curve, gradient)
        move *= min(1.0, 1.0 / max(1e-9, np.abs(move).max()))
        slope, shift = max(0.05, slope - move[0]), shift - move[1]
    return Scorer(network, float(slope), float(shift))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 800, most_clean: int = 1600, most_chars: int = 12_000) -> Scorer:
    """Fit on a bounded sample: at most ``most_toxic`` and ``most_clean`` labelled documents of at most
    ``most_chars`` characters, drawn by a hash of the id from rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text").between(1, most_chars))
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = [known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most) for kind, most in ((1, most_toxic), (0, most_clean))]
    # At most most_toxic + most_clean ids: small enough to send to every task.
    sample = texts.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    share = count.get(1, 0) / max(1, sum(count.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        made = pickle.dumps(fit([text for _, text, _ in rows], [toxic for _, _, toxic in rows], share))
        del rows
        release()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["scorer"])

    # One task fits it, so that the driver, which lives on, takes the network alone and not what the fit needs.
    made = sample.select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "scorer binary").collect()
    return pickle.loads(made[0].scorer) if made else fit([], [], share)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score every whole text: (doc_id, held_out, score, predicted), a row for each row of ``docs``.

    The score is that of the worst of all overlapping windows; a null or empty text is one empty
    window. Held out are documents with crc32(doc_id as text) mod 3 = 1, whose labels are never read;
    a null id isn't held out. Labels that are null, neither 0 nor 1, or of no document are ignored;
    of repeated ones 1 wins; without both classes every score is the share of 1. Only texts are
    inputs. Extra columns are not read.

    Plan: the network is fitted by one task, on a bounded sample (see ``train``), and sent to the
    others, a few MB at any size of the corpus; texts are scored in one narrow pass, slice by slice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in chunks(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.score(batch.column("text")), pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under the threshold. Trains and scores as above."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in chunks(batches, "text", SLICE):
            yield batch.filter(pa.array(scorer.score(batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)

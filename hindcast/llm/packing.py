"""Token packing: sum-of-squares online placement of documents into fixed windows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Bytes of text encoded at a time.
SLICE_BYTES = 2 << 20
#: Runs of letters that one call of the tokenizer encodes.
RUNS = 500

#: Letters below U+0250 but for U+0130: they stay single letters under NFC and lower-casing.
_LETTERS = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+"
#: ASCII punctuation without the apostrophe, which starts contractions.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SIMPLE = f"^{_LETTERS}[{''.join(chr(92) + c for c in _MARKS)}]*$"


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` that begin at ``start``, one behind the other."""
    ends = np.cumsum(size)
    return pool[np.arange(size.sum()) + np.repeat(start - (ends - size), size)]


class WordEncoder:
    """Ids of whole texts, by the distinct white-space separated words of a slice of them.

    The tokenizer's normaliser and its split pattern treat ASCII white space as a boundary that no
    token, composition or added token crosses, so the ids of a text are those of its words in turn.
    Likewise a run of letters and the punctuation after it are tokens of their own. Runs of letters
    that are lower-cased already need neither normaliser nor split pattern, ASCII ones no byte
    mapping either, so the tokenizer's model gets them, many to a call, without these.
    Nothing is kept from one slice to the next.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks take the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        blank = pre_tokenizers.WhitespaceSplit()
        self.ascii, self.accented = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = blank
        self.accented.pre_tokenizer = pre_tokenizers.Sequence([blank, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _each(self, tokenizer, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids, and number of ids for each, of texts encoded one by one."""
        ids, sizes = [], []
        for i in range(0, len(texts), 4000):
            own = [e.ids for e in tokenizer.encode_batch_fast(texts[i : i + 4000], add_special_tokens=False)]
            ids.append(np.fromiter((x for o in own for x in o), np.uint32))
            sizes.append(np.array([len(o) for o in own], np.int64))
        return ids, sizes

    def _runs(self, tokenizer, runs: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same of runs of letters."""
        ids, sizes = [], []
        for i in range(0, len(runs), 64 * RUNS):
            calls = [runs[j : j + RUNS] for j in range(i, min(i + 64 * RUNS, len(runs)), RUNS)]
            for part, own in zip(calls, tokenizer.encode_batch_fast([" ".join(c) for c in calls], add_special_tokens=False)):
                found = np.array(own.ids, np.uint32)
                ends = np.flatnonzero(self.ends_word[found]) + 1  # the last id of a run of letters, and no other, ends a word
                if len(ends) == len(part):
                    ids.append(found)
                    sizes.append(np.diff(ends, prepend=0))
                else:
                    for have, more in zip((ids, sizes), self._each(tokenizer, part)):
                        have += more
        return ids, sizes

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and number of ids for each, of distinct words."""
        simple = pc.match_substring_regex(words, _SIMPLE)
        plain = words.filter(simple)
        runs = pc.utf8_lower(pc.utf8_rtrim(plain, characters=_MARKS)).dictionary_encode()
        marks = pc.replace_substring_regex(plain, "^" + _LETTERS, "").dictionary_encode()
        other = [w.decode("utf-8", "replace") for w in words.filter(pc.invert(simple)).cast(pa.binary()).to_pylist()]
        narrow = pc.string_is_ascii(runs.dictionary)
        parts = [
            self._runs(self.ascii, runs.dictionary.filter(narrow).to_pylist()), self._runs(self.accented, runs.dictionary.filter(pc.invert(narrow)).to_pylist()),
            self._each(self.tokenizer, marks.dictionary.to_pylist()), self._each(self.tokenizer, other),
        ]
        pool = np.concatenate([np.zeros(0, np.uint32), *(x for ids, _ in parts for x in ids)])
        size = np.concatenate([np.zeros(0, np.int64), *(x for _, sizes in parts for x in sizes)])
        start = np.cumsum(size) - size
        # Places in ``size``: ASCII runs, accented ones, marks, other words. A word is up to two of them.
        narrow, n_runs, n_marks = narrow.to_numpy(zero_copy_only=False), len(runs.dictionary), len(marks.dictionary)
        of_run = np.where(narrow, np.cumsum(narrow) - 1, narrow.sum() + np.cumsum(~narrow) - 1)
        simple = simple.to_numpy(zero_copy_only=False)
        first, second = np.zeros((2, len(words)), np.int64)
        first[simple] = of_run[runs.indices.to_numpy()]
        second[simple] = n_runs + marks.indices.to_numpy()
        first[~simple] = n_runs + n_marks + np.arange(len(other))
        both = np.stack([first, second], 1)
        sizes = np.stack([size[first], np.where(simple, size[second], 0)], 1) if len(size) else np.zeros((len(words), 2), np.int64)
        return _gather(pool, start[both].ravel(), sizes.ravel()) if len(size) else pool, sizes.sum(1)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a string column; a null is empty."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        ids, sizes = self._words(words.dictionary)
        lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int64()), pa.array(ids))
        found = lists.take(words.indices)
        at = found.offsets.to_numpy()[split.offsets.to_numpy()].tolist()
        values = found.values.to_numpy()
        for a, b in zip(at, at[1:]):
            yield values[a:b]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class SumOfSquares:
    """Online packing: each piece goes to the fill level that minimises the sum of squared counts
    of partially filled windows. ``count[h]`` is the level array; ``open[h]`` holds the windows.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece of under ``capacity`` ids into a window; give that window back if it is full."""
        c, count = self.capacity, self.count
        # Moving a window from level h to h + size changes the sum of squares by
        # 2 (count[h + size] - count[h]) + 2, without the term of a level that has no count
        # (0: a fresh window, capacity: a full one).
        change = 2 * (count[size:] - count[: c + 1 - size]) + 2
        change[0] = 2 * count[size] + 1
        if c - size > 0:
            change[c - size] = 1 - 2 * count[c - size]
        change[1:][count[1 : c + 1 - size] == 0] = np.iinfo(np.int64).max
        # Of equal changes the fullest window is taken.
        level = len(change) - 1 - int(np.argmin(change[::-1]))
        window = self.open[level].pop() if level else []
        if level:
            count[level] -= 1
        window.append(piece)
        if level + size == c:
            return window
        count[level + size] += 1
        self.open.setdefault(level + size, []).append(window)
        return None

    def rest(self) -> list[tuple]:
        """Pieces of the windows that are still open, fullest first."""
        return [piece for level in sorted(self.open, reverse=True) for window in self.open[level] for piece in window]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack the ids of all documents into sequences of at most ``window`` ids.

    Returns a row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). A
    document is the ids of its text and ``end_id``; a null or empty text is ``end_id`` alone. Whole
    windows are cut off long documents; what is left of each document is placed by sum of squares.
    A window that a task leaves open at its end is emptied: its pieces are laid end to end and cut
    at ``window``, and the last stretch is cut into powers of two, which need no padding. Repeated
    rows are packed again; a null id stays null. Extra columns are not read.

    Plan: one narrow pass; each task packs its own rows, so nothing is shuffled, and its state is
    bounded by the level array (at most one open window per level needs to be held for long, and
    open windows hold only the ids that fill them). A lost task is packed again the same way.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        state = SumOfSquares(window)
        made = 0
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), crc32(ids.astype("<u4").tobytes()), total, base + made, at))
                at += len(ids)
            made += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in chunks(batches, "text", SLICE_BYTES):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                ids = np.append(ids, np.uint32(end_id))
                total = len(ids)
                whole = total - total % window
                for start in range(0, whole, window):
                    close([(doc, start, ids[start : start + window], total)])
                if whole < total:
                    full = state.place((doc, whole, ids[whole:].copy(), total), total - whole)
                    if full:
                        close(full)
            yield flush()

        left = state.rest()
        remaining = sum(len(ids) for _, _, ids, _ in left)
        sequence: list[tuple] = []
        room = _next_length(remaining, window)
        for doc, start, ids, total in left:
            while len(ids):
                take = min(room, len(ids))
                sequence.append((doc, start, ids[:take], total))
                start, ids, room, remaining = start + take, ids[take:], room - take, remaining - take
                if not room:
                    close(sequence)
                    sequence = []
                    room = _next_length(remaining, window)
        yield flush()

    return docs.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _next_length(remaining: int, window: int) -> int:
    """The next sequence of the rest: a whole window, else the largest power of two that fits."""
    return window if remaining >= window else 1 << remaining.bit_length() - 1 if remaining else 0

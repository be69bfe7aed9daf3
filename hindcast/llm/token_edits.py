"""Edit-aware token counts: a segment tree of pre-tokens for each document."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Pre-tokens in a leaf of the tree; a leaf that grows to eight times as many has the tree rebuilt.
LEAF = 32
#: A pre-token depends on at most this many characters after its end (the pattern looks no further).
LOOK = 4
CACHE_PIECES = 1_000_000


class PieceCounter:
    """Token counts of pre-tokens, remembered by piece."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            missing = set(pieces).difference(self.known)
            if len(self.known) + len(missing) > CACHE_PIECES:
                self.known.clear()
                missing = set(pieces)
            for piece in missing:
                self.known[piece] = len(self.encode(piece))
            return list(map(self.known.__getitem__, pieces))


class TokenTree:
    """Sums of characters and tokens over the pre-tokens of one text; an edit re-encodes what it touches."""

    def __init__(self, text: str, counter: PieceCounter):
        self.counter = counter
        self.encoded = 0
        self._build(counter.pattern.findall(text))
        self.built = self.encoded

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.encoded += len(pieces)
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if pieces:
            each = np.array([list(map(len, pieces)), self.counter.counts(pieces)]).T
            self.sums[self.size : self.size + len(self.leaves)] = np.add.reduceat(each, np.arange(0, len(pieces), LEAF))
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    def text(self) -> str:
        return "".join(piece for leaf in self.leaves for piece in leaf)

    def _set(self, leaf: int, pieces: list[str]) -> None:
        self.leaves[leaf] = pieces
        node = self.size + leaf
        self.sums[node] = sum(map(len, pieces)), sum(self.counter.counts(pieces))
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (the last one that holds any, at the end), and its first character."""
        node, before = 1, 0
        while node < self.size:
            left = int(self.sums[2 * node, 0])
            if at - before < left or not self.sums[2 * node + 1, 0]:
                node = 2 * node
            else:
                before += left
                node = 2 * node + 1
        return node - self.size, before

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replace ``length`` characters from ``start`` on; both are cut to the text."""
        start = min(max(start, 0), self.chars)
        end = min(start + max(length, 0), self.chars)
        first, at = self._find(max(0, start - LOOK))
        head, keep = self.leaves[first], 0
        # Pre-tokens that end LOOK characters before the edit stand as they are.
        while keep < len(head) and at + len(head[keep]) + LOOK <= start:
            at += len(head[keep])
            keep += 1
        old, last, begin = head[keep:], first, at
        reach = at + sum(map(len, old))
        more = 1
        while True:
            while reach < self.chars and (reach < end + 8 * LOOK or more > 1):
                last += 1
                old = old + self.leaves[last]
                reach += sum(map(len, self.leaves[last]))
                more -= bool(self.leaves[last])
            joined = "".join(old)
            new = joined[: start - begin] + replacement + joined[end - begin :]
            shift = len(new) - len(joined)
            edges, place = {}, begin
            for i, piece in enumerate(old):  # old boundaries after the edit, in the new text's places
                if place >= end:
                    edges.setdefault(place - begin + shift, i)
                place += len(piece)
            sure = len(new) if reach == self.chars else len(new) - LOOK
            pieces, done, rest = [], 0, None
            for match in self.counter.pattern.finditer(new):
                if done in edges and done >= start - begin + len(replacement):
                    rest = edges[done]
                    break
                if match.end() > sure:
                    break
                pieces.append(match.group())
                done = match.end()
            if rest is None and reach == self.chars and done == len(new):
                rest = len(old)
            if rest is not None:
                break
            more = 2 * (last - first + 1)  # no boundary is shared so far: look further
        self.encoded += len(pieces)
        for leaf in range(first + 1, last + 1):
            self._set(leaf, [])
        grown = head[:keep] + pieces + old[rest:]
        if len(grown) > 8 * LEAF:
            self.leaves[first] = grown
            self._build([piece for leaf in self.leaves for piece in leaf])
        else:
            self._set(first, grown)


_counters: dict[tuple[str, str], PieceCounter] = {}


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``edits`` from a table (id, seq, start, length, replacement).

    Edits of one id are applied by seq (ties by start, length, replacement); those of no document are
    dropped. An id's edits meet in one row, as its text does.
    """
    listed = edits.groupBy(F.col(id_col).alias("edited")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "length", "replacement"))).alias("edits"))
    listed = listed.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["length"].cast("long").alias("length"), e["replacement"].alias("replacement"))))
    return docs.join(listed, docs[id_col] == listed["edited"], "left").drop("edited")


def count_after_edits(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Token counts before and after each document's edits.

    ``edits``: array of (start, length, replacement) in characters, applied in order, each to the text
    that the ones before it left; positions are cut to the text, a null replacement is empty, an edit
    with a null position is skipped. Returns, a row for each row of ``docs``: (doc_id, tokens_before,
    tokens_after, chars_after, n_edits, n_pretokens, n_reencoded), the last being the pre-tokens that
    the edits had encoded. A null text is empty, null edits are none. Extra columns are not read.

    Plan: one narrow pass; a tree lives as long as its document's row is worked on.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).alias("edits"))
    names = ["doc_id", "tokens_before", "tokens_after", "chars_after", "n_edits", "n_pretokens", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (ranks_path, pattern)
        counter = _counters.get(key) or _counters.setdefault(key, PieceCounter(*key))
        for batch in chunks(batches, "text"):
            rows = []
            for doc, text, edits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "edits"))):
                tree = TokenTree(text or "", counter)
                before, done = tree.tokens, 0
                for e in edits or []:
                    if e is not None and e["start"] is not None and e["length"] is not None:
                        tree.edit(e["start"], e["length"], e["replacement"] or "")
                        done += 1
                rows.append((doc, before, tree.tokens, tree.chars, done, tree.built, tree.encoded - tree.built))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))

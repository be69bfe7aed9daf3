"""Line deduplication: drop lines whose normalised form many documents share."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stage

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, least_chars: int) -> list[bytes | None]:
    """16-byte hash of each line's key, None for keys under ``least_chars`` code points.

    A key is the line without white space [\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased.
    """
    out: list[bytes | None] = []
    for line in text.translate(LOWER).split(b"\n"):
        key = line.strip(SPACE)
        long = len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars)
        out.append(blake2b(key, digest_size=16).digest() if long else None)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop every line whose key at least ``least_docs`` documents hold, except in the largest id holding it.

    Returns (doc_id, text, n_lines, n_dropped, kept_sha256), a row for each row of ``docs``; ``text``
    has the lines that stay, in order, joined by newlines. A null or empty text is one empty line.
    Documents are told apart by id: rows that repeat an id count once and lose the same keys. Rows
    with a null id count for no key and keep all their lines. Of the other columns of ``docs`` only
    those in ``keep`` are read; they are returned as they are.

    Plan: keys are exploded as 16-byte hashes, counted by a distinct aggregation that is combined
    before each shuffle, so a key that a third of the documents share stays cheap; only keys over
    the threshold are joined back (AQE splits a hot one), and texts move once, keyed by document.
    """
    carried = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carried)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids, hashed = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = set(line_keys(text or b"", least_chars)) - {None}
                ids += [doc] * len(own)
                hashed += own
            pair = np.frombuffer(b"".join(hashed), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["id", "k1", "k2"])

    held = stage(docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(keys, "id long, k1 long, k2 long"), "line-keys")
    shared = (
        held.groupBy("k1", "k2").agg(F.countDistinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= least_docs).select("k1", "k2", "keeper")
    )
    shared = stage(shared, "line-shared")
    drops = (
        held.join(shared, ["k1", "k2"])
        .filter("id != keeper")
        .groupBy("id")
        .agg(F.collect_set(F.struct("k1", "k2")).alias("drop"))
        .select("id", F.col("drop.k1").alias("d1"), F.col("drop.k2").alias("d2"))
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            kept, n_lines, n_dropped, digest = [], [], [], []
            for text, d1, d2 in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("d1").to_pylist(), batch.column("d2").to_pylist()):
                text = text or b""
                lines = text.split(b"\n")
                stay = lines
                if d1:
                    gone = {np.array(pair, np.int64).tobytes() for pair in zip(d1, d2)}
                    stay = [line for line, key in zip(lines, line_keys(text, least_chars)) if key not in gone]
                joined = b"\n".join(stay)
                kept.append(joined)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                digest.append(sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string())] + [batch.column(c) for c in kept_names],
                ["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"] + kept_names,
            )

    kept_names = docs.columns[2:]
    joined = docs.join(drops, docs.doc_id == drops.id, "left").select("doc_id", "text", "d1", "d2", *kept_names)
    schema = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string" + "".join(f", {name} {kind}" for name, kind in docs.dtypes[2:])
    return joined.mapInArrow(rebuild, schema).withColumnsRenamed(dict(zip(kept_names, keep)))

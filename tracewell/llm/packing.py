"""Packing documents' ids into sequences of a fixed window by non-negative least squares.

Documents are cut at whole windows; what is left of each, 1 to window - 1 ids,
makes a histogram of at most that many bins, which is all the driver sees.  It
enumerates combinations of up to three lengths that fill the window, solves
repeat counts for them by non-negative least squares against the histogram,
rounds them, and packs the residual lengths greedily.  The result is a list of
patterns (lengths, repeats).  Executors number the pieces of each length and
look up the sequence and offset of each number.

Nulls, empties, ties: a null or empty text has only the end id; equal rows are
packed each on its own; a null doc_id is packed like any other; further columns
are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm import tokens
from tracewell.llm.shared import by_batch, by_partition, partitions, record, written

WINDOW, END_ID = 1024, 0
#: Lengths in one combination, at most.
DEPTH = 3
#: Steps of the solver.
STEPS = 400
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def combinations(lengths: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> np.ndarray:
    """Rows of ascending lengths, 0 for none, that add up to the window."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    found = []
    if there[window]:
        found.append(np.array([[0, 0, window]]))
    a = lengths[lengths < window]
    b = window - a
    pairs = (a <= b) & there[b]
    found.append(np.stack([np.zeros(pairs.sum(), int), a[pairs], b[pairs]], axis=1))
    if depth > 2:
        x, y = np.meshgrid(a, a, indexing="ij")
        z = window - x - y
        triples = (x <= y) & (y <= z) & there[np.clip(z, 0, window)]
        found.append(np.stack([x[triples], y[triples], z[triples]], axis=1))
    return np.concatenate(found).astype(np.int64)


def solve_repeats(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats x >= 0 that minimise ||A x - histogram||, by accelerated projected gradient."""
    used = np.where(rows > 0, 1.0, 0.0)
    apply = lambda x: np.bincount(rows.ravel(), (used * x[:, None]).ravel(), len(histogram)) * (np.arange(len(histogram)) > 0)
    weight = 1 / np.sqrt(np.maximum(np.bincount(rows.ravel(), used.ravel(), len(histogram)), 1))  # rows of the system, balanced
    target = histogram * weight
    x = momentum = np.zeros(len(rows))
    t, rate = 1.0, 1 / 9.0  # each column has at most three entries, so the norm is bounded
    for _ in range(steps):
        gap = (apply(momentum) * weight - target) * weight
        new = np.maximum(momentum - rate * 3 * (gap[rows] * used).sum(axis=1), 0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum, x, t = new + (t - 1) / later * (new - x), new, later
    return x


def _round(rows: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats that use no length more often than it occurs; what is left of the histogram."""
    repeats = np.floor(x + 0.5).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    out = np.zeros(len(rows), dtype=np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        if not repeats[i]:
            break
        own, times = np.unique(rows[i][rows[i] > 0], return_counts=True)
        out[i] = min(int(repeats[i]), int((left[own] // times).min()))
        left[own] -= out[i] * times
    return out, left


def _greedy(left: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """Longest first, each with the longest that still fits; whole groups of equal sequences at a time."""
    patterns, left = [], left.copy()
    while left.any():
        lengths, room, own = np.flatnonzero(left), window, []
        taken = np.zeros_like(left)
        while len(fits := lengths[(lengths <= room) & (left[lengths] > taken[lengths])]):
            own.append(int(fits[-1]))
            taken[fits[-1]] += 1
            room -= own[-1]
        used = np.flatnonzero(taken)
        times = int((left[used] // taken[used]).min())
        left -= taken * times
        patterns.append((own, times))
    return patterns


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Patterns (lengths, repeats) that use each length as often as the histogram has it."""
    rows = combinations(np.flatnonzero(histogram), window)
    patterns: list[tuple[list[int], int]] = []
    left = histogram.astype(np.int64)
    if len(rows):
        repeats, left = _round(rows, solve_repeats(rows, histogram.astype(float)), histogram)
        patterns = [([int(v) for v in row if v], int(n)) for row, n in zip(rows, repeats, strict=True) if n]
    return patterns + _greedy(left, window)


def _pieces(docs: DataFrame, path: str, window: int, end_id: int, with_ids: bool) -> DataFrame:
    """Whole windows of each document and what is left of it."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = tokens.encoder(path).encode_ended(batch.column("text"), end_id)
        raw = memoryview(ids.astype("<u4").tobytes())
        windows = -(-counts // window)
        row = np.repeat(np.arange(len(counts)), windows)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * window
        length = np.minimum(counts[row] - start, window)
        at = 4 * ((np.cumsum(counts) - counts)[row] + start)
        pieces = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
        own = pa.array([bytes(x) for x in pieces] if with_ids else [None] * len(pieces), pa.binary())
        return record({"doc_id": batch.column("doc_id").take(pa.array(row)), "start": start, "length": length, "ids_crc32": [zlib.crc32(x) for x in pieces], "doc_tokens": counts[row], "ids": own}, {"ids_crc32": pa.int64()})

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECE)


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces with sequence_id and offset; ids (little-endian uint32) with them if asked for."""
    spark = docs.sparkSession
    pieces = written(_pieces(docs, vocabulary or tokens.default_path(), window, end_id, with_ids), "pieces")
    # Number the pieces of each length: the salt spreads a length that many documents share.
    salts = max(64, 2 * partitions(spark))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        histogram[r["length"]] = r["n"]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "salt"]
    order = W.partitionBy("length", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "start", "ids_crc32")
    numbered = salted.select(*columns, F.row_number().over(order).alias("number")).join(before, ["length", "salt"])
    numbered = numbered.select(*columns[:-1], (F.col("number") + F.col("before") - 1).alias("number"))
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _placed(batch, slots.value, with_ids)

    schema = PIECE + ", sequence_id long, offset long"
    return by_partition(numbered, run, schema if with_ids else schema.replace("ids binary, ", ""))


def _slots(patterns: list[tuple[list[int], int]]) -> dict:
    """For each length the patterns that use it: numbers up to the first column go to sequences from the second, at the third."""
    sequence = 0
    uses: dict[int, list[tuple[int, int, int]]] = {}
    for own, times in patterns:
        offset = 0
        for length in own:
            uses.setdefault(length, []).append((times, sequence, offset))
            offset += length
        sequence += times
    slots = {}
    for length, rows in uses.items():
        times, first, offset = np.array(rows, dtype=np.int64).T
        slots[length] = (np.cumsum(times), first - (np.cumsum(times) - times), offset)
    return slots


def _placed(batch: pa.RecordBatch, slots: dict, with_ids: bool) -> pa.RecordBatch:
    length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
    sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        until, first, at = slots[int(n)]
        use = np.searchsorted(until, number[own], side="right")
        sequence[own] = first[use] + number[own]
        offset[own] = at[use]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    return record({c: batch.column(c) for c in names} | {"sequence_id": sequence, "offset": offset})


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)

"""Exact top-k inner products by three-phase uniform threshold.

The score of a vector is the sum of ``LISTS`` partial scores, one for each run of
dimensions.  Phase 1 gathers, from each partition and list, the entries with the
highest partial scores, with their whole scores; the k-th highest whole score of
a query is a safe cutoff.  Phase 2 broadcasts it: a vector that reaches it must
reach cutoff / LISTS in some list, so only such entries are collected.  Phase 3
adds up their remaining partial scores exactly and keeps what reaches the cutoff.
A vector too short to reach any cutoff of a block (Cauchy and Schwarz) is left out.
Queries go in blocks of bounded size, and through a block in tiles whose scores fit
a core's cache.  The whole-valued vectors are written once, dealt out evenly: a file
of few row groups would else be read by as few tasks, once for each block and phase.

Nulls and ties: vectors that are null or have null or non-finite components take
no part.  Missing dimensions count as 0.  Ties go to the smaller vec_id.  Rows
with the query's vec_id aren't its candidates; a repeated query row counts once.
A null vec_id is neither query nor candidate.  Fewer candidates than k: all of
them.  Scores outside 64 bits are clamped.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.shared import bounds_of, by_batch, by_partition, record, written

LISTS, SCALE = 4, 64
#: Bytes of one block of queries, which is broadcast.
BLOCK_BYTES = 4 << 20
#: Vectors compared with a block at a time.
ROWS = 256
#: Queries compared with them at a time.
TILE = 512
#: Entries that a partition gives for each query and list in the first phase.
EACH = 2


def _whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, width, own): floor(64 x) of each vector that takes part, as bytes of floats that hold it, ``width`` bytes each; dealt out evenly."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = batch.column("embedding")
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
        good = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)], minlength=len(sizes)) == 0
        with np.errstate(invalid="ignore"):
            flat = np.floor(SCALE * flat[np.repeat(good, sizes)])
        sizes = sizes[good].astype(np.int64)
        width = 4 if np.abs(flat).max(initial=0) < 2**24 else 8
        offsets = width * np.concatenate([[0], np.cumsum(sizes)])
        raw = pa.py_buffer((flat.astype(np.float32) if width == 4 else flat).tobytes())
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), raw]).cast(pa.binary())
        return record({"vec_id": batch.column("vec_id").filter(pa.array(good)), "width": np.full(len(sizes), width, np.int32), "own": own})

    kind = dict(vectors.dtypes)["embedding"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return by_batch(rows.repartition(vectors.sparkSession.sparkContext.defaultParallelism), run, "vec_id long, width int, own binary")


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of rows of ``_whole`` as [vector, dimension], missing dimensions 0."""
    width, own = batch.column("width").to_numpy(), batch.column("own")
    offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    if len(own) and (width == width[0]).all() and (sizes == width[0] * dim).all() and dim:
        return np.frombuffer(own.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(f"<f{width[0]}").reshape(len(own), dim)
    out = np.zeros((len(own), dim))
    for i, (w, raw) in enumerate(zip(width.tolist(), own.to_pylist(), strict=True)):
        x = np.frombuffer(raw, f"<f{w}")[:dim]
        out[i, : len(x)] = x
    return out


def _kind(queries: np.ndarray, rows: np.ndarray):
    """The cheapest type that holds all scores of these."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _partials(queries: np.ndarray, rows: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Exact partial scores [query, row] of each list, in the type of both."""
    if queries.dtype != object:
        return [queries[:, a:b] @ rows[:, a:b].T for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [np.clip(queries[:, a:b].dot(rows[:, a:b].T), -(2**62), 2**62) if b > a else np.zeros((len(queries), len(rows)), object) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class _Queries:
    """A block of queries, ascending by id, in the type that the rows at hand ask for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.held: dict = {}

    def tiles(self, rows: np.ndarray, vec_ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """(first query, queries, rows, (query, row) of rows with a query's own id) for each ``TILE`` queries, whose scores fit a core's cache."""
        kind = _kind(self.vectors, rows)
        whole = np.vectorize(int, otypes=[object])
        cast = (lambda x: whole(x)) if kind is object else (lambda x: x.astype(kind, copy=False))
        if kind not in self.held:
            self.held[kind] = cast(self.vectors)
        rows, place = cast(rows), np.searchsorted(self.ids, vec_ids)
        r = np.flatnonzero(self.ids[np.minimum(place, len(self.ids) - 1)] == vec_ids)
        q = place[r]
        for lo in range(0, len(self.ids), TILE):
            inside = (q >= lo) & (q < lo + TILE)
            yield lo, self.held[kind][lo : lo + TILE], rows, (q[inside] - lo, r[inside])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest of all vectors for each query."""
    rows, asked = written(_whole(vectors), "vectors"), written(_whole(queries).dropDuplicates(["vec_id"]), "queries")
    facts = asked.agg(F.count("*").alias("n"), F.max(F.length("own") / F.col("width")).cast("int").alias("dim"), F.max("width").alias("width")).first()
    if not facts["n"]:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    blocks = -(-facts["n"] * facts["width"] * max(1, facts["dim"]) // BLOCK_BYTES)
    bounds = bounds_of(asked, "vec_id", blocks)
    found = None
    for lo, hi in zip(bounds, [*bounds[1:], None], strict=True):
        own = asked.filter((F.col("vec_id") >= lo) & (F.lit(True) if hi is None else F.col("vec_id") < hi))
        part = _block(rows, own, facts["dim"], k)
        found = part if found is None else found.unionByName(part)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(rows: DataFrame, own: DataFrame, dim: int, k: int) -> DataFrame:
    spark = rows.sparkSession
    table = own.orderBy("vec_id").toArrow().combine_chunks()  # one block: BLOCK_BYTES of vectors
    ids = table.column("vec_id").to_numpy()
    edges = np.linspace(0, dim, LISTS + 1).astype(int)
    block = spark.sparkContext.broadcast((ids, _matrix(table.to_batches()[0], dim)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            vec_ids, rows = batch.column("vec_id").to_numpy(), _matrix(batch, dim)
            for lo in range(0, batch.num_rows, ROWS):
                yield vec_ids[lo : lo + ROWS], rows[lo : lo + ROWS]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1: of each list the entries with the highest partial scores here."""
        asked = _Queries(*block.value)
        query = np.arange(len(asked.ids))
        best: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(LISTS)]
        for vec_ids, rows in chunks(batches):
            part, score = np.empty((LISTS, len(query))), np.empty((LISTS, len(query)))
            vec = np.empty((LISTS, len(query)), np.int64)
            for lo, own, others, itself in asked.tiles(rows, vec_ids):
                parts = _partials(own, others, edges)
                total, q = sum(parts[1:], parts[0]), np.arange(len(own))
                total[itself] = np.nan
                for g, x in enumerate(parts):
                    x[itself] = -np.inf
                    at = x.argmax(axis=1)
                    part[g, lo : lo + TILE], score[g, lo : lo + TILE], vec[g, lo : lo + TILE] = x[q, at], total[q, at], vec_ids[at]
            for g in range(LISTS):
                best[g].append((part[g], vec[g], score[g]))
                if len(best[g]) > 8:
                    best[g] = [_highest(best[g], EACH)]
        for g in range(LISTS):
            if best[g]:
                _, vec, score = (x.reshape(len(query), -1) for x in _highest(best[g], EACH))
                there = ~np.isnan(score)
                score = np.where(np.abs(score) >= 2**53, np.nextafter(score, -np.inf), score)  # rounded: no cutoff above a score
                yield record({"q": np.repeat(query, there.sum(axis=1)), "vec_id": vec[there], "score": np.clip(score[there], -(2.0**62), 2.0**62).astype(np.int64)})

    seen = by_partition(rows, gather, "q long, vec_id long, score long").distinct()
    least = seen.groupBy("q").agg(F.try_element_at(F.sort_array(F.collect_list("score"), asc=False), F.lit(k)).alias("least"))
    cutoff = np.full(len(ids), -(2**62), dtype=np.int64)
    for q, v in least.filter(F.col("least").isNotNull()).collect():  # a number for each query of the block
        cutoff[q] = v
    limits = spark.sparkContext.broadcast(cutoff)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3: entries with a sufficient partial score, and their whole scores."""
        asked, floor = _Queries(*block.value), limits.value
        reach = _reach(asked.vectors, floor)
        kept, count = [(np.empty(0, np.int64),) * 3], 0
        for vec_ids, rows in chunks(batches):
            near = _lengths(rows) >= reach
            if not near.any():
                continue
            for q, vec, score in _sufficient(asked, floor, rows[near], vec_ids[near], edges):
                kept.append((q, vec, score))
                count += len(q)
            if count > 4 * k * len(floor) + 100_000:
                kept = [_first(kept, k)]
                count = len(kept[0][0])
        q, vec, score = _first(kept, k)
        yield record({"query_id": asked.ids[q], "vec_id": vec, "score": score})

    return by_partition(rows, collect, "query_id long, vec_id long, score long")


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """The length of each vector, rounded up."""
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)


def _reach(queries: np.ndarray, floor: np.ndarray) -> float:
    """No vector shorter than this reaches the cutoff of a query (Cauchy and Schwarz)."""
    with np.errstate(divide="ignore"):
        return float(np.where(floor <= 0, 0, floor / _lengths(queries)).min(initial=np.inf)) * (1 - 1e-9)


def _sufficient(asked: _Queries, floor: np.ndarray, rows: np.ndarray, vec_ids: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, vec_id, score) of the entries that have a partial score of cutoff / LISTS and reach the cutoff with the others."""
    for lo, own, others, itself in asked.tiles(rows, vec_ids):
        limit = floor[lo : lo + TILE, None].astype(own.dtype)  # beyond its whole numbers: beyond all scores too
        parts = _partials(own, others, edges)
        total, highest = sum(parts[1:], parts[0]), parts[0]
        for x in parts[1:]:
            highest = np.maximum(highest, x)
        enough = (total >= limit) & (highest >= limit / LISTS if own.dtype != object else highest * LISTS >= limit)
        enough = enough.astype(bool)
        enough[itself] = False
        if enough.any():
            q, r = np.nonzero(enough)
            yield q + lo, vec_ids[r], np.clip(total[q, r], -(2**62), 2**62).astype(np.int64)


def _highest(found: list, each: int) -> tuple[np.ndarray, ...]:
    """For each query the ``each`` highest partial scores of several lists of them."""
    parts, vecs, scores = (np.concatenate([x[i].reshape(len(x[i]), -1) for x in found], axis=1) for i in range(3))
    order = np.argsort(-parts, axis=1, kind="stable")[:, :each]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (parts, vecs, scores))


def _first(found: list, k: int) -> tuple[np.ndarray, ...]:
    """At most k entries of each query: the highest scores, ties to the smaller id."""
    q, vec, score = (np.concatenate([x[i] for x in found]) for i in range(3))
    order = np.lexsort((vec, -score, q))
    q, vec, score = q[order], vec[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[place < k], vec[place < k], score[place < k]


def op9(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.filter("vec_id % 20 = 0"))

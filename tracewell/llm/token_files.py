"""Token ids in canonical, length-limited Huffman code.

A file set is a folder with a ``codes`` table (id, bits: from these the canonical
code follows) and a ``blocks`` table in ascending document order.  A block is one
document: its bits and the bit offset of every ``STRIDE``-th id, from each of
which decoding can begin, so that a reader decodes all stretches at once with
one table.  Blocks don't depend on each other.

Nulls, empties, ties, long texts: a null or empty text has only the end id.  A null
doc_id sorts first.  Repeated ids stay, in order of their codes' bytes; equal rows
are interchangeable.  A very long text is one block.  Further columns are ignored.
An empty table makes an empty file set.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import tokens
from tracewell.llm.shared import bounds_of, bucket_of, by_batch, by_partition, partitions, record, shared_folder, written

#: Ids between two checkpoints.
STRIDE = 128
#: Longest code in bits where the vocabulary allows it; a reader's table has 2**LIMIT rows.
LIMIT = 16
#: A row of ``blocks``; first: ids of the file before the document.
BLOCK = "file int, doc_id long, first long, n_tokens long, payload binary, marks binary"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    if limit > 24:
        raise ValueError("more than 2**24 ids")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, is_leaf, leaf_before = leaves, np.ones(len(leaves), dtype=bool), []
    for _ in range(limit):
        leaf_before.append(np.cumsum(is_leaf))
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, packages])
        place = np.argsort(merged, kind="stable")
        level, is_leaf = merged[place], place < len(leaves)
    take = 2 * len(leaves) - 2
    for before in reversed(leaf_before):
        chosen = int(before[take - 1]) if take else 0
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id: ascending by length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = lengths[order].astype(np.int64)
    code, last = 0, int(bits[0]) if len(bits) else 0
    for n in range(last, int(bits[-1]) + 1 if len(bits) else 0):
        own = order[bits == n]
        code <<= n - last
        codes[own] = code + np.arange(len(own))
        code, last = code + len(own), n
    return codes


def encode(ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Bits and checkpoints of each document; ``ends``: where the documents end in ``ids``."""
    bits = lengths[ids].astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    total = np.concatenate([[0], np.cumsum(bits)])
    words = (total[ends] - total[starts] + 31) // 32  # each document begins at a word of its own
    first = np.concatenate([[0], np.cumsum(words)])
    at = total[:-1] + np.repeat(first[:-1] * 32 - total[starts], ends - starts)
    wide = codes[ids].astype(np.uint64) << (64 - bits - (at & 31)).astype(np.uint64)
    size = int(first[-1]) + 1
    # codes don't overlap, so sums of 32-bit parts are exact in doubles
    packed = np.bincount(at >> 5, (wide >> np.uint64(32)).astype(np.float64), size) + np.bincount((at >> 5) + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    raw = packed.astype(np.uint64).astype(">u4").tobytes()
    used = (total[ends] - total[starts] + 7) // 8
    payload = [raw[4 * a : 4 * a + n] for a, n in zip(first[:-1].tolist(), used.tolist(), strict=True)]
    marks = [(at[a:b:STRIDE] - at[a]).astype("<u4").tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return payload, marks


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, bits) for each value of the next ``width`` bits."""
    width = int(lengths.max(initial=1))
    codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
    order = used[np.argsort(codes[used].astype(np.int64) << (width - lengths[used].astype(np.int64)), kind="stable")]
    reach = np.left_shift(1, width - lengths[order].astype(np.int64))
    ids, bits = np.repeat(order, reach), np.repeat(lengths[order], reach)
    pad = (1 << width) - len(ids)
    return np.pad(ids, (0, pad)).astype(np.int64), np.pad(bits, (0, pad), constant_values=1).astype(np.int64), width


def decode(payload: list[bytes], marks: list[bytes], counts: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of all documents, one after another; every stretch between checkpoints advances at once."""
    ids_of, bits_of, width = table
    buffer = np.frombuffer(b"".join(payload) + bytes(8), dtype=np.uint8).astype(np.uint32)
    window = (buffer[:-3] << 24) | (buffer[1:-2] << 16) | (buffer[2:-1] << 8) | buffer[3:]
    begins = np.concatenate([[0], np.cumsum([len(p) for p in payload])[:-1]]).astype(np.int64) * 8
    lanes = np.array([len(m) // 4 for m in marks], dtype=np.int64)
    at = np.frombuffer(b"".join(marks), dtype="<u4").astype(np.int64) + np.repeat(begins, lanes)
    within = np.arange(len(at)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    left = np.minimum(np.repeat(counts, lanes) - within * STRIDE, STRIDE)
    to = np.repeat(np.cumsum(counts) - counts, lanes) + within * STRIDE
    order = np.argsort(-left, kind="stable")
    at, left, to = at[order], left[order], to[order]
    out = np.empty(int(counts.sum()), dtype=np.uint32)
    for step in range(STRIDE):
        live = int(np.searchsorted(-left, -step, side="left"))
        if not live:
            break
        p = at[:live]
        key = (window[p >> 3] >> (32 - width - (p & 7)).astype(np.uint32)) & np.uint32((1 << width) - 1)
        out[to[:live] + step] = ids_of[key]
        at[:live] = p + bits_of[key]
    return out


def _tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = tokens.encoder(path).encode_ended(batch.column("text"), end_id)
        wide = np.maximum.reduceat(ids, np.cumsum(counts) - counts) >= 1 << 16  # texts whose ids take four bytes each
        raw = ids.astype("<u2").tobytes()
        ends = (2 * np.cumsum(counts)).tolist()
        own = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i in np.flatnonzero(wide).tolist():
            own[i] = ids[ends[i] // 2 - counts[i] : ends[i] // 2].astype("<u4").tobytes()
        return record({"doc_id": batch.column("doc_id"), "n_tokens": counts, "ids": own}, {"ids": pa.binary()})

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_tokens long, ids binary")


def _wide(ids: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Ids stored in 2 or 4 bytes each."""
    return np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(x, dtype="<u2" if len(x) == 2 * n else "<u4").astype(np.uint32) for x, n in zip(ids, counts.tolist(), strict=True))])


def _counts(table: DataFrame) -> DataFrame:
    """Rows (id, n); at most one for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            own = np.bincount(_wide(batch.column("ids").to_pylist(), batch.column("n_tokens").to_numpy()))
            if len(own) > len(total):
                total = np.pad(total, (0, len(own) - len(total)))
            total[: len(own)] += own
        used = np.flatnonzero(total)
        yield record({"id": used.astype(np.int64), "n": total[used]})

    return by_partition(table, run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> None:
    """Writes the ids of (doc_id, text) rows, each with ``end_id`` after them, to ``folder``."""
    spark = docs.sparkSession
    table = written(_tokenised(docs, vocabulary, end_id), "token-ids")
    n = partitions(spark)
    bounds = np.array(bounds_of(table, "doc_id", n), dtype=np.int64)
    counted = _counts(table).toPandas()  # one row for each id of the vocabulary at most
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, dtype=np.int64)
    counts[counted["id"]] = counted["n"]
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(record({"id": used.astype(np.int64), "bits": lengths[used].astype(np.int32)}).to_pandas(), "id long, bits int").coalesce(1).write.parquet(f"{folder}/codes")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        per = batch.column("n_tokens").to_numpy()
        payload, marks = encode(_wide(batch.column("ids").to_pylist(), per), np.cumsum(per), lengths, codes)
        return record({"file": bucket_of(batch.column("doc_id"), bounds), "doc_id": batch.column("doc_id"), "n_tokens": batch.column("n_tokens"), "payload": payload, "marks": marks}, {"payload": pa.binary(), "marks": pa.binary()})

    coded = by_batch(table, run, "file int, doc_id long, n_tokens long, payload binary, marks binary")
    ordered = coded.repartitionById(max(n, len(bounds)), F.col("file")).sortWithinPartitions(F.col("file"), F.col("doc_id").asc_nulls_first(), "payload")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: dict[int, int] = {}
        for batch in batches:
            per, file = batch.column("n_tokens").to_numpy(), batch.column("file").to_numpy()
            first = np.cumsum(per) - per
            for f in np.unique(file):
                own = file == f
                first[own] += before.get(int(f), 0) - first[own][0]
                before[int(f)] = int(first[own][-1] + per[own][-1])
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), pa.array(first), *batch.columns[2:]], names=["file", "doc_id", "first", "n_tokens", "payload", "marks"])

    by_partition(ordered, index, BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids): ids as little-endian uint32, start counted over all documents before."""
    code = spark.read.parquet(f"{folder}/codes").toPandas()
    lengths = np.zeros(int(code["id"].max()) + 1 if len(code) else 1, dtype=np.uint8)
    lengths[code["id"]] = code["bits"]
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).toPandas()  # a row for each file
    before = np.zeros(int(sizes["file"].max()) + 2 if len(sizes) else 1, dtype=np.int64)
    before[sizes["file"] + 1] = sizes["n"]
    before = np.cumsum(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            if not batch.num_rows:
                continue
            per = batch.column("n_tokens").to_numpy()
            raw = decode(batch.column("payload").to_pylist(), batch.column("marks").to_pylist(), per, table).astype("<u4").tobytes()
            ends = (4 * np.cumsum(per)).tolist()
            own = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            start = batch.column("first").to_numpy() + before[batch.column("file").to_numpy()]
            yield record({"doc_id": batch.column("doc_id"), "start": start, "n_tokens": batch.column("n_tokens"), "ids": own}, {"ids": pa.binary()})

    return by_partition(blocks, run, "doc_id long, start long, n_tokens long, ids binary")


def op10(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, vocabulary or tokens.default_path(), end_id)
    return digests(read_token_files(spark, folder))


def digests(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

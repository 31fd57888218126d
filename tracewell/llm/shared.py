"""What the operators share: the cluster's shared folder, Arrow batches, words and their hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that Python gets; it bounds a worker's memory.
BATCH_BYTES = 2 << 20
#: Bytes of text hashed at a time.
SLICE_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one of our own in local mode (tests), an error on a cluster."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` on each Arrow batch; a single text may be larger than a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return by_partition(df, run, schema)


def bounded(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Holds Arrow batches to ``size`` bytes from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def by_partition(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bounded(df.sparkSession)
    return df.mapInArrow(function, schema)


def record(columns: dict, types: dict | None = None) -> pa.RecordBatch:
    types = types or {}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, types.get(k)) for k, c in columns.items()], names=list(columns))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before each as make it none of the columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounds_of(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n values of ``key`` that start ranges of about equal size; at most n values reach the driver."""
    found = df.agg(F.percentile_approx(key, [i / n for i in range(n)], 20 * n).alias("b"), F.min(key).alias("least")).first()
    return sorted({*(found["b"] or []), *([found["least"]] if found["least"] is not None else [])})


def bucket_of(keys: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """The range of each key; null keys count as the least."""
    if not len(bounds):
        return np.zeros(len(keys), dtype=np.int32)
    values = keys.fill_null(int(bounds[0])).to_numpy(zero_copy_only=False)
    return np.maximum(np.searchsorted(bounds, values, side="right") - 1, 0).astype(np.int32)


# Words: runs of anything but the six ASCII space characters, A-Z made lower case.

WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that part words where only letters count; bytes over 127 belong to letters.
NOT_LETTER = np.array([not (b >= 128 or chr(b).isalpha()) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_OF = _BYTE[_LOWER]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slice_words(data: np.ndarray, breaks: np.ndarray, space: np.ndarray, letters: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a stretch of bytes; ``breaks``: where texts begin in it."""
    ink = ~space[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    first[breaks] |= ink[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    lengths = np.diff(starts, append=len(data))
    place = np.arange(len(data) - starts[0], dtype=np.int64) - np.repeat(starts - starts[0], lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _ODD, dtype=np.uint64))
    codes = np.where(space, np.uint64(0), _BYTE_OF)[data[starts[0] :]] * powers[place]
    if letters is not None:
        codes[place >= letters] = 0
    return starts, mix64(np.add.reduceat(codes, starts - starts[0]))


def word_hashes(texts: pa.Array, space: np.ndarray = _SPACE, letters: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text), in reading order; null texts have none.  letters: bytes of a word that count."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    found, at, lo = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while lo < len(data):
        hi = min(lo + SLICE_BYTES, len(data))
        while hi < len(data):  # on to the next space, so that no word is cut
            if len(gap := np.flatnonzero(space[data[hi : hi + 4096]])):
                hi += int(gap[0])
                break
            hi = min(hi + 4096, len(data))
        inner = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        starts, hashes = _slice_words(data[lo:hi], inner, space, letters)
        found.append(hashes)
        at.append(starts + lo)
        lo = hi
    return np.concatenate(found), (np.searchsorted(offsets, np.concatenate(at), side="right") - 1).astype(np.int64)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the ascending distinct hashes of its k-word shingles; fewer words count as one shingle."""
    words, of = word_hashes(texts)
    ends = np.searchsorted(of, np.arange(len(texts)), side="right")
    begin = 0
    if len(words) >= k:
        whole = np.zeros(len(words) - k + 1, dtype=np.uint64)
        for i in range(k):
            whole = whole * _ODD + words[i : len(words) - k + 1 + i]
        whole = mix64(whole)
    for end in ends:
        n = end - begin
        if n >= k:
            yield np.unique(whole[begin : end - k + 1])
        elif n:
            short = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[begin:end]:
                    short = short * _ODD + w
            yield mix64(np.array([short], dtype=np.uint64))
        else:
            yield np.empty(0, np.uint64)
        begin = end

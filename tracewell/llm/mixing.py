"""Mixing sources to target weights by blocks of words.

The words of a source's documents, in hashed document order, form one stream that
is cut into blocks of ``BLOCK`` words, a small source into ``FEWEST`` blocks or so of
fewer.  A source's quota counts blocks of its own mean size, as the last is partial.
The mix is dealt into output shards.  Each
shard draws how many of its slots go to each source: multinomial draws whose
probabilities are what the sources have left of their quotas, so that totals
close exactly.  The i-th slot of a source reads the block that the source's
pseudorandom permutation (swap-or-not) maps i to, a new permutation for each pass
over the source.  Documents meet their blocks by a join on the block's index; Spark
takes all slots for as small as the rows they are drawn from, so the join is told
to merge: else every slot of the mix would be broadcast.

Offsets in a source's stream are sums over ``SALTS`` buckets of documents, so a
source of any share of the rows spreads over tasks; nothing depends on how many
tasks there are.  The driver sees a row for each source.  It draws the counts of
``GROUPS`` groups of shards at most; a task draws those of the shards in a group,
one shard of about ``SLOTS`` slots after another.

Nulls, empties, ties: a null text has size 0 and is never taken; a null source is
a source, last in the order; repeated rows each have their own words; further
columns are carried by ``mixed_documents`` and ignored otherwise; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.shared import WORD, by_batch, by_partition, fresh, partitions, record, word_hashes, written

BLOCK = 64
#: Blocks that a source is cut into at least, as far as its words go: quotas are whole blocks.
FEWEST = 16
#: Slots of an output shard, groups of shards at most, and buckets of a source.
SLOTS, GROUPS, SALTS = 4096, 2048, 256
WEIGHTS, MOST = (5, 2, 1), 3
ROUNDS = 24


def _key():
    """A source as a key that is never null: null sorts last."""
    return F.struct(F.col("source").isNull().alias("null"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))


def targets_of(sizes: np.ndarray, weights: np.ndarray, most: int = MOST) -> np.ndarray:
    """Shares by weight of all sizes, none above ``most`` times its size; the excess is shared again by weight."""
    targets, full = np.zeros(len(sizes)), np.asarray(sizes) == 0
    left = float(np.sum(sizes))
    while left > 0 and not full.all():
        share = left * weights * ~full / (weights * ~full).sum()
        over = ~full & (share > most * sizes)
        if not over.any():
            return np.where(full, targets, share)
        targets[over] = most * sizes[over]
        full |= over
        left = float(np.sum(sizes)) - targets.sum()
    return targets


def quotas_of(targets: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, most: int = MOST) -> np.ndarray:
    """Slots of each source: its target in blocks of its own mean size, as its last block is partial."""
    return np.minimum(np.rint(targets * blocks / np.maximum(sizes, 1)).astype(np.int64), most * blocks)


def shard_counts(quota: np.ndarray, shards: int, seed) -> Iterator[np.ndarray]:
    """For each shard the slots of each source: multinomial by what quotas have left; they add up to the quotas."""
    rng, left = np.random.default_rng(seed), quota.astype(np.int64).copy()
    for shard in range(shards):
        slots = int(left.sum()) // (shards - shard)
        own = np.zeros_like(left)
        while slots:
            draw = np.minimum(rng.multinomial(slots, (left - own) / (left - own).sum()), left - own)
            own += draw
            slots -= int(draw.sum())
        left -= own
        yield own


def permuted(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each seed, applied to each index: swap-or-not."""
    x, n = index.astype(np.uint64), n.astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROUNDS):
            key = _mix(seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r)) % n
            other = (key + n - x) % n
            high = np.maximum(x, other)
            swap = _mix(high ^ _mix(seed.astype(np.uint64) + np.uint64(r << 32))) & np.uint64(1)
            x = np.where(swap == 1, other, x)
    return x.astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _sized(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, row): the number of words of each text; ``row`` tells repeated rows apart by their text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, of = word_hashes(batch.column("text"))
        return record({"doc_id": batch.column("doc_id"), "source": batch.column("source"), "digest": batch.column("digest"), "size": np.bincount(of, minlength=batch.num_rows).astype(np.int64)})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return by_batch(rows, run, "doc_id long, source string, digest long, size long").select("doc_id", _key().alias("key"), "size", "digest")


class Mix:
    """The plan of a mix: documents with their places, sources with their targets, and the blocks taken."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 0):
        spark = docs.sparkSession
        self.spark, self.seed = spark, seed
        sized = written(_sized(docs), "sizes")
        salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int"))
        sums = salted.groupBy("key", "salt").agg(F.sum("size").alias("s"))
        found = {(r["key"]["null"], r["key"]["name"]): r["s"] for r in sums.groupBy("key").agg(F.sum("s").alias("s")).collect()}  # a row for each source
        self.sources = sorted(found)
        self.sizes = np.array([found[k] for k in self.sources], dtype=np.int64)
        wide = np.array([weights[i % len(weights)] for i in range(len(self.sources))], dtype=float)
        self.targets = targets_of(self.sizes, wide, most)
        self.width = np.clip(-(-self.sizes // FEWEST), 1, block)
        self.blocks = -(-self.sizes // self.width)
        self.quota = quotas_of(self.targets, self.sizes, self.blocks, most)
        self.places = self._placed(salted, sums)

    def _placed(self, salted: DataFrame, sums: DataFrame) -> DataFrame:
        """(doc_id, source_no, width, size, start): where each document's words start in its source's stream."""
        names = self.spark.createDataFrame([(k[0], k[1], i, int(self.width[i])) for i, k in enumerate(self.sources)], "null boolean, name string, source_no int, width int")
        earlier = W.partitionBy("key").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
        before = sums.select("key", "salt", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
        order = W.partitionBy("key", "salt").orderBy(F.xxhash64("doc_id", "digest"), "doc_id", "digest").rowsBetween(W.unboundedPreceding, -1)
        starts = salted.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
        before = before.join(names.hint("merge"), (F.col("key.null") == names["null"]) & (F.col("key.name") == names["name"]))
        joined = starts.join(before.select("key", "salt", "before", "source_no", "width").hint("merge"), ["key", "salt"])
        return joined.select("doc_id", "digest", "source_no", "width", "size", (F.col("inner") + F.col("before")).alias("start"))

    def slots(self) -> DataFrame:
        """(group, shard, slot, source_no, pass, block): what each slot of each output shard reads."""
        shards = max(1, -(-int(self.quota.sum()) // SLOTS))
        groups, seed, blocks = min(GROUPS, shards), self.seed, self.blocks
        counts = np.array(list(shard_counts(self.quota, groups, seed)))
        first = np.cumsum(counts, axis=0) - counts
        rows = [(g, counts[g].tolist(), first[g].tolist()) for g in range(groups)]
        draws = self.spark.createDataFrame(rows, "group int, counts array<long>, first array<long>").repartition(min(groups, 4 * partitions(self.spark)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, quota, begins in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at = np.array(begins, dtype=np.int64)
                    for shard, own in enumerate(shard_counts(np.array(quota, dtype=np.int64), -(-shards // groups), [seed, group])):
                        source = np.repeat(np.arange(len(own)), own)
                        index = at[source] + np.arange(len(source)) - np.repeat(np.cumsum(own) - own, own)
                        turn = index // blocks[source]
                        take = permuted(index % blocks[source], blocks[source], seed * 1_000_003 + source * 64 + turn)
                        at += own
                        yield record({"group": np.full(len(source), group, np.int32), "shard": np.full(len(source), shard, np.int32), "slot": index, "source_no": source.astype(np.int32), "pass": turn.astype(np.int32), "block": take})

        return by_partition(draws, run, "group int, shard int, slot long, source_no int, pass int, block long")

    def pieces(self) -> DataFrame:
        """(doc_id, digest, source_no, size, block, words, from): the part of each block that a document fills."""
        b = F.col("width")
        spans = self.places.filter("size > 0")
        first, last = F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b)
        cut = spans.withColumn("block", F.explode(F.sequence(first, last)))
        lo = F.greatest(F.col("start"), F.col("block") * b)
        hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return cut.select("doc_id", "digest", "source_no", "size", "start", "block", (hi - lo).alias("words"), (lo - F.col("start")).alias("from"))


def taken_words(docs: DataFrame, **settings) -> DataFrame:
    """A row (doc_id, size, source_size, target, taken) for each row of ``docs``."""
    mix = Mix(docs, **settings)
    spark = docs.sparkSession
    facts = spark.createDataFrame([(i, int(s), float(t)) for i, (s, t) in enumerate(zip(mix.sizes, mix.targets, strict=True))], "source_no int, source_size long, target double")
    times = mix.slots().groupBy("source_no", "block").agg(F.count("*").alias("times"))
    met = mix.pieces().join(times.hint("merge"), ["source_no", "block"], "left")
    taken = met.groupBy("doc_id", "source_no", "start", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    empty = mix.places.filter("size = 0").select("doc_id", "source_no", "size", F.lit(0).cast("long").alias("taken"))
    rows = taken.select("doc_id", "source_no", "size", "taken").unionByName(empty)
    return rows.join(F.broadcast(facts), "source_no").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """docs' columns, a row for each document and pass over its source that takes words of it: just those words.

    A pass that takes a whole document keeps its text as it is; else the taken
    runs of words keep their spacing and a newline parts them.  n_chars, where
    there, is counted anew.
    """
    mix = Mix(docs, **settings)
    used = mix.pieces().join(mix.slots().select("source_no", "block", "pass").hint("merge"), ["source_no", "block"])
    runs = used.groupBy("doc_id", "digest", "start", "pass").agg(F.array_sort(F.collect_list(F.struct("from", "words"))).alias("runs"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    of, digest, each, one = fresh(docs, "of", "digest", "passes", "runs")
    passes = runs.groupBy(key.alias(of), F.col("digest").alias(digest)).agg(F.array_sort(F.collect_list(F.struct("start", "pass", "runs"))).alias(each))
    marked = docs.withColumns({of: key, digest: F.xxhash64(F.col("text").cast("string"))}).dropDuplicates([of, digest])  # repeated rows: their passes come from one of them
    rows = marked.join(passes, [of, digest]).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(f"{each}.runs").alias(one))
    names = docs.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        import re

        texts = []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column(one).to_pylist(), strict=True):
            spans = [m.span() for m in re.finditer(WORD, text)]
            joint: list[list[int]] = []
            for r in runs:
                lo, hi = r["from"], r["from"] + r["words"]
                if joint and joint[-1][1] == lo:
                    joint[-1][1] = hi
                else:
                    joint.append([lo, hi])
            texts.append(text if joint == [[0, len(spans)]] else "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in joint))
        columns = {n: batch.column(n) for n in names} | {"text": pa.array(texts, pa.string())}
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(t) for t in texts], batch.column("n_chars").type)
        return record(columns)

    return by_batch(rows, cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return taken_words(docs)

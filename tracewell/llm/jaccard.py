"""Exact Jaccard self-join of documents' word shingles with adaptive multi-match prefixes.

Every distinct shingle set is a node; documents with equal sets share one, so
copies are never paired.  Shingles have one global order: by the class (log2) of
how often prefixes hold them, then by hash.  Classes come from a table of
``SLOTS`` bytes, whatever the corpus: shingles that share a slot share the
greatest class in it, which blurs the order and loses nothing, as any order does.

If two sets reach the threshold, their prefixes of n - ceil(t n) + l shingles
share at least l.  Each set picks its own l from the estimated cost of its
candidates: a prefix whose shingles occur in many prefixes grows longer and must
share more.  A pair of sizes n and m needs an overlap of o, so its first l common
shingles are among the first n - o + l and m - o + l.  A pair is verified only if
it so shares the smaller l of the two.

Shingles in one prefix only are dropped.  The others' lists are dealt out as
pairs of chunks of about ``CHUNK`` nodes, so that no task holds a list of any
length.  Inside a task, pairs are tested by size, place and a parity sketch: every
shingle flips one bit, so two sets differ by at least as many shingles as their
sketches differ in bits, and a pair that differs too much can't reach the
threshold.  Only what passes leaves the task.

Dense groups aren't paired out.  First each node is compared with one pivot of its
size in each list, and what links is merged into components.  Then come rounds
over the lists that still hold several components: a node's best partners in
other components, ``QUOTA`` of them and eight times as many in each round, over the
lists that left some out, until a round has left none out.  A pair that meets in several lists is left to the first of
them, as far as the rows' first shared shingles tell.  So the operator gives exact components, not links:
links inside a component aren't all made, and their number doesn't come out of it.
Verification counts the intersection of whole sets, read from the texts again.

Nulls, empties, ties, long texts: a null or wordless text has an empty set and
links with nothing; repeated rows give a row each; a null doc_id is carried
through, but never names a component that has another id; a long text is one row
of its set like any other (20,000 words are 160 kB); further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.components import components
from tracewell.llm.shared import by_batch, by_partition, forget, fresh, partitions, record, shingle_sets, written

#: Slots of the table of count classes, a byte each; it is broadcast.
SLOTS, BLOCKS = 1 << 22, 64
#: A shingle in fewer prefixes than this has class 0.
LIGHT = 3
#: Bits of the bitmap that picks the texts to verify.
PICKS = 1 << 22
#: Nodes of a list that a task compares with as many others.
CHUNK = 2048
#: Partners that a node has in the first round after the pivots.
QUOTA = 4
#: Parts into which the comparisons with one node are dealt.
SALTS = 32
#: Bytes of a sketch at most; it has two bits for each shingle of a smaller set.
SKETCH = 128
#: First shared shingles that a row of a list has with it, to leave a pair to the first list that has both.
LEADS = 4
#: Pairs tested at a time.
TESTED = 1 << 17


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which a partner at the threshold shares at least one."""
    return n - (percent * n + 99) // 100 + 1


def overlap(n, m, percent: int):
    """Shingles that sets of sizes n and m share at the threshold."""
    return -(-(percent * (n + m)) // (100 + percent))


def matches(p: int, cost: float) -> int:
    """How many shared shingles to ask for: one more for each eight of a prefix and doubling of candidates per shingle."""
    return 1 + (p // 8) * min(4, int(np.log2(max(1.0, cost / p))))


def sketch(own: np.ndarray) -> bytes:
    """The parity of how many shingles fall on each bit."""
    size = 8
    while size < SKETCH and 4 * size < len(own):
        size *= 2
    return np.packbits((np.bincount(((own >> np.uint64(40)) & np.uint64(8 * size - 1)).astype(np.int64), minlength=8 * size) & 1).astype(np.uint8)).tobytes()


def _name(own: np.ndarray) -> bytes:
    return blake2b(own.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Each row's node and set size, and the first shingles of its set by hash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = list(shingle_sets(batch.column("text"), k))
        first = [x[: prefix_length(len(x), percent) if len(x) else 0].tobytes() for x in own]
        return record({"doc_id": batch.column("doc_id"), "node": [_name(x) for x in own], "n": [len(x) for x in own], "shingles": first}, {"node": pa.binary(), "n": pa.int32(), "shingles": pa.binary()})

    return by_batch(docs, run, "doc_id long, node binary, n int, shingles binary")


def _classes(rows: DataFrame) -> np.ndarray:
    """The class of each slot; ``BLOCKS`` rows of ``SLOTS`` bytes in all reach the driver."""

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record({"shingle": np.frombuffer(b"".join(batch.column("shingles").to_pylist()), dtype=np.int64)})

    counts = by_batch(rows.filter("n > 0").dropDuplicates(["node"]).select("shingles"), listed, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= LIGHT)
    slots = counts.groupBy(F.col("shingle").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.floor(F.log2(F.max("n"))).cast("int").alias("c"))
    width = SLOTS // BLOCKS
    dealt = slots.repartition(BLOCKS, F.floor(F.col("slot") / width))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            slot, c = batch.column("slot").to_numpy(), batch.column("c").to_numpy()
            for b in np.unique(slot // width).tolist():
                own = slot // width == b
                blocks.setdefault(b, np.zeros(width, np.uint8))[slot[own] % width] = c[own]
        for b, x in blocks.items():
            yield record({"block": [b], "classes": [x.tobytes()]}, {"block": pa.int64(), "classes": pa.binary()})

    out = np.zeros(SLOTS, np.uint8)
    for r in by_partition(dealt, packed, "block long, classes binary").collect():
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["classes"], np.uint8)
    return out


def _nodes(docs: DataFrame, k: int, percent: int, classes) -> DataFrame:
    """A row (id, node, n, l, prefix, sketch) for each distinct set; the prefix is in the global order."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        table, out = classes.value, {}
        for own in shingle_sets(batch.column("text"), k):
            n = len(own)
            if not n or (node := _name(own)) in out:
                continue
            grade = table[(own & np.uint64(SLOTS - 1)).astype(np.int64)]
            p, order = prefix_length(n, percent), np.argsort(grade, kind="stable")
            l = min(matches(p, float(np.exp2(grade[order[:p]].astype(float)).sum())), n - p + 1)
            out[node] = (n, l, own[order[: p + l - 1]].tobytes(), sketch(own))
        if not out:
            return None
        n, l, prefix, bits = zip(*out.values(), strict=True)
        return record({"node": list(out), "n": n, "l": l, "prefix": prefix, "sketch": bits}, {"node": pa.binary(), "n": pa.int32(), "l": pa.int32(), "prefix": pa.binary(), "sketch": pa.binary()})

    once = by_batch(docs.select("text"), run, "node binary, n int, l int, prefix binary, sketch binary").dropDuplicates(["node"])
    return once.select(F.monotonically_increasing_id().alias("id"), "node", "n", "l", "prefix", "sketch")


def _postings(nodes: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [np.frombuffer(x, dtype=np.int64) for x in batch.column("prefix").to_pylist()]
        times = np.array([len(x) for x in own])
        return record({"shingle": np.concatenate(own), "id": np.repeat(batch.column("id").to_numpy(), times), "place": np.concatenate([np.arange(x, dtype=np.int32) for x in times])})

    return by_batch(nodes.select("id", "prefix"), run, "shingle long, id long, place int")


class _Lists:
    """Rows of whole list parts, in the order of (shingle, i, j, n, id), as arrays."""

    def __init__(self, batch: pa.RecordBatch):
        self.shingle, self.i, self.j, self.part, self.id, self.label, self.n, self.l, self.place = (batch.column(c).to_numpy() for c in ("shingle", "i", "j", "part", "id", "label", "n", "l", "place"))
        self.lead = None
        if "lead" in batch.schema.names:
            lead = batch.column("lead")
            self.lead, count = np.zeros((len(self.id), LEADS), np.int64), lead.value_lengths().to_numpy()
            self.led = np.arange(LEADS) < count[:, None]
            self.lead[self.led] = lead.flatten().to_numpy()
        self.sketches = batch.column("sketch")
        offsets = np.frombuffer(self.sketches.buffers()[1], np.int32)[self.sketches.offset : self.sketches.offset + len(self.id) + 1].astype(np.int64)
        self.width, self.at = np.diff(offsets), offsets[:-1]
        self.bytes = np.frombuffer(self.sketches.buffers()[2], np.uint8)
        first = np.ones(len(self.id), bool)
        first[1:] = (self.shingle[1:] != self.shingle[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        self.first = np.flatnonzero(first)
        self.end = np.repeat(np.append(self.first[1:], len(self.id)), np.diff(np.append(self.first, len(self.id))))

    def _matrix(self, width: int, rows: np.ndarray) -> np.ndarray:
        """Sketches of rows, folded to ``width`` bytes."""
        out = np.empty((len(rows), width), np.uint8)
        for own in np.unique(self.width[rows]).tolist():
            of = np.flatnonzero(self.width[rows] == own)
            x = self.bytes[self.at[rows[of]][:, None] + np.arange(own)]
            while x.shape[1] > width:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            out[of] = x
        return out.view(np.uint64)

    def _first_met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """False where both rows lead with another shingle: as the order is global, it is earlier, and its list has the pair."""
        first = np.full(len(a), LEADS)
        for i in range(LEADS - 1, -1, -1):
            first[(self.led[a, i, None] & self.led[b] & (self.lead[a, i, None] == self.lead[b])).any(axis=1)] = i
        return (first == LEADS) | (self.lead[a, np.minimum(first, LEADS - 1)] == self.shingle[a])

    def passing(self, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of rows that may link, and by how much their sketches differ."""
        n, m, l = self.n[a].astype(np.int64), self.n[b].astype(np.int64), np.minimum(self.l[a], self.l[b])
        need = overlap(n, m, percent)
        ok = (self.label[a] != self.label[b]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (self.place[a] < n - need + l) & (self.place[b] < m - need + l)
        ok &= (self.i[a] == self.j[a]) | (self.part[a] != self.part[b])
        if self.lead is not None:
            ok[ok] = self._first_met(a[ok], b[ok])
        a, b, most, total = a[ok], b[ok], (n + m - 2 * need)[ok], (n + m)[ok]
        width, differ = np.minimum(self.width[a], self.width[b]), np.zeros(len(a), np.int64)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            rows, to = np.unique(np.concatenate([a[own], b[own]]), return_inverse=True)
            x = self._matrix(w, rows)
            differ[own] = np.bitwise_count(x[to[: len(own)]] ^ x[to[len(own) :]]).sum(axis=1)
        ok = differ <= most
        return a[ok], b[ok], differ[ok] / total[ok]

    def with_pivots(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each row with the least id of its list part and class of sizes: lists that share their members share pivots.  Two rows alone are a pair."""
        size = np.floor(np.log(self.n) * 8).astype(np.int64)
        size[np.repeat(np.diff(np.append(self.first, len(self.id))) == 2, np.diff(np.append(self.first, len(self.id))))] = 0
        new = np.ones(len(self.id), bool)
        new[1:] = size[1:] != size[:-1]
        new[self.first] = True
        run = np.cumsum(new) - 1
        order = np.lexsort((self.id, run))
        pivot = order[np.flatnonzero(new)][run]
        rows = np.flatnonzero(pivot != np.arange(len(pivot)))
        yield pivot[rows], rows

    def all_pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of a list part whose sizes are near enough, ``TESTED`` or so at a time."""
        live, step, held, count = np.arange(len(self.id)), 1, [], 0
        while len(live):
            live = live[live + step < self.end[live]]
            live = live[100 * self.n[live].astype(np.int64) >= percent * self.n[live + step].astype(np.int64)]  # sizes ascend
            held.append((live, live + step))
            count += len(live)
            step += 1
            if count >= TESTED or not len(live):
                yield np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
                held, count = [], 0


def _best(a: np.ndarray, b: np.ndarray, differ: np.ndarray, quota: int) -> np.ndarray:
    """Which pairs are among the ``quota`` best of either end."""
    keep = np.zeros(len(a), bool)
    for end in (a, b):
        order = np.lexsort((differ, end))
        own = end[order]
        first = np.ones(len(own), bool)
        first[1:] = own[1:] != own[:-1]
        begins = np.flatnonzero(first)
        rank = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
        keep[order[rank < quota]] = True
    return keep


def _candidates(met: DataFrame, percent: int, quota: int) -> DataFrame:
    """(a, b, shingle): pairs of ids that may link, from lists in order; null pairs with the shingles of lists that left some out.  quota 0: with pivots."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, a, b, differ = _Lists(batch), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        less = np.empty(0, np.int64)
        for x, y in lists.all_pairs(percent) if quota else lists.with_pivots():
            x, y, d = lists.passing(x, y, percent)
            a, b, differ = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([differ, d])
            if quota:
                keep = _best(a, b, differ, quota)
                less = np.union1d(less, lists.shingle[a[~keep]])
                a, b, differ = a[keep], b[keep], differ[keep]
        ends = np.unique(np.stack([np.minimum(lists.id[a], lists.id[b]), np.maximum(lists.id[a], lists.id[b])]), axis=1)
        none, pairs = pa.nulls(len(less), pa.int64()), pa.nulls(ends.shape[1], pa.int64())
        return record({k: pa.concat_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())]) for k, x, y in (("a", ends[0], none), ("b", ends[1], none), ("shingle", pairs, less))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in ("shingle", "i", "j")]
            same = np.logical_and.reduce([batch.column(c).to_numpy() == x for c, x in zip(("shingle", "i", "j"), last, strict=True)])
            cut = int(np.flatnonzero(same)[0])  # what follows may go on in the next batch
            if cut:
                yield found(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and [held[-1].column(c)[0].as_py() for c in ("shingle", "i", "j")] != last:
                yield found(pa.concat_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield found(pa.concat_batches(held))

    return by_partition(met, run, "a long, b long, shingle long")


def _compared(pairs: DataFrame, blobs: DataFrame, holds) -> DataFrame:
    """The pairs (a, b) for which ``holds(row of a, row of b)``; blobs: (id, n, l, own).  Comparisons with one node are dealt to ``SALTS`` tasks."""
    spark = pairs.sparkSession
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    right = salted.join(blobs, salted.b == blobs.id).select("a", "salt", "b", "n", "l", "own")
    left = salted.select("a", "salt").distinct().join(blobs, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "n", "l", "own")
    met = right.unionByName(left).repartition(partitions(spark), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for a, _, b, n, l, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = (n, l, np.frombuffer(raw, dtype=np.uint64))
                if b is None:
                    base = row
                elif holds(base, row):
                    found[0].append(a)
                    found[1].append(b)
            yield record({"a": found[0], "b": found[1]}, {"a": pa.int64(), "b": pa.int64()})

    return by_partition(met, compare, "a long, b long")


def _verified(docs: DataFrame, rows: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough and whose whole sets reach the threshold; one document of each node is read."""
    spark = docs.sparkSession

    def shared(x: tuple, y: tuple) -> bool:
        need, l = overlap(x[0], y[0], percent), min(x[1], y[1])
        return len(np.intersect1d(x[2][: x[0] - need + l], y[2][: y[0] - need + l], assume_unique=True)) >= l

    def similar(x: tuple, y: tuple) -> bool:
        common = len(np.intersect1d(x[2], y[2], assume_unique=True))
        return 100 * common >= percent * (x[0] + y[0] - common)

    pairs = written(_compared(pairs, nodes.select("id", "n", "l", F.col("prefix").alias("own")), shared), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    names = written(nodes.select("id", "node").join(ends, "id", "left_semi"), "names")
    of = rows.join(names.select("node"), "node", "left_semi").groupBy("node").agg(F.min_by(F.struct("doc_id"), F.col("doc_id").isNull()).alias("x")).select("x.doc_id")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(PICKS)).cast("int")
    wanted = np.zeros(PICKS, dtype=bool)
    wanted[of.select(slot("doc_id").alias("s")).distinct().toPandas()["s"].to_numpy(int)] = True  # PICKS values at most
    picked = spark.sparkContext.broadcast(np.packbits(wanted))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = batch.column("slot").to_numpy()
        texts = batch.column("text").filter(pa.array((picked.value[s >> 3] >> (7 - (s & 7)) & 1).astype(bool)))
        own = {_name(x): x for x in shingle_sets(texts, k)}
        return record({"node": list(own), "n": [len(x) for x in own.values()], "own": [x.tobytes() for x in own.values()]}, {"node": pa.binary(), "n": pa.int32(), "own": pa.binary()})

    whole = by_batch(docs.select("text", slot("doc_id").alias("slot")), sets, "node binary, n int, own binary").dropDuplicates(["node"])
    whole = written(whole.join(names, "node").select("id", "n", F.lit(0).alias("l"), "own"), "sets", "none")
    found = written(_compared(pairs, whole, similar), "verified")
    forget(pairs, names, whole)
    return found


def node_links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n) of each row, and (node, label) of the nodes that have links."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(_rows(docs, k, percent), "rows", "none")
    classes = spark.sparkContext.broadcast(_classes(rows))
    slim = written(rows.select("doc_id", "node", "n"), "rows", "none")
    forget(rows)
    nodes = written(_nodes(docs, k, percent, classes), "nodes", "none")
    several = _postings(nodes).groupBy("shingle").agg(F.count("*").alias("c")).filter("c > 1")
    shared = written(_postings(nodes).join(several, "shingle"), "postings")
    lead = F.slice(F.array_sort(F.collect_list(F.struct("place", "shingle"))), 1, LEADS)["shingle"].alias("lead")
    about = written(nodes.select("id", "n", "l", "sketch").join(shared.groupBy("id").agg(lead), "id"), "about")
    tried = labels = left = None
    quota = 0
    while True:
        open_lists = shared if not quota else shared.filter("c > 2") if left is None else shared.join(left, "shingle", "left_semi")
        labelled = open_lists if labels is None else open_lists.join(labels.withColumnRenamed("node", "id"), "id", "left")
        labelled = labelled.withColumn("label", F.col("id") if labels is None else F.coalesce("label", "id"))
        if labels is not None:
            mixed = labelled.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("shingle")
            labelled = labelled.join(mixed, "shingle", "left_semi")
        parts = F.ceil(F.col("c") / CHUNK)
        dealt = labelled.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).join(about, "id")
        if quota:
            dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).withColumns({"i": F.least("part", "o"), "j": F.greatest("part", "o")})
        else:
            dealt = dealt.withColumns({"i": F.col("part"), "j": F.col("part")})
        met = dealt.select("shingle", "i", "j", "part", "id", "label", "n", "l", "place", "sketch", *["lead"] * bool(quota)).repartition(partitions(spark), "shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "n", "id")
        found = written(_candidates(met, percent, quota).distinct(), "candidates")
        pairs = found.filter("a is not null").select("a", "b")
        new = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        old, left = left, written(found.filter("a is null").select("shingle"), "left") if quota else None
        more = left is None or left.limit(1).count() > 0
        forget(found, old)
        good = _verified(docs, slim, nodes, new, k, percent)
        tried = new if tried is None else tried.union(new)
        old, labels = labels, components(good, known=labels)
        if old is not labels:
            forget(old)
        forget(good)
        if not more:
            break
        quota = 8 * quota or QUOTA
    forget(shared, about, left)
    named = written(nodes.select("id", "node").join(labels.withColumnRenamed("node", "id"), "id").select("node", "label"), "labels")
    forget(nodes, labels)
    return slim, named


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """A row (doc_id, n_shingles, component_id) for each row of ``docs``."""
    rows, labels = node_links(docs, k, percent)
    named = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left")
    group = F.coalesce(F.col("label").cast("string"), F.hex("node"))  # up to 20 characters, or 32 where there is no link
    least = named.groupBy(group.alias("g")).agg(F.min("least").alias("component_id"))
    of = named.withColumn("g", group).join(least, "g").select(F.col("node").alias("of"), "component_id")
    joined = rows.join(of, (rows.node == of.of) & (rows.n > 0), "left")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, one with the least doc_id (null last); rows are told apart by doc_id and node.

    Wordless rows are in no component: those equal in doc_id and text count once.
    """
    rows, labels = node_links(docs, k, percent)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0)).alias("id"), "node"))
    named = rows.filter("n > 0").groupBy("node").agg(least.alias("least")).join(labels, "node", "left")
    group = F.coalesce(F.col("label").cast("string"), F.hex("node"))
    chosen = named.groupBy(group).agg(F.min("least").alias("x")).select("x.*").toDF(*(key := fresh(docs, "no_id", "id_or_0", "node")))

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes = [_name(x) if len(x) else None for x in shingle_sets(batch.column("text"), k)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], names=[*batch.schema.names, key[2]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    marked = by_batch(docs, mark, schema + f", {key[2]} binary").withColumns({key[0]: F.col("doc_id").isNull(), key[1]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    kept = marked.filter(F.col(key[2]).isNotNull()).dropDuplicates(key).join(chosen, key, "left_semi")  # copies of one row meet as partial sums first
    bare = marked.filter(F.col(key[2]).isNull()).dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(bare.select(*docs.columns))


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return similar_groups(docs, k=4, percent=85)

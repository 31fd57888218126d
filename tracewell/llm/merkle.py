"""Document fingerprints: a Merkle tree over sections, paragraphs and their leaves.

Leaves are cut by content: a paragraph (a line) is cut where a hash of the last
``WINDOW`` characters says so, about every ``LEAF``, at most ``LONGEST``, so that
an insertion shifts no later cut.  A paragraph's digest covers its leaves, a
section's its paragraphs, the root its sections.  A section ends where the digest
of a paragraph says so.  The fingerprint is the root, then the sections with their
digests, paragraphs and shortened leaf digests; equal roots mean equal texts.
``likeness`` and ``differing`` go down only into branches that differ: equal ones
are lined up in order (a longest increasing run of equal branches), and what lies
between is compared one level down.  Text that has moved counts as different.

``chained`` brings each document together with the next one by doc_id: rows are
dealt into ranges of doc_id, each range gets a copy of the first document of the
one after, and partitions are read in order, one document at a time.

Nulls, empties, ties: a null text counts as empty, and an empty text has a root
and no leaves.  A null doc_id sorts first; equal ids are in order of their
texts; a single document's next is itself; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.shared import bounds_of, bucket_of, by_batch, by_partition, partitions, record

#: Characters that decide a cut; characters between cuts on average, and at most.
WINDOW, LEAF, LONGEST = 8, 24, 64
#: A paragraph ends a section with a chance of one in so many.
SECTION = 8
#: Characters of a text that are hashed at a time, and of a leaf's name: its length and 42 bits of its digest.
SLICE, SHORT = 1 << 18, 8
_LENGTH = {base64.b64encode(bytes([x << 2]))[:1].decode(): x + 1 for x in range(64)}
_WEIGHTS = [np.uint32(x | 1) for x in np.random.default_rng(11).integers(1 << 31, 1 << 32, WINDOW)]


def _digest(data: bytes, kind: bytes) -> bytes:
    return blake2b(data, digest_size=16, person=kind).digest()


def _cuts(text: str) -> list[int]:
    """Places at which the content ends a leaf; only characters of the same line count."""
    found = []
    for lo in range(0, len(text), SLICE):
        start = max(0, lo - WINDOW)
        codes = np.frombuffer(text[start : lo + SLICE].encode("utf-32-le"), "<u4")
        place = np.arange(len(codes), dtype=np.int32)
        since = place - np.maximum.accumulate(np.where(codes == 10, place, -1 if start == 0 else -WINDOW - 1))
        mixed = np.zeros(len(codes), np.uint32)
        for j, weight in enumerate(_WEIGHTS[: len(codes)]):
            mixed[j:] += (codes[: len(codes) - j] + np.uint32(1)) * weight * (since[j:] > j)
        mixed = (mixed ^ (mixed >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        at = np.flatnonzero((((mixed >> np.uint32(8)) % np.uint32(LEAF)) == 0) & (since > 0)) + start + 1
        found += at[at > lo].tolist()
    return found


def _paragraphs(text: str) -> Iterator[list[str]]:
    """The leaves of each line."""
    cuts = [*_cuts(text), len(text) + 1]
    at = next_cut = 0
    for line in text.split("\n"):
        stop, leaves = at + len(line), []
        while at < stop:
            end = min(cuts[next_cut], stop, at + LONGEST)
            leaves.append(text[at:end])
            at = end
            if cuts[next_cut] == at:
                next_cut += 1
        yield leaves
        at = stop + 1


def fingerprint(text: str) -> str:
    """root|section:paragraph,paragraph|section:..., a paragraph being its leaves, ``SHORT`` characters each."""
    sections: list[tuple[bytes, list[str]]] = []
    inner: list[bytes] = []
    names: list[str] = []
    for found in _paragraphs(text) if text else ():
        leaves = [_digest(x.encode(), b"leaf") for x in found]
        own = _digest(b"".join(leaves), b"paragraph")
        inner.append(own)
        names.append(base64.b64encode(b"".join(bytes([(len(own_text) - 1) << 2 | x[0] & 3]) + x[1:6] for own_text, x in zip(found, leaves, strict=True))).decode())
        if own[-1] % SECTION == 0:
            sections.append((_digest(b"".join(inner), b"section"), names))
            inner, names = [], []
    if inner:
        sections.append((_digest(b"".join(inner), b"section"), names))
    root = _digest(b"".join(d for d, _ in sections), b"root").hex()
    return "|".join([root, *(d[:6].hex() + ":" + ",".join(p) for d, p in sections)])


def _weight(paragraph: str) -> int:
    """Characters of a paragraph, its end being one."""
    return 1 + sum(map(_LENGTH.__getitem__, paragraph[::SHORT]))


def _aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal items in the same order in both: the longest increasing run, the n-th of equal items with the n-th."""
    places: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # the least place in b that ends a run of each length
    last: list[int] = []  # the pair there
    pairs: list[tuple[int, int, int]] = []  # (place in a, place in b, pair before)
    for i, name in enumerate(a):
        if own := places.get(name):
            j = own.pop()
            k = bisect_left(ends, j)
            pairs.append((i, j, last[k - 1] if k else -1))
            ends[k : k + 1], last[k : k + 1] = [j], [len(pairs) - 1]
    out, at = [], last[-1] if last else -1
    while at >= 0:
        i, j, at = pairs[at]
        out.append((i, j))
    return out[::-1]


def _gaps(a: list[str], b: list[str], pairs: list[tuple[int, int]]) -> Iterator[tuple[slice, slice]]:
    """What lies between aligned items, where both sides have something."""
    i = j = 0
    for x, y in [*pairs, (len(a), len(b))]:
        if x > i and y > j:
            yield slice(i, x), slice(j, y)
        i, j = x + 1, y + 1


def _split(print_: str) -> list[tuple[str, list[str]]]:
    return [(name, own.split(",")) for name, _, own in (s.partition(":") for s in print_.split("|")[1:])]


def likeness(a: str, b: str) -> float:
    """Characters of leaves in common and in order as a share of all: 1 for equal roots, 0 for nothing in common."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    x, y = _split(a), _split(b)
    total = sum(_weight(p) for side in (x, y) for _, own in side for p in own)
    same, names = 0, ([n for n, _ in x], [n for n, _ in y])
    pairs = _aligned(*names)
    same += sum(_weight(p) for i, _ in pairs for p in x[i][1])
    for here, there in _gaps(*names, pairs):
        own, other = ([p for _, s in side for p in s] for side in (x[here], y[there]))
        found = _aligned(own, other)
        same += sum(_weight(own[i]) for i, _ in found)
        for m, n in _gaps(own, other, found):
            left, right = ([p[k : k + SHORT] for p in side for k in range(0, len(p), SHORT)] for side in (own[m], other[n]))
            same += sum(_LENGTH[left[i][0]] for i, _ in _aligned(left, right))
    return min(2 * same / total, 1.0) if total else 0.0


def differing(a: str, b: str) -> list[tuple[str, int]]:
    """Where two fingerprints differ: (side, paragraph number) of the paragraphs the other one doesn't have."""

    def split(print_: str) -> list[tuple[str, int, list[str]]]:
        out, at = [], 0
        for s in print_.split("|")[1:]:
            name, _, own = s.partition(":")
            out.append((name, at, own.split(",")))
            at += len(out[-1][2])
        return out

    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    sides = {"a": split(a), "b": split(b)}
    found = []
    for side, other in (("a", "b"), ("b", "a")):
        same = {name for name, _, _ in sides[other]}
        there = Counter(p for name, _, own in sides[other] for p in own)
        for name, at, own in sides[side]:
            if name not in same:
                for i, p in enumerate(own):
                    there[p] -= 1
                    if there[p] < 0:
                        found.append((side, at + i))
    return found


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def chained(docs: DataFrame) -> DataFrame:
    """(bucket, ahead, doc_id, text): partitions in order of doc_id, each with the first document of the next one at its end."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = partitions(spark)
    found = bounds_of(rows.select("doc_id"), "doc_id", n)
    nulls = bool(rows.select("doc_id").filter("doc_id is null").limit(1).count())
    bounds = np.array(found, dtype=np.int64)
    last = max(len(found) - 1, 0)

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id")
        own = bucket_of(ids, bounds)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        starts = ~null & np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), bounds) & (own > 0)
        first = null if nulls else (~null & (ids.fill_null(0).to_numpy(zero_copy_only=False) == (bounds[0] if len(bounds) else 0)))
        rows = np.concatenate([np.arange(len(own)), np.flatnonzero(starts), np.flatnonzero(first)])
        bucket = np.concatenate([own, own[starts] - 1, np.full(first.sum(), last)]).astype(np.int32)
        ahead = np.arange(len(rows)) >= len(own)
        return record({"bucket": bucket, "ahead": ahead, "doc_id": ids.take(pa.array(rows)), "text": batch.column("text").take(pa.array(rows))})

    dealt = by_batch(rows, deal, "bucket int, ahead boolean, doc_id long, text string")
    return dealt.repartitionById(max(n, len(found), 1), F.col("bucket")).sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows of SCHEMA, one for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (bucket, doc_id, text, fingerprint), waiting for the next one
        for batch in batches:
            out = []
            for bucket, ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ahead and (before is None or before[0] != bucket):
                    continue
                mark = before[3] if before is not None and before[2] == text else fingerprint(text)
                own = (bucket, doc_id, text, mark)
                if before is not None:
                    changed = edited(before[2], text)
                    other = before[3] if changed == before[2] else fingerprint(changed)
                    out.append((before[1], len(before[2]), sha256(changed.encode()).hexdigest(), before[3], other, likeness(before[3], other), likeness(before[3], mark)))
                before = None if ahead else own
            yield record(dict(zip(NAMES, map(list, zip(*out, strict=True)), strict=True)) if out else {k: [] for k in NAMES}, TYPES)

    return by_partition(chained(docs), run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = {x.split()[0]: {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")}


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return fingerprints(docs)

"""Language ID: a bidirectional gated recurrent network over bytes.

Every byte of a text is read in windows of ``WINDOW`` bytes; in each, one network
runs forward and one backward, and their two states give every position a label
distribution.  A document's probabilities are the mean over all its positions.
Training is plain numpy: backpropagation through time and Adam, on a bounded
sample of labelled rows (``SAMPLE`` documents, ``EXCERPT`` characters of each
from a hashed place), as many of each language as there are or the sample holds,
each language drawn equally often.

Nulls and empties: a text that is null or has no letter is ``und`` with score 0,
as is everything where no row has a label to learn from.  Rows without a label
or doc_id are predicted, not learned from.  Repeated rows give a row each, with the
same answer; of labels equally probable the first by name wins.  A very long text
is read whole, window by window, in bounded memory.  Further columns, whatever
their names, are kept by ``predict`` and ignored by ``op7``.  An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from tracewell.llm.shared import bounded

HIDDEN, WINDOW, LANES = 8, 96, 2048
#: Labelled documents learned from (twice as many at most), and characters of each.
SAMPLE, EXCERPT = 6000, 400
STEPS, BATCH, SPAN, RATE = 320, 192, 48, 0.02
UNDETERMINED = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two recurrent layers, one for each direction, and a label layer on both."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.weights = {
            "byte": draw(2, 256, 3 * hidden, scale=0.3),  # what a byte adds to the gates: update, reset, new
            "state": draw(2, hidden, 3 * hidden, scale=1 / np.sqrt(hidden)),
            "out": draw(2 * hidden, len(labels), scale=0.3),
            "bias": np.zeros(len(labels), np.float32),
        }

    def states(self, codes: np.ndarray, mask: np.ndarray, trace: list | None = None) -> np.ndarray:
        """States [2, time, lane, hidden] after each byte; the second direction reads from the end."""
        byte, state, h = self.weights["byte"], self.weights["state"], self.hidden
        span, lanes = codes.shape
        now = np.zeros((2, lanes, h), np.float32)
        out = np.empty((2, span, lanes, h), np.float32)
        for t in range(span):
            back = span - 1 - t
            given = np.stack([byte[0][codes[t]], byte[1][codes[back]]])
            own = np.matmul(now, state)
            gates = _sigmoid(given[..., : 2 * h] + own[..., : 2 * h])
            update, reset = gates[..., :h], gates[..., h:]
            new = np.tanh(given[..., 2 * h :] + reset * own[..., 2 * h :])
            before, keep = now, np.stack([mask[t], mask[back]])[..., None]
            now = (new + update * (before - new)) * keep
            out[0, t], out[1, back] = now
            if trace is not None:
                trace.append((before, update, reset, new, own[..., 2 * h :], keep))
        return out

    def _logits(self, states: np.ndarray) -> np.ndarray:
        return np.concatenate([states[0], states[1]], axis=-1) @ self.weights["out"] + self.weights["bias"]

    def probabilities(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """[time, lane, label]: a distribution for every position."""
        logits = self._logits(self.states(codes, mask))
        np.exp(logits - logits.max(axis=-1, keepdims=True), out=logits)
        return logits / logits.sum(axis=-1, keepdims=True)

    def gradients(self, codes: np.ndarray, mask: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients, backwards through time."""
        h, w, trace = self.hidden, self.weights, []
        states = self.states(codes, mask, trace)
        both = np.concatenate([states[0], states[1]], axis=-1)
        logits = both @ w["out"] + w["bias"]
        p = np.exp(logits - logits.max(axis=-1, keepdims=True))
        p /= p.sum(axis=-1, keepdims=True)
        lanes, total = np.arange(codes.shape[1]), mask.sum()
        loss = float(-(np.log(p[:, lanes, targets] + 1e-9) * mask).sum() / total)
        p[:, lanes, targets] -= 1
        p *= (mask / total)[..., None]
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["out"] = np.einsum("tlh,tlc->hc", both, p)
        grads["bias"] = p.sum(axis=(0, 1))
        from_label = p @ w["out"].T
        span = codes.shape[0]
        flow = np.zeros((2, codes.shape[1], h), np.float32)
        for t in reversed(range(span)):
            back = span - 1 - t
            before, update, reset, new, own, keep = trace[t]
            flow = (flow + np.stack([from_label[t, :, :h], from_label[back, :, h:]])) * keep
            to_new = flow * (1 - update) * (1 - new * new)
            to_update = flow * (before - new) * update * (1 - update)
            to_reset = to_new * own * reset * (1 - reset)
            gates = np.concatenate([to_update, to_reset, to_new * reset], axis=-1)
            grads["state"] += np.matmul(before.transpose(0, 2, 1), gates)
            inputs = np.concatenate([to_update, to_reset, to_new], axis=-1)
            np.add.at(grads["byte"][0], codes[t], inputs[0])
            np.add.at(grads["byte"][1], codes[back], inputs[1])
            flow = flow * update + np.matmul(gates, w["state"].transpose(0, 2, 1))
        return loss, grads

    def fit(self, texts: list[bytes], targets: np.ndarray, steps: int = STEPS, seed: int = 1) -> float:
        """Adam on random windows; every label is drawn equally often."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(targets == i) for i in range(len(self.labels))]
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            labels = rng.integers(0, len(groups), BATCH)
            rows = [groups[g][rng.integers(len(groups[g]))] for g in labels]
            codes, mask = np.zeros((SPAN, BATCH), np.uint8), np.zeros((SPAN, BATCH), np.float32)
            for lane, row in enumerate(rows):
                text = texts[row]
                start = rng.integers(0, max(1, len(text) - SPAN + 1))
                own = np.frombuffer(text[start : start + SPAN], np.uint8)
                codes[: len(own), lane], mask[: len(own), lane] = own, 1
            loss, grads = self.gradients(codes, mask, labels)
            rate = RATE * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                self.weights[k] -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """[text, label]: the mean distribution over all positions; zeros for an empty text."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        sizes = np.diff(offsets)
        windows = (sizes + WINDOW - 1) // WINDOW
        of = np.repeat(np.arange(len(texts)), windows)
        within = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
        starts = np.repeat(offsets[:-1], windows) + within
        lengths = np.minimum(sizes[of] - within, WINDOW)
        total = np.zeros((len(texts), len(self.labels)))
        order = np.argsort(-lengths, kind="stable")
        for lo in range(0, len(order), LANES):
            own = order[lo : lo + LANES]
            steps = np.arange(int(lengths[own].max()))[:, None]
            mask = (steps < lengths[own]).astype(np.float32)
            at = np.minimum(starts[own] + steps, len(data) - 1)  # what a window lacks is masked
            found = (self.probabilities(data[at], mask) * mask[..., None]).sum(axis=0)
            np.add.at(total, of[own], found)
        return total / np.maximum(sizes, 1)[:, None]


def learnable(docs: DataFrame) -> DataFrame:
    """Rows to learn from: a label, a text, and a doc_id that isn't held out."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Learns from about ``sample`` labelled rows, as many of each language, picked by a hash of doc_id and length; None if there are none."""
    labelled = learnable(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return None
    hashed = F.xxhash64("doc_id", F.length("text"))
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / len(sizes) / n))])
    place = (F.lit(1) + F.pmod(hashed, F.greatest(F.length("text") - EXCERPT, F.lit(1)))).cast("int")
    picked = labelled.filter(F.shiftrightunsigned(hashed, 11) * 2.0**-53 < rates[F.col("lang")])
    rows = picked.select("lang", F.col("text").substr(place, F.lit(EXCERPT)).alias("text"), hashed.alias("h")).orderBy("h", "lang", "text").limit(2 * sample).toPandas()
    rows = rows[[any(c.isalpha() for c in t) for t in rows["text"]]].sort_values(["h", "lang", "text"])
    if not len(rows):
        return None
    labels = sorted(set(rows["lang"]))
    network = Network(labels)
    if len(labels) > 1:
        network.fit([t.encode() for t in rows["text"]], np.searchsorted(labels, rows["lang"].to_numpy(object)))
    return network


def predicted(text: Column, network: Network | None) -> Column:
    """struct(lang_pred, score) of a text; only the text itself goes to Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = np.full(len(batch), UNDETERMINED, dtype=object), np.zeros(len(batch))
            known = np.array([network is not None and t is not None and any(map(str.isalpha, t)) for t in batch.to_pylist()], dtype=bool)
            if known.any():
                own = network.pooled(batch.filter(pa.array(known)))
                names[known] = [network.labels[i] for i in own.argmax(axis=1)]
                scores[known] = np.clip(own.max(axis=1), 0, 1)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    found = F.arrow_udf(run, "lang_pred string, score double", ArrowUDFType.SCALAR_ITER)
    return found.asNondeterministic()(text)  # else a filter on its answer has it asked twice


def predict(docs: DataFrame, network: Network | None, into: str = "language") -> DataFrame:
    """docs with the column ``into``: a struct of lang_pred and score."""
    bounded(docs.sparkSession)
    return docs.withColumn(into, predicted(F.col("text").cast("string"), network))


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    network = train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(rows, network).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")

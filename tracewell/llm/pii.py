"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds choose.

All of it is DataFrame expressions.  For every kind a pattern proposes spans
(overlaps across kinds are kept).  ``BASE`` kinds with their checks always count.
The further kinds, secrets among them, have loose patterns of high recall; whether
such a span counts is decided by gradient-boosted trees on its format (length,
digits, letters, case, entropy, checksum) and context (what stands before and
after it).  Each kind has trees of its own.  They are fitted to ``SAMPLE`` generated sentences
(``pii_examples``), run through the same expressions, and compiled to CASE
expressions.  Half of the sentences are held out: on them a logistic curve for
each kind calibrates scores to probabilities, and the kind's threshold is the
highest probability at which ``RECALL`` of the wanted spans are still found, or a
half if that is less.

Positions count code points; ends are exclusive.  Nulls, empties, ties, long texts:
a null or empty text has no spans; equal rows give equal rows; a null doc_id is
carried through; a long text is scanned whole, in time that grows with its length
and its spans; further columns, whatever their names, are kept by ``with_spans``
and ``redacted``; an empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import pii_examples
from tracewell.llm.shared import fresh

#: Kind -> pattern.  Each finds what the plain pattern finds, without backtracking.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_RUN = "A-Za-z0-9_+/=-"
#: Further kinds, which the trees decide.
LOOSE = {
    "email_words": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++ ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,}+",
    "phone_local": r"(?<![0-9A-Za-z+.(-])(?<![0-9)] )(?:\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|0[0-9]{2,4}[ /-][0-9]{6,8})(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card_short": r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "birth": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?![0-9A-Za-z/-])",
    "handle": r"(?<![A-Za-z0-9._%+@/-])@[A-Za-z_][A-Za-z0-9_]{2,30}+(?![@.]?[A-Za-z0-9])",
    "address": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "secret": rf"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{{12,}}+={{0,2}}+(?![{_RUN}])",
    "password": r"(?i)(?<=(?:password|passwort|passwd|pwd|secret|passe|token|api_key|apikey) {0,2}[=:] {0,2}[\x22']{0,1})[^\s\x22',;]{5,64}+",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {
    "email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": "+",
    "email_words": r"[(\[]at[)\]]", "phone_local": r"[0-9]{3}[ .-][0-9]{4}|[ /-][0-9]{6}", "national_id": r"[0-9]-[0-9]{2}-[0-9]", "card_short": r"[0-9]{5}", "account": r"[A-Z]{2}[0-9]{2}",
    "birth": r"[0-9][./-][0-9]{1,2}[./-][0-9]", "handle": "@", "address": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "secret": rf"[{_RUN}]{{12}}", "password": r"(?i)(?:pass|pwd|secret|token|api)[a-z_]{0,6} {0,2}[=:]",
}
KINDS = [*BASE, *LOOSE]
SAMPLE, TREES, RATE, RECALL = 10000, 30, 0.3, 0.95
FEATURES = ["kind", "length", "digits", "marks", "upper", "lower", "alike", "entropy", "turns", "checked", "hex", "cue", "near", "counter", "given", "quoted", "unit", "bracket", "year", "known"]

#: How keys of widespread services begin.
_KNOWN = r"\A(?:AKIA|ASIA|gh[pousr]_|sk_live_|sk_test_|xox[abprs]-|AIza|eyJ)[A-Za-z0-9_-]"
_CUES = r"(?i)(?:call|phone|tel|mobile|cell|fax|dial|contact|ssn|social|card|amex|visa|mail|iban|account|konto|born|birth|dob|geb|follow|pass|pwd|secret|token|key|login|auth|bearer)"
_NEAR = r"(?i)\b(?:me|my|his|her|their|number|nr|no|is|at|on|am|le|to)[^A-Za-z0-9]{1,3}$"
_COUNTERS = r"(?i)(?:order|version|part|isbn|ref|invoice|ticket|serial|sku|item|issue|build|page|case|model|commit|sha[0-9]*|md5|checksum|digest|etag|hash|released|file|img|\bid)[^a-z0-9]{0,4}(?:no|number|nr|on)?[^a-z0-9]{0,4}$"


def _matches(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, match, before, after) in order."""
    pattern = F.lit((BASE | LOOSE)[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, (BASE | LOOSE)[kind], -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["match"].alias("match"), F.right(pair["gap"], F.lit(32)).alias("before"), F.left(pair["next"], F.lit(8)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.arrays_zip(found.alias("match"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("next")), F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(g.alias("gap"), m["match"].alias("match"), m["next"].alias("next")))
    state = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    spans = F.aggregate(pairs, state, step, lambda s: s["spans"])
    need = NEEDS[kind]
    there = F.contains(text, F.lit(need)) if len(need) == 1 else text.rlike(need)
    return F.when(there, F.filter(spans, lambda s: _passes(kind, s["match"]))).otherwise(empty)


def _passes(kind: str, match: Column) -> Column:
    """The check of a base kind; loose kinds have none."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _entropy(text: Column) -> Column:
    """Tenths of bits a character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return (-10 * F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: total + F.when(c == "", 0.0).otherwise(share(c) * F.log2(F.greatest(share(c), F.lit(1e-9)))))).cast("int")


def features(span: Column) -> dict[str, Column]:
    """Whole numbers that describe a proposed span; lengths over 64 count as 64."""
    match, before = span["match"], span["before"]
    without = lambda pattern: F.least(F.length(F.regexp_replace(match, pattern, "")), F.lit(64))
    digits = F.regexp_replace(match, "[^0-9]", "")
    whole = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    return {
        "kind": F.array_position(F.array(*[F.lit(k) for k in KINDS]), span["kind"]).cast("int"),
        "length": F.least(F.length(match), F.lit(64)),
        "digits": without("[^0-9]"),
        "marks": without("[A-Za-z0-9]"),
        "upper": without("[^A-Z]"),
        "lower": without("[^a-z]"),
        "alike": F.size(F.array_distinct(F.split(digits, ""))),
        "entropy": _entropy(match),
        "turns": F.least(F.regexp_count(match, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")), F.lit(64)),
        "checked": whole(_luhn(digits)),
        "hex": whole(match.rlike(r"\A[0-9a-f]+\z")),
        "cue": whole(before.rlike(_CUES)),
        "near": whole(before.rlike(_NEAR)),
        "counter": whole(before.rlike(_COUNTERS)),
        "given": whole(before.rlike(r"[=:] {0,2}[\x22']?$")),
        "quoted": whole(before.rlike(r"[\x22']$")),
        "unit": whole(span["after"].rlike(r"(?i)^ ?(?:%|€|eur\b|usd\b|kg\b|km\b|mb\b|gb\b|bytes\b|items\b|px\b)")),
        "bracket": whole(match.rlike(r"\A\([0-9]{3}\)")),
        "year": F.coalesce(F.regexp_extract(match, "((?:19|20)[0-9]{2})", 1).try_cast("int") - 1900, F.lit(0)),
        "known": whole(match.rlike(_KNOWN)),
    }


class Trees:
    """Boosted trees of depth 2 on whole-number features from 0 to 255, fitted to the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE):
        x = np.clip(x, 0, 255)
        self.bias, self.trees = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
        score = np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            root = self._split(x, y - p, p * (1 - p), np.ones(len(y), bool))
            sides = [self._split(x, y - p, p * (1 - p), s) for s in (x[:, root[0]] <= root[1], x[:, root[0]] > root[1])]
            leaves = []
            for (f, cut), side in zip(sides, (x[:, root[0]] <= root[1], x[:, root[0]] > root[1]), strict=True):
                for own in (side & (x[:, f] <= cut), side & (x[:, f] > cut)):
                    step = rate * (y - p)[own].sum() / ((p * (1 - p))[own].sum() + 1.0)
                    leaves.append(float(step))
                    score[own] += step
            self.trees.append((root, *sides, leaves))

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, int]:
        """The feature and the value up to which rows go left, with the greatest gain."""
        best, at = -1.0, (0, 0)
        for f in range(x.shape[1]):
            left_g, left_h = (np.cumsum(np.bincount(x[rows, f], v[rows], 256))[:-1] for v in (g, h))
            gain = left_g**2 / (left_h + 1) + (g[rows].sum() - left_g) ** 2 / (h[rows].sum() - left_h + 1)
            if gain.max() > best + 1e-9:
                best, at = float(gain.max()), (f, int(gain.argmax()))
        return at

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for (f, c), (lf, lc), (rf, rc), leaves in self.trees:
            left = np.where(x[:, lf] <= lc, leaves[0], leaves[1])
            out += np.where(x[:, f] <= c, left, np.where(x[:, rf] <= rc, leaves[2], leaves[3]))
        return out

    def column(self, x: list[Column]) -> Column:
        """The same sum as one expression."""
        out = F.lit(self.bias)
        for (f, c), (lf, lc), (rf, rc), leaves in self.trees:
            left = F.when(x[lf] <= lc, leaves[0]).otherwise(leaves[1])
            out = out + F.when(x[f] <= c, left).otherwise(F.when(x[rf] <= rc, leaves[2]).otherwise(leaves[3]))
        return out


def _calibrated(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the logistic curve from scores to probabilities, by Newton's steps."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * scores + b)))
        w, x = p * (1 - p) + 1e-6, np.stack([scores, np.ones_like(scores)])
        step = np.linalg.solve((x * w) @ x.T + 1e-3 * np.eye(2), x @ (y - p) - 1e-3 * np.array([a - 1, b]))
        a, b = a + step[0], b + step[1]
    return float(max(a, 1e-3)), float(b)


class Model:
    """Trees and, for each loose kind, its calibration and the probability from which a span counts."""

    def __init__(self, spark: SparkSession, sample: int = SAMPLE):
        rows = json.dumps(pii_examples.sentences(list(LOOSE), sample))
        table = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<text:string,kind:string,start:int,end:int,label:int>>")).alias("r")).select("r.*")
        spans = table.select("kind", "start", "end", "label", F.explode(F.concat(*[_matches(F.col("text"), k) for k in LOOSE])).alias("s"))
        spans = spans.filter("s.kind = kind and s.start < end and s.end > start")
        got = spans.select("label", *[c.alias(n) for n, c in features(F.col("s")).items()]).collect()  # about ``sample`` rows
        rows = np.array(sorted(tuple(r) for r in got), dtype=np.int64)
        x, y = rows[:, 1:], rows[:, 0].astype(float)
        seen = np.random.default_rng(0).random(len(y)) < 0.5
        self.trees, self.curves, self.thresholds = {}, {}, {}
        for k in LOOSE:
            kind = x[:, 0] == KINDS.index(k) + 1
            self.trees[k] = Trees(x[kind & seen], y[kind & seen])
            own = kind & ~seen
            scores = self.trees[k].scores(x[own])
            a, b = self.curves[k] = _calibrated(scores, y[own])
            p = np.sort(1 / (1 + np.exp(-(a * scores[y[own] > 0] + b))))
            self.thresholds[k] = min(0.5, float(p[int((1 - RECALL) * len(p))]) - 1e-9) if len(p) else 1.0

    def chosen(self, text: Column) -> Column:
        """The loose spans that count."""
        spans = F.concat(*[_matches(text, k) for k in LOOSE])
        described = F.transform(spans, lambda s: F.struct(s.alias("s"), *[c.alias(n) for n, c in features(s).items()]))  # each feature once

        def counts(d: Column) -> Column:
            own = F.lit(False)
            for k, (a, b) in self.curves.items():
                score = self.trees[k].column([d[n] for n in FEATURES])
                own = F.when(d["s"]["kind"] == k, 1 / (1 + F.exp(-(score * F.lit(a) + F.lit(b)))) >= F.lit(self.thresholds[k])).otherwise(own)
            return own

        kept = F.transform(F.filter(described, counts), lambda d: d["s"])
        need = "|".join(f"(?:{NEEDS[k]})" for k in LOOSE)
        return F.when(text.rlike(need), kept).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>"))


def with_spans(docs: DataFrame, model: Model | None = None, into: str = "pii") -> DataFrame:
    """docs with the column ``into``: arrays base_<kind> and more of (kind, start, end, match, before, after)."""
    model = model or Model(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn(into, F.struct(*[_matches(text, k).alias(f"base_{k}") for k in BASE], model.chosen(text).alias("more")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns, and n_spans, the number of all spans."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "pii.*")
    base = F.concat(*[F.col(f"base_{k}") for k in BASE])
    spans = F.concat(base, F.col("more"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs' columns with every span replaced by its kind, as in ``[EMAIL]``; spans that overlap are one.

    Their union goes; the kind is that of the first, then longest.
    """
    (into,) = fresh(docs, "pii")
    found = with_spans(docs, model, into)
    every = F.concat(*[F.col(f"{into}.base_{k}") for k in BASE], F.col(f"{into}.more"))
    spans = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def step(state: Column, s: Column) -> Column:
        free = s["start"] >= state["at"]
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], -s["back"]).alias("at"), F.when(free, F.concat(state["parts"], F.array(piece))).otherwise(state["parts"]).alias("parts"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    whole = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    clean = F.when(F.size(spans) > 0, whole).otherwise(F.col("text").cast("string"))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Onboarding of unseen formats: declared specs, generated parsers, a validation lab, and approval."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracewell.operators import mapping, parsers


class SpecError(ValueError):
    """A spec that no parser can be made of."""


@dataclass(frozen=True)
class ParserSpec:
    """kind "key_value" (pair_separator, separator) or "delimited" (separator, names)."""

    id: str
    version: str
    kind: str
    separator: str
    pair_separator: str = ""
    names: tuple[str, ...] = ()

    def validate(self) -> None:
        if not self.id.strip():
            raise SpecError("an empty id")
        own = [self.separator, *([self.pair_separator] if self.kind == "key_value" else [])]
        if self.kind not in ("key_value", "delimited"):
            raise SpecError(f"no kind {self.kind!r}")
        if not all(own):
            raise SpecError("an empty separator")
        if any(ord(c) < 32 or ord(c) == 127 for s in own for c in s):
            raise SpecError("a control character in a separator")
        if self.kind == "key_value" and self.separator == self.pair_separator:
            raise SpecError("equal separators")
        if self.kind == "delimited":
            names = [n.strip() for n in self.names]
            if not names or not all(names):
                raise SpecError("an empty field name")
            if len(set(names)) < len(names):
                raise SpecError("a repeated field name")

    def build(self) -> parsers.Parser:
        self.validate()
        parse = parsers.key_value(self.pair_separator, self.separator) if self.kind == "key_value" else parsers.delimited(self.separator, list(self.names))
        return parsers.Parser(self.id, self.version, parse, "Generated")


INFERRED = {
    "generic-kv-space-eq": ParserSpec("generic-kv-space-eq", "1.0.0", "key_value", "=", " "),
    "generic-csv-3col": ParserSpec("generic-csv-3col", "1.0.0", "delimited", ",", names=("col1", "col2", "col3")),
}


def spec_for(decision: str, parser_id: str | None) -> ParserSpec:
    """The spec of an inferred format."""
    if decision != "Recognized":
        raise SpecError("inference abstained")
    if parser_id not in INFERRED:
        raise SpecError(f"no spec for {parser_id!r}")
    return INFERRED[parser_id]


@dataclass
class LabSuite:
    """Inputs of each check; golden: (input, {name: value}); expected field names for semantic ones."""

    syntax: list[bytes] = field(default_factory=list)
    semantic: list[tuple[bytes, list[str]]] = field(default_factory=list)
    golden: list[tuple[bytes, list[tuple[str, str]]]] = field(default_factory=list)
    negative: list[bytes] = field(default_factory=list)
    mutation: list[bytes] = field(default_factory=list)
    security: list[bytes] = field(default_factory=list)
    performance: list[bytes] = field(default_factory=list)


def mutated(data: bytes) -> bytes:
    """The first of = : , becomes X; without one the middle byte goes up by one."""
    at = next((i for i, b in enumerate(data) if b in b"=:,"), None)
    if at is not None:
        return data[:at] + b"X" + data[at + 1 :]
    if not data:
        return data
    middle = len(data) // 2
    return data[:middle] + bytes([(data[middle] + 1) % 256]) + data[middle + 1 :]


#: What every parser must survive: very many pairs, and deep nesting.
HOSTILE = [b"".join(b"k%d=v " % i for i in range(10_000)), b'{"a":' * 500 + b"1" + b"}" * 500]


def evaluate(spark: SparkSession, parser: parsers.Parser, suite: LabSuite, mapped_as: str | None = None) -> dict[str, bool]:
    """A verdict for each check; all cases run as one table.

    mapped_as: the parser whose mapping rules hold for this one; by default its own,
    and a parser without rules fails the semantic check.

    A check without inputs fails, but for security, which always parses
    ``HOSTILE`` and passes if it returns.  Semantic inputs must parse, convert and
    map, and the result must have the names asked for, as fields or targets.
    Negative ones must be refused as Malformed or Unsupported, not by a limit.
    Mutation passes if some golden input (or one of ``suite.mutation``), with a byte
    changed, fails or gives other fields.
    """
    rows = [("syntax", x, None) for x in suite.syntax] + [("semantic", x, [(n, "") for n in names]) for x, names in suite.semantic]
    rows += [("golden", x, sorted(want)) for x, want in suite.golden] + [("negative", x, None) for x in suite.negative]
    rows += [("mutation", mutated(x), sorted(want)) for x, want in suite.golden if x] + [("mutation", mutated(x), None) for x in suite.mutation]
    rows += [("security", x, None) for x in [*HOSTILE, *suite.security]] + [("performance", x, None) for x in suite.performance]
    cases = spark.createDataFrame(rows, "check string, data binary, want array<struct<name:string,value:string>>")
    got = cases.select("check", "want", F.explode(F.array(parser.parse(F.col("data")))).alias("r"))
    have = F.array_sort(F.transform("r.fields", lambda f: F.struct(f["name"].alias("name"), f["raw_value"].alias("value"))))
    ok, rules = F.col("r.status") == "Success", F.lit(mapped_as or parser.id)
    mapped = got.withColumn("c", mapping.canonical(rules, F.when(ok, mapping.to_ir(F.lit(parser.id), F.col("r.fields")))))
    targets = F.array(*[F.when(F.col("c")[t].isNotNull(), F.lit(t)) for t in mapping.ORDER])
    names = F.concat(F.transform("r.fields", lambda f: f["name"]), F.array_compact(targets))
    passed = (
        F.when(F.col("check") == "syntax", ok)
        .when(F.col("check") == "semantic", ok & F.col("c").isNotNull() & F.forall("want", lambda w: F.array_contains(names, w["name"])))
        .when(F.col("check") == "golden", ok & (have == F.col("want")))
        .when(F.col("check") == "negative", F.col("r.status").isin("Malformed", "Unsupported"))
        .when(F.col("check") == "mutation", ~ok | (F.col("want").isNotNull() & (have != F.col("want"))))
        .otherwise(F.lit(True))
    )
    sure = F.coalesce(passed, F.lit(False))
    found = {r["check"]: r["any"] if r["check"] == "mutation" else r["all"] for r in mapped.groupBy("check").agg(F.bool_and(sure).alias("all"), F.bool_or(sure).alias("any")).collect()}
    return {k: found.get(k, False) for k in ("syntax", "semantic", "golden", "negative", "mutation", "security", "performance")}


@dataclass(frozen=True)
class Candidate:
    """A parser with its lab report; only one that passed everything can be approved."""

    parser: parsers.Parser
    report: dict[str, bool]

    def approve(self, registry: parsers.Registry) -> parsers.Parser:
        if not all(self.report.values()):
            raise SpecError(f"failed: {[k for k, v in self.report.items() if not v]}")
        approved = parsers.Parser(self.parser.id, self.parser.version, self.parser.parse, "Approved")
        registry.register(approved)
        return approved

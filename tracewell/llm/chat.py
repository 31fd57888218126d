"""Chat formatting by a template compiler.

``compile_template`` parses a small template language into a syntax tree, folds
constants, and generates Python closures.  The language has ``{{ expression }}``,
``{% for x in y %}``, ``{% if %} {% elif %} {% else %}`` and ``{% generation %}``,
whose output is under the loss mask.  It is sandboxed: an expression has names of
the template's own context, item access by constant names, literals, ``==``,
``!=``, ``+``, ``and``, ``or``, ``not`` and the filters listed in ``FILTERS``; no
calls, attributes or imports.  A closure yields (text, under the mask) pieces, so
a conversation of any length streams through.

Control strings in a text are escaped: a backslash is doubled, each ``#`` of a run
of three or more gets a backslash, and ``</turn>`` becomes ``<\\/turn>``; in roles a
newline becomes ``\\n``.  So no control string of the template can stand in a text.

Nulls, empties, ties: a null or empty text has no characters, a null role is an
empty one, rows of equal conv_id and turn are in order of role and text, a null
conv_id is a conversation of its own, further columns are ignored, an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.shared import by_partition, partitions, record

TEMPLATE = (
    "{% for turn in turns %}### {{ turn.role | escape_role }}:\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}\n</turn>\n{% endfor %}"
)
#: Characters of a stretch of output; a longer conversation is written as several.
STRETCH = 1 << 20


# Escaping


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    text = re.sub(r"#{3,}", lambda m: "\\#" * len(m.group()), text)
    return text.replace("</turn>", "<\\/turn>")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower}


# The language: text -> tokens -> tree -> closures


class TemplateError(ValueError):
    """A template that the language doesn't have."""


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([0-9]+)|([A-Za-z_]\w*)|(==|!=|[.+|()\[\]]))")
_KEYWORDS = {"and", "or", "not", "true", "false", "none"}


class _Expression:
    """Recursive descent over one expression; nodes are tuples, constants are ("const", value)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            text, number, name, sign = m.groups()
            self.tokens.append(("text", re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], text[1:-1])) if text else ("number", int(number)) if number else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = _fold(("or", node, self.both()))
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = _fold(("and", node, self.negated()))
        return node

    def negated(self) -> tuple:
        return _fold(("not", self.negated())) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        for sign in ("==", "!="):
            if self.take(sign):
                return _fold((sign, node, self.added()))
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = _fold(("+", node, self.filtered()))
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = _fold(("filter", name, node))
        return node

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind in ("text", "number"):
            return ("const", value)
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        if value in _KEYWORDS:
            raise TemplateError(f"unexpected {value!r}")
        node: tuple = ("name", value)
        while self.peek(".", "["):
            closing = self.take("[") or not self.take(".")
            kind, key = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
            if kind not in (("text", "number") if closing else ("name",)) or str(key).startswith("_"):
                raise TemplateError(f"no item {key!r}")
            self.at += 1
            if closing and not self.take("]"):
                raise TemplateError("missing ]")
            node = ("item", node, key)
        return node


def _fold(node: tuple) -> tuple:
    """A node whose operands are constants becomes a constant."""
    operands = node[2:] if node[0] == "filter" else node[1:]
    if all(x[0] == "const" for x in operands):
        return ("const", _evaluator(node)({}))
    if node[0] in ("and", "or") and node[1][0] == "const":
        return node[2] if bool(node[1][1]) == (node[0] == "and") else node[1]
    return node


def _evaluator(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda context, value=node[1]: value
    if kind == "name":
        return lambda context, name=node[1]: context.get(name)
    if kind == "item":
        inner, key = _evaluator(node[1]), node[2]

        def item(context: dict) -> object:
            value = inner(context)
            if isinstance(value, dict):
                return value.get(key)
            return value[key] if isinstance(value, (list, tuple)) and isinstance(key, int) and key < len(value) else None

        return item
    if kind == "filter":
        inner, change = _evaluator(node[2]), FILTERS[node[1]]
        return lambda context: change(_text(inner(context)))
    if kind == "not":
        inner = _evaluator(node[1])
        return lambda context: not inner(context)
    left, right = _evaluator(node[1]), _evaluator(node[2])
    return {
        "==": lambda context: left(context) == right(context),
        "!=": lambda context: left(context) != right(context),
        "+": lambda context: _text(left(context)) + _text(right(context)),
        "and": lambda context: left(context) and right(context),
        "or": lambda context: left(context) or right(context),
    }[kind]


def _text(value: object) -> str:
    return "" if value is None else str(value)


def parse(source: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("show", expression), ("for", name, expression, body), ("if", [(test, body)...]), ("generation", body)."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("show", m.group(1)) if m.group(1) is not None else ("tag", m.group(2).strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    tree, rest = _body(parts, 0, ())
    if rest != len(parts):
        raise TemplateError(f"unexpected {parts[rest][1]!r}")
    return tree


def _body(parts: list[tuple], at: int, until: tuple[str, ...]) -> tuple[list[tuple], int]:
    out: list[tuple] = []
    while at < len(parts):
        kind, value = parts[at]
        word, _, rest = value.partition(" ")
        if kind == "tag" and word in until:
            return _joined(out), at
        at += 1
        if kind == "text":
            out.append(("text", value))
        elif kind == "show":
            node = _Expression(value).whole()
            out.append(("text", _text(node[1])) if node[0] == "const" else ("show", node))
        elif word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"can't read {value!r}")
            body, at = _closed(parts, at, "endfor")
            out.append(("for", m[1], _Expression(m[2]).whole(), body))
        elif word == "generation":
            body, at = _closed(parts, at, "endgeneration")
            out.append(("generation", body))
        elif word == "if":
            arms: list[tuple] = []
            test = _Expression(rest).whole()
            while True:
                body, at = _body(parts, at, ("elif", "else", "endif"))
                if at >= len(parts):
                    raise TemplateError("an if isn't closed")
                arms.append((test, body))
                word, _, rest = parts[at][1].partition(" ")
                at += 1
                if word == "endif":
                    break
                test = ("const", True) if word == "else" else _Expression(rest).whole()
            live = [a for a in arms if not (a[0][0] == "const" and not a[0][1])]  # arms that can be reached
            cut = next((i for i, a in enumerate(live) if a[0][0] == "const"), len(live))
            out += live[0][1] if cut == 0 and live else [("if", live[: cut + 1])] if live else []
        else:
            raise TemplateError(f"no tag {word!r}")
    if until:
        raise TemplateError(f"missing {until[-1]}")
    return _joined(out), at


def _closed(parts: list[tuple], at: int, end: str) -> tuple[list[tuple], int]:
    body, at = _body(parts, at, (end,))
    return body, at + 1


def _joined(nodes: list[tuple]) -> list[tuple]:
    """Neighbouring constant texts become one."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        else:
            out.append(node)
    return out


Pieces = Iterator[tuple[str, bool]]


def compile_template(source: str) -> Callable[[dict], Pieces]:
    """A closure from a context to (text, under the loss mask) pieces."""
    body = _generate(parse(source), False)
    return lambda context: body(dict(context))


def _generate(nodes: list[tuple], masked: bool) -> Callable[[dict], Pieces]:
    steps = [_step(node, masked) for node in nodes]

    def run(context: dict) -> Pieces:
        for step in steps:
            yield from step(context)

    return run


def _step(node: tuple, masked: bool) -> Callable[[dict], Pieces]:
    kind = node[0]
    if kind == "text":
        return lambda context, piece=(node[1], masked): (piece,)
    if kind == "show":
        value = _evaluator(node[1])
        return lambda context: ((_text(value(context)), masked),)
    if kind == "generation":
        return _generate(node[1], True)
    if kind == "for":
        name, many, body = node[1], _evaluator(node[2]), _generate(node[3], masked)

        def loop(context: dict) -> Pieces:
            for item in many(context) or ():
                yield from body(context | {name: item})

        return loop
    arms = [(_evaluator(test), _generate(body, masked)) for test, body in node[1]]

    def choose(context: dict) -> Pieces:
        for test, body in arms:
            if test(context):
                yield from body(context)
                return

    return choose


# On tables


def _uses(node: object, name: str) -> int:
    """How often a syntax tree names ``name``; within a loop counts twice."""
    if isinstance(node, tuple) and node[:1] == ("name",):
        return int(node[1] == name)
    if isinstance(node, tuple) and node[:1] == ("for",):
        return _uses(node[2], name) + 2 * _uses(node[3], name)
    return sum(_uses(x, name) for x in node) if isinstance(node, (tuple, list)) else 0


def _passes_once(source: str) -> bool:
    """Whether a template goes over its turns in one loop and uses them nowhere else."""
    tree = parse(source)
    return _uses(tree, "turns") == 1 and any(node[0] == "for" and node[2] == ("name", "turns") for node in tree)


class _Turns:
    """The turns of one conversation, from a sorted stream; ``between`` says that another one has begun."""

    def __init__(self, rows: Iterator[tuple]) -> None:
        self.rows, self.between = rows, False

    def __iter__(self) -> Iterator[dict]:
        for _, _, role, text in self.rows:
            self.between = True
            yield {"role": role, "text": text}


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, stretch, formatted, mask): each conversation's text in stretches, mask the (start, end) under the loss.

    The template renders whole conversations.  Rows are sorted by conversation and
    turn in each partition; a template with one loop over ``turns`` draws them from
    that stream, so that a conversation is never held as a whole, and its stretches
    end between turns.  One that uses ``turns`` in other ways gets a conversation's
    turns as a tuple in memory.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = turns.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    streams = _passes_once(template)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        render = compile_template(template)
        sorted_rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for conv, own in groupby(sorted_rows, itemgetter(0)):
            source = _Turns(own)
            number, parts, mask, size = 0, [], [], 0
            for piece, masked in render({"turns": source if streams else tuple(source)}):
                if size > STRETCH and (source.between or not streams):
                    yield conv, number, "".join(parts), mask
                    number, parts, mask, size = number + 1, [], [], 0
                source.between = False
                if masked and piece:
                    mask.append({"start": size, "end": size + len(piece)})
                parts.append(piece)
                size += len(piece)
            if parts or not number:
                yield conv, number, "".join(parts), mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in stretches(batches):
            held.append(row)
            size += len(row[2])
            if size > STRETCH:
                yield _stretch_rows(held)
                held, size = [], 0
        if held:
            yield _stretch_rows(held)

    return by_partition(ordered, run, "conv_id long, stretch int, formatted string, mask array<struct<start:int,end:int>>")


def _stretch_rows(rows: list[tuple]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return record(dict(zip(("conv_id", "stretch", "formatted", "mask"), map(list, zip(*rows, strict=True)), strict=True)), {"conv_id": pa.int64(), "stretch": pa.int32(), "mask": spans})


_TURN = re.compile(r"### (.*?):\n(.*?)\n</turn>\n", re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """From the output alone: turns, their digest, and the text under the mask, each conversation's stretches in order."""
    ordered = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, state = object(), None

        def close() -> None:
            if state is not None:
                out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv_id, _, text, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != conv or state is None:
                    close()
                    conv, state = conv_id, [0, sha256(), 0, sha256(), 0]
                for m in _TURN.finditer(text):
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for span in mask:
                    own = unescape(text[span["start"] : span["end"]])
                    state[2] += len(own)
                    state[3].update(own.encode())
                state[4] += len(text)
            if out:
                yield _digest_rows(out)
                out.clear()
        close()
        if out:
            yield _digest_rows(out)

    return by_partition(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return record(dict(zip(("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), map(list, zip(*rows, strict=True)), strict=True)), {"conv_id": pa.int64()})


def op3(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    return read_back(format_conversations(rows))

r"""Chat formatting: a sandboxed template language, compiled to Python closures.

The language has text, ``{{ expression }}``, ``{% if %}``/``{% elif %}``/``{% else %}``/``{% endif %}``,
``{% for x in y %}``/``{% endfor %}`` and ``{% generation %}``/``{% endgeneration %}``. Expressions are names,
attributes of mappings (``message.role``), string and number literals, ``+``, ``==``, ``!=``, ``and``, ``or``,
``not``, ``( )`` and the filters ``escape``, ``trim``, ``upper`` and ``lower``. There is nothing else: no calls, no
attributes of Python objects, no loops without end. A template is parsed to a syntax tree, constants are folded,
and the tree becomes closures that write to an output which also records where generated text lies.

A template sees a whole conversation: ``messages`` are its turns in order, ``first`` is the first of them. In a loop,
``loop.first``, ``loop.last``, ``loop.index``, ``loop.previous`` and ``loop.next`` say where it stands. Messages are
read as the loop goes on and what is written leaves after each turn, so a conversation of any length is never held
whole; a template can therefore go over ``messages`` once.

Escaping is reversible: in texts a backslash becomes two, and a backslash and ``-`` go into each control string after its first
character. So the marks of turns cannot occur in a text, and reading back is exact for every text.

A conversation is a sequence of turns in the order of (turn, role, text). Rows are dealt by conversation and sorted.
Null texts and roles are empty; rows without a conversation id are one conversation together, without an id; a
conversation without rows does not exist; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.common import table

#: Turns start with "### ", the role and ": ", and end with the closing mark. Fixed marks of the format.
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
TEMPLATE = "{% for message in messages %}### {{ message.role | escape }}: {% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}{% else %}{{ message.text | escape }}{% endif %} </turn>\n{% endfor %}"

_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:(?= )")


def escape(text: str) -> str:
    r"""Backslashes doubled; a control string, and the mark after a role, is cut after its first character by "\-"."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\-", text)


_UNESCAPE = re.compile(r"\\(\\|-)")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\\" if m[1] == "\\" else "", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+().|]))")


class TemplateError(ValueError):
    pass


class Output:
    """Written text; spans are the places of generated text, counted from the beginning of all that was written."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = self.open = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        out = "".join(self.parts), self.spans
        self.parts, self.spans = [], []
        return out


# Syntax trees are tuples: a kind, then its parts.


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    def __init__(self, source: str) -> None:
        self.rest = _tokens(source)
        self.tree = self.either()
        if self.rest:
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")

    def eat(self, *wanted: str) -> str | None:
        if self.rest and self.rest[0][0] in ("op", "name") and self.rest[0][1] in wanted:
            return self.rest.pop(0)[1]
        return None

    def either(self) -> tuple:
        left = self.both()
        while self.eat("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.eat("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.eat("not") else self.compared()

    def compared(self) -> tuple:
        left = self.summed()
        if op := self.eat("==", "!="):
            return (op, left, self.summed())
        return left

    def summed(self) -> tuple:
        left = self.filtered()
        while self.eat("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.atom()
        while self.eat("|"):
            name = self.rest.pop(0)[1] if self.rest else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            left = ("filter", name, left)
        return left

    def atom(self) -> tuple:
        if self.eat("("):
            inner = self.either()
            if not self.eat(")"):
                raise TemplateError("a bracket isn't closed")
            return inner
        kind, text = self.rest.pop(0) if self.rest else ("", "")
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "num":
            return ("const", int(text))
        if kind != "name":
            raise TemplateError(f"unexpected {text!r}")
        node: tuple = ("name", text)
        while self.eat("."):
            kind, key = self.rest.pop(0) if self.rest else ("", "")
            if kind != "name":
                raise TemplateError("an attribute needs a name")
            node = ("item", node, key)
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(pieces):
            piece, tagged = pieces[at], at % 2
            at += 1
            if not tagged:
                if piece:
                    nodes.append(("text", piece))
            elif piece.startswith("{{"):
                nodes.append(("print", _Expression(piece[2:-2]).tree))
            else:
                tag = piece[2:-2].strip()
                word, _, more = tag.partition(" ")
                if word in ends:
                    return ("block", nodes), tag
                if word == "if":
                    nodes.append(branch(more))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", more, re.S)
                    if not m:
                        raise TemplateError(f"loop {more!r}")
                    body, _ = block("endfor")
                    nodes.append(("for", m[1], _Expression(m[2]).tree, body))
                elif word == "generation":
                    nodes.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown tag {tag!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return ("block", nodes), ""

    def branch(condition: str) -> tuple:
        body, tag = block("elif", "else", "endif")
        word, _, more = tag.partition(" ")
        other: tuple = ("block", [])
        if word == "elif":
            other = branch(more)
        elif word == "else":
            other, _ = block("endif")
        return ("if", _Expression(condition).tree, body, other)

    return block()[0]


def fold(node: tuple) -> tuple:
    """Evaluates constant parts, drops branches that cannot be taken and joins neighbouring texts."""
    kind = node[0]
    if kind in ("==", "!=", "+", "and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == b[0] == "const":
            return ("const", _expression((kind, a, b))({}))
        return (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(node[2])
        return ("const", FILTERS[node[1]](str(a[1]))) if a[0] == "const" else ("filter", node[1], a)
    if kind == "item":
        return ("item", fold(node[1]), node[2])
    if kind == "print":
        a = fold(node[1])
        return ("text", _shown(a[1])) if a[0] == "const" else ("print", a)
    if kind == "if":
        test = fold(node[1])
        if test[0] == "const":
            return fold(node[2] if test[1] else node[3])
        return ("if", test, fold(node[2]), fold(node[3]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "block":
        nodes: list[tuple] = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                if y[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + y[1])
                elif y != ("text", ""):
                    nodes.append(y)
        return ("block", nodes)
    return node


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def _expression(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, k=node[1]: env.get(k)
    if kind == "item":
        inner = _expression(node[1])

        def item(env: dict, k: str = node[2]) -> Any:
            held = inner(env)
            return held.get(k) if isinstance(held, dict) else None

        return item
    if kind == "filter":
        inner, f = _expression(node[2]), FILTERS[node[1]]
        return lambda env: f(_shown(inner(env)))
    if kind == "not":
        inner = _expression(node[1])
        return lambda env: not inner(env)
    a, b = _expression(node[1]), _expression(node[2])
    return {
        "==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env),
        "+": lambda env: _add(a(env), b(env)),
    }[kind]


def _add(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else _shown(a) + _shown(b)


def _writer(node: tuple) -> Callable[[dict, Output], Iterator[None]]:
    """A closure that writes as it is iterated; it stops after each turn of a loop, where output may be taken."""
    kind = node[0]
    if kind in ("text", "print"):
        value = (lambda env, t=node[1]: t) if kind == "text" else _expression(node[1])

        def write(env: dict, out: Output) -> Iterator[None]:
            out.write(_shown(value(env)))
            return iter(())

        return write
    if kind == "if":
        test, yes, no = _expression(node[1]), _writer(node[2]), _writer(node[3])
        return lambda env, out: yes(env, out) if test(env) else no(env, out)
    if kind == "for":
        many, body = _expression(node[2]), _writer(node[3])

        def loop(env: dict, out: Output, name: str = node[1]) -> Iterator[None]:
            inner, source, none = dict(env), iter(many(env) or ()), object()
            before, now, index = None, next(source, none), 1
            while now is not none:
                after = next(source, none)
                last = after is none
                inner[name] = now
                inner["loop"] = {"first": index == 1, "last": last, "index": index, "previous": before, "next": None if last else after}
                yield from body(inner, out)
                yield
                before, now, index = now, after, index + 1

        return loop
    if kind == "generation":
        body = _writer(node[1])

        def generation(env: dict, out: Output) -> Iterator[None]:
            start = out.size
            out.open += 1
            yield from body(env, out)
            out.open -= 1
            out.spans.append((start, out.size))

        return generation
    parts = [_writer(x) for x in node[1]]

    def block(env: dict, out: Output) -> Iterator[None]:
        for part in parts:
            yield from part(env, out)

    return block


class Template:
    """A compiled template."""

    def __init__(self, source: str) -> None:
        self.write = _writer(fold(parse(source)))

    def stream(self, variables: dict) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(text, spans of generated text) as it is written, after each turn of a loop; generated text is never cut."""
        out = Output()
        for _ in self.write(variables, out):
            if out.parts and not out.open:
                yield out.take()
        if out.parts:
            yield out.take()

    def __call__(self, variables: dict) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and spans."""
        out = Output()
        for _ in self.write(variables, out):
            pass
        return out.take()


def compile_template(source: str) -> Template:
    """A function from variables to (text, spans of generated text)."""
    return Template(source)


def read_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts out of formatted text; raises ValueError where it isn't whole turns."""
    out, at = [], 0
    while at < len(text):
        end = text.find(CLOSE, at)
        if not text.startswith(OPEN, at) or end < 0:
            raise ValueError("not a formatted conversation")
        role, found, body = text[at + len(OPEN) : end].partition(COLON)
        if not found:
            raise ValueError("a turn without a role")
        out.append((unescape(role), unescape(body)))
        at = end + len(CLOSE)
    return out


#: Rows and characters of an output batch.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 22


def format_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Rows (conv_id, part, at, formatted, spans): a conversation's text in parts, a turn each if the template loops over turns.

    `at` is where a part begins; it and the spans of generated text are counted from the conversation's beginning.
    Parts of a conversation are neighbours, in order.
    """
    roles = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, kind = compile_template(template), None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield from zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)

        def parts() -> Iterator[tuple]:
            for conv, own in groupby(rows(), key=lambda r: r[0]):
                messages = ({"role": role, "text": text} for _, role, text in own)
                first = next(messages)
                at = 0
                for part, (text, spans) in enumerate(render.stream({"messages": chain([first], messages), "first": first})):
                    yield conv, part, at, text, [{"start": a, "end": b} for a, b in spans]
                    at += len(text)

        def packed(held: list[tuple]) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["conv_id", "part", "at", "formatted", "spans"])

        held, chars = [], 0
        for row in parts():
            held.append(row)
            chars += len(row[3])
            if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield packed(held)
                held, chars = [], 0
        if held:
            yield packed(held)

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return roles.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kind}, part long, at long, formatted string, spans array<struct<start:long,end:long>>")


def digest_turns(formatted: DataFrame) -> DataFrame:
    """Reads formatted turns back and digests each conversation; its parts must be neighbours, and whole turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        key: object = None
        state: list = []
        kind = None

        def close() -> tuple:
            return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            done, kind = [], batch.column(0).type
            for conv, at, text, spans in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "at", "formatted", "spans")), strict=True):
                if not state or conv != key:
                    if state:
                        done.append(close())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    lost = unescape(text[span["start"] - at : span["end"] - at])
                    state[2] += len(lost)
                    state[3].update(lost.encode())
                state[4] += len(text)
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)
        if state:
            yield pa.record_batch([pa.array([c], t) for c, t in zip(close(), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Text of conversation -7, which the query adds: it holds marks, a backslash and a role.
PROBE = r"\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digest_turns(format_turns(turns))


#: formatted_chars follows from the escapes: a backslash adds one character, a control string two.
OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, length(role) + length(text) + length(regexp_replace(role || chr(10) || text, '[^\\]', '', 'g'))
    + 2 * len(regexp_extract_all(role || chr(10) || text, '</turn>|: '))
    + 2 * CAST(coalesce(list_sum(list_transform(regexp_extract_all(role || chr(10) || text, '#{3,}'), lambda s: length(s) - 2)), 0) AS BIGINT) + 4 + 2 + 9 AS formatted
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

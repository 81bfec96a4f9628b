"""Chat formatting: a compiler for a sandboxed template language.

    {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}   {% set name = e %}
    {% for name in e %} {% endfor %}   {% generation %} {% endgeneration %}   {# comment #}

Expressions: strings, numbers, true, false, none, names, a.b, a[e], + - * % ~, comparisons, in, and,
or, not, a if b else c, and the filters trim, upper, lower, length, escape. In a loop, loop.index,
loop.index0, loop.first and loop.last are known.

A template is parsed into a syntax tree, constants are folded (also dead branches and adjacent
literals), and the tree becomes nested Python closures. The sandbox holds by construction: names
reach only what the caller passes and what the template sets, ``a.b`` reads dict keys and never
attributes, nothing can be called, and the only loops are over given lists.

``escape`` sets an escape character into each control string inside a text, one more if it has some
already, so that the output has control strings only where the template puts them and unescape()
gives the text back exactly.

Edge cases: a null text or role is empty; turns that repeat a number are all kept, by role and text;
rows with a null conversation id form one conversation; an empty table gives an empty result.
One conversation at a time is held in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESC = "\x1b"
# The control strings of the production template.
CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
TEMPLATE = (
    "{% for m in messages %}<s>[ROLE] {{ m.role | escape }} [/ROLE][INST] "
    '{% if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}'
    " [/INST]</s>{% endfor %}"
)


class TemplateError(ValueError):
    """The template is not of the language, or asks for something that isn't there."""


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple = ()


TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>()\[\].,|]))")
PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
BACKSLASH = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}
CONSTANTS = {"true": True, "false": False, "none": None}
COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}
ARITHMETIC: dict[str, Callable] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: text_of(a) + text_of(b),
    "*": lambda a, b: number(a) * number(b), "%": lambda a, b: number(a) % number(b),
}


def number(x: Any) -> Any:
    """Only numbers multiply, so a template can't blow a string up."""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise TemplateError("a number is needed")
    return x


def text_of(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _controls(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"{re.escape(c[0])}{ESC}*{re.escape(c[1:])}" for c in controls))


def escape(text: str, controls: tuple[str, ...] = CONTROL) -> str:
    return _controls(controls).sub(lambda m: m[0][0] + ESC + m[0][1:], text) if any(c[0] in text for c in controls) else text


def unescape(text: str, controls: tuple[str, ...] = CONTROL) -> str:
    return _controls(controls).sub(lambda m: m[0].replace(ESC, "", 1), text) if ESC in text else text


class Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self) -> Node:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Node("choice", (test, node, self.choice()))
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.sum()
        while op := self.take(*COMPARE):
            node = Node("binary", (op, node, self.sum()))
        return node

    def sum(self) -> Node:
        node = self.product()
        while op := self.take("+", "-", "~"):
            node = Node("binary", (op, node, self.product()))
        return node

    def product(self) -> Node:
        node = self.filtered()
        while op := self.take("*", "%"):
            node = Node("binary", (op, node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.reached()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in ("trim", "upper", "lower", "length", "escape"):
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = Node("filter", (name, node))
        return node

    def reached(self) -> Node:
        node = self.atom()
        while op := self.take(".", "["):
            if op == "[":
                node = Node("item", (node, self.choice()))
                self.need("]")
            else:
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("a name is missing after '.'")
                self.at += 1
                node = Node("item", (node, Node("const", (name,))))
        return node

    def atom(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Node("const", (float(value) if "." in value else int(value),))
        if kind == "str":
            return Node("const", (re.sub(r"\\(.)", lambda m: BACKSLASH.get(m[1], m[1]), value[1:-1], flags=re.DOTALL),))
        if kind == "name":
            return Node("const", (CONSTANTS[value],)) if value in CONSTANTS else Node("name", (value,))
        if value == "(":
            node = self.choice()
            self.need(")")
            return node
        if value == "-":
            return Node("binary", ("-", Node("const", (0,)), self.atom()))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    """A template's syntax tree."""
    pieces, at = [], 0
    for m in PIECE.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m[1] is not None:
            pieces.append(("show", m[1]))
        elif m[2] is not None:
            pieces.append(("do", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    node, end, rest = _block(pieces, 0, ())
    if rest < len(pieces):
        raise TemplateError(f"unexpected {end!r}")
    return node


def _block(pieces: list, at: int, ends: tuple[str, ...]) -> tuple[Node, str, int]:
    body = []
    while at < len(pieces):
        kind, value = pieces[at]
        at += 1
        if kind == "text":
            body.append(Node("text", (value,)))
        elif kind == "show":
            body.append(Node("show", (Expression(value).whole(),)))
        else:
            word, _, rest = value.partition(" ")
            if word in ends:
                return Node("block", tuple(body)), value, at
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
                if not m:
                    raise TemplateError(f"can't read {value!r}")
                inner, _, at = _block(pieces, at, ("endfor",))
                body.append(Node("for", (m[1], Expression(m[2]).whole(), inner)))
            elif word == "if":
                branches, other, test = [], Node("block"), rest
                while True:
                    inner, end, at = _block(pieces, at, ("elif", "else", "endif"))
                    if test is None:
                        other = inner
                    else:
                        branches.append((Expression(test).whole(), inner))
                    if end == "endif":
                        break
                    test = end.partition(" ")[2] if end.startswith("elif") else None
                for t, inner in reversed(branches):
                    other = Node("if", (t, inner, other))
                body.append(other)
            elif word == "set":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(.+)", rest, re.DOTALL)
                if not m:
                    raise TemplateError(f"can't read {value!r}")
                body.append(Node("set", (m[1], Expression(m[2]).whole())))
            elif word == "generation":
                inner, _, at = _block(pieces, at, ("endgeneration",))
                body.append(Node("generation", (inner,)))
            else:
                raise TemplateError(f"unexpected {value!r}")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return Node("block", tuple(body)), "", at


def fold(node: Any, controls: tuple[str, ...] = CONTROL) -> Any:
    """The same tree with constant parts computed, dead branches gone and adjacent literals joined."""
    if isinstance(node, tuple):
        return tuple(fold(x, controls) for x in node)
    if not isinstance(node, Node):
        return node
    node = Node(node.kind, fold(node.args, controls))
    constant = lambda x: isinstance(x, Node) and x.kind == "const"
    inputs = [a for a in node.args if isinstance(a, Node)]
    if node.kind in ("binary", "filter", "not", "and", "or") and all(map(constant, inputs)):
        try:
            return Node("const", (_expression(node, controls)({}),))
        except (TemplateError, TypeError, ZeroDivisionError):
            return node  # it fails where it is reached, not before
    if node.kind in ("if", "choice") and constant(node.args[0]):
        return node.args[1] if node.args[0].args[0] else node.args[2]
    if node.kind == "show" and constant(node.args[0]):
        return Node("text", (text_of(node.args[0].args[0]),))
    if node.kind == "block":
        out: list[Node] = []
        for x in (y for x in node.args for y in (x.args if x.kind == "block" else (x,))):
            if x.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", (out[-1].args[0] + x.args[0],))
            elif x.kind != "text" or x.args[0]:
                out.append(x)
        return Node("block", tuple(out))
    return node


def _expression(node: Node, controls: tuple[str, ...]) -> Callable[[dict], Any]:
    """A closure that evaluates an expression in an environment."""
    if node.kind == "const":
        value = node.args[0]
        return lambda env: value
    if node.kind == "name":
        name = node.args[0]

        def look(env: dict) -> Any:
            if name not in env:
                raise TemplateError(f"{name!r} is not known")
            return env[name]

        return look
    if node.kind == "item":
        of, key = (_expression(x, controls) for x in node.args)

        def item(env: dict) -> Any:
            a, k = of(env), key(env)
            if isinstance(a, dict):
                return a.get(k)
            if isinstance(a, list) and isinstance(k, int):
                return a[k] if -len(a) <= k < len(a) else None
            raise TemplateError("only dicts and lists have items")

        return item
    if node.kind == "binary":
        op = {**COMPARE, **ARITHMETIC}[node.args[0]]
        a, b = (_expression(x, controls) for x in node.args[1:])
        return lambda env: op(a(env), b(env))
    if node.kind == "filter":
        inner = _expression(node.args[1], controls)
        f = {"trim": lambda x: text_of(x).strip(), "upper": lambda x: text_of(x).upper(), "lower": lambda x: text_of(x).lower(), "length": len, "escape": lambda x: escape(text_of(x), controls)}[node.args[0]]
        return lambda env: f(inner(env))
    parts = [_expression(x, controls) for x in node.args]
    if node.kind == "not":
        return lambda env: not parts[0](env)
    if node.kind == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if node.kind == "or":
        return lambda env: parts[0](env) or parts[1](env)
    return lambda env: parts[1](env) if parts[0](env) else parts[2](env)


Out = list[tuple[str, bool]]


def _statement(node: Node, controls: tuple[str, ...], marked: bool = False) -> Callable[[dict, Out], None]:
    """A closure that renders a statement; marked: it stands under a generation marker."""
    if node.kind == "text":
        piece = (node.args[0], marked)
        return lambda env, out: out.append(piece)
    if node.kind == "show":
        value = _expression(node.args[0], controls)
        return lambda env, out: out.append((text_of(value(env)), marked))
    if node.kind == "block":
        steps = [_statement(x, controls, marked) for x in node.args]

        def block(env: dict, out: Out) -> None:
            for step in steps:
                step(env, out)

        return block
    if node.kind == "if":
        test = _expression(node.args[0], controls)
        yes, no = (_statement(x, controls, marked) for x in node.args[1:])
        return lambda env, out: (yes if test(env) else no)(env, out)
    if node.kind == "set":
        name, value = node.args[0], _expression(node.args[1], controls)
        return lambda env, out: env.__setitem__(name, value(env))
    if node.kind == "generation":
        return _statement(node.args[0], controls, True)
    name, over, body = node.args[0], _expression(node.args[1], controls), _statement(node.args[2], controls, marked)

    def loop(env: dict, out: Out) -> None:
        items = over(env)
        if not isinstance(items, list):
            raise TemplateError("only a list can be looped over")
        outer = {k: env[k] for k in (name, "loop") if k in env}
        for i, x in enumerate(items):
            env[name], env["loop"] = x, {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(items)}
            body(env, out)
        for k in (name, "loop"):
            env.pop(k, None)
        env.update(outer)

    return loop


def compile_template(source: str, controls: tuple[str, ...] = CONTROL) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function of a conversation's messages that gives its text and the spans under generation markers, in code points."""
    run = _statement(fold(parse(source), controls), controls)

    def render(messages: list[dict], **more: Any) -> tuple[str, list[tuple[int, int]]]:
        out: Out = []
        run({**more, "messages": messages}, out)
        spans, at = [], 0
        for piece, marked in out:
            if marked and piece:
                spans.append((at, at + len(piece)))
            at += len(piece)
        return "".join(p for p, _ in out), spans

    return render


def format_conversations(df: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROL) -> DataFrame:
    """conv_id, n_turns, formatted, loss (array of start, end in code points): a row for each conversation of (conv_id, turn, role, text).

    Conversations are dealt by id and read in order from sorted partitions, one at a time.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["conv_id", "n_turns", "formatted", "loss"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, controls)
        rows: list[tuple] = []
        current, messages, size, kind_of_id = None, None, 0, None

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind_of_id), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], arrow)], names=names)

        def close() -> int:
            text, spans = render(messages)
            rows.append((current, len(messages), text, [{"start": s, "end": e} for s, e in spans]))
            return len(text)

        for batch in batches:
            kind_of_id = batch.column(0).type
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if messages is None or conv != current:
                    if messages is not None:
                        size += close()
                        if size > 4_000_000:
                            yield emit()
                            rows.clear()
                            size = 0
                    current, messages = conv, []
                messages.append({"role": role or "", "text": text or ""})
        if messages is not None:
            close()
            yield emit()

    turns = df.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "role", "text").mapInArrow(work, f"conv_id {kind}, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>")


TURN = re.compile(r"<s>\[ROLE\] (.*?) \[/ROLE\]\[INST\] (.*?) \[/INST\]</s>", re.DOTALL)


def read_back(formatted: str, loss: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """(turns as role and text, texts under the loss mask), from the production template's output alone."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns, [unescape(formatted[s:e]) for s, e in loss]


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read back from each formatted conversation."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns, learned = read_back(text, [(x["start"], x["end"]) for x in loss])
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                joined = "".join(learned)
                rows.append((len(turns), digest.hexdigest(), len(joined), hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())))], names=names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(work, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

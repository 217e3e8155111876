"""A small sandboxed template language for conversations, compiled to Python closures.

    {{ expr }}                                   output
    {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% for name in expr %} {% endfor %}          with loop.index0, loop.first, loop.last
    {% set name = expr %}
    {% generation %} {% endgeneration %}         marks what a model learns to write
    {# comment #}

Expressions: names, fields (m.role), literals ('text', 12, true, false, none), + (text or numbers),
==, !=, and, or, not, parentheses and filters from a fixed list (x | trim). There are no calls, no
indexing by expressions, and fields are looked up in dicts only, so a template can't reach Python
objects. Parsing gives a syntax tree, constants in it are folded, and each node becomes a closure.

A compiled template is a generator of (text, is_generation) pieces. It pulls its messages from an
iterator and looks one ahead for loop.last, so a conversation of any length streams through it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """The template breaks the grammar or uses an unknown name."""


# ---- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    name: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class For:
    name: str
    expr: Any
    body: tuple


@dataclass(frozen=True)
class SetVar:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- parser

_BLOCK = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*')|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sym>==|!=|[+().|]))", re.S)
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expr:
    def __init__(self, source: str):
        self.source, self.tokens, at = source, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def whole(self) -> Any:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over in {self.source!r}")
        return node

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Op("or", (node, self.both()))
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Op("and", (node, self.negated()))
        return node

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        node = self.summed()
        for sign in ("==", "!="):
            if self.take(sign):
                return Op(sign, (node, self.summed()))
        return node

    def summed(self) -> Any:
        node = self.piped()
        while self.take("+"):
            node = Op("+", (node, self.piped()))
        return node

    def piped(self) -> Any:
        node = self.atom()
        while True:
            if self.take("|"):
                node = Filter(self.word(), node)
            elif self.take("."):
                node = Field(node, self.word())
            else:
                return node

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError(f"a name is missing in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> Any:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError(f"unclosed bracket in {self.source!r}")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError(f"an operand is missing in {self.source!r}")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "num":
            return Const(int(text))
        if kind == "name":
            return Const(_WORDS[text]) if text in _WORDS else Name(text)
        raise TemplateError(f"unexpected {text!r} in {self.source!r}")


def parse(source: str) -> tuple:
    """Template text to a tuple of statements."""
    items: list[tuple[str, str]] = []
    at = 0
    for m in _BLOCK.finditer(source):
        if m.start() > at:
            items.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            items.append(("out", m[1]))
        elif m[2] is not None:
            items.append(("tag", m[2].strip()))
    if at < len(source):
        items.append(("text", source[at:]))
    place = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        found: list[Any] = []
        while place < len(items):
            kind, text = items[place]
            place += 1
            if kind == "text":
                found.append(Output(Const(text)))
            elif kind == "out":
                found.append(Output(_Expr(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(found), text
                found.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(found), ""

    def statement(word: str, rest: str) -> Any:
        if word == "if":
            arms, condition = [], _Expr(rest).whole()
            while True:
                inner, end = body("elif", "else", "endif")
                arms.append((condition, inner))
                if end == "endif":
                    return If(tuple(arms))
                condition = Const(True) if end == "else" else _Expr(end[4:]).whole()
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            return For(m[1], _Expr(m[2]).whole(), body("endfor")[0])
        if word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)):
            return SetVar(m[1], _Expr(m[2]).whole())
        if word == "generation" and not rest:
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return body()[0]


# ---- constant folding


def fold(node: Any, filters: dict[str, Callable]) -> Any:
    """Work out what needs no data; join neighbouring constant outputs; drop dead branches."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in node:
            y = fold(x, filters)
            for z in y if isinstance(y, tuple) else (y,):
                if isinstance(z, Output) and z.expr == Const(""):
                    continue
                if out and all(isinstance(s, Output) and isinstance(s.expr, Const) for s in (out[-1], z)):
                    out[-1] = Output(Const(_text(out[-1].expr.value) + _text(z.expr.value)))
                else:
                    out.append(z)
        return tuple(out)
    if isinstance(node, Output):
        expr = fold(node.expr, filters)
        return Output(Const(_text(expr.value)) if isinstance(expr, Const) else expr)
    if isinstance(node, Field):
        return Field(fold(node.of, filters), node.name)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of = fold(node.of, filters)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_compile_expr(Op(node.kind, args), filters)({}))
        if node.kind in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
        return Op(node.kind, args)
    if isinstance(node, If):
        arms = []
        for condition, inner in node.arms:
            condition = fold(condition, filters)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(inner, filters)))
            if isinstance(condition, Const):
                break
        if not arms:
            return ()
        return arms[0][1] if isinstance(arms[0][0], Const) else If(tuple(arms))
    if isinstance(node, For):
        return For(node.name, fold(node.expr, filters), fold(node.body, filters))
    if isinstance(node, SetVar):
        return SetVar(node.name, fold(node.expr, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


# ---- closures

Piece = tuple[str, bool]


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _plus(a: Any, b: Any) -> Any:
    numbers = all(isinstance(x, int) and not isinstance(x, bool) for x in (a, b))
    return a + b if numbers else _text(a) + _text(b)


def _compile_expr(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env: dict) -> Any:
            if name not in env:
                raise TemplateError(f"unknown name {name!r}")
            return env[name]

        return look
    if isinstance(node, Field):
        of, key = _compile_expr(node.of, filters), node.name

        def field(env: dict) -> Any:
            value = of(env)
            return value.get(key) if isinstance(value, dict) else None

        return field
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        inner, apply = _compile_expr(node.of, filters), filters[node.name]
        return lambda env: apply(inner(env))
    args = [_compile_expr(a, filters) for a in node.args]
    if node.kind == "not":
        return lambda env: not args[0](env)
    a, b = args
    return {
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "+": lambda env: _plus(a(env), b(env)),
    }[node.kind]


def _compile_body(nodes: tuple, filters: dict[str, Callable], marked: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_compile_statement(n, filters, marked) for n in nodes]

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def _compile_statement(node: Any, filters: dict[str, Callable], marked: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Output):
        expr = _compile_expr(node.expr, filters)

        def out(env: dict) -> Iterator[Piece]:
            yield _text(expr(env)), marked

        return out
    if isinstance(node, If):
        arms = [(_compile_expr(c, filters), _compile_body(b, filters, marked)) for c, b in node.arms]

        def choose(env: dict) -> Iterator[Piece]:
            for condition, inner in arms:
                if condition(env):
                    yield from inner(env)
                    return

        return choose
    if isinstance(node, SetVar):
        name, value = node.name, _compile_expr(node.expr, filters)

        def put(env: dict) -> Iterator[Piece]:
            env[name] = value(env)
            yield from ()

        return put
    if isinstance(node, Generation):
        return _compile_body(node.body, filters, True)
    name, items, inner = node.name, _compile_expr(node.expr, filters), _compile_body(node.body, filters, marked)

    def loop(env: dict) -> Iterator[Piece]:
        it = iter(items(env) or ())
        end = object()
        now, k = next(it, end), 0
        kept = {x: env[x] for x in (name, "loop") if x in env}
        while now is not end:
            after = next(it, end)
            env[name], env["loop"] = now, {"index0": k, "first": k == 0, "last": after is end}
            yield from inner(env)
            now, k = after, k + 1
        for x in (name, "loop"):
            env.pop(x, None)
        env.update(kept)

    return loop


FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "title": lambda x: _text(x).title(),
    "length": lambda x: len(x or ""),
}


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """Template text to a function of named values that yields (text, is_generation) pieces."""
    known = FILTERS | (filters or {})
    run = _compile_body(fold(parse(source), known), known, False)

    def render(**values: Any) -> Iterator[Piece]:
        return run(dict(values))

    return render

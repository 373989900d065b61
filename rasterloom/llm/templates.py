"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}`` writes a value, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in xs %} {% endfor %}``, ``{% set x = expression %}`` and ``{% generation %}
{% endgeneration %}`` control what is written, ``{# #}`` is a comment.  Expressions have
strings, integers, ``true``, ``false``, ``none``, names, ``a.b`` and ``a['b']`` on mappings,
``+ ~ == != < <= > >= in and or not``, ``x if c else y`` and filters.  There are no calls and
no attributes of Python objects, so a template reaches nothing but its data.

The source becomes a syntax tree; constants are folded and neighbouring texts joined; each
node becomes a closure.  A statement's closure is a generator of ``(text, generated)``, so a
loop over an iterator renders a conversation of any length in constant memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>()\[\].|+~,=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_KEYWORDS = {"if", "else", "and", "or", "not", "in"}


class TemplateError(ValueError):
    """A template that can't be read, or data that it can't be applied to."""


def _text(value: Any) -> str:
    return "" if value is None else str(value)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": len,
    "string": _text,
}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Expressions:
    """Recursive descent; nodes are tuples ``(kind, ...)``."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind in ("op", "name") and value in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing before {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name" or value in _KEYWORDS or value.startswith("_"):
            raise TemplateError(f"{value!r} is no name")
        self.at += 1
        return value

    def end(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over")

    def whole(self) -> tuple:
        out = self.choice()
        self.end()
        return out

    def choice(self) -> tuple:
        out = self.either()
        if self.take("if"):
            condition = self.either()
            other = self.choice() if self.take("else") else ("const", None)
            return ("if", condition, out, other)
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        out = self.sum()
        while self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
            op = self.tokens[self.at][1]
            self.at += 1
            out = (op, out, self.sum())
        return out

    def sum(self) -> tuple:
        out = self.filtered()
        while self.peek("+", "~"):
            op = self.tokens[self.at][1]
            self.at += 1
            out = (op, out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.item()
        while self.take("|"):
            out = ("filter", self.name(), out)
        return out

    def item(self) -> tuple:
        kind, value = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            out: tuple = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "int":
            self.at += 1
            out = ("const", int(value))
        elif self.take("("):
            out = self.choice()
            self.need(")")
        elif kind == "name" and value in ("true", "false", "none"):
            self.at += 1
            out = ("const", {"true": True, "false": False, "none": None}[value])
        else:
            out = ("name", self.name())
        while self.peek(".", "["):
            if self.take("."):
                out = ("get", out, ("const", self.name()))
            else:
                self.need("[")
                out = ("get", out, self.choice())
                self.need("]")
        return out


def parse(source: str) -> list[tuple]:
    """The syntax tree: a list of statements."""
    stack: list[tuple[str, list, Any]] = [("root", [], None)]
    at = 0
    for m in _TAGS.finditer(source):
        if m.start() > at:
            stack[-1][1].append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("write", _Expressions(m[1]).whole()))
            continue
        if m[2] is None:
            continue
        word, _, rest = m[2].strip().partition(" ")
        kind, body, held = stack[-1]
        if word == "if":
            stack.append(("if", [], [(_Expressions(rest).whole(), None)]))
        elif word in ("elif", "else") and kind == "if":
            held[-1] = (held[-1][0], list(body))
            held.append((_Expressions(rest).whole() if word == "elif" else ("const", True), None))
            body.clear()
        elif word == "endif" and kind == "if":
            held[-1] = (held[-1][0], body)
            stack.pop()
            stack[-1][1].append(("if", held))
        elif word == "for":
            e = _Expressions(rest)
            name = e.name()
            e.need("in")
            stack.append(("for", [], (name, e.whole())))
        elif word == "endfor" and kind == "for":
            stack.pop()
            stack[-1][1].append(("for", *held, body))
        elif word == "set":
            e = _Expressions(rest)
            name = e.name()
            e.need("=")
            body.append(("set", name, e.whole()))
        elif word == "generation":
            stack.append(("generation", [], None))
        elif word == "endgeneration" and kind == "generation":
            stack.pop()
            stack[-1][1].append(("generation", body))
        else:
            raise TemplateError(f"{m[0]!r} is out of place")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} isn't ended")
    if at < len(source):
        stack[0][1].append(("text", source[at:]))
    return stack[0][1]


def _typed(f: Callable) -> Callable:
    """An operation on values that may not go together."""

    def run(a: Any, b: Any) -> Any:
        try:
            return f(a, b)
        except TypeError as e:
            raise TemplateError(f"{a!r} and {b!r} don't go together") from e

    return run


_BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
_BINARY = {sign: _typed(f) for sign, f in _BINARY.items()}


def _get(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, list) and type(key) is int:
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError(f"only mappings and lists have items; {key!r} was asked for")


def fold(node: Any, pure: frozenset[str] = frozenset(FILTERS)) -> Any:
    """An expression with its constant parts worked out."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold(node[2], pure)
        return ("const", FILTERS[node[1]](inner[1])) if inner[0] == "const" and node[1] in pure else ("filter", node[1], inner)
    parts = [fold(x, pure) for x in node[1:]]
    if kind == "if" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(p[0] == "const" for p in parts):
        values = [p[1] for p in parts]
        if kind == "not":
            return ("const", not values[0])
        if kind == "get":
            return ("const", _get(*values))
        if kind in _BINARY:
            return ("const", _BINARY[kind](*values))
    return (kind, *parts)


def fold_body(body: list[tuple], pure: frozenset[str] = frozenset(FILTERS)) -> list[tuple]:
    """Statements with constants folded, dead branches dropped and neighbouring texts joined."""
    out: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        kind = node[0]
        if kind == "write":
            e = fold(node[1], pure)
            put(("text", _text(e[1])) if e[0] == "const" else ("write", e))
        elif kind == "if":
            branches = []
            for condition, inner in node[1]:
                c = fold(condition, pure)
                if c[0] == "const" and not c[1]:
                    continue
                branches.append((c, fold_body(inner, pure)))
                if c[0] == "const":
                    break
            if branches and branches[0][0][0] == "const":
                for x in branches[0][1]:
                    put(x)
            elif branches:
                put(("if", branches))
        elif kind == "for":
            put(("for", node[1], fold(node[2], pure), fold_body(node[3], pure)))
        elif kind == "generation":
            put(("generation", fold_body(node[1], pure)))
        elif kind == "set":
            put(("set", node[1], fold(node[2], pure)))
        else:
            put(node)
    return out


def _expression(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"no filter is named {node[1]!r}")
        f, inner = filters[node[1]], _expression(node[2], filters)
        return lambda env: f(inner(env))
    if kind == "if":
        c, a, b = (_expression(x, filters) for x in node[1:])
        return lambda env: a(env) if c(env) else b(env)
    if kind == "not":
        a = _expression(node[1], filters)
        return lambda env: not a(env)
    a, b = (_expression(x, filters) for x in node[1:])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    f = _get if kind == "get" else _BINARY[kind]
    return lambda env: f(a(env), b(env))


Pieces = Iterator[tuple[str, bool]]


def _statements(body: list[tuple], filters: dict[str, Callable]) -> Callable[[dict, bool], Pieces]:
    steps = [_statement(x, filters) for x in body]

    def run(env: dict, generated: bool) -> Pieces:
        for step in steps:
            yield from step(env, generated)

    return run


def _statement(node: tuple, filters: dict[str, Callable]) -> Callable[[dict, bool], Pieces]:
    kind = node[0]
    if kind == "text":
        text = node[1]

        def run(env: dict, generated: bool) -> Pieces:
            yield text, generated
    elif kind == "write":
        value = _expression(node[1], filters)

        def run(env: dict, generated: bool) -> Pieces:
            yield _text(value(env)), generated
    elif kind == "set":
        name, value = node[1], _expression(node[2], filters)

        def run(env: dict, generated: bool) -> Pieces:
            env[name] = value(env)
            yield from ()
    elif kind == "if":
        branches = [(_expression(c, filters), _statements(b, filters)) for c, b in node[1]]

        def run(env: dict, generated: bool) -> Pieces:
            for condition, inner in branches:
                if condition(env):
                    yield from inner(env, generated)
                    return
    elif kind == "generation":
        inner = _statements(node[1], filters)

        def run(env: dict, generated: bool) -> Pieces:
            yield from inner(env, True)
    else:
        name, items, inner = node[1], _expression(node[2], filters), _statements(node[3], filters)

        def run(env: dict, generated: bool) -> Pieces:
            given = items(env)
            if given is None:
                return
            rest = iter(given)
            one, before, index = next(rest, rest), None, 0
            while one is not rest:
                following = next(rest, rest)
                loop = {"index": index + 1, "index0": index, "first": index == 0, "last": following is rest, "previtem": before}
                yield from inner(env | {name: one, "loop": loop}, generated)
                one, before, index = following, one, index + 1

    return run


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Pieces]:
    """A function of named data that yields ``(text, generated)`` pieces."""
    run = _statements(fold_body(parse(source), frozenset(FILTERS) - set(filters or {})), FILTERS | (filters or {}))
    return lambda **data: run(data, False)

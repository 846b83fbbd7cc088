"""The formula language: text to a checked expression tree, and the tree to a Spark column.

Numbers are doubles, conditions booleans; the two don't mix. Operators bind, loosest first: or, and, not, comparison (of which there is one
in a row at most), + -, * /, negation. A failed operation is an error, not a null, unless it is in the branch of an ``if``
that isn't taken. Arguments may be named. Whole-plane functions (fields, shapes, noise) are columns that the caller binds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the language (fixed values).
MOST_BYTES, DEEPEST = 4096, 64

_TOKEN = re.compile(
    r"""(?P<space>[ \t\n\r]+)
    |(?P<number>[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)
    |(?P<word>[a-z][a-z0-9_]*)
    |(?P<selector>'[^'\x00-\x1f\x7f]*')
    |(?P<op><=|>=|==|!=|[-+*/<>(),.=])""",
    re.X,
)
#: Operators of other languages, and what to write (fixed values).
FOREIGN = {"&": "write `and`", "|": "write `or`", "~": "write `not`", "!": "write `not`", "**": "write `pow(a, b)`", "^": "write `pow(a, b)`", "%": "write `a - b * floor(a / b)`", '"': "selectors take single quotes", "?": "write `if(c, a, b)`", ":": "write `if(c, a, b)`"}


class FormulaError(ValueError):
    """``code`` names the breach, ``at`` the offset in the text."""

    def __init__(self, code: str, message: str, at: int = 0) -> None:
        super().__init__(f"{code} at {at}: {message}")
        self.code, self.at = code, at


@dataclass(frozen=True)
class Node:
    """op: number, name, selector, call, an operator, ``neg`` or ``not``."""

    op: str
    value: object = None
    args: tuple["Node", ...] = ()
    named: tuple[tuple[str, "Node"], ...] = ()
    at: int = 0


def tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        if text.startswith("**", at):
            raise FormulaError("formula.operator", FOREIGN["**"], at)
        m = _TOKEN.match(text, at)
        if not m:
            c = text[at]
            if c in FOREIGN:
                raise FormulaError("formula.operator", FOREIGN[c], at)
            if c == "'":
                raise FormulaError("formula.syntax", "a selector without its end", at)
            raise FormulaError("formula.character", f"{c!r}" + (": names are lower case" if c.isupper() else ""), at)
        if m.lastgroup == "number":
            if re.match(r"[A-Za-z0-9_.]", text[m.end() : m.end() + 1]):
                raise FormulaError("formula.syntax", "write the number in full, `1e3`, `5.0`", at)
            x = float(m[0])
            if math.isinf(x) or (x == 0 and re.search(r"[1-9]", re.split("[eE]", m[0])[0])):
                raise FormulaError("formula.syntax", "beyond the magnitudes a double holds", at)
        if m.lastgroup == "op" and m[0] == "." and re.match(r"[0-9]", text[m.end() : m.end() + 1]) and not (out and out[-1][0] == "word"):
            raise FormulaError("formula.syntax", f"write `0.{text[m.end()]}`", at)
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return [*out, ("end", "", len(text))]


class _Parser:
    #: Binary operators by level, loosest first.
    LEVELS = (("or",), ("and",), (), ("<", "<=", ">", ">=", "==", "!="), ("+", "-"), ("*", "/"))

    def __init__(self, text: str) -> None:
        self.tokens, self.k, self.depth = tokens(text), 0, 0

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.k]

    def take(self, value: str) -> bool:
        if self.peek()[0] in ("op", "word") and self.peek()[1] == value:
            self.k += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise FormulaError("formula.syntax", f"expected `{value}`", self.peek()[2])

    def deeper(self, parse: Callable[[], Node]) -> Node:
        self.depth += 1
        if self.depth > DEEPEST:
            raise FormulaError("formula.too_deep", f"nested more than {DEEPEST} deep", self.peek()[2])
        out = parse()
        self.depth -= 1
        return out

    def level(self, n: int = 0) -> Node:
        if n == len(self.LEVELS):
            return self.negation()
        if n == 2:
            at = self.peek()[2]
            if self.take("not"):
                return Node("not", args=(self.deeper(lambda: self.level(2)),), at=at)
            return self.level(3)
        left = self.level(n + 1)
        while (t := self.peek())[1] in self.LEVELS[n] and t[0] in ("op", "word"):
            self.k += 1
            left = Node(t[1], args=(left, self.level(n + 1)), at=t[2])
            if n == 3:
                if self.peek()[1] in self.LEVELS[3] and self.peek()[0] == "op":
                    raise FormulaError("formula.syntax", "write `a < b and b < c`", self.peek()[2])
                break
        return left

    def negation(self) -> Node:
        at = self.peek()[2]
        if self.take("-"):
            return Node("neg", args=(self.deeper(self.negation),), at=at)
        return self.primary()

    def primary(self) -> Node:
        kind, value, at = self.peek()
        if kind == "number":
            self.k += 1
            return Node("number", float(value), at=at)
        if kind == "selector":
            self.k += 1
            return Node("selector", value[1:-1], at=at)
        if self.take("("):
            out = self.deeper(self.level)
            self.need(")")
            return out
        if kind == "word" and value not in ("and", "or", "not"):
            self.k += 1
            if self.take("("):
                return self.deeper(lambda: self.call(value, at))
            if self.take("."):
                kind, own, _ = self.peek()
                if kind != "word":
                    raise FormulaError("formula.syntax", "expected a name after `.`", self.peek()[2])
                self.k += 1
                return Node("name", f"{value}.{own}", at=at)
            return Node("name", value, at=at)
        if value == "=":
            raise FormulaError("formula.operator", "write `==`", at)
        raise FormulaError("formula.syntax", "write an expression after `=`" if kind == "end" and not self.k else "expected an expression", at)

    def call(self, name: str, at: int) -> Node:
        args: list[Node] = []
        named: dict[str, Node] = {}
        while not self.take(")"):
            if args or named:
                self.need(",")
            kind, value, here = self.peek()
            if kind == "word" and self.tokens[self.k + 1][1] == "=":
                self.k += 2
                if value in named:
                    raise FormulaError("formula.arguments", f"`{value}` is given twice", here)
                named[value] = self.level()
            elif named:
                raise FormulaError("formula.arguments", "positional arguments come before named ones", here)
            else:
                args.append(self.level())
        return Node("call", name, tuple(args), tuple(named.items()), at)


def parse(text: str) -> Node:
    """The tree of a formula, with or without its leading ``=``."""
    text = text[1:] if text.startswith("=") else text
    if len(text.encode()) > MOST_BYTES:
        raise FormulaError("formula.too_long", f"more than {MOST_BYTES} bytes")
    p = _Parser(text)
    out = p.level()
    if p.peek()[0] != "end":
        raise FormulaError("formula.operator" if p.peek()[1] == "=" else "formula.syntax", "write `==`" if p.peek()[1] == "=" else "expected the end", p.peek()[2])
    return out


def names(node: Node) -> set[str]:
    """Names that a formula reads."""
    own = {str(node.value)} if node.op == "name" else set()
    return own.union(*(names(x) for x in node.args), *(names(x) for _, x in node.named))


def fail(code: str, message: str) -> Column:
    return F.raise_error(F.lit(f"{code}: {message}")).cast("double")


def guard(value: Column, ok: Column, code: str, message: str) -> Column:
    return F.when(ok, value).otherwise(fail(code, message))


def _turned(degrees: Column) -> tuple[Column, Column]:
    """Quadrant, and radians within it."""
    r = degrees % 360.0
    r = F.when(r < 0, r + 360.0).otherwise(r)
    q = F.when(r < 90, 0).when(r < 180, 1).when(r < 270, 2).otherwise(3)
    return q, (r - q * F.lit(90.0)) * F.lit(math.pi / 180.0)


def sin_degrees(a: Column) -> Column:
    q, h = _turned(a)
    return F.when(q == 0, F.sin(h)).when(q == 1, F.cos(h)).when(q == 2, -F.sin(h)).otherwise(-F.cos(h)) + F.lit(0.0)


def cos_degrees(a: Column) -> Column:
    q, h = _turned(a)
    return F.when(q == 0, F.cos(h)).when(q == 1, -F.sin(h)).when(q == 2, -F.cos(h)).otherwise(F.sin(h)) + F.lit(0.0)


def tan_degrees(a: Column) -> Column:
    c = cos_degrees(a)
    return guard(sin_degrees(a) / F.nullif(c, F.lit(0.0)), c != 0, "formula.not_finite", "tan")


def clamp(a: Column, lo: Column, hi: Column) -> Column:
    return guard(F.least(F.greatest(a, lo), hi), lo <= hi, "formula.range", "clamp needs lo <= hi")


def mix(a: Column, b: Column, s: Column) -> Column:
    return (F.lit(1.0) - s) * a + s * b


def smoothstep(e0: Column, e1: Column, a: Column) -> Column:
    s = F.least(F.greatest((a - e0) / F.nullif(e1 - e0, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return guard(s * s * (F.lit(3.0) - F.lit(2.0) * s), e0 < e1, "formula.range", "smoothstep needs e0 < e1")


def finite(value: Column, what: str) -> Column:
    return guard(value, ~F.isnan(value) & (F.abs(value) != float("inf")), "formula.not_finite", what)


#: Name to parameters, parameter types and result (n: number, c: condition, =: as the branches), and the column.
FUNCTIONS: dict[str, tuple[tuple[str, ...], str, Callable[..., Column]]] = {
    "abs": (("a",), "n:n", F.abs),
    "sqrt": (("a",), "n:n", lambda a: guard(F.sqrt(a), a >= 0, "formula.not_finite", "sqrt of a negative number")),
    "pow": (("a", "b"), "nn:n", lambda a, b: finite(F.pow(a, b), "pow")),
    "exp": (("a",), "n:n", lambda a: finite(F.exp(a), "exp")),
    "floor": (("a",), "n:n", lambda a: F.floor(a).cast("double")),
    "sin": (("a",), "n:n", sin_degrees),
    "cos": (("a",), "n:n", cos_degrees),
    "tan": (("a",), "n:n", tan_degrees),
    "min": (("a", "b"), "n*:n", F.least),
    "max": (("a", "b"), "n*:n", F.greatest),
    "clamp": (("a", "lo", "hi"), "nnn:n", clamp),
    "mix": (("a", "b", "s"), "nnn:n", mix),
    "smoothstep": (("e0", "e1", "a"), "nnn:n", smoothstep),
    "if": (("c", "a", "b"), "c==:=", lambda c, a, b: F.when(c, a).otherwise(b)),
}


@dataclass
class Scope:
    """What names and whole-plane calls stand for. ``lets`` are formulas by name, which may read one another."""

    columns: dict[str, Column] = field(default_factory=dict)
    lets: dict[str, str] = field(default_factory=dict)
    calls: dict[str, Callable[..., Column]] = field(default_factory=dict)


def compile_formula(text: str, scope: Scope | None = None, kind: str = "n") -> Column:
    """The column of a formula: a double (``n``) or a condition (``c``)."""
    scope = scope or Scope()
    out, got = _column(parse(text), scope, ())
    if got != kind:
        raise FormulaError("formula.type", f"a {'number' if kind == 'n' else 'condition'} is needed")
    return out


def _column(node: Node, scope: Scope, open_: tuple[str, ...]) -> tuple[Column, str]:
    def one(x: Node, kind: str) -> Column:
        column, got = _column(x, scope, open_)
        if got != kind:
            raise FormulaError("formula.type", f"a {'number' if kind == 'n' else 'condition'} is needed", x.at)
        return column

    op = node.op
    if op == "number":
        return F.lit(node.value), "n"
    if op == "name":
        name = str(node.value)
        if name in scope.lets:
            if name in open_:
                raise FormulaError("formula.cycle", " -> ".join([*open_, name]), node.at)
            return _column(parse(scope.lets[name]), scope, (*open_, name))
        if name == "pi":
            return F.lit(math.pi), "n"
        if name not in scope.columns:
            raise FormulaError("formula.unknown_name", name, node.at)
        return scope.columns[name], "n"
    if op == "neg":
        return -one(node.args[0], "n"), "n"
    if op == "not":
        return ~one(node.args[0], "c"), "c"
    if op in ("and", "or"):
        a, b = (one(x, "c") for x in node.args)
        return (a & b if op == "and" else a | b), "c"
    if op in _Parser.LEVELS[3]:
        a, b = (one(x, "n") for x in node.args)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op], "c"
    if op in ("+", "-", "*", "/"):
        a, b = (one(x, "n") for x in node.args)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: guard(a / F.nullif(b, F.lit(0.0)), b != 0, "formula.not_finite", "division by 0")}[op](), "n"
    if op == "call":
        return _call(node, scope, open_, one)
    raise FormulaError("formula.type", "a selector is an argument, not a value", node.at)


def _call(node: Node, scope: Scope, open_: tuple[str, ...], one: Callable[[Node, str], Column]) -> tuple[Column, str]:
    name = str(node.value)
    if name in scope.calls:
        plain = lambda x: x.value if x.op in ("selector", "number") else one(x, "n")
        return scope.calls[name](*map(plain, node.args), **{k: plain(x) for k, x in node.named}), "n"
    if name not in FUNCTIONS:
        raise FormulaError("formula.unknown_function", name, node.at)
    params, types, make = FUNCTIONS[name]
    takes, gives = types.split(":")
    given = dict(node.named)
    if takes == "n*":
        if given or len(node.args) < 2:
            raise FormulaError("formula.arguments", f"{name} takes two or more numbers", node.at)
        return make(*(one(x, "n") for x in node.args)), "n"
    if set(given) - set(params[len(node.args) :]) or len(node.args) + len(given) != len(params):
        raise FormulaError("formula.arguments", f"{name} takes {', '.join(params)}", node.at)
    args = [*node.args, *(given[p] for p in params[len(node.args) :])]
    if gives != "=":
        return make(*(one(x, k) for x, k in zip(args, takes))), gives
    branches = [_column(x, scope, open_) for x in args[1:]]
    if branches[0][1] != branches[1][1]:
        raise FormulaError("formula.type", "both branches are of one type", node.at)
    return make(one(args[0], "c"), branches[0][0], branches[1][0]), branches[0][1]

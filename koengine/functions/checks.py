"""CHECK expressions compiled to columns, with violations where a value is missing.

A missing operand is a violation, not SQL's unknown: ``false AND missing`` is false and ``true OR
missing`` true, everything else with a missing operand is an error. Each node compiles to a pair
(value, is_error).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Prop:
    name: str


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Op:
    """Comparison, arithmetic, and, or, not, if."""

    op: str
    args: tuple[Any, ...]


def compile_check(e: Any) -> tuple[Column, Column]:
    """(value, is_error) of an expression."""
    if isinstance(e, Lit):
        return F.lit(e.value), F.lit(False)
    if isinstance(e, Prop):
        return F.col(e.name), F.col(e.name).isNull()
    args = [compile_check(a) for a in e.args]
    if e.op == "not":
        (v, err), = args
        return ~v, err
    if e.op == "and":
        (a, ea), (b, eb) = args
        # left to right: a false left side ends it
        return F.when(~ea & ~a, F.lit(False)).otherwise(a & b), ea | (~(~ea & ~a) & eb)
    if e.op == "or":
        (a, ea), (b, eb) = args
        return F.when(~ea & a, F.lit(True)).otherwise(a | b), ea | (~(~ea & a) & eb)
    if e.op == "if":
        (c, ec), (t, et), (f, ef) = args
        return F.when(c, t).otherwise(f), ec | F.when(c, et).otherwise(ef)
    (a, ea), (b, eb) = args
    err = ea | eb
    if e.op == "/":
        return F.when(b != 0, a / b), err | F.coalesce(b == 0, F.lit(False))
    ops = {"==": lambda: a == b, "!=": lambda: a != b, ">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}
    return ops[e.op](), err


def violates(e: Any) -> Column:
    """True where the check does not hold or cannot be evaluated."""
    v, err = compile_check(e)
    return err | ~F.coalesce(v, F.lit(False))


_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>==|!=|>=|<=|>|<|\(|\))|(?P<word>[A-Za-z_]\w*))")


def parse_check(source: str) -> Any:
    """``a == 1 and (b > 2 or not c == "x")``: comparisons, AND, OR, NOT, parentheses."""
    toks, at = [], 0
    while at < len(source.rstrip()):
        m = _TOKEN.match(source, at)
        if m is None:
            raise ValueError(f"unexpected {source[at:at + 8]!r} in a check")
        toks.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    pos = 0

    def peek(word: str) -> bool:
        return pos < len(toks) and toks[pos][1].lower() == word

    def operand() -> Any:
        nonlocal pos
        if pos >= len(toks):
            raise ValueError("the check ends early")
        kind, text = toks[pos]
        pos += 1
        if kind == "num":
            return Lit(float(text) if "." in text else int(text))
        if kind == "str":
            return Lit(text[1:-1])
        if kind == "word":
            low = text.lower()
            return Lit({"true": True, "false": False, "null": None}[low]) if low in ("true", "false", "null") else Prop(text)
        raise ValueError(f"unexpected {text!r} in a check")

    def unary() -> Any:
        nonlocal pos
        if peek("not"):
            pos += 1
            return Op("not", (unary(),))
        if peek("("):
            pos += 1
            e = either()
            if not peek(")"):
                raise ValueError("a parenthesis is not closed")
            pos += 1
            return e
        a = operand()
        if pos < len(toks) and toks[pos][0] == "op" and toks[pos][1] not in "()":
            op = toks[pos][1]
            pos += 1
            return Op(op, (a, operand()))
        return a

    def both() -> Any:
        nonlocal pos
        e = unary()
        while peek("and"):
            pos += 1
            e = Op("and", (e, unary()))
        return e

    def either() -> Any:
        nonlocal pos
        e = both()
        while peek("or"):
            pos += 1
            e = Op("or", (e, both()))
        return e

    e = either()
    if pos < len(toks):
        raise ValueError(f"unexpected {toks[pos][1]!r} in a check")
    return e

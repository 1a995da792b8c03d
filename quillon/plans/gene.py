"""Genes: expression trees over columns and constants, their text forms and rewrites."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Union

from quillon.functions.primitives import GROUP_PRIMITIVES, REGISTRY

Node = Union["Call", "Col", "Const"]


@dataclass(frozen=True)
class Col:
    """A column of the input."""

    name: str


@dataclass(frozen=True)
class Const:
    """A number."""

    value: float


@dataclass(frozen=True)
class Call:
    """A primitive applied to sub-trees."""

    name: str
    args: tuple[Node, ...]


_TOKEN = re.compile(r"\s*([A-Za-z_][\w\-^+]*|`[^`]+`|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),])")


def parse(text: str, more: Mapping[str, int] | None = None) -> Node:
    """A gene from prefix text such as Add(Mul(l_quantity, l_discount), 0.5); names with odd characters go in backticks.

    more: primitives known besides the registered ones, with their numbers of arguments.
    """
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(m[1])
        at = m.end()
    node, rest = _read(tokens, 0, more or {})
    if rest != len(tokens):
        raise ValueError(f"text left over: {' '.join(tokens[rest:])!r}")
    return node


def _read(tokens: list[str], at: int, more: Mapping[str, int]) -> tuple[Node, int]:
    if at >= len(tokens):
        raise ValueError("text ends inside a gene")
    head = tokens[at]
    if at + 1 < len(tokens) and tokens[at + 1] == "(":
        arity = more.get(head) or GROUP_PRIMITIVES.get(head) or (REGISTRY[head].arity if head in REGISTRY else None)
        if arity is None:
            raise ValueError(f"unknown primitive {head!r}")
        args, at = [], at + 2
        while True:
            arg, at = _read(tokens, at, more)
            args.append(arg)
            if at >= len(tokens) or tokens[at] not in ",)":
                raise ValueError(f"missing bracket after an argument of {head}")
            at += 1
            if tokens[at - 1] == ")":
                break
        if len(args) != arity:
            raise ValueError(f"{head} takes {arity} arguments, not {len(args)}")
        return Call(head, tuple(args)), at
    if head in "(),":
        raise ValueError(f"{head!r} where a gene should start")
    if re.match(r"[-+.\d]", head):
        return Const(float(head)), at + 1
    return Col(head.strip("`")), at + 1


def key(node: Node) -> str:
    """The gene's canonical prefix text; equal text means equal trees, constants included."""
    if isinstance(node, Call):
        return f"{node.name}({', '.join(key(a) for a in node.args)})"
    if isinstance(node, Const):
        return repr(node.value)
    return node.name if re.fullmatch(r"[A-Za-z_]\w*", node.name) else f"`{node.name}`"


def walk(node: Node) -> Iterator[Node]:
    """All sub-trees, the node itself first."""
    yield node
    if isinstance(node, Call):
        for a in node.args:
            yield from walk(a)


def size(node: Node) -> int:
    return sum(1 for _ in walk(node))


def height(node: Node) -> int:
    return 1 + max(height(a) for a in node.args) if isinstance(node, Call) else 0


def columns(node: Node) -> list[str]:
    """Names of the columns it reads, in order of appearance."""
    return list(dict.fromkeys(n.name for n in walk(node) if isinstance(n, Col)))


_INFIX = {"Add": "+", "Sub": "-", "Mul": "*"}


def formula(node: Node) -> str:
    """Infix text for people; functions without an operator sign are written as calls."""
    if isinstance(node, Call):
        args = [formula(a) for a in node.args]
        base = node.name.split("^")[0]
        if base in _INFIX:
            return "(" + f" {_INFIX[base]} ".join(args) + ")"
        if node.name == "Neg":
            return f"(-{args[0]})"
        return f"{node.name}({', '.join(args)})"
    return key(node)


def simplify(node: Node) -> Node:
    """Rewrites that keep the value for finite inputs: x-x, x*0, x*1, x+0, double negation, idempotent Max and Min."""
    if not isinstance(node, Call):
        return node
    args = tuple(simplify(a) for a in node.args)
    zero, one = Const(0.0), Const(1.0)
    if len(args) == 2:
        a, b = args
        if node.name == "Sub" and a == b:
            return zero
        if node.name == "Mul" and zero in args:
            return zero
        if node.name == "Mul" and one in args:
            return a if b == one else b
        if node.name == "Add" and zero in args:
            return a if b == zero else b
        if node.name == "Sub" and b == zero:
            return a
        if node.name in ("Max", "Min", "Mean", "GE2A", "LT2A") and a == b:
            return a
    if node.name == "Neg" and isinstance(args[0], Call) and args[0].name == "Neg":
        return args[0].args[0]
    return Call(node.name, args)

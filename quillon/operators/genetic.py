"""Genetic operators on genes: random trees, crossover, mutation, hoisting. They run on the driver and touch no data."""

from __future__ import annotations

import random
from collections.abc import Sequence

from quillon.functions.primitives import get_primitive
from quillon.plans.gene import Call, Col, Const, Node, height, key, walk


def constant(rnd: random.Random, kind: str = "float") -> Const:
    """int: -1, 0 or 1; float: uniform from -1 to 1; normal: standard normal."""
    return Const(float(rnd.choice((-1, 0, 1)) if kind == "int" else rnd.gauss(0, 1) if kind == "normal" else rnd.uniform(-1, 1)))


def random_tree(rnd: random.Random, columns: Sequence[str], primitives: Sequence[str], depth: int, full: bool = False, constants: float = 0.1) -> Node:
    """A tree of at most `depth` levels of calls; `full` ones reach it on every branch."""
    if depth == 0 or (not full and rnd.random() < 0.2):
        return constant(rnd) if rnd.random() < constants else Col(rnd.choice(list(columns)))
    p = get_primitive(rnd.choice(list(primitives)))
    return Call(p.name, tuple(random_tree(rnd, columns, primitives, depth - 1, full, constants) for _ in range(p.arity)))


def half_and_half(rnd: random.Random, columns: Sequence[str], primitives: Sequence[str], low: int, high: int) -> Node:
    """Full or growing, of a depth from low to high."""
    return random_tree(rnd, columns, primitives, rnd.randint(low, high), rnd.random() < 0.5)


def replace(node: Node, at: int, new: Node) -> Node:
    """The tree with its at-th sub-tree, in prefix order, replaced."""
    count = -1

    def go(x: Node) -> Node:
        nonlocal count
        count += 1
        if count == at:
            count += sum(1 for _ in walk(x)) - 1
            return new
        return Call(x.name, tuple(go(a) for a in x.args)) if isinstance(x, Call) else x

    return go(node)


def crossover(rnd: random.Random, a: Node, b: Node, limit: int = 10) -> tuple[Node, Node]:
    """Random sub-trees exchanged; a child higher than the limit gives way to its parent."""
    parts_a, parts_b = list(walk(a)), list(walk(b))
    i, j = rnd.randrange(len(parts_a)), rnd.randrange(len(parts_b))
    one, two = replace(a, i, parts_b[j]), replace(b, j, parts_a[i])
    return (one if height(one) <= limit else a), (two if height(two) <= limit else b)


def mutate(rnd: random.Random, node: Node, columns: Sequence[str], primitives: Sequence[str], limit: int = 10) -> Node:
    """A random sub-tree replaced by a new one."""
    new = replace(node, rnd.randrange(sum(1 for _ in walk(node))), half_and_half(rnd, columns, primitives, 0, 2))
    return new if height(new) <= limit else node


def insert(rnd: random.Random, node: Node, columns: Sequence[str], primitives: Sequence[str], limit: int = 10) -> Node:
    """A primitive put above a random sub-tree, its other arguments columns."""
    parts = list(walk(node))
    at = rnd.randrange(len(parts))
    p = get_primitive(rnd.choice(list(primitives)))
    args = [Col(rnd.choice(list(columns))) for _ in range(p.arity)]
    args[rnd.randrange(p.arity)] = parts[at]
    new = replace(node, at, Call(p.name, tuple(args)))
    return new if height(new) <= limit else node


def hoist(rnd: random.Random, node: Node) -> Node:
    """A random sub-tree in the tree's place."""
    return rnd.choice(list(walk(node)))


def prune(node: Node, depth: int) -> Node:
    """The tree cut to a depth; a call at the edge becomes the first column below it, or 1."""
    if depth == 0 and isinstance(node, Call):
        return next((n for n in walk(node) if isinstance(n, Col)), Const(1.0))
    return Call(node.name, tuple(prune(a, depth - 1) for a in node.args)) if isinstance(node, Call) else node


def distinct(genes: Sequence[Node]) -> list[Node]:
    """The genes without syntactic repeats, in order."""
    return list({key(g): g for g in genes}.values())

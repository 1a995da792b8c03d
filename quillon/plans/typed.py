"""Typed genes with learnt parameters: scalers, encoders, group statistics and smooth operators as nodes of a gene.

Types: `number`, `category` (text) and `layer` (several columns, allowed at a gene's root only). A plan is fitted on
training rows and then applied to any rows: a learnt node's parameters are constants of the plan, so a fitted plan is
one projection without joins.

Nodes are fitted by depth, for all genes of a population together: equal calls once, and everything that one depth has
to learn in one aggregate, plus one grouped aggregate where group statistics are among it. What is learnt is bounded:
landmarks and bins in number, categories up to MAX_CATEGORIES, beyond which fitting is an error.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.primitives import get_primitive, sanitise
from quillon.plans.gene import Call, Col, Const, Node, key, parse, walk

#: Quantiles that a quantile transformer, a binning or a smooth operator keeps at most.
LANDMARKS = 1000
MAX_CATEGORIES = 10_000
#: Accuracy of approximate quantiles; fewer distinct values than this have exact ones.
ACCURACY = 10 * LANDMARKS

GROUPS = {"groupby_mean": "mean", "groupby_median": "median", "groupby_min": "min", "groupby_max": "max", "groupby_count": "n"}
#: Smooth operators: the primitive that each applies before its value is moved to the nearest one learnt.
SMOOTH = {"Add": 2, "Sub": 2, "Mul": 2, "Div": 2, "Sqrt": 1, "Sqrt-Signed": 1, "Log": 1, "SinPi": 1, "CosPi": 1, "Abs": 1, "Sigmoid": 1, "Square": 1, "Min": 2, "Max": 2, "Neg": 1, "AQ": 2, "ALog": 1, "ALog-Signed": 1}
#: Argument types and result type of the nodes that are no plain primitives.
SIGNATURES: dict[str, tuple[tuple[str, ...], str]] = {
    "standardize": (("number",), "number"),
    "min_max_scaler": (("number",), "number"),
    "robust_scaler": (("number",), "number"),
    "gaussian_quantile_transformer": (("number",), "number"),
    "normal_quantile_transformer": (("number",), "number"),
    "clip": (("number", "number", "number"), "number"),
    "binning": (("number",), "category"),
    **{g: (("category", "number"), "number") for g in GROUPS},
    "binary_feature_cross": (("category", "category"), "category"),
    "triple_feature_cross": (("category", "category", "category"), "layer"),
    "onehot_encoding": (("category",), "layer"),
    "binary_encoding": (("category",), "layer"),
    "ordinal_encoding": (("category",), "layer"),
    "identity": (("number",), "layer"),
    **{f"Smooth-{n}": (("number",) * arity, "number") for n, arity in SMOOTH.items()},
}
_LEARNT = set(SIGNATURES) - {"clip", "identity", "binary_feature_cross"}
_ARITIES = {n: len(a) for n, (a, _) in SIGNATURES.items()}


def read(text: str, categories: Sequence[str] = ()) -> Node:
    """A typed gene from prefix text; types are checked. categories: the columns that are categories, others are numbers."""
    node = parse(text, _ARITIES)
    type_of(node, set(categories))
    return node


def type_of(node: Node, categories: set[str], root: bool = True) -> str:
    """The node's type; a mistyped argument, or a layer below the root, is an error."""
    if isinstance(node, Const):
        return "number"
    if isinstance(node, Col):
        return "category" if node.name in categories else "number"
    takes, gives = SIGNATURES.get(node.name, (("number",) * len(node.args), "number"))
    for a, want in zip(node.args, takes, strict=True):
        got = type_of(a, categories, False)
        if got != want:
            raise ValueError(f"{node.name} takes a {want}, not the {got} {key(a)}")
    if gives == "layer" and not root:
        raise ValueError(f"{node.name} gives a layer, which no other node takes")
    return gives


def learnt_depth(node: Node) -> int:
    """How many learnt nodes lie on the longest way down from the node, itself included."""
    if not isinstance(node, Call):
        return 0
    return max((learnt_depth(a) for a in node.args), default=0) + (node.name in _LEARNT)


@dataclass
class TypedPlan:
    """Genes with all they have learnt, by the text of the learnt call."""

    genes: list[Node]
    categories: tuple[str, ...]
    learnt: dict[str, dict]

    def columns(self, gene: int) -> list[Column]:
        """The sanitised columns of a gene: one, or those of its layer."""
        node = self.genes[gene]
        if type_of(node, set(self.categories)) == "layer":
            return [_clean(c) for c in _layer(node, self.learnt)]
        out = _value(node, self.learnt, set(self.categories))
        return [out if type_of(node, set(self.categories)) == "category" else _clean(out)]

    def transform(self, df: DataFrame, keep: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
        """The columns `keep` and the genes' columns: g0, g1, ... unless named; a layer's are g0_0, g0_1, ..."""
        out = [F.col(f"`{k}`") for k in keep]
        for i, name in enumerate(names or [f"g{i}" for i in range(len(self.genes))]):
            parts = self.columns(i)
            layer = type_of(self.genes[i], set(self.categories)) == "layer"
            out += [c.alias(f"{name}_{j}" if layer else name) for j, c in enumerate(parts)]
        return df.select(*out)

    def to_dict(self) -> dict:
        return {"genes": [key(g) for g in self.genes], "categories": list(self.categories), "learnt": self.learnt}

    @classmethod
    def from_dict(cls, data: Mapping) -> TypedPlan:
        return cls([read(g, data["categories"]) for g in data["genes"]], tuple(data["categories"]), dict(data["learnt"]))


def fit(df: DataFrame, genes: Sequence[Node | str], categories: Sequence[str] = ()) -> TypedPlan:
    """Learn the parameters of all genes from the rows of df.

    NaN, infinite and null numbers count as 0, as at a gene's root; null categories are none. Quantiles are approximate
    beyond ACCURACY distinct values. A table without rows gives scalers that change nothing, and no category is known.
    """
    trees = [read(g, categories) if isinstance(g, str) else g for g in genes]
    calls = {key(n): n for t in trees for n in walk(t) if isinstance(n, Call) and n.name in _LEARNT}
    plan = TypedPlan(trees, tuple(categories), {})
    for depth in range(1, max((learnt_depth(c) for c in calls.values()), default=0) + 1):
        _learn(df, {t: c for t, c in calls.items() if learnt_depth(c) == depth}, plan)
    return plan


def _learn(df: DataFrame, calls: dict[str, Call], plan: TypedPlan) -> None:
    """The parameters of the calls of one depth, whose arguments' parameters are known."""
    kinds, stats, groups = set(plan.categories), [F.count(F.lit(1)).alias("rows")], []
    for i, call in enumerate(calls.values()):
        args = [_value(a, plan.learnt, kinds) for a in call.args]
        x = _clean(args[0]) if SIGNATURES[call.name][0][0] == "number" else args[0]
        if call.name in GROUPS:
            groups.append(F.struct(F.lit(i).alias("call"), args[0].cast("string").alias("key"), _clean(args[1]).alias("value")))
            stats += [F.avg(_clean(args[1])).alias(f"a{i}")]
        elif call.name == "standardize":
            stats += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        elif call.name == "min_max_scaler":
            stats += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
        elif call.name == "robust_scaler":
            stats.append(F.percentile_approx(x, F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75))), F.lit(ACCURACY)).alias(f"a{i}"))
        elif call.name in ("onehot_encoding", "binary_encoding", "ordinal_encoding"):
            stats.append(F.collect_set(args[0].cast("string")).alias(f"a{i}"))
        elif call.name == "triple_feature_cross":
            stats.append(F.collect_set(_crossed(args)).alias(f"a{i}"))
        else:
            value = _clean(get_primitive(call.name[7:]).build(*args)) if call.name.startswith("Smooth-") else x
            stats.append(F.percentile_approx(value, F.array(*(F.lit(k / LANDMARKS) for k in range(LANDMARKS + 1))), F.lit(ACCURACY)).alias(f"a{i}"))
    row = df.agg(*stats).first()
    tables: dict[int, dict[str, dict]] = {}
    if groups:
        cells = df.select(F.explode(F.array(*groups)).alias("c")).select("c.*").where("key IS NOT NULL")
        found = cells.groupBy("call", "key").agg(F.avg("value").alias("mean"), F.percentile_approx("value", F.lit(0.5), F.lit(ACCURACY)).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).cast("double").alias("n"))
        found = found.limit(MAX_CATEGORIES * len(groups) + 1).collect()
        if len(found) > MAX_CATEGORIES * len(groups):
            raise ValueError(f"more than {MAX_CATEGORIES} groups")
        for r in found:
            tables.setdefault(r["call"], {})[r["key"]] = r.asDict()
    for i, (text, call) in enumerate(calls.items()):
        if call.name in GROUPS:
            stat = GROUPS[call.name]
            table = {k: r[stat] for k, r in sorted(tables.get(i, {}).items())}
            plan.learnt[text] = {"table": table, "unseen": 0.0 if stat == "n" else row[f"a{i}"] or 0.0}
        elif call.name == "standardize":
            plan.learnt[text] = {"shift": row[f"a{i}"] or 0.0, "scale": row[f"b{i}"] or 1.0}
        elif call.name == "min_max_scaler":
            low, high = row[f"a{i}"] or 0.0, row[f"b{i}"] or 0.0
            plan.learnt[text] = {"shift": low, "scale": (high - low) or 1.0}
        elif call.name == "robust_scaler":
            low, middle, high = row[f"a{i}"] or (0.0, 0.0, 1.0)
            plan.learnt[text] = {"shift": middle, "scale": (high - low) or 1.0}
        elif call.name.endswith("_encoding") or call.name == "triple_feature_cross":
            names = sorted(row[f"a{i}"] or [])
            if len(names) > MAX_CATEGORIES:
                raise ValueError(f"more than {MAX_CATEGORIES} categories in {text}")
            plan.learnt[text] = {"names": names}
        else:
            marks = [float(v) for v in row[f"a{i}"] or []]
            if call.name == "binning":
                bins = min(LANDMARKS, max(1, math.ceil(math.sqrt(row["rows"]))))
                marks = sorted({marks[round(k * LANDMARKS / bins)] for k in range(1, bins)}) if marks else []
            elif call.name.startswith("Smooth-"):
                marks = sorted(set(marks))
            plan.learnt[text] = {"marks": marks}


def _let(value: Column, body) -> Column:
    """body(value), where value stands once in the expression however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _clean(value: Column) -> Column:
    return _let(value, sanitise)


def _numbers(values: Sequence[float]) -> Column:
    """An array of numbers as one constant."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def _strings(values: Sequence[str]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def _crossed(args: Sequence[Column]) -> Column:
    """Categories joined by _; null where one is."""
    whole = F.concat_ws("_", *(a.cast("string") for a in args))
    known = args[0].isNotNull()
    for a in args[1:]:
        known &= a.isNotNull()
    return F.when(known, whole)


def _numbered(value: Column, names: Sequence[str]) -> Column:
    """The place of a category among the learnt ones, from 0; -1 for others."""
    if not names:
        return F.lit(-1)
    return F.coalesce(F.array_position(_strings(names), value.cast("string")), F.lit(0)).cast("int") - 1


def _count_below(x: Column, marks: Column, n: int, equal: bool) -> Column:
    """How many of n ascending marks are less than x, or not greater; by bisection."""

    def step(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.floor((low + high) / 2).cast("int")
        mark = F.get(marks, middle)
        right = (low < high) & ((mark <= x) if equal else (mark < x))
        return F.struct(F.when(right, middle + 1).otherwise(low).alias("low"), F.when(right | (low >= high), high).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), start, step, lambda s: s["low"])


def _quantile(x: Column, marks: list[float], normal: bool) -> Column:
    """The share of training values below x, between the landmarks by straight lines, in the middle where several equal x."""
    n, at = len(marks) - 1, _numbers(marks)

    def share(k: Column) -> Column:
        less, upto = k["less"], k["upto"]
        inside = F.when(less == 0, F.lit(0.0)).when(less > n, F.lit(1.0)).otherwise((less - 1 + (x - k["a"]) / (k["b"] - k["a"])) / F.lit(float(n)))
        return F.when(upto > less, (less + upto - 1) / F.lit(2.0 * n)).otherwise(inside)

    counts = F.struct(_count_below(x, at, n + 1, False).alias("less"), _count_below(x, at, n + 1, True).alias("upto"))
    ends = lambda c: F.struct(c["less"].alias("less"), c["upto"].alias("upto"), F.get(at, c["less"] - 1).alias("a"), F.get(at, c["less"]).alias("b"))
    out = _let(_let(counts, ends), share)
    return _let(F.least(F.greatest(out, F.lit(1e-7)), F.lit(1 - 1e-7)), _normal_quantile) if normal else out


def _normal_quantile(p: Column) -> Column:
    """The standard normal value below which a share p lies: two Newton steps from a rational start.

    The distribution function is a continued fraction in the tail and a series near the middle, both far within 1e-9.
    """
    low = F.least(p, 1 - p)
    # fixed values: Hastings' rational approximation of the normal quantile
    start = lambda t: t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    z = _let(F.sqrt(-2 * F.log(low)), start)
    for _ in range(2):
        z = _let(z, lambda v: v + (_tail(v) - low) / _density(v))
    return _let(z, lambda v: F.when(p < 0.5, -v).otherwise(v))


def _density(z: Column) -> Column:
    return F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi))


def _tail(z: Column) -> Column:
    """The share above z, for z >= 0."""
    far = F.lit(0.0)
    for k in range(40, 0, -1):
        far = F.lit(float(k)) / (z + far)
    near = F.lit(1.0)
    for k in range(29, 0, -1):
        near = 1 + near * z * z / F.lit(2 * k + 1.0)
    near = z * near
    return F.when(z > 2.2, _density(z) / (z + far)).otherwise(F.lit(0.5) - _density(z) * near)


def _value(node: Node, learnt: Mapping[str, dict], categories: set[str]) -> Column:
    """The column of a node that gives a number or a category."""
    if isinstance(node, Const):
        return F.lit(node.value)
    if isinstance(node, Col):
        return F.col(f"`{node.name}`").cast("string" if node.name in categories else "double")
    args = [_value(a, learnt, categories) for a in node.args]
    own = learnt.get(key(node), {})
    if node.name == "clip":
        return F.least(F.greatest(args[0], args[1]), args[2])
    if node.name == "binary_feature_cross":
        return _crossed(args)
    if node.name in ("standardize", "min_max_scaler", "robust_scaler"):
        return (_clean(args[0]) - F.lit(own["shift"])) / F.lit(own["scale"])
    if node.name.endswith("quantile_transformer"):
        marks = own["marks"]
        return _let(_clean(args[0]), lambda x: _quantile(x, marks, node.name.startswith("normal"))) if marks else F.lit(0.0)
    if node.name == "binning":
        marks = own["marks"]
        code = _let(_clean(args[0]), lambda x: _count_below(x, _numbers(marks), len(marks), True)) if marks else F.lit(0)
        return code.cast("string")
    if node.name in GROUPS:
        names = list(own["table"])
        return F.coalesce(F.get(_numbers(own["table"].values()), _numbered(args[0], names)), F.lit(own["unseen"])) if names else F.lit(own["unseen"])
    if node.name.startswith("Smooth-"):
        value, marks = _clean(get_primitive(node.name[7:]).build(*args)), own["marks"]
        return _let(value, lambda x: _nearest(x, marks)) if marks else value
    return get_primitive(node.name).build(*args)


def _nearest(x: Column, marks: list[float]) -> Column:
    """The learnt value nearest to x; of two as near, the smaller."""
    at, n = _numbers(marks), len(marks)
    ends = _let(_count_below(x, at, n, False), lambda k: F.struct(F.get(at, k - 1).alias("below"), F.get(at, k).alias("above")))
    return _let(ends, lambda e: F.when(e["below"].isNull() | (e["above"] - x < x - e["below"]), e["above"]).otherwise(e["below"]))


def _layer(node: Node, learnt: Mapping[str, dict]) -> list[Column]:
    """The columns of a node that gives a layer."""
    if node.name == "identity":
        return [_value(node.args[0], learnt, _categories_below(node))]
    names = learnt[key(node)]["names"]
    args = [_value(a, learnt, _categories_below(node)) for a in node.args]
    place = _numbered(_crossed(args) if node.name == "triple_feature_cross" else args[0], names)
    if node.name == "ordinal_encoding":
        return [place.cast("double")]
    if node.name == "onehot_encoding":
        return [(place == k).cast("double") for k in range(len(names))]
    bits = max(1, math.ceil(math.log2(len(names) + 1)))  # an unknown category has all bits set
    return [F.expr("0.0D") + place.bitwiseAND(F.lit(1 << b)).cast("boolean").cast("double") for b in reversed(range(bits))]


def _categories_below(node: Node) -> set[str]:
    """The columns below a checked node that must be categories, by what takes them."""
    out: set[str] = set()
    for n in walk(node):
        if isinstance(n, Call):
            takes = SIGNATURES.get(n.name, (("number",) * len(n.args), ""))[0]
            out |= {a.name for a, t in zip(n.args, takes, strict=True) if isinstance(a, Col) and t == "category"}
    return out

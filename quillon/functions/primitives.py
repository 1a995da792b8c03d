"""The expression language: scalar and group-by primitives as Spark columns.

Every primitive is a function of columns of type double. Values follow IEEE arithmetic: where Spark would raise on a
division by zero, give null for a logarithm, or order NaN differently, the expression says what is meant. A gene's
result is sanitised at its root only (NaN, infinities and nulls become 0); inner values keep NaN and infinities.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the protected operations.
DIV_EPS, DIV_SHIFT, NEAR_ZERO, LOG_FLOOR, EXP_CAP, LEAK = 1e-10, 1e-6, 1e-6, 1e-10, 1e6, 0.01


@dataclass(frozen=True)
class Primitive:
    """name, number of arguments, and the column it makes of them."""

    name: str
    arity: int
    build: Callable[..., Column]


REGISTRY: dict[str, Primitive] = {}


def register_primitive(name: str, arity: int, build: Callable[..., Column]) -> Primitive:
    """Add a primitive of one's own: build takes `arity` columns and gives a column."""
    if arity < 1:
        raise ValueError("a primitive takes one argument at least")
    REGISTRY[name] = Primitive(name, arity, build)
    return REGISTRY[name]


def get_primitive(name: str) -> Primitive:
    try:
        return REGISTRY[name]
    except KeyError:
        raise ValueError(f"unknown primitive {name!r}") from None


def sanitise(value: Column) -> Column:
    """NaN, infinities and nulls as 0."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(v)


def sanitise_float32(value: Column) -> Column:
    """sanitise(), and the rest cut to the range of 32-bit floats."""
    most = F.lit(3.4028234663852886e38)
    return F.greatest(F.least(sanitise(value), most), -most)


def _nan() -> Column:
    return F.lit(float("nan"))


def _inf() -> Column:
    return F.lit(float("inf"))


def _sign(x: Column) -> Column:
    return F.signum(x)


def _ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).when(x == 0, -_inf()).otherwise(_nan())


def _divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), _nan()).otherwise(_sign(a) * _inf())).otherwise(F.try_divide(a, b))


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.when(b >= 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.sqrt(b * b + F.lit(DIV_EPS)))


def _aq(a: Column, b: Column) -> Column:
    return a / F.sqrt(F.lit(1.0) + b * b)


def _min(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), _nan()).otherwise(F.least(a, b))


def _max(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _eq(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a)


def _ge(a: Column, b: Column) -> Column:
    return (a >= b) & ~F.isnan(a) & ~F.isnan(b)


def _lt(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _pick(c: Column, yes: Column, no: Column) -> Column:
    return F.when(c, yes).otherwise(no)


def _log_protected(a: Column, log: Callable[[Column], Column]) -> Column:
    return F.when(F.abs(a) > NEAR_ZERO, log(F.abs(a))).otherwise(F.lit(0.0))


def _log_xy(a: Column, b: Column) -> Column:
    top, base = F.ln(F.abs(a)), F.ln(F.abs(b))
    edge = F.when(F.abs(a) == 1, _nan()).otherwise(_sign(top) * _inf())
    return F.when(F.abs(a) > NEAR_ZERO, F.when(b == 0, top / -_inf()).when(F.abs(b) == 1, edge).otherwise(F.try_divide(top, base))).otherwise(F.lit(0.0))


def _capped_exp(e: Column) -> Column:
    return F.when((e < EXP_CAP) & ~F.isnan(e), e).otherwise(F.lit(1.0))


def _root(a: Column) -> Column:
    return F.sqrt(F.lit(1.0) + a * a)


def _fold(step: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda *args: reduce(step, args)


_PAIRS: dict[str, Callable[[Column, Column], Column]] = {
    "Add": lambda a, b: a + b,
    "Sub": lambda a, b: a - b,
    "Mul": lambda a, b: a * b,
    "Max": _max,
    "Min": _min,
    "Div": _div,
    "AQ": _aq,
}
for _name, _step in _PAIRS.items():
    register_primitive(_name, 2, _step)
    for _n in (3, 4, 5):
        register_primitive(f"{_name}^{_n}", _n, _fold(_step))

_TWO = {
    "Div-O": _divide,
    "Div-S": lambda a, b: _divide(a, b + _sign(b) * F.lit(DIV_SHIFT)),
    "AQ-Signed": lambda a, b: _aq(a, b) * _sign(b),
    "LogXY": _log_xy,
    "Equal": lambda a, b: _flag(_eq(a, b)),
    "NotEqual": lambda a, b: _flag(~_eq(a, b)),
    "GE": lambda a, b: _flag(_ge(a, b)),
    "LE": lambda a, b: _flag(_ge(b, a)),
    "GE2A": lambda a, b: _pick(_ge(a, b), a, b),
    "GE2B": lambda a, b: _pick(_ge(a, b), a + b, a - b),
    "GE2C": lambda a, b: _pick(_ge(a, b), a + b, a * b),
    "LT2A": lambda a, b: _pick(_lt(a, b), a, b),
    "LT2B": lambda a, b: _pick(_lt(a, b), a + b, a - b),
    "LT2C": lambda a, b: _pick(_lt(a, b), a + b, a * b),
    "Mean": lambda a, b: (a + b) / F.lit(2.0),
    "ArgMax": lambda a, b: _flag(~_ge(a, b)),
    "ArgMin": lambda a, b: _flag(~_ge(b, a)),
    "GaussianKernel": lambda a, b: F.exp(-(a - b) * (a - b) / F.lit(2.0)),
    "ExponentialKernel": lambda a, b: F.exp(-F.abs(a - b)),
}
for _name, _step in _TWO.items():
    register_primitive(_name, 2, _step)

_ONE = {
    "Sqrt": lambda a: F.sqrt(F.abs(a)),
    "Sqrt-O": lambda a: F.sqrt(a),
    "Sqrt-Signed": lambda a: F.sqrt(F.abs(a)) * _sign(a),
    "Log": lambda a: _ln(F.abs(a)),
    "ALog": lambda a: F.ln(_root(a)),
    "ALog-Signed": lambda a: F.ln(_root(a)) * _sign(a),
    "AbsLog": lambda a: F.ln(F.lit(1.0) + F.abs(a)),
    "AbsLog-Signed": lambda a: F.ln(F.lit(1.0) + F.abs(a)) * _sign(a),
    "Log-O": _ln,
    "Log-C": lambda a: F.ln(F.greatest(F.abs(a), F.lit(LOG_FLOOR))),
    "Log-C-Signed": lambda a: F.ln(F.greatest(F.abs(a), F.lit(LOG_FLOOR))),  # the sign is taken after the clip: always +
    "ALog10": lambda a: F.log10(_root(a)),
    "Sin": F.sin,
    "Cos": F.cos,
    "RSin": lambda a: F.sin(F.lit(math.pi) * a),
    "RCos": lambda a: F.cos(F.lit(math.pi) * a),
    "SinPi": lambda a: F.sin(F.lit(math.pi) * a),
    "CosPi": lambda a: F.cos(F.lit(math.pi) * a),
    "DSin": lambda a: F.sin(F.radians(a)),
    "DCos": lambda a: F.cos(F.radians(a)),
    "Arcsin": F.asin,
    "Arccos": F.acos,
    "Arctan": F.atan,
    "Tanh": F.tanh,
    "Cbrt": F.cbrt,
    "Square": lambda a: a * a,
    "Square-Signed": lambda a: a * a * _sign(a),
    "Cube": lambda a: a * a * a,
    "FourthPower": lambda a: a * a * a * a,
    "FifthPower": lambda a: a * a * a * a * a,
    "Log2": lambda a: _log_protected(a, F.log2),
    "Log10": lambda a: _log_protected(a, F.log10),
    "Exp2": lambda a: _capped_exp(F.pow(F.lit(2.0), a)),
    "Exp": lambda a: _capped_exp(F.exp(a)),
    "Inv": lambda a: F.when(F.abs(a) > NEAR_ZERO, F.try_divide(F.lit(1.0), a)).otherwise(F.lit(0.0)),
    "Abs": F.abs,
    "Neg": lambda a: -a,
    "Sigmoid": lambda a: F.lit(1.0) / (F.lit(1.0) + F.exp(-a)),
    "Round": F.rint,
    "Floor": lambda a: F.floor(a).cast("double"),
    "Ceil": lambda a: F.ceil(a).cast("double"),
    "Residual": lambda a: a - F.floor(a).cast("double"),
    "Relu": lambda a: F.greatest(F.lit(0.0), a),
    "Gaussian": lambda a: F.exp(-a * a / F.lit(2.0)),
    "LeakyRelu": lambda a: F.when(a > 0, a).otherwise(F.lit(LEAK) * a),
}
for _name, _step in _ONE.items():
    register_primitive(_name, 1, _step)

_MORE = {
    "GE3A": (3, lambda a, b, c: _pick(_ge(a, F.lit(0.0)), b, c)),
    "GE3B": (3, lambda a, b, c: _pick(_ge(a, F.lit(0.0)), b + c, b - c)),
    "GE3C": (3, lambda a, b, c: _pick(_ge(a, F.lit(0.0)), b + c, b * c)),
    "GE4A": (4, lambda a, b, c, d: _pick(_ge(a, b), c, d)),
    "GE4B": (4, lambda a, b, c, d: _pick(_ge(a, b), c + d, c - d)),
    "GE4C": (4, lambda a, b, c, d: _pick(_ge(a, b), c + d, c * d)),
    "LT4A": (4, lambda a, b, c, d: _pick(_lt(a, b), c, d)),
    "LT4B": (4, lambda a, b, c, d: _pick(_lt(a, b), c + d, c - d)),
    "LT4C": (4, lambda a, b, c, d: _pick(_lt(a, b), c + d, c * d)),
    # not in the default set, but part of presets and helpers
    "GE3D": (3, lambda a, b, c: _pick(_ge(a + b, c), a + b, c)),
    "GE3E": (3, lambda a, b, c: _pick(_ge(a + b, c), a + b, a + c)),
    "GE3F": (3, lambda a, b, c: _pick(_ge(a + b, c), a + b, a * c)),
    "AndA": (2, lambda a, b: _flag(_ge(a, F.lit(0.0)) & _ge(b, F.lit(0.0)))),
    "AndB": (2, lambda a, b: _flag(_lt(a, F.lit(0.0)) & _lt(b, F.lit(0.0)))),
    "OrA": (2, lambda a, b: _flag(_ge(a, F.lit(0.0)) | _ge(b, F.lit(0.0)))),
    "OrB": (2, lambda a, b: _flag(_lt(a, F.lit(0.0)) | _lt(b, F.lit(0.0)))),
    "If": (3, lambda a, b, c: _pick(_lt(F.lit(0.0), a), b, c)),
    "Greater": (2, lambda a, b: _flag(_lt(b, a))),
    "Less": (2, lambda a, b: _flag(_lt(a, b))),
    "BitAnd": (2, lambda a, b: a.cast("long").bitwiseAND(b.cast("long")).cast("double")),
    "BitOr": (2, lambda a, b: a.cast("long").bitwiseOR(b.cast("long")).cast("double")),
    "BitXor": (2, lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")).cast("double")),
    "LogE": (1, lambda a: _log_protected(a, F.ln)),
}
for _name, (_n, _step) in _MORE.items():
    register_primitive(_name, _n, _step)

#: Primitives over groups of the first argument; plans.compiler turns them into windows or fitted lookups.
GROUP_PRIMITIVES = {"GroupByMean": 2, "GroupByMedian": 2, "GroupByMax": 2, "GroupByMin": 2, "GroupByCount": 1, "GroupByVar": 2}

#: Named sets of primitives.
PRESETS = {
    "default": ("Add", "Sub", "Mul", "AQ"),
    "optimal": ("Add", "Sub", "Mul", "AQ", "Sqrt", "Sin", "Cos", "Max", "Min", "Neg"),
    "CDFC": ("Add", "Sub", "Mul", "AQ", "Max", "If"),
}


def preset(text: str) -> tuple[str, ...]:
    """Primitive names for a setting: a named set, a comma-separated list of names, and otherwise the default four."""
    if text in PRESETS:
        return PRESETS[text]
    if "optimal" in text:
        return PRESETS["optimal"]
    names = tuple(n.strip() for n in text.split(","))
    return names if len(names) > 1 and all(n in REGISTRY or n in GROUP_PRIMITIVES for n in names) else PRESETS["default"]

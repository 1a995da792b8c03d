"""The queries of the feature-construction operators, and the SQL that says the same.

Floating results are rounded on both sides, as engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.estimator import FeatureForest
from quillon.functions.primitives import get_primitive, sanitise
from quillon.operators import complexity, coresets, encoding, ensemble, importance, information, knn, learners, linear, linear_tree, local_models, metrics, ordered, pair_distances, pair_metric, pareto, retrieval, sampling, scaling, selection, subsets, timeseries, voronoi
from quillon.plans import compiler, typed
from quillon.sources.scratch import scratch_path
from quillon.streaming import decayed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    y = F.round(x.cast("double"), digits)
    return F.when(y == 0, F.lit(0.0)).otherwise(y)


def _q(x: str, digits: int = 6) -> str:
    return f"CASE WHEN round(CAST({x} AS DOUBLE), {digits}) = 0 THEN 0.0 ELSE round(CAST({x} AS DOUBLE), {digits}) END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


# --- primitives -------------------------------------------------------------------------------------------------

#: Operands with signs, zeros and whole numbers, of no few-digit decimals.
_OPERANDS = {"a": "c_acctbal * 0.00073137", "b": "CAST(c_custkey % 7 AS DOUBLE) - 3.0", "c": "CAST(c_nationkey AS DOUBLE) * 0.3171 - 3.9", "d": "CAST(c_custkey % 5 AS DOUBLE) - 1.7"}
_G = "CASE WHEN {a} >= {b} THEN"
_DIV = "({a}) / (CASE WHEN ({b}) >= 0 THEN 1.0 ELSE -1.0 END * sqrt(({b}) * ({b}) + 1e-10))"
_AQ = "({a}) / sqrt(1.0 + ({b}) * ({b}))"
#: What each primitive is in DuckDB, whose arithmetic follows IEEE.
_SQL = {
    "arithmetic": {"Add": "a + b", "Sub": "a - b", "Mul": "a * b", "Mean": "(a + b) / 2.0", "Neg": "-a", "Abs": "abs(a)", "Add^3": "a + b + c", "Add^4": "a + b + c + d", "Add^5": "a + b + c + d + a", "Sub^3": "a - b - c", "Sub^4": "a - b - c - d", "Sub^5": "a - b - c - d - a", "Mul^3": "a * b * c", "Mul^4": "a * b * c * d", "Mul^5": "a * b * c * d * a"},
    "division": {"Div": _DIV.format(a="a", b="b"), "Div-O": "a / b", "Div-S": "a / (b + sign(b) * 1e-6)", "AQ": _AQ.format(a="a", b="b"), "AQ-Signed": f"{_AQ.format(a='a', b='b')} * sign(b)", "AQ^3": _AQ.format(a=_AQ.format(a="a", b="b"), b="c"), "AQ^4": _AQ.format(a=_AQ.format(a=_AQ.format(a="a", b="b"), b="c"), b="d"), "AQ^5": _AQ.format(a=_AQ.format(a=_AQ.format(a=_AQ.format(a="a", b="b"), b="c"), b="d"), b="a"), "Div^3": _DIV.format(a=_DIV.format(a="a", b="c"), b="d"), "Div^4": _DIV.format(a=_DIV.format(a=_DIV.format(a="a", b="c"), b="d"), b="c"), "Div^5": _DIV.format(a=_DIV.format(a=_DIV.format(a=_DIV.format(a="a", b="c"), b="d"), b="c"), b="d"), "Inv": "CASE WHEN abs(a) > 1e-6 THEN 1.0 / a ELSE 0.0 END"},
    "logs": {"Log": "ln(abs(b))", "ALog": "ln(sqrt(1.0 + a * a))", "ALog-Signed": "ln(sqrt(1.0 + a * a)) * sign(a)", "AbsLog": "ln(1.0 + abs(a))", "AbsLog-Signed": "ln(1.0 + abs(a)) * sign(a)", "Log-O": "ln(b)", "Log-C": "ln(greatest(abs(b), 1e-10))", "Log-C-Signed": "ln(greatest(abs(b), 1e-10))", "ALog10": "log10(sqrt(1.0 + a * a))", "LogXY": "CASE WHEN abs(a) > 1e-6 THEN ln(abs(a)) / ln(abs(b)) ELSE 0.0 END", "Log2": "CASE WHEN abs(b) > 1e-6 THEN log2(abs(b)) ELSE 0.0 END", "Log10": "CASE WHEN abs(b) > 1e-6 THEN log10(abs(b)) ELSE 0.0 END", "LogE": "CASE WHEN abs(b) > 1e-6 THEN ln(abs(b)) ELSE 0.0 END"},
    "trigonometry": {"Sin": "sin(a)", "Cos": "cos(a)", "RSin": "sin(pi() * a)", "RCos": "cos(pi() * a)", "SinPi": "sin(pi() * c)", "CosPi": "cos(pi() * c)", "DSin": "sin(radians(a))", "DCos": "cos(radians(a))", "Arcsin": "CASE WHEN abs(c) <= 1 THEN asin(c) ELSE 'nan'::DOUBLE END", "Arccos": "CASE WHEN abs(c) <= 1 THEN acos(c) ELSE 'nan'::DOUBLE END", "Arctan": "atan(a)", "Tanh": "tanh(c)"},
    "powers": {"Sqrt": "sqrt(abs(a))", "Sqrt-O": "CASE WHEN a >= 0 THEN sqrt(a) ELSE 'nan'::DOUBLE END", "Sqrt-Signed": "sqrt(abs(a)) * sign(a)", "Cbrt": "cbrt(a)", "Square": "a * a", "Square-Signed": "a * a * sign(a)", "Cube": "a * a * a", "FourthPower": "a * a * a * a", "FifthPower": "a * a * a * a * a", "Exp2": "CASE WHEN pow(2.0, a) < 1e6 THEN pow(2.0, a) ELSE 1.0 END", "Exp": "CASE WHEN exp(a) < 1e6 THEN exp(a) ELSE 1.0 END"},
    "rounding": {"Round": "round_even(c, 0)", "Floor": "floor(a)", "Ceil": "ceil(a)", "Residual": "a - floor(a)"},
    "comparison": {"Equal": "CASE WHEN b = d + 0.7 THEN 1.0 ELSE 0.0 END", "NotEqual": "CASE WHEN a <> b THEN 1.0 ELSE 0.0 END", "GE": "CASE WHEN a >= b THEN 1.0 ELSE 0.0 END", "LE": "CASE WHEN a <= b THEN 1.0 ELSE 0.0 END", "ArgMax": "CASE WHEN a >= b THEN 0.0 ELSE 1.0 END", "ArgMin": "CASE WHEN a <= b THEN 0.0 ELSE 1.0 END", "AndA": "CASE WHEN a >= 0 AND b >= 0 THEN 1.0 ELSE 0.0 END", "AndB": "CASE WHEN a < 0 AND b < 0 THEN 1.0 ELSE 0.0 END", "OrA": "CASE WHEN a >= 0 OR b >= 0 THEN 1.0 ELSE 0.0 END", "OrB": "CASE WHEN a < 0 OR b < 0 THEN 1.0 ELSE 0.0 END", "Greater": "CASE WHEN a > b THEN 1.0 ELSE 0.0 END", "Less": "CASE WHEN a < b THEN 1.0 ELSE 0.0 END"},
    "conditional": {"GE3A": "CASE WHEN a >= 0 THEN b ELSE c END", "GE3B": "CASE WHEN a >= 0 THEN b + c ELSE b - c END", "GE3C": "CASE WHEN a >= 0 THEN b + c ELSE b * c END", "GE4A": f"{_G.format(a='a', b='b')} c ELSE d END", "GE4B": f"{_G.format(a='a', b='b')} c + d ELSE c - d END", "GE4C": f"{_G.format(a='a', b='b')} c + d ELSE c * d END", "LT4A": "CASE WHEN a < b THEN c ELSE d END", "LT4B": "CASE WHEN a < b THEN c + d ELSE c - d END", "LT4C": "CASE WHEN a < b THEN c + d ELSE c * d END", "GE2A": f"{_G.format(a='a', b='b')} a ELSE b END", "GE2B": f"{_G.format(a='a', b='b')} a + b ELSE a - b END", "GE2C": f"{_G.format(a='a', b='b')} a + b ELSE a * b END", "LT2A": "CASE WHEN a < b THEN a ELSE b END", "LT2B": "CASE WHEN a < b THEN a + b ELSE a - b END", "LT2C": "CASE WHEN a < b THEN a + b ELSE a * b END", "GE3D": "CASE WHEN a + b >= c THEN a + b ELSE c END", "GE3E": "CASE WHEN a + b >= c THEN a + b ELSE a + c END", "GE3F": "CASE WHEN a + b >= c THEN a + b ELSE a * c END", "If": "CASE WHEN a > 0 THEN b ELSE c END"},
    "extremes": {"Max": "greatest(a, b)", "Min": "least(a, b)", "Max^3": "greatest(a, b, c)", "Max^4": "greatest(a, b, c, d)", "Max^5": "greatest(a, b, c, d)", "Min^3": "least(a, b, c)", "Min^4": "least(a, b, c, d)", "Min^5": "least(a, b, c, d)"},
    "activations": {"Sigmoid": "1.0 / (1.0 + exp(-a))", "Relu": "greatest(0.0, a)", "LeakyRelu": "CASE WHEN a > 0 THEN a ELSE 0.01 * a END"},
    "kernels": {"Gaussian": "exp(-a * a / 2.0)", "GaussianKernel": "exp(-(a - b) * (a - b) / 2.0)", "ExponentialKernel": "exp(-abs(a - b))"},
}
#: Operands of the primitives that are not given the first ones.
_ARGS = {"Log": "b", "Log-O": "b", "Log-C": "b", "Log-C-Signed": "b", "Log2": "b", "Log10": "b", "LogE": "b", "SinPi": "c", "CosPi": "c", "Arcsin": "c", "Arccos": "c", "Tanh": "c", "Round": "c", "Div^3": "acd", "Div^4": "acdc", "Div^5": "acdcd"}


def _name(primitive: str) -> str:
    return "f_" + primitive.lower().replace("-", "_").replace("^", "_n")


def _operands(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select("c_custkey", *(F.expr(e).cast("double").alias(n) for n, e in _OPERANDS.items()))


def _primitives(names: Sequence[str]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        columns = []
        for n in names:
            p = get_primitive(n)
            args = [F.col(c) for c in (_ARGS.get(n) or "abcda"[: p.arity])]
            if n == "Equal":
                args = [F.col("b"), F.col("d") + F.lit(0.7)]
            columns.append(_r(sanitise(p.build(*args))).alias(_name(n)))
        return _operands(spark, sf).select("c_custkey", *columns)

    return run


def _primitives_sql(table: dict[str, str]) -> str:
    operands = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _OPERANDS.items())
    sane = lambda e: f"CASE WHEN ({e}) IS NULL OR isnan(CAST({e} AS DOUBLE)) OR isinf(CAST({e} AS DOUBLE)) THEN 0.0 ELSE ({e}) END"
    columns = ", ".join(f"{_q(sane(e))} AS {_name(n)}" for n, e in table.items())
    return f"WITH t AS (SELECT c_custkey, {operands} FROM customer) SELECT c_custkey, {columns} FROM t"


for _group, _table in _SQL.items():
    QUERIES[f"primitives_{_group}"] = _primitives(list(_table))
    ORACLES[f"primitives_{_group}"] = _primitives_sql(_table)

# --- genes and group-by primitives ------------------------------------------------------------------------------

GENES = ["Add(Mul(l_quantity, l_discount), AQ(l_extendedprice, l_quantity))", "Sub(Log(l_extendedprice), Sqrt(l_tax))"]


@query(
    "gene_ridge_r2",
    f"""WITH t AS (SELECT l_quantity * l_discount + l_extendedprice / sqrt(1.0 + l_quantity * l_quantity) AS g, l_tax AS y FROM lineitem),
        s AS (SELECT count(*) AS n, avg(g) AS mg, avg(y) AS my, var_pop(g) AS vg, covar_pop(g, y) AS c, var_pop(y) AS vy FROM t),
        m AS (SELECT *, n * c / (n * vg + 1.0) AS w FROM s)
        SELECT n, {_q("w", 9)} AS coef, {_q("my - w * mg")} AS intercept, {_q("1.0 - (vy - 2 * w * c + w * w * vg) / vy")} AS r2 FROM m""",
)
def gene_ridge_r2(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a gene over lineitem, the ridge of l_tax on it, and its R2."""
    rows = compiler.features(_t(spark, sf, "lineitem"), GENES[:1], ["g"], keep=["l_tax"])
    model = linear.ridge(rows, ["g"], "l_tax", 1.0)
    scored = rows.withColumn("p", model.column())
    return scored.agg(F.count(F.lit(1)).alias("n"), _r(F.lit(model.coefficients[0]), 9).alias("coef"), _r(F.lit(model.intercept)).alias("intercept"), _r(metrics.r2(F.col("l_tax"), F.col("p"), scored)).alias("r2"))


@query("gene_features", f"SELECT o_orderkey, {_q('ln(o_totalprice) * cos(o_custkey)')} AS g0, {_q('o_totalprice / sqrt(1.0 + CAST(o_custkey AS DOUBLE) * o_custkey)')} AS g1 FROM orders")
def gene_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = compiler.features(_t(spark, sf, "orders"), ["Mul(Log(o_totalprice), Cos(o_custkey))", "AQ(o_totalprice, o_custkey)"], keep=["o_orderkey"])
    return rows.select("o_orderkey", _r(F.col("g0")).alias("g0"), _r(F.col("g1")).alias("g1"))


@query("gene_modular", f"WITH t AS (SELECT o_orderkey, ln(o_totalprice) AS m1 FROM orders) SELECT o_orderkey, {_q('m1')} AS m1, {_q('m1 * m1 - m1')} AS m2 FROM t")
def gene_modular(spark: SparkSession, sf: str) -> DataFrame:
    rows = compiler.modular(_t(spark, sf, "orders"), ["Log(o_totalprice)", "Sub(Mul(m1, m1), m1)"], ["m1", "m2"], keep=["o_orderkey"])
    return rows.select("o_orderkey", _r(F.col("m1")).alias("m1"), _r(F.col("m2")).alias("m2"))


@query(
    "group_primitives",
    f"""SELECT c_custkey, {_q("c_acctbal / avg(c_acctbal) OVER w")} AS g_mean, {_q("c_acctbal / median(c_acctbal) OVER w")} AS g_median,
        {_q("c_acctbal / max(c_acctbal) OVER w")} AS g_max, {_q("c_acctbal / min(c_acctbal) OVER w")} AS g_min,
        CAST(count(*) OVER w AS DOUBLE) AS g_count, {_q("var_pop(c_acctbal) OVER w", 3)} AS g_var
        FROM customer WINDOW w AS (PARTITION BY c_nationkey)""",
)
def group_primitives(spark: SparkSession, sf: str) -> DataFrame:
    names = {"g_mean": "GroupByMean", "g_median": "GroupByMedian", "g_max": "GroupByMax", "g_min": "GroupByMin", "g_var": "GroupByVar"}
    genes = [f"{p}(c_nationkey, c_acctbal)" for p in names.values()]
    rows = compiler.features(_t(spark, sf, "customer"), [*genes, "GroupByCount(c_nationkey)"], [*names, "g_count"], keep=["c_custkey"])
    return rows.select("c_custkey", *(_r(F.col(n)).alias(n) for n in names if n != "g_var"), "g_count", _r(F.col("g_var"), 3).alias("g_var"))


@query(
    "group_discretised",
    f"""WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, CAST(floor(0.2 * count(*)) AS BIGINT) AS bins FROM customer),
        t AS (SELECT c_custkey, c_nationkey, floor((c_acctbal - lo) / (hi - lo) * (bins - 1)) AS cell FROM customer, s)
        SELECT c_custkey, {_q("CASE WHEN max(c_nationkey) OVER (PARTITION BY cell) = 0 THEN 0.0 ELSE CAST(c_nationkey AS DOUBLE) / max(c_nationkey) OVER (PARTITION BY cell) END")} AS g FROM t""",
)
def group_discretised(spark: SparkSession, sf: str) -> DataFrame:
    rows = compiler.features(_t(spark, sf, "customer"), ["GroupByMax(c_acctbal, c_nationkey)"], ["g"], keep=["c_custkey"])
    return rows.select("c_custkey", _r(F.col("g")).alias("g"))


@query("group_fitted", f"WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer WHERE c_custkey % 2 = 0 GROUP BY c_nationkey) SELECT c_custkey, {_q('coalesce(m, 0.0)', 4)} AS stat FROM customer LEFT JOIN s USING (c_nationkey)")
def group_fitted(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer")
    table = compiler.fit_group_table(df.where("c_custkey % 2 = 0"), "GroupByMean", "c_nationkey", "c_acctbal")
    return compiler.apply_group_table(df, table, "c_nationkey", 0.0, "stat").select("c_custkey", _r(F.col("stat"), 4).alias("stat"))


#: Training rows of group_fitted_genes: enough that nations repeat, so keys are taken as they are; one nation is not seen.
_SEEN = "c_custkey % 10 <> 0 AND c_nationkey <> 3"


@query(
    "group_fitted_genes",
    f"""WITH t AS (SELECT * FROM customer WHERE {_SEEN}),
        s AS (SELECT c_nationkey, avg(c_acctbal) AS m, max(c_acctbal) AS h, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY c_nationkey),
        g AS (SELECT avg(c_acctbal) AS m, max(c_acctbal) AS h, (SELECT avg(n) FROM s) AS n FROM t)
        SELECT c_custkey, {_q("c_acctbal / coalesce(s.m, g.m)", 4)} AS g_mean, {_q("c_acctbal / coalesce(s.h, g.h)", 4)} AS g_max, {_q("coalesce(s.n, g.n)", 4)} AS g_count
        FROM customer LEFT JOIN s USING (c_nationkey) CROSS JOIN g""",
)
def group_fitted_genes(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer")
    genes, names = ["GroupByMean(c_nationkey, c_acctbal)", "GroupByMax(c_nationkey, c_acctbal)", "GroupByCount(c_nationkey)"], ["g_mean", "g_max", "g_count"]
    fits = compiler.fit_groups(df.where(_SEEN), genes)
    rows = compiler.features(df, genes, names, keep=["c_custkey"], groups=fits)
    return rows.select("c_custkey", *(_r(F.col(n), 4).alias(n) for n in names))


# --- scalers ----------------------------------------------------------------------------------------------------

_SCALED = {
    "standard": (scaling.standard, "(x - avg(x) OVER ()) / stddev_pop(x) OVER ()"),
    "min_max": (scaling.min_max, "(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())"),
    "robust": (scaling.robust, "(x - q[2]) / (q[3] - q[1])"),
    "max_abs": (scaling.max_abs, "x / max(abs(x)) OVER ()"),
    "safety": (scaling.safety, "(x - avg(x) OVER ()) / stddev_pop(x) OVER ()"),
    "robust_clip": (scaling.robust_clip, "((x - q[2]) / (q[3] - q[1])) / sqrt(1.0 + ((x - q[2]) / (q[3] - q[1]) / 3.0) * ((x - q[2]) / (q[3] - q[1]) / 3.0))"),
    "sigmoid": (scaling.sigmoid, "ln(greatest(least((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 0.999), 0.001) / (1.0 - greatest(least((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 0.999), 0.001)))"),
    "bounds": (scaling.bounds, "x"),
}


def _scaler(fit: Callable) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _t(spark, sf, "events").select("event_id", F.col("value").alias("x"))
        return fit(df, ["x"]).apply(df).select("event_id", _r(F.col("x")).alias("x"))

    return run


for _group, (_fit, _expression) in _SCALED.items():
    QUERIES[f"scale_{_group}"] = _scaler(_fit)
    ORACLES[f"scale_{_group}"] = f"WITH t AS (SELECT event_id, CAST(value AS DOUBLE) AS x, (SELECT quantile_cont(CAST(value AS DOUBLE), [0.25, 0.5, 0.75]) FROM events) AS q FROM events) SELECT event_id, {_q(_expression)} AS x FROM t"


@query("column_kinds", """SELECT 'c_nationkey' AS name, 'Numerical' AS kind UNION ALL SELECT 'l', CASE WHEN (SELECT count(DISTINCT l_linenumber) FROM lineitem) <= 10 THEN 'Categorical' ELSE 'Numerical' END""")
def column_kinds(spark: SparkSession, sf: str) -> DataFrame:
    found = {"c_nationkey": scaling.column_kinds(_t(spark, sf, "customer"), ["c_nationkey"])["c_nationkey"], "l": scaling.column_kinds(_t(spark, sf, "lineitem"), ["l_linenumber"])["l_linenumber"]}
    return spark.createDataFrame(list(found.items()), "name string, kind string")


# --- encoders ---------------------------------------------------------------------------------------------------

_TRAIN = "c_custkey % 3 <> 0"


def _encoder(f: Callable[[DataFrame, DataFrame], DataFrame], columns: dict[str, int | None]) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = _t(spark, sf, "customer")
        out = f(df.where(_TRAIN), df)
        return out.select("c_custkey", *(F.col(c).cast("long").alias(c) if d is None else _r(F.col(c), d).alias(c) for c, d in columns.items()))

    return run


def _encoded(name: str, f: Callable[[DataFrame, DataFrame], DataFrame], columns: dict[str, int | None], sql: str) -> None:
    QUERIES[f"encode_{name}"] = _encoder(f, columns)
    ORACLES[f"encode_{name}"] = "WITH train AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0), " + sql


_CODES = "codes AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM train))"
_encoded("ordinal", lambda a, b: encoding.ordinal(b, encoding.codes(a, "c_mktsegment"), "c_mktsegment", "code"), {"code": None}, f"{_CODES} SELECT c_custkey, CAST(coalesce(code, -1) AS BIGINT) AS code FROM customer LEFT JOIN codes USING (c_mktsegment)")
_encoded("binary", lambda a, b: encoding.binary(b, encoding.codes(a, "c_mktsegment"), "c_mktsegment", "b"), {"b0": None, "b1": None, "b2": None}, f"{_CODES} SELECT c_custkey, CAST(code >> 2 & 1 AS BIGINT) AS b0, CAST(code >> 1 & 1 AS BIGINT) AS b1, CAST(code & 1 AS BIGINT) AS b2 FROM customer LEFT JOIN codes USING (c_mktsegment)")
_encoded("one_hot", lambda a, b: encoding.one_hot(b, ["BUILDING", "MACHINERY"], "c_mktsegment", "is_"), {"is_BUILDING": None, "is_MACHINERY": None}, "x AS (SELECT 1) SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS \"is_BUILDING\", CAST(c_mktsegment = 'MACHINERY' AS BIGINT) AS \"is_MACHINERY\" FROM customer")
_encoded("count", lambda a, b: encoding.count(a, b, "c_nationkey", "n"), {"n": None}, "s AS (SELECT c_nationkey, count(*) AS n FROM train GROUP BY ALL) SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) AS n FROM customer LEFT JOIN s USING (c_nationkey)")
_encoded("target", lambda a, b: encoding.target(a, b, "c_nationkey", "c_acctbal", "e"), {"e": 4}, f"m AS (SELECT avg(c_acctbal) AS m FROM train), s AS (SELECT c_nationkey, avg(c_acctbal) AS g, 1.0 / (1.0 + exp(-(count(*) - 20.0) / 10.0)) AS w FROM train GROUP BY ALL) SELECT c_custkey, {_q('coalesce(w * g + (1.0 - w) * m, m)', 4)} AS e FROM customer LEFT JOIN s USING (c_nationkey), m")
_encoded("m_estimate", lambda a, b: encoding.m_estimate(a, b, "c_nationkey", "c_acctbal", "e", 5.0), {"e": 4}, f"m AS (SELECT avg(c_acctbal) AS m FROM train), s AS (SELECT c_nationkey, sum(c_acctbal) AS g, count(*) AS n FROM train GROUP BY ALL) SELECT c_custkey, {_q('coalesce((g + 5.0 * m) / (n + 5.0), m)', 4)} AS e FROM customer LEFT JOIN s USING (c_nationkey), m")
_encoded("james_stein", lambda a, b: encoding.james_stein(a, b, "c_nationkey", "c_acctbal", "e"), {"e": 4}, f"m AS (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM train), s AS (SELECT c_nationkey, avg(c_acctbal) AS g, var_pop(c_acctbal) / count(*) AS o FROM train GROUP BY ALL) SELECT c_custkey, {_q('coalesce((1.0 - o / (o + v)) * g + o / (o + v) * m, m)', 4)} AS e FROM customer LEFT JOIN s USING (c_nationkey), m")
_encoded("leave_one_out", lambda a, b: encoding.leave_one_out(b, "c_nationkey", "c_acctbal", "e").withColumn("e", F.col("e") * F.lit(0.7310137)), {"e": 4}, f"x AS (SELECT 1) SELECT c_custkey, {_q('(sum(c_acctbal) OVER w - c_acctbal) / (count(*) OVER w - 1) * 0.7310137', 4)} AS e FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
_encoded("ordered_target", lambda a, b: encoding.ordered_target(b, "c_nationkey", "c_acctbal", "c_custkey", "e"), {"e": 4}, f"m AS (SELECT avg(c_acctbal) AS m FROM customer) SELECT c_custkey, {_q('(coalesce(sum(c_acctbal) OVER w, 0.0) + m) / (count(*) OVER w + 1.0)', 4)} AS e FROM customer, m WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
_encoded("quantile", lambda a, b: encoding.quantile_target(a, b, "c_nationkey", "c_acctbal", "e"), {"e": 4}, f"m AS (SELECT median(c_acctbal) AS m FROM train), s AS (SELECT c_nationkey, median(c_acctbal) AS g, count(*) AS n FROM train GROUP BY ALL) SELECT c_custkey, {_q('coalesce((n * g + m) / (n + 1.0), m)', 4)} AS e FROM customer LEFT JOIN s USING (c_nationkey), m")
_encoded("group_numeric", lambda a, b: encoding.group_numeric(a, b, "c_mktsegment", ["c_acctbal"]), {f"c_mktsegment_{k}_c_acctbal": 4 for k in ("mean", "median", "std", "max", "min")}, f"s AS (SELECT c_mktsegment, {_q('avg(c_acctbal)', 4)} AS c_mktsegment_mean_c_acctbal, {_q('median(c_acctbal)', 4)} AS c_mktsegment_median_c_acctbal, {_q('stddev_samp(c_acctbal)', 4)} AS c_mktsegment_std_c_acctbal, max(c_acctbal) AS c_mktsegment_max_c_acctbal, min(c_acctbal) AS c_mktsegment_min_c_acctbal FROM train GROUP BY ALL) SELECT c_custkey, s.* EXCLUDE (c_mktsegment) FROM customer LEFT JOIN s USING (c_mktsegment)")
_encoded("group_categorical", lambda a, b: encoding.group_categorical(a, b, "c_mktsegment", ["c_nationkey"]), {f"c_mktsegment_{k}_c_nationkey": None for k in ("mode", "nunique", "count")}, "n AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM train GROUP BY ALL), s AS (SELECT c_mktsegment, CAST(first(c_nationkey ORDER BY n DESC, c_nationkey) AS BIGINT) AS c_mktsegment_mode_c_nationkey, count(*) AS c_mktsegment_nunique_c_nationkey, CAST(sum(n) AS BIGINT) AS c_mktsegment_count_c_nationkey FROM n GROUP BY ALL) SELECT c_custkey, s.* EXCLUDE (c_mktsegment) FROM customer LEFT JOIN s USING (c_mktsegment)".replace("GROUP BY ALL) SELECT c_custkey", "GROUP BY c_mktsegment) SELECT c_custkey"))
_encoded("quantile_bins", lambda a, b: encoding.quantile_bins(a, b, "c_acctbal", "bin", 4), {"bin": None}, "e AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS e FROM train) SELECT c_custkey, CAST((c_acctbal >= e[1])::INT + (c_acctbal >= e[2])::INT + (c_acctbal >= e[3])::INT AS BIGINT) AS bin FROM customer, e")
_encoded("histogram_bins", lambda a, b: encoding.histogram_bins(b, "c_acctbal", "bin", 10), {"bin": None}, "e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, CAST(least(greatest(floor((c_acctbal - lo) / (hi - lo) * 10), 0), 9) AS BIGINT) AS bin FROM customer, e")
_encoded("nearest_value", lambda a, b: encoding.nearest_value(a, b, "c_acctbal", "near"), {"near": 4}, "v AS (SELECT DISTINCT c_acctbal AS t FROM train), lo AS (SELECT c_custkey, c_acctbal AS x, t AS l FROM customer ASOF LEFT JOIN v ON c_acctbal >= t), hi AS (SELECT c_custkey, t AS h FROM customer ASOF LEFT JOIN v ON c_acctbal <= t) SELECT c_custkey, CASE WHEN l IS NULL THEN h WHEN h IS NULL THEN l WHEN x - l <= h - x THEN l ELSE h END AS near FROM lo JOIN hi USING (c_custkey)")
_encoded("contrast_helmert", lambda a, b: encoding.contrast(b, encoding.codes(a, "c_mktsegment"), "c_mktsegment", "h", "helmert"), {"h0": 4, "h1": 4}, f"{_CODES} SELECT c_custkey, CAST(CASE code WHEN 0 THEN -1.0 WHEN 1 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS h0, CAST(CASE WHEN code < 2 THEN -1.0 WHEN code = 2 THEN 2.0 ELSE 0.0 END AS DOUBLE) AS h1 FROM customer LEFT JOIN codes USING (c_mktsegment)")
_encoded("contrast_sum", lambda a, b: encoding.contrast(b, encoding.codes(a, "c_mktsegment"), "c_mktsegment", "h", "sum"), {"h0": 4, "h3": 4}, f"{_CODES} SELECT c_custkey, CAST(CASE code WHEN 0 THEN 1.0 WHEN 4 THEN -1.0 ELSE 0.0 END AS DOUBLE) AS h0, CAST(CASE code WHEN 3 THEN 1.0 WHEN 4 THEN -1.0 ELSE 0.0 END AS DOUBLE) AS h3 FROM customer LEFT JOIN codes USING (c_mktsegment)")


@query("encode_cross", "SELECT c_custkey, c_mktsegment || '_' || CAST(c_nationkey AS VARCHAR) AS crossed FROM customer")
def encode_cross(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.cross(_t(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], "crossed").select("c_custkey", "crossed")


# --- losses and scores --------------------------------------------------------------------------------------------

_YP = "c_acctbal * 0.000310137 AS y, CAST(c_custkey % 11 AS DOUBLE) * 0.3 - 1.0 AS p"


def _yp(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal * 0.000310137 AS y", "CAST(c_custkey % 11 AS DOUBLE) * 0.3 - 1.0 AS p")


@query("case_losses", f"WITH t AS (SELECT c_custkey, {_YP} FROM customer), e AS (SELECT c_custkey, (y - p) * (y - p) AS q, abs(y - p) AS a FROM t) SELECT c_custkey, {_q('q')} AS squared, {_q('a')} AS absolute, {_q('exp(least(q, 10.0))', 4)} AS exp_squared, {_q('ln(1.0 + q)')} AS log_squared, {_q('q * q', 4)} AS quad, {_q('least(q, 1.0)')} AS bounded FROM e")
def case_losses(spark: SparkSession, sf: str) -> DataFrame:
    digits = {"exp_squared": 4, "quad": 4}
    return _yp(spark, sf).select("c_custkey", *(_r(f(F.col("y"), F.col("p")), digits.get(n, 6)).alias(n) for n, f in metrics.CASE_LOSSES.items()))


@query("score_r2", f"WITH t AS (SELECT c_custkey, {_YP}, CAST(c_custkey % 5 + 1 AS DOUBLE) AS w FROM customer) SELECT {_q('1.0 - sum((y - p) * (y - p)) / (count(*) * var_pop(y))')} AS r2, {_q('1.0 - sum(w * (y - p) * (y - p)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w))')} AS weighted, {_q('corr(y, p)')} AS pearson FROM t")
def score_r2(spark: SparkSession, sf: str) -> DataFrame:
    df = _yp(spark, sf).withColumn("w", (F.col("c_custkey") % 5 + 1).cast("double"))
    y, p = F.col("y"), F.col("p")
    return df.agg(_r(metrics.r2(y, p, df)).alias("r2"), _r(metrics.weighted_r2(y, p, F.col("w"))).alias("weighted"), _r(F.corr(y, p)).alias("pearson"))


@query("score_spearman", f"WITH t AS (SELECT c_custkey, {_YP} FROM customer), r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS b FROM t) SELECT {_q('corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE))')} AS spearman FROM r")
def score_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.spearman(_yp(spark, sf), "y", "p").select(_r(F.col("spearman")).alias("spearman"))


@query("smoothness", f"WITH t AS (SELECT event_id, ts, value, value - lag(value) OVER (ORDER BY ts, event_id) AS d1 FROM events), u AS (SELECT d1, d1 - lag(d1) OVER (ORDER BY ts, event_id) AS d2 FROM t) SELECT {_q('avg(d1 * d1)', 3)} AS first_order, {_q('avg(d2 * d2)', 3)} AS second_order FROM u")
def smoothness(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.smoothness(_t(spark, sf, "events"), "ts", "value", "event_id")
    return out.select(_r(F.col("first_order"), 3).alias("first_order"), _r(F.col("second_order"), 3).alias("second_order"))


@query("generation_statistics", f"SELECT {_q('avg(value)', 4)} AS avg, {_q('stddev_pop(value)', 4)} AS std, {_q('quantile_cont(value, 0.25)', 4)} AS q25, {_q('median(value)', 4)} AS median, {_q('quantile_cont(value, 0.75)', 4)} AS q75, {_q('min(value)', 4)} AS min, {_q('max(value)', 4)} AS max FROM events")
def generation_statistics(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.generation_statistics(_t(spark, sf, "events"), "value")
    return out.select(*(_r(F.col(c), 4).alias(c) for c in out.columns))


@query("weighted_mean_std", f"WITH t AS (SELECT value AS v, CAST(event_id % 9 + 1 AS DOUBLE) AS w FROM events) SELECT {_q('sum(v * w) / sum(w)', 4)} AS mean, {_q('sqrt(sum(w * v * v) / sum(w) - (sum(v * w) / sum(w)) * (sum(v * w) / sum(w)))', 4)} AS std FROM t")
def weighted_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.weighted_mean_std(_t(spark, sf, "events").withColumn("w", (F.col("event_id") % 9 + 1).cast("double")), "value", "w")
    return out.select(_r(F.col("mean"), 4).alias("mean"), _r(F.col("std"), 4).alias("std"))


@query("outlier_free_mean", f"WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT {_q('avg(o_totalprice)', 3)} AS mean FROM orders, q WHERE o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def outlier_free_mean(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.outlier_free_mean(_t(spark, sf, "orders"), "o_totalprice").select(_r(F.col("mean"), 3).alias("mean"))


@query("bootstrap_error")
def bootstrap_error(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bootstrap_error(_yp(spark, sf).withColumn("loss", (F.col("y") - F.col("p")) ** 2), "loss", "c_custkey")


@query("semantic_fingerprint")
def semantic_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = compiler.features(_t(spark, sf, "customer"), ["Mul(c_acctbal, 2.0)", "Add(c_acctbal, c_acctbal)", "Sin(c_acctbal)"], keep=["c_custkey"])
    return metrics.semantic_fingerprint(rows, ["g0", "g1", "g2"], "c_custkey")


# --- linear models ------------------------------------------------------------------------------------------------


def _xy(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal * 0.001 AS x", "sin(c_acctbal) + c_acctbal * 0.0004 AS y")


_XY = "SELECT c_custkey, c_acctbal * 0.001 AS x, sin(c_acctbal) + c_acctbal * 0.0004 AS y FROM customer"


@query("ridge_cross_validation", f"WITH t AS (SELECT *, c_custkey % 5 AS fold FROM ({_XY})), f AS (SELECT a.fold, count(*) AS n, avg(b.x) AS mx, avg(b.y) AS my, count(*) * covar_pop(b.x, b.y) AS c, count(*) * var_pop(b.x) AS v FROM (SELECT DISTINCT fold FROM t) a JOIN t b ON a.fold <> b.fold GROUP BY a.fold) SELECT c_custkey, {_q('my + c / (v + 1.0) * (x - mx)')} AS cv FROM t JOIN f USING (fold)")
def ridge_cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    out = linear.cross_val_predict(_xy(spark, sf), ["x"], "y", (F.col("c_custkey") % 5).cast("int"), 1.0)
    return out.select("c_custkey", _r(F.col("cv")).alias("cv"))


@query("ridge_leave_one_out", f"WITH t AS ({_XY}), s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, count(*) * covar_pop(x, y) AS c, count(*) * var_pop(x) AS v FROM t) SELECT c_custkey, {_q('y - (y - (my + c / (v + 1.0) * (x - mx))) / (1.0 - 1.0 / n - (x - mx) * (x - mx) / (v + 1.0))')} AS loo FROM t, s")
def ridge_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = linear.loo_predictions(_xy(spark, sf), ["x"], "y", [1.0])
    return out.select("c_custkey", _r(F.col("loo")).alias("loo"))


@query("linear_scaling", f"WITH t AS ({_XY}) SELECT {_q('regr_slope(y, x)')} AS slope, {_q('regr_intercept(y, x)')} AS intercept FROM t")
def linear_scaling(spark: SparkSession, sf: str) -> DataFrame:
    m = linear.linear_scaling(_xy(spark, sf), "x", "y")
    return spark.range(1).select(_r(F.lit(m.coefficients[0])).alias("slope"), _r(F.lit(m.intercept)).alias("intercept"))


@query("ood_folds", "WITH t AS (SELECT quantile_cont(c_acctbal, [0.2, 0.4, 0.6, 0.8]) AS e FROM customer) SELECT CAST((c_acctbal >= e[1])::INT + (c_acctbal >= e[2])::INT + (c_acctbal >= e[3])::INT + (c_acctbal >= e[4])::INT AS INTEGER) AS fold, count(*) AS n FROM customer, t GROUP BY 1")
def ood_folds(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer")
    return df.withColumn("fold", linear.ood_folds(df, "c_acctbal")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("leaf_ridge", f"WITH t AS (SELECT *, c_custkey % 4 AS leaf FROM ({_XY})), s AS (SELECT leaf, avg(x) AS mx, avg(y) AS my, count(*) * covar_pop(x, y) AS c, count(*) * var_pop(x) AS v FROM t GROUP BY leaf) SELECT c_custkey, {_q('my + c / (v + 1.0) * (x - mx)')} AS leaf_pred FROM t JOIN s USING (leaf)")
def leaf_ridge(spark: SparkSession, sf: str) -> DataFrame:
    out = linear.leaf_ridge(_xy(spark, sf).withColumn("leaf", F.col("c_custkey") % 4), "leaf", ["x"], "y")
    return out.select("c_custkey", _r(F.col("leaf_pred")).alias("leaf_pred"))


@query("r2_drop")
def r2_drop(spark: SparkSession, sf: str) -> DataFrame:
    found = linear.r2_drop(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return spark.createDataFrame(list(found.items()), "feature string, r2_drop double")


@query("forward_selection")
def forward_selection(spark: SparkSession, sf: str) -> DataFrame:
    found = linear.forward_selection(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 2)
    return spark.createDataFrame(list(enumerate(found)), "place int, feature string")


@query("linear_leaf_tree")
def linear_leaf_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of ridges over lineitem: price by quantity, discount and tax."""
    df = _t(spark, sf, "lineitem")
    tree = linear_tree.grow(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return df.groupBy(tree.leaf().alias("leaf")).agg(F.count(F.lit(1)).alias("n"), _r(F.avg(tree.column()), 2).alias("mean_pred"), _r(F.avg("l_extendedprice"), 2).alias("mean_y"))


@query("ridge_then_trees")
def ridge_then_trees(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS a", "CAST(p_partkey % 37 AS DOUBLE) AS b", "p_retailprice AS y")
    return df.select("p_partkey", _r(linear_tree.ridge_and_trees(df, ["a", "b"], "y", trees=2).column(), 4).alias("pred"))


_PAIRS = "SELECT sqrt(pow(a.a - b.a, 2){}) AS z, abs(a.y - b.y) AS w FROM c a JOIN c b ON a.k < b.k"
_DISTANCES = f"WITH c AS (SELECT c_custkey AS k, c_acctbal / 100 AS a, CAST(c_custkey % 31 AS DOUBLE) AS b, c_acctbal * c_acctbal / 1e4 + c_nationkey AS y FROM customer) SELECT {_q('covar_samp(z, w) / (stddev_pop(z) * stddev_pop(w))')} AS iodc FROM ({_PAIRS})"


def _distance_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").selectExpr("c_acctbal / 100 AS a", "CAST(c_custkey % 31 AS DOUBLE) AS b", "c_acctbal * c_acctbal / 1e4 + c_nationkey AS y")


@query("distance_correlation", _DISTANCES.format(""))
def distance_correlation(spark: SparkSession, sf: str) -> DataFrame:
    found = pair_distances.input_output_distance_correlation(_distance_rows(spark, sf), ["a"], "y")
    return spark.createDataFrame([(found,)], "iodc double").select(_r(F.col("iodc")).alias("iodc"))


@query("distance_correlation_several", _DISTANCES.format(" + pow(a.b - b.b, 2)"))
def distance_correlation_several(spark: SparkSession, sf: str) -> DataFrame:
    found = pair_distances.input_output_distance_correlation(_distance_rows(spark, sf), ["a", "b"], "y")
    return spark.createDataFrame([(found,)], "iodc double").select(_r(F.col("iodc")).alias("iodc"))


@query("maximal_information")
def maximal_information(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "lineitem")
    found = [(c, float(information.maximal_information(df, c, "l_extendedprice"))) for c in ("l_quantity", "l_discount", "l_tax")]
    return spark.createDataFrame(found, "feature string, mic double").select("feature", _r(F.col("mic")).alias("mic"))


@query("residual_information")
def residual_information(spark: SparkSession, sf: str) -> DataFrame:
    features = ["l_quantity", "l_discount", "l_tax"]
    df = _t(spark, sf, "lineitem")
    model = linear.solve_ridge(linear.gram(df, features, "l_extendedprice"), features, 1.0)
    rows = df.select(*features, "l_extendedprice", (F.col("l_extendedprice") - model.column()).alias("left"))
    return spark.createDataFrame([(float(information.residual_information(rows, features, "left", "l_extendedprice")),)], "wcrv double").select(_r(F.col("wcrv")).alias("wcrv"))


def _members(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    df = _t(spark, sf, "lineitem").selectExpr("l_extendedprice AS y", "2000.0D * l_quantity AS a", "1000.0D * l_quantity + 27000 AS b", "53000.0D AS c", "60000.0D - 100000 * l_discount AS d", "38000.0D + 500 * l_linenumber AS e")
    return df, list("abcde")


@query("shapley_members")
def shapley_members(spark: SparkSession, sf: str) -> DataFrame:
    df, members = _members(spark, sf)
    found = subsets.shapley_values(df, members, "y")
    return spark.createDataFrame([(m, v) for m, (v, _) in found.items()], "member string, shapley double").select("member", _r(F.col("shapley"), 2).alias("shapley"))


@query("determinantal_members")
def determinantal_members(spark: SparkSession, sf: str) -> DataFrame:
    df, members = _members(spark, sf)
    return spark.createDataFrame(list(enumerate(subsets.determinantal_members(df, members, "y", 3), 1)), "place int, member string")


# --- typed genes ---

_TYPED = ["standardize(groupby_mean(c_mktsegment, standardize(c_acctbal)))", "min_max_scaler(Mul(c_acctbal, c_nationkey))", "groupby_count(binary_feature_cross(c_mktsegment, nation), c_acctbal)", "onehot_encoding(c_mktsegment)"]


@query(
    "typed_genes",
    f"""WITH t AS (SELECT *, c_mktsegment || '_' || c_nationkey AS k FROM customer WHERE c_custkey % 4 <> 0),
    s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d, min(c_acctbal * c_nationkey) AS lo, max(c_acctbal * c_nationkey) AS hi FROM t),
    g AS (SELECT c_mktsegment, avg((c_acctbal - m) / d) AS gm FROM t, s GROUP BY c_mktsegment),
    h AS (SELECT avg(gm) AS hm, stddev_pop(gm) AS hd FROM t JOIN g USING (c_mktsegment)),
    n AS (SELECT k, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY k)
    SELECT c_custkey, {_q('(gm - hm) / hd')} AS g0, {_q('(c_acctbal * c_nationkey - lo) / (hi - lo)')} AS g1, coalesce(n.n, 0.0) AS g2,
           {", ".join(f"CASE WHEN c_mktsegment = (SELECT DISTINCT c_mktsegment FROM t ORDER BY 1 LIMIT 1 OFFSET {i}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g3_{i}" for i in range(5))}
    FROM customer c JOIN g USING (c_mktsegment) LEFT JOIN n ON n.k = c_mktsegment || '_' || c_nationkey, s, h""",
)
def typed_genes(spark: SparkSession, sf: str) -> DataFrame:
    """Genes fitted on three quarters of customer and applied to all of it."""
    df = _t(spark, sf, "customer")
    df = df.withColumn("nation", F.col("c_nationkey").cast("string"))
    plan = typed.fit(df.where("c_custkey % 4 <> 0"), _TYPED, ["c_mktsegment", "nation"])
    out = plan.transform(df, ["c_custkey"])
    return out.select("c_custkey", _r(F.col("g0")).alias("g0"), _r(F.col("g1")).alias("g1"), "g2", *(f"g3_{i}" for i in range(5)))


# --- nearest neighbours ---------------------------------------------------------------------------------------------

_D2 = "list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"
_NEAR = f"near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, id) AS rk FROM (SELECT q.vec_id AS query_id, d.vec_id AS id, d.label AS y, {_D2} AS d2 FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)), k AS (SELECT * FROM near WHERE rk <= 5)"


def _neighbours(spark: SparkSession, sf: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    df = _t(spark, sf, "embeddings")
    return knn.knn(df.where("vec_id % 20 = 0"), df, k), df


@query("knn_join", f"WITH {_NEAR} SELECT query_id, id, {_q('d2')} AS d2, CAST(rk AS INTEGER) AS rk FROM k")
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf)[0].select("query_id", "id", _r(F.col("d2")).alias("d2"), "rk")


_KNN = {"uniform": "avg(y)", "inverse_rank": "sum(y / rk) / sum(1.0 / rk)", "linear_rank": "sum(y * (6.0 - rk)) / sum(6.0 - rk)", "inverse_distance": "sum(y / (d2 + 1e-6)) / sum(1.0 / (d2 + 1e-6))", "gaussian": "sum(y * exp(-d2 / 2.0)) / sum(exp(-d2 / 2.0))"}


def _knn_query(how: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        near, df = _neighbours(spark, sf)
        return knn.knn_predict(near, df, "vec_id", "label", 5, how).select("query_id", _r(F.col("prediction")).alias("prediction"))

    return run


for _group, _expression in _KNN.items():
    QUERIES[f"knn_{_group}"] = _knn_query(_group)
    ORACLES[f"knn_{_group}"] = f"WITH {_NEAR} SELECT query_id, {_q(_expression)} AS prediction FROM k GROUP BY query_id"


@query("knn_softmax_weights", f"WITH {_NEAR} SELECT query_id, id, {_q('exp(-0.5 * d2) / sum(exp(-0.5 * d2)) OVER (PARTITION BY query_id)')} AS weight FROM k")
def knn_softmax_weights(spark: SparkSession, sf: str) -> DataFrame:
    return knn.softmax_weights(_neighbours(spark, sf)[0], 0.5).select("query_id", "id", _r(F.col("weight")).alias("weight"))


@query("knn_auto_k", f"WITH {_NEAR}, r AS (SELECT rk, query_id, avg(y) OVER (PARTITION BY query_id ORDER BY rk) AS p FROM k), j AS (SELECT rk, p, label AS own FROM r JOIN embeddings ON query_id = vec_id) SELECT CAST(rk AS INTEGER) AS k, {_q('1.0 - sum((own - p) * (own - p)) / (count(*) * var_pop(own))')} AS r2 FROM j GROUP BY rk")
def knn_auto_k(spark: SparkSession, sf: str) -> DataFrame:
    near, df = _neighbours(spark, sf)
    return knn.auto_k(near, df, "vec_id", "label").select("k", _r(F.col("r2")).alias("r2"))


@query("knn_local_weights", f"WITH {_NEAR}, m AS (SELECT query_id, model, avg(abs(y - model)) + 1e-10 AS e FROM k, (SELECT unnest([2, 5, 8]) AS model) GROUP BY ALL) SELECT query_id, CAST(model AS INTEGER) AS model, {_q('(1.0 / e) / sum(1.0 / e) OVER (PARTITION BY query_id)')} AS weight FROM m")
def knn_local_weights(spark: SparkSession, sf: str) -> DataFrame:
    near, df = _neighbours(spark, sf)
    losses = df.select(F.col("vec_id").alias("id"), "label", F.explode(F.array(F.lit(2), F.lit(5), F.lit(8))).alias("model")).select("id", "model", F.abs(F.col("label") - F.col("model")).cast("double").alias("loss"))
    return knn.local_model_weights(near, losses).select("query_id", "model", _r(F.col("weight")).alias("weight"))


# --- populations ------------------------------------------------------------------------------------------------------

_LOSS = "SELECT c_nationkey AS ind_id, c_custkey % 40 AS row_id, max(abs(c_acctbal)) AS loss FROM customer GROUP BY ALL"
_POP = "SELECT p_partkey AS ind_id, p_retailprice AS fitness, CAST(p_size AS DOUBLE) AS size, p_brand AS cell FROM part"


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "customer")
    return t.groupBy(F.col("c_nationkey").alias("ind_id"), (F.col("c_custkey") % 40).alias("row_id")).agg(F.max(F.abs("c_acctbal")).alias("loss"))


def _population(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("ind_id"), F.col("p_retailprice").alias("fitness"), F.col("p_size").cast("double").alias("size"), F.col("p_brand").alias("cell"))


@query("pareto_front", f"WITH p AS ({_POP}) SELECT ind_id, fitness, size FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.fitness <= a.fitness AND b.size <= a.size AND (b.fitness < a.fitness OR b.size < a.size))")
def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    return selection.pareto_front(_population(spark, sf), ["fitness", "size"]).select("ind_id", "fitness", "size")


@query("crowding_distance", f"WITH p AS ({_POP}), r AS (SELECT max(fitness) - min(fitness) AS f, max(size) - min(size) AS s FROM p), n AS (SELECT ind_id, (lead(fitness) OVER a - lag(fitness) OVER a) / f + (lead(size) OVER b - lag(size) OVER b) / s AS c FROM p, r WINDOW a AS (ORDER BY fitness, ind_id), b AS (ORDER BY size, ind_id)) SELECT ind_id, {_q('coalesce(c, -1.0)', 9)} AS crowding FROM n")
def crowding_distance(spark: SparkSession, sf: str) -> DataFrame:
    out = selection.crowding(_population(spark, sf), ["fitness", "size"])
    return out.select("ind_id", _r(F.when(F.col("crowding") == float("inf"), -1.0).otherwise(F.col("crowding")), 9).alias("crowding"))


_GOALS = ["fitness", "size", "third"]
_POP3 = f"SELECT *, CAST((ind_id * 7919) % 1009 AS DOUBLE) AS third FROM ({_POP})"
#: The layer of a row is the longest chain of rows that dominate it one after the other.
_LAYERS = f"""p AS ({_POP3}), e AS (
    SELECT a.ind_id AS a, b.ind_id AS b FROM p a JOIN p b ON a.fitness <= b.fitness AND a.size <= b.size AND a.third <= b.third
    AND (a.fitness < b.fitness OR a.size < b.size OR a.third < b.third)),
    chains AS (SELECT ind_id, 0 AS layer FROM p UNION SELECT e.b, layer + 1 FROM chains JOIN e ON e.a = chains.ind_id),
    layers AS (SELECT ind_id, max(layer) AS layer FROM chains GROUP BY ind_id)"""


def _population3(spark: SparkSession, sf: str) -> DataFrame:
    return _population(spark, sf).withColumn("third", (F.col("ind_id") * 7919 % 1009).cast("double"))


@query("pareto_layers", f"WITH RECURSIVE {_LAYERS} SELECT ind_id, CAST(layer AS INTEGER) AS layer FROM layers")
def pareto_layers(spark: SparkSession, sf: str) -> DataFrame:
    return pareto.layers(_population3(spark, sf), _GOALS, "ind_id")


_CROWD = " + ".join(f"coalesce((lead({o}) OVER w{o} - lag({o}) OVER w{o}) / (CASE WHEN max({o}) OVER l > min({o}) OVER l THEN 3 * (max({o}) OVER l - min({o}) OVER l) ELSE 1.0 END), 'inf'::DOUBLE)" for o in _GOALS)


@query(
    "nsga2_survivors",
    f"""WITH RECURSIVE {_LAYERS},
    c AS (SELECT ind_id, layer, {_CROWD} AS crowding FROM p JOIN layers USING (ind_id) WINDOW l AS (PARTITION BY layer), {", ".join(f"w{o} AS (PARTITION BY layer ORDER BY {o}, ind_id)" for o in _GOALS)}),
    r AS (SELECT *, row_number() OVER (ORDER BY layer, crowding DESC, ind_id) AS r, max(layer) OVER () AS top FROM c)
    SELECT ind_id, CAST(layer AS INTEGER) AS layer FROM r WHERE r <= (SELECT count(*) // 3 FROM p)""",
)
def nsga2_survivors(spark: SparkSession, sf: str) -> DataFrame:
    population = _population3(spark, sf)
    return pareto.nsga2(population, _GOALS, "ind_id", population.count() // 3).select("ind_id", "layer")


@query("nsga3_survivors")
def nsga3_survivors(spark: SparkSession, sf: str) -> DataFrame:
    population = _population3(spark, sf)
    return pareto.nsga3(population, _GOALS, "ind_id", population.count() // 3).select("ind_id", "layer", "niche", "distance")


@query("knee_point", f"WITH p AS ({_POP}), f AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.fitness <= a.fitness AND b.size <= a.size AND (b.fitness < a.fitness OR b.size < a.size))), r AS (SELECT min(fitness) AS a, CASE WHEN max(fitness) > min(fitness) THEN max(fitness) - min(fitness) ELSE 1.0 END AS b, min(size) AS c, CASE WHEN max(size) > min(size) THEN max(size) - min(size) ELSE 1.0 END AS d FROM f) SELECT ind_id, {_q('abs((fitness - a) / b + (size - c) / d - 1.0) / sqrt(2.0)')} AS knee_distance FROM f, r ORDER BY abs((fitness - a) / b + (size - c) / d - 1.0) DESC, ind_id LIMIT 1")
def knee_point(spark: SparkSession, sf: str) -> DataFrame:
    front = selection.pareto_front(_population(spark, sf), ["fitness", "size"])
    return selection.knee_point(front, "fitness", "size").select("ind_id", _r(F.col("knee_distance")).alias("knee_distance"))


@query("map_elites", f"SELECT ind_id, cell, fitness FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY fitness, ind_id) AS r FROM ({_POP})) WHERE r = 1")
def map_elites(spark: SparkSession, sf: str) -> DataFrame:
    return selection.map_elites(_population(spark, sf), ["cell"]).select("ind_id", "cell", "fitness")


@query("hall_of_fame", f"SELECT ind_id, fitness FROM ({_POP}) ORDER BY fitness, ind_id LIMIT 20")
def hall_of_fame(spark: SparkSession, sf: str) -> DataFrame:
    return ensemble.hall_of_fame(_population(spark, sf), 20).select("ind_id", "fitness")


@query("harmonic_rank", f"WITH p AS ({_POP}) SELECT ind_id, {_q('2.0 / (1.0 / rank() OVER (ORDER BY fitness) + 1.0 / rank() OVER (ORDER BY size))', 4)} AS harmonic_rank FROM p")
def harmonic_rank(spark: SparkSession, sf: str) -> DataFrame:
    return selection.harmonic_rank(_population(spark, sf), ["fitness", "size"]).select("ind_id", _r(F.col("harmonic_rank"), 4).alias("harmonic_rank"))


@query("niches", f"SELECT ind_id, CAST(ntile(CAST(floor(sqrt((SELECT count(*) FROM part))) AS INTEGER)) OVER (ORDER BY fitness, ind_id) - 1 AS INTEGER) AS niche FROM ({_POP})")
def niches(spark: SparkSession, sf: str) -> DataFrame:
    return selection.niches(_population(spark, sf)).select("ind_id", "niche")


@query("boltzmann_weights", f"WITH p AS (SELECT ind_id, exp((fitness - max(fitness) OVER ()) / 0.05) AS w FROM ({_POP})) SELECT ind_id, {_q('w / sum(w) OVER ()', 9)} AS p FROM p")
def boltzmann_weights(spark: SparkSession, sf: str) -> DataFrame:
    return selection.boltzmann_weights(_population(spark, sf), 5, 10).select("ind_id", _r(F.col("p"), 9).alias("p"))


@query("roulette_weights", f"WITH p AS (SELECT ind_id, max(fitness) OVER () - fitness AS w FROM ({_POP})) SELECT ind_id, {_q('w / sum(w) OVER ()', 9)} AS p FROM p")
def roulette_weights(spark: SparkSession, sf: str) -> DataFrame:
    return selection.roulette_weights(_population(spark, sf)).select("ind_id", _r(F.col("p"), 9).alias("p"))


@query("tournament")
def tournament(spark: SparkSession, sf: str) -> DataFrame:
    return selection.tournament(_population(spark, sf), 50, 7)


@query("lexicase")
def lexicase(spark: SparkSession, sf: str) -> DataFrame:
    ids, matrix = selection.loss_matrix(_losses(spark, sf))
    return spark.createDataFrame(list(enumerate(int(i) for i in selection.lexicase(ids, matrix, 20, 7))), "pick int, ind_id int")


@query("lexicase_step", f"WITH t AS (SELECT ind_id, loss FROM ({_LOSS}) WHERE row_id = 3), m AS (SELECT median(loss) AS m, min(loss) AS l FROM t), d AS (SELECT median(abs(loss - m)) AS d FROM t, m) SELECT ind_id FROM t, m, d WHERE loss <= l + d")
def lexicase_step(spark: SparkSession, sf: str) -> DataFrame:
    losses = _losses(spark, sf)
    return selection.lexicase_step(losses.select("ind_id").distinct(), losses, 3)


@query("case_ranks", f"WITH t AS (SELECT ind_id, row_number() OVER (PARTITION BY row_id ORDER BY loss, ind_id) AS r FROM ({_LOSS})) SELECT ind_id, {_q('avg(r)')} AS mean_rank FROM t GROUP BY ind_id")
def case_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return selection.case_ranks(_losses(spark, sf)).select("ind_id", _r(F.col("mean_rank")).alias("mean_rank"))


@query("complementary_partner", f"WITH t AS ({_LOSS}), h AS (SELECT row_id FROM t WHERE ind_id = 3 AND loss >= (SELECT quantile_cont(loss, 0.75) FROM t WHERE ind_id = 3)) SELECT ind_id, {_q('avg(loss)', 4)} AS loss FROM t WHERE ind_id <> 3 AND row_id IN (SELECT row_id FROM h) GROUP BY ind_id ORDER BY avg(loss), ind_id LIMIT 1")
def complementary_partner(spark: SparkSession, sf: str) -> DataFrame:
    return selection.complementary_partner(_losses(spark, sf), 3).select("ind_id", _r(F.col("loss"), 4).alias("loss"))


@query("pair_complement", f"WITH t AS ({_LOSS}) SELECT a.ind_id, {_q('avg(least(a.loss, b.loss))', 4)} AS loss FROM t a JOIN t b USING (row_id) WHERE b.ind_id = 3 AND a.ind_id <> 3 GROUP BY a.ind_id")
def pair_complement(spark: SparkSession, sf: str) -> DataFrame:
    return selection.pair_complement(_losses(spark, sf), 3).select("ind_id", _r(F.col("loss"), 4).alias("loss"))


@query("da_lexicase_scores", f"WITH t AS ({_LOSS}), z AS (SELECT ind_id, row_id, (loss - avg(loss) OVER w) / (CASE WHEN stddev_pop(loss) OVER w = 0 THEN 1e-8 ELSE stddev_pop(loss) OVER w END) AS z FROM t WINDOW w AS (PARTITION BY row_id)) SELECT ind_id, {_q('sum(z * (row_id % 7 + 1) / 160.0)', 5)} AS score FROM z GROUP BY ind_id")
def da_lexicase_scores(spark: SparkSession, sf: str) -> DataFrame:
    losses = _losses(spark, sf)
    weights = losses.select("row_id").distinct().withColumn("w", (F.col("row_id") % 7 + 1) / F.lit(160.0))
    return selection.da_lexicase_scores(losses, weights).select("ind_id", _r(F.col("score"), 5).alias("score"))


@query("minimum_variance_split")
def minimum_variance_split(spark: SparkSession, sf: str) -> DataFrame:
    return selection.best_split(_losses(spark, sf))


@query("batch_means", f"SELECT ind_id, row_id // 16 AS batch, {_q('avg(loss) * 0.7310137', 4)} AS loss FROM ({_LOSS}) GROUP BY ALL".replace("GROUP BY ALL) GROUP BY ALL", "GROUP BY ALL) GROUP BY 1, 2"))
def batch_means(spark: SparkSession, sf: str) -> DataFrame:
    return selection.batch_means(_losses(spark, sf), 16).select("ind_id", "batch", _r(F.col("loss") * F.lit(0.7310137), 4).alias("loss"))


@query("hard_rows", f"SELECT row_id, {_q('median(loss)', 4)} AS score FROM ({_LOSS}) GROUP BY row_id ORDER BY median(loss) DESC, row_id LIMIT 10")
def hard_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hard_rows(_losses(spark, sf), 10).select("row_id", _r(F.col("score"), 4).alias("score"))


@query("instance_weights", f"WITH t AS (SELECT row_id, median(loss) AS s FROM ({_LOSS}) GROUP BY row_id) SELECT row_id, {_q('s / sum(s) OVER ()')} AS weight FROM t")
def instance_weights(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.instance_weights(_losses(spark, sf), "row_id", "loss").select("row_id", _r(F.col("weight")).alias("weight"))


# --- ensembles and importance -------------------------------------------------------------------------------------------

_MODELS = "c_acctbal * 0.000310137 AS y, c_acctbal * 0.0003 + sin(c_custkey) AS p0, c_acctbal * 0.00025 + cos(c_custkey) AS p1, sin(c_custkey * 2.0) AS p2"


def _models(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").selectExpr("c_custkey", *(x.strip() for x in _MODELS.split(", ")))


@query("combine_predictions", f"WITH t AS (SELECT c_custkey, {_MODELS} FROM customer) SELECT c_custkey, {_q('(p0 + p1 + p2) / 3.0')} AS mean, {_q('list_median([p0, p1, p2])')} AS median, {_q('0.5 * p0 + 0.25 * p1 + 0.25 * p2')} AS weighted FROM t")
def combine_predictions(spark: SparkSession, sf: str) -> DataFrame:
    p = ["p0", "p1", "p2"]
    return _models(spark, sf).select("c_custkey", _r(ensemble.combine(p)).alias("mean"), _r(ensemble.combine(p, "median")).alias("median"), _r(ensemble.combine(p, "weighted", [2, 1, 1])).alias("weighted"))


@query("greedy_ensemble")
def greedy_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    chosen = ensemble.greedy(_models(spark, sf), ["p0", "p1", "p2"], "y", 4)
    return spark.createDataFrame(list(enumerate(chosen)), "place int, model string")


@query("drep_weights")
def drep_weights(spark: SparkSession, sf: str) -> DataFrame:
    found = ensemble.drep_weights(_models(spark, sf), ["p0", "p1", "p2"], "y")
    return spark.createDataFrame(list(found.items()), "model string, weight double")


_NOVEL = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("dominated_novelty", f"WITH p AS (SELECT vec_id AS ind_id, embedding, CAST(label * 100 + vec_id % 7 AS DOUBLE) AS fitness FROM embeddings), d AS (SELECT a.ind_id, b.ind_id AS other, 1.0 - {_NOVEL} / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d FROM p a JOIN p b ON b.fitness < a.fitness OR (b.fitness = a.fitness AND b.ind_id < a.ind_id)), r AS (SELECT *, row_number() OVER (PARTITION BY ind_id ORDER BY d, other) AS r FROM d) SELECT ind_id, {_q('coalesce(avg(d), -1.0)')} AS novelty FROM (SELECT ind_id FROM p) LEFT JOIN (SELECT * FROM r WHERE r <= 3) USING (ind_id) GROUP BY ind_id")
def dominated_novelty(spark: SparkSession, sf: str) -> DataFrame:
    generation = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("ind_id"), "embedding", (F.col("label") * 100 + F.col("vec_id") % 7).cast("double").alias("fitness"))
    out = ensemble.dominated_novelty(generation, "embedding", 3)
    return out.select("ind_id", _r(F.when(F.col("novelty") == float("inf"), -1.0).otherwise(F.col("novelty"))).alias("novelty"))


@query("ensemble_importance", f"WITH g AS (SELECT p_type AS hash, min(struct_pack(s := p_size, b := p_brand)).b AS gene, sum(abs(p_retailprice - 950.0) * 0.1) AS v FROM part GROUP BY p_type) SELECT gene, {_q('v / sum(v) OVER ()')} AS importance FROM g")
def ensemble_importance(spark: SparkSession, sf: str) -> DataFrame:
    genes = _t(spark, sf, "part").select(F.col("p_type").alias("hash"), F.col("p_brand").alias("gene"), F.col("p_size").alias("gene_size"), (F.col("p_retailprice") - 950.0).alias("coef"), F.lit(0.1).alias("weight"))
    return importance.ensemble_importance(genes).select("gene", _r(F.col("importance")).alias("importance"))


@query("most_redundant", f"SELECT 'l_discount' AS one, 'l_tax' AS two, {_q('corr(l_discount, l_tax)')} AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', {_q('corr(l_quantity, l_discount)')} FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', {_q('corr(l_quantity, l_tax)')} FROM lineitem")
def most_redundant(spark: SparkSession, sf: str) -> DataFrame:
    return importance.most_redundant(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).select("one", "two", _r(F.col("r")).alias("r"))


@query("linear_shap")
def linear_shap(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "lineitem")
    return importance.linear_shap(df, linear.ridge(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))


@query("mean_replacement_importance")
def mean_replacement_importance(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "lineitem")
    return importance.mean_replacement(df, linear.ridge(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "l_extendedprice")


@query("residual_match", f"WITH c AS (SELECT 'l_quantity' AS \"column\", corr(l_extendedprice, l_quantity) AS r FROM lineitem UNION ALL SELECT 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem UNION ALL SELECT 'l_tax', corr(l_extendedprice, l_tax) FROM lineitem) SELECT \"column\", {_q('r')} AS r FROM c ORDER BY abs(c.r) DESC LIMIT 1")
def residual_match(spark: SparkSession, sf: str) -> DataFrame:
    return importance.residual_match(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).select("column", _r(F.col("r")).alias("r"))


# --- time series and sampling ---------------------------------------------------------------------------------------------

_SERIES = "SELECT event_type AS s, CAST(ts AS DATE) AS t, round(sum(value), 2) AS y FROM events GROUP BY ALL"


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").groupBy(F.col("event_type").alias("s"), F.to_date("ts").alias("t")).agg(F.round(F.sum("value"), 2).alias("y"))


@query("ts_lags", f"SELECT * FROM (SELECT s, t, y, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 3) OVER w AS lag_3 FROM ({_SERIES}) WINDOW w AS (PARTITION BY s ORDER BY t)) WHERE lag_3 IS NOT NULL")
def ts_lags(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.lags(_series(spark, sf), ["s"], "t", "y", 3)


@query("ts_increments", f"SELECT s, t, {_q('y - lag(y) OVER (PARTITION BY s ORDER BY t)', 4)} AS increment FROM ({_SERIES})")
def ts_increments(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.increments(_series(spark, sf), ["s"], "t", "y").select("s", "t", _r(F.col("increment"), 4).alias("increment"))


@query("ts_interpolate", f"WITH t AS (SELECT s, t, y, lead(y) OVER (PARTITION BY s ORDER BY t) AS n FROM ({_SERIES})), p AS (SELECT *, unnest(CASE WHEN n IS NULL THEN [0] ELSE [0, 1, 2] END) AS step FROM t) SELECT s, t, CAST(step AS INTEGER) AS step, {_q('CASE WHEN step = 0 THEN y ELSE y + (n - y) * step / 3.0 END', 4)} AS value FROM p")
def ts_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    out = timeseries.interpolate(_series(spark, sf), ["s"], "t", "y", 2)
    return out.select("s", "t", "step", _r(F.col("value"), 4).alias("value"))


@query("ts_reconstruct", f"SELECT s, t, {_q('y', 3)} AS value FROM ({_SERIES})")
def ts_reconstruct(spark: SparkSession, sf: str) -> DataFrame:
    inc = timeseries.increments(_series(spark, sf), ["s"], "t", "y")
    start = F.first("y").over(W.partitionBy("s").orderBy("t"))
    return timeseries.reconstruct(inc, ["s"], "t", "increment", start).select("s", "t", _r(F.col("value"), 3).alias("value"))


@query("ts_moving_average", f"SELECT s, t, {_q('avg(y) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 4)} AS moving_average FROM ({_SERIES})")
def ts_moving_average(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.moving_average(_series(spark, sf), ["s"], "t", "y", 3).select("s", "t", _r(F.col("moving_average"), 4).alias("moving_average"))


@query("ts_running_moments", f"SELECT s, t, {_q('avg(y) OVER w', 3)} AS running_mean, {_q('var_pop(y) OVER w', 1)} AS running_var FROM ({_SERIES}) WINDOW w AS (PARTITION BY s ORDER BY t)")
def ts_running_moments(spark: SparkSession, sf: str) -> DataFrame:
    out = timeseries.running_moments(_series(spark, sf), ["s"], "t", "y")
    return out.select("s", "t", _r(F.col("running_mean"), 3).alias("running_mean"), _r(F.col("running_var"), 1).alias("running_var"))


@query("ts_forecast", f"WITH l AS (SELECT s, y, lag(y) OVER w AS y1, row_number() OVER (PARTITION BY s ORDER BY t DESC) AS r FROM ({_SERIES}) WINDOW w AS (PARTITION BY s ORDER BY t)), f AS (SELECT s, 0.6 * y + 0.3 * y1 + 2.0 AS f1, y FROM l WHERE r = 1) SELECT s, {_q('f1', 3)} AS f1, {_q('0.6 * f1 + 0.3 * y + 2.0', 3)} AS f2 FROM f")
def ts_forecast(spark: SparkSession, sf: str) -> DataFrame:
    last = timeseries.lags(_series(spark, sf), ["s"], "t", "y", 1).groupBy("s").agg(F.max_by(F.array("y", "lag_1"), "t").alias("lags"))
    return timeseries.forecast(last, [0.6, 0.3], 2.0, 2).select("s", _r(F.get("forecast", F.lit(0)), 3).alias("f1"), _r(F.get("forecast", F.lit(1)), 3).alias("f2"))


@query("sample_mini_batch", "SELECT c_custkey FROM customer WHERE (c_custkey - 800 % (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer)) % (SELECT count(*) FROM customer) < 32")
def sample_mini_batch(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer")
    return sampling.mini_batch(df, "c_custkey", 100, df.count()).select("c_custkey")


@query("sample_equal_width", "WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), b AS (SELECT c_custkey, CAST(least(floor((c_acctbal - lo) / (hi - lo) * 10), 9) AS INTEGER) AS bin FROM customer, r) SELECT c_custkey, bin FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY c_custkey) AS n FROM b) WHERE n <= 5")
def sample_equal_width(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.equal_width_sample(_t(spark, sf, "customer"), "c_acctbal", "c_custkey", 10, 5).select("c_custkey", "bin")


@query("sample_split")
def sample_split(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select(sampling.split("c_custkey", {"train": 80, "valid": 10, "test": 10}).alias("part")).groupBy("part").count()


@query("sample_mixup")
def sample_mixup(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer")
    return sampling.mixup(df, "c_custkey", ["c_acctbal"], df.count())


# --- the estimator ----------------------------------------------------------------------------------------------------


def _forest(spark: SparkSession, sf: str) -> tuple[FeatureForest, DataFrame]:
    df = _t(spark, sf, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS p_size", "p_retailprice", "sin(p_size) * p_size + p_retailprice * 0.01 AS y")
    forest = FeatureForest(primitives="optimal", population=6, generations=1, genes=2, depth=2, ensemble=3)
    return forest.fit(df, ["p_size", "p_retailprice"], "y", "p_partkey"), df


@query("forest_predict")
def forest_predict(spark: SparkSession, sf: str) -> DataFrame:
    forest, df = _forest(spark, sf)
    return forest.predict(df).select("p_partkey", "y", "prediction")


@query("forest_transform")
def forest_transform(spark: SparkSession, sf: str) -> DataFrame:
    forest, df = _forest(spark, sf)
    return forest.transform(df)


@query("forest_importance")
def forest_importance(spark: SparkSession, sf: str) -> DataFrame:
    forest, _ = _forest(spark, sf)
    return spark.createDataFrame(list(forest.importance().items()), "gene string, importance double")


# --- complexity, learners and retrieval ---------------------------------------------------------------------------------


@query("complexity_tikhonov", f"WITH t AS ({_XY}) SELECT {_q('sqrt(sum(y * y))')} AS tikhonov FROM t")
def complexity_tikhonov(spark: SparkSession, sf: str) -> DataFrame:
    return complexity.tikhonov(_xy(spark, sf), "y").select(_r(F.col("tikhonov")).alias("tikhonov"))


@query("complexity_sharpness", f"WITH t AS ({_XY}) SELECT {_q('avg(greatest((y - y * 1.1) * (y - y * 1.1), (y - sin(x)) * (y - sin(x))))')} AS sharpness FROM t")
def complexity_sharpness(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("y")
    return complexity.sharpness(_xy(spark, sf), y, [y * F.lit(1.1), F.sin("x")]).select(_r(F.col("sharpness")).alias("sharpness"))


@query("complexity_rademacher")
def complexity_rademacher(spark: SparkSession, sf: str) -> DataFrame:
    return complexity.rademacher(_xy(spark, sf), "y", "c_custkey")


@query("complexity_igci", f"WITH t AS ({_XY}), u AS (SELECT c_custkey, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y FROM t), d AS (SELECT x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM u WINDOW w AS (ORDER BY x, c_custkey)) SELECT {_q('avg(ln(abs(dy / dx)))', 5)} AS igci FROM d WHERE dx <> 0 AND dy <> 0")
def complexity_igci(spark: SparkSession, sf: str) -> DataFrame:
    return complexity.igci(_xy(spark, sf), "x", "y", "c_custkey").select(_r(F.col("igci"), 5).alias("igci"))


@query("learner_tree_cross_validation")
def learner_tree_cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    out = learners.cross_val(_xy(spark, sf), ["x"], "y", (F.col("c_custkey") % 3).cast("int"), 3)
    return out.select("c_custkey", "fold", "prediction")


@query("learner_logistic")
def learner_logistic(spark: SparkSession, sf: str) -> DataFrame:
    rows = _xy(spark, sf).withColumn("c", (F.col("y") > 1).cast("int"))
    return learners.classify(rows, rows, ["x"], "c").select("c_custkey", "prediction", F.get("probabilities", F.lit(1)).alias("p1"))


@query("kmeans_bins")
def kmeans_bins(spark: SparkSession, sf: str) -> DataFrame:
    return learners.kmeans_bins(_xy(spark, sf), "x", 4, "bin").select("c_custkey", "bin")


@query("pca_scaled")
def pca_scaled(spark: SparkSession, sf: str) -> DataFrame:
    rows = scaling.standard(_xy(spark, sf), ["x", "y"]).apply(_xy(spark, sf))
    return learners.pca(rows, ["x", "y"], 2).select("c_custkey", "pc0", "pc1")


_QUERY_VECTOR = [float((i * 7) % 11) - 5.0 for i in range(64)]


@query(
    "nearest_semantics",
    f"""WITH q AS (SELECT {_QUERY_VECTOR!r}::DOUBLE[] AS q), c AS (SELECT list_transform(q, lambda x: x - list_avg(q)) AS q FROM q),
        v AS (SELECT vec_id AS tree, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x - list_avg(CAST(embedding AS DOUBLE[]))) AS v FROM embeddings),
        d AS (SELECT tree, abs(list_dot_product(v, q)) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)) AS r FROM v, c)
        SELECT tree, {_q("sqrt(greatest(2.0 - 2.0 * r, 0.0))")} AS distance FROM d ORDER BY 2.0 - 2.0 * r, tree LIMIT 10""",
)
def nearest_semantics(spark: SparkSession, sf: str) -> DataFrame:
    library = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("tree"), F.lit(1).alias("size"), F.col("embedding").alias("semantics"))
    return retrieval.nearest_trees(library, _QUERY_VECTOR, 10).select("tree", _r(F.col("distance")).alias("distance"))


@query("stage_order")
def stage_order(spark: SparkSession, sf: str) -> DataFrame:
    chosen = retrieval.stage_order(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 3)
    return spark.createDataFrame(list(enumerate(chosen)), "place int, feature string")


# --- scores, scalers and selection of later rounds --------------------------------------------------------------------

_TYPES = "SELECT p_type, p_size, p_retailprice FROM part"


@query("scale_skew", f"WITH s AS (SELECT skewness(value) AS k, min(value) AS lo, count(*) AS n FROM events), g AS (SELECT k * (n - 2) / sqrt(n * (n - 1.0)) AS k, lo FROM s) SELECT event_id, {_q('CASE WHEN k > 0.5 THEN sqrt(value - lo) WHEN k < -0.5 THEN (value - lo) * (value - lo) ELSE value END', 4)} AS value FROM events, g")
def scale_skew(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "events").select("event_id", "value")
    return scaling.skew(df, ["value"]).apply(df).select("event_id", _r(F.col("value"), 4).alias("value"))


@query("scale_quantile_uniform", f"WITH g AS (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM orders), t AS (SELECT o_orderkey, o_totalprice AS x, g.e AS e, len(list_filter(g.e, lambda v: v <= o_totalprice)) AS b FROM orders, g) SELECT o_orderkey, {_q('CASE WHEN b <= 0 THEN 0.0 WHEN b >= 11 THEN 1.0 ELSE (b - 1 + (x - e[b]) / (e[b + 1] - e[b])) / 10.0 END', 5)} AS u FROM t")
def scale_quantile_uniform(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("u"))
    return scaling.quantile_uniform(df, "u", 11).apply(df).select("o_orderkey", _r(F.col("u"), 5).alias("u"))


@query("scale_std_min_max", f"SELECT c_custkey, {_q('(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER ()')} AS s, {_q('(c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ())')} AS m FROM customer")
def scale_std_min_max(spark: SparkSession, sf: str) -> DataFrame:
    out = scaling.std_and_min_max(_t(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return out.select("c_custkey", _r(F.col("c_acctbal_std")).alias("s"), _r(F.col("c_acctbal_mm")).alias("m"))


@query("scale_one_hot_standard", f"WITH t AS (SELECT c_custkey, CAST(c_custkey % 2 AS DOUBLE) AS flag, c_acctbal AS x FROM customer) SELECT c_custkey, {_q('flag')} AS flag, {_q('(x - avg(x) OVER ()) / stddev_pop(x) OVER ()')} AS x FROM t")
def scale_one_hot_standard(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 2).cast("double").alias("flag"), F.col("c_acctbal").alias("x"))
    return scaling.one_hot_standard(df, ["flag", "x"]).apply(df).select("c_custkey", _r(F.col("flag")).alias("flag"), _r(F.col("x")).alias("x"))


@query("scale_whole_targets", f"WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT p_partkey, {_q('greatest(least(round_even(p_retailprice / 17.3 - 10.0, 0), hi), lo)')} AS p_size FROM part, b")
def scale_whole_targets(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "part")
    guesses = df.select("p_partkey", (F.col("p_retailprice") / F.lit(17.3) - 10.0).alias("p_size"))
    return scaling.whole_targets(df, "p_size").apply(guesses).select("p_partkey", _r(F.col("p_size")).alias("p_size"))


@query("scale_unscaled", f"SELECT c_custkey, {_q('c_acctbal')} AS x FROM customer")
def scale_unscaled(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    return scaling.unscaled(["x"]).apply(df).select("c_custkey", _r(F.col("x")).alias("x"))


@query("layer_and_clip", f"SELECT l_orderkey, {_q('sum(0.5 * l_quantity - 2.0 * l_discount + 3.0)', 4)} AS layer, {_q('sum(greatest(least(l_quantity, 40.0), 10.0))', 4)} AS clipped FROM lineitem GROUP BY ALL")
def layer_and_clip(spark: SparkSession, sf: str) -> DataFrame:
    layer = scaling.linear_layer([F.col("l_quantity"), F.col("l_discount")], [0.5, -2.0], 3.0)
    out = _t(spark, sf, "lineitem").groupBy("l_orderkey")
    return out.agg(_r(F.sum(layer), 4).alias("layer"), _r(F.sum(scaling.clip(F.col("l_quantity"), 10, 40)), 4).alias("clipped"))


_PROBS = "WITH t AS (SELECT c_custkey, CAST(c_custkey % 3 AS INTEGER) AS y, 0.2 + CAST(c_nationkey % 4 AS DOUBLE) / 10 AS a, 0.1 + CAST(c_custkey % 4 AS DOUBLE) / 10 AS b FROM customer), u AS (SELECT c_custkey, y, a / (a + b + 0.3) AS p0, b / (a + b + 0.3) AS p1, 0.3 / (a + b + 0.3) AS p2 FROM t)"


@query("class_losses", f"{_PROBS} SELECT c_custkey, CASE WHEN y = (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS zero_one, {_q('-ln(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-8))')} AS cross_entropy FROM u")
def class_losses(spark: SparkSession, sf: str) -> DataFrame:
    t = _t(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 3).cast("int").alias("y"), (F.lit(0.2) + (F.col("c_nationkey") % 4).cast("double") / 10).alias("a"), (F.lit(0.1) + (F.col("c_custkey") % 4).cast("double") / 10).alias("b"))
    whole = F.col("a") + F.col("b") + F.lit(0.3)
    p = F.array(F.col("a") / whole, F.col("b") / whole, F.lit(0.3) / whole)
    return t.select("c_custkey", metrics.zero_one(F.col("y"), p).alias("zero_one"), _r(metrics.cross_entropy(F.col("y"), p)).alias("cross_entropy"))


@query("task_r2", f"WITH t AS (SELECT c_nationkey, {_YP} FROM customer), r AS (SELECT 1.0 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)) AS r2 FROM t GROUP BY c_nationkey HAVING var_pop(y) > 0) SELECT {_q('avg(r2)', 4)} AS task_r2 FROM r")
def task_r2(spark: SparkSession, sf: str) -> DataFrame:
    df = _yp(spark, sf).join(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return metrics.task_r2(df, "y", "p", "c_nationkey").select(_r(F.col("task_r2"), 4).alias("task_r2"))


@query("sized_scores", f"SELECT p_partkey, {_q('p_retailprice / 1000.0 - 0.01 * p_size')} AS by_size, {_q('p_retailprice / 1000.0 - 0.05 * (p_partkey % 7)')} AS by_features FROM part")
def sized_scores(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("p_retailprice") / F.lit(1000.0)
    return _t(spark, sf, "part").select("p_partkey", _r(metrics.sized_score(score, F.col("p_size"))).alias("by_size"), _r(metrics.sized_score(score, F.col("p_partkey") % 7, 0.05)).alias("by_features"))


@query("cv_gap", f"WITH t AS (SELECT c_custkey, {_YP} FROM customer) SELECT {_q('avg((y - p) * (y - p))', 4)} AS train, {_q('avg((y - 0.9 * p) * (y - 0.9 * p))', 4)} AS cross_err, {_q('avg((y - 0.9 * p) * (y - 0.9 * p)) - avg((y - p) * (y - p))', 4)} AS gap FROM t")
def cv_gap(spark: SparkSession, sf: str) -> DataFrame:
    df = _yp(spark, sf).withColumn("q", F.lit(0.9) * F.col("p"))
    return complexity.cv_gap(df, "y", "p", "q").select(_r(F.col("train"), 4).alias("train"), _r(F.col("cross"), 4).alias("cross_err"), _r(F.col("gap"), 4).alias("gap"))


@query("pac_kl_term", f"WITH t AS (SELECT sqrt(sum(l_tax * l_tax)) AS norm, count(*) AS n FROM lineitem) SELECT {_q('4 * sqrt((norm * norm / (2 * 0.01) + ln(2 * n / 0.1)) / n)')} AS kl FROM t")
def pac_kl_term(spark: SparkSession, sf: str) -> DataFrame:
    norm, n = _t(spark, sf, "lineitem").agg(F.sqrt(F.sum(F.col("l_tax") * F.col("l_tax"))), F.count(F.lit(1))).first()
    return spark.createDataFrame([(complexity.kl_term(norm, 0.1, n),)], "kl double").select(_r(F.col("kl")).alias("kl"))


@query("top_by_quantile", f"WITH g AS (SELECT p_type AS gene, sum(p_retailprice) AS importance FROM part GROUP BY p_type) SELECT gene, {_q('importance', 2)} AS importance FROM g WHERE importance >= (SELECT quantile_cont(importance, 0.6) FROM g)")
def top_by_quantile(spark: SparkSession, sf: str) -> DataFrame:
    scores = _t(spark, sf, "part").groupBy(F.col("p_type").alias("gene")).agg(F.sum("p_retailprice").alias("importance"))
    return importance.top_by_quantile(scores, 0.4).select("gene", _r(F.col("importance"), 2).alias("importance"))


@query("library_evict", "SELECT p_partkey AS tree, p_size AS size FROM part ORDER BY p_partkey % 13 DESC, p_size, p_partkey LIMIT 20")
def library_evict(spark: SparkSession, sf: str) -> DataFrame:
    library = _t(spark, sf, "part").select(F.col("p_partkey").alias("tree"), F.col("p_size").alias("size"), (F.col("p_partkey") % 13).alias("used"))
    return retrieval.evict(library, 20).select("tree", "size")


@query("library_smallest", "WITH t AS (SELECT vec_id AS tree, vec_id % 5 AS size, label AS s FROM embeddings) SELECT tree, size FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY size, tree) AS r FROM t) WHERE r = 1")
def library_smallest(spark: SparkSession, sf: str) -> DataFrame:
    own = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (i == F.col("label")).cast("double"))
    library = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("tree"), (F.col("vec_id") % 5).alias("size"), own.alias("semantics"))
    return retrieval.smallest_per_semantics(library).select("tree", "size")


@query("impute", f"WITH t AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS x, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS s FROM customer) SELECT c_custkey, {_q('coalesce(x, avg(x) OVER ())', 4)} AS x, coalesce(s, 'missing') AS seg FROM t")
def impute(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("x"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("seg"))
    return encoding.impute(df, df, ["x"], ["seg"]).select("c_custkey", _r(F.col("x"), 4).alias("x"), "seg")


@query("p_lexicase_wins", f"WITH t AS ({_LOSS}), m AS (SELECT *, median(loss) OVER (PARTITION BY row_id) AS m, min(loss) OVER (PARTITION BY row_id) AS l FROM t), d AS (SELECT *, median(abs(loss - m)) OVER (PARTITION BY row_id) AS d FROM m) SELECT ind_id, CAST(count(*) FILTER (loss <= l + d) AS BIGINT) AS wins FROM d GROUP BY ind_id")
def p_lexicase_wins(spark: SparkSession, sf: str) -> DataFrame:
    return selection.p_lexicase_wins(_losses(spark, sf))


@query("normalised_objectives", f"SELECT p_partkey AS ind_id, {_q('(p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())')} AS fitness, {_q('(p_size - min(p_size) OVER ()) / CAST(max(p_size) OVER () - min(p_size) OVER () AS DOUBLE)')} AS size FROM part")
def normalised_objectives(spark: SparkSession, sf: str) -> DataFrame:
    out = selection.normalised_objectives(_population(spark, sf), ["fitness", "size"])
    return out.select("ind_id", _r(F.col("fitness")).alias("fitness"), _r(F.col("size")).alias("size"))


@query("parent_angles", f"WITH t AS (SELECT ind_id, row_id, loss - 5000.0 AS e FROM ({_LOSS})), o AS (SELECT row_id, e AS own FROM t WHERE ind_id = 3) SELECT ind_id, {_q('sum(e * own) / sqrt(sum(e * e) * sum(own * own))')} AS cosine FROM t JOIN o USING (row_id) WHERE ind_id <> 3 GROUP BY ind_id")
def parent_angles(spark: SparkSession, sf: str) -> DataFrame:
    residuals = _losses(spark, sf).select("ind_id", "row_id", (F.col("loss") - 5000.0).alias("residual"))
    return selection.angles(residuals, 3).select("ind_id", _r(F.col("cosine")).alias("cosine"))


@query("curriculum_tiers", f"WITH m AS (SELECT row_id, avg(loss) AS mean FROM ({_LOSS}) GROUP BY row_id) SELECT row_id, CAST(ntile(4) OVER (ORDER BY mean, row_id) - 1 AS INTEGER) AS tier FROM m")
def curriculum_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return selection.curriculum_tiers(_losses(spark, sf), 4)


@query("knn_auto_k_linear", f"WITH {_NEAR}, r AS (SELECT rk, query_id, ((rk + 1) * sum(y) OVER w - sum(rk * y) OVER w) / (rk * (rk + 1) / 2.0) AS p FROM k WINDOW w AS (PARTITION BY query_id ORDER BY rk)), j AS (SELECT rk, CAST(p AS DOUBLE) AS p, label AS own FROM r JOIN embeddings ON query_id = vec_id) SELECT CAST(rk AS INTEGER) AS k, {_q('1.0 - sum((own - p) * (own - p)) / (count(*) * var_pop(own))')} AS r2 FROM j GROUP BY rk")
def knn_auto_k_linear(spark: SparkSession, sf: str) -> DataFrame:
    near, df = _neighbours(spark, sf)
    return knn.auto_k_linear(near, df, "vec_id", "label").select("k", _r(F.col("r2")).alias("r2"))


@query("knn_auto_k_predict", f"WITH {_NEAR}, r AS (SELECT rk, query_id, avg(y) OVER (PARTITION BY query_id ORDER BY rk) AS p FROM k), j AS (SELECT rk, p, label AS own FROM r JOIN embeddings ON query_id = vec_id), s AS (SELECT rk, 1.0 - sum((own - p) * (own - p)) / (count(*) * var_pop(own)) AS r2 FROM j GROUP BY rk), b AS (SELECT rk, r2 FROM s ORDER BY r2 DESC, rk LIMIT 1) SELECT query_id, {_q('CASE WHEN b.r2 > 0 THEN r.p ELSE (SELECT avg(label) FROM embeddings) END')} AS prediction FROM r, b WHERE r.rk = b.rk")
def knn_auto_k_predict(spark: SparkSession, sf: str) -> DataFrame:
    near, df = _neighbours(spark, sf)
    return knn.auto_k_predict(near, df, "vec_id", "label").select("query_id", _r(F.col("prediction")).alias("prediction"))


@query("bounded_regression", f"WITH t AS ({_XY}), m AS (SELECT covar_pop(x, y) / var_pop(x) AS b, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS a, min(y) AS lo, max(y) AS hi FROM t) SELECT c_custkey, {_q('greatest(least(a + b * x, hi), lo)', 4)} AS p FROM t, m")
def bounded_regression(spark: SparkSession, sf: str) -> DataFrame:
    df = _xy(spark, sf)
    return df.select("c_custkey", _r(linear.bounded(linear.linear_scaling(df, "x", "y").column(), df, "y"), 4).alias("p"))


# --- learnt metrics, local models, coresets ------------------------------------------------------------------------

_PART_Z = "p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a0, CAST(p_retailprice AS DOUBLE) AS b0, CAST(p_partkey % 13 AS DOUBLE) + p_size / 7.0 AS y FROM part), z AS (SELECT id, (a0 - avg(a0) OVER ()) / stddev_pop(a0) OVER () AS a, (b0 - avg(b0) OVER ()) / stddev_pop(b0) OVER () AS b, y FROM p)"
_PART_FEATURES = ["p_size", "p_retailprice"]


def _part_target(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").withColumn("y", (F.col("p_partkey") % 13).cast("double") + F.col("p_size") / F.lit(7.0))


_PAIR = "SELECT s.a - t.a AS a, s.b - t.b AS b, abs(s.y - t.y) AS d FROM z s JOIN z t ON s.id <> t.id"


@query("metric_pair_moments", f"WITH {_PART_Z}, d AS ({_PAIR}), m AS (SELECT avg(a * a * d) AS ta, avg(a * b * d) AS tb, avg(b * b * d) AS tc, avg(a * a * a * a) AS faa, avg(a * a * a * b) AS fab, avg(a * a * b * b) AS fac, avg(a * b * b * b) AS fbc, avg(b * b * b * b) AS fcc FROM d) SELECT pair, {_q('t')} AS target, {_q('f0')} AS with_aa, {_q('f1')} AS with_ab, {_q('f2')} AS with_bb FROM (SELECT 'aa' AS pair, ta AS t, faa AS f0, fab AS f1, fac AS f2 FROM m UNION ALL SELECT 'ab', tb, fab, fac, fbc FROM m UNION ALL SELECT 'bb', tc, fac, fbc, fcc FROM m)")
def metric_pair_moments(spark: SparkSession, sf: str) -> DataFrame:
    m = pair_metric.pair_moments(_part_target(spark, sf), _PART_FEATURES, "y")
    rows = [(pair, float(t), *map(float, f)) for pair, t, f in zip(("aa", "ab", "bb"), m.target, m.fourth, strict=True)]
    names = ("target", "with_aa", "with_ab", "with_bb")
    out = spark.createDataFrame(rows, f"pair string, {', '.join(f'{n} double' for n in names)}")
    return out.select("pair", *(_r(F.col(n)).alias(n) for n in names))


@query("similarity_moments", f"WITH {_PART_Z}, g AS (SELECT 1.0 / var_pop(y) AS g FROM z), w AS (SELECT s.a AS a, s.b AS b, t.a AS a2, t.b AS b2, exp(-g * (s.y - t.y) * (s.y - t.y)) AS s FROM z s, z t, g) SELECT pair, {_q('n', 3)} AS near, {_q('w', 3)} AS whole FROM (SELECT 'aa' AS pair, sum(s * a * a2) AS n, sum(s * a * a) AS w FROM w UNION ALL SELECT 'ab', sum(s * a * b2), sum(s * a * b) FROM w UNION ALL SELECT 'bb', sum(s * b * b2), sum(s * b * b) FROM w)")
def similarity_moments(spark: SparkSession, sf: str) -> DataFrame:
    near, whole, *_ = pair_metric.similarity_moments(_part_target(spark, sf), _PART_FEATURES, "y")
    rows = [(pair, float(near[i]), float(whole[i])) for pair, i in (("aa", (0, 0)), ("ab", (0, 1)), ("bb", (1, 1)))]
    return spark.createDataFrame(rows, "pair string, near double, whole double").select("pair", _r(F.col("near"), 3).alias("near"), _r(F.col("whole"), 3).alias("whole"))


@query("pls_scores", f"WITH {_PART_Z}, c AS (SELECT covar_pop(a, y) AS ca, covar_pop(b, y) AS cb FROM z) SELECT id AS p_partkey, {_q('(a * ca + b * cb) / sqrt(ca * ca + cb * cb)')} AS score FROM z, c")
def pls_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = _part_target(spark, sf)
    first = pair_metric.partial_least_squares(df, _PART_FEATURES, "y", dimensions=1)
    return df.select("p_partkey", _r(first.column()[0]).alias("score"))


@query("metric_knn")
def metric_knn(spark: SparkSession, sf: str) -> DataFrame:
    df = _part_target(spark, sf)
    metric = pair_metric.learnt_metric(df, _PART_FEATURES, "y")
    return pair_metric.projected_predict(df.where("p_partkey % 20 = 0"), df, metric, "y", "p_partkey").select("query_id", _r(F.col("prediction")).alias("prediction"))


@query("lpp_knn")
def lpp_knn(spark: SparkSession, sf: str) -> DataFrame:
    df = _part_target(spark, sf)
    metric = pair_metric.locality_preserving(df, _PART_FEATURES, "y")
    return pair_metric.projected_predict(df.where("p_partkey % 20 = 0"), df, metric, "y", "p_partkey").select("query_id", _r(F.col("prediction")).alias("prediction"))


@query("ridge_boosted_knn")
def ridge_boosted_knn(spark: SparkSession, sf: str) -> DataFrame:
    df = _part_target(spark, sf)
    return pair_metric.ridge_boosted_predict(df.where("p_partkey % 20 = 0"), df, _PART_FEATURES, "y", "p_partkey").select("query_id", _r(F.col("prediction")).alias("prediction"))


_LOCAL_FITS = """WITH c AS (SELECT c_custkey AS id, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer),
    r AS (SELECT q.id, q.y, d.x - q.x AS dx, d.y - q.y AS dy, d.y AS ny, row_number() OVER (PARTITION BY q.id ORDER BY (d.x - q.x) * (d.x - q.x), d.id) AS rk FROM c q JOIN c d ON q.id <> d.id),
    n AS (SELECT id, y, dx, dy, ny, median(ny) OVER (PARTITION BY id) AS m FROM r WHERE rk <= 5),
    g AS (SELECT id, count(*) AS n, sum(dx) AS sx, sum(dx * dx) AS sxx, sum(dy) AS sy, sum(dx * dy) AS sxy, median(abs(ny - m)) AS spread FROM n GROUP BY id),
    f AS (SELECT id, abs(((sxx + e) * sy - sx * sxy) / ((n + e) * (sxx + e) - sx * sx)) AS residual, spread FROM (SELECT *, 1e-10 * (n + sxx) / 2 AS e FROM g))"""


@query("local_fits", f"{_LOCAL_FITS} SELECT id AS c_custkey, {_q('residual', 4)} AS residual, {_q('spread', 4)} AS spread FROM f")
def local_fits(spark: SparkSession, sf: str) -> DataFrame:
    out = local_models.local_fits(*_local(spark, sf), "c_custkey", ["c_acctbal"], "c_nationkey")
    return out.select(F.col("query_id").alias("c_custkey"), _r(F.col("residual"), 4).alias("residual"), _r(F.col("spread"), 4).alias("spread"))


def _local(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = _t(spark, sf, "customer")
    rows = df.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal").cast("double")).alias("v"))
    return df, knn.knn(rows, rows, 5, "id", "v")


@query("nonlinearity_weights", f"{_LOCAL_FITS}, o AS (SELECT median(abs(y - (SELECT avg(y) FROM c))) AS o FROM c), m AS (SELECT id, residual / ((CASE WHEN spread > 1e-10 THEN spread ELSE o END) + 1e-10) AS miss FROM f, o), d AS (SELECT id, miss - median(miss) OVER () AS away FROM m), s AS (SELECT median(abs(away)) AS s FROM d), w AS (SELECT id, pow(greatest(greatest(least(away, 2.5 * s), -2.5 * s) + 1.5 * s, 1e-10), 0.75) AS w FROM d, s) SELECT id AS c_custkey, {_q('1000.0 * w / sum(w) OVER ()', 4)} AS permille FROM w")
def nonlinearity_weights(spark: SparkSession, sf: str) -> DataFrame:
    out = local_models.nonlinearity_weights(*_local(spark, sf), "c_custkey", ["c_acctbal"], "c_nationkey")
    return out.select(F.col("query_id").alias("c_custkey"), _r(F.lit(1000.0) * F.col("weight"), 4).alias("permille"))


def _farthest_sql(k: int) -> str:
    """The greedy choice, one step of it a table."""
    gap = "list_distance(CAST(v AS DOUBLE[]), CAST(w AS DOUBLE[]))"
    steps = ["e AS (SELECT vec_id AS id, embedding AS v FROM embeddings)", "c1 AS (SELECT id, v AS w, CAST(NULL AS DOUBLE) AS d FROM e ORDER BY id LIMIT 1)", f"l1 AS (SELECT e.id, v, CASE WHEN e.id = c1.id THEN -1 ELSE {gap} END AS far FROM e, c1)"]
    for s in range(2, k + 1):
        steps.append(f"c{s} AS (SELECT id, v AS w, far AS d FROM l{s - 1} ORDER BY far DESC, id LIMIT 1)")
        steps.append(f"l{s} AS (SELECT l.id, v, CASE WHEN l.id = c{s}.id THEN -1 ELSE least(far, {gap}) END AS far FROM l{s - 1} l, c{s})")
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(f'SELECT id, CAST({s} AS INTEGER) AS rk, CASE WHEN d IS NOT NULL THEN round(d, 6) END AS distance FROM c{s}' for s in range(1, k + 1))}"


@query("farthest_first", _farthest_sql(8))
def farthest_first(spark: SparkSession, sf: str) -> DataFrame:
    return coresets.farthest_first(_t(spark, sf, "embeddings"), 8).select("id", "rk", F.round("distance", 6).alias("distance"))


@query("decayed_moments", f"WITH r AS (SELECT user_id, value AS x, pow(0.9, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1) AS w FROM events WHERE value IS NOT NULL), m AS (SELECT user_id, sum(w * x) / sum(w) AS mean FROM r GROUP BY user_id) SELECT r.user_id, {_q('sum(w)')} AS n, {_q('any_value(mean)', 4)} AS mean, {_q('sum(w * (x - mean) * (x - mean)) / sum(w)', 3)} AS var, count(*) AS rows FROM r JOIN m ON r.user_id IS NOT DISTINCT FROM m.user_id GROUP BY r.user_id")
def decayed_moments(spark: SparkSession, sf: str) -> DataFrame:
    out = decayed.decayed_moments(_t(spark, sf, "events"), "user_id", "ts", "event_id", "value", 0.9)
    return out.select("user_id", _r(F.col("n")).alias("n"), _r(F.col("mean"), 4).alias("mean"), _r(F.col("var"), 3).alias("var"), "rows")


# --- Voronoi archives -------------------------------------------------------------------------------------------------

_CELLS, _ROUNDS = 6, 2


def _voronoi_sql() -> str:
    """The embeddings' directions e, farthest-first starts, rounds of means, and each row's last cell in n<rounds + 1>."""
    steps = ["e AS MATERIALIZED (SELECT id, [x / sqrt(list_dot_product(v, v)) for x in v] AS v, fitness FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label * 100 + vec_id % 7 AS DOUBLE) AS fitness FROM embeddings))", "c1 AS MATERIALIZED (SELECT id, v AS w FROM e ORDER BY id LIMIT 1)", "l1 AS MATERIALIZED (SELECT e.id, v, CASE WHEN e.id = c1.id THEN -1 ELSE list_distance(v, w) END AS far FROM e, c1)"]
    for s in range(2, _CELLS + 1):
        steps.append(f"c{s} AS MATERIALIZED (SELECT id, v AS w FROM l{s - 1} ORDER BY far DESC, id LIMIT 1)")
        steps.append(f"l{s} AS MATERIALIZED (SELECT l.id, v, CASE WHEN l.id = c{s}.id THEN -1 ELSE least(far, list_distance(v, w)) END AS far FROM l{s - 1} l, c{s})")
    steps.append(f"a0 AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {s - 1} AS cell, w FROM c{s}' for s in range(1, _CELLS + 1))})")
    for r in range(1, _ROUNDS + 2):
        steps.append(f"n{r} AS MATERIALIZED (SELECT id, v, fitness, cell FROM (SELECT id, v, fitness, cell, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, w) DESC, cell) AS r FROM e, a{r - 1}) WHERE r = 1)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT cell, [x / sqrt(list_dot_product(s, s)) for x in s] AS w FROM (SELECT cell, list(x ORDER BY place) AS s FROM (SELECT cell, place, sum(x) AS x FROM (SELECT cell, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM n{r}) GROUP BY cell, place) GROUP BY cell))")
    return "WITH " + ", ".join(steps)


def _individuals(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("ind_id"), (F.col("label") * 100 + F.col("vec_id") % 7).cast("double").alias("fitness"), F.col("embedding").alias("vector"))


@query("voronoi_centres", f"{_voronoi_sql()} SELECT CAST(cell AS INTEGER) AS cell_id, CAST(place AS INTEGER) AS place_id, {_q('x')} AS x FROM (SELECT cell, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS place FROM a{_ROUNDS})")
def voronoi_centres(spark: SparkSession, sf: str) -> DataFrame:
    centres = voronoi.voronoi_centres(_individuals(spark, sf), _CELLS, rounds=_ROUNDS)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    return spark.createDataFrame(rows, "cell_id int, w array<double>").select("cell_id", F.posexplode("w").alias("place_id", "x")).select("cell_id", "place_id", _r(F.col("x")).alias("x"))


@query("voronoi_archive", f"{_voronoi_sql()} SELECT CAST(cell AS INTEGER) AS cell_id, id AS ind_id, fitness FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY fitness, id) AS r FROM n{_ROUNDS + 1}) WHERE r = 1")
def voronoi_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Three generations merged one by one into a stored archive; the SQL takes all individuals at once."""
    everyone = _individuals(spark, sf)
    archive = voronoi.VoronoiArchive(spark, scratch_path(spark, "archive")).create(voronoi.voronoi_centres(everyone, _CELLS, rounds=_ROUNDS))
    for generation in range(3):
        found = archive.merge(everyone.where(F.col("ind_id") % 3 == generation), generation)
    return found.select(F.col("cell").alias("cell_id"), "ind_id", "fitness")


@query("reclustered_archive")
def reclustered_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Two generations; the second's best and the first's elites are clustered anew."""
    everyone = _individuals(spark, sf)
    first = voronoi.reclustered_archive(everyone.where("ind_id % 2 = 0"), None, _CELLS, 100)
    return voronoi.reclustered_archive(everyone.where("ind_id % 2 = 1"), first, _CELLS, 100, mode="combined").select("ind_id", "fitness")


@query("voronoi_members")
def voronoi_members(spark: SparkSession, sf: str) -> DataFrame:
    df, members = _members(spark, sf)
    found = voronoi.voronoi_members(df, members, "y", 3)
    return spark.createDataFrame(list(enumerate(found, 1)), "rk int, member string")


@query("exact_quantiles", f"SELECT CAST(q * 100 AS INTEGER) AS q_id, {_q('x')} AS x FROM (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.77, 1.0]) AS q, unnest((SELECT quantile_cont(c_acctbal, [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]) FROM customer)) AS x)")
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = ordered.quantiles(_t(spark, sf, "customer"), "c_acctbal", (0.0, 0.1, 0.25, 0.5, 0.77, 1.0))
    return spark.createDataFrame([(round(q * 100), x) for q, x in found.items()], "q_id int, x double").select("q_id", _r(F.col("x")).alias("x"))

"""Genes to Spark columns and feature queries.

A feature query is one projection over the input, so column pruning and whole-stage code generation apply; group-by
primitives add a window each (statistics of the rows themselves) or, given fit_groups() of the training rows, a join with each
call's fitted table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions.primitives import GROUP_PRIMITIVES, get_primitive, sanitise

from .gene import Call, Col, Const, Node, key, parse

#: Keys with a larger share of distinct values are cut to bins, a fifth as many as rows.
BIN_RATIO = 0.2
#: Genes in one projection; more are split, as generated code has a size limit.
MAX_GENES = 200


def to_column(node: Node | str) -> Column:
    """The unsanitised column of a gene without group-by primitives."""
    node = parse(node) if isinstance(node, str) else node
    if isinstance(node, Const):
        return F.lit(node.value)
    if isinstance(node, Col):
        return F.col(f"`{node.name}`").cast("double")
    if node.name in GROUP_PRIMITIVES:
        raise ValueError(f"{node.name} needs its table; use features()")
    return get_primitive(node.name).build(*(to_column(a) for a in node.args))


@dataclass
class GroupFit:
    """What a group-by call learnt: how its key is cut, key and stat of every group, and the statistic for other groups.

    bins are the least and greatest key and the number of edges, or None where keys are taken as they are. without is
    true for a GroupByCount whose keys hardly repeat: it gives the key itself. The table reads the training rows each
    time it is used, until it is written (FeatureForest.save).
    """

    bins: tuple[float, float, int] | None
    table: DataFrame
    unseen: float | None
    without: bool = False


def _spread(df: DataFrame, value: Column) -> tuple[tuple[float, float, int] | None, bool]:
    """The bins of a key whose values hardly repeat, if it has more than one; and whether they hardly repeat."""
    n, distinct, low, high = df.select(value.alias("v")).agg(F.count(F.lit(1)), F.count_distinct("v"), F.min("v"), F.max("v")).first()
    sparse = bool(n) and distinct / n > BIN_RATIO
    return ((low, high, max(2, int(BIN_RATIO * n))) if sparse and low != high else None), sparse


def _cut(value: Column, bins: tuple[float, float, int] | None) -> Column:
    if bins is None:
        return value
    low, high, edges = bins
    return F.lit(low) + F.floor((value - low) / (high - low) * (edges - 1)) * ((high - low) / (edges - 1))


def discretised(df: DataFrame, value: Column) -> Column:
    """The group key of a numeric column: the value itself, or its bin's lower edge where values hardly repeat.

    The edges are int(BIN_RATIO * n) equally spaced numbers from the least to the greatest value.
    """
    return _cut(value, _spread(df, value)[0])


def _plain_statistic(name: str, value: Column | None) -> Column:
    if name == "GroupByCount":
        return F.count(F.lit(1))
    if name == "GroupByMedian":
        return F.percentile(value, F.lit(0.5))
    return {"GroupByMean": F.avg, "GroupByMax": F.max, "GroupByMin": F.min, "GroupByVar": F.var_pop}[name](value)


def _fit_group(df: DataFrame, name: str, group: Column, value: Column | None) -> GroupFit:
    """Groups not seen here get the statistic of all rows; a count, the mean size of a group."""
    bins, sparse = _spread(df, group)
    if name == "GroupByCount":
        bins = None
    table = df.groupBy(_cut(group, bins).alias("key")).agg(_plain_statistic(name, value).cast("double").alias("stat"))
    unseen = (table.agg(F.avg("stat")) if name == "GroupByCount" else df.agg(_plain_statistic(name, value))).first()[0]
    return GroupFit(bins, table, unseen, name == "GroupByCount" and sparse)


def _look_up(df: DataFrame, fit: GroupFit, name: str, group: Column, value: Column | None, output: str) -> DataFrame:
    """df with a fitted group-by call's value as `output`."""
    if fit.without:
        return df.withColumn(output, group)
    k, stat, seen = f"{output}_key", f"{output}_stat", f"{output}_seen"
    table = fit.table.select(F.col("key").alias(k), F.col("stat").alias(stat), F.lit(True).alias(seen))
    keyed = df.withColumn(output, _cut(group, fit.bins))
    joined = keyed.join(table, keyed[output].eqNullSafe(table[k]), "left")
    found = F.when(F.col(seen), F.col(stat)).otherwise(F.lit(fit.unseen).cast("double"))
    if name not in ("GroupByCount", "GroupByVar"):
        found = get_primitive("Div-O").build(value, found)
    return joined.withColumn(output, found).drop(k, stat, seen)


def group_statistic(name: str, value: Column | None, group: Column) -> Column:
    """The windowed value of a group-by primitive: the ratio of the value to its group's mean, median, maximum or
    minimum; the group's size; the group's population variance."""
    stat = _plain_statistic(name, value).over(W.partitionBy(group)).cast("double")
    return stat if name in ("GroupByCount", "GroupByVar") else get_primitive("Div-O").build(value, stat)


def _lower(df: DataFrame, node: Node, made: dict[str, str], fits: dict[str, GroupFit] | None = None, learn: bool = False) -> tuple[DataFrame, Node]:
    """Group-by calls replaced by columns that are added to df: windows, or what fits holds by the call's text."""
    if not isinstance(node, Call):
        return df, node
    args = []
    for a in node.args:
        df, low = _lower(df, a, made, fits, learn)
        args.append(low)
    if node.name not in GROUP_PRIMITIVES:
        return df, Call(node.name, tuple(args))
    text = key(node)
    if text not in made:
        made[text] = f"__group_{len(made)}"
        group, value = to_column(args[0]), to_column(args[1]) if len(args) > 1 else None
        if fits is not None:
            if learn and text not in fits:
                fits[text] = _fit_group(df, node.name, group, value)
            return _look_up(df, fits[text], node.name, group, value, made[text]), Col(made[text])
        bins, sparse = _spread(df, group)
        if node.name == "GroupByCount":
            column = group if sparse else group_statistic(node.name, None, group)
        else:
            column = group_statistic(node.name, value, _cut(group, bins))
        df = df.withColumn(made[text], column)
    return df, Col(made[text])


def has_groups(node: Node) -> bool:
    """Whether a gene holds a group-by call."""
    return isinstance(node, Call) and (node.name in GROUP_PRIMITIVES or any(map(has_groups, node.args)))


def fit_groups(df: DataFrame, genes: Sequence[Node | str]) -> dict[str, GroupFit]:
    """By text, the fit of every group-by call in the genes, to the rows of df; for features()."""
    fits: dict[str, GroupFit] = {}
    made: dict[str, str] = {}
    for g in genes:
        df, _ = _lower(df, parse(g) if isinstance(g, str) else g, made, fits, learn=True)
    return fits


def features(df: DataFrame, genes: Sequence[Node | str], names: Sequence[str] | None = None, keep: Sequence[str] = (), groups: dict[str, GroupFit] | None = None) -> DataFrame:
    """The columns `keep` and one sanitised column per gene (g0, g1, ... unless named).

    Equal genes are computed once. Group-by primitives take the statistics in `groups`, df's own rows' if it is None.
    """
    trees = [parse(g) if isinstance(g, str) else g for g in genes]
    names = list(names or (f"g{i}" for i in range(len(trees))))
    if len(trees) > MAX_GENES:
        raise ValueError(f"more than {MAX_GENES} genes in one query; call it in parts")
    made: dict[str, str] = {}
    lowered = []
    for t in trees:
        df, low = _lower(df, t, made, groups)
        lowered.append(low)
    return df.select(*(F.col(f"`{k}`") for k in keep), *(sanitise(to_column(t)).alias(n) for t, n in zip(lowered, names, strict=True)))


def fit_group_table(df: DataFrame, name: str, group: str, value: str) -> DataFrame:
    """A fitted statistic per group: columns `group` and stat; keys are taken as they are."""
    v = F.col(f"`{value}`").cast("double")
    stats = {"GroupByMean": F.avg(v), "GroupByMedian": F.percentile(v, F.lit(0.5)), "GroupByMax": F.max(v), "GroupByMin": F.min(v), "GroupByCount": F.count(F.lit(1)).cast("double"), "GroupByVar": F.var_pop(v)}
    return df.groupBy(F.col(f"`{group}`")).agg(stats[name].alias("stat"))


def apply_group_table(df: DataFrame, table: DataFrame, group: str, default: float | None, output: str) -> DataFrame:
    """df with the fitted statistic of each row's group; groups not seen at fitting get `default`."""
    looked = table.select(F.col(f"`{group}`").alias("__k"), F.col("stat").alias(output))
    joined = df.join(looked, df[f"`{group}`"].eqNullSafe(looked["__k"]), "left").drop("__k")
    return joined.withColumn(output, F.coalesce(F.col(output), F.lit(default)))


def modular(df: DataFrame, genes: Sequence[Node | str], names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Genes that may read the results of the genes before them, by name; each result is sanitised."""
    trees = [parse(g) if isinstance(g, str) else g for g in genes]
    for tree, name in zip(trees, names, strict=True):
        df = df.withColumn(name, sanitise(to_column(tree)))
    return df.select(*(F.col(f"`{c}`") for c in (*keep, *names)))

"""FeatureForest: searches for constructed features and predicts with an ensemble of ridges on them."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.primitives import preset, register_primitive
from quillon.operators import linear, scaling
from quillon.operators.ensemble import combine
from quillon.operators.genetic import crossover, half_and_half, mutate
from quillon.plans import typed
from quillon.plans.compiler import MAX_GENES, GroupFit, features, fit_groups, has_groups
from quillon.plans.gene import Call, Col, Node, columns, formula, key, parse, simplify
from quillon.sources.tables import check_features, load_model, read, save_model, write


@dataclass
class Individual:
    """Genes, their ridge and its cross-validated error."""

    genes: list[Node]
    error: float = float("inf")
    model: linear.LinearModel | None = None
    weight: float = 1.0


@dataclass
class FeatureForest:
    """fit(df, features, y), predict(df), transform(df), formula(). Features are numbers, booleans or texts.

    A generation's genes, repeats left out, are evaluated in projections of at most MAX_GENES columns, and one
    aggregate per projection batch gives all the Gram matrices by fold that the individuals' ridges need. Selection is
    automatic epsilon-lexicase over the folds' errors; the ensemble is the best individuals seen.
    """

    primitives: str = "default"
    custom_primitives: dict[str, tuple[int, Callable[..., Column]]] = field(default_factory=dict)
    population: int = 12
    generations: int = 3
    genes: int = 3
    depth: int = 3
    ensemble: int = 5
    folds: int = 5
    alpha: float = 1.0
    how: str = "mean"
    seed: int = 0
    groups: dict[str, GroupFit] = field(default_factory=dict, init=False)
    #: Of every text column among the inputs the gene of its training mean; the genes read it as <column>__mean.
    encoding: typed.TypedPlan | None = field(default=None, init=False)

    def fit(self, df: DataFrame, columns_in: Sequence[str], y: str, row_id: str) -> FeatureForest:
        texts = [c for c in columns_in if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
        if texts:
            self.encoding = typed.fit(df, [Call("groupby_mean", (Col(c), Col(y))) for c in texts], texts)
            df, columns_in = self._encoded(df), [f"{c}__mean" if c in texts else c for c in columns_in]
        check_features(df, [*columns_in, y])
        for name, (arity, build) in self.custom_primitives.items():
            register_primitive(name, arity, build)
        names = (*preset(self.primitives), *self.custom_primitives)
        self.inputs, self.target, self.row_id = list(columns_in), y, row_id
        usable = scaling.drop_constant(df, columns_in) or list(columns_in)
        rnd = random.Random(self.seed)
        people = [Individual([half_and_half(rnd, usable, names, 1, self.depth) for _ in range(self.genes)]) for _ in range(self.population)]
        self.hall, seen = [], set()
        for generation in range(self.generations + 1):
            people = [p for p in people if (k := tuple(sorted(key(g) for g in p.genes))) not in seen and not seen.add(k)] or people
            losses = self._evaluate(df, people)
            best = {tuple(key(g) for g in p.genes): p for p in [*self.hall, *people]}
            self.hall = sorted(best.values(), key=lambda p: (p.error, [key(g) for g in p.genes]))[: self.ensemble]
            if generation == self.generations:
                self.groups = fit_groups(df, [g for p in self.hall for g in p.genes])
                break
            parents = self._select(rnd, people, losses, self.population)
            people = [self._vary(rnd, parents[i], parents[(i + 1) % len(parents)], usable, names) for i in range(len(parents))]
        return self

    def _encoded(self, df: DataFrame) -> DataFrame:
        """df with <column>__mean for the text inputs; unknown and null texts have the mean of all training rows."""
        if self.encoding is None:
            return df
        return df.withColumns({f"{c}__mean": self.encoding.columns(i)[0] for i, c in enumerate(self.encoding.categories)})

    def _evaluate(self, df: DataFrame, people: list[Individual]) -> np.ndarray:
        """Sets every individual's model and error; gives errors by individual and fold."""
        out = np.zeros((len(people), self.folds))
        per_batch = max(1, min(MAX_GENES // self.genes, 8))
        for at in range(0, len(people), per_batch):
            part = people[at : at + per_batch]
            unique = {key(g): g for p in part for g in p.genes}
            place = {k: f"g{i}" for i, k in enumerate(unique)}
            rows = features(df, list(unique.values()), list(place.values()), keep=[self.target, self.row_id])
            folded = rows.withColumn("__fold", linear.fold_of(self.row_id, self.folds, self.seed))
            sums = [s.alias(f"p{i}_{j}") for i, p in enumerate(part) for j, s in enumerate(linear._sums([place[key(g)] for g in p.genes], self.target))]
            found = folded.groupBy("__fold").agg(*sums).collect()
            for i, p in enumerate(part):
                k = len(p.genes) + 2
                names = [f"s{a}_{b}" for a in range(k) for b in range(a, k)]
                grams = {r["__fold"]: linear._matrix({n: r[f"p{i}_{j}"] for j, n in enumerate(names)}, k) for r in found}
                total = sum(grams.values())
                labels = [f"x{a}" for a in range(len(p.genes))]
                errors = []
                for f, g in grams.items():
                    m = linear.solve_ridge(total - g, labels, self.alpha) if len(grams) > 1 else linear.solve_ridge(total, labels, self.alpha)
                    beta = np.array([-m.intercept, *(-c for c in m.coefficients), 1.0])
                    out[at + i, f] = float(beta @ g @ beta) / max(g[0, 0], 1.0)
                    errors.append(float(beta @ g @ beta))
                p.model = linear.solve_ridge(total, [key(g) for g in p.genes], self.alpha)
                p.error = sum(errors) / max(total[0, 0], 1.0)
        return out

    @staticmethod
    def _select(rnd: random.Random, people: list[Individual], losses: np.ndarray, k: int) -> list[Individual]:
        from quillon.operators.selection import lexicase

        return [people[i] for i in lexicase(list(range(len(people))), losses, k, rnd.randrange(1 << 30))]

    def _vary(self, rnd: random.Random, a: Individual, b: Individual, usable: Sequence[str], names: Sequence[str]) -> Individual:
        genes = list(a.genes)
        i = rnd.randrange(len(genes))
        genes[i], _ = crossover(rnd, genes[i], rnd.choice(b.genes))
        if rnd.random() < 0.3:
            j = rnd.randrange(len(genes))
            genes[j] = mutate(rnd, genes[j], usable, names)
        return Individual([simplify(g) for g in genes])

    def _table(self, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        unique = {key(g): g for p in self.hall for g in p.genes}
        place = {k: f"__g{i}" for i, k in enumerate(unique)}
        return features(self._encoded(df), list(unique.values()), list(place.values()), keep=df.columns, groups=self._fitted()), place

    def _fitted(self) -> dict[str, GroupFit]:
        """The group statistics of the training rows; a forest restored without its tables has none."""
        if not self.groups and any(has_groups(g) for p in self.hall for g in p.genes):
            raise ValueError("its genes need group tables: save() and load() keep them")
        return self.groups

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """df with the ensemble's prediction; a row's does not depend on the rows scored with it."""
        rows, place = self._table(df)
        named = {}
        for i, p in enumerate(self.hall):
            m = linear.LinearModel(tuple(place[f] for f in p.model.features), p.model.intercept, p.model.coefficients)
            named[f"__p{i}"] = m.column()
        scored = rows.withColumns(named)
        return scored.withColumn(output, combine(list(named), self.how)).select(*(F.col(f"`{c}`") for c in df.columns), output)

    def importance(self) -> dict[str, float]:
        """Genes by the sum of |coefficient| over the ensemble, scaled to sum 1."""
        total: dict[str, float] = {}
        for p in self.hall:
            for f, c in zip(p.model.features, p.model.coefficients, strict=True):
                total[f] = total.get(f, 0.0) + abs(c) * p.weight
        whole = sum(total.values()) or 1.0
        return dict(sorted(((k, v / whole) for k, v in total.items()), key=lambda x: (-x[1], x[0])))

    def transform(self, df: DataFrame, ratio: float = 0.5, keep_inputs: bool = True) -> DataFrame:
        """df with the most important genes as columns f0, f1, ...: those at or above the (1 - ratio) quantile."""
        found = self.importance()
        edge = float(np.quantile(list(found.values()), 1 - ratio))
        chosen = [g for g, v in found.items() if v >= edge]
        return features(self._encoded(df), chosen, [f"f{i}" for i in range(len(chosen))], keep=df.columns if keep_inputs else [self.row_id], groups=self._fitted())

    def formula(self) -> str:
        """The best individual as an infix formula."""
        p = self.hall[0]
        terms = [f"{c:.6g} * {formula(parse(f))}" for f, c in zip(p.model.features, p.model.coefficients, strict=True)]
        return " + ".join([f"{p.model.intercept:.6g}", *terms])

    def describe(self) -> dict:
        """The fitted ensemble as plain values, for save_model()."""
        return {"encoding": self.encoding and self.encoding.to_dict(), "inputs": self.inputs, "target": self.target, "row_id": self.row_id, "how": self.how, "members": [{"genes": [key(g) for g in p.genes], "error": p.error, "intercept": p.model.intercept, "coefficients": list(p.model.coefficients)} for p in self.hall]}

    def save(self, spark: SparkSession, path: str) -> None:
        """The fitted ensemble under a folder: its description as JSON, each group-by call's table as Parquet."""
        names = sorted(self.groups)
        for i, name in enumerate(names):
            write(self.groups[name].table, f"{path}/group-{i}")
        fits = [{"call": n, "bins": f.bins, "unseen": f.unseen, "without": f.without} for n, f in ((n, self.groups[n]) for n in names)]
        save_model(spark, self.describe() | {"groups": fits}, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureForest:
        found = load_model(spark, f"{path}/model")
        out = cls.restore(found)
        for i, g in enumerate(found["groups"]):
            out.groups[g["call"]] = GroupFit(tuple(g["bins"]) if g["bins"] else None, read(spark, f"{path}/group-{i}"), g["unseen"], g["without"])
        return out

    @classmethod
    def restore(cls, found: dict) -> FeatureForest:
        """A forest from describe(); where its genes hold group-by calls, use save() and load()."""
        out = cls(how=found["how"])
        out.inputs, out.target, out.row_id = found["inputs"], found["target"], found["row_id"]
        out.encoding = typed.TypedPlan.from_dict(found["encoding"]) if found.get("encoding") else None
        out.hall = [Individual([parse(g) for g in m["genes"]], m["error"], linear.LinearModel(tuple(m["genes"]), m["intercept"], tuple(m["coefficients"]))) for m in found["members"]]
        return out

    def columns_used(self) -> list[str]:
        return sorted({c for p in self.hall for g in p.genes for c in columns(g)})

"""Parent and survivor selection over a loss table.

losses is long form: ind_id, row_id, loss. Objectives are wide: ind_id and one column per objective, smaller is better.
Random choices are hashes or random.Random(seed), so reruns agree.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators import pareto
from quillon.operators.ordered import with_neighbours

#: A loss table with at most so many values is collected for lexicase; larger ones are filtered in Spark.
MAX_COLLECT = 5_000_000


def loss_matrix(losses: DataFrame, limit: int = MAX_COLLECT) -> tuple[list, np.ndarray]:
    """Individuals in order, and their losses by row in order of row_id, for tables of at most `limit` values.

    A missing loss counts as the largest of its row.
    """
    if losses.count() > limit:
        raise ValueError("the loss table is too large to collect; use lexicase_step()")
    frame = losses.toPandas().pivot(index="ind_id", columns="row_id", values="loss").sort_index()
    matrix = frame.to_numpy(np.float64)
    return list(frame.index), np.where(np.isnan(matrix), np.nanmax(matrix, axis=0), matrix)


def _mad(x: np.ndarray) -> float:
    return float(np.median(np.abs(x - np.median(x))))


def lexicase(ids: list, matrix: np.ndarray, k: int, seed: int, epsilon: float | None = None, weights: Sequence[float] | None = None) -> list:
    """k parents: cases in random order, each keeping the candidates within epsilon (the median absolute deviation
    among them unless given) of the least loss, until one is left; of several, a random one.

    weights bias the order of cases: larger weights come early more often.
    """
    rnd, chosen = random.Random(seed), []
    for _ in range(k):
        if weights is None:
            order = list(range(matrix.shape[1]))
            rnd.shuffle(order)
        else:
            order = sorted(range(matrix.shape[1]), key=lambda c: -(rnd.random() ** (1 / max(weights[c], 1e-12))))
        left = np.arange(len(ids))
        for case in order:
            if len(left) == 1:
                break
            column = matrix[left, case]
            reach = _mad(column) if epsilon is None else epsilon
            left = left[column <= column.min() + reach]
        chosen.append(ids[int(left[rnd.randrange(len(left))])])
    return chosen


def lexicase_step(candidates: DataFrame, losses: DataFrame, row_id: int) -> DataFrame:
    """The candidates (ind_id) within the median absolute deviation of the least loss on one row, in Spark."""
    case = losses.where(F.col("row_id") == row_id).join(candidates, "ind_id", "left_semi")
    median = case.agg(F.percentile(F.col("loss").cast("double"), F.lit(0.5)).alias("m")).first()["m"]
    least, reach = case.agg(F.min("loss"), F.percentile(F.abs(F.col("loss") - F.lit(median)), F.lit(0.5))).first()
    return case.where(F.col("loss") <= least + reach).select("ind_id")


def tournament(fitness: DataFrame, k: int, size: int, seed: int = 0) -> DataFrame:
    """pick (0 to k-1), ind_id: the best (least fitness) of `size` individuals drawn with replacement per pick."""
    ids = fitness.select("ind_id", "fitness").withColumn("place", F.row_number().over(W.orderBy("ind_id")) - 1)
    n = fitness.count()
    draws = fitness.sparkSession.range(k * size).select((F.col("id") / size).cast("int").alias("pick"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("place"))
    return draws.join(ids, "place").groupBy("pick").agg(F.min_by("ind_id", F.struct("fitness", "ind_id")).alias("ind_id"))


def roulette_weights(fitness: DataFrame) -> DataFrame:
    """ind_id, p: chances in proportion to the distance from the worst fitness."""
    worst = fitness.agg(F.max("fitness")).first()[0]
    raw = fitness.withColumn("w", F.lit(worst) - F.col("fitness"))
    total = raw.agg(F.sum("w")).first()[0] or 0.0
    n = fitness.count()
    return raw.select("ind_id", (F.col("w") / F.lit(total) if total > 0 else F.lit(1.0 / n)).alias("p"))


def boltzmann_weights(fitness: DataFrame, generation: int, cycle: int) -> DataFrame:
    """ind_id, p: softmax of (f - max f) / t over score f, with t = 0.1 * (1 - (generation mod cycle) / cycle), 1e-8 at least."""
    t = max(1e-8, 0.1 * (1 - (generation % cycle) / cycle))
    top = fitness.agg(F.max("fitness")).first()[0]
    raw = fitness.withColumn("w", F.exp((F.col("fitness") - F.lit(top)) / F.lit(t)))
    total = raw.agg(F.sum("w")).first()[0]
    return raw.select("ind_id", (F.col("w") / F.lit(total)).alias("p"))


def _dominates(b: str, a: str, objectives: Sequence[str]) -> Column:
    no_worse = F.lit(True)
    better = F.lit(False)
    for o in objectives:
        no_worse &= F.col(f"{b}.{o}") <= F.col(f"{a}.{o}")
        better |= F.col(f"{b}.{o}") < F.col(f"{a}.{o}")
    return no_worse & better


def pareto_front(population: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """The rows that no other row dominates (smaller is better).

    For two objectives, one ordered pass: rows with equal objectives are one; a row stays if no row before it in
    (first, second) order has a second objective as small. More objectives use an anti-join on dominance.
    """
    if len(objectives) == 2:
        one, two = objectives
        groups = population.groupBy(one).agg(F.min(two).alias("__least"))
        before = F.min("__least").over(W.orderBy(one).rowsBetween(W.unboundedPreceding, -1))
        edge = groups.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__least") < F.col("__before")))
        edge = edge.select(F.col(one).alias("__one"), "__least")
        return population.join(edge, (F.col(one) == F.col("__one")) & (F.col(two) == F.col("__least")), "left_semi")
    return population.alias("a").join(population.alias("b"), _dominates("b", "a", objectives), "left_anti")


def pareto_layers(population: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """population with front: 0 for the rows that none dominates, 1 for those that only they dominate, and so on."""
    return population.join(pareto.layers(population, objectives, "ind_id").withColumnRenamed("layer", "front"), "ind_id")


def crowding(population: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """population with crowding: sum over objectives of the neighbours' distance over the range; infinite at the ends."""
    ranges = population.agg(*(F.max(o).alias(f"hi_{o}") for o in objectives), *(F.min(o).alias(f"lo_{o}") for o in objectives)).first()
    total, out = F.lit(0.0), population
    for i, o in enumerate(objectives):
        span = (ranges[f"hi_{o}"] - ranges[f"lo_{o}"]) or 1.0
        near = with_neighbours(population, o, "ind_id", [o], back=1, ahead=1)
        apart = (F.col(f"`{o}_1`") - F.col(f"`{o}_-1`")) / F.lit(span)
        out = out.join(near.select("ind_id", F.coalesce(apart, F.lit(float("inf"))).alias(f"__c{i}")), "ind_id")
        total += F.col(f"__c{i}")
    return out.withColumn("crowding", total).drop(*(f"__c{i}" for i in range(len(objectives))))


def knee_point(front: DataFrame, one: str, two: str) -> DataFrame:
    """The row of a two-objective front farthest from the line through its ends, after scaling both to 0..1."""
    lo1, hi1, lo2, hi2 = front.agg(F.min(one), F.max(one), F.min(two), F.max(two)).first()
    a = (F.col(one) - F.lit(lo1)) / F.lit((hi1 - lo1) or 1.0)
    b = (F.col(two) - F.lit(lo2)) / F.lit((hi2 - lo2) or 1.0)
    return front.withColumn("knee_distance", F.abs(a + b - F.lit(1.0)) / F.sqrt(F.lit(2.0))).orderBy(F.col("knee_distance").desc(), "ind_id").limit(1)


def harmonic_rank(population: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """population with harmonic_rank: the harmonic mean of its ranks by each objective."""
    ranked = population.withColumns({f"__r{i}": F.rank().over(W.orderBy(o)) for i, o in enumerate(objectives)})
    inverse = sum((F.lit(1.0) / F.col(f"__r{i}") for i in range(len(objectives))), F.lit(0.0))
    return ranked.withColumn("harmonic_rank", F.lit(float(len(objectives))) / inverse).drop(*(f"__r{i}" for i in range(len(objectives))))


def case_ranks(losses: DataFrame) -> DataFrame:
    """ind_id, mean_rank: mean over rows of the place in order of loss, from 1; ties by ind_id."""
    rank = F.row_number().over(W.partitionBy("row_id").orderBy("loss", "ind_id"))
    return losses.withColumn("r", rank).groupBy("ind_id").agg(F.avg("r").alias("mean_rank"))


def complementary_partner(losses: DataFrame, parent: int) -> DataFrame:
    """The individual that does best on the worst quarter of the parent's rows."""
    own = losses.where(F.col("ind_id") == parent)
    edge = own.agg(F.percentile(F.col("loss").cast("double"), F.lit(0.75))).first()[0]
    hard = own.where(F.col("loss") >= edge).select("row_id")
    mean = losses.where(F.col("ind_id") != parent).join(hard, "row_id", "left_semi").groupBy("ind_id").agg(F.avg("loss").alias("loss"))
    return mean.orderBy("loss", "ind_id").limit(1)


def pair_complement(losses: DataFrame, parent: int) -> DataFrame:
    """ind_id, loss: the mean over rows of the smaller of both losses, of the parent with each other individual."""
    own = losses.where(F.col("ind_id") == parent).select("row_id", F.col("loss").alias("own"))
    both = losses.where(F.col("ind_id") != parent).join(own, "row_id")
    return both.groupBy("ind_id").agg(F.avg(F.least("loss", "own")).alias("loss"))


def map_elites(population: DataFrame, cells: Sequence[str]) -> DataFrame:
    """The best (least fitness) individual of each cell."""
    first = F.row_number().over(W.partitionBy(*cells).orderBy("fitness", "ind_id"))
    return population.withColumn("__r", first).where("__r = 1").drop("__r")


def da_lexicase_scores(losses: DataFrame, weights: DataFrame) -> DataFrame:
    """ind_id, score: the losses, z-scored per row over individuals, summed with the rows' weights (row_id, w)."""
    over = W.partitionBy("row_id")
    sd = F.stddev_pop("loss").over(over)
    z = (F.col("loss") - F.avg("loss").over(over)) / F.when(sd == 0, F.lit(1e-8)).otherwise(sd)
    return losses.withColumn("z", z).join(weights, "row_id").groupBy("ind_id").agg(F.sum(F.col("w") * F.col("z")).alias("score"))


def best_split(losses: DataFrame) -> DataFrame:
    """One row per row_id: the threshold on its sorted losses that leaves the least variance within both parts."""
    by = W.partitionBy("row_id").orderBy("loss", "ind_id")
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    n, s, q = F.count("loss"), F.sum("loss"), F.sum(F.col("loss") * F.col("loss"))
    whole = W.partitionBy("row_id")
    x = losses.select("row_id", "loss", "ind_id", n.over(upto).alias("n1"), s.over(upto).alias("s1"), q.over(upto).alias("q1"), n.over(whole).alias("n"), s.over(whole).alias("s"), q.over(whole).alias("q"), F.lead("loss").over(by).alias("nxt"))
    x = x.where(F.col("nxt").isNotNull() & (F.col("nxt") > F.col("loss")))
    n2, s2, q2 = F.col("n") - F.col("n1"), F.col("s") - F.col("s1"), F.col("q") - F.col("q1")
    score = (F.col("q1") - F.col("s1") * F.col("s1") / F.col("n1") + q2 - s2 * s2 / n2) / F.col("n")
    cut = x.withColumns({"score": score, "threshold": (F.col("loss") + F.col("nxt")) / F.lit(2.0)})
    return cut.groupBy("row_id").agg(F.min_by("threshold", F.struct("score", "threshold")).alias("threshold"))


def batch_means(losses: DataFrame, batch: int) -> DataFrame:
    """ind_id, batch, loss: mean loss per batch of consecutive row ids."""
    return losses.groupBy("ind_id", F.floor(F.col("row_id") / batch).alias("batch")).agg(F.avg("loss").alias("loss"))


def niches(fitness: DataFrame) -> DataFrame:
    """fitness with niche: about sqrt(n) equal parts in order of fitness."""
    n = fitness.count()
    return fitness.withColumn("niche", F.ntile(max(1, int(n**0.5))).over(W.orderBy("fitness", "ind_id")) - 1)


def p_lexicase_wins(losses: DataFrame) -> DataFrame:
    """ind_id, wins: on how many rows an individual is within the median absolute deviation of the least loss."""
    whole = W.partitionBy("row_id")
    middle = losses.withColumns({"m": F.percentile("loss", F.lit(0.5)).over(whole), "least": F.min("loss").over(whole)})
    spread = middle.withColumn("gap", F.abs(F.col("loss") - F.col("m")))
    near = F.col("loss") <= F.col("least") + F.percentile("gap", F.lit(0.5)).over(whole)
    return spread.select("ind_id", near.alias("near")).groupBy("ind_id").agg(F.sum(F.col("near").cast("long")).alias("wins"))


def normalised_objectives(population: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """population with every objective scaled to 0..1 by its least and greatest value; a constant one becomes 0."""
    row = population.agg(*(f(o).alias(f"{n}_{o}") for o in objectives for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def unit(o: str) -> Column:
        low, span = row[f"lo_{o}"], (row[f"hi_{o}"] or 0) - (row[f"lo_{o}"] or 0)
        return (F.col(o) - F.lit(low)) / F.lit(float(span)) if span else F.lit(0.0)

    return population.withColumns({o: unit(o) for o in objectives})


def angles(residuals: DataFrame, parent: int) -> DataFrame:
    """ind_id, cosine of its residual vector with the parent's: the mate of the widest angle has the least.

    residuals: ind_id, row_id, residual. A vector of zeros is at a right angle to all.
    """
    own = residuals.where(F.col("ind_id") == parent).select("row_id", F.col("residual").alias("own"))
    both = residuals.where(F.col("ind_id") != parent).join(own, "row_id")
    length = F.sqrt(F.sum(F.col("residual") ** 2) * F.sum(F.col("own") ** 2))
    sums = both.groupBy("ind_id").agg(F.sum(F.col("residual") * F.col("own")).alias("dot"), length.alias("length"))
    return sums.select("ind_id", F.coalesce(F.try_divide("dot", "length"), F.lit(0.0)).alias("cosine"))


def curriculum_tiers(losses: DataFrame, tiers: int) -> DataFrame:
    """row_id, tier from 0 (easiest): rows by their mean loss over individuals, in equal parts."""
    mean = losses.groupBy("row_id").agg(F.avg("loss").alias("mean"))
    return mean.select("row_id", (F.ntile(tiers).over(W.orderBy("mean", "row_id")) - 1).alias("tier"))  # one row per training case

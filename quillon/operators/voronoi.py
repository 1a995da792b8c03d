"""Archives with one elite in each cell of a centroidal Voronoi tessellation of the directions of error vectors.

A vector's cell is that of the centre it has the greatest cosine with. Vectors that are null, zero or hold a component
that is null or not finite have no cell and take no part; neither do individuals without a fitness. Lower fitness is
better, ties go to the smaller ind_id, and of rows that repeat an ind_id and fitness any one stays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import ordered
from quillon.operators.coresets import farthest_first
from quillon.operators.linear import gram

#: Numbers in a table of centres, which every task gets: 32 MB.
MOST_NUMBERS = 4_000_000


def _directed(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has a direction, with it at length 1 in the vector's place."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # a length beyond the range of doubles, either way, gives no direction
    return df.where(good & (length > 0) & (length < float("inf"))).withColumn(vector, F.transform(v, lambda x: x / length))


def _nearest(vectors: pd.Series, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x, np.argmax(x @ centres.T, axis=1).astype(np.int32)


def voronoi_centres(df: DataFrame, k: int, id_col: str = "ind_id", vector: str = "vector", weight: str | None = None, rounds: int = 10) -> np.ndarray:
    """k directions (fewer, if rows are fewer), each the mean direction of its cell after some rounds, one job a round.

    They start at a farthest-first sample. A task adds its rows up by cell, so k sums of a task are shuffled and k sums
    come to the driver, whatever the number of rows. A cell that loses its rows, or whose mean is zero, keeps its
    centre. Rounds end early where no centre moves. Rows of null, negative or zero weight count for nothing.
    """
    rows = _directed(df, vector).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v"), (F.lit(1.0) if weight is None else F.coalesce(F.greatest(F.col(f"`{weight}`").cast("double"), F.lit(0.0)), F.lit(0.0))).alias("w"))
    rows = rows.where(F.col("w") > 0)
    first = farthest_first(rows, k, "vec_id", "v").select("id", "rk")
    # of rows that repeat an id, the smallest vector; farthest_first gives ids alone
    start = rows.join(F.broadcast(first), F.col("vec_id") == F.col("id")).groupBy("rk").agg(F.min("v").alias("v")).orderBy("rk").collect()
    if not start:
        return np.zeros((0, 0))
    centres = np.array([r["v"] for r in start])
    if centres.size > MOST_NUMBERS:
        raise ValueError(f"centres hold at most {MOST_NUMBERS} numbers")
    for _ in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast(centres)

        def add_up(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            now = sent.value
            sums = np.zeros_like(now)
            for f in (f for f in frames if len(f)):
                x, cell = _nearest(f["v"], now)
                np.add.at(sums, cell, x * f["w"].to_numpy()[:, None])
            held = np.flatnonzero(np.abs(sums).sum(1) > 0)
            if len(held):
                yield pd.DataFrame({"cell": held.astype(np.int32), "s": list(sums[held])})

        parts = rows.select("v", "w").mapInPandas(add_up, "cell int, s array<double>")
        total = parts.select("cell", F.posexplode("s").alias("at", "x")).groupBy("cell", "at").agg(F.sum("x").alias("x"))
        moved = centres.copy()
        for r in total.groupBy("cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("s")).collect():
            mean = np.array(r["s"])
            length = np.sqrt(mean @ mean)
            if length > 1e-12:
                moved[r["cell"]] = mean / length
        sent.unpersist()
        done, centres = np.allclose(moved, centres, rtol=0, atol=1e-12), moved
        if done:
            break
    return centres


def voronoi_cells(df: DataFrame, centres: np.ndarray, vector: str = "vector") -> DataFrame:
    """df's rows that have a direction, as they are, with cell: the number of the nearest centre, ties to the smaller one."""
    sent = df.sparkSession.sparkContext.broadcast(np.asarray(centres, np.float64))

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest(v, sent.value)[1] if len(v) else np.zeros(0, np.int32))

    unit = "__unit"
    while unit in df.columns:
        unit += "_"
    return _directed(df.withColumn(unit, F.col(f"`{vector}`")), unit).withColumn("cell", cell(F.col(unit))).drop(unit)


def elites(df: DataFrame, cell: str = "cell") -> DataFrame:
    """The best row of each cell: one aggregate with partial sums, so a cell that holds most rows is no task's burden."""
    best = F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(F.col("fitness").cast("double"), F.col("ind_id")))
    return df.where("fitness IS NOT NULL AND NOT isnan(CAST(fitness AS DOUBLE))").groupBy(F.col(f"`{cell}`").alias("in_cell")).agg(best.alias("row")).select("row.*")


def candidates(population: DataFrame, archive: DataFrame | None, size: int, mode: str = "independent") -> DataFrame:
    """What competes for an archive: both tables ("free"), the best `size` of the population with the archive
    ("independent"), or the best `size` of both without those whose fitness is far worse than the rest's
    ("combined": over the third quartile by more than 1.5 times the distance of the quartiles)."""
    if mode not in ("free", "independent", "combined"):
        raise ValueError("mode must be free, independent or combined")
    top = lambda t: t.where("fitness IS NOT NULL AND NOT isnan(CAST(fitness AS DOUBLE))").orderBy("fitness", "ind_id").limit(size)
    own = top(population) if mode == "independent" else population
    pool = own if archive is None else own.unionByName(archive.select(*population.columns))
    if mode != "combined":
        return pool
    low, high = ordered.quantiles(pool, "fitness", (0.25, 0.75)).values()
    return pool.limit(0) if low is None else top(pool.where(F.col("fitness") <= high + 1.5 * (high - low)))


def reclustered_archive(population: DataFrame, archive: DataFrame | None, k: int, size: int, vector: str = "vector", mode: str = "independent", rounds: int = 10) -> DataFrame:
    """A new archive of at most k rows: the candidates' cells are found anew, weighted by goodness from 0 to 1, and each
    gives its best. The centres that no weighted row reaches give none."""
    pool = candidates(population, archive, size, mode)
    low, high = pool.agg(F.min("fitness").cast("double"), F.max("fitness").cast("double")).first()
    if low is None:
        return pool.limit(0)
    goodness = (F.lit(high) - F.col("fitness")) / F.lit(high - low) if high > low else F.lit(1.0)
    name = "__goodness"
    while name in pool.columns:
        name += "_"
    centres = voronoi_centres(pool.withColumn(name, goodness), k, "ind_id", vector, name, rounds)
    return elites(voronoi_cells(pool.drop("cell"), centres, vector)).select(*population.columns) if len(centres) else pool.limit(0)


class VoronoiArchive:
    """A stored archive over fixed cells: a folder of centres and of one table of elites for each generation merged.

    Each table is the best of each cell among the one before and the new generation; so any order and grouping of the
    same individuals into generations ends in the same elites, and merging a generation again (after a lost driver,
    say) writes the same table. Tables of generations before stay, for replays.
    """

    def __init__(self, spark: SparkSession, path: str, vector: str = "vector"):
        self.spark, self.path, self.vector = spark, path.rstrip("/"), vector

    def create(self, centres: np.ndarray) -> VoronoiArchive:
        """Store the centres; an archive that has some already is an error."""
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        self.spark.createDataFrame(rows, "cell int, v array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        return self

    def centres(self) -> np.ndarray:
        return np.array([r["v"] for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()])

    def generations(self) -> list[int]:
        """The generations whose tables are complete."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generation=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def at(self, generation: int) -> DataFrame:
        """The elites after a generation, with their cells."""
        return self.spark.read.parquet(f"{self.path}/generation={generation}")

    def merge(self, population: DataFrame, generation: int) -> DataFrame:
        """Merge a generation (numbers rise; those up to the last complete one overwrite it alone) and return the elites.

        Columns are the first generation's; later ones must have them. A column named cell is replaced by the cell.
        """
        done = self.generations()
        if done and generation < done[-1]:
            raise ValueError(f"generation {done[-1]} is merged already")
        before = [g for g in done if g < generation]
        own = elites(voronoi_cells(population.drop("cell"), self.centres(), self.vector))
        if before:
            last = self.at(before[-1])
            own = elites(last.unionByName(own.select(*last.columns)))
        own.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/generation={generation}")  # a row a cell at most
        return self.at(generation)


def member_cells(g: np.ndarray, k: int, rounds: int = 20, symmetric: bool = False) -> np.ndarray:
    """Cells of members from gram(members, y) alone: cosines of their errors are all that means of cells need.

    The first centres are members, farthest first by cosine, from member 0; then each round puts a member where its
    cosine with the cell's mean is greatest. symmetric: a member's error turned round is one more vector, so members
    that err in opposite ways can share cells. Members without an error are in cell 0. Ties go to the smaller number.
    """
    m, last = len(g) - 2, len(g) - 1
    turn = np.zeros((m, len(g)))
    turn[np.arange(m), np.arange(1, m + 1)], turn[:, last] = 1.0, -1.0
    errors = turn @ g @ turn.T
    size = np.sqrt(np.maximum(np.diag(errors), 0))
    scale = np.where(size > 1e-9 * max(np.sqrt(g[last, last]), 1e-300), 1 / np.maximum(size, 1e-300), 0.0)
    cosine = errors * np.outer(scale, scale)
    if symmetric:
        cosine = np.block([[cosine, -cosine], [-cosine, cosine]])
    chosen = [0]
    while len(chosen) < min(k, m):
        near = cosine[:, chosen].max(1)
        near[chosen] = np.inf
        chosen.append(int(np.argmin(near)))
    near = cosine[:, chosen].copy()
    near[chosen, range(len(chosen))] = 2.0  # of copies, each chosen one keeps its cell
    cell = np.argmax(near, axis=1)
    for _ in range(rounds):
        inside = (cell[:, None] == np.arange(len(chosen))).astype(float)
        norm = np.sqrt(np.maximum(np.einsum("ic,ij,jc->c", inside, cosine, inside), 0))
        near = np.where(norm > 1e-12, (cosine @ inside) / np.maximum(norm, 1e-300), -2.0)
        moved = np.where(np.concatenate([scale] * (1 + symmetric)) > 0, np.argmax(near, axis=1), 0)
        if (moved == cell).all():
            break
        cell = moved
    return cell[:m]


def voronoi_members(df: DataFrame, members: Sequence[str], y: str, k: int, symmetric: bool = False) -> list[str]:
    """The member of least squared error in each of k cells of the members' errors, the best first, from one aggregate over the rows."""
    g = gram(df, members, y)
    last, cell = len(g) - 1, member_cells(g, k, symmetric=symmetric)
    loss = [g[i, i] - 2 * g[i, last] + g[last, last] for i in range(1, last)]
    best: dict[int, int] = {}
    for i in sorted(range(len(members)), key=lambda i: (loss[i], i)):
        best.setdefault(int(cell[i]), i)
    return [members[i] for i in best.values()]

"""Tree ensembles of a whole plan as one grouped Spark job over bounded blocks of rows.

A population is the training rows of one fold and horizon.  It is cut by a hash of its
keys into blocks of ``BLOCK_ROWS`` rows at most (about); a task gets one block and some
ensembles of one model, so that no task holds a population.  A population of one block
has the ensembles of the plain algorithm; with several blocks a prediction is their
mean, weighted by rows, as in bagging: every row is learned from, at any size.

Why not one job for each level of all trees: boosting needs 300 rounds of up to 8
levels one after the other.  Measured here, a Spark job over next to nothing takes 0.25
to 0.29 s and a barrier between running tasks 0.95 s, so that 2,400 of them take
ten minutes and more before any work is done.

A configuration of fewer iterations is a prefix of its longer twin; the grid's 24
configurations need 12 ensembles.  Ensembles are kept as a table of node arrays; origins
are scored by grouping them with these rows, in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.fixed import FEATURES, FOREST_TREES, PRIMARY_MODELS, SEED, SERIES
from shelfline.operators import trees as tr
from shelfline.operators.forecast import configuration_grid
from shelfline.session import stored

BLOCK_ROWS = 1 << 17
#: Bins of a numeric column for boosting.
BINS = 32
#: Trees of a forest that a task grows, and origins that a task scores at once.
FOREST_PART, CHUNK_ROWS = 25, 1 << 17

POPULATION = ["fold_id", "horizon"]
_CATEGORY = [True] * len(SERIES) + [False] * len(FEATURES)

_MODELS = (
    "fold_id int, horizon int, model string, part string, block long, block_rows long, base double, "
    + ", ".join(f"levels_{i} array<string>" for i in range(len(SERIES)))
    + ", configurations array<string>, counts array<int>, roots array<int>, columns array<smallint>, children array<int>, numbers array<double>"
)
_ARROW = pa.schema(
    [("fold_id", pa.int32()), ("horizon", pa.int32()), ("model", pa.string()), ("part", pa.string()), ("block", pa.int64()), ("block_rows", pa.int64()), ("base", pa.float64())]
    + [(f"levels_{i}", pa.list_(pa.string())) for i in range(len(SERIES))]
    + [("configurations", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("roots", pa.list_(pa.int32()))]
    + [("columns", pa.list_(pa.int16())), ("children", pa.list_(pa.int32())), ("numbers", pa.list_(pa.float64()))]
)


def planned_parts(candidates: Iterable[tuple[str, int, str, int]], forest_trees: int = FOREST_TREES) -> list[tuple[int, int, str, str]]:
    """(fold, horizon, model, part) of the tasks for (model, horizon, configuration, fold) candidates.

    A part names what its task fits: boosted ensembles of one depth and subsample, or a range of a forest's trees.
    """
    grid = {row[0]: row[1:] for row in configuration_grid()}
    parts: dict[tuple, dict] = {}
    for model, horizon, configuration, fold in candidates:
        if model in PRIMARY_MODELS:
            rate, iterations, depth, subsample = grid[configuration]
            of = parts.setdefault((fold, horizon, model, (depth, subsample)), {})
            of.setdefault((rate, depth, subsample), []).append((iterations, configuration))
        elif model == "random_forest":
            for begin in range(0, forest_trees, FOREST_PART):
                parts[fold, horizon, model, begin] = {(begin, min(begin + FOREST_PART, forest_trees), forest_trees): [(0, configuration)]}
        else:
            raise ValueError(f"{model} is not a tree model")
    out = []
    for (fold, horizon, model, _), of in parts.items():
        # numbers and names in plain text, read back by _ensembles_of
        text = ";".join(" ".join(map(str, key)) + "|" + ",".join(f"{i}:{c}" for i, c in sorted(value)) for key, value in sorted(of.items()))
        out.append((fold, horizon, model, text))
    return out


def _partitions(groups: int) -> int:
    """Partitions for groups that take long: a few groups are dealt so thinly that they hardly meet."""
    return max(groups, min(8 * groups, 2000), 1)


def _ensembles_of(part: str):
    for one in part.split(";"):
        numbers, configurations = one.split("|")
        pairs = [c.split(":") for c in configurations.split(",")]
        yield [float(x) for x in numbers.split(" ")], [(int(i), c) for i, c in pairs]


def _columns(table: pa.Table, levels: list[list[str]]) -> list[np.ndarray]:
    """Categories as level numbers (-1: none of them), then the numeric columns."""
    out = []
    for name, known in zip(SERIES, levels, strict=True):
        at = {level: i for i, level in enumerate(known)}
        out.append(np.array([at.get(v, -1) for v in table.column(name).to_pylist()], float))
    return out + [table.column(c).to_numpy().astype(float) for c in FEATURES]


def _fit(table: pa.Table, bins: int, seed: int) -> pa.Table:
    """All ensembles of one block, model and part."""
    first = table.slice(0, 1).to_pylist()[0]
    # the order in which rows arrive is not fixed
    table = table.sort_by([(c, "ascending") for c in (*SERIES, "Date")])
    levels = [sorted(set(table.column(c).to_pylist())) for c in SERIES]
    columns, target = _columns(table, levels), table.column("target").to_numpy().astype(float)
    out = {name: [] for name in _ARROW.names}
    data = None if first["model"] == "random_forest" else tr.binned(columns, _CATEGORY, bins)
    for numbers, configurations in _ensembles_of(first["part"]):
        if data is None:
            begin, end, all_trees = map(int, numbers)
            grown, base = tr.forest(columns, _CATEGORY, target, range(begin, end), seed), 0.0
            for tree in grown:
                tree.number[tree.column < 0] /= all_trees
            counts = [end - begin] * len(configurations)
        else:
            rate, depth, subsample = numbers
            counts = [i for i, _ in configurations]
            base, grown = tr.boost(data, target, tr.FAMILIES[first["model"]], rate, max(counts), int(depth), subsample, seed)
        one = tr.packed(grown)
        row = {
            **{c: first[c] for c in ("fold_id", "horizon", "model", "part", "block")},
            "block_rows": table.num_rows, "base": base,
            **{f"levels_{i}": v for i, v in enumerate(levels)},
            "configurations": [c for _, c in configurations], "counts": counts,
            "roots": one.roots, "columns": one.column, "children": one.child, "numbers": one.number,
        }
        for name, value in row.items():
            out[name].append(value)
    return pa.table({name: pa.array(out[name], field.type) for name, field in zip(_ARROW.names, _ARROW, strict=True)})


def _checked(table: pa.Table) -> pa.Table:
    for c in ("target", *FEATURES):
        values = table.column(c).to_numpy()
        if not np.all(np.isfinite(values.astype(float))):
            raise ValueError(f"fitting needs finite values: {c}")
    return table


def fit_trees(training: DataFrame, candidates: Iterable[tuple[str, int, str, int]], forest_trees: int = FOREST_TREES, block_rows: int = BLOCK_ROWS, bins: int = BINS, seed: int = SEED) -> DataFrame:
    """One row for each ensemble and block, as node arrays; written once."""
    spark = training.sparkSession
    parts = planned_parts(candidates, forest_trees)
    sizes = training.groupBy(*POPULATION).agg(F.count(F.lit(1)).alias("_n"))
    plan = spark.createDataFrame(parts, "fold_id int, horizon int, model string, part string")
    # one row for each task of a population: the plan's size
    tasks = plan.join(sizes, POPULATION).withColumn("_blocks", F.ceil(F.col("_n") / block_rows).cast("long"))
    groups = tasks.agg(F.sum("_blocks"), F.count(F.lit(1))).first()
    if groups[1] != len(parts):
        raise ValueError("the plan has populations without training rows")
    keys = [*POPULATION, "model", "part", "block"]
    rows = (
        training.select(*POPULATION, *SERIES, "Date", *FEATURES, "target")
        .join(F.broadcast(tasks.drop("_n")), POPULATION)
        .withColumn("block", F.pmod(F.xxhash64(*SERIES, "Date"), F.col("_blocks")))
        .drop("_blocks")
    )
    fitted = rows.repartition(_partitions(int(groups[0])), *keys).groupBy(*keys).applyInArrow(lambda table: _fit(_checked(table), bins, seed), _MODELS)
    return stored(fitted, "ensembles")


_SCORES = "fold_id int, " + ", ".join(f"{c} string" for c in SERIES) + ", horizon int, model string, configuration_id string, share double, block_rows long"


def _score(models: pa.Table, origins: pa.Table) -> pa.Table:
    names = ["fold_id", *SERIES, "horizon", "model", "configuration_id", "share", "block_rows"]
    pieces = []
    for m in models.to_pylist() if origins.num_rows else []:
        one = tr.Packed(*(np.array(m[c]) for c in ("roots", "columns", "children", "numbers")))
        columns = np.stack(_columns(origins, [m[f"levels_{i}"] for i in range(len(SERIES))]))
        # a block of rows and all trees at a time
        for begin in range(0, origins.num_rows, 1024):
            part = origins.slice(begin, 1024)
            leaves = one.leaves(columns[:, begin : begin + 1024], np.array(_CATEGORY))
            for configuration, count in zip(m["configurations"], m["counts"], strict=True):
                n = part.num_rows
                pieces.append(
                    pa.table(
                        [
                            pa.array(np.full(n, m["fold_id"], np.int32)), *(part.column(c) for c in SERIES),
                            pa.array(np.full(n, m["horizon"], np.int32)), pa.array([m["model"]] * n), pa.array([configuration] * n),
                            pa.array(m["base"] + leaves[:, :count].sum(axis=1)), pa.array(np.full(n, m["block_rows"])),
                        ],
                        names=names,
                    )
                )
    kinds = [pa.int32(), *[pa.string()] * len(SERIES), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return pa.concat_tables([p.cast(schema) for p in pieces]) if pieces else schema.empty_table()


def score_trees(models: DataFrame, origins: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """fold_id, series, horizon, model, configuration_id, prediction of every origin of a model's fold."""
    sizes = origins.groupBy("fold_id").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("long").alias("_chunks"))
    keys = ["fold_id", "horizon", "model", "part", "block", "chunk"]
    # a fold's number of chunks; then each ensemble once for every chunk
    held = models.join(F.broadcast(sizes), "fold_id").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks")
    # renamed, as a grouping of a table with itself would be ambiguous
    tasks_of = ["fold_id", "horizon", "model", "part", "block"]
    asked = models.select(*[F.col(c).alias(f"_{c}") for c in tasks_of]).distinct()
    points = (
        origins.select("fold_id", *SERIES, *FEATURES)
        .join(F.broadcast(sizes), "fold_id")
        .withColumn("chunk", F.pmod(F.xxhash64(*SERIES), F.col("_chunks")))
        .join(F.broadcast(asked), F.col("fold_id") == F.col("_fold_id"))  # keys of the tasks that fitted, as many as the plan has
        .select(*[F.col(f"_{c}").alias(c) for c in tasks_of], "chunk", *SERIES, *FEATURES)
    )
    tasks = _partitions(models.select("part").count())
    shares = held.repartition(tasks, *keys).groupBy(*keys).cogroup(points.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(_score, _SCORES)
    population = models.select(*POPULATION, "model", "block", "block_rows").distinct().groupBy(*POPULATION, "model").agg(F.sum("block_rows").alias("_rows"))
    weighted = shares.join(F.broadcast(population), [*POPULATION, "model"])
    return weighted.groupBy("fold_id", *SERIES, "horizon", "model", "configuration_id").agg(
        F.sum(F.col("share") * (F.col("block_rows") / F.col("_rows"))).alias("prediction")
    )

import numpy as np
import pytest

from shelfline.fixed import FEATURES, SERIES
from shelfline.operators import ensembles as en
from shelfline.operators import models as mo
from shelfline.operators import trees as tr

CATEGORY = [True, False, False, False]


def block(n=120, seed=1):
    rng = np.random.default_rng(seed)
    columns = [rng.integers(0, 4, n).astype(float), np.round(rng.standard_normal(n), 1), rng.standard_normal(n), rng.integers(0, 3, n).astype(float)]
    target = 3 * (columns[0] == 2) + 2 * columns[1] + (columns[2] > 0.3) + rng.integers(-2, 3, n)
    return columns, target.astype(float)


def sides(data, rows):
    """Every split of every column, as (cell, rows of the first side, rows of the second one)."""
    for cell in range(data.begin[-1]):
        own = data.cells[rows, data.column[cell]]
        second = own == cell if data.category[data.column[cell]] else own > cell
        yield cell, rows[~second], rows[second]


def slow_leaves(data, family, gradient, rows, depth):
    """Leaves of one tree, as row lists, by trying every split anew."""
    score = lambda part: gradient[part].sum() ** 2 / (len(part) + family.penalty)
    ample = lambda *parts: all(len(p) >= max(family.least_rows, 1) for p in parts)

    def best(part):
        gains = [(score(a) + score(b) - score(part), -cell, a, b) for cell, a, b in sides(data, part) if ample(a, b)]
        return max(gains, key=lambda x: x[:2], default=(0.0,))

    if family.growth == "symmetric":
        leaves = [rows]
        for _ in range(depth):
            tried = []
            for cell in range(data.begin[-1]):
                pairs = [next((a, b) for c, a, b in sides(data, part) if c == cell) for part in leaves]
                if any(ample(*pair) for pair in pairs):
                    total = sum(score(a) + score(b) if ample(a, b) else score(part) for (a, b), part in zip(pairs, leaves, strict=True) if len(part))
                    tried.append((round(total, 9), -cell, pairs))
            top = max(tried, key=lambda x: x[:2], default=(-1.0,))
            if top[0] <= sum(score(p) for p in leaves if len(p)) + 1e-6:
                break
            leaves = [side for pair in top[2] for side in pair]
        return leaves
    leaves = [(rows, 0)]
    while len(leaves) < family.leaves:
        options = [(best(part), i) for i, (part, level) in enumerate(leaves) if level < depth and len(part)]
        options = [(o, i) for o, i in options if o[0] > 1e-6]
        if not options:
            break
        (_, _, a, b), i = max(options, key=lambda x: x[0][0])
        level = leaves[i][1]
        leaves[i : i + 1] = [(a, level + 1), (b, level + 1)]
    return [part for part, _ in leaves]


@pytest.mark.parametrize("name", list(tr.FAMILIES))
@pytest.mark.parametrize("bins", [5, 64])
def test_boosting_against_trying_every_split(name, bins):
    columns, target = block()
    family = tr.FAMILIES[name] if name != "lightgbm" else tr.Family("leaf_wise", 0.0, 5, 6)
    data = tr.binned(columns, CATEGORY, bins)
    base, trees = tr.boost(data, target, family, 0.3, 4, 3, 1.0, 7)
    fitted = np.full(len(target), target.mean())
    for _ in range(4):
        gradient = fitted - target
        for part in slow_leaves(data, family, gradient, np.arange(len(target)), 3):
            if len(part):
                fitted[part] -= 0.3 * gradient[part].sum() / (len(part) + family.penalty)
    found = base + tr.packed(trees).leaves(np.stack(columns), np.array(CATEGORY)).sum(axis=1)
    np.testing.assert_allclose(found, fitted, atol=1e-9)


def test_the_three_families_differ():
    columns, target = block(400)
    data = tr.binned(columns, CATEGORY, 32)
    packs = {name: tr.packed(tr.boost(data, target, family, 0.1, 3, 4, 1.0, 7)[1]) for name, family in tr.FAMILIES.items()}
    fitted = {name: p.leaves(np.stack(columns), np.array(CATEGORY)).sum(axis=1) for name, p in packs.items()}
    names = list(fitted)
    assert all(not np.allclose(fitted[a], fitted[b]) for a in names for b in names if a < b)
    first = packs["catboost"].column[:31]
    # nodes of a level share a column
    assert all(len({first[i] for i in range(2**d - 1, 2 ** (d + 1) - 1)}) == 1 for d in range(4))


def test_short_runs_are_prefixes_and_samples_are_fixed():
    columns, target = block()
    data = tr.binned(columns, CATEGORY, 32)
    long = tr.boost(data, target, tr.FAMILIES["xgboost"], 0.1, 9, 4, 0.8, 7)[1]
    short = tr.boost(data, target, tr.FAMILIES["xgboost"], 0.1, 4, 4, 0.8, 7)[1]
    for a, b in zip(long, short, strict=False):
        np.testing.assert_array_equal(a.column, b.column)
        np.testing.assert_array_equal(a.number, b.number)


def slow_forest_tree(columns, target, weight, rows):
    """Prediction of every row of ``rows``' subtree, by trying every distinct value."""
    inside = rows[weight[rows] > 0]
    w, y = weight[inside], target[inside]
    mean = (w * y).sum() / w.sum()
    if y.min() == y.max():
        return {int(r): mean for r in rows}
    options = []
    for f, values in enumerate(columns):
        distinct = np.unique(values[inside])
        for i, v in enumerate(distinct):
            last = i + 1 == len(distinct)
            if CATEGORY[f]:
                second, threshold = values == v, None
            elif last:
                continue
            else:
                middle = (v + distinct[i + 1]) / 2
                threshold = middle if middle < distinct[i + 1] else v
                second = values > threshold
            a, b = inside[~second[inside]], inside[second[inside]]
            if len(a) and len(b):
                gain = sum((weight[p] * target[p]).sum() ** 2 / weight[p].sum() for p in (a, b))
                options.append((gain, -f, -i, second))
    if not options:
        return {int(r): mean for r in rows}
    *_, second = max(options, key=lambda x: x[:3])
    return slow_forest_tree(columns, target, weight, rows[~second[rows]]) | slow_forest_tree(columns, target, weight, rows[second[rows]])


def test_forest_trees_against_trying_every_value():
    columns, target = block(60, 4)
    columns[2][1] = np.nextafter(columns[2][0], 9)  # neighbouring doubles have no middle
    trees = tr.forest(columns, CATEGORY, target, range(3), 11)
    for number, tree in enumerate(trees):
        draw = np.random.default_rng((11, number)).integers(0, 60, 60)
        weight = np.bincount(draw, minlength=60).astype(float)
        expected = slow_forest_tree(columns, target, weight, np.arange(60))
        found = tr.packed([tree]).leaves(np.stack(columns), np.array(CATEGORY))[:, 0]
        hit = weight > 0
        # every sampled row has its own target's mean, whatever ties the splits had
        np.testing.assert_allclose(found[hit], np.array([expected[i] for i in range(60)])[hit], atol=1e-9)


@pytest.fixture(scope="module")
def population(spark):
    rng = np.random.default_rng(5)
    kinds = "fold_id int, horizon int, SKU_ID string, Warehouse_ID string, Date date, " + ", ".join(f"{f} double" for f in FEATURES) + ", target double"
    rows = []
    for fold in (1, 2):
        for i in range(160):
            x = [float(v) for v in np.round(rng.standard_normal(len(FEATURES)), 2)]
            day = f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}"
            rows.append((fold, 7, f"S{i % 3}", f"W{i % 2}", day, *x, 2 * x[0] + (i % 3) + round(float(rng.standard_normal()), 1)))
    from pyspark.sql import functions as F

    training = spark.createDataFrame([(*r[:4], None, *r[5:]) for r in rows], kinds).drop("Date")
    dates = spark.createDataFrame([(r[0], r[5], r[4]) for r in rows], f"fold_id int, {FEATURES[0]} double, d string")
    training = training.join(dates, ["fold_id", FEATURES[0]]).withColumn("Date", F.to_date("d")).drop("d")
    training = training.dropDuplicates(["fold_id", *SERIES, "Date"])
    origins = training.select("fold_id", *SERIES, *FEATURES).dropDuplicates(["fold_id", *SERIES])
    return mo.stored(training, "t"), mo.stored(origins, "o")


PLAN = [(m, 7, c, f) for m in ("xgboost", "lightgbm", "catboost") for c in ("GBM001", "GBM003") for f in (1, 2)] + [("random_forest", 7, "fixed", f) for f in (1, 2)]


def test_a_small_plan_on_spark_equals_the_growers(spark, population):
    training, origins = population
    found = {(r.model, r.configuration_id, r.fold_id, r.SKU_ID, r.Warehouse_ID): r.prediction for r in mo.fit_candidates(training, origins, PLAN, forest_trees=30).collect()}
    assert len(found) == len(PLAN) * 6
    for fold in (1, 2):
        table = training.where(f"fold_id = {fold}").toArrow().sort_by([(c, "ascending") for c in (*SERIES, "Date")])
        points = origins.where(f"fold_id = {fold}").toArrow()
        levels = [sorted(set(table.column(c).to_pylist())) for c in SERIES]
        columns, target = en._columns(table, levels), table.column("target").to_numpy()
        asked, category = np.stack(en._columns(points, levels)), np.array(en._CATEGORY)
        data = tr.binned(columns, en._CATEGORY, en.BINS)
        for model in ("xgboost", "catboost", "lightgbm"):
            base, trees = tr.boost(data, target, tr.FAMILIES[model], 0.03, 100, 4, 0.8, mo.SEED)
            expected = base + tr.packed(trees).leaves(asked, category).sum(axis=1)
            for sku, wh, value in zip(points.column("SKU_ID").to_pylist(), points.column("Warehouse_ID").to_pylist(), expected, strict=True):
                assert found[model, "GBM001", fold, sku, wh] == pytest.approx(value)
        trees = tr.forest(columns, en._CATEGORY, target, range(30), mo.SEED)
        expected = tr.packed(trees).leaves(asked, category).mean(axis=1)
        for sku, wh, value in zip(points.column("SKU_ID").to_pylist(), points.column("Warehouse_ID").to_pylist(), expected, strict=True):
            assert found["random_forest", "fixed", fold, sku, wh] == pytest.approx(value)


def test_blocks_share_a_population_by_rows(spark, population):
    training, origins = population
    models = en.fit_trees(training, [("xgboost", 7, "GBM001", 1)], block_rows=60)
    sizes = [r.block_rows for r in models.collect()]
    rows = training.where("fold_id = 1").count()
    assert len(sizes) == -(-rows // 60) and sum(sizes) == rows
    scored = en.score_trees(models, origins, chunk_rows=2).collect()
    assert len(scored) == 6 and all(np.isfinite(r.prediction) for r in scored)


def test_unseen_levels_and_populations_are_refused(spark, population):
    from pyspark.sql import functions as F

    training, origins = population
    with pytest.raises(ValueError, match="unseen level SKU_ID NEW"):
        mo.fit_candidates(training, origins.withColumn("SKU_ID", F.lit("NEW")), PLAN[:1])
    with pytest.raises(ValueError, match="without training rows"):
        en.fit_trees(training, [("xgboost", 7, "GBM001", 3)])

"""Clusters, model search and interpretation on tables with a known answer."""

from itertools import permutations
from math import inf
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sylvagrid.operators import allometry, attribution, boosting, clusters, models, ranking
from sylvagrid.session import stage

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Target 3a + 1.5ab, c is irrelevant; every vector belongs to several rows."""
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(0, 1, (500, 3)), 6)
    data = []
    for i in range(1500):
        a, b, c = x[i % 500]
        data.append((f"r{i}", i % 500 % 9, a, b, c, 3 * a + 1.5 * a * b + rng.normal(0, 0.1)))
    return stage(spark.createDataFrame([(r, k, *map(float, v)) for r, k, *v in data], "row_id string, block int, a double, b double, c double, y double"))


@pytest.fixture(scope="module")
def searched(rows):
    results, nodes = boosting.search(rows, FEATURES, "block", "y", [5, 6], trials=12, max_features=3, test=1, validation=(2, 3), patience=4, min_trials=6)
    return results, nodes


@pytest.fixture(scope="module")
def found(searched):
    return attribution.forests(*searched)


# --- trees ---------------------------------------------------------------------


def plain_split(bins, g, h, rows, least, alpha, lam, allowed, width):
    """The best split of some rows by trying all of them: (gain, feature, bin)."""

    def soft(x):
        return (abs(x) - alpha if abs(x) > alpha else 0.0) * (1 if x > 0 else -1)

    def score(part):
        return soft(sum(g[i] for i in part)) ** 2 / (sum(h[i] for i in part) + lam)

    best = None
    for f in allowed:
        for b in range(width - 1):
            left, right = [i for i in rows if bins[i][f] <= b], [i for i in rows if bins[i][f] > b]
            if sum(h[i] for i in left) >= least and sum(h[i] for i in right) >= least:
                gain = score(left) + score(right) - score(rows)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, b)
    return best


def plain_tree(bins, g, h, rows, depth, least, alpha, lam, allowed, width):
    split = plain_split(bins, g, h, rows, least, alpha, lam, allowed, width) if depth else None
    if split is None or split[0] <= 1e-6:
        total = sum(g[i] for i in rows)
        value = -(abs(total) - alpha if abs(total) > alpha else 0.0) * (1 if total > 0 else -1) / (sum(h[i] for i in rows) + lam)
        return {i: value for i in rows}
    _, f, b = split
    out = {}
    for part in ([i for i in rows if bins[i][f] <= b], [i for i in rows if bins[i][f] > b]):
        out |= plain_tree(bins, g, h, part, depth - 1, least, alpha, lam, allowed, width)
    return out


def grown(bins, g, h, depth, least, alpha, lam, allowed, width):
    """One tree, grown beside a shallower one with other settings; its features as columns of `bins`."""
    cols = np.stack([bins[:, allowed].T, bins[:, allowed[::-1]].T])
    slots = np.ones((2, len(allowed)), bool)
    slots[1, -1] = False
    both = [np.array(x) for x in ((depth, 2), (least, 3), (alpha, 0.1), (lam, 1.0))]
    trees, value = boosting.grow(cols, slots, np.stack([g, -g]), np.stack([h, h]), *both, width=width)
    tree = trees[0]
    tree.feature = np.where(tree.feature >= 0, allowed[tree.feature], -1)
    return tree, value[0]


@pytest.mark.parametrize("depth, least, alpha, lam", [(1, 1, 0.0, 0.0), (3, 2, 0.3, 0.5), (4, 5, 0.1, 0.2), (6, 1, 0.5, 0.0)])
def test_a_tree_equals_an_exhaustive_search(depth, least, alpha, lam):
    rng = np.random.default_rng(depth)
    bins = rng.integers(0, 8, (60, 4))
    h = rng.integers(0, 4, 60).astype(float)
    g = np.where(h > 0, rng.normal(0, 3, 60), 0.0)
    allowed = np.array([0, 2, 3])
    tree, value = grown(bins, g, h, depth, least, alpha, lam, allowed, 8)
    live = [i for i in range(60) if h[i]]
    want = plain_tree(bins, g, h, live, depth, least, alpha, lam, allowed, 8)
    assert all(value[i] == pytest.approx(want[i]) for i in live)
    # rows without weight walk the same tree
    for i in range(60):
        at = 0
        while tree.feature[at] >= 0:
            at = (tree.left if bins[i][tree.feature[at]] <= tree.cut[at] else tree.right)[at]
        assert value[i] == tree.value[at]


def test_boosting_lowers_the_error_and_counts_rows():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 64, (200, 2)).astype(np.uint8)
    y = bins[:, 0] / 10 + (bins[:, 1] > 30)
    n = rng.integers(1, 5, 200)
    data = boosting.Data(bins, n, n * y, n * y * y, np.zeros(200, int))
    setting = SimpleNamespace(seed=1, trial=0, chosen=[0, 1], n_estimators=60, max_depth=3, min_child_weight=1, subsample=0.9, colsample_bytree=1.0, learning_rate=0.2, reg_alpha=0.0, reg_lambda=0.1)
    out, start, trees = boosting.boost(data, [np.ones(200, bool)], [setting])[0]
    assert start == pytest.approx((n * y).sum() / n.sum()) and len(trees) == 60
    assert boosting.r2(data, out, np.ones(200, bool)) > 0.97
    # R2 from sums is R2 over rows
    p, t = np.repeat(out, n), np.repeat(y, n)
    assert boosting.r2(data, out, np.ones(200, bool)) == pytest.approx(1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    # a trial does not depend on those beside it
    other = SimpleNamespace(**{**vars(setting), "trial": 1, "n_estimators": 70, "max_depth": 6, "chosen": [1]})
    again = boosting.boost(data, [np.arange(200) % 3 > 0, np.ones(200, bool)], [other, setting])[1]
    assert np.array_equal(out, again[0]) and len(again[2]) == 60


def test_vectors_alike_in_the_chosen_predictors_are_fitted_as_one_cell(monkeypatch):
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 64, (3000, 12)).astype(np.uint8)
    bins[:, [3, 7]] = rng.integers(0, 5, (3000, 2))
    n = rng.integers(1, 5, 3000)
    # sums of quarters are exact in any order
    sum_y = n * (bins[:, 3] + (bins[:, 7] > 2) * 0.5) + rng.integers(-8, 9, 3000) / 4
    fitted = np.arange(3000) % 4 > 0
    setting = SimpleNamespace(run_id=0, seed=3, trial=1, chosen=[3, 7], n_estimators=9, max_depth=4, min_child_weight=2, subsample=0.7, colsample_bytree=1.0, learning_rate=0.5, reg_alpha=0.1, reg_lambda=0.2)
    widths, grow = [], boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda cols, *a: widths.append(cols.shape[2]) or grow(cols, *a))
    got, _, trees = boosting.boost(boosting.Data(bins, n, sum_y, sum_y, n), [fitted], [setting])[0]
    assert set(widths) == {25} and len(trees) == 9
    # the same draws on single vectors
    random = np.random.default_rng([3, 1])
    out = np.full(3000, sum_y[fitted].sum() / n[fitted].sum())
    for _ in range(9):
        h = np.where(fitted & (random.random(3000) < 0.7), n, 0.0)
        random.permutation([3, 7])
        g = np.where(h > 0, out * n - sum_y, 0.0)
        one = [np.array([x]) for x in (4, 2, 0.1, 0.2)]
        out += 0.5 * grow(bins[:, [3, 7]].T[None].astype(int), np.ones((1, 2), bool), g[None], h[None], *one)[1][0]
    assert got == pytest.approx(out)
    # many predictors leave no vectors alike, and no two that differ become one
    first, cell = boosting.alike(bins, list(range(12)))
    assert len(first) == len(np.unique(bins, axis=0)) and (bins[first[cell]] == bins).all()


def test_batches_hold_every_trial_once_within_their_bounds(monkeypatch):
    monkeypatch.setattr(boosting, "CELLS", 2000)
    bins = np.random.default_rng(1).integers(0, 64, (300, 5)).astype(np.uint8)
    data = boosting.Data(bins, np.ones(300, int), np.zeros(300), np.zeros(300), np.zeros(300, int))
    trials = [SimpleNamespace(run_id=t % 2, trial=t // 2, chosen=list(range(1 + t % 5))) for t in range(40)]
    some = list(boosting.batches(data, trials, 5))
    assert sorted((t.run_id, t.trial) for b in some for t in b) == sorted((t.run_id, t.trial) for t in trials)
    assert all(len(b) == 1 or len(b) * max(300, *(5 * len(boosting.alike(bins, t.chosen)[0]) for t in b)) <= 2000 for b in some) and len(some[0]) > 1


def test_the_histogram_of_a_level_gives_the_same_split(spark, rows):
    vectors = boosting.feature_vectors(rows, FEATURES, "block", "y")
    assert vectors.count() == 500 and vectors.agg(F.sum("n")).first()[0] == 1500
    cuts = boosting.cut_points(vectors, FEATURES)
    best = boosting.split_gains(boosting.level_histogram(vectors, FEATURES, cuts), alpha=0.2, lam=0.4, least=5).orderBy(F.desc("gain"), "feature", "bin").first()
    table = vectors.toPandas()
    points = {r["feature"]: np.array(r["cuts"]) for r in cuts.collect()}
    bins = np.stack([np.searchsorted(points[f], table[f], side="left") for f in FEATURES], axis=1)
    mean = table.sum_y.sum() / table.n.sum()
    g = (mean * table.n - table.sum_y).to_numpy()
    tree, _ = grown(bins, g, table.n.to_numpy(float), 1, 5, 0.2, 0.4, np.arange(3), 64)
    assert (FEATURES[tree.feature[0]], tree.cut[0]) == (best["feature"], best["bin"])
    assert best["gain"] == pytest.approx(tree.gain[0])


def test_cut_points_and_bins_equal_numpy(spark, monkeypatch):
    # no group goes into one task's hash map
    monkeypatch.delattr(boosting.F, "percentile")
    rng = np.random.default_rng(9)
    table = np.stack([rng.normal(0, 9, 700).round(1), rng.integers(0, 3, 700).astype(float), np.full(700, 4.0)], axis=1)
    vectors = spark.createDataFrame([(*map(float, x), i % 5 + 1, float(i % 7)) for i, x in enumerate(table)], [*FEATURES, "n", "sum_y"])
    cuts = boosting.cut_points(vectors, FEATURES, 20)
    points = {r["feature"]: np.array(r["cuts"]) for r in cuts.collect()}
    got = {(r["feature"], r["bin"]): (r["threshold"], r["n"], r["sum_y"]) for r in boosting.level_histogram(vectors, FEATURES, cuts).collect()}
    want = {}
    for k, f in enumerate(FEATURES):
        assert points[f] == pytest.approx(np.percentile(table[:, k], 5 * np.arange(1, 20)))
        for i, b in enumerate(np.searchsorted(points[f], table[:, k], side="left").tolist()):
            _, n, y = want.get((f, b), (0, 0, 0))
            want[f, b] = (points[f][b] if b < 19 else None, n + i % 5 + 1, y + i % 7)
    assert got == want
    none = vectors.where("n < 0")
    assert {r["feature"]: r["cuts"] for r in boosting.cut_points(none, FEATURES).collect()} == dict.fromkeys(FEATURES)
    assert boosting.level_histogram(none, FEATURES, boosting.cut_points(none, FEATURES)).count() == 0


def test_models_are_fitted_on_all_rows(spark, rows, monkeypatch):
    from sylvagrid.plans import learning

    # the bounds that rows and vectors used to have
    monkeypatch.setattr(boosting.feature_vectors, "__defaults__", (10,))
    assert boosting.feature_vectors(rows, FEATURES, "block", "y").agg(F.count("n"), F.sum("n")).first() == (500, 1500)
    data = [(i, 1995 + i % 2, float(i), 0.0, i % 5 / 2, *[float(i * (k + 1) % 41) for k in range(39)]) for i in range(40)]
    table = spark.createDataFrame(data, ["cell", "year_start", "x", "y", learning.TARGET, *learning.FEATURES])
    asked = {}
    monkeypatch.setattr(learning, "modelling_rows", lambda v, features, **options: asked.update(options) or table)
    got = learning.table_of(None).orderBy("x").toPandas()
    assert not asked.get("cap") and len(got) == 40 and got.row_id[3] == "3_1996"
    for f in (learning.TARGET, *learning.FEATURES):
        values = table.orderBy("x").toPandas()[f]
        assert got[f].to_numpy() == pytest.approx(((values - values.mean()) / values.std()).to_numpy())


def test_a_run_gets_the_trials_it_needs_in_any_case(rows, searched, monkeypatch):
    asked, spread = [], boosting.spread
    monkeypatch.setattr(boosting, "spread", lambda df, *keys: asked.append(df.count()) or spread(df, *keys))
    results, _ = boosting.search(rows, FEATURES, "block", "y", [5], trials=12, max_features=3, test=1, validation=(2, 3), patience=4, min_trials=2)
    assert sum(asked[:-1]) == results.first()["trials_completed"] and asked[0] == 6


def test_vectors_go_to_the_tasks_as_bins(spark):
    vectors = spark.createDataFrame([(3, 0.5, 9.0, 2, 1.5, 2.5, 20), (4, 0.1, -1.0, 1, 0.5, 0.25, 10)], "block int, a double, b double, n long, sum_y double, sum_yy double, vector long")
    cuts = {"a": np.array([0.2, 0.5, 0.7]), "b": np.array([])}
    got = [tuple(r) for r in boosting.in_bins(vectors.orderBy("vector"), ["a", "b"], "block", cuts).collect()]
    assert got == [(4, 1, 0.5, 0.25, bytes([0, 0])), (3, 2, 1.5, 2.5, bytes([1, 0]))]


def test_vectors_are_alike_to_nine_digits(spark):
    rows = [(1, 0.5, 1.0), (1, 0.5, 2.0), (1, 0.5 + 1e-12, 4.0), (1, 0.6, 8.0), (2, 0.5, 16.0)]
    got = boosting.feature_vectors(spark.createDataFrame(rows, "block int, f double, y double"), ["f"], "block", "y")
    assert sorted(r[:5] for r in got.collect()) == [(1, 0.5, 3, 7.0, 21.0), (1, 0.6, 1, 8.0, 64.0), (2, 0.5, 1, 16.0, 256.0)]


def test_split_gains_take_all_vectors(spark, monkeypatch):
    from sylvagrid.plans import learning, views

    v = views.Views(spark, "/root/testdata/sf0.01")
    monkeypatch.setattr(boosting.feature_vectors, "__defaults__", (10,))
    got = learning.split_gains(v).selectExpr("n_left + n_right AS n").distinct().collect()
    assert [r["n"] for r in got] == [learning.modelling_rows(v).count()]


# --- search --------------------------------------------------------------------


def test_settings_depend_on_the_seed_only(spark):
    one = boosting.trial_settings(spark, FEATURES, [1, 2], 30, 10).orderBy("run_id", "trial").collect()
    assert one[:30] == boosting.trial_settings(spark, FEATURES, [1], 30, 10).orderBy("trial").collect()
    assert one[0][3:] != one[30][3:]
    for name, (low, high) in boosting.RANGES.items():
        values = [r[name] for r in one]
        assert low <= min(values) and max(values) <= high and len(set(values)) > 3
    assert {len(r["chosen"]) for r in one} == {1, 2, 3} and all(list(r["chosen"]) == sorted(set(r["chosen"])) for r in one)


def test_patience_starts_after_the_least_number_of_trials():
    scores = [0.1, 0.5, 0.2, 0.3, 0.4, 0.4, 0.45, 0.6, 0.1]
    assert boosting.stopped_at(scores, 3, 0) == (1, 5, True)
    assert boosting.stopped_at(scores, 3, 4) == (1, 7, True)
    assert boosting.stopped_at(scores, 9, 4) == (7, 9, False)


def test_blocks_are_split_whole():
    for seed in range(20):
        tested, held = boosting.block_parts(list(range(15)), seed, 2, (3, 4))
        assert len(tested) == 2 and len(held) in (3, 4) and not tested & held
    assert boosting.block_parts([0], 1, 2, (3, 4)) == (set(), set())


def test_search_reports_runs(searched, rows):
    results, nodes = searched
    got = results.orderBy("run_id").collect()
    assert [r["seed"] for r in got] == [5, 6]
    for r in got:
        assert 6 <= r["trials_completed"] <= 12 and set(r["features"]) <= set(FEATURES) and set(r["importance"]) <= set(r["features"])
        assert sum(r["importance"].values()) == pytest.approx(1)
        assert set(r["params"]) == set(boosting.RANGES)
    assert max(r["val_r2"] for r in got) > 0.5
    assert nodes.where("feature IS NOT NULL AND left < 0").count() == 0


def test_batches_of_trials_change_no_result(rows, searched):
    again, nodes = boosting.search(rows.repartition(5), FEATURES, "block", "y", [5, 6], trials=12, max_features=3, test=1, validation=(2, 3), patience=4, min_trials=6, batch=5)
    assert [r.asDict() for r in again.orderBy("run_id").collect()] == [r.asDict() for r in searched[0].orderBy("run_id").collect()]
    assert nodes.exceptAll(searched[1]).count() == 0


def test_search_without_rows(spark, rows):
    results, nodes = boosting.search(rows.where("false"), FEATURES, "block", "y", [1], trials=2, min_trials=1, patience=1)
    r = results.first()
    assert r["val_r2"] == -1.0 and r["start"] == 0.0 and nodes.where("feature IS NOT NULL").count() == 0


# --- interpretation ------------------------------------------------------------


def mixtures(model, x, z, features):
    """Prediction for every set of predictors taken from x, the others from z."""
    out = {}
    for bits in range(1 << len(features)):
        row = {f: np.array([x[f] if bits >> k & 1 else z[f]]) for k, f in enumerate(features)}
        out[bits] = model.predict(row)[0]
    return out


@pytest.fixture(scope="module")
def deep():
    """A model of six predictors with random trees."""
    rng = np.random.default_rng(3)
    features, rows = list("abcdef"), []
    for tree in range(4):
        nodes, todo = [], [(0, 0)]
        free = 1
        while todo:
            at, depth = todo.pop()
            if depth < 5 and rng.random() < 0.85:
                nodes.append((0, tree, at, features[rng.integers(6)], float(rng.normal()), free, free + 1, 0.0))
                todo += [(free, depth + 1), (free + 1, depth + 1)]
                free += 2
            else:
                nodes.append((0, tree, at, None, np.nan, -1, -1, float(rng.normal())))
        rows += nodes
    return attribution.Forest(0.7, features, pd.DataFrame(rows, columns=["run_id", "tree", "node", "feature", "threshold", "left", "right", "value"]))


def test_prediction_is_a_plain_walk(deep):
    rng = np.random.default_rng(4)
    rows = {f: rng.normal(size=40) for f in deep.features}
    for i, p in enumerate(deep.predict(rows)):
        want = deep.start
        for tree in deep.trees:
            nodes = {r.node: r for r in tree.itertuples()}
            r = nodes[0]
            while r.left >= 0:
                r = nodes[r.left if rows[r.feature][i] <= r.threshold else r.right]
            want += r.value
        assert p == pytest.approx(want)
        inside = [leaf.value for leaf in deep.leaves() if all(lo < rows[f][i] <= hi for f, lo, hi in zip(leaf.features, leaf.low, leaf.high))]
        assert len(inside) == len(deep.trees) and sum(inside) + deep.start == pytest.approx(want)


def test_attribution_equals_all_orders(deep):
    rng = np.random.default_rng(5)
    rows, base = ({f: rng.normal(size=n) for f in deep.features} for n in (3, 4))
    share = np.array([0.4, 0.3, 0.2, 0.1])
    got = attribution.attributions(deep.leaves(), deep.features, rows, base, share)
    orders = list(permutations(range(6)))
    for i in range(3):
        want = np.zeros(6)
        for j in range(4):
            value = mixtures(deep, {f: rows[f][i] for f in rows}, {f: base[f][j] for f in base}, deep.features)
            for order in orders:
                bits = 0
                for k in order:
                    want[k] += share[j] * (value[bits | 1 << k] - value[bits]) / len(orders)
                    bits |= 1 << k
        assert got[i] == pytest.approx(want)
        assert got[i].sum() == pytest.approx(deep.predict({f: rows[f][i : i + 1] for f in rows})[0] - (share * deep.predict(base)).sum())


def test_interaction_equals_all_subsets(deep):
    from math import factorial

    rng = np.random.default_rng(6)
    rows, base = ({f: rng.normal(size=n) for f in deep.features} for n in (4, 3))
    share = np.full(3, 1 / 3)
    for first, second in (("a", "b"), ("c", "f"), ("e", "b")):
        i, j = deep.features.index(first), deep.features.index(second)
        got = attribution.interactions(deep.leaves(), first, second, rows, base, share)
        for r in range(4):
            want = 0.0
            for z in range(3):
                value = mixtures(deep, {f: rows[f][r] for f in rows}, {f: base[f][z] for f in base}, deep.features)
                for bits in range(64):
                    if not bits >> i & 1 and not bits >> j & 1:
                        size = bits.bit_count()
                        weight = factorial(size) * factorial(4 - size) / factorial(5)
                        change = value[bits | 1 << i | 1 << j] - value[bits | 1 << i] - value[bits | 1 << j] + value[bits]
                        want += share[z] * weight * change / 2
            assert got[r] == pytest.approx(want)


def test_curve_is_the_mean_attribution_of_changed_rows(deep):
    rng = np.random.default_rng(7)
    rows, base = ({f: rng.normal(size=n) for f in deep.features} for n in (8, 5))
    share, n, grid = np.full(5, 0.2), rng.integers(1, 4, 8), np.linspace(-2, 2, 9)
    got = attribution.curve(deep.leaves(), "c", grid, rows, n, base, share)
    for g, effect in zip(grid, got):
        changed = rows | {"c": np.full(8, g)}
        phi = attribution.attributions(deep.leaves(), deep.features, changed, base, share)[:, 2]
        assert effect == pytest.approx((phi * n).sum() / n.sum())


def test_permutation_ranks_the_relevant_predictor_first(found, rows):
    got = {r["feature"]: r for r in attribution.permutation_importance(found, rows, "y", "row_id", 3, size=400).collect()}
    assert got["a"]["importance"] == max(r["importance"] for r in got.values()) > 0.3


def test_permutation_takes_all_rows_of_each_model(spark, rows, deep, monkeypatch):
    monkeypatch.setattr(attribution, "sample", None)
    monkeypatch.setattr(attribution, "ROWS", 500)
    monkeypatch.setattr(attribution, "VECTORS", 64)
    table = rows.selectExpr("row_id", "y", "a", "b", "c", "-a AS d", "a * b AS e", "floor(c) * 1.0D AS f")
    table = table.unionByName(table.where("a > 0").withColumn("row_id", F.concat("row_id", F.lit("again"))))
    models = {0: deep, 3: attribution.Forest(0.1, list("abcdef"), deep.nodes[deep.nodes.tree < 2])}
    assert attribution.permutation_importance({}, table, "y", "row_id").count() == 0
    got = {r["feature"]: r for r in attribution.permutation_importance(models, table, "y", "row_id", 3, seed=8).collect()}
    # the same orders on plain rows, in the order of vectors and targets
    plain = table.withColumn("v", F.xxhash64(*"abcdef")).orderBy("v", "y").toPandas()
    x, y, n = {f: plain[f].to_numpy() for f in "abcdef"}, plain.y.to_numpy(), len(plain)
    orders = [attribution.shuffled(np.arange(n), n, (8, k)) for k in range(3)]
    assert n > 2000 and all(sorted(o) == list(range(n)) for o in orders)

    def r2(model, x):
        return 1 - ((y - model.predict(x)) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    for f in "abcdef":
        drops = [[r2(m, x) - r2(m, x | {f: x[f][o]}) for o in orders] for m in models.values()]
        assert got[f]["importance"] == pytest.approx(np.mean(drops)) and got[f]["spread"] == pytest.approx(np.mean(np.std(drops, axis=1)))
        assert got[f]["n_models"] == 2


def test_a_random_order_holds_every_row_once():
    for n in (1, 2, 3, 64, 65, 1000):
        order = attribution.shuffled(np.arange(n), n, (1, 2))
        assert sorted(order) == list(range(n))
    order = attribution.shuffled(np.arange(5000), 5000, (1, 3))
    assert abs(np.corrcoef(np.arange(5000), order)[0, 1]) < 0.05 and abs(np.corrcoef(order[1:], order[:-1])[0, 1]) < 0.05
    assert (order != attribution.shuffled(np.arange(5000), 5000, (1, 4))).mean() > 0.99
    assert list(attribution.shuffled(np.array([7, 4999]), 5000, (1, 3))) == [order[7], order[4999]]


def test_shapley_values_add_up(found, rows):
    values = attribution.shapley_values(found, rows, "row_id", 60, 20)
    totals = {(r["run_id"], r["row"]): r["phi"] for r in values.groupBy("run_id", "row").agg(F.sum("phi").alias("phi")).collect()}
    names = sorted({f for m in found.values() for f in m.features})
    explained, n = attribution.distinct_rows(attribution.sample(rows, names, "row_id", 60, 42))
    base, times = attribution.distinct_rows(attribution.sample(rows, names, "row_id", 20, 43))
    for run, model in found.items():
        p, mean = model.predict(explained), (model.predict(base) * times).sum() / times.sum()
        assert all(totals[run, i] == pytest.approx(p[i] - mean) for i in range(len(n)))
    got = {r["feature"]: r for r in attribution.shapley_importance(found, rows, "row_id", 60, 20).collect()}
    assert got["a"]["n_rows"] == 60 and got["a"]["mean_abs"] == max(r["mean_abs"] for r in got.values())


def test_curves_rise_with_a(found, rows):
    got = attribution.attribution_curves(found, rows, ["a"], "row_id", -1.5, 1.5, 5, 200, 50).orderBy("run_id", "x").collect()
    assert len(got) == 5 * sum("a" in m.features for m in found.values())
    assert got[4]["effect"] - got[0]["effect"] > 2


def test_interaction_follows_the_product(found, rows):
    both = {run: m for run, m in found.items() if {"a", "b"} <= set(m.features)}
    if both:
        got = attribution.interaction_values(both, rows, "a", "b", "row_id", 120, 40)
        assert got.select(F.corr(F.col("interaction"), F.col("value_1") * F.col("value_2"))).first()[0] > 0.5
    assert attribution.top_pair(found, ("a", "nothing")) in [tuple(p) for m in found.values() for p in permutations(m.features, 2)] + [None]


# --- clusters ------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    pts = [(float(cx + x), float(cy + y)) for cx, cy in ((0, 0), (100, 0), (0, 100)) for x, y in rng.normal(0, 1, (40, 2))]
    return spark.createDataFrame(pts, "x double, y double")


def test_clusters_find_separate_blobs(blobs):
    assert clusters.cluster_count(blobs, 2, 6, min_size=10) == 3
    sizes = clusters.k_means(blobs, 3).groupBy("cluster_id").count().collect()
    assert sorted(r["count"] for r in sizes) == [40, 40, 40]
    assert clusters.cluster_count(blobs, 2, 6, min_size=60) == 2  # the size rule leaves no range


def test_steps_equal_plain_ones(blobs):
    xy = np.array([tuple(r) for r in blobs.collect()])
    starts = [xy[:4], xy[[0, 50]]]
    centres, cost = clusters.lloyd(blobs, [s.copy() for s in starts])
    for start, got, value in zip(starts, centres, cost):
        c = start.copy()
        for _ in range(60):
            at = ((xy[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([xy[at == k].mean(axis=0) if (at == k).any() else c[k] for k in range(len(c))])
        assert got == pytest.approx(c, abs=1e-5)
        assert value == pytest.approx(((xy[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())


def test_points_at_one_place_are_one_with_their_count(spark, blobs, monkeypatch):
    seen, lloyd = [], clusters.lloyd
    monkeypatch.setattr(clusters, "lloyd", lambda points, *a: seen.append(points) or lloyd(points, *a))
    one = clusters.fit_all(blobs, [3], 2)[3]
    again = clusters.fit_all(blobs.unionByName(blobs).unionByName(blobs), [3], 2)[3]
    assert seen[0].count() == seen[1].count() and again[0] == pytest.approx(one[0]) and again[1] == pytest.approx(3 * one[1])
    # of equally near centres the first, of equal centres too
    at, gap = clusters.nearest(np.array([[5.0, 0.0], [9.0, 0.0]]), np.array([[0.0, 0.0], [10.0, 0.0], [10.0, 0.0]]))
    assert at.tolist() == [0, 1] and gap.tolist() == [25.0, 1.0]


def test_ties_and_no_points(spark):
    points = spark.createDataFrame([(5.0, 0.0), (-1.0, 0.0)], "x double, y double")
    got = {r["x"]: r["cluster_id"] for r in clusters.assign(points, np.array([[0.0, 0.0], [10.0, 0.0]])).collect()}
    assert got == {5.0: 0, -1.0: 0}
    assert clusters.k_means(points.where("false"), 3).count() == 0
    same = spark.createDataFrame([(1.0, 1.0)] * 30, "x double, y double")
    assert {r["cluster_id"] for r in clusters.k_means(same, 2).collect()} == {0}
    assert inf not in [c for _, c in clusters.fit_all(same, [2], 2).values()]


# --- tables about models, fits -----------------------------------------------------


def test_fractions_are_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("g"))
    got = {r["part"]: r["count"] for r in models.fraction_split(df, ["g"], 1, [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).groupBy("part").count().collect()}
    assert got == {"train": 800, "validation": 100, "test": 100}


def test_lowess_keeps_a_line(spark):
    # a curve longer than any earlier bound, and one with an outlier that the robust passes ignore
    df = spark.createDataFrame([(1, float(x), 2.0 * x + 1) for x in range(400)], "g int, x double, y double")
    for r in models.lowess(df, ["g"], "x", "y", 0.3).collect():
        assert r["smooth"] == pytest.approx(r["y"])
    noisy = [(2, float(x), 3.0 * x + (x * 7 % 5 - 2) * 4.0 + (60.0 if x == 20 else 0.0)) for x in range(40)]
    df = spark.createDataFrame(noisy, "g int, x double, y double")
    off = {p: {r["x"]: abs(r["smooth"] - 3 * r["x"]) for r in models.lowess(df, ["g"], "x", "y", 0.5, p).collect()} for p in (0, 3)}
    assert off[3][20.0] < 0.5 * off[0][20.0]


def test_trim_drops_the_planted_outliers(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(2, 0.5, 880)
    good = [(1, i, float(a), float(1.5 * a + e)) for i, (a, e) in enumerate(zip(x, rng.normal(0, 0.1, 880)))]
    bad = [(1, 5000 + i, 2.0, 12.0 + i / 100) for i in range(120)]
    df = spark.createDataFrame(good + bad, "g int, i int, x double, y double")
    kept = allometry.trim_outliers(df, ["g"], "x", "y", 0.12)
    assert kept.where("i >= 5000").count() == 0
    assert kept.count() == 880


def test_rows_alike_are_scanned_once_by_quantile_lines(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 20, 300) / 4
    data = [("g" if i % 3 else None, float(a), float(a + b)) for i, (a, b) in enumerate(zip(x, rng.integers(-8, 9, 300) / 4))]
    one = spark.createDataFrame(data, "g string, x double, y double")
    more = one.unionByName(one).unionByName(one.where("x > 2"))
    scanned, scored = [], allometry._scored
    monkeypatch.setattr(allometry, "_scored", lambda rows, *a: scanned.append(rows.count()) or scored(rows, *a))
    got = allometry.quantile_lines(more, ["g"], "x", "y", refinements=1)
    assert set(scanned) == {len(set(data))}
    rows = [tuple(r) for r in more.collect()]
    for r in got.collect():
        mine = [(a, b) for g, a, b in rows if g == r["g"]]
        gaps = sorted(b - r["slope"] * a for a, b in mine)
        level = gaps[int(np.ceil(r["q"] * len(gaps) - 1e-9)) - 1]
        loss = np.mean([max(r["q"] * (v - level), (r["q"] - 1) * (v - level)) for v in gaps]) + 0.05 * abs(r["slope"])
        assert r["intercept"] == pytest.approx(level) and r["loss"] == pytest.approx(loss)
    assert got.count() == 6


def test_rounds_of_quantile_lines_share_their_splitters(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.uniform(0, 3, 800)
    data = [("g" if i % 3 else "h", float(a), float(2 * a + e)) for i, (a, e) in enumerate(zip(x, rng.normal(0, 0.4, 800)))]
    taken, splitters = [], ranking.splitters
    for module in (allometry, ranking):
        monkeypatch.setattr(module, "splitters", lambda *a: taken.append(a) or splitters(*a), raising=False)
    got = allometry.quantile_lines(spark.createDataFrame(data, "g string, x double, y double"), ["g"], "x", "y", refinements=2).collect()
    assert len(taken) == 1 and len(got) == 6
    for r in got:
        gaps = np.array([b - r["slope"] * a for g, a, b in data if g == r["g"]])
        level = np.sort(gaps)[int(np.ceil(r["q"] * len(gaps) - 1e-9)) - 1]
        off = gaps - level
        assert r["intercept"] == pytest.approx(level) and r["loss"] == pytest.approx(np.maximum(r["q"] * off, (r["q"] - 1) * off).mean() + 0.05 * abs(r["slope"]))


def test_quantile_lines_bracket_the_data(spark):
    rng = np.random.default_rng(10)
    x = rng.uniform(0, 3, 3000)
    y = 0.7 + 1.4 * x + rng.normal(0, 0.3, 3000)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "g int, x double, y double")
    got = {r["q"]: r for r in allometry.quantile_lines(df, ["g"], "x", "y", alpha=0.0).collect()}
    assert got[0.5]["slope"] == pytest.approx(1.4, abs=0.06)
    assert got[0.5]["intercept"] == pytest.approx(0.7, abs=0.1)
    for q in (0.15, 0.85):
        below = np.mean(y <= got[q]["intercept"] + got[q]["slope"] * x)
        assert below == pytest.approx(q, abs=0.01)

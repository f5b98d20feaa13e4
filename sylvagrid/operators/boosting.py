"""Model search by histogram-boosted trees on binned feature vectors.

Rows that share their predictors and their block (the cells of one climate cell and year) are one
feature vector with a count, a sum and a sum of squares of the target: squared error needs no more.
Spark reduces the rows to these vectors, cuts every predictor into at most `BINS` bins at quantiles,
and deals the trials out as rows of a table; a task fits a trial on the vectors, which all tasks share:
all of them, as one byte per predictor beside four numbers. A trial sees some predictors alone, so the
vectors alike in the bins of these are one cell for it, and its trees grow on cells. They grow level by
level: one histogram of (node, feature, bin) per level, split by the gain with L1, L2 and minimum child weight.

Models leave the search as node tables, one row per node of each tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sylvagrid.functions.noise import uniform_from
from sylvagrid.operators import ranking
from sylvagrid.session import spread, stage

BINS = 64
# trials that grow together in a task, and bins or vectors of theirs that it holds at once
TOGETHER, CELLS = 24, 4_000_000
# settings of a trial; whole numbers where both limits are
RANGES = {
    "n_estimators": (50, 300),
    "max_depth": (3, 8),
    "min_child_weight": (1, 10),
    "subsample": (0.6, 1.0),
    "colsample_bytree": (0.6, 1.0),
    "learning_rate": (0.01, 0.3),
    "reg_alpha": (0.0, 0.5),
    "reg_lambda": (0.0, 0.5),
}
SETTINGS = ["run_id int", "seed long", "trial int", *[f"{n} {'int' if isinstance(r[0], int) else 'double'}" for n, r in RANGES.items()], "chosen array<int>"]
NODES = "run_id int, tree int, node int, feature string, threshold double, left int, right int, value double, gain double"


# --- feature vectors -------------------------------------------------------------


def feature_vectors(rows: DataFrame, features: Sequence[str], block: str, target: str) -> DataFrame:
    """(block, features, n, sum_y, sum_yy): rows alike in block and predictors as one.

    Values are compared and summed to nine digits, so that the order in which partitions are added changes nothing.
    Rows alike in every digit are added up first, so that vectors are rounded, not rows.
    """
    y = F.col(target)
    sums = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sum_y"), F.sum(y * y).alias("sum_yy")]
    alike = rows.groupBy(block, *features).agg(*sums)
    sums = [F.sum("n").alias("n"), F.round(F.sum("sum_y"), 9).alias("sum_y"), F.round(F.sum("sum_yy"), 9).alias("sum_yy")]
    vectors = alike.groupBy(block, *[F.round(f, 9).alias(f) for f in features]).agg(*sums)
    return stage(vectors.withColumn("vector", F.xxhash64(block, *features)), "vectors")


def stacked(vectors: DataFrame, features: Sequence[str], *kept: str) -> DataFrame:
    """(kept, feature, x): one row per vector and predictor."""
    return vectors.select(*kept, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(list(kept), list(features), "feature", "x")


def cut_points(vectors: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """(feature, cuts): quantiles of every predictor over the vectors, `bins` - 1 of them; null without vectors. Staged."""
    shares = [k / bins for k in range(1, bins)]
    found = ranking.exact_quantiles(stacked(vectors, features), ["feature"], "x", shares, staged=True)
    names = vectors.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    return stage(names.join(found, "feature", "left"), "cuts")


def in_bins(vectors: DataFrame, features: Sequence[str], block: str, cuts: dict[str, np.ndarray]) -> DataFrame:
    """(block, n, sum_y, sum_yy, bins) in the order of the vectors: the bin of each predictor as a byte of `bins`."""
    kept = [block, "n", "sum_y", "sum_yy"]

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in frames:
            bins = np.stack([np.searchsorted(cuts[f], t[f].to_numpy(float), side="left") for f in features], axis=1).astype(np.uint8)
            yield t[kept].assign(bins=[row.tobytes() for row in bins])

    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInPandas(packed, ", ".join([f"`{c}` {types[c]}" for c in kept] + ["bins binary"]))


def level_histogram(vectors: DataFrame, features: Sequence[str], cuts: DataFrame) -> DataFrame:
    """(feature, bin, threshold, n, sum_y) of one node: the vectors counted by the bin of each predictor."""
    most = cuts.agg(F.max(F.size("cuts"))).first()[0] or 0
    long = stacked(vectors, features, "n", "sum_y").join(cuts, "feature")
    binned = ranking.with_place(long, "bin", F.col("cuts"), F.col("x"), max(most, 0).bit_length(), below=True)
    sums = binned.groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("sum_y").alias("sum_y"))
    return sums.join(cuts, "feature").select("feature", "bin", F.get("cuts", F.col("bin")).alias("threshold"), "n", "sum_y")


def shrunk(total: Column, alpha: float) -> Column:
    return F.signum(total) * F.greatest(F.abs(total) - alpha, F.lit(0.0))


def split_gains(histogram: DataFrame, alpha: float = 0.0, lam: float = 1.0, least: float = 1.0) -> DataFrame:
    """Gain of splitting a node after every bin of its histogram, for a start at the mean of the target."""
    feature = W.partitionBy("feature")
    upto = feature.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    left, all_n = F.sum("n").over(upto), F.sum("n").over(feature)
    total, part = F.sum("sum_y").over(feature), F.sum("sum_y").over(upto)
    # gradients about the mean: they sum to zero over the node
    g = part - left * total / all_n
    gain = shrunk(g, alpha) ** 2 / (left + lam) + shrunk(-g, alpha) ** 2 / (all_n - left + lam)
    out = histogram.select("feature", "bin", "threshold", left.alias("n_left"), (all_n - left).alias("n_right"), gain.alias("gain"))
    return out.where((F.col("n_left") >= least) & (F.col("n_right") >= least) & F.col("threshold").isNotNull())


# --- trees ---------------------------------------------------------------------


@dataclass
class Tree:
    """Arrays over nodes; `feature` is -1 at a leaf. Left: bin <= cut."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray


def pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`values` at some places, all of them valid: checking that would take twice the time."""
    return values.take(at, mode="clip")


def grow(
    cols: np.ndarray,
    slots: np.ndarray,
    g: np.ndarray,
    h: np.ndarray,
    depth: np.ndarray,
    least: np.ndarray,
    alpha: np.ndarray,
    lam: np.ndarray,
    width: int = BINS,
) -> tuple[list[Tree], np.ndarray]:
    """One tree for each of some trials, all of them level by level, and the value each row gets.

    `cols` holds the bins as trials x slots x rows; a trial may use the predictors in its valid `slots`. `g` and `h` are
    gradients and weights as trials x rows; rows of weight 0 are only routed. The features of the trees are slots. Of
    equal gains the first slot and the lowest bin win. No number of a trial depends on the others.
    """
    trials, size, rows = cols.shape
    live = [np.flatnonzero(x > 0) for x in h]
    usable = [np.flatnonzero(s) for s in slots]
    count = np.array([len(s) for s in usable])
    trained = [[pick(cols[t, k], some) for k in usable[t]] for t, some in enumerate(live)]
    lg, lh = ([pick(x[t], some) for t, some in enumerate(live)] for x in (g, h))
    flat, row, at = [np.ascontiguousarray(c).reshape(-1) for c in cols], np.arange(rows), [np.full(rows, t) for t in range(trials)]
    trial, total_g, total_h = np.arange(trials), g.sum(axis=1), h.sum(axis=1)
    feature, cut, child, won_gain = np.full(trials, -1), np.zeros(trials, int), np.full(trials, -1), np.zeros(trials)
    opened = np.arange(trials)
    for level in range(int(depth.max())):
        opened = opened[depth[trial[opened]] > level]
        if not len(opened):
            break
        # a row of the histogram is a predictor of a node, those of its trial alone
        owner, bounds = trial[opened], np.searchsorted(trial[opened], np.arange(trials + 1))
        many = count[owner]
        node = np.repeat(np.arange(len(opened)), many)
        slot = np.concatenate([np.tile(usable[t], last - first) for t, (first, last) in enumerate(zip(bounds, bounds[1:]))])
        hist_h, left_g = np.empty((len(node), width)), np.empty((len(node), width))
        row_at = np.append(0, many.cumsum())
        for t, (first, last) in enumerate(zip(bounds, bounds[1:])):
            if first == last:
                continue
            # rows of closed nodes go behind the open ones
            place = np.full(len(trial), (last - first) * width)
            place[opened[first:last]] = np.arange(last - first) * width
            base, cells = pick(place, pick(at[t], live[t])), (last - first + 1) * width
            own = slice(row_at[first], row_at[last])
            mine = [(x[own].reshape(last - first, count[t], width), w[t]) for x, w in ((hist_h, lh), (left_g, lg))]
            for k, column in enumerate(trained[t]):
                key = base + column
                for hist, weights in mine:
                    hist[:, k] = np.bincount(key, weights, cells)[:-width].reshape(-1, width)
        np.cumsum(left_g, axis=1, out=left_g)
        left_h = hist_h.cumsum(axis=1)
        low = least[owner][node, None]
        # a split after an empty bin is the one before it again
        good = (hist_h > 0) & (left_h >= low) & (total_h[opened][node, None] - left_h >= low)
        good[:, -1] = False
        spot = np.flatnonzero(good)
        if not len(spot):
            break
        who = node[spot // width]
        a, l = alpha[owner][who], lam[owner][who]
        part_g, part_h, all_g, all_h = left_g.ravel()[spot], left_h.ravel()[spot], total_g[opened][who], total_h[opened][who]

        def score(gradient: np.ndarray, weights: np.ndarray) -> np.ndarray:
            return np.maximum(np.abs(gradient) - a, 0) ** 2 / np.maximum(weights + l, 1e-12)

        gain = score(part_g, part_h) + score(all_g - part_g, all_h - part_h) - score(all_g, all_h)
        starts = np.flatnonzero(np.diff(who, prepend=-1))
        top = np.maximum.reduceat(gain, starts)
        reached = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(starts, len(who)))))
        split, first_at = np.unique(who[reached], return_index=True)
        best = reached[first_at]
        worth = gain[best] > 1e-6
        split, best = split[worth], best[worth]
        if not len(split):
            break
        won, b = np.divmod(spot[best], width)
        f = slot[won]
        parent, first = opened[split], len(trial) + 2 * np.arange(len(split))
        feature[parent], cut[parent], child[parent], won_gain[parent] = f, b, first, gain[best]

        def grown(values: np.ndarray, new: np.ndarray) -> np.ndarray:
            return np.concatenate([values, new])

        def both(left: np.ndarray, total: np.ndarray) -> np.ndarray:
            return np.stack([left, total - left], axis=1).ravel()

        total_g, total_h = (grown(t, both(x[won, b], t[parent])) for t, x in ((total_g, left_g), (total_h, left_h)))
        trial = grown(trial, np.repeat(trial[parent], 2))
        more = 2 * len(split)
        feature, cut, child, won_gain = grown(feature, np.full(more, -1)), grown(cut, np.zeros(more, int)), grown(child, np.full(more, -1)), grown(won_gain, np.zeros(more))
        # closed nodes lead to themselves
        inner = feature >= 0
        start, bound, to = np.where(inner, feature, 0) * rows, np.where(inner, cut, width).astype(cols.dtype), np.where(inner, child, np.arange(len(trial)))
        for t in np.unique(trial[parent]):
            right = pick(flat[t], pick(start, at[t]) + row) > pick(bound, at[t])
            at[t] = pick(to, at[t]) + right
        opened = np.arange(first[0], first[0] + more)
    a, l = alpha[trial], lam[trial]
    value = -np.sign(total_g) * np.maximum(np.abs(total_g) - a, 0) / np.maximum(total_h + l, 1e-12)
    value = np.where(feature < 0, value, 0.0)
    trees = []
    for t in range(trials):
        own = np.flatnonzero(trial == t)
        number = np.zeros(len(trial), int)
        number[own] = np.arange(len(own))
        inner = feature[own] >= 0
        left = np.where(inner, number[child[own]], -1)
        right = np.where(inner, number[np.minimum(child[own] + 1, len(trial) - 1)], -1)
        trees.append(Tree(feature[own], cut[own], left, right, value[own], won_gain[own]))
    return trees, np.stack([pick(value, a) for a in at])


@dataclass
class Data:
    """The vectors as arrays: bins, weights, sums of the target and its squares, block numbers."""

    bins: np.ndarray
    n: np.ndarray
    sum_y: np.ndarray
    sum_yy: np.ndarray
    block: np.ndarray


def alike(bins: np.ndarray, chosen: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(a vector of every cell, the cell of every vector): vectors with the same bins of the chosen predictors are one cell."""
    code = np.zeros(len(bins), np.int64)
    for k, f in enumerate(chosen):
        if k and k % 7 == 0:  # seven bins and the dense number of a cell fit into 63 bits
            code = np.unique(code, return_inverse=True)[1]
        code = code * BINS + bins[:, f]
    _, first, cell = np.unique(code, return_index=True, return_inverse=True)
    return first, cell


def boost(data: Data, fitted: Sequence[np.ndarray], settings: Sequence) -> list[tuple[np.ndarray, float, list[Tree]]]:
    """Per trial: predictions for all vectors of a model fitted on those marked `fitted`, its start value and its trees.

    The trials grow together, tree by tree. Each tree sees a share of the vectors and of the chosen predictors, drawn
    from the seed and the trial; the drawn vectors are added up by cell, and the tree grows on the cells. Leaf values
    carry the learning rate; features are numbers of predictors.
    """
    order = sorted(range(len(settings)), key=lambda i: -settings[i].n_estimators)
    random = [np.random.default_rng([int(settings[i].seed), int(settings[i].trial)]) for i in order]
    chosen = [np.asarray(settings[i].chosen, np.int64) for i in order]
    named = [np.sort(c) for c in chosen]
    some = [max(1, int(settings[i].colsample_bytree * len(c))) for i, c in zip(order, chosen)]

    def column(name: str) -> np.ndarray:
        return np.array([getattr(settings[i], name) for i in order])

    last, depth, least, alpha, lam, rate, seen_share = map(column, ("n_estimators", "max_depth", "min_child_weight", "reg_alpha", "reg_lambda", "learning_rate", "subsample"))
    cells = [alike(data.bins, c) for c in named]
    most = max((len(first) for first, _ in cells), default=0)
    bins = np.zeros((len(order), max(map(len, named), default=0), most), data.bins.dtype)
    for t, (first, _) in enumerate(cells):
        bins[t, : len(named[t]), : len(first)] = data.bins[first][:, named[t]].T
    inside = [np.flatnonzero(fitted[i]) for i in order]
    parts = [(cell[own], data.n[own].astype(float), data.sum_y[own]) for own, (_, cell) in zip(inside, cells)]
    start = np.array([y.sum() / max(n.sum(), 1) for _, n, y in parts])
    out, trees = np.repeat(start[:, None], most, axis=1), [[] for _ in order]
    for k in range(int(last.max(initial=0))):
        n = int((last > k).sum())  # the first n trials go on
        h, sum_y = np.zeros((n, most)), np.zeros((n, most))
        slots = np.zeros((n, max(some[:n])), bool)
        allowed = np.zeros(slots.shape, np.int64)  # places among the chosen predictors
        for t in range(n):
            cell, weight, y = parts[t]
            seen = random[t].random(len(data.n))[inside[t]] < seen_share[t]
            if seen.any():
                weight, y = weight * seen, y * seen
            h[t], sum_y[t] = np.bincount(cell, weight, most), np.bincount(cell, y, most)
            allowed[t, : some[t]] = np.searchsorted(named[t], np.sort(random[t].permutation(chosen[t])[: some[t]]))
            slots[t, : some[t]] = True
        g = np.where(h > 0, out[:n] * h - sum_y, 0.0)
        grown, value = grow(bins[np.arange(n)[:, None], allowed], slots, g, h, depth[:n], least[:n], alpha[:n], lam[:n])
        out[:n] += rate[:n, None] * value
        for t, tree in enumerate(grown):
            tree.feature = np.where(tree.feature >= 0, named[t][allowed[t][tree.feature]], -1)
            tree.value = tree.value * rate[t]
            trees[t].append(tree)
    back = np.argsort(order)
    return [(out[j][cells[j][1]], float(start[j]), trees[j]) for j in back]


def batches(data: Data, trials: Sequence, size: int) -> Iterator[list]:
    """Trials that grow together: alike in the number of their cells, within the bounds of bins and of vectors held at once."""
    sizes = {(t.run_id, t.trial): len(alike(data.bins, np.sort(t.chosen))[0]) * size for t in trials}
    some: list = []
    for t in sorted(trials, key=lambda t: (sizes[t.run_id, t.trial], len(t.chosen))):
        held = max(sizes[t.run_id, t.trial], len(data.n)) * (len(some) + 1)
        if some and (len(some) == TOGETHER or held > CELLS):
            yield some
            some = []
        some.append(t)
    if some:
        yield some


def r2(data: Data, prediction: np.ndarray, part: np.ndarray) -> float:
    """R2 over the rows of some vectors, from their sums; -1 where it is undefined."""
    n, s, ss, p = data.n[part], data.sum_y[part], data.sum_yy[part], prediction[part]
    error, total = (n * p * p - 2 * p * s + ss).sum(), ss.sum() - s.sum() ** 2 / max(n.sum(), 1)
    return float(1 - error / total) if total > 0 else -1.0


# --- search --------------------------------------------------------------------


def trial_settings(spark: SparkSession, predictors: Sequence[str], seeds: Sequence[int], trials: int, max_features: int) -> DataFrame:
    """A row per run and trial: settings and predictor subset, drawn from hashes of (seed, trial, name)."""
    runs = F.explode(F.array(*[F.struct(F.lit(k).alias("run_id"), F.lit(int(s)).cast("long").alias("seed")) for k, s in enumerate(seeds)]))
    table = spark.range(trials).select(F.col("id").cast("int").alias("trial"), runs.alias("r")).select("r.*", "trial")

    def draw(name: str) -> Column:
        return uniform_from(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("trial").cast("string"), F.lit(name))))

    columns = []
    for name, (low, high) in RANGES.items():
        whole = isinstance(low, int)
        value = F.floor(low + draw(name) * (high - low + 1)).cast("int") if whole else F.lit(float(low)) + draw(name) * (high - low)
        columns.append(value.alias(name))
    order = F.array_sort(F.array(*[F.struct(draw(p).alias("u"), F.lit(k).alias("k")) for k, p in enumerate(predictors)]))
    n = 1 + F.floor(draw("n_features") * min(max_features, len(predictors))).cast("int")
    chosen = F.array_sort(F.slice(F.transform(order, lambda s: s["k"]), 1, n))
    return table.select("run_id", "seed", "trial", *columns, chosen.alias("chosen"))


def block_parts(blocks: Sequence, seed: int, test: int, validation: tuple[int, int]) -> tuple[set, set]:
    """Blocks for testing and for validation, drawn by the seed; the others train. Some block always trains."""
    random = np.random.default_rng([int(seed), 7])
    order = [blocks[i] for i in random.permutation(len(blocks))]
    some = int(random.integers(validation[0], validation[1] + 1))
    test = min(test, max(len(order) - 2, 0))
    some = min(some, max(len(order) - test - 1, 0))
    return set(order[:test]), set(order[test : test + some])


def stopped_at(scores: Sequence[float], patience: int, min_trials: int) -> tuple[int, int, bool]:
    """(best trial, trials done, patience ran out) of scores in their order."""
    best, since = 0, 0
    for k, s in enumerate(scores):
        if k == 0 or s > scores[best]:
            best, since = k, 0
        elif k >= min_trials:
            since += 1
        if since >= patience:
            return best, k + 1, True
    return best, len(scores), False


def search(
    rows: DataFrame,
    predictors: Sequence[str],
    block: str,
    target: str,
    seeds: Sequence[int],
    trials: int = 1000,
    max_features: int = 10,
    test: int = 2,
    validation: tuple[int, int] = (3, 4),
    patience: int = 40,
    min_trials: int = 100,
    batch: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Random search with blocked splits: one result row, and the node table of the refitted model, per seed.

    Whole blocks go to test, validation (a number between the limits) or training. A trial is scored by R2 on the
    validation blocks; a run stops after `patience` trials without a new best once `min_trials` ran. Its best trial is
    refitted on training and validation blocks and scored on the test blocks. Trials of all running runs are fitted
    `batch` at a time and judged in their order, so that the size of a batch changes no result; without `batch` a run
    gets the trials it needs in any case before its patience can run out.
    """
    spark = rows.sparkSession
    vectors = feature_vectors(rows, predictors, block, target)
    cuts = {r["feature"]: np.array(r["cuts"] or [], float) for r in cut_points(vectors, predictors).collect()}  # predictors x BINS
    table = in_bins(vectors.orderBy("vector"), predictors, block, cuts).toPandas()  # a byte per vector and predictor
    bins = np.frombuffer(b"".join(table["bins"]), np.uint8).reshape(-1, len(predictors))
    blocks = sorted(table[block].unique().tolist())
    codes = table[block].map({b: k for k, b in enumerate(blocks)}).to_numpy(np.int64) if len(table) else np.zeros(0, np.int64)
    data = Data(bins, table["n"].to_numpy(np.int64), table["sum_y"].to_numpy(float), table["sum_yy"].to_numpy(float), codes)
    parts = {}
    for run, seed in enumerate(seeds):
        tested, held = block_parts(range(len(blocks)), seed, test, validation)
        part = np.array([2 if k in tested else 1 if k in held else 0 for k in range(len(blocks))], np.int8)
        parts[run] = part[codes] if len(codes) else np.zeros(0, np.int8)
    shared = spark.sparkContext.broadcast((data, parts))
    settings = stage(trial_settings(spark, predictors, seeds, trials, max_features), "trials")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data, parts = shared.value
        for frame in frames:
            for some in batches(data, list(frame.itertuples()), max_features):
                fits = boost(data, [parts[t.run_id] == 0 for t in some], some)
                found = [(t.run_id, t.trial, r2(data, out, parts[t.run_id] == 1)) for t, (out, _, _) in zip(some, fits)]
                yield pd.DataFrame(found, columns=["run_id", "trial", "val_r2"])

    scores: dict[int, list[float]] = {run: [] for run in range(len(seeds))}
    running, ended = list(scores), {}
    while running and trials:
        wanted = F.lit(False)
        for run in running:
            done = len(scores[run])
            least = max(ended[run][0] + 1 if done else 0, min_trials) + patience
            upto = max(least, done + 1) if batch is None else done + batch
            wanted = wanted | ((F.col("run_id") == run) & F.col("trial").between(done, upto - 1))
        got = spread(settings.where(wanted), "run_id", "trial").mapInPandas(score, "run_id int, trial int, val_r2 double").collect()
        for r in sorted(got, key=lambda r: r["trial"]):
            scores[r["run_id"]].append(r["val_r2"])
        ended = {run: stopped_at(s, patience, min_trials) for run, s in scores.items()}
        running = [run for run in running if not ended[run][2] and len(scores[run]) < trials]

    names = list(predictors)

    def refit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data, parts = shared.value
        for frame in frames:
            for t in frame.itertuples():
                part = parts[t.run_id]
                out, start, trees = boost(data, [part < 2], [t])[0]
                yield pd.DataFrame({"run_id": [t.run_id], "tree": -1, "node": 0, "feature": None, "threshold": r2(data, out, part == 2), "left": -1, "right": -1, "value": start, "gain": 0.0})
                for k, tree in enumerate(trees):
                    inner = tree.feature >= 0
                    yield pd.DataFrame(
                        {
                            "run_id": t.run_id,
                            "tree": k,
                            "node": np.arange(len(tree.feature)),
                            "feature": [names[f] if f >= 0 else None for f in tree.feature],
                            "threshold": [cuts[names[f]][c] if f >= 0 else np.nan for f, c in zip(tree.feature, tree.cut.astype(int))],
                            "left": np.where(inner, tree.left, -1),
                            "right": np.where(inner, tree.right, -1),
                            "value": tree.value,
                            "gain": tree.gain,
                        }
                    )

    best = F.lit(False)
    for run, (at, _, _) in ended.items():
        best = best | ((F.col("run_id") == run) & (F.col("trial") == at))
    refitted = stage(spread(settings.where(best), "run_id").mapInPandas(refit, NODES), "models")
    nodes = refitted.where("tree >= 0")
    ends = [(run, seeds[run], float(scores[run][at]), done) for run, (at, done, _) in ended.items()]
    summary = spark.createDataFrame(ends, "run_id int, seed int, val_r2 double, trials_completed int")
    starts = refitted.where("tree < 0").select("run_id", F.col("threshold").alias("test_r2"), F.col("value").alias("start"))
    name = F.array(*[F.lit(p) for p in predictors])
    params = F.create_map(*[x for n in RANGES for x in (F.lit(n), F.col(n).cast("double"))])
    chosen = settings.where(best).select("run_id", F.array_sort(F.transform("chosen", lambda k: F.get(name, k))).alias("features"), params.alias("params"))
    results = summary.join(chosen, "run_id").join(starts, "run_id").join(gain_shares(nodes), "run_id", "left")
    results = results.select("run_id", "seed", "features", "params", "val_r2", "test_r2", "trials_completed", "start", F.coalesce("importance", F.create_map().cast("map<string,double>")).alias("importance"))
    return stage(results, "results"), nodes


def gain_shares(nodes: DataFrame) -> DataFrame:
    """(run_id, importance): mean gain of the splits by each predictor, as a share of the sum of these means."""
    means = nodes.where(F.col("feature").isNotNull()).groupBy("run_id", "feature").agg(F.avg("gain").alias("_g"))
    share = F.col("_g") / F.sum("_g").over(W.partitionBy("run_id"))
    pairs = means.select("run_id", F.struct("feature", share.alias("share")).alias("p"))
    return pairs.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list("p"))).alias("importance"))

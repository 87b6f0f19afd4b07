"""Probes of the evaluation grid: fits of many cells at once against single ones, learners against brute force."""

import pickle

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from skein.operators import learners, probes


def table(spark, x, y, length=1, splits=("train", "train", "valid", "test"), **more):
    rows = [(f"u{i:05d}", splits[i % len(splits)], length, [float(v) for v in r], True, int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "user_id string, split string, prefix_len int, embedding array<double>, label_available_t boolean, label_t int").select("*", *[F.lit(v).alias(k) for k, v in more.items()])


def noisy(seed, n=240, d=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(0.5, 4, d) + np.arange(d)
    return x, (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 2 - x[:, 1] + 1)))).astype(int)


def test_guards(spark):
    x, y = noisy(1)
    df = table(spark, x, y)
    for bad in ({"mode": "odd"}, {"kind": "odd"}):
        with pytest.raises(ValueError):
            probes.Probe(df, **bad)
    with pytest.raises(ValueError):
        probes.chosen_models({"a": 1}, ["b"])
    flat = spark.createDataFrame([("u", "train", 1, 5.0, 3, 1)], "user_id string, split string, prefix_len int, gap_mean double, next_event_token_id int, label_x int")
    assert probes.feature_columns(flat) == ["gap_mean"] and "next_event_token_id" in probes.feature_columns(flat, leaking=True)
    for few in (df.limit(9), df.withColumn("label_t", F.lit(1)), df.filter("split <> 'train'")):
        with pytest.raises(ValueError):
            probes.evaluation_grid({"m": probes.Probe(few)}, ["t"], [1])
    for mode, turn in (("RAW", "none"), ("zscore", "standardize"), ("l2_then_standardize", "l2"), ("L2_then_PCA_then_standardize", "l2_pca")):
        assert probes.Probe(df, mode=mode).turn == turn


def test_separable_and_skipped_cells(spark):
    x = [[float(i % 2) * 4 + 0.01 * i, 1.0] for i in range(80)]
    df = table(spark, x, [i // 1 % 2 for i in range(80)], splits=("train", "train", "test", "test"))
    lone = table(spark, x[:12], [1] * 12, length=2)
    for kind in ("logistic", "tabular"):
        out = probes.evaluation_grid({"m": probes.Probe(df.unionByName(lone), kind, "zscore")}, ["t"], [1, 2, 3]).collect()
        assert [(r.model_name, r.target, r.prefix_len, r.split) for r in out] == [("m", "t", 1, "test")] and out[0].roc_auc == 1.0 and out[0].num_rows == 40


def optimum(x, y, turn, pca=None):
    """(intercept, weights on the turned inputs, gradient there) by plain Newton on one cell."""
    a, shift = probes.turned(turn, pca, len(x), x.mean(0), np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    z = np.hstack([np.ones((len(x), 1)), (x - shift) @ a])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, ridge = np.zeros(z.shape[1]), np.diag(np.append(0.0, np.ones(a.shape[1])))
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b = b - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (w * (p - y)) + ridge @ b)
    return 1 / (1 + np.exp(-z @ b))


def test_cells_fitted_together_are_those_fitted_alone(spark):
    modes = [("none", None), ("standardize", None), ("l2_standardize", None), ("l2_pca", 3)]
    data = [noisy(k, 160 + 40 * k) for k in range(3)]
    df = None
    for k, (x, y) in enumerate(data):
        part = table(spark, x, y, length=k + 1)
        df = part if df is None else df.unionByName(part)
    df = df.repartition(5)
    grid = probes.Grid({m: probes.Probe(df, "logistic", m, pca) for m, pca in modes}, ["t"], [1, 2, 3])
    assert len(grid.cells) == 12
    got = {(r.model_name, r.prefix_len, r.user_id): r.prob for r in probes.scored(grid, grid.rows).join(grid.names, "cell").collect()}
    for k, (x, y) in enumerate(data):
        train = np.arange(len(y)) % 4 < 2
        for m, pca in modes:
            z = x / np.linalg.norm(x, axis=1, keepdims=True) if m.startswith("l2") else x
            want = optimum(z[train], y[train], probes.MODES[m], pca)
            have = [got[m, k + 1, f"u{i:05d}"] for i in np.flatnonzero(train)]
            assert np.allclose(have, want, atol=1e-6)


def jobs_of(spark, work):
    sc, name = spark.sparkContext, f"jobs{id(work)}"
    sc.setJobGroup(name, name)
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name))


def test_number_of_jobs_does_not_follow_the_cells(spark):
    x, y = noisy(5)
    df = table(spark, x, y).withColumn("label_s", 1 - F.col("label_t")).withColumn("label_available_s", F.lit(True))
    wide = df.withColumn("prefix_len", F.explode(F.array(*[F.lit(k) for k in range(1, 7)])))
    few = jobs_of(spark, lambda: probes.evaluation_grid({"m": probes.Probe(df)}, ["t"], [1]).collect())
    many = jobs_of(spark, lambda: probes.evaluation_grid({f"m{k}": probes.Probe(wide) for k in range(3)}, ["t", "s"], list(range(1, 7))).collect())
    assert many <= few + 3  # 36 cells


def test_length_is_worked_out_once_a_row(spark):
    """The plan holds one sum of squares; one inside the division would run again for each number of the vector."""
    x, y = noisy(6, 20, 7)
    x[3] = 0
    df = table(spark, x, y)
    rows = df.select("user_id", probes._inputs(probes.Probe(df, mode="l2")).alias("v"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    length = np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose([r.v for r in rows.orderBy("user_id").collect()], x / np.where(length > 0, length, 1))


@pytest.mark.parametrize("spread", [1e-3, 1e-7])
def test_fits_settle_on_columns_with_little_spread(spark, monkeypatch, spread):
    """Columns that are 1 but for a little have the same fit as that little alone, in as few steps."""
    z, y = noisy(12, 1200, 4)
    z = (z - z.mean(0)) / z.std(0)
    df = table(spark, 1 + z * spread, y)
    grid = probes.Grid({"m": probes.Probe(df, mode="standardize")}, ["t"], [1])
    calls, summed = [], probes.Grid.summed
    monkeypatch.setattr(probes.Grid, "summed", lambda *a: calls.append(1) or summed(*a))
    train = grid.train(("logistic",))
    (n, _, cov), = probes.moments(grid, train).values()
    mine = np.arange(len(y)) % 4 < 2
    near = z[mine] * spread
    assert n == mine.sum() and np.allclose(np.diag(cov), near.var(0), rtol=1e-6)
    calls.clear()
    weights = probes.fit_logistic(grid, train)[0]
    assert len(calls) < 12
    have = 1 / (1 + np.exp(-(weights[0] + (1 + near) @ weights[1:])))
    assert np.allclose(have, optimum(near, y[mine], "standardize"), atol=1e-6)


def test_models_of_the_same_vectors_share_their_rows(spark, monkeypatch):
    """A row is written once for all targets and for all models that read the same table, turned to unit length or not."""
    x, y = noisy(14, 120)
    df = table(spark, x, y).withColumn("label_s", F.when(F.col("label_t") == 1, 0).when(F.col("user_id") > "u00010", 1)).withColumn("label_available_s", F.col("user_id") < "u00100")
    made, real = [], probes.staged

    def counted(rows, name):
        made.append((name, real(rows, name)))
        return made[-1][1]

    monkeypatch.setattr(probes, "staged", counted)
    grid = probes.Grid({"a": probes.Probe(df), "b": probes.Probe(df, "boosted"), "c": probes.Probe(df, mode="l2")}, ["t", "s"], [1])
    assert [(name, rows.count()) for name, rows in made] == [("grid", 2 * len(y))]
    assert [(c["model_name"], c["target"]) for c in grid.cells] == [(m, t) for m in "abc" for t in "st"]
    known = df.filter("label_available_s AND label_s IS NOT NULL").count()
    assert {r.cell: r["count"] for r in grid.rows.groupBy("cell").count().collect()} == {i: known if c["target"] == "s" else len(y) for i, c in enumerate(grid.cells)}
    train = df.filter("split = 'train' AND label_available_s AND label_s IS NOT NULL")
    assert grid.cells[0]["n"] == train.count() and grid.cells[0]["pos"] == train.agg(F.sum("label_s")).first()[0]


def test_each_sampled_cell_has_a_task_of_its_own(spark, monkeypatch):
    x, y = noisy(13, 160)
    df = table(spark, x, y).withColumn("prefix_len", F.explode(F.array(*[F.lit(k) for k in range(1, 7)])))
    grid = probes.Grid({"m": probes.Probe(df, "boosted")}, ["t"], list(range(1, 7)))
    monkeypatch.setattr(probes, "BoostedTrees", lambda x, y: TaskContext.get().partitionId())
    found = probes.fit_sampled(grid, grid.train(("boosted",)))
    assert len(found) == 6 == len({pickle.loads(b) for b in found.values()})


# ------------------------------------------------------------------ boosted trees


def brute_split(x, g, h):
    """Gain and rows on the left of the best threshold over all columns."""
    best = (-np.inf, None)
    score = lambda rows: g[rows].sum() ** 2 / h[rows].sum()
    for c in range(x.shape[1]):
        for t in np.unique(x[:, c])[:-1]:
            left = x[:, c] <= t
            if left.sum() >= learners.LEAST_LEAF and (~left).sum() >= learners.LEAST_LEAF:
                gain = score(left) + score(~left) - g.sum() ** 2 / h.sum()
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    return best


def brute_tree(x, g, h):
    """Leaf-wise growth by trying every threshold."""
    held = [(*brute_split(x, g, h), np.arange(len(g)))]
    while len(held) < learners.LEAVES:
        k = max(range(len(held)), key=lambda i: held[i][0])
        gain, left, rows = held[k]
        if not gain > 0:
            break
        held.pop(k)
        for own in (rows[left], rows[~left]):
            held.append((*brute_split(x[own], g[own], h[own]), own))
    value = np.zeros(len(g))
    for _, _, rows in held:
        value[rows] = -learners.RATE * g[rows].sum() / h[rows].sum()
    return value


def test_trees_split_as_brute_force(monkeypatch):
    monkeypatch.setattr(learners, "LEAVES", 9)
    x, y = noisy(7, 400, 4)
    x = np.round(x, 1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    model = learners.BoostedTrees(x, y.astype(float), rounds=6)
    assert all(len(c) < 255 for c in model.cuts)
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        want = brute_tree(x, p - y, p * (1 - p))
        have = learners.leaf_values(tree, learners.binned(x, model.cuts))
        assert np.allclose(have, want) and (tree[:, 0] < 0).sum() <= 9
        margin += have
    assert np.allclose(model.prob(x), 1 / (1 + np.exp(-margin)))


def test_trees_run_all_rounds_and_learn_what_lines_cannot():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 6))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = learners.BoostedTrees(x[:2000], y[:2000])
    assert len(model.trees) == 200 and ((model.prob(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.95
    big = rng.standard_normal((12_000, 2))
    stopped = learners.BoostedTrees(big, (rng.random(12_000) < 0.5).astype(float))
    assert len(stopped.trees) < 200
    constant = learners.BoostedTrees(np.zeros((50, 2)), np.arange(50) % 2.0, rounds=3)
    assert np.allclose(constant.prob(np.zeros((3, 2))), 0.5)


def test_perceptron_gradient_and_early_stop():
    x, y = noisy(9, 300, 3)
    y = y.astype(float)
    net = learners.Perceptron(x, y, hidden=7, epochs=1)
    loss = lambda: learners.log_loss(net.margin(x), y).mean() + learners.SHRINK / 2 / len(y) * sum((net.parts[k] ** 2).sum() for k in (0, 2))
    for k, d in enumerate(net._gradient(x, y)):
        at = np.unravel_index(np.abs(d).argmax(), d.shape)
        old = net.parts[k][at]
        up, down = (net.parts[k].__setitem__(at, old + s) or loss() for s in (1e-6, -1e-6))
        net.parts[k][at] = old
        assert abs((up - down) / 2e-6 - d[at]) < 1e-5
    rng = np.random.default_rng(10)
    x = rng.standard_normal((3000, 2))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    assert ((learners.Perceptron(x, y).prob(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_named_models_are_fitted(spark):
    """CLS, SVD and features carry one half of the answer each; the combined model sees both embeddings."""
    rng = np.random.default_rng(11)
    n = 400
    a, b = rng.standard_normal(n), rng.standard_normal(n)
    y = (a + b > 0).astype(int)
    cls, svd = table(spark, np.stack([a, rng.standard_normal(n)], 1), y), table(spark, b[:, None], y).drop("label_t", "label_available_t")
    features = cls.select("user_id", "split", "prefix_len", "label_t", "label_available_t", F.col("embedding")[0].alias("gap_mean"), F.col("label_t").cast("double").alias("markov_actual_prob"))
    svd = svd.join(cls.select("user_id", "label_t", "label_available_t"), "user_id")
    models = probes.named_models(cls, cls, svd, features, leaking=True, perceptrons=True, mode="zscore")
    out = {r.model_name: r.roc_auc for r in probes.evaluation_grid(models, ["t"], [1]).filter("split = 'test'").collect()}
    assert len(out) == 10 and out["combined_cls_baseline_svd_logreg"] > 0.98 > max(out["main_cls_logreg"], out["baseline_svd_logreg"], out["baseline_features_hgb_clean"])
    assert out["baseline_features_hgb_legacy"] > 0.99 and out["baseline_features_logreg_legacy"] > 0.99 and out["main_cls_mlp"] > 0.6

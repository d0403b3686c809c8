import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import ensemble as E
from tidegrid.operators import forecast as C
from tidegrid.operators import metrics as M
from tidegrid.operators import regression as R
from tidegrid.operators import splits as X
from tidegrid.operators.hierarchy import KEYS, LEVELS, rollup_hierarchy


@pytest.fixture(scope="module")
def shop(spark):
    """Two states, three stores, four items, 60 days, many empty days."""
    rng = np.random.default_rng(3)
    rows = []
    for s, (store, state) in enumerate([("s1", "A"), ("s2", "A"), ("s3", "B")]):
        for i in range(4):
            start = 1 + 5 * ((i + s) % 3)
            for d in range(start, 61):
                v = float(rng.integers(0, 6)) if rng.random() < 0.6 else 0.0
                rows.append((state, store, f"C{i % 2}", f"D{i % 2}_{i // 2}", f"i{i}", d, max(v, 1.0) if d == start else v))
    cols = [*KEYS, "d", "sales"]
    pdf = pd.DataFrame(rows, columns=["state_id", "store_id", "cat_id", "dept_id", "item_id", "d", "sales"])[cols]
    return spark.createDataFrame(pdf), pdf


def test_rollup_totals_agree(shop):
    df, pdf = shop
    out = rollup_hierarchy(df, ["sales"]).toPandas()
    totals = out.groupby("level").sales.sum()
    assert len(totals) == 12 and (totals == pdf.sales.sum()).all()
    for lv, cols in LEVELS.items():
        want = pdf.groupby(cols).ngroups if cols else 1
        assert (out.level == lv).sum() == want


def brute_wrmsse(pdf, fc, revenue, end, h):
    out = {}
    rev = revenue.rename(columns={"revenue": "r"})
    for lv, cols in LEVELS.items():
        keyed = lambda x: x.groupby(cols) if cols else x.groupby(lambda i: 0)
        total, score = 0.0, 0.0
        wide = pdf.assign(k=["|".join(map(str, r)) for r in pdf[cols].to_numpy()] if cols else "all")
        f = fc.assign(k=["|".join(map(str, r)) for r in fc[cols].to_numpy()] if cols else "all")
        w = rev.assign(k=["|".join(map(str, r)) for r in rev[cols].to_numpy()] if cols else "all").groupby("k").r.sum()
        for k, block in wide.groupby("k"):
            y = block.groupby("d").sales.sum().reindex(range(1, end + h + 1), fill_value=0.0).to_numpy()
            train, valid = y[:end], y[end:]
            train = train[np.argmax(train != 0):]
            scale = np.mean(np.diff(train) ** 2)
            p = f[f.k == k].groupby("step").forecast.sum().reindex(range(1, h + 1), fill_value=0.0).to_numpy()
            weight = w.get(k, 0.0)
            total += weight
            if scale > 0:
                score += weight * np.sqrt(np.mean((valid - p) ** 2) / scale)
        out[lv] = score / total
    return out


@pytest.mark.parametrize("sparse", [True, False])
def test_wrmsse_brute_force(spark, shop, sparse):
    df, pdf = shop
    end, h = 46, 14
    rng = np.random.default_rng(8)
    base = pdf[KEYS].drop_duplicates()
    fc = base.merge(pd.DataFrame({"step": range(1, h + 1)}), how="cross")
    fc["forecast"] = rng.random(len(fc)) * 3
    revenue = base.assign(revenue=rng.random(len(base)) * 10)
    rows = df.filter("sales > 0") if sparse else df
    out = M.wrmsse_levels(rows, spark.createDataFrame(fc), spark.createDataFrame(revenue), F.lit(end), h).toPandas()
    want = brute_wrmsse(pdf, fc, revenue, end, h)
    for lv, score in out.set_index("level").wrmsse.items():
        assert score == pytest.approx(want[lv], rel=1e-9), lv


def test_perfect_forecast_scores_zero(spark, shop):
    df, pdf = shop
    future = df.filter("d > 46").select(*KEYS, (F.col("d") - 46).alias("step"), F.col("sales").alias("forecast"))
    revenue = df.groupBy(*KEYS).agg(F.sum("sales").alias("revenue"))
    out = M.wrmsse_levels(df, future, revenue, F.lit(46), 14).toPandas()
    assert (out.wrmsse.abs() < 1e-12).all()


def test_seasonal_naive_repeats_and_falls_back(tiny):
    out = C.seasonal_naive(tiny, ["id"], 10, 7).toPandas().sort_values("step")
    assert out[out.id == "season"].forecast.tolist() == [1, 2, 3, 4, 5, 6, 7, 1, 2, 3]
    assert out[out.id == "one"].forecast.tolist() == [7.0] * 10
    assert out[out.id == "late"].forecast.iloc[0] == pytest.approx(1.5)


def test_naive2_follows_a_clear_season(tiny):
    season = tiny.filter("id = 'season'")
    assert C.seasonality(season, ["id"], 7).first().seasonal
    out = C.naive2(season, ["id"], 7, 7).orderBy("step").toPandas()
    np.testing.assert_allclose(out.forecast, [1, 2, 3, 4, 5, 6, 7], rtol=1e-9)


def slow_kernel_paths(y, last, h, draws, season, scale, weight):
    """Paths as they are defined: every earlier value, drawn ones too, weighted by distance in time and season; a draw takes
    history by value first, then own draws in order."""
    n, out = len(y), []
    phase = lambda t: (last + 1 - n + t) % season if season else 0
    for path_draws in draws:
        path = list(y)
        for s, u in enumerate(path_draws):
            t = n + s
            far = np.array([weight * ((t - j) / (n + h - 1) + (scale * abs(phase(j) - phase(t)) / (season - 1) if season else 0)) for j in range(t)])
            w = np.exp(far.min() - far)
            order = [j for j in sorted(range(n), key=lambda j: y[j]) if not np.isnan(y[j])] + list(range(n, t))
            x, total = 0.0, w[order].sum() * u
            for j in order:
                x += w[j]
                if x > total:
                    break
            path.append(path[j])
        out.append(path[n:])
    return np.array(out)


@pytest.mark.parametrize("season,scale,weight", [(7, 2.0, 1.0), (None, 0.0, 3.0), (5, 1000.0, 0.5)])
def test_kernel_samples_equal_plain_paths(spark, tiny, season, scale, weight):
    h, n = 28, 6
    got = C.kernel_samples(tiny, ["id"], h, n, seed=1, season=season, feature_scale=scale, weight=weight)
    draws = got.withColumn("u", C.uniform_draw(["id", "step", "sample"], 1)).toPandas()
    assert len(draws) == 6 * h * n
    for k, mine in draws.groupby("id"):
        wide = lambda c: mine.pivot(index="sample", columns="step", values=c).to_numpy()
        series = tiny.filter(F.col("id") == k).orderBy("d").toPandas()
        want = slow_kernel_paths(series.sales.to_numpy(), int(series.d.max()), h, wide("u"), season, scale, weight)
        np.testing.assert_array_equal(wide("value"), want, err_msg=k)


def test_kernel_first_steps_follow_the_quantiles(spark, tiny):
    df = tiny.filter("id = 'season'")
    drawn = C.kernel_samples(df, ["id"], 3, 4000, seed=5, season=7, feature_scale=2.0).filter("step = 1").toPandas()["value"]
    probs = [0.1, 0.5, 0.9]
    want = C.kernel_quantiles(df, ["id"], 3, probs, season=7, feature_scale=2.0).filter("step = 1").first()
    for i, p in enumerate(probs):  # the quantile is the least value with that share
        q = want[f"q{i}"]
        assert (drawn <= q).mean() >= p - 0.03 and (drawn < q).mean() <= p + 0.03


def test_kernel_samples_repeatable(spark, tiny):
    a = C.kernel_samples(tiny, ["id"], 5, 8, seed=1, season=7)
    b = C.kernel_samples(tiny.repartition(7), ["id"], 5, 8, seed=1, season=7)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_level_ratios_grow_with_the_quantile():
    for lv, r in E.level_ratios().items():
        assert r[4] == 1.0 and all(a <= b for a, b in zip(r, r[1:])), lv
    assert E.level_ratios()[1][8] < E.level_ratios()[12][8]


def test_samplers_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).withColumn("weight", (F.col("id") % 7 + 1).cast("double"))
    a = X.weighted_replicate(df, ["id"], "weight", 0.8, 3)
    b = X.weighted_replicate(df.repartition(11), ["id"], "weight", 0.8, 3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert abs(a.count() - 4000) < 150
    p = X.sample_uniform(df, ["id"], 0.2, 4).count()
    assert abs(p - 1000) < 120


def test_least_squares_per_key(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 300), "a": rng.normal(size=300), "b": rng.normal(size=300)})
    pdf["y"] = 1 + pdf.k + 2 * pdf.a - pdf.b + rng.normal(size=300) * 0.1
    beta = R.fit(spark.createDataFrame(pdf), ["k"], ["a", "b"], "y", ridge=0.0).toPandas().set_index("k").beta
    for k, g in pdf.groupby("k"):
        want = np.linalg.lstsq(np.c_[np.ones(len(g)), g.a, g.b], g.y, rcond=None)[0]
        np.testing.assert_allclose(beta[k], want, atol=1e-6)


def test_poisson_fit_balances_totals(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 600), "a": rng.normal(size=600)})
    pdf["y"] = rng.poisson(np.exp(0.5 + 0.4 * pdf.a)).astype(float)
    df = spark.createDataFrame(pdf)
    beta = R.fit(df, ["k"], ["a"], "y", "poisson").cache()
    assert all(r.converged and r.iterations < 20 for r in beta.collect())
    out = R.predict(df, beta, ["k"], ["a"], "poisson").groupBy("k").agg(F.sum("y").alias("y"), F.sum("forecast").alias("f"))
    for r in out.collect():
        assert r.f == pytest.approx(r.y, rel=1e-8)


def test_fits_converge_from_afar(spark):
    """Steep counts whose first steps overshoot, a key that settles at once and one without a solution."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=400)
    steep = pd.DataFrame({"k": "steep", "a": x * 8, "y": rng.poisson(np.exp(np.minimum(x * 4, 9))).astype(float)})
    flat = pd.DataFrame({"k": "flat", "a": x, "y": 2.0})
    none = pd.DataFrame({"k": "none", "a": 1.0, "y": [1.0, 2.0]})
    df = spark.createDataFrame(pd.concat([steep, flat, none]))
    for family in ("poisson", "tweedie"):
        rows = {r.k: r for r in R.fit(df, ["k"], ["a"], "y", family, power=1.3, ridge=0.0).collect()}
        assert rows["none"].beta is None and not rows["none"].converged
        assert rows["flat"].converged and rows["flat"].beta[0] == pytest.approx(np.log(2), abs=1e-6)
        b0, b1 = rows["steep"].beta
        mu = np.exp(b0 + b1 * steep.a)
        slope = (steep.y - mu) * (1 if family == "poisson" else mu ** -0.3)
        assert rows["steep"].converged and rows["steep"].iterations > rows["flat"].iterations
        assert abs(slope.sum()) < 1e-5 * abs(slope).sum() and abs((slope * steep.a).sum()) < 1e-5 * abs(slope * steep.a).sum()
    few = {r.k: r for r in R.fit(df, ["k"], ["a"], "y", "poisson", iterations=2).collect()}
    assert len(few) == 3 and not few["steep"].converged


def test_asymmetric_fit_weighs_the_sides(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": 1, "a": rng.normal(size=500)})
    pdf["y"] = 2 * pdf.a + rng.normal(size=500)
    (row,) = R.fit(spark.createDataFrame(pdf), ["k"], ["a"], "y", "asymmetric", multiplier=4.0, ridge=0.0).collect()
    e = pdf.y - row.beta[0] - row.beta[1] * pdf.a
    assert row.converged and abs((np.where(e < 0, 1.0, 4.0) * e).sum()) < 1e-6


def test_quantile_fit_coverage(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": 1, "a": rng.normal(size=2000)})
    pdf["y"] = 3 * pdf.a + rng.normal(size=2000)
    df = spark.createDataFrame(pdf)
    beta = {r.q: r for r in R.fit_quantiles(df, ["k"], ["a"], "y", [0.1, 0.5, 0.9]).collect()}
    check = lambda q, b: np.maximum(q * (pdf.y - b[0] - b[1] * pdf.a), (q - 1) * (pdf.y - b[0] - b[1] * pdf.a)).sum()
    for q, r in beta.items():
        assert r.converged and (pdf.y <= r.beta[0] + r.beta[1] * pdf.a).mean() == pytest.approx(q, abs=0.004)
        for move in ([0.02, 0], [-0.02, 0], [0, 0.02], [0, -0.02]):  # no better line nearby
            assert check(q, r.beta) <= check(q, np.add(r.beta, move)) + 1e-6


def test_search_equals_a_fit_per_fold(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"fold": rng.integers(0, 4, 400), "a": rng.normal(size=400), "b": rng.normal(size=400)})
    pdf["y"] = 1 + 2 * pdf.a - pdf.b + rng.normal(size=400)
    grid = [{"ridge": r, "features": m} for r in (0.0, 50.0) for m in (1, 2)]
    out = R.tune(spark.createDataFrame(pdf), "fold", ["a", "b"], "y", grid, 4, 1).collect()
    assert len(out) == 16
    for r in out:
        params = dict(p.split("=") for p in r.params.split(","))
        use, ridge = ["a", "b"][: int(params["features"])], float(params["ridge"])
        train, test = pdf[pdf.fold != r.fold], pdf[pdf.fold == r.fold]
        x = np.c_[np.ones(len(train)), train[use]]
        b = np.linalg.solve(x.T @ x + ridge * np.diag([0.0] + [1.0] * len(use)), x.T @ train.y)
        assert r.rmse == pytest.approx(np.sqrt(np.mean((test.y - np.c_[np.ones(len(test)), test[use]] @ b) ** 2)), rel=1e-9)


def test_importance_shuffles_one_feature(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"i": range(500), "k": 1, "a": rng.normal(size=500), "b": rng.normal(size=500)})
    pdf["y"] = 3 * pdf.a
    df = spark.createDataFrame(pdf)
    beta = R.fit(df, ["k"], ["a", "b"], "y", ridge=0.0)
    out = {r.feature: r.importance for r in R.permutation_importance(df, beta, ["k"], ["i"], ["a", "b"], "y", 3).collect()}
    assert out["a"] > 3 and abs(out["b"]) < 1e-6


def test_staged_days_equal_a_loop(spark):
    """Two stages of different models and features; the second reads the first one's days, inside and before its block."""
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame([(k, d, float(rng.integers(0, 9))) for k, n in (("a", 40), ("b", 40), ("new", 5)) for d in range(41 - n, 41)], columns=["id", "d", "sales"])
    models = [(3, [("lag", 3), ("mean", 1, 4)], [0.5, 0.2, 0.7]), (8, [("lag", 8), ("mean", 2, 3), ("mean", 8, 20)], [0.1, 0.3, 0.4, 0.2])]
    tables = [(last, recipe, spark.createDataFrame([(k, b) for k in ("a", "b", "new")], "id string, beta array<double>")) for last, recipe, b in models]
    out = R.fold_forecast(spark.createDataFrame(pdf), tables, ["id"], ["id"], 40, "gaussian").toPandas()
    for k, mine in pdf.groupby("id"):
        past = mine.sort_values("d").sales.tolist()
        n, step = len(past), 0
        for last, recipe, b in models:
            while step < last:
                value = b[0]
                for c, f in zip(b[1:], recipe):
                    if f[0] == "lag":
                        value += c * (past[-f[1]] if len(past) >= f[1] else 0)
                    else:
                        part = past[: len(past) - f[1] + 1][-f[2]:]
                        value += c * (np.mean(part) if part else 0)
                past.append(value)
                step += 1
        got = out[out.id == k].sort_values("step")
        assert got.step.tolist() == list(range(1, 9))
        np.testing.assert_allclose(got.forecast, past[n:], rtol=1e-9)


def test_history_features_meet_the_fold(spark):
    """Training features of a day are what the fold computes for it from the days before."""
    rng = np.random.default_rng(14)
    pdf = pd.DataFrame([("a", d, float(rng.integers(0, 9))) for d in range(1, 61)], columns=["id", "d", "sales"])
    recipe = R.stage_recipe(7, 2, [7], [1, 7], [7, 14])
    names = [R.feature_name(f) for f in recipe]
    df = spark.createDataFrame(pdf)
    row = R.history_features(df, ["id"], recipe).filter("d = 60").first()
    for i, name in enumerate(names):
        b = spark.createDataFrame([("a", [0.0] + [float(j == i) for j in range(len(names))])], "id string, beta array<double>")
        got = R.fold_forecast(df, [(1, recipe, b)], ["id"], ["id"], 59, "gaussian").first().forecast
        assert got == pytest.approx(row[name]), name


def test_seasonal_error_of_observed_rows(spark):
    """Equal to the one over every day: thin, late, short and dense series."""
    from tidegrid.operators.reshape import fill_gaps

    rng = np.random.default_rng(15)
    rows = [("one", 3, 5.0), ("last", 40, 2.0), ("near", 34, 2.0), ("near", 36, 3.0), ("edge", 33, 4.0)]
    rows += [("thin", int(d), float(rng.integers(1, 9))) for d in sorted(rng.choice(40, 9, replace=False) + 1)]
    rows += [("dense", d, float(rng.integers(0, 5))) for d in range(1, 41)] + [("after", 45, 1.0)]
    df = spark.createDataFrame(rows, "id string, d int, sales double")
    grid = fill_gaps(df.filter("d <= 40"), ["id"], "d", {"sales": 0.0}, end=F.lit(40))
    want = {r.id: r.seasonal_error for r in M.seasonal_error(grid, ["id"], 7).collect()}
    got = {r.id: r.seasonal_error for r in M.seasonal_error_observed(df, ["id"], 7, 40).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == (pytest.approx(v) if v is not None else None), k


def slow_instances(values, past, future, lead):
    for i in range(len(values)):
        coming = values[i + lead : i + lead + future]
        if len(coming) == future:
            before = values[max(0, i - past) : i]
            yield i, [0.0] * (past - len(before)) + before, coming, [1] * (past - len(before)) + [0] * len(before)


@pytest.mark.parametrize("block", [256, 5])
def test_instances_at_every_position(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    series = {"a": [float(v) for v in range(1, 40)], "b": [7.0], "c": [1.0, None, 3.0, 4.0, 5.0, 6.0]}
    df = spark.createDataFrame([(k, 10 + i, v) for k, vs in series.items() for i, v in enumerate(vs)], "id string, d int, sales double")
    got = {(r.id, r.pos): r for r in X.make_instances(df, ["id"], 4, 2, lead=1).collect()}
    want = {(k, i): x for k, vs in series.items() for i, *x in slow_instances(vs, 4, 2, 1)}
    assert set(got) == set(want)
    for key, (past, coming, pad) in want.items():
        r = got[key]
        assert [r.past_target, r.future_target, r.past_is_pad, r.forecast_start] == [past, coming, pad, 11 + key[1]]
    full = X.make_instances(df, ["id"], 4, 2, lead=1, pick_incomplete=False, chosen=F.col("pos") % 2 == 0)
    assert {(r.id, r.pos) for r in full.collect()} == {key for key in want if key[1] >= 4 and key[1] % 2 == 0}
    for r in X.make_instances_canonical(df, ["id"], 3, pad=True).collect():
        held = series[r.id][max(0, r.pos - 3) : r.pos]
        assert r.past_target == [0.0] * (3 - len(held)) + held and sum(r.past_is_pad) == 3 - len(held) and r.last_day == 9 + r.pos
    forks = X.make_forking_instances(df, ["id"], 3, 2).collect()
    assert {(r.id, r.pos) for r in forks} == {(k, i) for k, vs in series.items() for i in range(len(vs) - 2)}
    for r in forks:
        vs, steps = series[r.id], range(max(0, r.pos - 2), r.pos + 1)
        assert r.future_target == [[0.0, 0.0]] * (3 - len(steps)) + [vs[j + 1 : j + 3] for j in steps]
    for r in X.lag_block(df, ["id"], [1, 3], 2).collect():
        vs, i = series[r.id], r.pos
        assert r.block_1 == vs[i - 2 : i] and r.block_3 == vs[i - 4 : i - 2] and r.d == 10 + i
    assert X.lag_block(df, ["id"], [1, 3], 2).count() == (39 - 4) + (6 - 4)


def test_recursive_equals_direct_loop(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame([(k, d, float(rng.integers(1, 9))) for k in ("a", "b") for d in range(1, 41)], columns=["id", "d", "sales"])
    beta = spark.createDataFrame([("a", [0.5, 0.3, 0.4]), ("b", [0.1, 0.6, 0.2])], "id string, beta array<double>")
    out = R.predict_recursive(spark.createDataFrame(pdf), beta, ["id"], ["id"], [1], [7], 5, 40, "gaussian").toPandas()
    for k, (b0, b1, b2) in {"a": (0.5, 0.3, 0.4), "b": (0.1, 0.6, 0.2)}.items():
        hist = pdf[pdf.id == k].sales.tolist()
        for _ in range(5):
            hist.append(b0 + b1 * hist[-1] + b2 * np.mean(hist[-7:]))
        np.testing.assert_allclose(out[out.id == k].sort_values("step").forecast, hist[-5:], rtol=1e-9)


def test_degenerate_series_fit_to_null(spark):
    rows = [("ok", x, 2 * x + 1) for x in (0.0, 1.0, 2.0)] + [("constant", 5.0, y) for y in (1.0, 2.0)] + [("one", 0.7, 3.0)]
    df = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in rows], "id string, x double, y double")
    beta = {r.id: r.beta for r in R.fit(df, ["id"], ["x"], "y", ridge=0.0).collect()}
    assert beta["constant"] is None and beta["one"] is None
    assert abs(beta["ok"][0] - 1) < 1e-9 and abs(beta["ok"][1] - 2) < 1e-9


def test_kernel_quantiles_of_thin_series(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 1.0), ("b", 2, 3.0)], "id string, d int, sales double")
    for kind in ("exponential", "uniform"):
        got = C.kernel_quantiles(df, ["id"], 7, [0.5], season=7, kind=kind).collect()
        assert len(got) == 14 and all(r.q0 is not None for r in got)

"""Regression over many groups at once, by re-weighted least squares.

One aggregate per iteration sums x x' and x y per key (partial sums, so a hot key is no
worse than others); the k x k systems, one small row per key, are solved in Arrow batches.
No group's rows are ever gathered, and the number of keys is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.ranking import global_position, keyed_permutation
from tidegrid.operators.windows import add_lags, rolling
from tidegrid.sources.files import checkpoint_table

FAMILIES = ["gaussian", "poisson", "tweedie", "asymmetric"]

#: A fit has converged when the next step would lower its loss by less than this part of it.
SETTLED = 1e-16
#: Halvings of one step before a fit is given up; width of the smoothed quantile loss at the end, and how it shrinks.
HALVINGS, NARROWEST, SHRINK = 40, 1 / 256, 4.0


def _linear(features: list[str], beta: str = "beta") -> Column:
    out = F.col(beta)[0]
    for i, f in enumerate(features, 1):
        out = out + F.col(beta)[i] * F.col(f)
    return out


def _cells(features: list[str], w: Column, z: Column) -> list[Column]:
    """Sums of w x x' (upper triangle) and x z."""
    xs = [F.lit(1.0), *[F.col(f) for f in features]]
    k = len(xs)
    square = [F.sum(w * xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    return square + [F.sum(xs[i] * z).alias(f"b{i}") for i in range(k)]


def _systems(batch: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.zeros((len(batch), k, k))
    for i in range(k):
        for j in range(i, k):
            a[:, i, j] = a[:, j, i] = batch[f"a{i}_{j}"].to_numpy(dtype=float)
    return a, np.stack([batch[f"b{i}"].to_numpy(dtype=float) for i in range(k)], axis=1)


def _solved(a: np.ndarray, b: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many systems (the first unknown is not shrunk), and which have a single one."""
    k = a.shape[1]
    shrink = np.eye(k) * ridge
    shrink[0, 0] = 0.0
    a = a + shrink
    with np.errstate(all="ignore"):
        size = np.sqrt(np.einsum("nii->ni", a))
        size[~(size > 0)] = 1.0
        scaled = a / (size[:, :, None] * size[:, None, :])
    finite = np.isfinite(scaled).all((1, 2)) & np.isfinite(b).all(1)
    single = finite.copy()
    single[finite] = np.linalg.eigvalsh(scaled[finite])[:, 0] > 1e-10
    x = np.zeros((len(a), k))
    x[single] = np.linalg.solve(scaled[single], (b / size)[single][:, :, None])[:, :, 0] / size[single]
    return x, single


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys] + [rest])


def _solve(df: DataFrame, keys: list[str], features: list[str], z: Column, ridge: float) -> DataFrame:
    """Least squares per key: (keys, n, beta, spread). ``spread`` is the residuals' deviation.

    A key whose (ridged) system has no single solution, as with a constant feature or too few rows, gets null
    coefficients.
    """
    k = len(features) + 1
    sums = df.withColumn("_z", z).groupBy(*keys).agg(
        *_cells(features, F.lit(1.0), F.col("_z")), F.count("*").alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("zz")
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = _systems(batch, k)
            beta, single = _solved(a, b, ridge)
            rest = batch["zz"].to_numpy(dtype=float) - 2 * (beta * b).sum(1) + np.einsum("ni,nij,nj->n", beta, a, beta)
            out = batch[[*keys, "n"]].copy()
            out["beta"] = [x if ok else None for x, ok in zip(beta, single)]
            out["spread"] = np.sqrt(np.maximum(rest, 0) / batch["n"].to_numpy())
            yield out

    return sums.mapInPandas(solve, _schema(df, keys, "n bigint, beta array<double>, spread double"))


def _loss(family: str, power: float, multiplier: float) -> tuple[Column, Column, Column]:
    """Loss of a row, minus half its slope in the linear predictor, and the weight of the row's x x'."""
    y, eta = F.col("_y"), F.col("_eta")
    e = y - eta
    if family == "asymmetric":
        w = F.when(e < 0, 1.0).otherwise(multiplier)
        return w * e * e, w * e, w
    if family == "quantile":
        # the check loss, its corner rounded over the key's width
        q, x = F.col("q"), e / F.col("width")
        near = F.exp(-F.abs(x))
        above = F.when(x >= 0, 1 / (1 + near)).otherwise(near / (1 + near))
        loss = q * e + F.col("width") * (F.greatest(-x, F.lit(0.0)) + F.log1p(near))
        return 2 * loss, q - 1 + above, (near / ((1 + near) * (1 + near)) + 1e-4) / F.col("width")
    mu = F.exp(eta)
    if family == "poisson":
        return 2 * (F.when(y > 0, y * (F.log(y) - eta)).otherwise(0.0) - (y - mu)), y - mu, mu
    a, b = 1.0 - power, 2.0 - power
    loss = F.pow(y, F.lit(b)) / (a * b) - y * F.exp(a * eta) / a + F.exp(b * eta) / b
    return 2 * loss, (y - mu) * F.exp(a * eta), F.exp(b * eta)


def _advance(k: int, keys: list[str], ridge: float, last: float):
    """One step of every active key, from the sums at its trial coefficients."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = _systems(batch, k)
            trial = np.array(batch["trial"].tolist(), float).reshape(len(batch), k)
            shrink = np.r_[0.0, np.full(k - 1, ridge)]
            with np.errstate(all="ignore"):
                loss = batch["_loss"].to_numpy(dtype=float) + (shrink * trial * trial).sum(1)
                slope = b - shrink * trial
                move, single = _solved(a, slope, ridge)
                gain = (slope * move).sum(1)
            rows = []
            for r, row in enumerate(batch.itertuples(index=False)):
                beta, width, best, halved, done, ok = row.beta, row.width, row.loss, row.halved, False, False
                better = np.isfinite(loss[r]) and (best is None or np.isnan(best) or loss[r] <= best + 1e-12 * abs(best))
                if better and single[r]:
                    beta, best, halved = trial[r], loss[r], 0
                    settled = gain[r] <= SETTLED * max(abs(loss[r]), 1e-300)
                    following = trial[r] if settled else trial[r] + move[r]
                    if settled and width is not None and width > row.first_width * last * 1.001:
                        width, best = width / SHRINK, None  # the loss is another one now
                    elif settled:
                        done, ok = True, True
                elif beta is None:
                    done, following = True, trial[r]
                else:
                    halved, following = halved + 1, (np.asarray(beta) + trial[r]) / 2
                    done = halved > HALVINGS
                rows.append((*[getattr(row, c) for c in keys], row.n, beta, following, best, width, row.first_width, halved, row.iterations + 1, done, ok))
            columns = [*keys, "n", "beta", "trial", "loss", "width", "first_width", "halved", "iterations", "done", "converged"]
            yield pd.DataFrame(rows, columns=columns).astype({"loss": "Float64", "width": "Float64", "first_width": "Float64"})

    return run


_STATE = "n bigint, beta array<double>, trial array<double>, loss double, width double, first_width double, halved int, iterations int, done boolean, converged boolean"


def _descend(rows: DataFrame, state: DataFrame, keys: list[str], join: list[str], features: list[str], family: str,
             iterations: int, power: float, multiplier: float, ridge: float) -> DataFrame:
    """Steps of all keys until each has settled; a settled key leaves and its rows are no longer read into sums."""
    loss, slope, weight = _loss(family, power, multiplier)
    finished, k = [], len(features) + 1
    for _ in range(iterations):
        state = checkpoint_table(state, "fit")
        finished.append(state.filter("done"))
        active = state.filter("NOT done")
        if active.isEmpty():
            break
        scored = rows.join(active.select(*keys, "trial", "width"), join).withColumn("_eta", _linear(features, "trial"))
        scored = scored.withColumns({"_l": loss, "_s": slope, "_w": weight})
        sums = scored.groupBy(*keys).agg(*_cells(features, F.col("_w"), F.col("_s")), F.sum("_l").alias("_loss"))
        state = sums.join(active, keys).mapInPandas(_advance(k, keys, ridge, NARROWEST), _schema(state, keys, _STATE))
    else:
        finished.append(checkpoint_table(state, "fit"))
    return reduce(DataFrame.unionByName, finished).select(*keys, "n", "beta", "iterations", F.coalesce("converged", F.lit(False)).alias("converged"))


def _first_state(start: DataFrame, keys: list[str], width: Column) -> DataFrame:
    nothing = F.col("beta").isNull()
    return start.select(
        *keys, "n", F.lit(None).cast("array<double>").alias("beta"), F.col("beta").alias("trial"), F.lit(None).cast("double").alias("loss"),
        width.alias("width"), width.alias("first_width"), F.lit(0).alias("halved"), F.lit(0).alias("iterations"), nothing.alias("done"), F.lit(False).alias("converged"),
    )


def fit(df: DataFrame, keys: list[str], features: list[str], label: str, family: str = "gaussian",
        iterations: int = 100, power: float = 1.1, multiplier: float = 1.0,
        ridge: float = 1e-6) -> DataFrame:
    """Coefficients per key: (keys, n, beta, iterations, converged).

    gaussian: least squares. poisson / tweedie: log link. asymmetric: squared error, weight 1
    below the fit and ``multiplier`` above. Quantiles: see fit_quantiles.
    Rows with a null feature or label are not used. A step that raises the loss (or leaves the numbers' range) is
    halved; a key is done when no step would lower its loss any more, and ``converged`` says so.
    """
    if family not in FAMILIES:
        raise ValueError(f"family must be one of {FAMILIES}")
    rows = df.select(*keys, *features, F.col(label).cast("double").alias("_y")).na.drop()
    link = F.log(F.col("_y") + 0.1) if family in ("poisson", "tweedie") else F.col("_y")
    start = _solve(rows, keys, features, link, ridge)
    if family == "gaussian":
        return start.select(*keys, "n", "beta", F.lit(1).alias("iterations"), F.col("beta").isNotNull().alias("converged"))
    state = _first_state(start, keys, F.lit(None).cast("double"))
    return _descend(rows, state, keys, keys, features, family, iterations, power, multiplier, ridge)


def fit_quantiles(df: DataFrame, keys: list[str], features: list[str], label: str, probs: list[float],
                  iterations: int = 200) -> DataFrame:
    """One fit per key and quantile: (keys, q, n, beta, iterations, converged), all in the same jobs.

    The check loss is smoothed over a width that starts at the residuals' deviation and shrinks to a 256th of it, each
    time from where the wider one settled, so every step is a Newton step of a smooth loss.
    """
    rows = df.select(*keys, *features, F.col(label).cast("double").alias("_y")).na.drop()
    start = checkpoint_table(_solve(rows, keys, features, F.col("_y"), 1e-6), "start")
    each = start.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    # without any spread the fit goes through every row, at every quantile
    state = _first_state(each, [*keys, "q"], F.greatest(F.col("spread"), F.lit(1e-9)))
    return _descend(rows, state, [*keys, "q"], keys, features, "quantile", iterations, 0.0, 1.0, 1e-9)


def predict(df: DataFrame, beta: DataFrame, keys: list[str], features: list[str], family: str = "gaussian",
            out: str = "forecast") -> DataFrame:
    scored = df.join(beta.select(*keys, "beta"), keys).withColumn(out, _linear(features))
    if family in ("poisson", "tweedie"):
        scored = scored.withColumn(out, F.exp(F.col(out)))
    return scored.drop("beta")


def asymmetric_loss(df: DataFrame, keys: list[str], y: str, forecast: str, multiplier: float) -> DataFrame:
    """Mean squared residual, weight 1 where the forecast is too high and ``multiplier`` where it is too low."""
    e = F.col(y) - F.col(forecast)
    loss = F.when(e < 0, e * e).otherwise(e * e * multiplier)
    return df.groupBy(*keys).agg(F.avg(loss).alias("loss"))


def tune(df: DataFrame, folds: str, features: list[str], label: str, grid: list[dict], n: int, seed: int) -> DataFrame:
    """Random parameter sets, scored by leaving out one fold at a time: (params, fold, rmse).

    Parameters: ``ridge`` and ``features`` (how many of the list to use). The rows are read once, into one matrix of
    cross products a fold. The rest of a fold is the total less its own matrix, a subset of features a part of it, a ridge
    something added to its diagonal; and a fold's squared error follows from its own matrix too.
    """
    rng = np.random.default_rng(seed)
    picked = [grid[i] for i in sorted(rng.choice(len(grid), size=min(n, len(grid)), replace=False))]
    k = len(features) + 1
    rows = df.select(folds, *features, F.col(label).cast("double").alias("_y")).na.drop()
    sums = rows.groupBy(F.col(folds).alias("fold")).agg(
        *_cells(features, F.lit(1.0), F.col("_y")), F.count("*").alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy")
    )
    sums = checkpoint_table(sums, "folds")
    cells = [c for c in sums.columns if c[0] in "ab"]
    total = sums.agg(F.struct(*[F.sum(c).alias(c) for c in cells])).scalar()
    wide = sums.withColumn("_t", total).select("fold", "n", "yy", *cells, *[F.col(f"_t.{c}").alias(f"t_{c}") for c in cells])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, own_y = _systems(batch, k)
            every, every_y = _systems(batch[[f"t_{c}" for c in cells]].rename(columns=lambda c: c[2:]), k)
            for params in picked:
                m = 1 + len(features[: params.get("features", len(features))])
                beta, single = _solved((every - own)[:, :m, :m], (every_y - own_y)[:, :m], params.get("ridge", 1e-6))
                error = batch["yy"].to_numpy(dtype=float) - 2 * (beta * own_y[:, :m]).sum(1) + np.einsum("ni,nij,nj->n", beta, own[:, :m, :m], beta)
                text = ",".join(f"{name}={v}" for name, v in sorted(params.items()))
                rmse = np.where(single, np.sqrt(np.maximum(error, 0) / batch["n"].to_numpy()), np.nan)
                yield pd.DataFrame({"params": text, "fold": batch["fold"], "rmse": rmse})

    out = wide.mapInPandas(score, f"params string, fold {sums.schema['fold'].dataType.simpleString()}, rmse double")
    return out.withColumn("rmse", F.nanvl("rmse", F.lit(None).cast("double")))


def permutation_importance(df: DataFrame, beta: DataFrame, keys: list[str], row_keys: list[str], features: list[str],
                           label: str, seed: int, family: str = "gaussian") -> DataFrame:
    """Rise of the RMSE when one feature is shuffled over all rows; (feature, importance).

    Rows are numbered once (``row_keys`` must be unique). A shuffle is a keyed permutation of the numbers, computed in
    the row, so each feature costs one equi join and no sort.
    """
    rows = df.select(*dict.fromkeys([*row_keys, *keys, *features, label])).na.drop()
    placed = checkpoint_table(global_position(rows, row_keys, name="_pos"), "placed")
    n = placed.count()

    def rmse(scored: DataFrame, name: str) -> DataFrame:
        return scored.agg(F.sqrt(F.avg(F.pow(F.col(label) - F.col("forecast"), F.lit(2.0)))).alias("rmse")).select(
            F.lit(name).alias("feature"), "rmse"
        )

    plain = rmse(predict(placed, beta, keys, features, family), "").select("rmse").scalar()
    parts = []
    for i, f in enumerate(features):
        other = placed.select(F.col("_pos").alias("_from"), F.col(f).alias("_f"))
        mixed = placed.drop(f).withColumn("_from", keyed_permutation(F.col("_pos") - 1, n, seed + i) + 1).join(other, "_from")
        parts.append(rmse(predict(mixed.withColumnRenamed("_f", f), beta, keys, features, family), f))
    return reduce(DataFrame.unionByName, parts).select("feature", (F.col("rmse") - plain).alias("importance"))


# --- forecasts that feed on themselves ---------------------------------------------------
# A feature is ("lag", k): the value k days before; or ("mean", s, w): the mean of the w days that end s days before.

def feature_name(feature: tuple) -> str:
    return "_".join(map(str, feature))


def history_features(df: DataFrame, keys: list[str], recipe: list[tuple], day: str = "d", value: str = "sales", whole: bool = False) -> DataFrame:
    """The recipe's features of every row of a gap-free history, null where a frame is not full. ``whole``: see rolling."""
    means = [(f[1], f[2]) for f in recipe if f[0] == "mean"]
    lags = [f[1] for f in recipe if f[0] == "lag"]
    out = rolling(df, keys, means, day, value, std=False, name="_f", whole=whole) if means else df
    out = add_lags(out, keys, lags, day, value, "lag")
    return out.withColumnsRenamed({f"_f_mean_{s}_{w}": f"mean_{s}_{w}" for s, w in means})


def _from_buffer(past: Column, feature: tuple) -> Column:
    """A feature of the day after the last of ``past``; days before the series count as absent, a feature without any as 0."""
    if feature[0] == "lag":
        return F.coalesce(F.try_element_at(past, F.lit(-feature[1])), F.lit(0.0))
    end = F.size(past) - feature[1] + 1
    start = F.greatest(end - feature[2] + 1, F.lit(1))
    part = F.slice(past, start, F.greatest(end - start + 1, F.lit(0)))
    return F.coalesce(F.try_divide(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), F.size(part)), F.lit(0.0))


def fold_forecast(history: DataFrame, models: list[tuple[int, list[tuple], DataFrame]], series: list[str], model_keys: list[str],
                  end: int, family: str = "poisson") -> DataFrame:
    """Days after ``end`` one by one: (series, step, forecast). ``models``: (last step, recipe, coefficients) of each stage.

    A series is one row: the array of the values that any recipe looks back to. Each step computes its features from the
    array's end and appends its prediction, so later days and later stages read earlier predictions; all steps are one
    expression. ``history`` must be gap-free up to ``end``.
    """
    reach = max(f[1] + (f[2] - 1 if f[0] == "mean" else 0) for _, recipe, _ in models for f in recipe)
    rows = history.filter((F.col("d") <= end) & (F.col("d") > end - reach))
    packed = F.array_sort(F.collect_list(F.struct("d", F.col("sales").cast("double").alias("v"))))
    ids = list(dict.fromkeys([*series, *model_keys]))
    out = rows.groupBy(*ids).agg(packed.alias("_p")).select(*ids, F.transform("_p", lambda p: p["v"]).alias("_p"))
    done = 0
    for last, recipe, beta in models:
        out = out.join(beta.select(*model_keys, F.col("beta").alias("_b")), model_keys)

        def following(past: Column, recipe: list[tuple] = recipe) -> Column:
            eta = F.col("_b")[0]
            for i, feature in enumerate(recipe, 1):
                eta = eta + F.col("_b")[i] * _from_buffer(past, feature)
            return F.exp(eta) if family in ("poisson", "tweedie") else eta

        steps = F.sequence(F.lit(1), F.lit(last - done))
        grown = F.aggregate(steps, F.col("_p"), lambda past, _: F.concat(past, F.array(following(past))))
        out, done = out.select(*ids, grown.alias("_p")), last
    made = F.slice("_p", -done, done)
    return out.select(*series, F.posexplode(made).alias("step", "forecast")).withColumn("step", F.col("step") + 1)


def predict_recursive(history: DataFrame, beta: DataFrame, series: list[str], model_keys: list[str], lags: list[int],
                      widths: list[int], h: int, end: int, family: str = "poisson") -> DataFrame:
    """One model for all days: lags and means of the last days, of which later ones are predictions."""
    recipe = [("lag", n) for n in lags] + [("mean", 1, w) for w in widths]
    return fold_forecast(history, [(h, recipe, beta)], series, model_keys, end, family)


def stage_recipe(horizon: int, lags: int, widths: list[int], shifts: list[int], inner: list[int]) -> list[tuple]:
    """Features of the stage that ends at ``horizon``: lags and means that are known for all its days, and short means at
    ``shifts`` that reach into the days predicted before."""
    known = [("lag", horizon + n) for n in range(lags)] + [("mean", horizon, w) for w in widths]
    return known + [f for s in shifts for w in inner if (f := ("mean", s, w)) not in known]


def predict_staged(grid: DataFrame, series: list[str], model_keys: list[str], stages: list[int], end: int, lags: int = 3,
                   widths: tuple[int, ...] = (7, 28), shifts: tuple[int, ...] = (1, 7), inner: tuple[int, ...] = (7, 14),
                   family: str = "gaussian", whole: bool = False) -> DataFrame:
    """One model a horizon block, each with lags of its own; its short means read the blocks and days before it."""
    ids = list(dict.fromkeys([*series, *model_keys]))
    known = grid.filter(F.col("d") <= end).select(*ids, "d", "sales")
    models = []
    for last in stages:
        recipe = stage_recipe(last, lags, list(widths), list(shifts), list(inner))
        rows = history_features(known, series, recipe, whole=whole)
        beta = fit(rows, model_keys, [feature_name(f) for f in recipe], "sales", family)
        models.append((last, recipe, checkpoint_table(beta, f"stage-{last}")))
    return fold_forecast(known, models, series, model_keys, end, family)


def fit_trees(df: DataFrame, features: list[str], label: str, depth: int = 4, rounds: int = 10, seed: int = 1):
    """Gradient-boosted trees over one pooled table (squared error)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip")
    trees = GBTRegressor(featuresCol="x", labelCol=label, predictionCol="forecast", maxDepth=depth, maxIter=rounds, seed=seed)
    return Pipeline(stages=[assembler, trees]).fit(df)


def fit_count(df: DataFrame, features: list[str], label: str, family: str, power: float = 1.1, iterations: int = 10):
    """Pooled Poisson or Tweedie regression with log link from Spark ML."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    glm = GeneralizedLinearRegression(featuresCol="x", labelCol=label, predictionCol="forecast", maxIter=iterations, family=family)
    glm = glm.setVariancePower(power).setLinkPower(0.0) if family == "tweedie" else glm.setLink("log")
    assembler = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip")
    return Pipeline(stages=[assembler, glm]).fit(df)

"""Regression from sufficient statistics: one or two aggregation jobs, then k by k algebra on the driver.

Spatial models need (I - r W) only through inner products of y, X, Wy and WX, and through log |I - r W|. That comes
from the eigenvalues of the symmetric form of W for up to EXACT observations; beyond that from stochastic Lanczos quadrature with
seeded random vectors, which are joined with W once a step, and with a standard error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions.stats import chi2_tail, f_tail, normal_cdf, t_two_sided
from arealis.operators.cut import cut
from arealis.operators.weights import is_symmetric, row_standardise

EXACT = 3000


@dataclass
class Fit:
    """Coefficients with errors, statistics and p; fit measures and tests by name."""

    terms: list[str]
    coef: np.ndarray
    se: np.ndarray
    stat: np.ndarray
    p: np.ndarray
    cov: np.ndarray
    fit: dict[str, float]
    tests: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # value, df, p
    spatial: float | None = None

    def table(self, spark) -> DataFrame:
        rows = [(t, *map(float, v)) for t, *v in zip(self.terms, self.coef, self.se, self.stat, self.p, strict=True)]
        return spark.createDataFrame(rows, "term string, coef double, se double, stat double, p double")

    def report(self, spark) -> DataFrame:
        rows = [(k, None, float(v), None) for k, v in self.fit.items()] + [(k, float(v[1]), float(v[0]), float(v[2])) for k, v in self.tests.items()]
        return spark.createDataFrame(rows, "test string, df double, value double, p double")

    def text(self) -> str:
        lines = [f"{'variable':<14}{'coefficient':>16}{'std. error':>16}{'statistic':>14}{'probability':>14}"]
        lines += [f"{t:<14}{c:>16.7f}{s:>16.7f}{z:>14.6f}{p:>14.7f}" for t, c, s, z, p in zip(self.terms, self.coef, self.se, self.stat, self.p, strict=True)]
        lines += [f"{k}: {v:.6f}" for k, v in self.fit.items()]
        lines += [f"{k}: {v:.6f} (df {d:g}, p {p:.7f})" for k, (v, d, p) in self.tests.items()]
        return "\n".join(lines)


def products(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """n and the matrix of sums of products of columns (a constant among them is the number 1): one pass, k (k + 1) / 2 sums."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    col = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    row = df.agg(F.count(F.lit(1)), *[F.sum(col(columns[i]) * col(columns[j])) for i, j in pairs]).first()
    out = np.zeros((len(columns),) * 2)
    for (i, j), v in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return row[0], out


def _centred(df: DataFrame, xs: list[str], y: str) -> tuple[DataFrame, dict[str, float]]:
    means = df.agg(*[F.avg(c).alias(c) for c in (*xs, y)]).first().asDict()
    return df.select("*", *[(F.col(c) - F.lit(means[c])).alias(f"_c_{c}") for c in (*xs, y)]), means


def ols(df: DataFrame, y: str, xs: list[str], w: DataFrame | None = None, key: str = "obs_id") -> Fit:
    """Least squares with diagnostics; with W, Moran's I of residuals and the Lagrange multiplier tests too."""
    centred, means = _centred(df, xs, y)
    names = [f"_c_{c}" for c in (*xs, y)]
    n, m = products(centred, names)
    k = len(xs) + 1
    slopes = np.linalg.solve(m[:-1, :-1], m[:-1, -1]) if xs else np.empty(0)
    intercept = means[y] - sum(b * means[x] for b, x in zip(slopes, xs, strict=True))
    coef = np.concatenate([[intercept], slopes])
    rss = float(m[-1, -1] - slopes @ m[:-1, -1]) if xs else float(m[-1, -1])
    tss = float(m[-1, -1])
    mu = np.array([means[x] for x in xs])
    inner = np.linalg.inv(m[:-1, :-1]) if xs else np.empty((0, 0))
    inv = np.block([[np.array([[1 / n + mu @ inner @ mu]]), -(mu @ inner)[None, :]], [-(inner @ mu)[:, None], inner]]) if xs else np.array([[1 / n]])
    s2, s2ml = rss / (n - k), rss / n
    cov = s2 * inv
    se = np.sqrt(np.diag(cov))
    t = coef / se
    r2 = 1 - rss / tss if tss else 0.0
    r2 = r2 if 0 <= r2 <= 1 else 0.0
    log_l = -n / 2 * (math.log(2 * math.pi) + math.log(s2ml) + 1)
    f = ((tss - rss) / (k - 1)) / s2 if k > 1 else math.nan
    fit = {"n": n, "k": k, "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / (n - k), "rss": rss, "sigma2": s2, "sigma2_ml": s2ml, "log_likelihood": log_l, "aic": -2 * log_l + 2 * k, "sc": -2 * log_l + k * math.log(n), "f": f, "f_p": f_tail(f, k - 1, n - k) if k > 1 else math.nan, "mean_y": means[y], "sd_y": math.sqrt(tss / (n - 1))}
    out = Fit(["CONSTANT", *xs], coef, se, t, np.array([t_two_sided(v, n - k) for v in t]), cov, fit)
    res = residuals(df, y, xs, out)
    _ols_tests(res, xs, out, n, k)
    if w is not None:
        _spatial_tests(res, w, y, xs, out, key)
    return out


def predict(df: DataFrame, xs: list[str], fit: Fit, out: str = "predicted"):
    value = F.lit(float(fit.coef[0]))
    for b, x in zip(fit.coef[1:], xs, strict=False):
        value = value + float(b) * F.col(x)
    return df.withColumn(out, value)


def residuals(df: DataFrame, y: str, xs: list[str], fit: Fit) -> DataFrame:
    """The rows with predicted and residual."""
    return predict(df, xs, fit).withColumn("residual", F.col(y) - F.col("predicted"))


def _r2_on(df: DataFrame, target: str, columns: list[str]) -> tuple[float, float, int]:
    """R squared, explained sum of squares and rank of a regression of target on a constant and columns."""
    names = list(columns)
    means = df.agg(*[F.avg(c) for c in (*names, target)]).first()
    shifted = df.select(*[(F.col(c) - F.lit(float(m))).alias(f"_{i}") for i, (c, m) in enumerate(zip((*names, target), means, strict=True))])
    _, m = products(shifted, [f"_{i}" for i in range(len(names) + 1)])
    scale = np.sqrt(np.where(np.diag(m)[:-1] > 0, np.diag(m)[:-1], 1.0))
    a = m[:-1, :-1] / np.outer(scale, scale)
    b = m[:-1, -1] / scale
    explained = float(b @ np.linalg.pinv(a, rcond=1e-10) @ b)
    return explained / m[-1, -1] if m[-1, -1] else 0.0, explained, int(np.linalg.matrix_rank(a, tol=1e-10))


def _ols_tests(res: DataFrame, xs: list[str], out: Fit, n: int, k: int) -> None:
    _, m = products(res, ["1", *xs])
    scale = np.sqrt(np.diag(m))
    lam = np.linalg.eigvalsh(m / np.outer(scale, scale))
    out.fit["condition_number"] = math.sqrt(lam[-1] / max(lam[0], 1e-300))
    e = F.col("residual")
    e2, e3, e4 = res.agg(F.sum(e * e), F.sum(e * e * e), F.sum(e * e * e * e)).first()
    var = e2 / (n - 1 if n <= 30 else n)
    skew, kurt = e3 / n / var**1.5, e4 / n / var**2
    jb = n * (skew**2 / 6 + (kurt - 3) ** 2 / 24)
    out.tests["jarque_bera"] = (jb, 2, chi2_tail(jb, 2))
    if not xs:
        return
    s2 = out.fit["sigma2_ml"]
    sq = res.select("residual", (e * e - s2).alias("_g"), (e * e).alias("_e2"), *[(F.col(x) * F.col(x)).alias(f"_q{i}") for i, x in enumerate(xs)], *xs)
    _, ess, _ = _r2_on(sq, "_g", [f"_q{i}" for i in range(len(xs))])
    bp = ess / (2 * s2 * s2)
    out.tests["breusch_pagan"] = (bp, k - 1, chi2_tail(bp, k - 1))
    mean_g2 = e4 / n - s2 * s2
    kb = ess / mean_g2
    out.tests["koenker_bassett"] = (kb, k - 1, chi2_tail(kb, k - 1))
    cross = {f"_w{i}_{j}": F.col(xs[i]) * F.col(xs[j]) for i in range(len(xs)) for j in range(i, len(xs))}
    r2, _, _ = _r2_on(sq.withColumns(cross), "_e2", [*xs, *cross])
    df = ((k - 1) ** 2 + 3 * (k - 1)) / 2
    out.tests["white"] = (n * r2, df, chi2_tail(n * r2, df))


def lagged(df: DataFrame, w: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows with the row-standardised lags `_l_<column>` of several columns, by one join."""
    sums = w.select("src", "dst").join(df.select(F.col(key).alias("dst"), *columns), "dst").groupBy("src").agg(*[F.avg(c).alias(f"_l_{c}") for c in columns])
    return df.join(sums.withColumnRenamed("src", key), key, "left").fillna(0.0, [f"_l_{c}" for c in columns])


def trace_w(w: DataFrame) -> float:
    """tr(W'W + WW) of the row-standardised W: sums over pairs and their opposites."""
    s = row_standardise(w)
    other = s.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v"))
    return s.join(other, ["src", "dst"], "left").agg(F.sum(F.col("w") * F.col("w") + F.col("w") * F.coalesce("v", F.lit(0.0)))).first()[0]


def _spatial_tests(res: DataFrame, w: DataFrame, y: str, xs: list[str], out: Fit, key: str) -> None:
    n, k, s2 = out.fit["n"], out.fit["k"], out.fit["sigma2_ml"]
    full = lagged(res.withColumn("_one", F.lit(1.0)), w, key, ["residual", y, "predicted", "_one", *xs])
    names = ["residual", "_l_residual", f"_l_{y}", "_l_predicted", "_one", *xs, "_l__one", *[f"_l_{x}" for x in xs]]
    _, m = products(full, names)
    at = names.index
    ee, ewe, ewy = m[0, 0], m[0, 1], m[0, at(f"_l_{y}")]
    t = trace_w(w)
    design = [at("_one"), *[at(x) for x in xs]]
    lag_design = [at("_l__one"), *[at(f"_l_{x}") for x in xs]]
    xx = np.linalg.pinv(m[np.ix_(design, design)])
    xf = m[np.ix_(design, [at("_l_predicted")])][:, 0]
    quad = float(m[at("_l_predicted"), at("_l_predicted")] - xf @ xx @ xf)
    info = quad / s2 + t
    out.fit["moran_residuals"] = ewe / ee
    xwx = m[np.ix_(design, lag_design)]
    wxwx = m[np.ix_(lag_design, lag_design)]
    a = xx @ xwx
    # Exact moments of the residuals' Moran's I for row-standardised W.
    s0 = full.where(F.col("_l__one") != 0).count()
    scale = n / s0 if s0 else 0.0
    mean = -float(np.trace(a)) / (n - k)
    xw = _transposed_products(full, w, key, ["_one", *xs])
    tr_mwmw = _trace_ww(w) - 2 * float(np.trace(xx @ _xwwx(full, w, key, ["_one", *xs]))) + float(np.trace(a @ a))
    tr_mwmw_t = _trace_wtw(w) - float(np.trace(xx @ xw)) - float(np.trace(xx @ wxwx)) + float(np.trace(a @ (xx @ xwx.T)))
    var = (tr_mwmw_t + tr_mwmw + float(np.trace(a)) ** 2) / ((n - k) * (n - k + 2)) - mean**2
    z = (ewe / ee - mean) / math.sqrt(var) if var > 0 else math.nan
    out.tests["moran_z"] = (z, 0, 2 * (1 - normal_cdf(abs(z))) if z == z else math.nan)
    out.fit["moran_scale"] = scale
    d_rho, d_lambda = ewy / s2, ewe / s2
    lag_test, err_test = d_rho**2 / info, d_lambda**2 / t
    rob_lag = (d_rho - d_lambda) ** 2 / (info - t) if info > t else math.nan
    rob_err = (d_lambda - t / info * d_rho) ** 2 / (t * (1 - t / info)) if info > t else math.nan
    for name, value, df in (("lm_lag", lag_test, 1), ("robust_lm_lag", rob_lag, 1), ("lm_error", err_test, 1), ("robust_lm_error", rob_err, 1), ("lm_sarma", rob_lag + err_test, 2)):
        out.tests[name] = (value, df, chi2_tail(value, df) if value == value else math.nan)


def _trace_ww(w: DataFrame) -> float:
    s = row_standardise(w)
    other = s.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("v"))
    return s.join(other, ["src", "dst"]).agg(F.coalesce(F.sum(F.col("w") * F.col("v")), F.lit(0.0))).first()[0]


def _trace_wtw(w: DataFrame) -> float:
    return row_standardise(w).agg(F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0.0))).first()[0]


def _transposed_lags(df: DataFrame, w: DataFrame, key: str, columns: list[str]) -> DataFrame:
    s = row_standardise(w)
    sums = s.join(df.select(F.col(key).alias("src"), *columns), "src").groupBy("dst").agg(*[F.sum(F.col("w") * F.col(c)).alias(f"_t_{c}") for c in columns])
    return df.join(sums.withColumnRenamed("dst", key), key, "left").fillna(0.0, [f"_t_{c}" for c in columns])


def _transposed_products(df: DataFrame, w: DataFrame, key: str, columns: list[str]) -> np.ndarray:
    """X'WW'X."""
    found = _transposed_lags(df.select(key, *columns), w, key, columns)
    return products(found, [f"_t_{c}" for c in columns])[1]


def _xwwx(df: DataFrame, w: DataFrame, key: str, columns: list[str]) -> np.ndarray:
    """X'WWX from W'X and WX."""
    found = _transposed_lags(df, w, key, columns)
    names = [f"_t_{c}" for c in columns] + [f"_l_{c}" for c in columns]
    m = products(found, names)[1]
    return m[: len(columns), len(columns) :]


class LogDet:
    """r -> log |I - r W|, and the standard error of that: 0 from eigenvalues; else from quadratures, one (nodes, weights) for each random vector.

    The first two terms of the power series are taken off the quadratures and added exactly, since tr W = 0 and tr WW is known.
    """

    def __init__(self, n: int, quadratures: list[tuple[np.ndarray, np.ndarray]] | None = None, trace_ww: float = 0.0, eigenvalues: np.ndarray | None = None) -> None:
        self.n, self.quadratures, self.trace_ww, self.eigenvalues = n, quadratures or [], trace_ww, eigenvalues

    def _values(self, r: float) -> np.ndarray:
        return np.array([self.n * (t @ (np.log1p(-r * x) + r * x + r * r * x * x / 2)) for x, t in self.quadratures])

    def __call__(self, r: float) -> float:
        if self.eigenvalues is not None:
            return float(np.log1p(-r * self.eigenvalues).sum())
        return float(self._values(r).mean()) - r * r * self.trace_ww / 2

    def error(self, r: float) -> float:
        if self.eigenvalues is not None:
            return 0.0
        values = self._values(r)
        return float(values.std(ddof=1) / math.sqrt(len(values))) if len(values) > 1 else math.inf


def quadrature(diagonal: list[float], beside: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Gauss nodes (kept inside -1 to 1, where the eigenvalues lie) and weights of a tridiagonal matrix."""
    t = np.diag(diagonal) + np.diag(beside[: len(diagonal) - 1], 1) + np.diag(beside[: len(diagonal) - 1], -1)
    values, vectors = np.linalg.eigh(t)
    return np.clip(values, -1.0, 1.0), vectors[0] ** 2


def lanczos(s: DataFrame, keys: DataFrame, key: str, steps: int, vectors: int, seed: int) -> list[tuple[list[float], list[float]]]:
    """Tridiagonal matrices of a symmetric relation s(src, dst, v) from random signs. A step is one distributed product with all vectors; two sums for each come to the driver."""
    names = [f"u{i}" for i in range(vectors)]
    n = keys.count()
    signs = [F.when(F.xxhash64(F.col(key), F.lit(seed + i)) % 2 == 0, 1.0).otherwise(-1.0) / math.sqrt(n) for i in range(vectors)]
    state = cut(keys.select(F.col(key).alias("src"), *[x.alias(c) for x, c in zip(signs, names, strict=True)], *[F.lit(0.0).alias(f"p{c}") for c in names]))
    beta, found, live = [0.0] * vectors, [([], []) for _ in names], [True] * vectors
    for step in range(steps):
        sums = s.join(state.select(F.col("src").alias("dst"), *names), "dst").groupBy("src").agg(*[F.sum(F.col("v") * F.col(c)).alias(f"a{c}") for c in names])
        moved = state.join(sums, "src", "left").select("src", *names, *[(F.coalesce(f"a{c}", F.lit(0.0)) - F.lit(b) * F.col(f"p{c}")).alias(f"a{c}") for c, b in zip(names, beta, strict=True)])
        moved = cut(moved)
        got = moved.agg(*[F.sum(F.col(f"a{c}") * F.col(c)) for c in names], *[F.sum(F.col(f"a{c}") * F.col(f"a{c}")) for c in names]).first()
        alpha, beta = got[:vectors], [math.sqrt(max(q - a * a, 0.0)) for a, q in zip(got[:vectors], got[vectors:], strict=True)]
        for i in range(vectors):
            if live[i]:
                found[i][0].append(alpha[i])
                found[i][1].append(beta[i])
                live[i] = beta[i] > 1e-6  # else, but for rounding, the vector's space is exhausted, and its quadrature exact
        if not any(live):
            break
        state = moved.select("src", *[((F.col(f"a{c}") - F.lit(a) * F.col(c)) / F.lit(b if up else 1.0)).alias(c) for c, a, b, up in zip(names, alpha, beta, live, strict=True)], *[F.col(c).alias(f"p{c}") for c in names])
    return found


def log_det(w: DataFrame, keys: DataFrame, key: str = "obs_id", steps: int = 40, vectors: int = 16, seed: int = 42, exact: int = EXACT) -> LogDet:
    """log |I - r W| for row-standardised W of symmetric contiguity: from eigenvalues up to `exact` observations, beyond that by stochastic Lanczos
    quadrature over products with the symmetric form of W, with a standard error. The quadratures' own error falls by a constant factor a step (at r = 0.99 by 1.3)."""
    n = keys.count()
    if n <= exact:
        names = {r[0]: i for i, r in enumerate(keys.select(key).orderBy(key).collect())}
        pairs = w.select("src", "dst").collect()
        a = np.zeros((n, n))
        for s, d in pairs:
            a[names[s], names[d]] = 1.0
        deg = a.sum(1)
        root = np.where(deg > 0, 1 / np.sqrt(np.where(deg > 0, deg, 1)), 0)
        return LogDet(n, eigenvalues=np.linalg.eigvalsh(a * root[:, None] * root[None, :]))
    degree = w.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    s = cut(w.select("src", "dst").join(degree, "src").join(degree.toDF("dst", "l"), "dst").select("src", "dst", (1 / F.sqrt(F.col("k") * F.col("l"))).alias("v")))
    squares = s.agg(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).first()[0]
    return LogDet(n, [quadrature(*t) for t in lanczos(s, keys, key, steps, vectors, seed)], squares)


def golden(f, low: float = -0.999999, high: float = 0.999999, tol: float = 1e-12) -> float:
    """The place of the maximum."""
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol:
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def _spatial_matrices(df: DataFrame, w: DataFrame, y: str, xs: list[str], key: str):
    if not is_symmetric(w):
        raise ValueError("the weights must be symmetric")
    full = lagged(df.withColumn("_one", F.lit(1.0)).select(key, y, "_one", *xs), w, key, [y, "_one", *xs])
    names = ["_one", *xs, y, "_l__one", *[f"_l_{x}" for x in xs], f"_l_{y}"]
    n, m = products(full, names)
    k = len(xs) + 1
    return full, n, m, k


def spatial_lag(df: DataFrame, y: str, xs: list[str], w: DataFrame, key: str = "obs_id") -> Fit:
    """Maximum likelihood of y = r W y + X b + e: the likelihood needs three scalars and log |I - r W|."""
    base = ols(df, y, xs)
    full, n, m, k = _spatial_matrices(df, w, y, xs, key)
    x, iy, il = list(range(k)), k, 2 * k + 1
    inv = np.linalg.inv(m[np.ix_(x, x)])
    b0, bl = inv @ m[x, iy], inv @ m[x, il]
    e00, e0l, ell = m[iy, iy] - b0 @ m[x, iy], m[iy, il] - b0 @ m[x, il], m[il, il] - bl @ m[x, il]
    det = log_det(w, df, key)
    sse = lambda r: e00 - 2 * r * e0l + r * r * ell
    log_l = lambda r: -n / 2 * (math.log(2 * math.pi) + math.log(sse(r) / n) + 1) + det(r)
    rho = golden(log_l)
    beta, s2 = b0 - rho * bl, sse(rho) / n
    cov = _numeric_cov(lambda v: _lag_likelihood(v, m, x, iy, il, n, k, det), np.concatenate([[rho], beta, [s2]]))
    out = _spatial_fit("W_" + y, ["CONSTANT", *xs], rho, beta, s2, cov, log_l(rho), n, k + 1, base)
    out.fit["log_likelihood_se"] = det.error(rho)
    return out


def _lag_likelihood(v, m, x, iy, il, n, k, det) -> float:
    rho, b, s2 = v[0], v[1 : k + 1], v[k + 1]
    vec = np.zeros(len(m))
    vec[iy], vec[il], vec[x] = 1, -rho, -b
    return -n / 2 * math.log(2 * math.pi * s2) + det(rho) - vec @ m @ vec / (2 * s2)


def spatial_error(df: DataFrame, y: str, xs: list[str], w: DataFrame, key: str = "obs_id") -> Fit:
    """Maximum likelihood of y = X b + u, u = l W u + e: the filtered products are quadratic in l, so no pass is repeated."""
    base = ols(df, y, xs)
    full, n, m, k = _spatial_matrices(df, w, y, xs, key)
    det = log_det(w, df, key)

    def filtered(lam: float) -> np.ndarray:
        f = np.hstack([np.eye(k + 1), -lam * np.eye(k + 1)])
        return f @ m @ f.T

    def solve(lam: float):
        q = filtered(lam)
        b = np.linalg.solve(q[:k, :k], q[:k, k])
        return b, (q[k, k] - b @ q[:k, k]) / n

    log_l = lambda lam: -n / 2 * (math.log(2 * math.pi) + math.log(solve(lam)[1]) + 1) + det(lam)
    lam = golden(log_l)
    beta, s2 = solve(lam)

    def likelihood(v) -> float:
        q, vec = filtered(v[0]), np.concatenate([-v[1 : k + 1], [1]])
        return -n / 2 * math.log(2 * math.pi * v[k + 1]) + det(v[0]) - vec @ q @ vec / (2 * v[k + 1])

    cov = _numeric_cov(likelihood, np.concatenate([[lam], beta, [s2]]))
    out = _spatial_fit("LAMBDA", ["CONSTANT", *xs], lam, beta, s2, cov, log_l(lam), n, k, base)
    out.fit["log_likelihood_se"] = det.error(lam)
    out.tests["wald"] = (float(out.stat[-1] ** 2), 1, chi2_tail(float(out.stat[-1] ** 2), 1))
    return out


def _numeric_cov(f, v: np.ndarray) -> np.ndarray:
    """Inverse of the observed information by central differences."""
    h = np.maximum(np.abs(v), 1e-2) * 1e-4
    size = len(v)
    hess = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            def at(a, b):
                u = v.copy()
                u[i] += a * h[i]
                u[j] += b * h[j]
                return f(u)

            hess[i, j] = hess[j, i] = (at(1, 1) - at(1, -1) - at(-1, 1) + at(-1, -1)) / (4 * h[i] * h[j])
    return np.linalg.inv(-hess)


def _spatial_fit(name: str, terms: list[str], r: float, beta: np.ndarray, s2: float, cov: np.ndarray, log_l: float, n: int, k: int, base: Fit) -> Fit:
    order = [*range(1, len(beta) + 1), 0]
    coef = np.concatenate([beta, [r]])
    part = cov[np.ix_(order, order)]
    se = np.sqrt(np.diag(part))
    z = coef / se
    lr = 2 * (log_l - base.fit["log_likelihood"])
    fit = {"n": n, "k": k, "sigma2_ml": s2, "log_likelihood": log_l, "aic": -2 * log_l + 2 * k, "sc": -2 * log_l + k * math.log(n)}
    return Fit([*terms, name], coef, se, z, np.array([2 * (1 - normal_cdf(abs(v))) for v in z]), part, fit, {"likelihood_ratio": (lr, 1, chi2_tail(max(lr, 0.0), 1))}, r)


def save_lag(df: DataFrame, y: str, xs: list[str], w: DataFrame, fit: Fit, key: str = "obs_id", rounds: int = 60) -> DataFrame:
    """LAG_PREDIC = (I - rW)^-1 X b by its power series, LAG_RESIDU = y - rWy - Xb, LAG_PRDERR = y - prediction."""
    beta, rho = fit.coef[:-1], float(fit.spatial)
    xb = predict(df, xs, Fit(fit.terms, beta, beta, beta, beta, fit.cov, {}), "_xb")
    step = lagged(xb, w, key, [y]).withColumn("LAG_RESIDU", F.col(y) - rho * F.col(f"_l_{y}") - F.col("_xb")).withColumn("_sum", F.col("_xb")).withColumn("_term", F.col("_xb"))
    base = step.columns
    power = 1.0
    for i in range(rounds):
        power *= abs(rho)
        if power < 1e-10:
            break
        step = lagged(step, w, key, ["_term"]).withColumn("_term", rho * F.col("_l__term")).withColumn("_sum", F.col("_sum") + F.col("_term")).select(base)
        if i % 5 == 4:
            step = cut(step)
    return step.withColumn("LAG_PREDIC", F.col("_sum")).withColumn("LAG_PRDERR", F.col(y) - F.col("_sum")).select(*df.columns, "LAG_PREDIC", "LAG_RESIDU", "LAG_PRDERR")


def save_error(df: DataFrame, y: str, xs: list[str], w: DataFrame, fit: Fit, key: str = "obs_id") -> DataFrame:
    """ERR_PREDIC = X b, ERR_PRDERR = y - X b, ERR_RESIDU the filtered residual."""
    beta, lam = fit.coef[:-1], float(fit.spatial)
    found = predict(df, xs, Fit(fit.terms, beta, beta, beta, beta, fit.cov, {}), "ERR_PREDIC").withColumn("ERR_PRDERR", F.col(y) - F.col("ERR_PREDIC"))
    return lagged(found, w, key, ["ERR_PRDERR"]).withColumn("ERR_RESIDU", F.col("ERR_PRDERR") - lam * F.col("_l_ERR_PRDERR")).select(*df.columns, "ERR_PREDIC", "ERR_RESIDU", "ERR_PRDERR")

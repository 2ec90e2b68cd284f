"""Geometry of the market state as grouped tasks around the numpy kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantflume.functions.scalar import finite, signed_log
from quantflume.functions.series import KEY, TIME, by_time
from quantflume.kernels import curvature as cv
from quantflume.kernels import gridfield
from quantflume.kernels.density import Density, scott
from quantflume.session import written

SCAN = ["phi", "grad_phi_norm", "mahalanobis", "max_abs_z", "H_det", "H_mineig", "H_maxeig", "H_neg", "H_R", "H_G_norm", "H_ric_norm", "H_T_norm", "lam_field", "H_T_lam_share", "H_field_eq_kappa", "H_field_eq_r2", "F_det", "F_mineig", "F_maxeig", "F_R", "F_G_norm", "Fref_R", "H_singular", "F_singular"]


def evaluate(past: np.ndarray, lam: np.ndarray | None, at: np.ndarray, h: float, step: float = 1e-3, fisher: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """All scan values at the points ``at`` for a density of the rows ``past``; the Einstein and stress tensors besides.

    One matrix of kernel weights per lattice point serves every metric.
    """
    kde, n = Density(past, h), len(at)
    out = {k: np.full(n, np.nan) for k in SCAN}
    mu, inv = kde.x.mean(axis=0), np.linalg.pinv(np.cov(kde.x, rowvar=False))
    w, _ = kde.weights(at)
    grad = kde.gradient(at, w)
    out["phi"] = -kde.log_density(at)
    out["grad_phi_norm"] = np.linalg.norm(grad, axis=1)
    out["mahalanobis"] = np.sqrt(np.einsum("ni,ij,nj->n", at - mu, inv, at - mu))
    out["max_abs_z"] = np.abs(at).max(axis=1)
    c = cv.curvature(kde.hessian, at, step)
    fill = lambda name, values, ok: out[name].__setitem__(ok, values[ok])
    out["H_singular"] = (~c.ok).astype(float)
    for name, v in (("H_det", c.det), ("H_mineig", c.eigenvalues[:, 0]), ("H_maxeig", c.eigenvalues[:, -1]), ("H_neg", (c.eigenvalues < 0).sum(axis=1).astype(float)), ("H_R", c.scalar), ("H_G_norm", cv.tensor_norm(c.einstein, c.inverse)), ("H_ric_norm", cv.tensor_norm(c.ricci, c.inverse))):
        fill(name, v, c.ok)
    t = np.full_like(c.einstein, np.nan)
    if lam is not None:
        lv = w @ lam
        glam = _lam_gradient(kde, lam, at, w, lv)
        t = cv.stress(grad, lv, glam, c.g, c.inverse)
        i, j = kde.pairs
        g_, t_ = c.einstein[:, i, j], t[:, i, j]
        kappa = (g_ * t_).sum(axis=1) / ((t_ * t_).sum(axis=1) + 1e-300)
        rest = g_ - kappa[:, None] * t_
        tn = cv.tensor_norm(t, c.inverse)
        for name, v in (("H_T_norm", tn), ("lam_field", lv), ("H_T_lam_share", cv.tensor_norm(cv.W_LAM * lv[:, None, None] * c.g, c.inverse) / (tn + 1e-300)), ("H_field_eq_kappa", kappa), ("H_field_eq_r2", 1 - (rest * rest).sum(axis=1) / ((g_ * g_).sum(axis=1) + 1e-300))):
            fill(name, v, c.ok)
    if fisher:
        own, ref = kde.scores(), kde.reference_scores()
        for kind, s in (("F", own), ("Fref", ref)):
            k = cv.curvature(lambda x, s=s: kde.fisher(s, kde.weights(x)[0]), at, step)
            ok = k.ok & c.ok
            if kind == "F":
                out["F_singular"] = (c.ok & ~k.ok).astype(float)
                for name, v in (("F_det", k.det), ("F_mineig", k.eigenvalues[:, 0]), ("F_maxeig", k.eigenvalues[:, -1]), ("F_R", k.scalar), ("F_G_norm", cv.tensor_norm(k.einstein, k.inverse))):
                    fill(name, v, ok)
                good = ok
            else:
                fill("Fref_R", k.scalar, ok & good)
    return out, c.einstein, t


def _lam_gradient(kde: Density, lam: np.ndarray, at: np.ndarray, w: np.ndarray, lv: np.ndarray) -> np.ndarray:
    """Gradient of the kernel-weighted mean of the rigidity."""
    mean_u = kde.moments(at, w)[0]
    wl = w * lam
    mean_lu = (at * wl.sum(axis=1)[:, None] - wl @ kde.x) / kde.h
    return -(mean_lu - lv[:, None] * mean_u) / kde.h


def causal_scan(df: DataFrame, columns: list[str], lam: str | None = None, window: int = 1500, refit: int = 60, every: int = 1, h: float | None = None, fisher: bool = True, step: float = 1e-3, refits: int = 8) -> DataFrame:
    """Geometry of every ``every``-th bar from a density of the ``window`` bars before its block of ``refit`` bars.

    A series is cut into runs of ``refits`` blocks; each run's task gets its own
    bars and the window before them, so a long series spreads over as many
    tasks as it has runs, no task holds more than ``window + refits * refit``
    rows, and a bar is shuffled ``1 + window / (refits * refit)`` times. Blocks with
    fewer than half a window of complete bars, and incomplete bars, give no
    row; a metric that can't be inverted gives a row with its flag and nulls.
    Without any block the result is empty.
    """
    d = len(columns)
    h = h or scott(window, d)
    n = F.row_number().over(by_time()) - 1
    at = df.select(KEY, TIME, *[F.col(c).cast("double") for c in columns], *([F.col(lam).cast("double").alias("_lam")] if lam else [])).withColumn("_n", n.cast("long"))
    # bar n lies in run (n - window) / length and in the histories of the later runs that begin within a window of it
    length = refits * refit
    first = F.greatest(F.floor((F.col("_n") - window) / length), F.lit(0))
    last = F.floor(F.col("_n") / length)
    spread = at.withColumn("_run", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    i, j = np.triu_indices(d)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_n"])
        k, z = pdf["_n"].to_numpy(), pdf[columns].to_numpy(dtype=float)
        whole, out = np.isfinite(z).all(axis=1), []
        values = np.nan_to_num(pdf["_lam"].to_numpy(dtype=float), nan=0.0, posinf=0.0, neginf=0.0) if lam else None
        for block in range(refits):
            t0 = int(pdf["_run"].iloc[0]) * length + block * refit + window
            past, own = (k >= t0 - window) & (k < t0) & whole, (k >= t0) & (k < t0 + refit) & ((k - t0) % every == 0) & whole
            if past.sum() < window // 2 or not own.any():
                continue
            got, g, t = evaluate(z[past], None if values is None else values[past], z[own], h, step, fisher)
            out.append(pd.DataFrame({KEY: pdf[KEY].to_numpy()[own], TIME: pdf[TIME].to_numpy()[own]} | got | {"einstein": list(g[:, i, j]), "stress": list(t[:, i, j])}))
        return pd.concat(out) if out else pd.DataFrame(columns=[KEY, TIME, *SCAN, "einstein", "stress"])

    kinds = dict(df.dtypes)
    schema = f"{KEY} {kinds[KEY]}, {TIME} {kinds[TIME]}, " + ", ".join(f"{c} double" for c in SCAN) + ", einstein array<double>, stress array<double>"
    out = spread.groupBy(KEY, "_run").applyInPandas(run, schema)
    return out.select(KEY, TIME, *[finite(c).alias(c) for c in SCAN], "einstein", "stress")


def delta_f(scan: DataFrame) -> DataFrame:
    """``scan`` with ``dF``: how much the local Fisher curvature exceeds the Gaussian reference's, in signed logs."""
    return scan.withColumn("dF", signed_log(F.col("F_R")) - signed_log(F.col("Fref_R")))


def reliability(df: DataFrame, columns: list[str], lam: str | None = None, window: int = 1500, bars: int = 240, scales: tuple[float, ...] = (0.5, 1.0, 2.0, 3.0, 4.0), seed: int = 0) -> DataFrame:
    """Scan values of sampled bars from the even and from the odd bars of their window, at several bandwidths.

    One row per (bar, scale, half); correlate the halves' ranks for reliability.
    """
    d = len(columns)
    n = F.row_number().over(by_time()) - 1
    at = df.select(KEY, TIME, *[F.col(c).cast("double") for c in columns]).withColumn("_n", n.cast("long"))
    order = F.row_number().over(Window.partitionBy(KEY).orderBy(F.xxhash64(F.lit(seed), TIME), TIME))
    chosen = at.where(F.col("_n") >= window).withColumn("_o", order).where(F.col("_o") <= bars).select(KEY, F.col(TIME).alias("_at"), F.col("_n").alias("_k"), F.array(*columns).alias("_x"))
    # a chosen bar meets the rows of the one or two window-sized blocks that hold its history
    at = at.withColumn("_b", F.floor(F.col("_n") / window))
    chosen = chosen.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor((F.col("_k") - window) / window), F.floor((F.col("_k") - 1) / window)))))
    rows = chosen.join(at, [KEY, "_b"]).where((F.col("_n") >= F.col("_k") - window) & (F.col("_n") < F.col("_k")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, odd = pdf[columns].to_numpy(dtype=float), pdf["_n"].to_numpy() % 2
        x = np.array([pdf["_x"].iloc[0]], dtype=float)
        out = []
        for half in (0, 1):
            past = z[odd == half]
            past = past[np.isfinite(past).all(axis=1)]
            if len(past) < window // 4 or not np.isfinite(x).all():
                continue
            for s in scales:
                got, _, _ = evaluate(past, None, x, s * scott(window, d))
                out.append({KEY: pdf[KEY].iloc[0], TIME: pdf["_at"].iloc[0], "half": half, "scale": s, "phi": got["phi"][0], "H_R": got["H_R"][0], "F_R": got["F_R"][0], "Fref_R": got["Fref_R"][0]})
        return pd.DataFrame(out, columns=[KEY, TIME, "half", "scale", "phi", "H_R", "F_R", "Fref_R"])

    kinds = dict(df.dtypes)
    out = rows.groupBy(KEY, "_at").applyInPandas(run, f"{KEY} {kinds[KEY]}, {TIME} {kinds[TIME]}, half int, scale double, phi double, H_R double, F_R double, Fref_R double")
    return out.select(KEY, TIME, "half", "scale", *[finite(c).alias(c) for c in ("phi", "H_R", "F_R", "Fref_R")])


def density_at(df: DataFrame, columns: list[str], by: str, id_col: str, h: float | None = None, tile: int = 2048, together: int = 16) -> DataFrame:
    """At every row the density of its group's rows: log density, gradient and Hessian of the surprise, own score without itself, local Fisher matrix.

    ``h`` None: Scott's bandwidth of the group's size. Every row meets every
    other of its group by the definition; rows come in tiles, and a task has one
    tile of points and up to ``together`` tiles of samples, whose sums it adds
    up block by block. A row's own kernel is 1, so sums run over the others and
    it is added at the end. Rows with a null or a value that isn't finite among ``columns`` give
    none; repeated rows count as often as they occur; of a group of one row the
    score and the Fisher matrix are null; matrices are upper triangles, row by row.
    """
    d = len(columns)
    pairs = list(zip(*(k.tolist() for k in np.triu_indices(d)), strict=True))
    xs = [f"qf_x{k}" for k in range(d)]
    rows = df.select(by, id_col, *[finite(F.col(c).cast("double")).alias(x) for c, x in zip(columns, xs, strict=True)])
    rows = written(rows.dropna(subset=xs).withColumn("qf_n", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.col(by).alias("qf_by")).agg(F.count(F.lit(1)).alias("qf_size"))
    width = F.lit(float(h)) if h else F.pow(F.col("qf_size"), F.lit(-1.0 / (d + 4)))
    sizes = sizes.withColumn("qf_h", width).withColumn("qf_tiles", F.ceil(F.col("qf_size") / tile).cast("int"))
    rows = rows.join(sizes, F.col(by).eqNullSafe(F.col("qf_by"))).drop("qf_by").withColumn("qf_tile", F.pmod(F.xxhash64("qf_n"), F.col("qf_tiles")).cast("int"))

    def moments(b: np.ndarray, _: np.ndarray) -> np.ndarray:
        return np.concatenate([b, *[(b[:, i] * b[:, j])[:, None] for i, j in pairs]], axis=1)

    def about(a: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Sums of u and of its products, from those of the samples, u = a - b."""
        total, first = sums[:, :1], sums[:, 1 : d + 1]
        second = [total[:, 0] * a[:, i] * a[:, j] - a[:, i] * first[:, j] - a[:, j] * first[:, i] + sums[:, d + 1 + k] for k, (i, j) in enumerate(pairs)]
        return np.column_stack([total, total * a - first, *second])

    part = F.col("qf_top").isNotNull()
    first = _kernel_sums(rows, by, xs, [], moments, about, 1 + d + len(pairs), together)
    near, zero = F.when(part, F.exp("qf_top")).otherwise(0.0), F.lit(0.0)
    out = rows.join(first, "qf_n", "left")
    total = 1 + near * F.coalesce(F.col("qf_sums")[0], zero)
    mean = [near * F.coalesce(F.col("qf_sums")[1 + k], zero) / total for k in range(d)]
    second = [near * F.coalesce(F.col("qf_sums")[1 + d + k], zero) / total for k in range(len(pairs))]
    hw = F.col("qf_h")
    hessian = [((1.0 if i == j else 0.0) - (second[k] - mean[i] * mean[j])) / (hw * hw) for k, (i, j) in enumerate(pairs)]
    scores = [F.when(part, F.col("qf_sums")[1 + k] / F.col("qf_sums")[0] / hw) for k in range(d)]
    cs = [f"qf_c{k}" for k in range(d)]
    log_density = F.log(total) - F.log("qf_size") - d / 2 * F.log(2 * np.pi * hw * hw)
    kept = [by, id_col, *xs, "qf_n", "qf_h", "qf_tiles", "qf_tile"]
    out = written(out.select(*kept, total.alias("qf_total"), near.alias("qf_near"), log_density.alias("log_density"), F.array(*[m / hw for m in mean]).alias("gradient"), F.array(*hessian).alias("hessian"), *[c.alias(n) for n, c in zip(cs, scores, strict=True)]))

    def products(_: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.column_stack([c[:, i] * c[:, j] for i, j in pairs])

    again = _kernel_sums(out.select(*kept, *cs), by, xs, cs, products, lambda a, sums: sums[:, 1:], len(pairs), together)
    out = out.join(again, "qf_n", "left")
    fisher = [(F.col(cs[i]) * F.col(cs[j]) + F.col("qf_near") * F.coalesce(F.col("qf_sums")[k], zero)) / F.col("qf_total") for k, (i, j) in enumerate(pairs)]
    return out.select(by, id_col, F.col("qf_h").alias("h"), "log_density", "gradient", "hessian", F.array(*cs).alias("score"), F.array(*fisher).alias("fisher"))


def _kernel_sums(rows: DataFrame, by: str, xs: list[str], more: list[str], features, finish, size: int, together: int) -> DataFrame:
    """``qf_n``, ``qf_top`` and ``qf_sums``: each row's sums, over the other rows of its group, of kernel weights times 1 and the samples' ``features``, relative to the exponential of ``qf_top``."""
    groups = F.floor((F.col("qf_tiles") - 1) / together).cast("int")
    columns = [by, "qf_a", "qf_g", "qf_of", "qf_n", "qf_h", *xs, *more]
    points = rows.withColumn("qf_a", F.col("qf_tile")).withColumn("qf_g", F.explode(F.sequence(F.lit(0), groups))).withColumn("qf_of", F.lit(True))
    samples = rows.withColumn("qf_g", F.floor(F.col("qf_tile") / together).cast("int")).withColumn("qf_a", F.explode(F.sequence(F.lit(0), F.col("qf_tiles") - 1))).withColumn("qf_of", F.lit(False))

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        of = pdf["qf_of"].to_numpy(dtype=bool)
        n, h = pdf["qf_n"].to_numpy(), float(pdf["qf_h"].iloc[0])
        x = pdf[xs].to_numpy(dtype=float)
        # centred for accuracy
        x = (x - x.mean(axis=0)) / h
        a, b, own, other = x[of], x[~of], n[of], n[~of]
        feats = np.concatenate([np.ones((len(b), 1)), features(b, pdf[more].to_numpy(dtype=float)[~of])], axis=1)
        tops, sums = np.full(len(a), -np.inf), np.zeros((len(a), feats.shape[1]))
        half = 0.5 * (b * b).sum(axis=1)
        for p in range(0, len(a), 256):
            at = a[p : p + 256]
            for k in range(0, len(b), 4096):
                q = at @ b[k : k + 4096].T - half[k : k + 4096] - 0.5 * (at * at).sum(axis=1)[:, None]
                q[own[p : p + 256, None] == other[None, k : k + 4096]] = -np.inf
                new = np.maximum(tops[p : p + 256], q.max(axis=1))
                there = np.isfinite(new)
                base = np.where(there, new, 0.0)
                sums[p : p + 256] = sums[p : p + 256] * np.exp(tops[p : p + 256] - base)[:, None] + np.exp(q - base[:, None]) @ feats[k : k + 4096]
                tops[p : p + 256] = new
        got = np.isfinite(tops)
        return pd.DataFrame({"qf_n": own[got], "qf_part_top": tops[got], "qf_part": pd.Series(list(finish(a[got], sums[got])), dtype=object)})

    found = points.select(*columns).unionByName(samples.select(*columns)).groupBy(by, "qf_a", "qf_g").applyInPandas(partial, "qf_n long, qf_part_top double, qf_part array<double>")
    found = found.groupBy("qf_n").agg(F.max("qf_part_top").alias("qf_top"), F.collect_list(F.struct("qf_part_top", "qf_part")).alias("qf_parts"))

    def raised(k: int) -> Column:
        return F.aggregate("qf_parts", F.lit(0.0), lambda s, v: s + v["qf_part"][k] * F.exp(v["qf_part_top"] - F.col("qf_top")))

    return found.select("qf_n", "qf_top", F.array(*map(raised, range(size))).alias("qf_sums"))


def sphere_curvature(df: DataFrame, columns: list[str], id_col: str, radius: float) -> DataFrame:
    """Curvature of a sphere's metric at every row's stereographic coordinates: scalar, first entries of metric, connection and Einstein tensor. A row without a coordinate gives nulls."""
    kind = dict(df.dtypes)[id_col]

    def run(pdfs):
        for pdf in pdfs:
            x = pdf[columns].to_numpy(dtype=float)
            ok = np.isfinite(x).all(axis=1)
            c = cv.curvature(cv.sphere(radius), np.where(ok[:, None], x, 0.0))
            values = {"R": c.scalar, "g_11": c.g[:, 0, 0], "gamma_1_11": c.gamma[:, 0, 0, 0], "einstein_11": c.einstein[:, 0, 0]}
            yield pd.DataFrame({id_col: pdf[id_col]} | {k: np.where(ok, v, np.nan) for k, v in values.items()})

    out = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(run, f"{id_col} {kind}, R double, g_11 double, gamma_1_11 double, einstein_11 double")
    return out.select(id_col, *[finite(c).alias(c) for c in ("R", "g_11", "gamma_1_11", "einstein_11")])


def stress_at(df: DataFrame, grad_phi: list[str], grad_lam: list[str], lam: str, id_col: str) -> DataFrame:
    """The information stress tensor (upper triangle) and its norm under the flat metric, by the kernel that scans use. A row without a value gives nulls."""
    d, kind = len(grad_phi), dict(df.dtypes)[id_col]
    names = [f"t_{a + 1}{b + 1}" for a in range(d) for b in range(a, d)]
    i, j = np.triu_indices(d)

    def run(pdfs):
        for pdf in pdfs:
            x = pdf[[*grad_phi, *grad_lam, lam]].to_numpy(dtype=float)
            ok = np.isfinite(x).all(axis=1)
            flat = np.broadcast_to(np.eye(d), (len(x), d, d))
            t = cv.stress(x[:, :d], x[:, -1], x[:, d : 2 * d], flat, flat)
            values = dict(zip(names, t[:, i, j].T, strict=True)) | {"norm": cv.tensor_norm(t, flat)}
            yield pd.DataFrame({id_col: pdf[id_col]} | {k: np.where(ok, v, np.nan) for k, v in values.items()})

    out = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in [*grad_phi, *grad_lam, lam]]).mapInPandas(run, f"{id_col} {kind}, " + ", ".join(f"{n} double" for n in [*names, "norm"]))
    return out.select(id_col, *[finite(n).alias(n) for n in [*names, "norm"]])


def summary(scan: DataFrame) -> DataFrame:
    """Per symbol of a causal scan: bars, shares of negative directions and of their changes, medians and mean of dF, its autocorrelation, and its rank correlation with the distance from the centre.

    Bars without a value are left out of its statistic; a symbol with none has a null.
    """
    df = delta_f(scan)
    before = F.lag("H_neg").over(by_time())
    at = df.withColumn("_turn", F.when(before.isNotNull() & F.col("H_neg").isNotNull(), (F.col("H_neg") != before).cast("double")))
    at = at.withColumn("_d0", F.lag("dF").over(by_time()))
    out = at.groupBy(KEY).agg(F.count(F.lit(1)).alias("bars"), F.avg((F.col("H_neg") > 0).cast("double")).alias("indefinite"), F.avg("_turn").alias("turns"), F.median("H_R").alias("median_H_R"), F.median("F_R").alias("median_F_R"), F.avg("dF").alias("mean_dF"), F.median("dF").alias("median_dF"), F.corr("dF", "_d0").alias("autocorr_dF"))
    from quantflume.operators import stats

    return out.join(stats.spearman(df, "dF", "mahalanobis").select(KEY, F.col("rho").alias("rho_distance")), KEY, "left")


FIELD_2D = ["rho_field", "phi_field", "grad_phi_e", "grad_phi_j", "grad_phi_norm", "hess_phi_ee", "hess_phi_ej", "hess_phi_jj", "g_ee", "g_ej", "g_jj", "g_trace", "g_det", "g_det_safe", "g_inv_ee", "g_inv_ej", "g_inv_jj", "field_curvature", "dE_g_ee", "dJ_g_ee", "dE_g_ej", "dJ_g_ej", "dE_g_jj", "dJ_g_jj", "gamma_e_ee", "gamma_e_ej", "gamma_e_jj", "gamma_j_ee", "gamma_j_ej", "gamma_j_jj"]
FIELD_3D = ["field_curvature_scalar", "field_stress_tensor_norm", "field_einstein_norm", "field_gravity"]
TENSORS = [f"{t}_info_{i}{j}" for t in "GT" for i in range(3) for j in range(3)]


def grid_fields(df: DataFrame, x: str = "E", y: str = "jerk", m: str | None = "m_flux", lam: str = "lam", size: int = 200, shape: tuple[int, int, int] = (48, 48, 32)) -> DataFrame:
    """``df`` with the two- and three-dimensional grid fields at every bar. Looks ahead: grids are made from the whole series.

    A grid is one symbol's, so a symbol is one task; it holds three columns of
    the symbol's bars and the grids, and adds samples to them block by block.
    """
    need = [x, y, *([m, lam] if m else [])]
    rows = df.where(" and ".join(f"{c} is not null" for c in need)).select(KEY, TIME, *[F.col(c).cast("double").alias(c) for c in need])
    names = FIELD_2D + (FIELD_3D + TENSORS if m else [])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e, j = pdf[x].to_numpy(), pdf[y].to_numpy()
        axes, fields = gridfield.field_2d(e, j, size)
        points = np.column_stack([e, j])
        stacked = gridfield.interpolate(axes, np.stack([fields[n] for n in FIELD_2D], axis=-1), points)
        out = {n: stacked[:, k] for k, n in enumerate(FIELD_2D)}
        if m:
            points = np.column_stack([e, j, pdf[m].to_numpy()])
            axes, fields = gridfield.field_3d(points, pdf[lam].to_numpy(), shape)
            stacked = gridfield.interpolate(axes, np.stack([*[fields[n] for n in FIELD_3D], *[fields[f"{t}_info"][..., a, b] for t in "GT" for a in range(3) for b in range(3)]], axis=-1), points)
            out |= {n: stacked[:, k] for k, n in enumerate(FIELD_3D + TENSORS)}
        return pd.DataFrame({KEY: pdf[KEY], TIME: pdf[TIME]} | out)

    kinds = dict(df.dtypes)
    made = rows.groupBy(KEY).applyInPandas(run, f"{KEY} {kinds[KEY]}, {TIME} {kinds[TIME]}, " + ", ".join(f"{n} double" for n in names))
    return df.join(made.select(KEY, TIME, *[finite(n).alias(n) for n in names]), [KEY, TIME], "inner")

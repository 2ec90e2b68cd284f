"""The causal scan's density, metrics and stress tensor held to SQL that starts from the bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantflume.functions import scalar
from quantflume.plans.layer_queries import curvature_scan
from quantflume.plans.oracle import DAILY, W, ema_sql, frame, r
from quantflume.plans.series_queries import _V, KEYS, rd

#: Columns of the result and their digits.
DIGITS = {"phi": 5, "grad_phi_norm": 5, "mahalanobis": 5, "max_abs_z": 5, "lam_field": 4, "H_det": 4, "H_T_log": 4, "H_T_lam_share": 4, "F_det_log": 4}


def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scan of the daily series finds before curvature: surprise and its gradient, distances, the rigidity field, both metrics' determinants, negative directions, and the stress tensor's norm."""
    out = curvature_scan(spark, sf_dir)
    out = out.withColumn("H_T_log", F.log(F.col("H_T_norm") + 1e-12)).withColumn("F_det_log", F.log(F.greatest("F_det", F.lit(1e-300))))
    return out.select(*KEYS, *[rd(c, c, n) for c, n in DIGITS.items()], F.col("H_neg").cast("int").alias("H_neg"))


QUERIES = {"scan_metrics": scan_metrics}

WINDOW, REFIT, AXES = 500, 60, (1, 2, 3)
_UPPER = [(i, j) for i in AXES for j in AXES if i <= j]
_H = f"pow({WINDOW}, -1.0 / 7)"


def _listed(form: str, over=AXES) -> str:
    return ", ".join(form.format(k) for k in over)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r})"
    return f"{out}::DOUBLE"


def _quantile(p: str) -> str:
    """The normal quantile of p as SQL, by the same published coefficients."""
    q, tail = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    near, a, b = f"(0.180625 - {q} * {q})", f"({tail} - 1.6)", f"({tail} - 5.0)"
    ratio = lambda x, up, down: f"{_horner(x, up)} / {_horner(x, down)}"
    return f"CASE WHEN abs{q} <= 0.425 THEN {q} * {ratio(near, scalar._A, scalar._B)} ELSE sign{q} * CASE WHEN {tail} <= 5 THEN {ratio(a, scalar._C, scalar._D)} ELSE {ratio(b, scalar._E, scalar._F)} END END"


def _name(x: str, i: int, j: int) -> str:
    return f"{x}{min(i, j)}{max(i, j)}"


def _det(x: str) -> str:
    at = lambda i, j: _name(x, i, j)
    return f"({at(1, 1)} * ({at(2, 2)} * {at(3, 3)} - {at(2, 3)} * {at(2, 3)}) - {at(1, 2)} * ({at(1, 2)} * {at(3, 3)} - {at(2, 3)} * {at(1, 3)}) + {at(1, 3)} * ({at(1, 2)} * {at(2, 3)} - {at(2, 2)} * {at(1, 3)}))"


def _inverse(x: str, out: str) -> str:
    """The six entries of a symmetric matrix' inverse from its cofactors."""
    parts = []
    for i, j in _UPPER:
        (a, b), (c, d) = [k for k in AXES if k != i], [k for k in AXES if k != j]
        minor = f"({_name(x, a, c)} * {_name(x, b, d)} - {_name(x, a, d)} * {_name(x, b, c)})"
        parts.append(f"{(-1) ** (i + j)} * {minor} / {_det(x)} AS {_name(out, i, j)}")
    return ", ".join(parts)


def _form(v: str, m: str) -> str:
    """v M v as SQL."""
    return "(" + " + ".join(f"{v}{i} * {_name(m, i, j)} * {v}{j}" for i in AXES for j in AXES) + ")"


_whole = lambda t: " AND ".join(f"{t}.z{k} IS NOT NULL" for k in AXES)
_apart = lambda a, b: _listed(f"({a}.z{{0}} - {b}.z{{0}}) / {_H} AS u{{0}}")
_weight = lambda a, b: f"exp(-({' + '.join(f'pow(({a}.z{k} - {b}.z{k}) / {_H}, 2)' for k in AXES)}) / 2)"
_product = lambda i, j: "(" + " + ".join(f"{_name('i', i, k)} * {_name('t', k, j)}" for k in AXES) + ")"
_trace2 = " + ".join(f"{_product(i, j)} * {_product(j, i)}" for i in AXES for j in AXES)

_COORDINATES = f"""{DAILY}, v AS (SELECT symbol, bar_ms, {_V} AS v FROM daily), a AS (SELECT *, v - lag(v) OVER {W} AS a FROM v),
j AS (SELECT symbol, bar_ms, v * v + a * a AS e, a - lag(a) OVER {W} AS jerk, CASE WHEN count(v) OVER {frame(-29, 0)} >= 10 THEN 1 / (stddev_samp(v) OVER {frame(-29, 0)} + 1e-6) END AS lam FROM a),
{ema_sql("j", "e", "m")}, f AS (SELECT symbol, bar_ms, ema - lag(ema) OVER {W} AS flux FROM m),
x AS (SELECT j.symbol, j.bar_ms, e AS x1, jerk AS x2, flux AS x3, coalesce(lam, 0) AS lam, row_number() OVER {W.replace("symbol", "j.symbol").replace("bar_ms", "j.bar_ms")} - 1 AS n FROM j LEFT JOIN f USING (symbol, bar_ms)),
k AS (SELECT a.symbol, a.n, {_listed("count(p.x{0}) AS c{0}, (count(*) FILTER (p.x{0} < a.x{0}) + 0.5 * count(*) FILTER (p.x{0} = a.x{0}) + 0.5) / (count(p.x{0}) + 1.0) AS p{0}")}
  FROM x a JOIN x p ON a.symbol = p.symbol AND p.n BETWEEN a.n - {WINDOW} AND a.n - 1 GROUP BY 1, 2),
c AS (SELECT symbol, bar_ms, n, lam, {", ".join(f"CASE WHEN c{k} >= {WINDOW // 3} AND x{k} IS NOT NULL THEN {_quantile(f'p{k}')} END AS z{k}" for k in AXES)} FROM x LEFT JOIN k USING (symbol, n))"""

_SCAN = f"""{_COORDINATES},
own AS (SELECT *, {WINDOW} + ((n - {WINDOW}) // {REFIT}) * {REFIT} AS t0 FROM c WHERE n >= {WINDOW} AND {_whole("c")}),
past AS (SELECT b.t0, p.* FROM (SELECT DISTINCT symbol, t0 FROM own) b JOIN c p ON p.symbol = b.symbol AND p.n >= b.t0 - {WINDOW} AND p.n < b.t0 WHERE {_whole("p")}),
cv AS (SELECT symbol, t0, {_listed("avg(z{0}) AS a{0}")}, {", ".join(f"covar_samp(z{i}, z{j}) AS v{i}{j}" for i, j in _UPPER)} FROM past GROUP BY 1, 2 HAVING count(*) >= {WINDOW // 2}),
ci AS (SELECT symbol, t0, {_listed("a{0}")}, {_inverse("v", "w")} FROM cv),
lp AS (SELECT a.symbol, a.t0, a.n, {_weight("a", "b")} AS w, {_apart("a", "b")} FROM past a JOIN past b ON a.symbol = b.symbol AND a.t0 = b.t0 AND a.n <> b.n),
s AS (SELECT symbol, t0, n, {_listed(f"sum(w * u{{0}}) / sum(w) / {_H} AS s{{0}}")} FROM lp GROUP BY 1, 2, 3),
pairs AS (SELECT o.symbol, o.bar_ms, o.t0, p.lam, s.s1, s.s2, s.s3, {_weight("o", "p")} AS w, {_apart("o", "p")} FROM own o JOIN past p USING (symbol, t0) JOIN s ON s.symbol = p.symbol AND s.t0 = p.t0 AND s.n = p.n),
d AS (SELECT symbol, bar_ms, t0, count(*) AS size, sum(w) AS sw, sum(w * lam) / sum(w) AS lam, {_listed("sum(w * u{0}) / sum(w) AS m{0}")}, {_listed("sum(w * lam * u{0}) / sum(w) AS l{0}")},
  {", ".join(f"sum(w * u{i} * u{j}) / sum(w) AS q{i}{j}, sum(w * s{i} * s{j}) / sum(w) AS f{i}{j}" for i, j in _UPPER)} FROM pairs GROUP BY 1, 2, 3),
g AS (SELECT *, {_listed(f"m{{0}} / {_H} AS p{{0}}")}, {_listed(f"(lam * m{{0}} - l{{0}}) / {_H} AS r{{0}}")}, {", ".join(f"({int(i == j)} - (q{i}{j} - m{i} * m{j})) / ({_H} * {_H}) AS g{i}{j}" for i, j in _UPPER)} FROM d),
gi AS (SELECT *, {_inverse("g", "i")} FROM g),
gt AS (SELECT *, {_form("p", "i")} + 0.75 * {_form("r", "i")} AS tr FROM gi),
t AS (SELECT *, {", ".join(f"p{i} * p{j} + 0.75 * r{i} * r{j} + (0.25 * lam - 0.5 * tr) * g{i}{j} AS t{i}{j}" for i, j in _UPPER)} FROM gt),
e AS (SELECT *, sqrt(abs({_trace2})) AS tn, g11 + g22 + g33 AS k1, g11 * g22 - g12 * g12 + g11 * g33 - g13 * g13 + g22 * g33 - g23 * g23 AS k2, {_det("g")} AS k3 FROM t)"""

_MAHALANOBIS = "sqrt(" + " + ".join(f"(z{i} - a{i}) * {_name('w', i, j)} * (z{j} - a{j})" for i in AXES for j in AXES) + ")"
_VALUES = {
    "phi": f"1.5 * ln(2 * pi() * {_H} * {_H}) - ln(sw / size)",
    "grad_phi_norm": "sqrt(p1 * p1 + p2 * p2 + p3 * p3)",
    "mahalanobis": _MAHALANOBIS,
    "max_abs_z": "greatest(abs(z1), abs(z2), abs(z3))",
    "lam_field": "e.lam",
    "H_det": "k3",
    "H_T_log": "ln(tn + 1e-12)",
    "H_T_lam_share": "0.25 * abs(e.lam) * sqrt(3) / tn",
    "F_det_log": f"ln(greatest({_det('f')}, 1e-300))",
}

# negative eigenvalues are the sign changes of the characteristic polynomial's coefficients
ORACLES = {"scan_metrics": f"WITH {_SCAN} SELECT e.symbol, e.bar_ms, " + ", ".join(f"{r(_VALUES[c], n)} AS {c}" for c, n in DIGITS.items()) + ", ((k1 < 0)::INTEGER + (k1 * k2 < 0)::INTEGER + (k2 * k3 < 0)::INTEGER) AS H_neg FROM e JOIN own USING (symbol, bar_ms) JOIN ci ON ci.symbol = e.symbol AND ci.t0 = e.t0"}

"""Reference SQL (DuckDB) of draws under a flat prior, and of what is computed from them.

Written in terms of each population's slopes and cells, where the posterior falls apart into independent
pieces: a slope from within-cell sums of squares, a cell's value from its mean. The model code
solves one system of cross products instead. Random numbers are MD5 digests of (seed, draw, place) on both sides.
"""

from __future__ import annotations

SEED, N_DRAWS, POINTS, ATTEMPT = 123, 8_000, 1_000, 1_000
TAIL, THETAS = 269, 46  # of 8,000 draws: the smoothed tail, and the candidates of its fit


def uniform(draw: str, place: str, which: int) -> str:
    h = f"md5('{SEED}:' || {draw} || ':' || ({place}))[{1 + 13 * which}:{13 + 13 * which}]"
    return f"((CAST('0x' || {h} AS BIGINT) + 0.5) / 4503599627370496.0)"


def normal(draw: str, i: str, first: str = "1") -> str:
    """The i-th standard normal number of a draw."""
    place = f"CAST({first} + ({i}) // 2 AS BIGINT)"
    radius, angle = f"sqrt(-2 * ln({uniform(draw, place, 0)}))", f"2 * pi() * {uniform(draw, place, 1)}"
    return f"{radius} * CASE WHEN ({i}) % 2 = 0 THEN cos({angle}) ELSE sin({angle}) END"


def model(name: str, source: str, y: str, xs: tuple[str, ...], prior: bool = False) -> str:
    """CTEs: ``{name}_theta`` has b (slopes) and a (cell value) of every draw, population and year, and sigma.

    ``prior``: the default prior, a Student-t on the mean of the fitted values and a half Student-t on sigma.
    """
    k, n = len(xs), name
    given = " AND ".join(f"{c} IS NOT NULL" for c in (y, *xs))
    x = ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(xs, 1))
    means = "".join(f", avg(x{i}) AS m{i}" for i in range(1, k + 1))
    dev = "".join(f", x{i} - m{i} AS d{i}" for i in range(1, k + 1))
    squares = ", ".join(f"sum(d{i} * d{j}) AS w{i}{j}" for i in range(1, k + 1) for j in range(i, k + 1))
    cross = ", ".join(f"sum(d{i} * dy) AS s{i}" for i in range(1, k + 1))
    if k == 0:
        slopes = "SELECT DISTINCT Population FROM {n}_dev"
        fitted, draw_b, at_mean = "0", "", "0"
    elif k == 1:
        slopes = f"SELECT *, s1 / w11 AS e1 FROM (SELECT Population, {squares}, {cross} FROM {{n}}_dev GROUP BY 1)"
        fitted = "e1 * d1"
        draw_b = ", e1 + sigma * z0 / sqrt(w11) AS b1"
        at_mean = "b1 * m1"
    else:
        slopes = f"""SELECT *, w22 / det AS v11, -w12 / det AS v12, (w22 * s1 - w12 * s2) / det AS e1, (w11 * s2 - w12 * s1) / det AS e2
  FROM (SELECT *, w11 * w22 - w12 * w12 AS det FROM (SELECT Population, {squares}, {cross} FROM {{n}}_dev GROUP BY 1))"""
        fitted = "e1 * d1 + e2 * d2"
        draw_b = ", e1 + sigma * sqrt(v11) * z0 AS b1, e2 + sigma * (v12 / sqrt(v11) * z0 + z1 / sqrt(w22)) AS b2"
        at_mean = "b1 * m1 + b2 * m2"
    slopes = slopes.replace("{n}", n)
    q = k + 2
    z = "".join(f", {normal('draw', f'place * {q} + {i}', '1 + attempt * ' + str(ATTEMPT))} AS z{i}" for i in range(k))
    attempts = 6 if prior else 1  # one in a thousand is not kept
    half = " + ls - 2 * ln(1 + exp(2 * ls) / (3 * scale * scale))" if prior else ""
    scale = f" CROSS JOIN {n}_prior" if prior else ""
    parts = []
    if prior:
        parts.append(f"""
{n}_prior AS (
  SELECT round(median, 1) AS location, greatest(2.5, round(1.4826 * median(abs({y} - median)), 1)) AS scale
  FROM {source}, (SELECT median({y}) AS median FROM {source}) GROUP BY median)""")
    parts.append(f"""
{n}_rows AS (SELECT *, CAST({y} AS DOUBLE) AS y{', ' + x if x else ''} FROM {source} WHERE {given}),
{n}_cells AS (SELECT Population, "Year", count(*) AS n, avg(y) AS my{means} FROM {n}_rows GROUP BY 1, 2),
{n}_dev AS (SELECT Population, y - my AS dy{dev} FROM {n}_rows JOIN {n}_cells USING (Population, "Year")),
{n}_slopes AS ({slopes}),
{n}_s2 AS (
  SELECT count(*) AS n, count(*) - (SELECT count(*) FROM {n}_cells) - {k} * (SELECT count(*) FROM {n}_slopes) AS dof,
         sum(pow(dy - ({fitted}), 2)) AS rss
  FROM {n}_dev JOIN {n}_slopes USING (Population)),
{n}_coarse AS (
  SELECT i, ls, -dof * ls - rss / 2 * exp(-2 * ls){half} AS lp
  FROM (SELECT i, dof, rss, 0.5 * ln(rss / dof) - 9 + 12.0 * i / {POINTS - 1} AS ls FROM {n}_s2, range({POINTS}) t(i)){scale}),
{n}_bulk AS (
  SELECT greatest(min(i) - 1, 0) AS lo, least(max(i) + 1, {POINTS - 1}) AS hi FROM {n}_coarse WHERE lp > (SELECT max(lp) FROM {n}_coarse) - 40),
{n}_ends AS (SELECT a.ls AS lo, b.ls AS hi FROM {n}_bulk JOIN {n}_coarse a ON a.i = lo JOIN {n}_coarse b ON b.i = hi),
{n}_fine AS (
  SELECT i, ls, -dof * ls - rss / 2 * exp(-2 * ls){half} AS lp
  FROM (SELECT i, dof, rss, lo + (hi - lo) * i / {POINTS - 1} AS ls FROM {n}_s2, {n}_ends, range({POINTS}) t(i)){scale}),
{n}_weights AS (SELECT i, ls, exp(lp - max(lp) OVER ()) AS w FROM {n}_fine),
{n}_steps AS (SELECT i, ls, coalesce((w + lag(w) OVER (ORDER BY i)) / 2, 0) AS step FROM {n}_weights),
{n}_cdf AS MATERIALIZED (
  SELECT ls, c, lead(ls) OVER (ORDER BY i) AS ls2, lead(c) OVER (ORDER BY i) AS c2
  FROM (SELECT i, ls, sum(step) OVER (ORDER BY i) / (SELECT sum(step) FROM {n}_steps) AS c FROM {n}_steps)),
{n}_tries AS (
  SELECT draw, attempt, u, {uniform('draw', f'attempt * {ATTEMPT}', 1)} AS u2
  FROM (SELECT draw, attempt, {uniform('draw', f'attempt * {ATTEMPT}', 0)} AS u FROM range(1, {N_DRAWS + 1}) t(draw), range({attempts}) s(attempt))),
{n}_sigma AS (
  SELECT draw, attempt, u2, exp(ls + (ls2 - ls) * (u - c) / (c2 - c)) AS sigma FROM {n}_tries ASOF JOIN (SELECT * FROM {n}_cdf WHERE c2 > c) ON u >= c),
{n}_place AS (SELECT Population, row_number() OVER (ORDER BY Population) - 1 AS place FROM (SELECT DISTINCT Population FROM {n}_cells)),
{n}_b AS (
  SELECT Population, place, draw, attempt, u2, sigma{draw_b}
  FROM (SELECT *{z} FROM {n}_sigma, {n}_place JOIN {n}_slopes USING (Population))),
{n}_year AS (SELECT "Year", row_number() OVER (ORDER BY "Year") - 1 AS yi FROM (SELECT DISTINCT "Year" FROM {n}_cells)),
{n}_all AS (
  SELECT b.*, "Year", n, my - ({at_mean}) + sigma * ({normal('draw', f'(place * {q} + {k} + yi)', '1 + attempt * ' + str(ATTEMPT))}) / sqrt(n) AS a
  FROM {n}_b b JOIN {n}_cells USING (Population) JOIN {n}_year USING ("Year"))""")
    if prior:
        parts.append(f"""
{n}_kept AS (
  SELECT draw, min(attempt) AS attempt
  FROM (SELECT draw, attempt, u2, sum(n * a) / sum(n) AS mean FROM {n}_all GROUP BY 1, 2, 3), {n}_prior
  WHERE u2 <= pow(1 + pow((mean - location) / scale, 2) / 3, -2) GROUP BY 1),
{n}_theta AS MATERIALIZED (SELECT * FROM {n}_all JOIN {n}_kept USING (draw, attempt))""")
    else:
        parts.append(f"""
{n}_theta AS MATERIALIZED (SELECT * FROM {n}_all)""")
    return ",".join(parts)


def terms(n: str, xs: tuple[str, ...], pops: tuple[str, ...], years: tuple[int, ...]) -> str:
    """``{n}_terms``: idx, term, draw, value in treatment coding, sigma last."""
    names = ["Intercept", *(f"Population{p}" for p in pops[1:]), *(f"Year{y}" for y in years[1:]), *xs]
    names += [f"Population{p}:Year{y}" for y in years[1:] for p in pops[1:]] + [f"Population{p}:{x}" for x in xs for p in pops[1:]]
    at = {t: i for i, t in enumerate(names)}
    cell = lambda p, y: f"max(a) FILTER (Population = '{p}' AND \"Year\" = {y})"
    slope = lambda p, i: f"max(b{i}) FILTER (Population = '{p}')"
    ref, y0 = pops[0], years[0]
    value = {"Intercept": cell(ref, y0)}
    value |= {f"Population{p}": f"{cell(p, y0)} - {cell(ref, y0)}" for p in pops[1:]}
    value |= {f"Year{y}": f"{cell(ref, y)} - {cell(ref, y0)}" for y in years[1:]}
    value |= {f"Population{p}:Year{y}": f"{cell(p, y)} - {cell(p, y0)} - {cell(ref, y)} + {cell(ref, y0)}" for y in years[1:] for p in pops[1:]}
    for i, x in enumerate(xs, 1):
        value[x] = slope(ref, i)
        value |= {f"Population{p}:{x}": f"{slope(p, i)} - {slope(ref, i)}" for p in pops[1:]}
    value["sigma"] = "max(sigma)"
    at["sigma"] = len(names)
    rows = ", ".join(f"{{'idx': {at[t]}, 'term': '{t}', 'value': {v}}}" for t, v in value.items())
    return f"""
{n}_terms AS (SELECT draw, e.idx AS idx, e.term AS term, e.value AS value FROM (SELECT draw, unnest([{rows}]) AS e FROM {n}_theta GROUP BY draw))"""


def leave_one_out(n: str, k: int) -> str:
    """``{n}_loo``: elpd, lpd and tail shape of every row, by Pareto-smoothed importance sampling."""
    mean = "a" + "".join(f" + b{i} * x{i}" for i in range(1, k + 1))
    avg_log = lambda theta: f"list_sum(list_transform(x, lambda v: ln(1 - ({theta}) * v))) / {TAIL}"
    return f"""
{n}_lik AS (
  SELECT id, list_sort(list(0.5 * pow((y - ({mean})) / sigma, 2) + ln(sigma) + 0.5 * ln(2 * pi())), 'DESC') AS l
  FROM (SELECT *, row_number() OVER () AS id FROM {n}_rows) JOIN {n}_theta USING (Population, "Year") GROUP BY id),
{n}_tail AS (
  SELECT id, l[1] AS top, len(l) AS s, list_sum(list_transform(l, lambda v: exp(v - l[1]))) AS total,
         ln(list_sum(list_transform(l, lambda v: exp(l[len(l)] - v)))) - l[len(l)] - ln(len(l)) AS lpd,
         list_transform(l[1:{TAIL}], lambda v: v - l[1]) AS raw, greatest(l[{TAIL + 1}] - l[1], ln(2.2250738585072014e-308)) AS cut
  FROM {n}_lik),
{n}_over AS (SELECT *, list_transform(raw, lambda v: exp(v) - exp(cut)) AS x FROM {n}_tail),
{n}_theta_of AS (
  SELECT *, list_transform(range(1, {THETAS + 1}), lambda j: 1 / x[1] + (1 - sqrt({THETAS} / (j - 0.5))) / (3 * x[{TAIL - (int(TAIL / 4 + 0.5) - 1)}])) AS th FROM {n}_over),
{n}_ll AS (SELECT *, list_transform(th, lambda t: {avg_log('t')}) AS ks FROM {n}_theta_of),
{n}_fit1 AS (SELECT *, list_transform(list_zip(th, ks), lambda p: {TAIL} * (ln(-p[1] / p[2]) - p[2] - 1)) AS ll FROM {n}_ll),
{n}_fit2 AS (SELECT *, list_transform(ll, lambda v: exp(v - list_max(ll))) AS w FROM {n}_fit1),
{n}_fit3 AS (SELECT *, list_sum(list_transform(list_zip(th, w), lambda p: p[1] * p[2])) / list_sum(w) AS best FROM {n}_fit2),
{n}_fit4 AS (SELECT *, {avg_log('best')} AS shape0 FROM {n}_fit3),
{n}_fit5 AS (SELECT *, (shape0 * {TAIL} + 5) / ({TAIL} + 10) AS shape, -shape0 / best AS scale FROM {n}_fit4),
{n}_smooth AS (
  SELECT *, list_transform(range(1, {TAIL + 1}), lambda i: least(ln(scale * (exp(-shape * ln(1 - ({TAIL} - i + 0.5) / {TAIL})) - 1) / shape + exp(cut)), 0)) AS sm
  FROM {n}_fit5),
{n}_loo AS MATERIALIZED (
  SELECT id, lpd, shape AS pareto_k,
         ln(s - {TAIL} + list_sum(list_transform(list_zip(sm, raw), lambda p: exp(p[1] - p[2])))) - top
           - ln(total - list_sum(list_transform(raw, lambda v: exp(v))) + list_sum(list_transform(sm, lambda v: exp(v)))) AS elpd
  FROM {n}_smooth)"""


def scores(n: str) -> str:
    return f"""sum(elpd) AS elpd_loo, sqrt(count(*) * var_samp(elpd)) AS se_elpd_loo, sum(lpd - elpd) AS p_loo,
  sqrt(count(*) * var_samp(lpd - elpd)) AS se_p_loo, -2 * sum(elpd) AS looic, 2 * sqrt(count(*) * var_samp(elpd)) AS se_looic,
  count(*) FILTER (pareto_k > 0.7) AS n_high_k FROM {n}_loo"""

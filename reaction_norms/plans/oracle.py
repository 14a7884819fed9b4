"""Reference SQL (DuckDB) for the registered queries.

Written independently of the DataFrame plans: plasticity comes from the explicit
replicate-pair join, global statistics from unpartitioned windows, and fitted slopes
from Sxy / Sxx.
"""

from __future__ import annotations

from itertools import combinations

from reaction_norms.plans import posterior_sql as D

POPS = ("N1", "N2", "C1", "C2", "S1", "S2")
SORTED_POPS = tuple(sorted(POPS))
YEARS = (2010, 2017)

PLANTS = """
plants AS (
  SELECT CASE l_returnflag WHEN 'N' THEN 'north' WHEN 'R' THEN 'south' WHEN 'A' THEN 'center' END AS garden,
         CAST(l_partkey AS VARCHAR) AS Dam_ID,
         CASE p_type WHEN 'ECONOMY' THEN 'N1' WHEN 'LARGE' THEN 'N2' WHEN 'MEDIUM' THEN 'C1'
                     WHEN 'PROMO' THEN 'C2' WHEN 'SMALL' THEN 'S1' WHEN 'STANDARD' THEN 'S2' END AS Population,
         CAST(CASE WHEN p_size % 2 = 0 THEN 2010 ELSE 2017 END AS BIGINT) AS "Year",
         CASE WHEN l_linenumber <= 2 THEN l_quantity END AS doy,
         CASE WHEN l_linenumber IN (3, 4) AND l_returnflag <> 'A' THEN round(l_extendedprice * 100) END AS sla,
         CASE WHEN l_linenumber IN (4, 5) AND l_returnflag <> 'A' THEN round(l_discount * 100) END AS ldmc,
         CASE WHEN l_linenumber <> 7 THEN round(l_extendedprice * 100) END AS rs,
         l_orderkey, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CLIMATE = """
climate AS (
  SELECT n_name AS ID1, CAST(year(o_orderdate) AS BIGINT) AS "Year",
         CAST(n_nationkey AS DOUBLE) AS Latitude, CAST(n_regionkey AS DOUBLE) AS Longitude,
         avg(round(o_totalprice * 100)) AS PPT_wt, sum(round(o_totalprice * 100)) AS MAP,
         avg(round(c_acctbal * 100)) AS MAT
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, n_nationkey, n_regionkey, year(o_orderdate)),
focal AS (SELECT * FROM climate WHERE ID1 NOT IN ('NATION_6', 'NATION_7', 'NATION_8'))"""

DRAWS = PLANTS + """,
cells AS (
  SELECT l_orderkey % 200 AS draw, Population, "Year", avg(l_quantity) AS prediction
  FROM plants GROUP BY 1, 2, 3)"""

# The first cohort raised by an effect of its population.
SHIFTED = DRAWS.replace("avg(l_quantity) AS prediction", """avg(l_quantity) + CASE WHEN "Year" = 2010 THEN
           CASE Population WHEN 'N1' THEN 0 WHEN 'N2' THEN 4 WHEN 'C1' THEN 8 WHEN 'C2' THEN 10 WHEN 'S1' THEN 14 WHEN 'S2' THEN 30 END
         ELSE 0 END AS prediction""")

# Families collected twice: supplier x cohort.
TWO_COHORTS = PLANTS.replace("CAST(l_partkey AS VARCHAR) AS Dam_ID", "CAST(l_suppkey AS VARCHAR) AS Dam_ID").replace(
    """CASE p_type WHEN 'ECONOMY' THEN 'N1' WHEN 'LARGE' THEN 'N2' WHEN 'MEDIUM' THEN 'C1'
                     WHEN 'PROMO' THEN 'C2' WHEN 'SMALL' THEN 'S1' WHEN 'STANDARD' THEN 'S2' END""",
    "['C1', 'C2', 'N1', 'N2', 'S1', 'S2'][l_suppkey % 6 + 1]",
).replace("l_partkey = p_partkey)", "l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)")

TRAITS = {
    "doy": ("First flower date plasticity", [("north", "south"), ("north", "center"), ("south", "center")]),
    "sla": ("SLA plasticity", [("south", "north")]),
    "ldmc": ("LDMC plasticity", [("north", "south")]),
}
RAW = {"doy": "first_flower_doy", "sla": "sla_cm2_per_g", "ldmc": "ldmc"}


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def envs(t: str) -> list[str]:
    return list(dict.fromkeys(e for pair in TRAITS[t][1] for e in pair))


def gate(t: str) -> str:
    flags = ", ".join(
        f"max(CASE WHEN garden = '{e}' AND n >= 2 THEN 1 ELSE 0 END) AS N_{e}" for e in envs(t)
    )
    both = " AND ".join(f"N_{e} > 0" for e in envs(t))
    centre = "min(doy) OVER (PARTITION BY garden)" if t == "doy" else "0"
    reps = " AND ".join(f"count(*) FILTER (garden = '{e}') >= 2" for e in envs(t))
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in TRAITS[t][1])
    return f"""
counts_{t} AS (SELECT garden, Dam_ID, "Year", count(*) AS n FROM plants WHERE {t} IS NOT NULL GROUP BY 1, 2, 3),
flags_{t} AS (SELECT Dam_ID, "Year", {flags} FROM counts_{t} GROUP BY 1, 2),
gate_{t} AS (SELECT *, CASE WHEN {both} THEN 1 ELSE 0 END AS both_ FROM flags_{t}),
elig_{t} AS (SELECT DISTINCT Dam_ID FROM gate_{t} WHERE both_ = 1),
sub_{t} AS (SELECT Dam_ID, Population, "Year", garden, {t} AS raw, {t} - {centre} AS v
            FROM plants WHERE {t} IS NOT NULL AND Dam_ID IN (SELECT Dam_ID FROM elig_{t})),
gm_{t} AS (SELECT avg(v) AS g FROM sub_{t}),
valid_{t} AS (SELECT Dam_ID, Population, "Year" FROM sub_{t} GROUP BY 1, 2, 3 HAVING {reps}),
pairs_{t} AS (
  SELECT a.Dam_ID, a.Population || '-' || a."Year" AS pop_year, a.Population,
         CAST(a."Year" AS VARCHAR) AS "Year", a.garden AS garden_1, b.garden AS garden_2,
         a.v AS v1, b.v AS v2, a.v - b.v AS difference, (a.v - b.v) / g AS ratio
  FROM valid_{t} f
  JOIN sub_{t} a ON a.Dam_ID = f.Dam_ID AND a.Population = f.Population AND a."Year" = f."Year"
  JOIN sub_{t} b ON b.Dam_ID = f.Dam_ID AND b.Population = f.Population AND b."Year" = f."Year"
  CROSS JOIN gm_{t}
  WHERE (a.garden, b.garden) IN ({pairs})),
index_{t} AS (SELECT Dam_ID, pop_year, Population, "Year", avg(ratio) AS {t}_plasticity
              FROM pairs_{t} GROUP BY 1, 2, 3, 4)"""


def with_gate(*traits: str) -> str:
    return "WITH " + PLANTS + "," + ",".join(gate(t) for t in traits)


COLS = [f"{t}_pp" for t in TRAITS] + [f"{t}_pp2" for t in TRAITS]


def selection() -> str:
    squares = ", ".join(f"{t}_pp * {t}_pp AS {t}_pp2" for t in TRAITS)
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}_z" for c in COLS)
    return with_gate(*TRAITS) + f""",
traits AS (
  SELECT d.Dam_ID, d.pop_year, d.Population, d."Year", doy_plasticity AS doy_pp,
         sla_plasticity AS sla_pp, ldmc_plasticity AS ldmc_pp
  FROM index_doy d
  LEFT JOIN index_sla s ON d.Dam_ID IS NOT DISTINCT FROM s.Dam_ID
  LEFT JOIN index_ldmc l ON d.Dam_ID IS NOT DISTINCT FROM l.Dam_ID),
fitness AS (SELECT Dam_ID, Population, "Year", avg(rs) AS mean_rs FROM plants GROUP BY 1, 2, 3),
sel AS (
  SELECT t.doy_pp, t.sla_pp, t.ldmc_pp, {squares}, f.mean_rs, f.Population, f."Year", f.Dam_ID
  FROM fitness f LEFT JOIN traits t ON f.Dam_ID IS NOT DISTINCT FROM t.Dam_ID),
selz AS (SELECT *, {z}, mean_rs / avg(mean_rs) OVER () AS fitness_rel FROM sel)"""


def names(cells: bool) -> list[tuple[str, str, str]]:
    if not cells:
        return [(f"{a}_{b}", a, b) for a, b in combinations(POPS, 2)]
    out = [(f"{a}_{y}", f"{b}_{y}") for y in YEARS for a, b in combinations(POPS, 2)]
    out += [(f"{p}_2010", f"{p}_2017") for p in POPS]
    return [(f"{a}-{b}", a, b) for a, b in out]


def contrast_values(cells: bool) -> str:
    return ", ".join(f"('{n}', '{a}', '{b}')" for n, a, b in names(cells))


DIFFS = DRAWS + f""",
keyed AS (SELECT draw, Population || '_' || "Year" AS cell, prediction FROM cells),
pops AS (SELECT draw, Population, avg(prediction) AS m FROM cells GROUP BY 1, 2),
cohorts AS (SELECT draw, "Year", avg(prediction) AS m FROM cells GROUP BY 1, 2),
celldifs AS (
  SELECT d.draw, c.var, a.prediction - b.prediction AS dif,
         a.prediction IS NOT NULL OR b.prediction IS NOT NULL AS seen
  FROM (SELECT DISTINCT draw FROM cells) d
  CROSS JOIN (VALUES {contrast_values(True)}) c(var, l, r)
  LEFT JOIN keyed a ON a.draw = d.draw AND a.cell = c.l
  LEFT JOIN keyed b ON b.draw = d.draw AND b.cell = c.r),
popdifs AS (
  SELECT d.draw, c.difference, a.m - b.m AS pred_diff
  FROM (SELECT DISTINCT draw FROM cells) d
  CROSS JOIN (VALUES {contrast_values(False)}) c(difference, l, r)
  LEFT JOIN pops a ON a.draw = d.draw AND a.Population = c.l
  LEFT JOIN pops b ON b.draw = d.draw AND b.Population = c.r),
cohortdifs AS (
  SELECT a.draw, a.m - b.m AS diff_prediction FROM cohorts a JOIN cohorts b ON a.draw = b.draw
  WHERE a."Year" = 2010 AND b."Year" = 2017)"""


def pd(value: str, prefix: str = "") -> str:
    """The three probabilities; a missing difference makes them missing."""
    def whole(expr: str) -> str:
        return f"CASE WHEN count({value}) = count(*) THEN {expr} END"

    up = whole(f"avg(CAST({value} > 0 AS DOUBLE))")
    down = whole(f"avg(CAST({value} < 0 AS DOUBLE))")
    both = whole(f"greatest(avg(CAST({value} > 0 AS DOUBLE)), avg(CAST({value} < 0 AS DOUBLE)))")
    name = prefix or "probability"
    return (
        f"{r(up)} AS prob_greater_than_zero, {r(down)} AS prob_less_than_zero, {r(both)} AS {name}"
    )


# Coefficients solved from the draw table: cell values and cohort changes.
BOUND = DRAWS + """,
whole AS (SELECT draw FROM cells GROUP BY 1 HAVING count(*) = 12),
two AS (
  SELECT a.draw, a.Population, a.prediction AS c0, b.prediction AS c1, b.prediction - a.prediction AS slope
  FROM cells a JOIN cells b ON a.draw = b.draw AND a.Population = b.Population
  WHERE a."Year" = 2010 AND b."Year" = 2017 AND a.draw IN (SELECT draw FROM whole)),
trends AS (SELECT draw, Population, y AS "Year", slope AS value FROM two, (VALUES ('2010'), ('2017')) v(y)),
ref AS (SELECT draw, c0, slope FROM two WHERE Population = 'C1'),
slopepd AS (
  SELECT Population, "Year", avg(value) AS mean_slope, avg(CAST(value > 0 AS DOUBLE)) AS up,
         avg(CAST(value < 0 AS DOUBLE)) AS down FROM trends GROUP BY 1, 2)"""


def bound_terms() -> str:
    rows = [
        "SELECT 0 AS idx, 'Intercept' AS term, c0 AS v FROM ref",
        "SELECT 6, 'Year2017', slope FROM ref",
        "SELECT 7, 'doy_pp_z', slope FROM ref",
        "SELECT 18, 'sigma', c0 FROM ref",
    ]
    for i, p in enumerate(SORTED_POPS[1:]):
        src = f"FROM two t JOIN ref USING (draw) WHERE t.Population = '{p}'"
        rows.append(f"SELECT {1 + i}, 'Population{p}', t.c0 - ref.c0 {src}")
        rows.append(f"SELECT {8 + i}, 'Population{p}:Year2017', t.slope - ref.slope {src}")
        rows.append(f"SELECT {13 + i}, 'Population{p}:doy_pp_z', t.slope - ref.slope {src}")
    return " UNION ALL ".join(rows)


def effects() -> str:
    """Bound draws along the observed range of the standardised flowering index."""
    return (
        selection()
        + ","
        + BOUND.replace(PLANTS + ",", "", 1)
        + """,
ranges AS (SELECT Population, CAST("Year" AS VARCHAR) AS "Year", min(doy_pp_z) AS lo, max(doy_pp_z) AS hi
           FROM selz GROUP BY 1, 2 HAVING min(doy_pp_z) IS NOT NULL),
eff AS (
  SELECT t.draw, t.Population, g."Year", s.i, g.lo + s.i * (g.hi - g.lo) / 99.0 AS doy_pp_z,
         CASE WHEN g."Year" = '2010' THEN t.c0 ELSE t.c1 END
           + t.slope * (g.lo + s.i * (g.hi - g.lo) / 99.0) AS value
  FROM two t JOIN ranges g USING (Population) CROSS JOIN range(100) s(i))"""
    )


def box(source: str, value: str, by: str) -> str:
    keys = [k.strip() for k in by.split(",")]
    same = " AND ".join(f"b.{k} IS NOT DISTINCT FROM q.{k}" for k in keys)
    cols = ", ".join(f"q.{k}" for k in keys)
    inside = "b.v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return f"""
b AS (SELECT {by}, {value} AS v FROM {source}),
q AS (SELECT {by}, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM b WHERE v IS NOT NULL GROUP BY {by})
SELECT {cols}, {r(f'min(CASE WHEN {inside} THEN b.v END)')} AS whisker_low, {r('max(q1)')} AS q1,
       {r('max(median)')} AS median, {r('max(q3)')} AS q3,
       {r(f'max(CASE WHEN {inside} THEN b.v END)')} AS whisker_high,
       count(*) AS n, count(*) FILTER (NOT ({inside})) AS n_outliers
FROM b JOIN q ON {same} WHERE b.v IS NOT NULL GROUP BY {cols}"""


def density(source: str, value: str, by: str | None, n: int, joint: bool, pad: float) -> str:
    key = by or "1"
    bw = "o.bw" if joint else "s.bw"
    label = f"s.k AS {by}, " if by else ""
    return f"""
vals AS (SELECT {key} AS k, {value} AS v FROM {source} WHERE {value} IS NOT NULL),
s AS (SELECT k, count(*) AS n, min(v) AS lo, max(v) AS hi,
        0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34)
          * pow(count(*), -0.2) AS bw FROM vals GROUP BY k),
o AS (SELECT min(lo) - {pad} * avg(bw) AS lo, max(hi) + {pad} * avg(bw) AS hi, avg(bw) AS bw FROM s),
g AS (SELECT i, o.lo + i * ((o.hi - o.lo) / {float(n - 1)}) AS x FROM range({n}) t(i), o)
SELECT {label}g.i AS i, {r('max(g.x)')} AS x,
       {r(f'sum(exp(-0.5 * pow((g.x - v) / {bw}, 2)) / (s.n * {bw} * sqrt(2 * pi())))')} AS density
FROM vals JOIN s USING (k) CROSS JOIN g CROSS JOIN o GROUP BY s.k, g.i"""


def smooth(n: int = 80, span: float = 0.75) -> str:
    s = ", ".join(f"sum(w * pow(t, {k})) AS s{k}" for k in range(5))
    m = ", ".join(f"sum(w * y * pow(t, {k})) AS r{k}" for k in range(3))
    return f"""
WITH {CLIMATE},
pts AS (SELECT ID1, CAST("Year" AS DOUBLE) AS x, PPT_wt AS y FROM focal WHERE PPT_wt BETWEEN 0 AND 26000000),
sites AS (SELECT ID1, min(x) AS lo, max(x) AS hi, count(*) AS n FROM pts GROUP BY 1),
far AS (SELECT ID1, i, lo + i * ((hi - lo) / {n - 1}.0) AS x0, x, y, n,
               abs(x - (lo + i * ((hi - lo) / {n - 1}.0))) AS d
        FROM pts JOIN sites USING (ID1) CROSS JOIN range({n}) g(i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ID1, i ORDER BY d, x) AS rn FROM far),
wide AS (SELECT *, max(CASE WHEN rn = least(floor(n * {span} + 1e-5), n) THEN d END)
                     OVER (PARTITION BY ID1, i) AS h FROM ranked),
w AS (SELECT ID1, i, x0, y, CASE WHEN h = 0 THEN NULL ELSE (x - x0) / h END AS t,
             CASE WHEN h > 0 AND d / h < 1 THEN pow(1 - pow(d / h, 3), 3) ELSE 0 END AS w FROM wide),
f AS (SELECT ID1, i, max(x0) AS x0, {s}, {m} FROM w GROUP BY 1, 2),
c AS (SELECT *, s2 * s4 - s3 * s3 AS c0, s2 * s3 - s1 * s4 AS c1, s1 * s3 - s2 * s2 AS c2 FROM f)
SELECT ID1, CAST(i AS BIGINT) AS i, {r('x0', 2)} AS "Year",
       {r('CASE WHEN abs(s0 * c0 + s1 * c1 + s2 * c2) > 1e-12 THEN (r0 * c0 + r1 * c1 + r2 * c2) / (s0 * c0 + s1 * c1 + s2 * c2) END', 2)} AS smooth
FROM c"""


def posterior(out: dict[str, str]) -> None:
    """Queries on draws under the flat prior, and under the default prior of the plasticity models."""
    one = selection() + "," + D.model("m", "selz", "fitness_rel", ("doy_pp_z",))
    coded = one + "," + D.terms("m", ("doy_pp_z",), SORTED_POPS, YEARS)
    q = lambda v, p: r(f"quantile_cont({v}, {p})", 5)
    out["flat_draws"] = coded + f" SELECT draw, CAST(idx AS BIGINT) AS idx, term, {r('value', 5)} AS value FROM m_terms"
    out["flat_subsample"] = one + f"""
SELECT draw, {r('sigma', 5)} AS sigma FROM (SELECT DISTINCT draw, sigma FROM m_theta) ORDER BY md5('123:' || draw), draw LIMIT 1000"""
    out["flat_coefficients"] = coded + f"""
SELECT CAST(idx AS BIGINT) AS idx, term, {r('avg(value)', 5)} AS estimate, {r('stddev_samp(value)', 5)} AS est_error,
  {q('value', 0.025)} AS lower, {q('value', 0.975)} AS upper FROM m_terms GROUP BY 1, 2"""
    each = [D.model(f"m_{t}", "selz", "fitness_rel", (f"{t}_pp_z",)) for t in TRAITS]
    out["flat_slope_table"] = selection() + "," + ",".join(each) + " UNION ALL ".join(
        f"""
SELECT Population, {q('b1', 0.5)} AS linear_median, {q('b1', 0.025)} AS linear_lower, {q('b1', 0.975)} AS linear_upper, '{label}' AS trait
FROM (SELECT DISTINCT draw, Population, b1 FROM m_{t}_theta) GROUP BY 1"""
        for t, (label, _) in TRAITS.items()
    )
    out["flat_conditional"] = one + f""",
ranges AS (SELECT Population, "Year", min(doy_pp_z) AS lo, max(doy_pp_z) AS hi FROM selz GROUP BY 1, 2 HAVING min(doy_pp_z) IS NOT NULL),
sure AS (
  SELECT Population, "Year" FROM m_theta GROUP BY 1, 2
  HAVING greatest(avg(CAST(b1 > 0 AS DOUBLE)), avg(CAST(b1 < 0 AS DOUBLE))) >= 0.95),
eff AS (
  SELECT Population, "Year", s.i, lo + s.i * (hi - lo) / 99.0 AS x, a + b1 * (lo + s.i * (hi - lo) / 99.0) AS value
  FROM m_theta JOIN sure USING (Population, "Year") JOIN ranges USING (Population, "Year") CROSS JOIN range(100) s(i))
SELECT Population, CAST("Year" AS VARCHAR) AS "Year", i, {r('max(x)', 5)} AS doy_pp_z, {q('value', 0.25)} AS lower, {q('value', 0.5)} AS median,
  {q('value', 0.75)} AS upper FROM eff GROUP BY 1, 2, 3"""
    out["flat_fitted"] = one + f"""
SELECT Dam_ID, Population, "Year", {r('avg(v)', 5)} AS estimate, {r('stddev_samp(v)', 5)} AS est_error, {q('v', 0.025)} AS lower, {q('v', 0.975)} AS upper
FROM (SELECT id, Dam_ID, Population, "Year", a + b1 * x1 AS v FROM (SELECT *, row_number() OVER () AS id FROM m_rows) JOIN m_theta USING (Population, "Year"))
GROUP BY id, 1, 2, 3"""
    forms = {"linear": ("pp_z",), "quadratic": ("pp_z", "pp2_z")}
    def loo(traits):
        parts = [selection()]
        for t in traits:
            for form, xs in forms.items():
                parts += [D.model(f"{t}_{form}", "selz", "fitness_rel", tuple(f"{t}_{x}" for x in xs)), D.leave_one_out(f"{t}_{form}", len(xs))]
        return ",".join(parts)

    fields = ("elpd_loo", "se_elpd_loo", "p_loo", "se_p_loo", "looic", "se_looic")
    rounded = ", ".join(f"{r(c, 5)} AS {c}" for c in fields) + ", n_high_k"
    both = " UNION ALL ".join(f"SELECT 'doy_{f}' AS model, {D.scores(f'doy_{f}')}" for f in forms)
    out["flat_loo_scores"] = loo(["doy"]) + f" SELECT model, {rounded} FROM ({both})"
    compared = []
    for t, (label, _) in TRAITS.items():
        a, b = (f"{t}_{f}" for f in forms)
        compared.append(f"""
SELECT *, CASE WHEN elpd_loo = best THEN 0 ELSE elpd_loo - best END AS elpd_diff,
  CASE WHEN elpd_loo = best THEN 0 ELSE se END AS se_diff, '{label}' AS trait
FROM (SELECT *, max(elpd_loo) OVER () AS best, (SELECT sqrt(count(*) * var_samp({a}_loo.elpd - {b}_loo.elpd)) FROM {a}_loo JOIN {b}_loo USING (id)) AS se
      FROM (SELECT '{a}' AS model, {D.scores(a)} UNION ALL SELECT '{b}', {D.scores(b)}))""")
    out["flat_loo_compare"] = loo(TRAITS) + f" SELECT model, {rounded}, {r('elpd_diff', 5)} AS elpd_diff, {r('se_diff', 5)} AS se_diff, trait FROM ({' UNION ALL '.join(compared)})"

    priors = [D.model(f"p_{t}", f"index_{t}", f"{t}_plasticity", (), prior=True) for t in TRAITS]
    kept = lambda t: f"(SELECT draw FROM (SELECT DISTINCT draw FROM p_{t}_theta) ORDER BY md5('123:' || draw), draw LIMIT 1000)"
    out["default_priors"] = with_gate(*TRAITS) + "," + ",".join(priors) + " UNION ALL ".join(
        f" SELECT '{t}' AS trait, CAST(location AS DOUBLE) AS location, CAST(scale AS DOUBLE) AS scale, CAST(3 AS DOUBLE) AS dof FROM p_{t}_prior" for t in TRAITS
    )
    for t, own in zip(TRAITS, priors):
        out[f"posterior_cells_{t}"] = with_gate(t) + "," + own + f"""
SELECT Population, "Year", {q('a', 0.5)} AS median, {q('a', 0.025)} AS lower, {q('a', 0.975)} AS upper
FROM p_{t}_theta WHERE draw IN {kept(t)} GROUP BY 1, 2"""
    out["posterior_cohort_pd"] = with_gate("doy") + "," + priors[0] + f""",
dif AS (SELECT draw, avg(a) FILTER ("Year" = '2010') - avg(a) FILTER ("Year" = '2017') AS dif FROM p_doy_theta WHERE draw IN {kept('doy')} GROUP BY 1)
SELECT {pd('dif')} FROM dif"""


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    clim = "WITH " + CLIMATE
    cv = lambda c: f"stddev_samp({c}) / avg({c})"
    out["site_roster"] = clim + """
SELECT DISTINCT ID1, Latitude, Longitude, CASE WHEN ID1 IN ('NATION_6', 'NATION_7', 'NATION_8')
  THEN 'common garden' ELSE 'focal population' END AS ID FROM climate"""
    out["site_normals"] = clim + f"""
SELECT ID1, {r('avg(MAP)', 3)} AS hist_MAP, {r('avg(PPT_wt)', 3)} AS hist_PPT_wt, {r('avg(MAT)', 3)} AS hist_MAT,
  {r(cv('MAP'), 3)} AS cv_MAP, {r(cv('PPT_wt'), 3)} AS cv_PPTwt, {r(cv('MAT'), 3)} AS cv_MAT
FROM focal WHERE "Year" BETWEEN 1995 AND 1998 GROUP BY 1"""
    out["contemporary_normals"] = out["site_normals"].replace("hist_", "cont_").replace("1995 AND 1998", "1999 AND 2001")
    periods = """(VALUES ('historical', 1995, 1998), ('contemporary', 1999, 2001)) p(period, lo, hi)"""
    cvs = clim + f""",
cvs AS (SELECT ID1, period, {cv('MAP')} AS cv_MAP, {cv('PPT_wt')} AS cv_PPTwt, {cv('MAT')} AS cv_MAT
FROM focal JOIN {periods} ON "Year" BETWEEN lo AND hi GROUP BY 1, 2)"""
    out["period_cv"] = cvs + f"""
SELECT ID1, period, {r('cv_MAP')} AS cv_MAP, {r('cv_PPTwt')} AS cv_PPTwt, {r('cv_MAT')} AS cv_MAT FROM cvs"""
    out["level_labels"] = cvs + f"""
SELECT CASE WHEN ID1 IN ('NATION_0','NATION_1','NATION_2','NATION_3','NATION_4','NATION_5') THEN ID1 END AS site,
  CASE period WHEN 'historical' THEN 'Historical' ELSE 'Contemporary' END AS period, {r('cv_PPTwt')} AS cv_PPTwt FROM cvs"""
    anom = clim + """,
base AS (SELECT ID1, avg(PPT_wt) AS baseline_mean FROM focal WHERE "Year" BETWEEN 1995 AND 1998 GROUP BY 1),
ev AS (SELECT ID1, "Year", avg(PPT_wt) AS event_mean FROM focal WHERE "Year" BETWEEN 1999 AND 2000 GROUP BY 1, 2),
anom AS (SELECT base.ID1, ev."Year", baseline_mean, event_mean, event_mean - baseline_mean AS anomaly
         FROM base LEFT JOIN ev USING (ID1))"""
    out["event_anomaly"] = anom + f"""
SELECT ID1, "Year", {r('baseline_mean', 3)} AS baseline_mean, {r('event_mean', 3)} AS event_mean,
  {r('anomaly', 3)} AS anomaly FROM anom"""
    out["event_anomaly_mean"] = anom + f" SELECT ID1, {r('avg(anomaly)', 3)} AS mean_anomaly FROM anom GROUP BY 1"
    out["baseline_lines"] = anom + f"""
SELECT ID1, "Year", {r('PPT_wt', 3)} AS PPT_wt, {r('baseline_mean', 3)} AS hist_PPT_wt
FROM focal LEFT JOIN base USING (ID1) WHERE "Year" BETWEEN 1999 AND 2001"""
    out["trend_smooth"] = smooth()

    for t, (label, pairs) in TRAITS.items():
        w = with_gate(t)
        flags = ", ".join(f"CAST(N_{e} AS BIGINT) AS N_{e}" for e in envs(t))
        out[f"replicate_counts_{t}"] = w + f" SELECT * FROM counts_{t}"
        full, keys = f"c_{envs(t)[0]}", 'Dam_ID, Population, "Year"'
        each = ",".join(
            f"""
c_{e} AS (SELECT {keys}, count(*) AS {e}_reps FROM sub_{t} WHERE garden = '{e}' GROUP BY 1, 2, 3)"""
            for e in envs(t)
        )
        for e in envs(t)[1:]:
            full += f" FULL OUTER JOIN c_{e} USING ({keys})"
        reps = ", ".join(f"{e}_reps" for e in envs(t))
        out[f"replicate_counts_wide_{t}"] = f"{w}, {each} SELECT {keys}, {reps} FROM {full}"
        out[f"gate_{t}"] = w + f' SELECT Dam_ID, "Year", {flags}, CAST(both_ AS BIGINT) AS "both" FROM gate_{t}'
        out[f"gate_frequency_{t}"] = w + f' SELECT CAST(both_ AS BIGINT) AS "both", count(*) AS n FROM gate_{t} GROUP BY 1'
        out[f"eligible_{t}"] = w + f" SELECT Dam_ID FROM elig_{t}"
        out[f"plasticity_{t}"] = w + f"""
SELECT Dam_ID, pop_year, Population, "Year", {r(f'{t}_plasticity')} AS {t}_plasticity FROM index_{t}"""
        out[f"pair_totals_{t}"] = w + f"""
SELECT Dam_ID, pop_year, garden_1, garden_2, count(*) AS n_pairs, {r('avg(difference)')} AS mean_difference,
  {r('avg(ratio)')} AS mean_ratio FROM pairs_{t} GROUP BY 1, 2, 3, 4"""
        out[f"replicate_differences_{t}"] = w + f"""
SELECT Dam_ID, pop_year, garden_1, garden_2, {r('v1')} AS {t}_1, count(*) AS n_pairs,
  {r('avg(difference)')} AS mean_difference, {r('avg(ratio)')} AS mean_ratio
FROM pairs_{t} GROUP BY Dam_ID, pop_year, garden_1, garden_2, v1"""
        out[f"pairs_{t}"] = w + f"""
SELECT Dam_ID, pop_year, garden_1, garden_2, {r('v1')} AS {t}_1, {r('v2')} AS {t}_2,
  {r('max(difference)')} AS difference, {r('max(ratio)')} AS ratio, count(*) AS n_pairs
FROM pairs_{t} GROUP BY Dam_ID, pop_year, garden_1, garden_2, v1, v2"""
        out[f"mean_shift_{t}"] = w + f"""
SELECT {r(f'avg({t}_plasticity)')} AS mean_plasticity, {r('max(g)')} AS global_mean,
  {r(f'avg({t}_plasticity) * max(g)')} AS mean_shift FROM index_{t}, gm_{t}"""
        means = w + f", em AS (SELECT garden, avg(v) AS m FROM sub_{t} GROUP BY 1)"
        out[f"env_means_{t}"] = means + f" SELECT garden, {r('m')} AS {t}_mean FROM em"
        out[f"subtraction_pairs_{t}"] = means + f"""
SELECT a.garden AS garden_1, b.garden AS garden_2, {r('a.m')} AS mean_1, {r('b.m')} AS mean_2
FROM em a JOIN em b ON a.m > b.m OR (a.m = b.m AND a.garden > b.garden)"""
        x = f"{t}_pp_z"
        out[f"restricted_grid_{t}"] = selection() + f""",
g AS (SELECT Population, "Year", min({x}) AS lo, max({x}) AS hi FROM selz GROUP BY 1, 2 HAVING min({x}) IS NOT NULL)
SELECT Population, "Year", i, {r('lo + i * (hi - lo) / 99.0')} AS {x} FROM g CROSS JOIN range(100) s(i)"""
        out[f"fit_cell_means_{t}"] = w + f"""
SELECT Population, "Year", {r(f'avg({t}_plasticity)')} AS estimate FROM index_{t} GROUP BY 1, 2"""
        out[f"fit_slopes_{t}"] = selection() + f""",
c AS (SELECT Population, "Year", {x} AS x, fitness_rel AS y FROM selz WHERE {x} IS NOT NULL AND fitness_rel IS NOT NULL),
d AS (SELECT Population, x - avg(x) OVER p AS dx, y - avg(y) OVER p AS dy FROM c
      WINDOW p AS (PARTITION BY Population, "Year"))
SELECT Population, {r('sum(dx * dy) / sum(dx * dx)')} AS slope FROM d GROUP BY 1"""

    doy = with_gate("doy")
    out["saved_index"] = out["plasticity_doy"]
    out["centered_doy"] = doy + """
SELECT Dam_ID, Population, "Year", garden, raw AS first_flower_doy, v AS "transplant_DOY" FROM sub_doy"""
    out["censored"] = doy + f"""
SELECT Dam_ID, pop_year, Population, "Year", {r('doy_plasticity')} AS doy_plasticity,
  {r('CASE WHEN doy_plasticity BETWEEN -0.25 AND 1.2 THEN doy_plasticity END')} AS shown FROM index_doy"""
    out["sample_sizes"] = with_gate(*TRAITS) + " UNION ALL ".join(
        f"""
SELECT '{label}' AS trait, Population, "Year", count(DISTINCT Dam_ID) AS n_families, count(*) AS n_individuals
FROM sub_{t} GROUP BY 2, 3"""
        for t, (label, _) in TRAITS.items()
    )
    out["sample_sizes_united"] = out["sample_sizes"]
    sel = selection()
    out["trait_join"] = sel + f"""
SELECT Dam_ID, pop_year, Population, "Year", {r('doy_pp')} AS doy_pp, {r('sla_pp')} AS sla_pp, {r('ldmc_pp')} AS ldmc_pp
FROM traits"""
    out["family_fitness"] = "WITH " + PLANTS + f"""
SELECT Dam_ID, Population, "Year", {r('avg(rs)')} AS mean_rs FROM plants GROUP BY 1, 2, 3"""
    base = ", ".join(f"{r(c)} AS {c}" for c in [*COLS, "mean_rs"])
    z = ", ".join(f"{r(c)} AS {c}" for c in [*[f"{c}_z" for c in COLS], "fitness_rel"])
    out["selection_table"] = sel + f' SELECT {base}, Population, "Year", Dam_ID FROM sel'
    out["selection_z"] = sel + f' SELECT {base}, Population, "Year", Dam_ID, {z} FROM selz'
    pops, quad = SORTED_POPS[1:], ("doy_pp_z", "doy_pp2_z")
    flag = lambda p: f"(CASE WHEN Population = '{p}' THEN 1.0 ELSE 0.0 END)"
    cohort = "(CASE WHEN \"Year\" = 2017 THEN 1.0 ELSE 0.0 END)"
    cols = ['CAST(1 AS DOUBLE) AS "Intercept"']
    cols += [f'CAST({flag(p)} AS DOUBLE) AS "Population{p}"' for p in pops]
    cols += [f'CAST({cohort} AS DOUBLE) AS "Year2017"'] + [f"{r(x)} AS {x}" for x in quad]
    cols += [f'CAST({flag(p)} * {cohort} AS DOUBLE) AS "Population{p}_x_Year2017"' for p in pops]
    cols += [
        f'{r(f"CAST({flag(p)} AS DOUBLE) * {x}")} AS "Population{p}_x_{x}"' for x in quad for p in pops
    ]
    out["design_matrix"] = sel + f"""
SELECT Dam_ID, {', '.join(cols)} FROM selz
WHERE fitness_rel IS NOT NULL AND doy_pp_z IS NOT NULL AND doy_pp2_z IS NOT NULL"""

    out["level_order"] = "WITH " + PLANTS + """
SELECT Population, CAST(CASE Population WHEN 'S1' THEN 1 WHEN 'S2' THEN 2 WHEN 'C1' THEN 3 WHEN 'C2' THEN 4
  WHEN 'N2' THEN 5 WHEN 'N1' THEN 6 END AS BIGINT) AS rank, count(*) AS n FROM plants GROUP BY 1, 2"""
    out["level_cells"] = "WITH " + PLANTS + """
SELECT a.Population, b."Year" FROM (SELECT DISTINCT Population FROM plants) a
CROSS JOIN (SELECT DISTINCT "Year" FROM plants) b"""

    d, draws = "WITH " + DIFFS, "WITH " + DRAWS
    cells = list(dict.fromkeys(c for _, a, b in names(True) for c in (a, b)))
    wide = ", ".join(
        f"{r(f'''max(CASE WHEN Population = '{c[:2]}' AND \"Year\" = {c[3:]} THEN prediction END)''')} AS {c}"
        for c in cells
    )
    out["cells_wide"] = draws + f" SELECT draw, {wide} FROM cells GROUP BY 1"
    every = ", ".join(f"('{c}')" for c in cells)
    out["cells_long"] = d + f"""
SELECT d.draw, c.g AS "group", {r('k.prediction')} AS prediction, c.g[1:2] AS Population, c.g[4:7] AS "Year"
FROM (SELECT DISTINCT draw FROM cells) d CROSS JOIN (VALUES {every}) c(g)
LEFT JOIN keyed k ON k.draw = d.draw AND k.cell = c.g"""
    out["marginal_cohort"] = d + f' SELECT draw, "Year", {r("m")} AS marginal_prediction FROM cohorts'
    out["marginal_population"] = d + f" SELECT draw, Population, {r('m')} AS marginal_prediction FROM pops"
    out["marginal_cell"] = draws + f"""
SELECT draw, Population, "Year", {r('prediction')} AS marginal_prediction FROM cells"""
    out["contrast_cohort"] = d + f" SELECT draw, {r('diff_prediction')} AS diff_prediction FROM cohortdifs"
    out["contrast_population"] = d + f" SELECT draw, difference, {r('pred_diff')} AS pred_diff FROM popdifs"
    out["contrast_popcohort"] = d + f" SELECT draw, var, {r('dif')} AS dif FROM celldifs"
    out["contrast_popcohort_long"] = out["contrast_popcohort"] + " WHERE seen"
    out["pd_cohort"] = d + f" SELECT {pd('diff_prediction')} FROM cohortdifs"
    out["pd_population"] = d + f" SELECT difference, {pd('pred_diff')} FROM popdifs GROUP BY 1"
    out["pd_popcohort"] = d + f" SELECT var, {pd('dif')} FROM celldifs GROUP BY 1"
    out["pd_back_join"] = d + f""", s AS (SELECT difference, {pd('pred_diff')} FROM popdifs GROUP BY 1)
SELECT draw, difference, {r('pred_diff')} AS pred_diff, prob_greater_than_zero, prob_less_than_zero, probability
FROM popdifs JOIN s USING (difference)"""
    out["labels"] = d + f""", s AS (SELECT var, {pd('dif')} FROM celldifs GROUP BY 1)
SELECT var, var[1:2] AS Population, split_part(var, '-', 1) AS "left", split_part(var, '-', 2) AS "right",
  'PD(≠0) = ' || regexp_replace(CAST((k // 10000 + CASE WHEN k % 10000 > 5000 OR (k % 10000 = 5000
    AND k // 10000 % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS VARCHAR), '\\.0$', '') AS label
FROM (SELECT *, CAST(round(probability * 1000000) AS BIGINT) AS k FROM s)"""
    keep = ", ".join(f"'{p}_2010-{p}_2017'" for p in POPS)
    out["stars"] = d + f""", s AS (SELECT var, {r('CASE WHEN count(dif) = count(*) THEN avg(dif) END')} AS mean_diff, {pd('dif', 'prob_diff_from_zero')}
  FROM celldifs WHERE var IN ({keep}) GROUP BY 1)
SELECT *, CASE WHEN prob_diff_from_zero >= 0.999 THEN '***' WHEN prob_diff_from_zero >= 0.99 THEN '**'
  WHEN prob_diff_from_zero >= 0.95 THEN '*' ELSE '' END AS significance, var[1:2] AS Population FROM s"""
    q = lambda v, p: r(f"quantile_cont({v}, {p})")
    out["cell_intervals"] = draws + f"""
SELECT Population, "Year", {q('prediction', 0.5)} AS median, {q('prediction', 0.025)} AS lower,
  {q('prediction', 0.975)} AS upper FROM cells GROUP BY 1, 2"""
    out["preview_cells"] = draws + f"""
SELECT draw, Population, "Year", {r('prediction')} AS prediction FROM cells ORDER BY draw, Population, "Year" LIMIT 6"""

    b = "WITH " + BOUND
    out["epred_cells"] = b + f"""
SELECT draw, Population, CAST("Year" AS VARCHAR) AS "Year", {r('prediction')} AS prediction
FROM cells WHERE draw IN (SELECT draw FROM whole)"""
    out["coef_summary"] = b + f""", t AS ({bound_terms()})
SELECT CAST(idx AS BIGINT) AS idx, term, {r('avg(v)')} AS estimate, {r('stddev_samp(v)')} AS est_error,
  {q('v', 0.025)} AS lower, {q('v', 0.975)} AS upper FROM t GROUP BY 1, 2"""
    out["slope_table"] = b + f"""
SELECT Population, {q('slope', 0.5)} AS linear_median, {q('slope', 0.025)} AS linear_lower,
  {q('slope', 0.975)} AS linear_upper, '{TRAITS['doy'][0]}' AS trait FROM two GROUP BY 1"""
    out["trend_draws"] = b + f' SELECT draw, Population, "Year", {r("value")} AS value FROM trends'
    out["slope_pd"] = b + f"""
SELECT Population, "Year", {r('mean_slope')} AS mean_slope, {r('up')} AS prob_greater_than_zero,
  {r('down')} AS prob_less_than_zero, {r('greatest(up, down)')} AS prob_diff_from_zero FROM slopepd"""
    eff = effects()
    out["conditional_effects"] = eff + f"""
SELECT draw, Population, "Year", i, {r('doy_pp_z', 5)} AS doy_pp_z, {r('value', 5)} AS value,
  Population || '-' || "Year" AS pop_year, {r('greatest(up, down)', 5)} AS prob_diff_from_zero,
  CASE WHEN greatest(up, down) >= 0.95 THEN 'Significant' ELSE 'Not Significant' END AS sig
FROM eff JOIN slopepd USING (Population, "Year")"""
    out["ribbon"] = eff + f"""
SELECT Population, "Year", i, {r('max(doy_pp_z)', 5)} AS doy_pp_z, {r('quantile_cont(value, 0.25)', 5)} AS lower,
  {r('quantile_cont(value, 0.5)', 5)} AS median, {r('quantile_cont(value, 0.75)', 5)} AS upper FROM eff GROUP BY 1, 2, 3"""
    widths = " UNION ALL ".join(
        f"""SELECT Population, {q('value', 0.5)} AS median, CAST({w} AS DOUBLE) AS width, {q('value', (1 - w) / 2)} AS lower,
  {q('value', (1 + w) / 2)} AS upper FROM trends WHERE "Year" = '2010' GROUP BY 1"""
        for w in (0.66, 0.95)
    )
    out["halfeye_intervals"] = b + " " + widths
    for t in TRAITS:
        w = with_gate(t) + ","
        out[f"box_garden_{t}"] = w + box(f"sub_{t}", "raw", "garden, Population")
        index = r(f"{t}_plasticity", 9)
        shown = f"CASE WHEN {index} BETWEEN -0.25 AND 1.2 THEN {index} END"
        out[f"box_index_{t}"] = w + box(f"index_{t}", shown, 'Population, "Year"')
    out["box_centered"] = doy + "," + box("sub_doy", "v", "garden, Population")
    out["halfeye_density"] = b + ", t10 AS (SELECT * FROM trends WHERE \"Year\" = '2010')," + density(
        "t10", "value", "Population", 256, False, 0.0
    )
    posterior(out)
    out["reference_population"] = selection() + f""",
levels AS (SELECT DISTINCT Population AS p FROM selz WHERE doy_pp_z IS NOT NULL AND fitness_rel IS NOT NULL),
termed AS (SELECT p FROM levels WHERE p > (SELECT min(p) FROM levels))
SELECT p AS Population FROM (VALUES {', '.join(f"('{p}')" for p in POPS)}) v(p) EXCEPT SELECT p FROM termed"""
    out["climate_csv"] = clim + f"""
SELECT ID1, "Year", {r('Latitude', 3)} AS Latitude, {r('Longitude', 3)} AS Longitude, {r('MAP', 3)} AS MAP, {r('PPT_wt', 3)} AS PPT_wt,
  {r('MAT', 3)} AS MAT, CAST(NULL AS DOUBLE) AS CMD FROM climate"""
    out["plants_csv"] = out["plasticity_doy"]
    out["saved_fit"] = out["coef_summary"]
    out["trait_join_bucketed"] = out["trait_join"]
    shown = "t10 AS (SELECT * FROM trends WHERE \"Year\" = '2010' AND value BETWEEN -4 AND 3)"
    out["halfeye_limited"] = b + f", {shown} " + widths.replace("trends WHERE \"Year\" = '2010'", "t10")
    near = ", near AS (SELECT * FROM popdifs WHERE pred_diff BETWEEN -4 AND 3),"
    out["ridges_limited"] = d + near + density("near", "pred_diff", "difference", 256, True, 3.0)
    shifted = lambda sql: sql.replace(DRAWS, SHIFTED).replace(DRAWS.replace(PLANTS + ",", "", 1), SHIFTED.replace(PLANTS + ",", "", 1))
    out["stars_shifted"] = shifted(out["stars"])
    both = b + f"""
SELECT Population, "Year", {r('mean_slope')} AS mean_slope, {r('up')} AS prob_greater_than_zero, {r('down')} AS prob_less_than_zero,
  {r('greatest(up, down)')} AS prob_diff_from_zero,
  CASE WHEN greatest(up, down) >= 0.95 THEN 'Significant' ELSE 'Not Significant' END AS sig FROM slopepd"""
    out["significance_shifted"] = shifted(both)
    out["ribbon_significant"] = shifted(out["ribbon"]).replace("FROM eff GROUP BY", "FROM eff JOIN (SELECT Population, \"Year\" FROM slopepd WHERE greatest(up, down) >= 0.95) USING (Population, \"Year\") GROUP BY")
    two = lambda sql: sql.replace(PLANTS, TWO_COHORTS)
    out["gate_two_cohorts"] = two(out["gate_ldmc"])
    out["plasticity_two_cohorts"] = two(out["plasticity_ldmc"])
    out["trait_join_two_cohorts"] = two(out["trait_join"])
    by_cohort = out["trait_join"]
    for t in ("s", "l"):
        by_cohort = by_cohort.replace(f"ON d.Dam_ID IS NOT DISTINCT FROM {t}.Dam_ID", f"ON d.Dam_ID IS NOT DISTINCT FROM {t}.Dam_ID AND d.pop_year = {t}.pop_year")
    out["trait_join_by_cohort"] = two(by_cohort)
    out["selection_two_cohorts"] = two(out["selection_table"])
    del out["pairs_sla"]  # not registered: quadratic for a continuous trait
    out["density_curve"] = d + "," + density("cohortdifs", "diff_prediction", None, 512, False, 0.0)
    out["density_ridges"] = d + "," + density("popdifs", "pred_diff", "difference", 256, True, 3.0)
    return out

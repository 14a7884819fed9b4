"""Named queries over the order/part tables, one or more per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reaction_norms.functions import columns as C
from reaction_norms.models import gaussian as M
from reaction_norms.models import loo as L
from reaction_norms.models.design import design_for
from reaction_norms.operators import climate as K
from reaction_norms.operators import figures as G
from reaction_norms.operators import plasticity as P
from reaction_norms.operators import posterior as Q
from reaction_norms.operators import reshape as R
from reaction_norms.operators import selection as S
from reaction_norms.session import materialize, shared_folder
from reaction_norms.sources import bindings as B
from reaction_norms.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NAMES = [t.name for t in P.TRAITS]
MEANS = {"hist_MAP": "MAP", "hist_PPT_wt": "PPT_wt", "hist_MAT": "MAT"}
PERIODS = {"historical": B.BASELINE_YEARS, "contemporary": B.CONTEMPORARY_YEARS}
SITE_ORDER = tuple(f"NATION_{i}" for i in (5, 4, 3, 2, 1, 0))
FIGURE_POPULATIONS = ("S1", "S2", "C1", "C2", "N2", "N1")
INDEX_LIMITS = (-0.25, 1.2)
SLOPE_LIMITS = (-4.0, 3.0)
TREND_LIMITS = (0.0, 26_000_000.0)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: whole numbers as bigint, doubles rounded without a negative zero."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        out.append(c.alias(field.name))
    return df.select(*out)


# ---------------------------------------------------------------------- climate


def _focal(spark: SparkSession, d: str) -> DataFrame:
    return K.focal_sites(B.climate(spark, d), B.GARDEN_SITES)


@query
def site_roster(spark, d):
    return tidy(K.site_roster(B.climate(spark, d), B.GARDEN_SITES))


@query
def site_normals(spark, d):
    normals = K.climate_normals(_focal(spark, d), means=MEANS, years=B.BASELINE_YEARS)
    return tidy(normals, 3)


@query
def contemporary_normals(spark, d):
    """The second period's means and variation, as ``site_normals`` has the first's."""
    means = {name.replace("hist", "cont"): c for name, c in MEANS.items()}
    return tidy(K.climate_normals(_focal(spark, d), means=means, years=B.CONTEMPORARY_YEARS), 3)


@query
def period_cv(spark, d):
    return tidy(K.compare_periods(_focal(spark, d), PERIODS))


def _anomalies(spark, d):
    return K.anomaly(_focal(spark, d), "PPT_wt", B.BASELINE_YEARS, B.EVENT_YEARS)


@query
def event_anomaly(spark, d):
    return tidy(_anomalies(spark, d), 3)


@query
def event_anomaly_mean(spark, d):
    return tidy(K.mean_anomaly(_anomalies(spark, d)), 3)


@query
def baseline_lines(spark, d):
    """Historical mean beside every site-year of the trend panel."""
    normals = K.climate_normals(
        _focal(spark, d), means={"hist_PPT_wt": "PPT_wt"}, cvs={}, years=B.BASELINE_YEARS
    )
    years = _focal(spark, d).where(F.col("Year").between(*B.CONTEMPORARY_YEARS))
    return tidy(years.select("ID1", "Year", "PPT_wt").join(normals, "ID1", "left"), 3)


@query
def trend_smooth(spark, d):
    shown = _focal(spark, d).withColumn("PPT_wt", C.censor("PPT_wt", *TREND_LIMITS))
    return tidy(K.smooth_trend(shown, "Year", "PPT_wt", "ID1"), 2)


# ------------------------------------------------------------------- plasticity


def _per_trait(
    name: str,
    fn: Callable[[DataFrame, P.Trait], DataFrame],
    traits: Sequence[P.Trait] = P.TRAITS,
    digits: int = 6,
) -> None:
    for t in traits:
        QUERIES[f"{name}_{t.name}"] = lambda spark, d, t=t: tidy(fn(B.joined_plants(spark, d), t), digits)


_per_trait("replicate_counts", P.replicate_counts)
_per_trait("replicate_counts_wide", P.replicate_counts_wide)
_per_trait("gate", P.gate_table)
_per_trait("gate_frequency", lambda plants, t: P.gate_frequency(P.gate_table(plants, t)))
_per_trait("eligible", P.eligible_families)
_per_trait("plasticity", P.plasticity_index)
_per_trait("pair_totals", P.pair_totals)
_per_trait("replicate_differences", P.replicate_differences)
# Days and whole percents take few distinct values, which bounds the pair table; for a
# continuous trait it is quadratic in the size of a family and is not registered.
_per_trait("pairs", P.pairwise_differences, [P.DOY, P.LDMC])
_per_trait("mean_shift", P.mean_shift)
_per_trait("env_means", P.env_means)
_per_trait(
    "subtraction_pairs",
    lambda plants, t: P.subtraction_pairs(P.env_means(plants, t), f"{t.name}_mean"),
)


@query
def centered_doy(spark, d):
    plants = P.eligible_plants(B.joined_plants(spark, d), P.DOY).select("Dam_ID", "Population", "Year", "garden", P.DOY.column)
    return tidy(P.center_on_env_min(plants, P.DOY.column))


@query
def sample_sizes(spark, d):
    return tidy(P.sample_sizes(B.joined_plants(spark, d)))


@query
def sample_sizes_united(spark, d):
    """Family sketches of each population, saved one run after another, and united."""
    plants = B.joined_plants(spark, d)
    runs = [replace(plants, families=plants.families.where(which)) for which in (F.col("Population") < "N1", ~(F.col("Population") < "N1"))]
    saved = [materialize(P.size_sketches(run)) for run in runs]
    return tidy(P.united_sizes(saved[0].unionByName(saved[1])))


# Families over both cohorts: a family passes its gate in one and keeps its plants of the other, and
# a join by family alone fans out.


def _two(spark, d):
    plants = B.two_cohort_plants(spark, d)
    return replace(plants, facts=materialize(plants.facts))


@query
def gate_two_cohorts(spark, d):
    return tidy(P.gate_table(_two(spark, d), P.LDMC))


@query
def plasticity_two_cohorts(spark, d):
    return tidy(P.plasticity_index(_two(spark, d), P.LDMC))


@query
def trait_join_two_cohorts(spark, d):
    return tidy(S.join_traits(S.indices_by_trait(_two(spark, d))))


@query
def trait_join_by_cohort(spark, d):
    return tidy(S.join_traits(S.indices_by_trait(_two(spark, d)), ("Dam_ID", "pop_year")))


@query
def selection_two_cohorts(spark, d):
    plants = _two(spark, d)
    return tidy(S.selection_table(plants, S.indices_by_trait(plants)))


# Hand-off files and tables.


def _folder(spark, name: str) -> str:
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def climate_csv(spark, d):
    """The climate table as a CSV file, read back under its contract."""
    path = _folder(spark, "climate")
    tables.write_table(B.climate(spark, d), path, "csv")
    got = tables.read_climate(spark, path).select("ID1", "Year", "Latitude", "Longitude", "MAP", "PPT_wt", "MAT", "CMD")
    return tidy(got, 3)


@query
def plants_csv(spark, d):
    """Family indices of plants that were read from CSV files."""
    path = _folder(spark, "plants")
    tables.write_table(B.plants(spark, d), path, "csv")
    return tidy(P.plasticity_index(tables.read_plants(spark, path), P.DOY))


@query
def saved_fit(spark, d):
    """Coefficients of a model that was saved and loaded."""
    path = _folder(spark, "fit")
    tables.save_fit(B.coefficient_terms(spark), B.coefficient_draws(spark, d), path)
    terms, draws = tables.load_fit(spark, path)
    names = [r["name"] for r in terms.orderBy("idx").collect()]
    return tidy(Q.coefficient_summary(draws, names))


@query
def trait_join_bucketed(spark, d):
    """The trait join on hand-off tables in buckets of the family: no shuffle."""
    path, run = _folder(spark, "tables"), uuid.uuid4().hex
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = {}
    for name, index in S.indices_by_trait(B.joined_plants(spark, d)).items():
        tables.replace_family_table(index, f"index_{name}_{run}", path, buckets)
        stored[name] = tables.family_table(spark, f"index_{name}_{run}")
    return tidy(S.join_traits(stored, null_safe=False))


@query
def saved_index(spark, d):
    """The family index written to the shared folder and read back."""
    path = _folder(spark, "saved_index")
    tables.write_table(P.plasticity_index(B.joined_plants(spark, d), P.DOY), path)
    return tidy(tables.read_plasticity(spark, path, "doy"))


# -------------------------------------------------------------------- selection


def _selection(spark, d):
    plants = B.joined_plants(spark, d)
    return S.selection_table(plants, S.indices_by_trait(plants))


def _selection_z(spark, d):
    return S.standardized_selection(_selection(spark, d), NAMES)


@query
def trait_join(spark, d):
    return tidy(S.join_traits(S.indices_by_trait(B.joined_plants(spark, d))))


@query
def family_fitness(spark, d):
    return tidy(S.family_fitness(B.joined_plants(spark, d)))


@query
def selection_table(spark, d):
    return tidy(_selection(spark, d))


@query
def selection_z(spark, d):
    return tidy(_selection_z(spark, d))


def _grid(trait: P.Trait) -> Query:
    return lambda spark, d: tidy(S.restricted_grid(_selection_z(spark, d), f"{trait.name}_pp_z"))


for _t in P.TRAITS:
    QUERIES[f"restricted_grid_{_t.name}"] = _grid(_t)


# ------------------------------------------------------------ levels and labels


@query
def level_order(spark, d):
    """Population level table in figure order."""
    plants = B.plants(spark, d)
    ranked = plants.select("Population", C.level_rank("Population", FIGURE_POPULATIONS).alias("rank"))
    return tidy(ranked.groupBy("Population", "rank").agg(F.count(F.lit(1)).alias("n")).orderBy("rank"))


@query
def level_labels(spark, d):
    """Sites restricted to declared levels and periods relabelled; unlisted become NULL."""
    cv = K.compare_periods(_focal(spark, d), PERIODS)
    return tidy(
        cv.select(
            C.with_level("ID1", SITE_ORDER).alias("site"),
            C.with_level(
                "period", ["historical", "contemporary"], ["Historical", "Contemporary"]
            ).alias("period"),
            "cv_PPTwt",
        )
    )


@query
def censored(spark, d):
    """Family indices outside the axis range become missing."""
    index = P.plasticity_index(B.joined_plants(spark, d), P.DOY)
    return tidy(index.withColumn("shown", C.censor("doy_plasticity", *INDEX_LIMITS)))


@query
def labels(spark, d):
    stats = Q.probability_of_difference(_cell_diffs(spark, d), "dif", ["var"])
    return stats.select(
        "var",
        C.first_population("var").alias("Population"),
        C.split_key("var", 1).alias("left"),
        C.split_key("var", 2).alias("right"),
        C.pd_label("probability").alias("label"),
    )


# ------------------------------------------------------------ cells and contrasts


def _cell_diffs(spark, d):
    return Q.cell_contrast(B.draw_table(spark, d))


def _population_diffs(spark, d):
    return Q.population_contrast(B.draw_table(spark, d))


@query
def cells_wide(spark, d):
    names = R.contrast_cells(R.cell_contrasts())
    return tidy(
        R.to_wide(B.draw_table(spark, d), ["draw"], ["Population", "Year"], names, "prediction")
    )


@query
def cells_long(spark, d):
    names = R.contrast_cells(R.cell_contrasts())
    wide = R.to_wide(B.draw_table(spark, d), ["draw"], ["Population", "Year"], names, "prediction")
    long = R.to_long(wide, ["draw"], names, "group", "prediction")
    return tidy(
        long.select(
            "*",
            C.split_key("group", 1, "_").alias("Population"),
            C.split_key("group", 2, "_").alias("Year"),
        )
    )


@query
def level_cells(spark, d):
    return tidy(R.level_cells(B.plants(spark, d), ["Population", "Year"]))


@query
def marginal_cohort(spark, d):
    return tidy(Q.marginal(B.draw_table(spark, d), ["Year"]))


@query
def marginal_population(spark, d):
    return tidy(Q.marginal(B.draw_table(spark, d), ["Population"]))


@query
def marginal_cell(spark, d):
    return tidy(Q.marginal(B.draw_table(spark, d), ["Population", "Year"]))


@query
def contrast_cohort(spark, d):
    return tidy(Q.cohort_contrast(B.draw_table(spark, d)))


@query
def contrast_population(spark, d):
    return tidy(_population_diffs(spark, d))


@query
def contrast_popcohort(spark, d):
    return tidy(_cell_diffs(spark, d))


@query
def contrast_popcohort_long(spark, d):
    """The same contrasts from long cells, without the wide row."""
    cells = B.draw_table(spark, d)
    keyed = cells.select("draw", C.key_text("Population", "Year", sep="_").alias("cell"), "prediction")
    return tidy(R.contrasts_from_long(keyed, "cell", "prediction", R.cell_contrasts()))


@query
def pd_cohort(spark, d):
    return tidy(Q.probability_of_difference(Q.cohort_contrast(B.draw_table(spark, d)), "diff_prediction"))


@query
def pd_population(spark, d):
    return tidy(Q.probability_of_difference(_population_diffs(spark, d), "pred_diff", ["difference"]))


@query
def pd_popcohort(spark, d):
    return tidy(Q.probability_of_difference(_cell_diffs(spark, d), "dif", ["var"]))


@query
def pd_back_join(spark, d):
    return tidy(Q.join_probability(_population_diffs(spark, d), "pred_diff", ["difference"]))


@query
def stars(spark, d):
    return tidy(Q.contrast_stars(_cell_diffs(spark, d)))


@query
def cell_intervals(spark, d):
    return tidy(Q.cell_summary(B.draw_table(spark, d)))


# ------------------------------------------------------------------------- models


def _index(spark, d, trait: P.Trait) -> DataFrame:
    return materialize(P.plasticity_index(B.joined_plants(spark, d), trait))


def _ols_draw(spark: SparkSession, fit: M.GaussianFit) -> DataFrame:
    """The least-squares solution as a draw table of one draw."""
    beta, s2 = fit.least_squares()
    return spark.createDataFrame([(0, [float(b) for b in beta], float(s2) ** 0.5)], M.DRAWS)


def _fit_cell_means(trait: P.Trait) -> Query:
    def run(spark, d):
        index = _index(spark, d, trait)
        design = design_for(index, f"{trait.name}_plasticity")
        cells = M.expected_cells(_ols_draw(spark, M.fit_gaussian(index, design)), design)
        return tidy(cells.drop("draw").withColumnRenamed("prediction", "estimate"))

    return run


def _model_data(spark, d) -> DataFrame:
    return materialize(_selection_z(spark, d))


def _fit_slopes(trait: P.Trait) -> Query:
    def run(spark, d):
        x = f"{trait.name}_pp_z"
        data = _model_data(spark, d)
        design = design_for(data, "fitness_rel", [x])
        slopes = M.slope_draws(_ols_draw(spark, M.fit_gaussian(data, design)), design, x)
        return tidy(slopes.drop("draw"))

    return run


for _t in P.TRAITS:
    QUERIES[f"fit_cell_means_{_t.name}"] = _fit_cell_means(_t)
    QUERIES[f"fit_slopes_{_t.name}"] = _fit_slopes(_t)


@query
def design_matrix(spark, d):
    """Design rows of the quadratic selection model."""
    data = _model_data(spark, d)
    design = design_for(data, "fitness_rel", ["doy_pp_z", "doy_pp2_z"])
    rows = design.complete_cases(data)
    return tidy(rows.select("Dam_ID", *[c.alias(t.replace(":", "_x_")) for c, t in zip(design.row(), design.terms)]))


FORMS = ("linear", "quadratic")


def _selection_models(
    data: DataFrame,
    traits: Sequence[P.Trait],
    forms: Sequence[str] = FORMS,
    prior: M.Prior | None = M.SELECTION_PRIOR,
) -> dict[str, M.GaussianFit]:
    """``{trait}_{form}`` models, all fitted in one pass over the selection table."""
    levels = design_for(data, "fitness_rel")
    designs = {}
    for t in traits:
        for form in forms:
            covariates = (f"{t.name}_pp_z", f"{t.name}_pp2_z")[: 1 + (form == "quadratic")]
            designs[f"{t.name}_{form}"] = replace(levels, covariates=covariates)
    return M.fit_all(data, designs, prior)


# Each query of a selection model comes under the priors of the analysis (``posterior_*``) and under the flat prior
# (``flat_*``), whose draws have a closed form that SQL can follow.


def _under_priors(fn: Callable[[SparkSession, str, M.Prior | None], DataFrame]) -> None:
    QUERIES[f"posterior_{fn.__name__}"] = lambda spark, d: tidy(fn(spark, d, M.SELECTION_PRIOR), 5)
    QUERIES[f"flat_{fn.__name__}"] = lambda spark, d: tidy(fn(spark, d, None), 5)


def _doy_fit(data: DataFrame, prior: M.Prior | None) -> M.GaussianFit:
    return _selection_models(data, [P.DOY], ["linear"], prior)["doy_linear"]


@_under_priors
def draws(spark, d, prior):
    """Every coefficient and sigma of every draw of the linear model."""
    fit = _doy_fit(_model_data(spark, d), prior)
    names = F.array(*[F.lit(t) for t in (*fit.design.terms, "sigma")])
    values = F.transform(F.concat("beta", F.array("sigma")), lambda v, i: F.struct(i.alias("idx"), F.get(names, i).alias("term"), v.alias("value")))
    return fit.draws(spark).select("draw", F.inline(values))


@_under_priors
def subsample(spark, d, prior):
    """A thousand of the draws, with their sigma."""
    return Q.subsample_draws(_doy_fit(_model_data(spark, d), prior).draws(spark)).select("draw", "sigma")


@_under_priors
def coefficients(spark, d, prior):
    fit = _doy_fit(_model_data(spark, d), prior)
    return Q.coefficient_summary(fit.draws(spark), fit.design.terms)


@_under_priors
def slope_table(spark, d, prior):
    """Slopes and intervals of the three linear models."""
    fits = _selection_models(_model_data(spark, d), P.TRAITS, ["linear"], prior)
    parts = []
    for t in P.TRAITS:
        fit = fits[f"{t.name}_linear"]
        slopes = M.slope_draws(fit.draws(spark), fit.design, f"{t.name}_pp_z")
        parts.append(Q.slope_table(slopes, t.label))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_under_priors
def conditional(spark, d, prior):
    """Ribbon of the linear model's fitted draws over the observed ranges, the cells with a significant slope."""
    data, x = _model_data(spark, d), "doy_pp_z"
    fit = _doy_fit(data, prior)
    draws = materialize(fit.draws(spark))
    probs = Q.slope_probability(M.trend_draws(draws, fit.design, x))
    effects = M.conditional_effects(draws, fit.design, x, S.observed_range(data, x))
    return G.ribbon(Q.join_significance(effects, probs), x)


@_under_priors
def fitted(spark, d, prior):
    """Expected value of every family under all draws."""
    data = _model_data(spark, d)
    return M.fitted_values(data, _doy_fit(data, prior), ["Dam_ID", "Population", "Year"])


def _loo_pointwise(spark, d, traits: Sequence[P.Trait], prior: M.Prior | None) -> DataFrame:
    data = _model_data(spark, d)
    return L.loo_pointwise(data, _selection_models(data, traits, prior=prior))


@_under_priors
def loo_scores(spark, d, prior):
    models = [f"{P.DOY.name}_{f}" for f in FORMS]
    return L.loo_scores(_loo_pointwise(spark, d, [P.DOY], prior), models)


@_under_priors
def loo_compare(spark, d, prior):
    """The six models of the three traits, scored in one pass."""
    groups = {t.label: [f"{t.name}_{f}" for f in FORMS] for t in P.TRAITS}
    return L.loo_compare(_loo_pointwise(spark, d, P.TRAITS, prior), groups)


for _new, _old in {"posterior_fitted": "fitted_values", "posterior_loo_scores": "loo_scores", "posterior_loo_compare": "loo_compare"}.items():
    QUERIES[_old] = QUERIES.pop(_new)


# The plasticity models name no prior and get the default one.


def _plasticity_model(spark, d, trait: P.Trait) -> M.GaussianFit:
    index = _index(spark, d, trait)
    design = design_for(index, f"{trait.name}_plasticity")
    return M.fit_gaussian(index, design, M.default_prior(index, design))


@query
def default_priors(spark, d):
    """Location and scale of the default prior of each plasticity model."""
    priors = [(t.name, _plasticity_model(spark, d, t).prior) for t in P.TRAITS]
    return spark.createDataFrame([(n, p.location, p.scale, p.dof) for n, p in priors], "trait string, location double, scale double, dof double")


def _plasticity_cells(spark, d, trait: P.Trait) -> DataFrame:
    """Expected cells of a thousand kept draws."""
    fit = _plasticity_model(spark, d, trait)
    return M.expected_cells(Q.subsample_draws(fit.draws(spark)), fit.design)


for _t in P.TRAITS:
    QUERIES[f"posterior_cells_{_t.name}"] = lambda spark, d, t=_t: tidy(Q.cell_summary(_plasticity_cells(spark, d, t)), 5)


@query
def posterior_cohort_pd(spark, d):
    """Cohort contrast of the plasticity model: fit, draws, 1000 kept, cells, PD."""
    return tidy(Q.probability_of_difference(Q.cohort_contrast(_plasticity_cells(spark, d, P.DOY)), "diff_prediction"))


# Tables computed from draws, on coefficients solved from the draw table.


@query
def epred_cells(spark, d):
    return tidy(M.expected_cells(B.coefficient_draws(spark, d), B.BOUND_DESIGN))


@query
def coef_summary(spark, d):
    return tidy(Q.coefficient_summary(B.coefficient_draws(spark, d), B.BOUND_DESIGN.terms))


def _bound_slopes(spark, d):
    return M.slope_draws(B.coefficient_draws(spark, d), B.BOUND_DESIGN, B.BOUND_COVARIATE)


def _bound_trends(spark, d):
    return M.trend_draws(B.coefficient_draws(spark, d), B.BOUND_DESIGN, B.BOUND_COVARIATE)


@query
def slope_table(spark, d):
    return tidy(Q.slope_table(_bound_slopes(spark, d), P.DOY.label))


@query
def trend_draws(spark, d):
    return tidy(_bound_trends(spark, d))


@query
def slope_pd(spark, d):
    return tidy(Q.slope_probability(_bound_trends(spark, d)))


def _bound_effects(spark, d, draws: DataFrame | None = None):
    draws = B.coefficient_draws(spark, d) if draws is None else draws
    ranges = S.observed_range(_selection_z(spark, d), B.BOUND_COVARIATE)
    effects = M.conditional_effects(draws, B.BOUND_DESIGN, B.BOUND_COVARIATE, ranges)
    trends = M.trend_draws(draws, B.BOUND_DESIGN, B.BOUND_COVARIATE)
    return Q.join_significance(effects, Q.slope_probability(trends))


def _shifted_draws(spark, d) -> DataFrame:
    return B.coefficient_draws(spark, d, B.shifted_draw_table(spark, d))


@query
def stars_shifted(spark, d):
    """Contrasts between cohorts that differ by as much as their population's effect."""
    return tidy(Q.contrast_stars(Q.cell_contrast(B.shifted_draw_table(spark, d))))


@query
def ribbon_significant(spark, d):
    """Ribbons of the cells whose slope differs from zero, of draws where some do and some do not."""
    return tidy(G.ribbon(_bound_effects(spark, d, _shifted_draws(spark, d)), B.BOUND_COVARIATE), 5)


@query
def significance_shifted(spark, d):
    """Slope, probability and label of every cell of those draws."""
    trends = M.trend_draws(_shifted_draws(spark, d), B.BOUND_DESIGN, B.BOUND_COVARIATE)
    return tidy(Q.slope_probability(trends).withColumn("sig", C.significance("prob_diff_from_zero")))


@query
def conditional_effects(spark, d):
    return tidy(_bound_effects(spark, d), 5)


# ------------------------------------------------------------------------ figures


def _box_garden(plants: P.Plants, trait: P.Trait) -> DataFrame:
    """Raw trait by garden x population over the eligible plants."""
    eligible = P.eligible_plants(plants, trait).select("garden", "Population", trait.column)
    return G.box_summary(materialize(eligible), trait.column, ["garden", "Population"])


def _box_index(plants: P.Plants, trait: P.Trait) -> DataFrame:
    """Family index by population x cohort, within the axis range.

    Last-bit noise of the index is rounded off first: a value can lie exactly on a fence.
    """
    index = materialize(tidy(P.plasticity_index(plants, trait), 9))
    return G.box_summary(index, f"{trait.name}_plasticity", ["Population", "Year"], INDEX_LIMITS)


_per_trait("box_garden", _box_garden)
_per_trait("box_index", _box_index)


@query
def box_centered(spark, d):
    """Centred flowering date by garden x population."""
    centred = P.center_on_env_min(P.eligible_plants(B.joined_plants(spark, d), P.DOY), P.DOY.column)
    rows = materialize(centred.select("garden", "Population", "transplant_DOY"))
    return tidy(G.box_summary(rows, "transplant_DOY", ["garden", "Population"]))


@query
def density_curve(spark, d):
    return tidy(G.density_curve(Q.cohort_contrast(B.draw_table(spark, d)), "diff_prediction"))


@query
def density_ridges(spark, d):
    return tidy(G.density_ridges(_population_diffs(spark, d), "pred_diff", ["difference"], n=256))


@query
def halfeye_intervals(spark, d):
    cohort = _bound_trends(spark, d).where(F.col("Year") == "2010")
    return tidy(G.interval_summary(cohort, "value", ["Population"]))


@query
def halfeye_limited(spark, d):
    """Intervals of the slopes within the limits of the axis."""
    cohort = _bound_trends(spark, d).where(F.col("Year") == "2010")
    return tidy(G.interval_summary(cohort, "value", ["Population"], limits=SLOPE_LIMITS))


@query
def ridges_limited(spark, d):
    """Densities of the contrasts within the limits of the axis."""
    return tidy(G.density_ridges(_population_diffs(spark, d), "pred_diff", ["difference"], n=256, limits=SLOPE_LIMITS))


@query
def halfeye_density(spark, d):
    cohort = _bound_trends(spark, d).where(F.col("Year") == "2010")
    return tidy(G.density_curve(cohort, "value", ["Population"], n=256))


@query
def reference_population(spark, d):
    """The declared population without a term of its own in the model of the data."""
    terms = _doy_fit(_model_data(spark, d), None).terms(spark)
    declared = spark.createDataFrame([(p,) for p in FIGURE_POPULATIONS], "Population string")
    return Q.reference_population(declared, terms)


@query
def ribbon(spark, d):
    return tidy(
        G.ribbon(_bound_effects(spark, d), B.BOUND_COVARIATE, significant_only=False), 5
    )


@query
def preview_cells(spark, d):
    """First rows of the draw table in a declared order."""
    return tidy(B.draw_table(spark, d).orderBy("draw", "Population", "Year").limit(6))

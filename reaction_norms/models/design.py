"""Design of a Gaussian linear model: population x cohort, plus population-specific slopes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reaction_norms.functions.lookup import level_values


@dataclass(frozen=True)
class Design:
    """``response ~ Population * Year + x + Population:x`` for every covariate x.

    Treatment coding; the first level of each factor is the reference.
    """

    response: str
    populations: tuple[str, ...]
    years: tuple[str, ...]
    covariates: tuple[str, ...] = field(default=())

    @property
    def terms(self) -> tuple[str, ...]:
        pops = [f"Population{p}" for p in self.populations[1:]]
        years = [f"Year{y}" for y in self.years[1:]]
        crossed = [f"{p}:{y}" for y in years for p in pops]
        slopes = [f"{p}:{x}" for x in self.covariates for p in pops]
        return ("Intercept", *pops, *years, *self.covariates, *crossed, *slopes)

    def active(self, population: str, year: str) -> dict[int, str | None]:
        """Terms that are not identically zero in one cell: index -> covariate, or None for 1."""
        at = {t: i for i, t in enumerate(self.terms)}
        pop = f"Population{population}" if population != self.populations[0] else None
        cohort = f"Year{year}" if year != self.years[0] else None
        out: dict[int, str | None] = {at["Intercept"]: None}
        for name in (pop, cohort, f"{pop}:{cohort}" if pop and cohort else None):
            if name:
                out[at[name]] = None
        for x in self.covariates:
            out[at[x]] = x
            if pop:
                out[at[f"{pop}:{x}"]] = x
        return out

    def cell_terms(self) -> np.ndarray:
        """Matrix from coefficients to each population's slopes and cell values, population by population."""
        rows = []
        for p in self.populations:
            slopes = self.active(p, self.years[0])
            rows += [[float(slopes.get(i, "") == x) for i in range(len(self.terms))] for x in self.covariates]
            for y in self.years:
                cell = self.active(p, y)
                rows.append([float(cell.get(i, "") is None) for i in range(len(self.terms))])
        return np.array(rows)

    def cells(self) -> list[tuple[str, str]]:
        return [(p, y) for p in self.populations for y in self.years]

    # ------------------------------------------------------------------ columns

    def is_complete(self) -> Column:
        """Whether a row has a response, every covariate and known factor levels."""
        needed = [F.col(c).isNotNull() for c in (self.response, *self.covariates)]
        levels = F.col("Population").isin(*self.populations)
        cohorts = F.col("Year").cast("string").isin(*self.years)
        return reduce(lambda a, b: a & b, [*needed, levels, cohorts])

    def complete_cases(self, df: DataFrame) -> DataFrame:
        """Listwise deletion: complete rows only."""
        return df.where(self.is_complete())

    def row(self) -> list[Column]:
        """Design row of a data frame as double columns, in term order."""
        year = F.col("Year").cast("string")
        flags: dict[str, Column] = {f"Population{p}": F.col("Population") == p for p in self.populations[1:]}
        flags.update({f"Year{y}": year == y for y in self.years[1:]})
        out = []
        for term in self.terms:
            value = F.lit(1.0)
            for part in term.split(":"):
                if part in flags:
                    value = value * flags[part].cast("double")
                elif part != "Intercept":
                    value = value * F.col(part).cast("double")
            out.append(value.alias(term))
        return out

    def matrix(self, population: np.ndarray, year: np.ndarray, values: Mapping[str, np.ndarray]) -> np.ndarray:
        """Design rows of complete rows inside a task, the same as ``row``; ``values`` has the covariates."""
        flags = {f"Population{p}": population == p for p in self.populations[1:]}
        flags.update({f"Year{y}": year == y for y in self.years[1:]})
        out = np.ones((len(population), len(self.terms)))
        for column, term in zip(out.T, self.terms):
            for part in term.split(":"):
                if part != "Intercept":
                    column *= flags[part] if part in flags else values[part]
        return out

    def cell_value(self, population: str, year: str, x: Mapping[str, Column] | None = None) -> Column:
        """Expected value of one cell from a draw's ``beta``, at given covariate values."""
        parts = []
        for i, cov in self.active(population, year).items():
            beta = F.col("beta")[i]
            parts.append(beta if cov is None else beta * (x or {}).get(cov, F.lit(0.0)))
        return reduce(lambda a, b: a + b, parts)

    def cell_slope(self, population: str, year: str, covariate: str) -> Column:
        """Slope of one cell from a draw's ``beta``."""
        own = [F.col("beta")[i] for i, c in self.active(population, year).items() if c == covariate]
        return reduce(lambda a, b: a + b, own)

    # ------------------------------------------------------------------- statistics

    def moments(self) -> Column:
        """Sufficient statistics of the complete rows of a group: count, means and central
        products of (covariates, response), as one struct of built-in aggregates."""
        ok = self.is_complete()
        cols = [F.when(ok, F.col(c).cast("double")) for c in (*self.covariates, self.response)]
        parts = [F.count_if(ok).alias("n")]
        parts += [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
        parts += [
            F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}")
            for i in range(len(cols))
            for j in range(i + 1)
        ]
        return F.struct(*parts)


def design_for(
    df: DataFrame,
    response: str,
    covariates: Sequence[str] = (),
    populations: Sequence[str] | None = None,
    years: Sequence[str] | None = None,
) -> Design:
    """Design with factor levels from the data (sorted) unless declared."""
    pops = populations or level_values(df, "Population")
    cohorts = years or [str(y) for y in level_values(df, "Year")]
    return Design(response, tuple(pops), tuple(str(y) for y in cohorts), tuple(covariates))

"""Column helpers. Each returns a built-in Spark expression: no UDF anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mean(col: str | Column, na_rm: bool = False) -> Column:
    """Group mean; with ``na_rm=False`` one missing value makes the mean missing."""
    col = _col(col)
    if na_rm:
        return F.avg(col)
    return F.when(F.count(col) == F.count(F.lit(1)), F.avg(col))


def coefficient_of_variation(col: str | Column) -> Column:
    """Sample sd over mean, missing values skipped; NULL for one row or a zero mean."""
    col = _col(col)
    return F.try_divide(F.stddev_samp(col), F.avg(col))


def share(condition: Column, na_rm: bool = False) -> Column:
    """Fraction of rows where the condition holds."""
    return mean(condition.cast("double"), na_rm)


def probability_of_difference(col: str | Column, na_rm: bool = False) -> tuple[Column, Column, Column]:
    """(share above 0, share below 0, the larger); zeros count on neither side."""
    col = _col(col)
    above, below = share(col > 0, na_rm), share(col < 0, na_rm)
    return above, below, F.greatest(above, below)


def stars(probability: str | Column) -> Column:
    """Significance stars of a probability of difference."""
    p = _col(probability)
    # The three cut points.
    return F.when(p >= 0.999, "***").when(p >= 0.99, "**").when(p >= 0.95, "*").otherwise("")


def significance(probability: str | Column, cut: float = 0.95) -> Column:
    p = _col(probability)
    return F.when(p >= cut, "Significant").when(p < cut, "Not Significant")


def censor(col: str | Column, low: float, high: float) -> Column:
    """Values outside the closed range become NULL."""
    col = _col(col)
    return F.when(col.between(low, high), col)


def level_rank(col: str | Column, levels: Sequence[str]) -> Column:
    """1-based rank in a declared level order; unlisted values are NULL."""
    found = F.array_position(F.array(*[F.lit(x) for x in levels]), _col(col).cast("string"))
    return F.nullif(found, F.lit(0).cast("bigint"))


def with_level(
    col: str | Column, levels: Sequence[str], labels: Sequence[str] | None = None
) -> Column:
    """Keep declared levels (relabelled on request); unlisted values are NULL."""
    rank = level_rank(col, levels)
    names = F.array(*[F.lit(x) for x in (labels or levels)])
    return F.when(rank.isNotNull(), F.element_at(names, rank.cast("int")))


def relevel_order(col: str | Column, first: Sequence[str]) -> list[Column]:
    """Sort keys that move the named levels to the front and leave the rest alphabetical."""
    return [level_rank(col, first).asc_nulls_last(), _col(col).asc_nulls_last()]


def key_text(*cols: str | Column, sep: str = "-") -> Column:
    """Composite key text; like text pasting, a missing part is written ``NA``."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in cols]
    return F.concat_ws(sep, *parts)


def split_key(col: str | Column, part: int, sep: str = "-") -> Column:
    """The ``part``-th (1-based) piece of a composite key."""
    return F.split_part(_col(col), F.lit(sep), F.lit(part))


def first_population(name: str | Column) -> Column:
    """Leading population code (a capital letter and a digit) of a contrast name."""
    found = F.regexp_extract(_col(name), r"^([A-Z]\d)", 1)
    return F.nullif(found, F.lit(""))


def pd_label(probability: str | Column, fixed: bool = False) -> Column:
    """Label of a probability of difference, rounded (``0.9``) or fixed (``0.90``)."""
    p = _col(probability)
    if fixed:
        return F.format_string("PD(≠0) = %.2f", p)
    text = F.regexp_replace(F.bround(p, 2).cast("string"), r"\.0$", "")
    return F.concat(F.lit("PD(≠0) = "), text)


def even_grid(low: str | Column, high: str | Column, n: int = 100) -> Column:
    """Array of ``n`` evenly spaced points from low to high."""
    low, high = _col(low), _col(high)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * (high - low) / F.lit(float(n - 1))
    )


def map_columns(
    cols: Sequence[str], fn, names: str = "{}_z"
) -> list[Column]:
    """One expression over several columns, named by a pattern."""
    return [fn(F.col(c)).alias(names.format(c)) for c in cols]

"""Exact interpolated quantiles, for draws and for data-sized groups.

Holding a group's values in one task is right for posterior draws (a fixed number,
``draw_quantiles``) and wrong for plants, where a group such as one garden grows with
the data. There (``exact_quantiles``) every wanted rank has a bracket of values that is narrowed until it holds
no more than ``LIMIT`` values; only those are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reaction_norms.functions.lookup import with_levels
from reaction_norms.session import materialize

#: Most values of a bracket, all of which one task orders.
LIMIT = 20_000
#: A sketch is off by at most 1 / ACCURACY of the ranks. First brackets add room for that; later
#: ones are cut at the GRID of evenly spaced ranks of the bracket before.
ACCURACY = 10_000
MARGIN = 8.0 / ACCURACY
GRID = 256


def draw_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Interpolated quantiles of groups that hold one value per posterior draw.

    The number of draws is a parameter of the analysis, not of the data, so a group is a
    short array; sorting it is several times faster than the hash table of ``percentile``.
    Use ``exact_quantiles`` for groups that grow with the data. ``extra`` are further aggregates.
    """
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_a"), *extra)
    others = [c for c in rows.columns if c not in (*by, "_a")]

    def at(p: float) -> Column:
        h = (F.size("_a") - 1) * F.lit(float(p))
        low = F.get("_a", F.floor(h).cast("int"))
        return low + (h - F.floor(h)) * (F.get("_a", F.ceil(h).cast("int")) - low)

    return rows.select(*by, *[at(p).alias(n) for n, p in probs.items()], *others)


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str]
) -> DataFrame:
    """One row per ``by`` group with an interpolated (type 7) quantile per name in ``probs``.

    ``by`` are factor columns, of any number of levels. A rank's bracket is cut at two values that a bounded
    sketch proposes: the rows below, at, between and above them are counted, and the count
    says exactly which part holds the rank, however wrong the sketch. Every cut
    leaves out the values at which it is made, so the narrowing ends for any data. Each is one pass; groups
    of up to ``LIMIT`` rows need none. The brackets, one row per group, are written tables.
    """
    names, wanted = list(probs), list(by)
    by = wanted or ["_all"]
    v = F.col(value).cast("double")
    data = (df if wanted else df.withColumn("_all", F.lit(1))).select(*by, v.alias("_v"))
    data = data.where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    lows = F.array(*[F.lit(max(p - MARGIN, 0.0)) for p in probs.values()])
    highs = F.array(*[F.lit(min(p + MARGIN, 1.0)) for p in probs.values()])
    sketch = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.percentile_approx("_v", lows, ACCURACY).alias("_a"),
        F.percentile_approx("_v", highs, ACCURACY).alias("_b"),
    )
    targets = []
    for i, p in enumerate(probs.values()):
        h = (F.col("_n") - 1) * F.lit(float(p))
        for j, rank in enumerate((F.floor(h), F.ceil(h))):
            part = {
                "i": F.lit(2 * i + j), "rank": rank.cast("long"), "share": h - F.floor(h), "below": F.lit(0).cast("long"),
                "inside": F.col("_n"), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"),
                "a": F.col("_a")[i], "b": F.col("_b")[i], "answer": F.lit(None).cast("double"),
            }
            targets.append(F.struct(*[c.alias(k) for k, c in part.items()]))
    state = materialize(sketch.select(*by, F.array(*targets).alias("_t")))
    while _widest(state) > LIMIT:
        state = materialize(_narrowed(data, state, by))

    # equal brackets, such as all those of a small group, are gathered once
    brackets = F.array_distinct(F.transform(F.filter("_t", lambda t: t["answer"].isNull()), lambda t: F.struct(t["lo"].alias("lo"), t["hi"].alias("hi"))))
    held = _inside(with_levels(data, state.select(*by, brackets.alias("_w")), by, ["_w"]), by, "_w")
    gathered = held.groupBy(*by, "_x.lo", "_x.hi").agg(F.sort_array(F.collect_list("_v")).alias("_all_of"))
    known = gathered.groupBy(*by).agg(F.collect_list(F.struct("lo", "hi", "_all_of")).alias("_k"))
    rows = with_levels(state, known, by, ["_k"])

    def found(t: Column) -> Column:
        mine = F.filter("_k", lambda k: k["lo"].eqNullSafe(t["lo"]) & k["hi"].eqNullSafe(t["hi"]))
        return F.coalesce(t["answer"], F.get(F.get(mine, 0)["_all_of"], (t["rank"] - t["below"]).cast("int")))

    rows = rows.withColumn("_q", F.transform("_t", lambda t: F.struct(t["i"].alias("i"), t["share"].alias("share"), found(t).alias("q"))))

    def value_at(target: int) -> Column:
        return F.filter("_q", lambda t: t["i"] == target)[0]

    def at(i: int) -> Column:
        low, high = value_at(2 * i), value_at(2 * i + 1)
        # two infinite neighbours have no difference
        return F.when(low["q"] == high["q"], low["q"]).otherwise(low["q"] + low["share"] * (high["q"] - low["q"]))

    return rows.select(*wanted, *[at(i).alias(n) for i, n in enumerate(names)])


def _widest(state: DataFrame) -> int:
    open_ = F.transform(F.filter("_t", lambda t: t["answer"].isNull()), lambda t: t["inside"])
    return state.agg(F.max(F.array_max(open_))).first()[0] or 0


def _inside(rows: DataFrame, by: Sequence[str], brackets: str) -> DataFrame:
    """Every value with each bracket (a struct with the open ends lo and hi, null: no end) that it lies in."""
    each = rows.select(*by, "_v", F.explode(brackets).alias("_x"))
    above = F.col("_x.lo").isNull() | (F.col("_v") > F.col("_x.lo"))
    return each.where(above & (F.col("_x.hi").isNull() | (F.col("_v") < F.col("_x.hi"))))


def _narrowed(data: DataFrame, state: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each bracket that is too wide, cut at its values a and b."""
    wide = F.filter("_t", lambda t: t["answer"].isNull() & (t["inside"] > LIMIT))
    rows = _inside(with_levels(data, state.select(*by, wide.alias("_w")), by, ["_w"]), by, "_w")
    v, a, b = F.col("_v"), F.col("_x.a"), F.col("_x.b")
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    parts = {"low": v < a, "mid": (v > a) & (v < b), "high": v > b}
    counts = rows.groupBy(*by, F.col("_x.i").alias("_i")).agg(
        F.count_if(v == a).alias("at_a"),
        F.count_if((v == b) & (b > a)).alias("at_b"),
        *[F.count_if(is_in).alias(k) for k, is_in in parts.items()],
        *[F.percentile_approx(F.when(is_in, v), grid, ACCURACY).alias(f"grid_{k}") for k, is_in in parts.items()],
    )
    flat = state.select(*by, F.explode("_t").alias("t")).withColumn("_i", F.col("t.i"))
    fields = ["low", "at_a", "mid", "at_b", "high", *(f"grid_{k}" for k in parts)]
    flat = with_levels(flat, counts, [*by, "_i"], fields)
    to_a = F.col("low") + F.col("at_a")
    to_b = to_a + F.col("mid") + F.col("at_b")
    r = F.col("t.rank") - F.col("t.below")

    def cut(k: str, lo: Column, hi: Column, before: Column) -> Column:
        below = F.col("t.below") + before
        place = F.floor((F.col("t.rank") - below) / F.col(k) * GRID).cast("int")
        return F.struct(
            "t.i", "t.rank", "t.share", below.alias("below"), F.col(k).alias("inside"), lo.alias("lo"), hi.alias("hi"),
            F.get(f"grid_{k}", F.greatest(place - 1, F.lit(0))).alias("a"),
            F.get(f"grid_{k}", F.least(place + 2, F.lit(GRID))).alias("b"),
            F.lit(None).cast("double").alias("answer"),
        )

    settled = lambda value: F.col("t").withField("answer", value)
    ends = F.col("t.lo"), F.col("t.a"), F.col("t.b"), F.col("t.hi")
    new = (
        F.when(F.col("low").isNull(), F.col("t"))
        .when(r < F.col("low"), cut("low", ends[0], ends[1], F.lit(0)))
        .when(r < to_a, settled(ends[1]))
        .when(r < to_a + F.col("mid"), cut("mid", ends[1], ends[2], to_a))
        .when(r < to_b, settled(ends[2]))
        .otherwise(cut("high", ends[2], ends[3], to_b))
    )
    return flat.select(*by, new.alias("t")).groupBy(*by).agg(F.collect_list("t").alias("_t"))

"""Exact order statistics of large groups, without a group's values in one buffer.

A sketch per group brackets each wanted rank; one pass counts the values below each bracket and tallies those inside it, equal values
as one row. Brackets that still hold more distinct values than `limit` are cut into ranges, the ranges are counted, and only those that
hold the wanted ranks stay, until a bracket fits one sort. So no task holds more than `limit` values of a group, however large the
group, and a value that fills a third of a group is one row.

Values are compared in double precision while brackets are narrowed and as they are in the last step, so integers beyond 2**53 are exact too.
Nulls and NaN take no part; groups without other values have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelathe.operators.written import written

#: The sketch's rank error is 1 / ACCURACY of a group; brackets reach out four times as far. Groups of fewer rows are one bracket.
ACCURACY = 10_000
#: Distinct values of one bracket that a task sorts at most.
LIMIT = 100_000
RANGES = 64


def null_safe(left: list[Column], right: list[Column]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & a.eqNullSafe(b)
    return on


def _joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the other table's columns, by keys of which some may be null."""
    right = other.select(*(F.col(k).alias(f"_of{k}") for k in keys), *(c for c in other.columns if c not in keys))
    return rows.join(right, null_safe([F.col(k) for k in keys], [F.col(f"_of{k}") for k in keys])).drop(*(f"_of{k}" for k in keys))


def order_statistics(rows: DataFrame, keys: list[str], value: str, quantiles: list[float], accuracy: int = ACCURACY, limit: int = LIMIT) -> DataFrame:
    """Per group and quantile q (column `j`: its place in the list) the values at ranks floor and ceil of q (n - 1).

    Columns: keys, j, n, low, high (values), below_low, below_high (how many values are smaller), equal_low, equal_high (how many are equal).
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    base = rows.select(*(F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)), F.col(value).alias("_v"), F.col(value).cast("double").alias("_d")).filter("_d is not null and not isnan(_d)")
    reach = 4 / accuracy  # the sketch's error, and the two ranks beside a quantile
    edges = [x for q in quantiles for x in (max(0.0, q - reach), min(1.0, q + reach))]
    sketch = F.percentile_approx("_d", edges, accuracy)
    groups = base.groupBy(*ks).agg(F.count("_v").alias("n"), F.min("_d").alias("_min"), F.max("_d").alias("_max"), sketch.alias("_edges"))
    few, n = F.col("n") <= accuracy, F.col("n") - 1
    edge = lambda i, whole: F.when(few, F.col(whole)).otherwise(F.col("_edges")[i])
    wanted = F.array(*(F.struct(F.lit(j).alias("j"), F.floor(F.lit(q) * n).alias("r0"), F.ceil(F.lit(q) * n).alias("r1"), edge(2 * j, "_min").alias("lo"), edge(2 * j + 1, "_max").alias("hi")) for j, q in enumerate(quantiles)))
    groups = written(groups.select(*ks, "n", wanted.alias("_wanted")))
    # A row counts below a bracket (null), inside it (its value), or not at all; equal ones meet before the shuffle.
    places = F.expr("transform(filter(_wanted, w -> _d <= w.hi), w -> struct(w.j as j, if(_d < w.lo, null, _v) as v))")
    tally = _joined(base, groups, ks).select(*ks, F.explode(places).alias("_p")).groupBy(*ks, "_p.j", "_p.v").agg(F.count(F.lit(1)).alias("c"))
    tally = written(tally)
    asked = groups.select(*ks, "n", F.explode("_wanted").alias("_w")).select(*ks, "n", "_w.j", "_w.r0", "_w.r1")
    below = tally.filter("v is null").select(*ks, "j", F.col("c").alias("below"))
    inside = tally.filter("v is not null")
    held = [*ks, "j"]
    state = _joined(inside, asked, held)
    right = below.select(*(F.col(k).alias(f"_of{k}") for k in held), "below")
    state = state.join(right, null_safe([F.col(k) for k in held], [F.col(f"_of{k}") for k in held]), "left").select(*held, "n", "r0", "r1", F.coalesce("below", F.lit(0)).alias("below"), "v", "c")
    last, most_rows = None, groups.agg(F.max("n")).first()[0] or 0
    # A bracket holds at most 10 / accuracy of a group, or a group of at most `accuracy` rows.
    while accuracy > limit or 10 * most_rows > limit * accuracy:
        most = state.groupBy(*held).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0]
        if most is None or most <= limit or most == last:
            break
        last, state = most, written(_narrowed(state, held, limit, accuracy))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*held).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
    placed = state.withColumn("_at", before)
    hit = lambda r, c: F.max(F.when((F.col("_at") <= F.col(r)) & (F.col(r) < F.col("_at") + F.col("c")), F.col(c)))
    found = placed.groupBy(*held, "n").agg(*(hit(r, c).alias(f"{name}{end}") for r, end in (("r0", "low"), ("r1", "high")) for c, name in (("v", ""), ("_at", "below_"), ("c", "equal_"))))
    return found.select(*(F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)), "j", "n", "low", "high", "below_low", "below_high", "equal_low", "equal_high")


def _narrowed(state: DataFrame, held: list[str], limit: int, accuracy: int) -> DataFrame:
    """Brackets of more than `limit` distinct values cut to the ranges that hold their wanted ranks."""
    d = F.col("v").cast("double")
    cuts = F.percentile_approx(d, [k / RANGES for k in range(1, RANGES)], accuracy)
    large = state.groupBy(*held).agg(F.count(F.lit(1)).alias("_m"), cuts.alias("_cuts"))
    ranged = _joined(state, large, held).withColumn("_d", d).withColumn("_range", F.when(F.col("_m") > limit, F.expr("size(filter(_cuts, x -> x < _d))")).otherwise(0)).drop("_cuts", "_m", "_d")
    sums = ranged.groupBy(*held, "_range", "below", "r0", "r1").agg(F.sum("c").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*held).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
    kept = sums.withColumn("_from", before).filter("_from <= r1 and r0 < _from + _c")
    kept = kept.select(*held, "_range", F.min("_from").over(Window.partitionBy(*held)).alias("_below"))
    return _joined(ranged, kept, [*held, "_range"]).withColumn("below", F.col("_below")).drop("_range", "_below")


def quantiles(rows: DataFrame, keys: list[str], value: str, names: dict[str, float], **options) -> DataFrame:
    """Keys and a column of each name: the exact quantile, between two values in proportion, as `percentile` has it."""
    qs = list(names.values())
    found = order_statistics(rows, keys, value, qs, **options)
    q = F.element_at(F.array(*(F.lit(float(x)) for x in qs)), F.col("j") + 1)
    at = q * (F.col("n") - 1)
    low, high = (F.col(c).cast("double") for c in ("low", "high"))
    exact = found.withColumn("_q", low + (high - low) * (at - F.floor(at)))
    return exact.groupBy(*keys).agg(*(F.max(F.when(F.col("j") == j, F.col("_q"))).alias(name) for j, name in enumerate(names)))


def _apart(a: Column, b: Column) -> Column:
    """a - b as a double; of integers exact before it is rounded."""
    return F.coalesce(F.try_subtract(a, b).cast("double"), a.cast("double") - b.cast("double"))


def trimmed(rows: DataFrame, keys: list[str], value: str, **options) -> DataFrame:
    """Mean, sample deviation and count of the values from rank floor((n - 1) / 4) to floor(3 (n - 1) / 4): keys, mean, sd, n.

    Values between the two bounds count whole, those equal to a bound as often as their ranks lie inside. Deviations are summed from the
    middle of the bounds, so they don't cancel.
    """
    found = order_statistics(rows, keys, value, [0.25, 0.75], **options)
    side = lambda j, c: F.max(F.when(F.col("j") == j, F.col(c)))
    bounds = found.groupBy(*keys).agg(F.max("n").alias("_n"), side(0, "low").alias("_lo"), side(1, "low").alias("_hi"), (side(0, "below_low") + side(0, "equal_low")).alias("_past_lo"), side(1, "below_low").alias("_before_hi"))
    r0, r1 = (F.floor(F.lit(q) * (F.col("_n") - 1)) for q in (0.25, 0.75))
    bounds = bounds.select(*keys, "_lo", "_hi", (_apart(F.col("_hi"), F.col("_lo")) / 2).alias("_half"), F.when(F.col("_lo") == F.col("_hi"), r1 - r0 + 1).otherwise(F.col("_past_lo") - r0).alias("_w_lo"), F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(r1 - F.col("_before_hi") + 1).alias("_w_hi"))
    ks = [f"_k{i}" for i in range(len(keys))]
    base = rows.select(*(F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)), F.col(value).alias("_v"))
    named = bounds.select(*(F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)), *(c for c in bounds.columns if c not in keys))
    inner = _joined(base, named, ks).filter("_v > _lo and _v < _hi").withColumn("_x", _apart(F.col("_v"), F.col("_lo")) - F.col("_half"))
    sums = inner.groupBy(*ks).agg(F.count("_x").alias("_c"), F.sum("_x").alias("_s"), F.sum(F.col("_x") * F.col("_x")).alias("_ss"))
    right = sums.select(*(F.col(k).alias(f"_of{k}") for k in ks), "_c", "_s", "_ss")
    both = named.join(right, null_safe([F.col(k) for k in ks], [F.col(f"_of{k}") for k in ks]), "left")
    lo, hi = -F.col("_half"), F.col("_half")
    n = F.coalesce("_c", F.lit(0)) + F.col("_w_lo") + F.col("_w_hi")
    s = F.coalesce("_s", F.lit(0.0)) + F.col("_w_lo") * lo + F.col("_w_hi") * hi
    ss = F.coalesce("_ss", F.lit(0.0)) + F.col("_w_lo") * lo * lo + F.col("_w_hi") * hi * hi
    sd = F.when(n > 1, F.sqrt(F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0))))
    return both.select(*(F.col(a).alias(k) for k, a in zip(keys, ks, strict=True)), (F.col("_lo").cast("double") + (F.col("_half") + s / n)).alias("mean"), sd.alias("sd"), n.alias("n"))

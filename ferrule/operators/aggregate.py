"""Statistics of columns, predictions and groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ferrule.plans.ranking import ranked
from ferrule.plans.staging import staged

from .filters import is_missing


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column, cell)``, one per cell."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("cell")) for c in columns])).alias("p")).select("p.*")


def average(df: DataFrame, columns: Sequence[str], missing: str = ".", special: float | None = None, absolute: bool = False) -> DataFrame:
    """Per column: n, n_missing, minval, maxval, total, mean, sd (sample), and n_special of a value asked for."""
    long = unpivot(df, columns)
    gone = is_missing(F.col("cell"), missing)
    x = F.when(~gone, F.col("cell").cast("double"))
    x = F.abs(x) if absolute else x
    out = [F.count(x).alias("n"), F.sum(gone.cast("long")).alias("n_missing"), F.min(x).alias("minval"), F.max(x).alias("maxval"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")]
    if special is not None:
        out.append(F.sum((x == special).cast("long")).alias("n_special"))
    return long.groupBy("column").agg(*out)


def percentiles(df: DataFrame, column: str, percents: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """Rows ``(group, percent, value)``: the sorted value at index int(p n / 100 + 0.4999), at most the last.

    Ranks come from counts of distinct values, so no group is gathered in one row."""
    cells = df.where(F.col(column).isNotNull()).groupBy(*group, F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    ranked = cells.withColumn("upto", F.sum("k").over(w.orderBy("x"))).withColumn("n", F.sum("k").over(w))
    want = F.explode(F.array(*[F.lit(float(p)) for p in percents]))
    index = F.least((F.col("percent") * F.col("n") / 100 + 0.4999).cast("long"), F.col("n") - 1)
    hit = ranked.select("*", want.alias("percent")).where((index < F.col("upto")) & (index >= F.col("upto") - F.col("k")))
    return hit.select(*group, "percent", F.col("x").alias("value"))


def distribution(df: DataFrame, column: str, accuracy: float | None = None, to_integer: bool = False, normalise: str | None = None, zero_bins: bool = False) -> DataFrame:
    """Rows ``(value, n)`` or ``(value, n, share)``: counts of rounded values.

    ``normalise``: ``area`` shares sum to 1, ``peak`` the largest is 1.
    ``zero_bins`` adds the values between, one step apart, that do not occur.
    """
    x = F.col(column).cast("double")
    step = 1.0 if to_integer else accuracy
    v = F.floor(x / step + 0.5) if step else x
    out = df.where(x.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    if zero_bins:
        if not step:
            raise ValueError("zero bins need a step")
        span = out.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("v"))
        out = span.join(out, "v", "left").select("v", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    value = (F.col("v") * step if step else F.col("v")).cast("double").alias("value")
    if not normalise:
        return out.select(value, "n")
    whole = out.agg((F.sum("n") if normalise == "area" else F.max("n")).alias("t"))
    return out.crossJoin(F.broadcast(whole)).select(value, "n", (F.col("n") / F.col("t")).alias("share"))  # one row


def histogram(df: DataFrame, column: str, low: float, high: float, dx: float) -> DataFrame:
    """Rows ``(bucket, n)`` of fixed buckets; values outside are not counted, ``high`` itself is in the last."""
    x = F.col(column).cast("double")
    last = int(round((high - low) / dx)) - 1
    bucket = F.least(F.floor((x - low) / dx), F.lit(last)).cast("int")
    return df.where((x >= low) & (x <= high)).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fuzzy_histogram(df: DataFrame, column: str, low: float, high: float, dx: float, minus: int = 0, plus: int = 0) -> DataFrame:
    """Rows ``(bucket, n)``: each value counts in full in its nearest bucket (halves to even) and in its neighbours.

    Buckets run from 0 to round((high - low) / dx).  ``minus`` buckets below
    count too, and those above up to, not including, home + ``plus``.  Values
    outside low to high are not counted.
    """
    x = F.col(column).cast("double")
    last = int(round((high - low) / dx))
    home = F.rint((x - low) / dx).cast("int")
    steps = range(-minus, max(1, plus))
    near = F.explode(F.array(*[home + k for k in steps])).alias("bucket")
    inside = df.where((x >= low) & (x <= high)).select(near).where((F.col("bucket") >= 0) & (F.col("bucket") <= last))
    return inside.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def prevalence_average(df: DataFrame, value: str, weight: str, group: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of a column."""
    x, w = F.col(value).cast("double"), F.col(weight).cast("double")
    both = x.isNotNull() & w.isNotNull()
    return df.where(both).groupBy(*group).agg((F.sum(x * w) / F.sum(w)).alias("weighted_mean"), F.sum(w).alias("weight"))


# Predictions against observations.


#: The three coefficients of the mean significant ratio at its two confidence levels.
CMSR = {95: (1.645, 0.325, 4.134), 90: (1.274, 0.382, 3.448)}


def _at_index(rows: DataFrame, names: Sequence[str], value: str, places: Mapping[str, Column]) -> DataFrame:
    """Per group the values at 0-based indices of their sorted order; ``places`` are made from the group's size ``n``."""
    order = ranked(rows.select(*names, value, "i"), names, [value, "i"])
    n = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    here = order.join(n, list(names))
    return here.groupBy(*names).agg(*[F.max(F.when(F.col("rank") - 1 == at, F.col(value))).alias(k) for k, at in places.items()])


def regression_metrics(
    df: DataFrame,
    obs: str,
    pred: str,
    id_column: str,
    group: Sequence[str] = (),
    first: int | None = None,
    percent: float | None = None,
    folds: Sequence[float] = (),
    ratios: Sequence[float] = (),
    cmsr: int | None = None,
) -> DataFrame:
    """Per group: n, mae, rmse, bias, r2, q2, ae50, ae95, maxerr and what is asked for beside them.

    Rows are taken by predicted value, largest first; ``first`` limits each
    group to its best, ``percent`` to that share (p n / 99.999, cut).  r2 is
    the squared correlation with its sign; q2 is 1 - SSE/SST, or SST/SSE - 1
    if SSE is the greater.  ae50 and ae95 are the absolute errors at index n/2
    and 95 n/100 of their sorted order.  ``folds`` adds ``within_<i>``, the
    share of rows with an absolute error below each; ``ratios`` adds
    ``ratio_<i>``, the share whose greater value is less than that multiple of
    the lesser (values below 1e-4 or of two signs never are).  ``cmsr``, 90 or
    95, adds ``cmsr_sd``, ``cmsr_mad`` and ``cmsd``: with b the mean
    difference and s its standard deviation, or 1.4826 times the median
    deviation from the median, b + (v1 + v2 exp(-v3 b / s)) s, as a power of
    ten in the first two.  Rows with a null in either column do not count.
    """
    names = list(group) or ["__all"]
    o, p = F.col(obs).cast("double"), F.col(pred).cast("double")
    keys = [F.col(g) for g in group] or [F.lit(0).alias("__all")]
    rows = df.where(o.isNotNull() & p.isNotNull()).select(*keys, o.alias("o"), p.alias("p"), F.col(id_column).alias("i"))
    if first is not None or percent is not None:
        rows = ranked(rows, names, [F.desc("p"), "i"])
        if percent is not None:
            total = rows.groupBy(*names).agg(F.floor(F.count(F.lit(1)) * percent / 99.999).alias("most"))
            rows = rows.join(total, names).where("rank <= most").drop("most")
        if first is not None:
            rows = rows.where(F.col("rank") <= first)
    err = F.col("o") - F.col("p")
    rows = rows.withColumns({"e": F.abs(err), "d": err})
    big, small = F.greatest(F.abs("o"), F.abs("p")), F.least(F.abs("o"), F.abs("p"))
    alike = (small >= 1e-4) & (F.col("o") * F.col("p") > 0)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    sums = rows.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("e").alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg("o") - F.avg("p")).alias("bias"),
        F.corr("o", "p").alias("c"),
        F.sum(err * err).alias("sse"),
        (F.var_pop("o") * F.count(F.lit(1))).alias("sst"),
        F.max("e").alias("maxerr"),
        F.stddev_samp("d").alias("sd"),
        *[share(F.col("e") < f).alias(f"within_{i}") for i, f in enumerate(folds)],
        *[share(alike & (big / small < f)).alias(f"ratio_{i}") for i, f in enumerate(ratios)],
    )
    n = F.col("n")
    sums = sums.join(_at_index(rows, names, "e", {"ae50": F.floor(n / 2), "ae95": F.floor(n * 95 / 100)}), names)
    out = ["ae50", "ae95", "maxerr", *[f"within_{i}" for i in range(len(folds))], *[f"ratio_{i}" for i in range(len(ratios))]]
    if cmsr is not None:
        middle = _at_index(rows, names, "d", {"median": F.floor(n / 2)})
        off = rows.join(middle, names).withColumn("off", F.abs(F.col("d") - F.col("median")))
        sums = sums.join(_at_index(off, names, "off", {"off": F.floor(n / 2)}), names)
        v1, v2, v3 = CMSR[cmsr]
        away, mad = F.abs("bias"), F.col("off") * 1.4826
        span = lambda s: away + (v1 + v2 * F.exp(-v3 * away / s)) * s
        sums = sums.withColumns({"cmsr_sd": F.pow(F.lit(10.0), span(F.col("sd"))), "cmsr_mad": F.pow(F.lit(10.0), span(mad)), "cmsd": span(mad)})
        out += ["cmsr_sd", "cmsr_mad", "cmsd"]
    q2 = F.when(F.col("sse") <= F.col("sst"), 1 - F.col("sse") / F.col("sst")).otherwise(F.col("sst") / F.col("sse") - 1)
    return sums.select(*group, "n", "mae", "rmse", "bias", (F.signum("c") * F.col("c") * F.col("c") + 0.0).alias("r2"), q2.alias("q2"), *out)


def _rank_depths(df: DataFrame, obs: str, pred: str, id_column: str, group: str) -> DataFrame:
    """Per group and depth: the running means of the observed values in predicted, best and worst order, as y, hi and lo.

    Also m, the group's mean, n, and ``spread``, its greatest less its least value."""
    cols = [F.col(group).alias("g"), F.col(obs).cast("double").alias("o"), F.col(pred).cast("double").alias("p"), F.col(id_column).alias("i")]
    rows = df.select(*cols).where("o is not null and p is not null")
    whole = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("t"), F.avg("o").alias("m"), (F.max("o") - F.min("o")).alias("spread"))
    best = staged(ranked(rows.select("g", "o", "i"), ["g"], [F.desc("o"), "i"], sums={"s": "o"}).select("g", "rank", "s"), "best")
    worst = best.select("g", "rank", "s").union(whole.select("g", F.lit(0).cast("long"), F.lit(0.0))).join(whole.select("g", "n", "t"), "g")
    # The i least values are all but the n - i greatest.
    worst = worst.where("rank < n").select("g", (F.col("n") - F.col("rank")).alias("rank"), (F.col("t") - F.col("s")).alias("w"))
    own = ranked(rows.select("g", "o", "p", "i"), ["g"], [F.desc("p"), "i"], sums={"a": "o"}).select("g", "rank", "a")
    both = own.join(best, ["g", "rank"]).join(worst, ["g", "rank"]).join(whole.drop("t"), "g")
    r = F.col("rank")
    return both.select("g", "rank", "n", "m", "spread", (F.col("a") / r).alias("y"), (F.col("s") / r).alias("hi"), (F.col("w") / r).alias("lo"))


def _depth_terms(depths: DataFrame, least: Column) -> DataFrame:
    """With ``wt``, the span of the depth, and ``term``, its weighted share; null where the depth tells nothing."""
    y, m = F.col("y"), F.col("m")
    room = F.when(y > m, F.col("hi") - m).otherwise(m - F.col("lo"))
    # At the last depth all three orders have the mean; sums in another order may miss it by a rounding error.
    told = (F.col("rank") < F.col("n")) & (F.abs(y - m) > F.col("spread") * 1e-9) & (room >= least)
    return depths.withColumn("wt", F.col("hi") - F.col("lo")).withColumn("term", F.when(told, (y - m) / room * F.col("wt")))


def b_squared(df: DataFrame, obs: str, pred: str, id_column: str, group: str) -> DataFrame:
    """Per group: n and b2, how well the predicted order ranks the observed values: 1 as the best order, -1 as the worst.

    At every depth the running mean in predicted order is set against the mean
    of all, as a share of the way to the best order's running mean if above it
    and to the worst order's if below.  Shares are weighted by the distance of
    best and worst; depths at the mean itself, or with no way to go, tell
    nothing.  A group without any such depth has 0.
    """
    terms = _depth_terms(_rank_depths(df, obs, pred, id_column, group), F.lit(1e-5))
    told = F.when(F.col("term").isNotNull(), F.col("wt"))
    b2 = F.coalesce(F.sum("term") / F.sum(told), F.lit(0.0))
    return terms.groupBy("g").agg(F.max("n").alias("n"), b2.alias("b2")).withColumnRenamed("g", group)


def b_squared_curve(df: DataFrame, obs: str, pred: str, id_column: str, group: str) -> DataFrame:
    """Per group and depth: rank and b2 of the rows so far; a depth that tells nothing repeats the one before.

    Every depth adds to the weights; the first depths have 0 until one tells."""
    terms = _depth_terms(_rank_depths(df, obs, pred, id_column, group), F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0) * 1e-5)
    run = staged(ranked(terms.select("g", "rank", "wt", "term").withColumnRenamed("rank", "depth"), ["g"], ["depth"], sums={"ws": "wt", "ts": "term"}), "curve")
    run = run.withColumn("seen", F.when(F.col("term").isNotNull(), F.col("ws"))).drop("rank")
    # Weights only grow, so that at the last telling depth is the greatest so far.
    last = ranked(run, ["g"], ["depth"], peaks={"upto": "seen"})
    return last.select(F.col("g").alias(group), F.col("depth").alias("rank"), F.coalesce(F.col("ts") / F.col("upto"), F.lit(0.0)).alias("b2"))


def enrichment(df: DataFrame, score: str, active: str, id_column: str, group: str, alpha: float = 20.0, fraction: float = 0.1) -> DataFrame:
    """Per group: n, actives, roc, rie, bedroc, ef (at ``fraction``) and auac of actives ranked by score, best first.

    Groups without an active or an inactive row are left out."""
    rows = df.select(F.col(group), F.col(active).cast("int").alias("act"), F.col(score).alias("_score"), F.col(id_column).alias("_id"))
    rows = ranked(rows, [group], [F.desc("_score"), "_id"])
    total = rows.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("N"))
    rows = rows.join(total, F.col(group).eqNullSafe(F.col("_g"))).withColumnRenamed("rank", "r")
    hit = F.col("act") == 1
    agg = rows.groupBy(group).agg(
        F.max("N").alias("n"),
        F.sum("act").cast("long").alias("actives"),
        F.sum(F.when(hit, F.col("r"))).alias("rs"),
        F.sum(F.when(hit, F.exp(-alpha * F.col("r") / F.col("N")))).alias("es"),
        F.sum(F.when(hit & (F.col("r") <= F.floor(F.col("N") * fraction)), 1).otherwise(0)).alias("top"),
    )
    big, k = F.col("n").cast("double"), F.col("actives").cast("double")
    auac = 1 - F.col("rs") / (k * big) + 0.5 / big
    ra = k / big
    # The area under the curve of actives against inactives; a perfect ranking has 1.
    roc = (auac - ra / 2) / (1 - ra)
    rie = F.col("es") / k / ((1 - F.exp(F.lit(-alpha))) / (big * (F.exp(alpha / big) - 1)))
    half = F.lit(alpha / 2)
    bedroc = rie * ra * F.sinh(half) / (F.cosh(half) - F.cosh(half - alpha * ra)) + 1 / (1 - F.exp(alpha * (1 - ra)))
    ef = F.col("top") / (k * fraction)
    return agg.where("actives > 0 and actives < n").select(group, "n", "actives", roc.alias("roc"), rie.alias("rie"), bedroc.alias("bedroc"), ef.alias("ef"), auac.alias("auac"))


def mispredicted(truth: DataFrame, predictions: Sequence[DataFrame], id_column: str, value: str) -> DataFrame:
    """Per identifier, worst first: n predictions, mean and largest absolute error."""
    long = None
    for p in predictions:
        part = p.select(id_column, F.col(value).cast("double").alias("p"))
        long = part if long is None else long.union(part)
    e = F.abs(F.col("p") - F.col("t"))
    both = long.join(truth.select(id_column, F.col(value).cast("double").alias("t")), id_column)
    return both.groupBy(id_column).agg(F.count("p").alias("n"), F.avg(e).alias("mean_error"), F.max(e).alias("worst_error"))


def confusion_matrix(df: DataFrame, obs: str, pred: str) -> DataFrame:
    """Rows ``(observed, predicted, n)``."""
    return df.groupBy(F.col(obs).alias("observed"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


# Groups.


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def activity_consistency(df: DataFrame, key: str, activity: str, id_column: str, order: str, tolerance: float | None = None, ratio: bool = False, merge: str = "ave") -> tuple[DataFrame, DataFrame]:
    """(groups, merged): statistics of each structure's activities, and one row per structure.

    ``groups``: key, n, minval, maxval, mean, consistent (range within the
    tolerance, absolute or as a share of the maximum).  ``merged``: the item
    with the largest activity (``max``), that closest to the mean carrying the
    mean (``ave``), the ``median`` item, the first of those agreeing with the
    most common activity (``vote``), or the first with the ``range``.
    """
    a = F.col(activity).cast("double")
    rows = df.select(F.col(key).alias("key"), a.alias("a"), F.col(id_column).alias("id"), F.col(order).alias("o")).where("a is not null")
    spread = F.col("maxval") - F.col("minval")
    off = spread / F.col("maxval") if ratio else spread
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("minval"), F.max("a").alias("maxval"), F.avg("a").alias("mean"))
    groups = groups.withColumn("consistent", F.lit(True) if tolerance is None else off <= tolerance)
    w = W.partitionBy("key")
    if merge == "max":
        picked = rows.withColumn("r", F.row_number().over(w.orderBy(F.desc("a"), "o"))).where("r = 1").select("key", "id", F.col("a").alias("activity"))
    elif merge == "median":
        ranked = rows.withColumn("r", F.row_number().over(w.orderBy("a", "o")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
        picked = ranked.where("r = floor(n / 2)").select("key", "id", F.col("a").alias("activity"))
    elif merge == "vote":
        votes = rows.groupBy("key", "a").agg(F.count(F.lit(1)).alias("v"), F.min(F.struct("o", "id")).alias("f"))
        picked = votes.withColumn("r", F.row_number().over(w.orderBy(F.desc("v"), "a"))).where("r = 1").select("key", F.col("f.id").alias("id"), F.col("a").alias("activity"))
    elif merge == "range":
        picked = rows.groupBy("key").agg(F.min(F.struct("o", "id"))["id"].alias("id"), (F.max("a") - F.min("a")).alias("activity"))
    elif merge == "ave":
        near = rows.withColumn("m", F.avg("a").over(w))
        picked = near.withColumn("r", F.row_number().over(w.orderBy(F.abs(F.col("a") - F.col("m")), "o"))).where("r = 1").select("key", "id", F.col("m").alias("activity"))
    else:
        raise ValueError(merge)
    return groups, picked


def common_names(df: DataFrame, key: str, name: str, order: str, sep: str = ":", first_and_count: bool = False) -> DataFrame:
    """Rows ``(key, names, n)``: the names of each structure in input order, joined, or the first and their number."""
    g = df.groupBy(F.col(key).alias("key"))
    if first_and_count:
        return g.agg(F.min(F.struct(order, name))[name].alias("names"), F.count(F.lit(1)).alias("n"))
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("v")))), lambda x: x["v"])
    return g.agg(F.array_join(names, sep).alias("names"), F.count(F.lit(1)).alias("n"))


def reason_summary(df: DataFrame, reason: Column, id_column: str) -> DataFrame:
    """Rows ``(reason, n, share, example)`` of rejections."""
    total = df.agg(F.count(F.lit(1)).alias("t"))
    out = df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("example"))
    return out.crossJoin(F.broadcast(total)).select("reason", "n", (F.col("n") / F.col("t")).alias("share"), "example")  # one row

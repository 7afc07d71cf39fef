"""Statistics of bits against activities, naive Bayes and kernel scores, over long fingerprints (id, bit, cnt)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def profile_activity(fp: DataFrame, activity: DataFrame, id_column: str, value: str, support: int = 1) -> DataFrame:
    """Per bit: n, mean activity of records with and without it, and Welch's t of the difference; most significant first
    is for the caller to order.  The complement is the total less the bit's own sums."""
    act = activity.select(F.col(id_column).alias("id"), F.col(value).cast("double").alias("y")).where("y is not null")
    known = fp.select("id", "bit").distinct().join(act, "id")
    whole = fp.select("id").distinct().join(act, "id").agg(F.count("y").alias("n_all"), F.sum("y").alias("s_all"), F.sum(F.col("y") * F.col("y")).alias("q_all"))
    per = known.groupBy("bit").agg(F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).where(F.col("n") >= support)
    x = per.crossJoin(F.broadcast(whole))  # one row
    m = F.col("n_all") - F.col("n")
    mean1, mean0 = F.col("s") / F.col("n"), F.when(m > 0, (F.col("s_all") - F.col("s")) / m)
    var1 = F.when(F.col("n") > 1, F.greatest((F.col("q") - F.col("n") * mean1 * mean1) / (F.col("n") - 1), F.lit(0.0)))
    var0 = F.when(m > 1, F.greatest((F.col("q_all") - F.col("q") - m * mean0 * mean0) / (m - 1), F.lit(0.0)))
    se = F.sqrt(var1 / F.col("n") + var0 / m)
    return x.select("bit", "n", mean1.alias("mean_with"), mean0.alias("mean_without"), F.when(se > 0, (mean1 - mean0) / se).alias("t"))


def profile_classes(fp: DataFrame, activity: DataFrame, id_column: str, label: str, support: int = 1) -> DataFrame:
    """Rows ``(bit, label, n, share)``: class membership of the records with each bit."""
    act = activity.select(F.col(id_column).alias("id"), F.col(label).alias("label"))
    counts = fp.select("id", "bit").distinct().join(act, "id").groupBy("bit", "label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("bit").agg(F.sum("n").alias("t")).where(F.col("t") >= support)
    return counts.join(total, "bit").select("bit", "label", "n", (F.col("n") / F.col("t")).alias("share"))


def modal_fingerprint(fp: DataFrame, pairs: bool = False) -> DataFrame:
    """Rows ``(bit, n, total)``: records and counts of each bit; with ``pairs`` rows ``(bit, bit2, n)`` of bits set together."""
    if not pairs:
        return fp.groupBy("bit").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").cast("long").alias("total"))
    other = fp.select("id", F.col("bit").alias("bit2"))
    return fp.select("id", "bit").join(other, "id").where("bit < bit2").groupBy("bit", "bit2").agg(F.count(F.lit(1)).alias("n"))


def train_bayes(fp: DataFrame, classes: DataFrame, id_column: str, label: str, laplace: float = 1.0) -> DataFrame:
    """Rows ``(bit, label, w)``: w = ln((n_cb + L) / (N_b P_c + L)) of each bit and class."""
    y = classes.select(F.col(id_column).alias("id"), F.col(label).alias("label"))
    rows = fp.select("id", "bit").distinct().join(y, "id")
    prior = y.groupBy("label").agg(F.count(F.lit(1)).alias("nc")).crossJoin(F.broadcast(y.agg(F.count(F.lit(1)).alias("n"))))
    prior = prior.select("label", (F.col("nc") / F.col("n")).alias("p"))
    per = rows.groupBy("bit").agg(F.count(F.lit(1)).alias("nb"))
    both = rows.groupBy("bit", "label").agg(F.count(F.lit(1)).alias("ncb"))
    # Every class of every bit: the classes are a handful.
    grid = per.crossJoin(prior)
    x = grid.join(both, ["bit", "label"], "left")
    return x.select("bit", "label", F.log((F.coalesce("ncb", F.lit(0)) + laplace) / (F.col("nb") * F.col("p") + laplace)).alias("w"))


def bayes_scores(fp: DataFrame, model: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Rows ``(id, label, score)``: the sum of weights over set bits, plus ln of the prior if given (label, p)."""
    s = fp.select("id", "bit").distinct().join(model, "bit").groupBy("id", "label").agg(F.sum("w").alias("score"))
    return s if prior is None else s.join(prior, "label").select("id", "label", (F.col("score") + F.log("p")).alias("score"))


def classify(scores: DataFrame) -> DataFrame:
    """Rows ``(id, label, score)``: the best class; ties go to the lesser label."""
    best = scores.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("b"))
    return best.select("id", F.col("b.label").alias("label"), (-F.col("b.s")).alias("score"))


def cross_validate(fp: DataFrame, classes: DataFrame, id_column: str, label: str, folds: int, seed: int = 0) -> DataFrame:
    """Rows ``(id, fold, label, score)``: each record scored by the model of the other folds; all folds in one plan."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % folds
    out = None
    y = classes.select(F.col(id_column).alias("id"), F.col(label).alias("label")).withColumn("fold", h.cast("int"))
    for k in range(folds):
        train, test = y.where(F.col("fold") != k), y.where(F.col("fold") == k)
        model = train_bayes(fp.join(train.select("id"), "id", "left_semi"), train, "id", "label")
        part = classify(bayes_scores(fp.join(test.select("id"), "id", "left_semi"), model)).withColumn("fold", F.lit(k))
        out = part if out is None else out.union(part)
    return out.select("id", "fold", "label", "score")


def kernel_scores(pairs: DataFrame, weights: DataFrame, bias: float = 0.0) -> DataFrame:
    """Rows ``(id, score)``: sum of weight times Tanimoto over support vectors, less the bias.

    ``pairs``: (needle, hay, d) of records to support vectors; ``weights``: (hay, w)."""
    return pairs.join(weights, "hay").groupBy(F.col("needle").alias("id")).agg((F.sum(F.col("w") * (1 - F.col("d"))) - bias).alias("score"))


def weighted_bits(fp: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows ``(id, score)``: counts times trained weights (bit, w)."""
    return fp.join(weights, "bit").groupBy("id").agg(F.sum(F.col("cnt") * F.col("w")).alias("score"))


def accuracy(df: DataFrame, observed: Column, predicted: Column, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group).agg(F.avg((observed == predicted).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))

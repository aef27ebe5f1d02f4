"""Exact ranking metrics, threshold search, deciles and error mining over scored pairs.

A scored frame has a label ``y`` of 0 and 1 and a ``score``.  Curves are built
on distinct scores, so tied scores are one threshold; sums are taken over the
aggregated scores, rounded into cells first where a window must hold them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def at_threshold(threshold: float) -> Column:
    return (F.col("score") >= threshold).cast("int")


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """One row: cells, precision, recall and F1; a share of nothing is 0."""
    p, y = at_threshold(threshold), F.col("y")
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    cells = scored.agg(count((p == 1) & (y == 1)).alias("tp"), count((p == 1) & (y == 0)).alias("fp"), count((p == 0) & (y == 1)).alias("fn"), count((p == 0) & (y == 0)).alias("tn"))
    return with_rates(cells)


def with_rates(cells: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    made = cells.withColumns({"precision": precision, "recall": recall})
    p, r = F.col("precision"), F.col("recall")
    return made.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))


def _in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``cell``, the number of its range of the order.

    Ranges come from a sample of the rows, so scores that bunch are cut apart,
    and equal scores by what follows them in the order.  Written, because a
    range's borders must be the same for all that read it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn("cell", F.spark_partition_id()))


def curve(scored: DataFrame, *by: str) -> DataFrame:
    """``(*by, score, tp, fp, positives, negatives, p, n)``: what each distinct score as threshold lets through, for each value of ``by``.

    Equal scores are summed first; the running sums are then taken in ranges of
    the score, whose totals are added, so no task orders all scores.
    """
    by_score = scored.where("score is not null").groupBy(*by, "score").agg(F.sum("y").cast("bigint").alias("p"), F.sum(1 - F.col("y")).cast("bigint").alias("n"))
    celled = _in_ranges(by_score, *by, F.desc("score"))
    cells = celled.groupBy(*by, "cell").agg(F.sum("p").alias("cp"), F.sum("n").alias("cn"))
    group = Window.partitionBy(*by)
    up = group.orderBy("cell")  # as many rows as cells
    above = cells.select(*by, "cell", (F.sum("cp").over(up) - F.col("cp")).alias("ap"), (F.sum("cn").over(up) - F.col("cn")).alias("an"), F.sum("cp").over(group).alias("positives"), F.sum("cn").over(group).alias("negatives"))
    inside = Window.partitionBy(*by, "cell").orderBy(F.desc("score"))
    return celled.join(F.broadcast(above), [*by, "cell"]).select(*by, "score", (F.col("ap") + F.sum("p").over(inside)).alias("tp"), (F.col("an") + F.sum("n").over(inside)).alias("fp"), "positives", "negatives", "p", "n")


def roc_curve(scored: DataFrame) -> DataFrame:
    """``(score, fpr, tpr)``."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return curve(scored).select("score", share("fp", "negatives").alias("fpr"), share("tp", "positives").alias("tpr"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """``(score, precision, recall)``."""
    recall = F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(F.lit(0.0))
    return curve(scored).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), recall.alias("recall"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """``(roc_auc)``: ties count half; 0.5 with one class only."""
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + F.lit(0.5) * F.col("n") * F.col("p"))
    both = F.max(F.col("positives") * F.col("negatives"))
    return curve(scored).agg(F.when(both > 0, area / both).otherwise(F.lit(0.5)).alias("roc_auc"))


def average_precision(scored: DataFrame, *by: str) -> DataFrame:
    """``(*by, average_precision)``: the step sum; with one class only the mean label."""
    step = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    made = curve(scored, *by).groupBy(*by).agg(step.alias("s"), F.max("positives").alias("np"), F.max("negatives").alias("nn"))
    mean = F.coalesce(F.col("np") / (F.col("np") + F.col("nn")), F.lit(0.0))
    return made.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("s") / F.col("np")).otherwise(mean).alias("average_precision"))


def recall_at_precision(scored: DataFrame, precision: float = 0.9) -> DataFrame:
    """``(recall)``: the largest recall at that precision or more; 0 for none."""
    return pr_curve(scored).where(F.col("precision") >= precision).agg(F.coalesce(F.max("recall"), F.lit(0.0)).alias("recall"))


def threshold_grid(scored: DataFrame) -> DataFrame:
    """Cells and rates at each of the 91 thresholds from 0.05 to 0.95."""
    # Each score counts for all thresholds up to it: one sum a hundredth, then a running sum over the grid.
    grid = scored.sparkSession.range(5, 96).select(F.col("id").cast("int").alias("step"), (F.col("id") / 100.0).alias("threshold"))
    floor = F.greatest(F.lit(-1), F.least(F.lit(100), F.floor(F.col("score") * 100).cast("int")))
    # floor(score * 100) may fall a step short of or beyond the grid value itself; the comparison with it decides.
    step = F.when(F.col("score") >= (floor + 1) / 100.0, floor + 1).when(F.col("score") >= floor / 100.0, floor).otherwise(floor - 1)
    sums = scored.groupBy(step.alias("at")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    joined = grid.join(F.broadcast(sums), F.col("at") >= F.col("step"), "left").groupBy("step", "threshold").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("fp"))
    totals = sums.agg(F.sum("p").alias("np"), F.sum("n").alias("nn"))
    cells = joined.crossJoin(F.broadcast(totals)).select("threshold", "tp", "fp", (F.col("np") - F.col("tp")).alias("fn"), (F.col("nn") - F.col("fp")).alias("tn"))
    return with_rates(cells)


def best_threshold(scored: DataFrame, least_recall: float = 0.85) -> DataFrame:
    """The threshold of best F1 among those that keep the recall, else of best recall; the lowest of equals."""
    grid = threshold_grid(scored)
    ok = F.col("recall") >= least_recall
    first = [F.desc(ok), F.desc(F.when(ok, F.col("f1")).otherwise(F.col("recall"))), F.desc(F.when(ok, F.col("recall")).otherwise(F.col("f1"))), F.col("threshold")]
    return grid.orderBy(*first).limit(1)


def ranks(scored: DataFrame, key: str = "pair_id") -> DataFrame:
    """Add ``k``, from 0, by falling score and rising key, and the number of rows ``rows``; ranges are ranked apart."""
    celled = _in_ranges(scored, F.desc("score"), key)
    sizes = celled.groupBy("cell").agg(F.count("*").alias("c"))
    above = sizes.select("cell", (F.sum("c").over(Window.orderBy("cell")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("rows"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("score"), key)) - 1
    return celled.withColumn("inside", inside).join(F.broadcast(above), "cell").withColumn("k", F.col("before") + F.col("inside")).drop("cell", "inside", "before")


def deciles(scored: DataFrame, key: str = "pair_id") -> DataFrame:
    """``(decile, lowest, highest, pairs, positives, rate)``; decile 0 holds the highest scores."""
    d = F.when(F.col("rows") <= 1, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(F.col("k") * 10 / (F.col("rows") - 1)).cast("int") - 1))
    return ranks(scored, key).groupBy(d.alias("decile")).agg(F.min("score").alias("lowest"), F.max("score").alias("highest"), F.count("*").alias("pairs"), F.sum("y").alias("positives"), F.avg("y").alias("rate"))


def score_distribution(scored: DataFrame, key: str = "pair_id") -> DataFrame:
    """Per class: n, mean, population deviation and exact quantiles of the score, which come from the rows' ranks."""
    made = None
    for y in (0, 1):
        ranked = ranks(scored.where(F.col("y") == y), key)
        at = F.col("rows") - 1 - F.col("k")
        quantiles = []
        for p in (0.1, 0.25, 0.5, 0.75, 0.9):
            place = F.lit(p) * (F.col("rows") - 1)
            low, part = F.floor(place), place - F.floor(place)
            weight = F.when(at == low, 1 - part).when(at == low + 1, part).otherwise(F.lit(0.0))
            quantiles.append(F.sum(weight * F.col("score")).alias(f"p{int(p * 100)}"))
        one = ranked.groupBy("y").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation"), *quantiles)
        made = one if made is None else made.unionByName(one)
    return made


def feature_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, mean, deviation, lowest, highest, constant)``."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])).alias("z")).select("z.*")
    made = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"), F.min("x").alias("lowest"), F.max("x").alias("highest"))
    return made.withColumn("constant", F.col("deviation") < 1e-9)


def label_correlations(df: DataFrame, columns: list[str], label: str = "y", top: int | None = None) -> DataFrame:
    """``(feature, correlation)``: Pearson, 1e-12 added to the denominator; nothing with one class only."""
    y = F.col(label).cast("double")
    long = df.select(y.alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])).alias("z")).select("y", "z.*")
    made = long.groupBy("feature").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).where("sy > 0")
    out = made.select("feature", (F.col("c") / (F.col("sx") * F.col("sy") + 1e-12)).alias("correlation"))
    return out if top is None else out.orderBy(F.desc(F.abs("correlation")), "feature").limit(top)


def false_positives(scored: DataFrame, threshold: float, key: str = "pair_id", top: int | None = None, least: float = 0.0) -> DataFrame:
    """Negatives scored as positives, the highest score first."""
    made = scored.where((F.col("y") == 0) & (F.col("score") >= threshold) & (F.col("score") >= least)).orderBy(F.desc("score"), key)
    return made if top is None else made.limit(top)


def false_negatives(scored: DataFrame, threshold: float, key: str = "pair_id", top: int | None = None) -> DataFrame:
    """Positives scored as negatives, the lowest score first."""
    made = scored.where((F.col("y") == 1) & (F.col("score") < threshold)).orderBy("score", key)
    return made if top is None else made.limit(top)


def error_rates(scored: DataFrame, threshold: float) -> DataFrame:
    """Errors and their share of each label's pairs."""
    p, y = at_threshold(threshold), F.col("y")
    n = lambda v: F.sum((y == v).cast("int"))
    fp, fn = F.sum(((p == 1) & (y == 0)).cast("int")), F.sum(((p == 0) & (y == 1)).cast("int"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return scored.agg(n(0).alias("negatives"), n(1).alias("positives"), fp.alias("fp"), fn.alias("fn"), share(fp, n(0)).alias("fp_share"), share(fn, n(1)).alias("fn_share"))


def audit_sheet(scored: DataFrame, threshold: float = 0.26, least: float = 0.9, top: int = 200, columns: list[str] | None = None) -> DataFrame:
    """The most confident false positives with empty columns for a reader's verdict; of ``columns`` those that exist."""
    kept = [c for c in (columns or scored.columns) if c in scored.columns]
    rows = false_positives(scored, threshold, top=top, least=least)
    return rows.select(*kept, F.lit("").alias("veredito"), F.lit("").alias("comentario"))


# Limits of the traffic light, worst colour last.
LIGHTS = {"roc_auc": (0.90, 0.80), "average_precision": (0.65, 0.45), "recall": (0.85, 0.70), "f1": (0.45, 0.30)}


def verdict(measured: DataFrame) -> DataFrame:
    """Colours of one row of roc_auc, average_precision, recall, f1 and fn_share, and what they add up to.

    An average precision from 0.30 to 0.45 is yellow as well; a share of false
    negatives above 0.30 is red.
    """
    def colour(name: str) -> Column:
        high, low = LIGHTS[name]
        low = 0.30 if name == "average_precision" else low
        return F.when(F.col(name) >= high, "verde").when(F.col(name) >= low, "amarelo").otherwise("vermelho")

    lights = {f"cor_{n}": colour(n) for n in LIGHTS} | {"cor_fn": F.when(F.col("fn_share") > 0.30, "vermelho").otherwise("verde")}
    made = measured.withColumns(lights)
    names = [F.col(c) for c in lights]
    return made.withColumn("veredito", F.when(F.array_contains(F.array(*names), "vermelho"), "não recomendado").when(F.array_contains(F.array(*names), "amarelo"), "monitorar").otherwise("pronto"))


def cumulative_importance(importances: DataFrame) -> DataFrame:
    """Add rank, share of the positive total and the running share, at most 1; one row a feature goes in."""
    positive = F.greatest(F.col("importance"), F.lit(0.0))
    down = Window.orderBy(F.desc("importance"), "feature")
    total = F.sum(positive).over(Window.partitionBy())
    share = F.when(total > 0, positive / total).otherwise(F.lit(0.0))
    ranked = importances.withColumns({"position": F.row_number().over(down), "share": share})
    return ranked.withColumn("running", F.least(F.lit(1.0), F.sum("share").over(down.rowsBetween(Window.unboundedPreceding, 0))))


def ranking(models: DataFrame) -> DataFrame:
    """Models by average precision with the lead over the next; a lead of less than a hundredth doesn't decide."""
    down = Window.orderBy(F.desc("average_precision"), "model")
    led = models.withColumns({"position": F.row_number().over(down), "lead": F.col("average_precision") - F.lead("average_precision").over(down)})
    return led.withColumn("decides", F.coalesce(F.col("lead") >= 0.01, F.lit(False)))


def comparison(scored: DataFrame, scores: list[str], precision: float = 0.9) -> DataFrame:
    """``(model, roc_auc, average_precision, recall, delta_*)`` of several score columns over the same rows; deltas are against the first."""
    names = ["roc_auc", "average_precision", "recall"]
    made = None
    for name in scores:
        one = scored.select("y", F.col(f"`{name}`").alias("score"))
        row = roc_auc(one).crossJoin(average_precision(one)).crossJoin(recall_at_precision(one, precision)).select(F.lit(name).alias("model"), *names)  # one row each
        made = row if made is None else made.unionByName(row)
    made = cut_lineage(made)
    first = made.where(F.col("model") == scores[0]).select(*[F.col(n).alias(f"first_{n}") for n in names])
    return made.crossJoin(F.broadcast(first)).select("model", *names, *[(F.col(n) - F.col(f"first_{n}")).alias(f"delta_{n}") for n in names])


# Groups of the feature table and how their columns' names begin; the first that fits counts.
GROUPS = [
    ("grafia", ("graf_",)), ("numeros", ("num_",)), ("composto", ("ofta_",)),
    ("avancado", ("spec_item_", "brand_a_token", "brand_b_token", "cls_pair_", "brand_longest", "brand_simhash", "fon_concat_")), ("fonetica", ("fon_",)),
    ("cosseno", ("spec_cosine_", "brand_emb_")), ("especificacao", ("spec_",)), ("classe", ("cls_",)), ("interacao", ("inter_",)),
    ("genericos", ("name_", "shared_", "contain_", "radical_", "lev_pure_", "against_")), ("palavras", ("n_tokens_", "brand_", "tok_")),
]


def group_of(feature: Column) -> Column:
    """The group of a feature's name; ``outros`` for a name of none."""
    found = F.lit("outros")
    for group, starts in reversed(GROUPS):
        hit = F.lit(False)
        for start in starts:
            hit = hit | F.startswith(feature, F.lit(start))
        found = F.when(hit, F.lit(group)).otherwise(found)
    return found


def importance_by_group(importances: DataFrame) -> DataFrame:
    """``(grupo, colunas, soma, media, parte, maior)`` of the positive importances of each group of features."""
    positive = importances.select("feature", F.greatest(F.col("importance"), F.lit(0.0)).alias("i")).withColumn("grupo", group_of(F.col("feature")))
    sums = positive.groupBy("grupo").agg(F.count("*").alias("colunas"), F.sum("i").alias("soma"), F.avg("i").alias("media"), F.min_by("feature", F.struct((-F.col("i")).alias("i"), F.col("feature").alias("f"))).alias("maior"))
    total = positive.agg(F.sum("i").alias("all"))  # one row
    return sums.crossJoin(F.broadcast(total)).withColumn("parte", F.when(F.col("all") > 0, F.col("soma") / F.col("all")).otherwise(F.lit(0.0))).drop("all")

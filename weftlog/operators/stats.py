"""Counts, vocabularies, scalers, ranks and quantiles.

Exact ranks over a large group come from ``distribution``: values are counted first, dealt to buckets between approximate
quantiles, and summed in two levels, so no group is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.schema import OTHER, POD, SERVICE

#: Buckets of a group's values, over which sums are carried.
BUCKETS = 64
#: The group of a table that is one group.
ALL = "_all"
#: Node types whose label is the type itself. Fixed values.
TYPE_LABELS = {"DNSName": "dnsname", "ExternalEndpoint": "external", "KubeAPI": "kubeapi", "Workload": "workload"}


def top_vocabulary(values: DataFrame, value: str, order: str, size: int) -> DataFrame:
    """(value, idx) of the ``size`` - 1 most frequent values from index 1 on; ties go to the one seen first, then to the smaller value. Index 0 is left for others."""
    counts = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    best = counts.orderBy(F.desc("n"), "seen", value).limit(max(size - 1, 0))  # size rows at most are numbered
    return best.select(value, F.row_number().over(Window.orderBy(F.desc("n"), "seen", value)).alias("idx"))


def log_scalers(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row: mean and population deviation of log(1 + x) for each field; a deviation of 0 is 1, and no rows give (0, 1)."""
    logs = {f: F.log1p(F.greatest(F.col(f).cast("double"), F.lit(0.0))) for f in fields}
    mean = [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{f}_mean") for f, x in logs.items()]
    dev = [F.coalesce(F.when(F.stddev_pop(x) > 0, F.stddev_pop(x)), F.lit(1.0)).alias(f"{f}_dev") for f, x in logs.items()]
    return df.agg(*mean, *dev)


def class_weights(rows: DataFrame, label: str, other: Column | None = None) -> DataFrame:
    """(label, n, weight): rows / (classes * n), 0 for rows of the ``other`` class, which are not counted either."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    is_other = F.lit(False) if other is None else other
    present = counts.where(~is_other)
    total = present.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))  # one row
    return counts.join(F.broadcast(total)).select(label, "n", F.when(is_other, 0.0).otherwise(F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def entity_label(app_namespace: str = "default") -> Column:
    """Role label of an entity: its service in the app's namespace, or the label of its type; null for other pods and services."""
    c = F.col
    own = F.when((c("namespace") == app_namespace) & (c("canonical_service") != ""), c("canonical_service"))
    by_type = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.when(c("entity_type").isin(POD, SERVICE), own).otherwise(F.try_element_at(by_type, c("entity_type")))


def label_vocabulary(entities: DataFrame, app_namespace: str = "default") -> DataFrame:
    """(label, idx): distinct labels in order from 1 on, and the label for all others at 0."""
    labels = entities.select(entity_label(app_namespace).alias("label")).where(F.col("label").isNotNull() & (F.col("label") != OTHER)).distinct()
    numbered = labels.select("label", F.row_number().over(Window.orderBy("label")).cast("int").alias("idx"))  # one row for each service
    return numbered.unionByName(entities.sparkSession.createDataFrame([(OTHER, 0)], "label string, idx int"))


def with_label_index(nodes: DataFrame, vocabulary: DataFrame, app_namespace: str = "default") -> DataFrame:
    """Adds label and y; what the vocabulary lacks is the other class."""
    out = nodes.withColumn("label", entity_label(app_namespace)).join(vocabulary.withColumnRenamed("idx", "y"), "label", "left")
    return out.withColumns({"label": F.when(F.col("y").isNull() | (F.col("y") == 0), OTHER).otherwise(F.col("label")), "y": F.coalesce("y", F.lit(0))})


def distribution(df: DataFrame, group: str, value: str, weight: Column | None = None) -> DataFrame:
    """(group, value, n, below, total): weight of each distinct value, of all smaller ones, and of the group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("n"))
    edges = counts.groupBy(group).agg(F.percentile_approx(value, F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)]), 1000).alias("edges"))
    edges = F.broadcast(edges) if group == ALL else edges  # one row; the optimizer knows that its key is constant and would pair all rows
    placed = counts.join(edges, group).withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")
    sums = placed.groupBy(group, "bucket").agg(F.sum("n").alias("s"))
    over = Window.partitionBy(group)
    carried = sums.select(group, "bucket", (F.sum("s").over(over.orderBy("bucket")) - F.col("s")).alias("carried"), F.sum("s").over(over).alias("total"))
    inside = F.sum("n").over(Window.partitionBy(group, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    return placed.join(carried, [group, "bucket"]).select(group, value, "n", (F.col("carried") + inside).alias("below"), "total")


def quantile(df: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """(group, threshold): exact quantile with linear interpolation."""
    at = (F.col("total") - 1) * F.lit(q)
    holds = lambda rank: (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
    ranked = distribution(df, group, value).withColumns({"lo": F.floor(at), "hi": F.ceil(at), "part": at - F.floor(at)})
    ends = ranked.groupBy(group).agg(F.max(F.when(holds(F.col("lo")), F.col(value))).alias("a"), F.max(F.when(holds(F.col("hi")), F.col(value))).alias("b"), F.first("part").alias("part"))
    return ends.select(group, (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("threshold"))


def midrank_normalised(scores: DataFrame, table: DataFrame, group: str, value: str) -> DataFrame:
    """Adds score_norm: (values below + values up to) / twice the number of the table's values in the group; the value itself where the table has none."""
    both = table.select(group, value, F.lit(1).alias("w")).unionByName(scores.select(group, value, F.lit(0).alias("w")))
    ranks = distribution(both, group, value, F.col("w")).select(group, value, F.when(F.col("total") > 0, (2 * F.col("below") + F.col("n")) / (2 * F.col("total"))).alias("rank"))
    return scores.join(ranks, [group, value], "left").withColumn("score_norm", F.coalesce("rank", value)).drop("rank")


def auc(df: DataFrame, value: str, positive: Column, group: str | None = None) -> DataFrame:
    """Chance that a positive's value is larger than a negative's, ties by half; null without both kinds. With n_pos and n_neg."""
    key = group or ALL
    rows = df.select(*([group] if group else [F.lit(0).alias(key)]), F.col(value), positive.alias("p")).where(F.col(value).isNotNull())
    negatives = distribution(rows, key, value, F.when(F.col("p"), 0).otherwise(1)).withColumnsRenamed({"n": "n_neg_here", "below": "neg_below", "total": "n_neg"})
    positives = rows.where("p").groupBy(key, value).agg(F.count(F.lit(1)).alias("n_here"))
    joined = negatives.join(positives, [key, value], "left")
    wins = F.sum(F.coalesce("n_here", F.lit(0)) * (F.col("neg_below") + F.col("n_neg_here") / 2))
    out = joined.groupBy(key).agg(wins.alias("wins"), F.sum(F.coalesce("n_here", F.lit(0))).alias("n_pos"), F.first("n_neg").alias("n_neg"))
    found = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("auc")
    return out.select(*([group] if group else []), found, "n_pos", "n_neg")

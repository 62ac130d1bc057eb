"""Learned stages on Spark ML: embeddings, role regression and scores.

Neighbourhoods are propagated for a fixed number of hops ([x, Ax, A(Ax)]) and classified by a weighted multinomial regression; this
stands in for a trained graph network, with the same inputs, target and score, and makes no claim to equal weights.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions.encoding import positional_encoding
from weftlog.functions.tokens import unknown_token
from weftlog.operators.graphs import mean_vector, mean_vectors
from weftlog.operators.stats import class_weights
from weftlog.schema import OTHER
from weftlog.scratch import written

#: Sentences for each task of Word2Vec.
SENTENCES = 200_000


def with_unknowns(sentences: DataFrame, least: int = 2) -> DataFrame:
    """Sentences in which tokens of fewer than ``least`` occurrences stand as the bucket of their namespace.

    Rare tokens have few occurrences, so only the sentences that hold one are taken apart; all others are passed on as they are.
    """
    keys = ["run_id", "w_idx", "entity_id"]
    said = sentences.select(*keys, "sentence").where(F.size("sentence") > 0)
    counts = said.select(F.explode("sentence").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # written, as their true size tells the planner how to join them
    rare = written(counts.where(F.col("n") < least).select("token", F.lit(True).alias("rare")), "rare-tokens")
    touched = written(said.select(*keys, F.explode("sentence").alias("token")).join(rare, "token", "left_semi").select(*keys).distinct(), "sentences-with-rare")
    tokens = said.join(touched, keys, "left_semi").select(*keys, F.posexplode("sentence").alias("i", "token"))
    mapped = tokens.join(rare, "token", "left").withColumn("token", F.when(F.col("rare"), unknown_token(F.col("token"))).otherwise(F.col("token")))
    rows = mapped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("rows"))
    return said.join(touched, keys, "left_anti").unionByName(rows.select(*keys, F.transform("rows", lambda r: r["token"]).alias("sentence")))


def token_vectors(sentences: DataFrame, size: int = 64, window: int = 5, epochs: int = 15, least: int = 2, seed: int = 17) -> DataFrame:
    """(token, vector): skip-gram vectors of common tokens and of the buckets.

    A task trains on about SENTENCES of them, and Spark averages the tasks' vectors after each epoch.
    """
    corpus = written(with_unknowns(sentences.where(F.size("sentence") > 0), least).select("sentence"), "corpus")
    tasks = corpus.count() // SENTENCES + 1
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, maxIter=epochs, numPartitions=tasks, seed=seed, inputCol="sentence", outputCol="v").fit(corpus)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


def encoded(sentences: DataFrame, vectors: DataFrame, size: int = 64) -> DataFrame:
    """(run_id, w_idx, entity_id, x): mean over a sentence of token vector plus the encoding of its place.

    An unknown token has its bucket's vector, or zeros.  The places' part of the mean depends on the length alone, so it
    is computed once for each length.  Tokens of a sentence are added up where they are read, so one row for each sentence is shuffled.
    """
    keys = ["run_id", "w_idx", "entity_id"]
    tokens = sentences.select(*keys, F.explode("sentence").alias("token"))
    vectors = written(vectors, "token-vectors")
    own = tokens.join(vectors, "token", "left").withColumn("bucket", unknown_token(F.col("token")))
    spare = vectors.select(F.col("token").alias("bucket"), F.col("vector").alias("spare"))
    full = own.join(spare, "bucket", "left").select(*keys, F.coalesce("vector", "spare", F.array_repeat(F.lit(0.0), size)).alias("v"))
    means = mean_vectors(full, keys, "v", size, "n")
    lengths = sentences.select(F.size("sentence").cast("long").alias("n")).where("n > 0").distinct()
    places = lengths.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("n", positional_encoding(F.col("i"), size).alias("pe"))
    shift = written(places.groupBy("n").agg(mean_vector("pe").alias("pe")), "places")
    return means.join(shift, "n").select(*keys, F.zip_with("v", "pe", lambda a, b: a + b).alias("x"))


def training_rows(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(features, y, weight) of nodes that have a role, balanced by class."""
    labelled = nodes.where(F.col("y") > 0).select(array_to_vector(F.concat(*columns)).alias("features"), F.col("y").cast("double").alias("y"))
    weights = written(class_weights(labelled, "y").select("y", "weight"), "weights")  # a row for each class, so nodes need no shuffle to meet it
    return labelled.join(weights, "y")


def role_regression(nodes: DataFrame, columns: list[str], iterations: int = 100, penalty: float = 1e-3):
    """Weighted multinomial regression on own and propagated vectors; None with fewer than two classes."""
    rows = training_rows(nodes, columns)
    if len(rows.select("y").distinct().take(2)) < 2:
        return None
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=iterations, regParam=penalty, family="multinomial").fit(rows)


def probabilities(nodes: DataFrame, model, columns: list[str]) -> DataFrame:
    """Adds probs, the model's class probabilities; without a model, all on the other class."""
    if model is None:
        return nodes.withColumn("probs", F.array(F.lit(1.0)))
    out = model.transform(nodes.withColumn("features", array_to_vector(F.concat(*columns))))
    return out.withColumn("probs", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def best(probs: Column) -> Column:
    """Place of the largest probability, the first of equals."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def node_scores(nodes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(run_id, w_idx, entity_id, node_type, true_label, pred_label, p_true, score_raw) of nodes with label, y and probs.

    The score is one minus the probability of the own role; a node without role scores 1.
    """
    names = vocabulary.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda r: r["label"]).alias("names"))  # one row of all classes
    own = F.when(F.col("y") == 0, 0.0).otherwise(F.coalesce(F.get("probs", F.col("y")), F.lit(0.0)))
    out = nodes.join(F.broadcast(names)).withColumn("p_true", own)
    return out.select(
        "run_id", "w_idx", "entity_id", F.col("entity_type").alias("node_type"), F.when(F.col("y") == 0, OTHER).otherwise(F.col("label")).alias("true_label"),
        F.coalesce(F.get("names", best(F.col("probs"))), F.lit("?")).alias("pred_label"), "p_true", (1 - F.col("p_true")).alias("score_raw"),
    )

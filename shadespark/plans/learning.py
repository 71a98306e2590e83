"""Labels, splits, preference weights and rankers with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.relational import ranked
from ..operators.scoring import naive_rule

# Fixed wishes of the preference pairs.
TEXTS = (("q01", "I want a deep red lipstick"), ("q02", "I like soft pink but not bright"), ("q03", "Looking for a nude shade"))
FEATURES = ("L_lab", "a_lab", "b_lab", "C_lab", "H_lab_deg", "depth", "warmth", "sat_eff")


def stratified_split(df: DataFrame, keys: Sequence[str], label: str = "label", seed: int = 7, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """df with `split`: exact shares of each label, by a seeded hash order that does not depend on partitions."""
    n = F.count("*").over(Window.partitionBy(label))
    out = ranked(df.withColumn("_n", n), [label], [F.md5(F.concat_ws("|", *keys, F.lit(str(seed))).cast("binary")), *keys], "_k")
    train, valid = F.round(F.col("_n") * shares[0]), F.round(F.col("_n") * (shares[0] + shares[1]))
    return out.withColumn("split", F.when(F.col("_k") <= train, "train").when(F.col("_k") <= valid, "valid").otherwise("test")).drop("_n", "_k")


def pairwise(shades: DataFrame, texts: Sequence[tuple[str, str]] = TEXTS, k: int = 10) -> DataFrame:
    """Preference pairs of each wish's k best and k worst shades by the naive rule, in both orientations."""
    spark = shades.sparkSession
    q = spark.createDataFrame(list(texts), "query_id string, wish string")
    s = shades.crossJoin(F.broadcast(q)).withColumn("_s", F.round(naive_rule(F.col("wish")), 12))
    cols = ["shade_id", "L_lab", "C_lab", "H_lab_deg"]
    top = ranked(s, ["query_id"], [F.desc("_s"), "shade_id"], "_k").where(F.col("_k") <= k).select("query_id", *(F.col(c).alias(f"{c}_p") for c in cols))
    low = ranked(s, ["query_id"], ["_s", F.desc("shade_id")], "_k").where(F.col("_k") <= k).select("query_id", *(F.col(c).alias(f"{c}_n") for c in cols))
    j = top.join(low, "query_id").withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    hue = F.pmod(F.col("H_lab_deg_p") - F.col("H_lab_deg_n") + 180, F.lit(360.0)) - 180
    delta = {"delta_L": F.col("L_lab_p") - F.col("L_lab_n"), "delta_C": F.col("C_lab_p") - F.col("C_lab_n"), "delta_H": hue}
    pick = lambda a, b: F.when(F.col("sign") == 1, F.col(a)).otherwise(F.col(b))
    return j.select("query_id", pick("shade_id_p", "shade_id_n").alias("item_pos_id"), pick("shade_id_n", "shade_id_p").alias("item_neg_id"), *((x * F.col("sign")).alias(n) for n, x in delta.items()), ((F.col("sign") + 1) / 2).cast("int").alias("label"))


def preference_weights(pairs: DataFrame) -> LogisticRegressionModel:
    """Logistic regression without intercept, ridge of strength 1 over the rows."""
    rows = VectorAssembler(inputCols=["delta_L", "delta_C", "delta_H"], outputCol="features").transform(pairs)
    return LogisticRegression(fitIntercept=False, standardization=False, elasticNetParam=0.0, regParam=1.0 / max(rows.count(), 1), maxIter=200, tol=1e-9).fit(rows)


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with `weight`: rows over labels times the label's rows."""
    each = df.groupBy(label).agg(F.count("*").alias("_n"))
    all_ = each.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return df.join(F.broadcast(each.crossJoin(all_)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")


def linear_ranker(train: DataFrame, features: Sequence[str] = FEATURES, multinomial: bool = False, iterations: int = 2000) -> PipelineModel:
    """Scaler and balanced logistic regression; multinomial for the colour namer."""
    rows = balanced(train)
    lr = LogisticRegression(featuresCol="scaled", weightCol="weight", family="multinomial" if multinomial else "binomial", regParam=1.0 / max(rows.count(), 1), maxIter=iterations)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), lr]).fit(rows)


#: Rows of a partition that trees grow over: up to one partition for each core, and beyond.
PART_ROWS, PART_ROWS_MOST = 250_000, 2_000_000


def dealt(rows: DataFrame) -> DataFrame:
    """rows in as few partitions as their number asks for, by a hash of the whole row, and in its order.

    Every level of every tree is a job over all partitions, and each of its tasks answers the driver with some kilobytes: their
    number goes by the rows, not by the files that they come from.
    """
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    parts = max(min(n // PART_ROWS + 1, cores), n // PART_ROWS_MOST + 1)
    return rows.withColumn("_at", F.xxhash64(*rows.columns)).repartition(parts, "_at").sortWithinPartitions("_at").drop("_at")


def boosted_ranker(train: DataFrame, valid: DataFrame | None = None, features: Sequence[str] = FEATURES, iterations: int = 400) -> PipelineModel:
    """Boosted trees on balanced rows; with valid rows, boosting ends once their loss no longer falls."""
    rows, stop = train, {}
    if valid is not None:
        rows = train.withColumn("_valid", F.lit(False)).unionByName(valid.withColumn("_valid", F.lit(True)))
        stop = {"validationIndicatorCol": "_valid", "validationTol": 0.001}
    gbt = GBTClassifier(featuresCol="raw", stepSize=0.06, maxDepth=5, minInstancesPerNode=25, maxIter=iterations, seed=7, weightCol="weight", **stop)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), gbt]).fit(dealt(balanced(rows)))


def write_predictions(model: PipelineModel, rows: DataFrame, path: str) -> None:
    """The rows with p, the likeliest first, as CSV."""
    predictions(model, rows).orderBy(F.desc("p"), *[c for c in ("product_id", "shade_id") if c in rows.columns]).write.mode("overwrite").option("header", True).csv(path)


def evaluation_report(model: PipelineModel, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """split, n, accuracy, positive_rate, auc, ap of rows with label and split, for each split."""
    from ..operators.aggregates import auc_ap

    scored = predictions(model, rows)
    hit = ((F.col("p") >= threshold).cast("int") == F.col("label")).cast("double")
    plain = scored.groupBy("split").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg((F.col("p") >= threshold).cast("double")).alias("positive_rate"))
    out = None
    for split in ("train", "valid", "test"):
        one = auc_ap(scored.where(F.col("split") == split), "label", "p").withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return plain.join(out, "split")


def coefficients(model: PipelineModel, features: Sequence[str] = FEATURES) -> dict[str, float]:
    """The linear ranker's weight of each scaled feature."""
    return dict(zip(features, map(float, model.stages[-1].coefficients.toArray())))


def colour_namer(train: DataFrame, label: str = "label", features: Sequence[str] = ("L_lab", "a_lab", "b_lab")) -> PipelineModel:
    """Scaler and balanced multinomial regression over label names; name_probabilities reads it."""
    from pyspark.ml.feature import StringIndexer

    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(train)
    rows = balanced(index.transform(train).drop(label).withColumnRenamed("_label", "label"))
    lr = LogisticRegression(featuresCol="scaled", weightCol="weight", family="multinomial", regParam=1.0 / max(rows.count(), 1), maxIter=300)
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), lr]).fit(rows)
    model.names = list(index.labels)
    return model


def name_probabilities(model: PipelineModel, chips: DataFrame) -> DataFrame:
    """chips with p_<name> for each name of a colour_namer."""
    p = model.transform(chips).withColumn("_p", vector_to_array("probability"))
    return p.select(*chips.columns, *(F.col("_p")[k].alias(f"p_{n}") for k, n in enumerate(model.names)))


def predictions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of label 1."""
    out = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    return out.select(*rows.columns, "p")

"""Models on feature tables with Spark ML; classes are weighted evenly."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tidemark.operators.evaluate import class_metrics, sign_test

#: Class labels: short, long, flat. Named in the label's metadata, so that a fit need not look for them.
CLASSES = {"ml_attr": {"name": "label", "type": "nominal", "vals": ["0", "1", "2"]}}


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """weight: rows over classes times the class's rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    k = counts.agg(F.count("*").alias("__k"), F.sum("__c").alias("__n"))
    return df.join(F.broadcast(counts.crossJoin(k).select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("weight"))), label)


def classed(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, F.col(label).cast("double").alias(label, metadata=CLASSES))


def vectors(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")


def assembled(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    return vectors(columns).transform(classed(df, label))


def forest(trees: int = 20, depth: int = 5, seed: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)


def three_class(train: DataFrame, columns: list[str], trees: int = 20, depth: int = 5, seed: int = 1):
    return forest(trees, depth, seed).fit(assembled(weighted(train), columns))


def score(model, df: DataFrame, columns: list[str]) -> DataFrame:
    """cls, conf, p_short, p_long, p_flat and signed strength of each row."""
    p = vector_to_array("probability")
    out = model.transform(assembled(df, columns)).withColumns({"p_short": p[0], "p_long": p[1], "p_flat": p[2]})
    out = out.withColumn("conf", F.greatest("p_short", "p_long", "p_flat")).withColumn("cls", F.col("prediction").cast("int"))
    return out.withColumn("strength", F.when(F.col("cls") == 1, F.col("conf")).when(F.col("cls") == 0, -F.col("conf")).otherwise(0.0)).drop("features", "rawPrediction", "probability", "prediction")


def at_once(spark: SparkSession, jobs: list[Callable[[], object]], most: int = 8) -> list:
    """Results of jobs run from driver threads, each in a scheduler pool of its own, so that small fits share the cluster."""

    def one(number: int) -> object:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{number % most}")
        return jobs[number]()

    if not jobs:
        return []
    with ThreadPoolExecutor(min(most, len(jobs))) as pool:
        # the threads take over the caller's job group and tags
        return list(pool.map(inheritable_thread_target(spark)(one), range(len(jobs))))


#: Rows beyond which a fit keeps the cluster busy by itself; as each keeps its rows at hand, such fits run one after another.
ALONE = 1_000_000


def together(train: DataFrame, most: int = 8) -> int:
    """Fits on ``train`` to run at once."""
    return most if train.limit(ALONE + 1).count() <= ALONE else 1


def walk_forward(df: DataFrame, columns: list[str], splits: DataFrame, number: str = "rn", folder: str | None = None, **options) -> DataFrame:
    """Predictions on each fold's test rows; splits has symbol, fold and the folds' bounds in row numbers, as from ``wf_splits``.

    With ``folder`` the rows are written there once, fold after fold, and read by each fit; folds of few rows are fitted at once.
    """
    placed = df.join(splits, "symbol").where(F.col(number) < F.col("test_end"))
    folds = [r[0] for r in splits.select("fold").distinct().orderBy("fold").collect()]  # a few
    if folder:
        for k in folds:  # a fold's own folder, so that no task sorts its rows by fold
            placed.where(F.col("fold") == k).drop("fold").write.parquet(f"{folder}/fold={k}")
        placed = df.sparkSession.read.schema(placed.schema).parquet(folder)

    def fit(fold: int) -> DataFrame:
        rows = placed.where(F.col("fold") == fold)
        model = three_class(rows.where(F.col(number) < F.col("train_end")), columns, **options)
        return score(model, rows.where(F.col(number) >= F.col("test_start")), columns)

    return reduce(DataFrame.unionByName, at_once(df.sparkSession, [partial(fit, k) for k in folds], together(placed)))


def one_vs_rest(train: DataFrame, test: DataFrame, columns: list[str], side: int, rounds: int = 10, seed: int = 1) -> tuple[DataFrame, float]:
    """Scores of a boosted model of one class against the others, and its area under the curve on the test rows."""
    binary = lambda d: VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(d.withColumn("label", (F.col("label") == side).cast("int")))
    model = GBTClassifier(maxIter=rounds, seed=seed).fit(binary(train))
    out = model.transform(binary(test))
    return out.withColumn("p", vector_to_array("probability")[1]), BinaryClassificationEvaluator().evaluate(out)


#: Symbols whose rows share a folder, about; lanes in which own fits run one after another, each a few jobs of one short task.
BESIDE, LANES = 32, 16


def pooled_against_own(df: DataFrame, columns: list[str], folder: str, number: str = "rn", cut: float = 0.7, **options) -> DataFrame:
    """Directional accuracy of one model over all symbols and of every symbol's own model, the same estimator, on the same test rows, paired
    by symbol in a sign test: wins are the pooled model's. A symbol on whose test rows one of the two tells no direction, or whose
    training rows are of one class, has no pair. However many symbols there are, each is fitted, by a few jobs of its own.

    What the own fits share is done for all of them at once: class weights, and a layout in which a fit finds its rows in one file.
    """
    spark = df.sparkSession
    parts = -(-df.select("symbol").distinct().count() // BESIDE) or 1
    kept = df.withColumn("part", F.pmod(F.xxhash64("symbol"), F.lit(parts)).cast("int")).repartition("part")
    of = lambda *by: F.count(F.lit(1)).over(Window.partitionBy("part", "symbol", *by))
    kept = kept.withColumn("early", F.col(number) < cut * of()).dropna(subset=[*columns, "label"])
    classes = F.size(F.collect_set("label").over(Window.partitionBy("part", "symbol", "early")))
    # the key is a text: compiled code does not hold texts that are compared with, so all fits share it
    kept = kept.withColumns({"weight": of("early") / (classes * of("early", "label")), "key": F.hex(F.col("symbol").cast("string"))})
    kept = kept.select("symbol", "key", number, "label", *columns, "early", "weight", "part").sortWithinPartitions("part", "key", number)
    kept.write.option("compression", "zstd").partitionBy("part").parquet(f"{folder}/rows")
    rows = spark.read.schema(kept.schema).parquet(f"{folder}/rows")
    fitted = rows.groupBy("part", "symbol", "key").agg(F.countDistinct(F.when(F.col("early"), F.col("label"))).alias("classes"), F.max(~F.col("early")).alias("judged")).where("classes > 1 AND judged")
    symbols = fitted.select("part", "symbol", "key").orderBy("part", "symbol").collect()
    ready = classed(rows)  # filters do not pass the making of vectors, so that follows them
    hit = "CASE WHEN prediction <> 2 THEN CAST(prediction = label AS DOUBLE) END"

    def own(mine: list) -> list:
        estimator, vector, found = forest(**options), vectors(columns), []
        for part, symbol, key in mine:
            of_symbol = ready.where(f"part = {part} AND key = '{key}'")
            model = estimator.fit(vector.transform(of_symbol.where("early")))
            told = model.transform(vector.transform(of_symbol.where("NOT early").coalesce(1)))
            found.append((symbol, told.selectExpr(f"avg({hit})").first()[0]))
        return found

    hits = [x for lane in at_once(spark, [partial(own, symbols[k::LANES]) for k in range(min(LANES, len(symbols)))], LANES) for x in lane if x[1] is not None]
    single = spark.createDataFrame(hits, kept.select("symbol").schema.add("y", "double"))
    train = rows.where("early").drop("weight", "key", number)
    pooled = three_class(train, columns, **options).transform(assembled(rows.where("NOT early"), columns)).groupBy("symbol").agg(F.expr(f"avg({hit})").alias("x")).where("x IS NOT NULL")
    return sign_test(pooled.join(single, "symbol").withColumn("all", F.lit("all")), "all")


def tuned(estimator, grid: list[dict], train: DataFrame, val: DataFrame, evaluator, parallelism: int = 4) -> tuple[int, list[float], list]:
    """Best map of a parameter grid by its score on later rows, all scores, and all models; ties go to the first. The validator's mask is
    time: what it fits on lies before what it judges by."""
    models: list = [None] * len(grid)

    def fit(made) -> None:
        k, model = next(made)
        models[k] = model

    made = estimator.fitMultiple(train, grid)
    at_once(train.sparkSession, [partial(fit, made)] * len(grid), parallelism)
    scores = [evaluator.evaluate(m.transform(val)) for m in models]
    return max(range(len(grid)), key=lambda k: (scores[k], -k)), scores, models


def compare_depths(train: DataFrame, val: DataFrame, columns: list[str], depths: tuple[int, ...], **options) -> tuple[dict[int, float], list[str]]:
    """Macro-F1 on later rows by tree depth, and the columns of the best model whose importance is over the mean."""
    models = dict(zip(depths, at_once(train.sparkSession, [partial(three_class, train, columns, depth=d, **options) for d in depths], together(train)), strict=True))
    found = {d: class_metrics(score(m, val, columns)).first()["macro_f1"] for d, m in models.items()}
    weights = models[max(found, key=found.get)].featureImportances.toArray()
    return found, [c for c, w in zip(columns, weights, strict=True) if w >= weights.mean()]


def gate_scores(model, test: DataFrame, columns: list[str], least: float = 0.5) -> dict:
    """Accuracy, directional rows, those told with enough confidence, and accuracy on these."""
    live, sure = F.col("cls") != 2, (F.col("cls") != 2) & (F.col("conf") >= least)
    hit = (F.col("cls") == F.col("label")).cast("double")
    return score(model, test, columns).agg(F.avg(hit).alias("accuracy"), F.count(F.when(live, 1)).alias("raw_trades"), F.count(F.when(sure, 1)).alias("gated_trades"), F.avg(F.when(sure, hit)).alias("gated_accuracy")).first().asDict()


def model_search(df: DataFrame, columns: list[str], train_end: int, val_end: int, grid: dict[str, list], number: str = "rn", least: int = 2, seed: int = 1, confident: float = 0.5) -> DataFrame:
    """Cases of a search over row numbers: the plain model, the best of a grid, it with even class weights, and refitted on the better half of
    its columns by importance (``least`` at least). Each has its score on validation rows and its figures on the test rows after them."""
    ready = assembled(weighted(df), columns).select(*df.columns, "weight", "features")
    train, val, test = ready.where(F.col(number) < train_end), ready.where((F.col(number) >= train_end) & (F.col(number) < val_end)), df.where(F.col(number) >= val_end)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed)
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(forest.getParam(name), values)
    maps = builder.build()
    most = together(train, 4)
    best, scores, models = tuned(forest, maps, train, val, judge, most)
    weights = models[best].featureImportances.toArray()
    half = sorted(range(len(columns)), key=lambda i: (-weights[i], i))[: max(least, len(columns) // 2)]
    pruned = [columns[i] for i in sorted(half)]
    fewer = VectorAssembler(inputCols=pruned, outputCol="features", handleInvalid="skip")
    small_train, small_val = fewer.transform(train.drop("features")), fewer.transform(val.drop("features"))
    plain, even, cut = at_once(df.sparkSession, [lambda: forest.fit(train), lambda: forest.copy({**maps[best], forest.weightCol: "weight"}).fit(train), lambda: forest.fit(small_train, maps[best])], most)
    cases = [("baseline", plain, judge.evaluate(plain.transform(val)), columns), ("tuned", models[best], scores[best], columns), ("class_weighted", even, judge.evaluate(even.transform(val)), columns), ("pruned", cut, judge.evaluate(cut.transform(small_val)), pruned)]
    found = at_once(df.sparkSession, [partial(gate_scores, m, test, used, confident) for _, m, _, used in cases], most)
    rows = [(name, float(v), len(used), x["accuracy"], x["raw_trades"], x["gated_trades"], x["gated_accuracy"]) for (name, _, v, used), x in zip(cases, found, strict=True)]
    return df.sparkSession.createDataFrame(rows, "case string, val_score double, columns int, accuracy double, raw_trades long, gated_trades long, gated_accuracy double")

"""Clusters of suppliers, contracts and people with Spark ML."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tendermill.operators import grouping
from tendermill.operators.outliers import above_quantile
from tendermill.operators.quantiles import exact_quantiles
from tendermill.plans.suppliers import SUPPLIER, clustering_columns
from tendermill.session import checkpointed

SEED = 42
# Metrics of the cluster profile, metrics of the efficiency groups and their names, best first.
PROFILE = ["total_volume", "avg_contract_value", "contracts_count", "price_volatility", "years_active", "projects_count",
           "diversification_index", "delivery_efficiency", "contract_consistency", "specialization_ratio"]
MORE_IS_BETTER = ["total_lots", "sum_lot_value"]
LESS_IS_BETTER = ["avg_time_to_close"]
EFFICIENCY = ["Эффективные менеджеры", "Средние менеджеры", "Малоэффективные менеджеры"]
# Categories of supplier clusters with a first recommendation.
ADVICE = {
    "PREMIUM (крупные, стабильные, опытные)": "Развивать долгосрочное стратегическое партнерство",
    "КРУПНЫЕ (высокий объем, но нестабильные)": "Работать над стабилизацией цен",
    "АКТИВНЫЕ УНИВЕРСАЛЫ (частые заказы, много проектов)": "Автоматизировать процессы заказа",
    "АКТИВНЫЕ СПЕЦИАЛИСТЫ (частые заказы, узкая специализация)": "Углублять экспертизу в их области",
    "НОВЫЕ (недавно начали работать)": "Тщательная проверка надежности",
    "УЗКОСПЕЦИАЛИЗИРОВАННЫЕ (работают в одном проекте)": "Углублять экспертизу в их области",
    "РЕДКИЕ (нерегулярные поставщики)": "Пересмотреть необходимость сотрудничества",
}
SCALERS = {
    "standard": lambda: StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    "robust": lambda: RobustScaler(inputCol="raw", outputCol="features", withCentering=True, withScaling=True),
    "minmax": lambda: MinMaxScaler(inputCol="raw", outputCol="features"),
}


def scaled(df: DataFrame, columns: Iterable[str], scaler: str = "standard") -> DataFrame:
    raw = VectorAssembler(inputCols=list(columns), outputCol="raw").transform(df)
    return SCALERS[scaler]().fit(raw).transform(raw).drop("raw")


def silhouette(clustered: DataFrame, prediction: str = "cluster") -> float:
    return ClusteringEvaluator(featuresCol="features", predictionCol=prediction).evaluate(clustered)


def _k_means(vectors: DataFrame, k: int):
    return KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster").fit(vectors)


def k_sweep(vectors: DataFrame, ks: Iterable[int]) -> list[tuple[int, float, float, float]]:
    """For each k: inertia, silhouette and Calinski-Harabasz index (between over within spread)."""
    cells = vectors.select(F.posexplode(vector_to_array("features")).alias("i", "x"))
    spread = cells.groupBy("i").agg(F.var_pop("x").alias("v"), F.count("*").alias("n")).agg(
        F.sum(F.col("v") * F.col("n")), F.max("n")).first()
    total, n = spread
    out = []
    for k in ks:
        model = _k_means(vectors, k)
        within = model.summary.trainingCost
        index = ((total - within) / (k - 1)) / (within / (n - k)) if within > 0 and n > k else float("inf")
        out.append((k, within, silhouette(model.transform(vectors)), index))
    return out


def sweep_table(spark: SparkSession, rows: list[tuple[int, float, float, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, calinski_harabasz double")


def best_scaler(df: DataFrame, columns: list[str], ks: Iterable[int] = range(2, 5)) -> list[tuple[str, int, float]]:
    """Best k and silhouette under each scaler, best scaler first."""
    ks = list(ks)
    found = []
    for name in SCALERS:
        vectors = scaled(df, columns, name)
        scores = [(silhouette(_k_means(vectors, k).transform(vectors)), k) for k in ks]
        score, k = max(scores)
        found.append((name, k, score))
    return sorted(found, key=lambda x: -x[2])


def principal_components(vectors: DataFrame, size: int, variance: float = 0.95) -> tuple[DataFrame, list[float]]:
    """Project onto the fewest components that hold the wanted share of the variance."""
    model = PCA(k=size, inputCol="features", outputCol="_all").fit(vectors)
    explained = model.explainedVariance.toArray().tolist()
    kept, reached = 0, 0.0
    while kept < len(explained) and reached < variance:
        reached += explained[kept]
        kept += 1
    first = array_to_vector(F.slice(vector_to_array("_all"), 1, max(kept, 1)))
    return model.transform(vectors).withColumn("components", first).drop("_all"), explained


def supplier_clusters(features: DataFrame, k: int | None = None, top_share: float = 0.99) -> DataFrame:
    """Suppliers above the volume quantile get clusters of their own; the rest is clustered by all numeric features.

    Without a given k it is the best silhouette of 2 to 8, but at least 6.
    """
    table = checkpointed(features)
    columns = clustering_columns(table)
    giants = above_quantile(table, "total_volume", top_share, SUPPLIER)
    normal = table.join(giants.select(SUPPLIER), SUPPLIER, "left_anti")
    vectors = checkpointed(scaled(normal, columns))
    if k is None:
        k = max(max(k_sweep(vectors, range(2, 9)), key=lambda r: r[2])[0], 6)
    clustered = _k_means(vectors, k).transform(vectors).drop("features").withColumn("is_giant", F.lit(False))
    own = giants.withColumn("cluster", (F.lit(k - 1) + F.col("position")).cast("int")).withColumn("is_giant", F.lit(True))
    return clustered.unionByName(own.select(*clustered.columns))


def cluster_profile(clusters: DataFrame) -> DataFrame:
    """Size, metric means, category, advice and the five largest suppliers of each cluster."""
    normal = clusters.where(~F.col("is_giant"))
    means = normal.groupBy("cluster").agg(F.count("*").alias("suppliers"), *(F.avg(c).alias(c) for c in PROFILE))
    volume = exact_quantiles(normal, [], "total_volume", {"q": 0.8})
    number = exact_quantiles(normal, [], "contracts_count", {"q": 0.7})
    marked = grouping.with_row(grouping.with_row(means, volume, "_volume"), number, "_number")
    names = list(ADVICE)
    category = (
        F.when((F.col("total_volume") > F.col("_volume.q")) & (F.col("price_volatility") < 0.2) & (F.col("years_active") > 2),
               names[0])
        .when(F.col("total_volume") > F.col("_volume.q"), names[1])
        .when((F.col("contracts_count") > F.col("_number.q")) & (F.col("projects_count") > 3), names[2])
        .when(F.col("contracts_count") > F.col("_number.q"), names[3])
        .when(F.col("years_active") < 1, names[4])
        .when(F.col("projects_count") == 1, names[5]).otherwise(names[6])
    )
    advice = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    # five names per cluster at most
    best = grouping.top_in_group(normal, ["cluster"], 5, F.desc("total_volume"), SUPPLIER).groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", SUPPLIER))), lambda s: s[SUPPLIER]), ", ")
        .alias("top_suppliers"))
    out = marked.withColumn("category", category).drop("_volume", "_number")
    return out.withColumn("advice", advice[F.col("category")]).join(best, "cluster")


def bisecting_clusters(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """Top-down hierarchy cut at k clusters. Bottom-up linkage would need every pair of rows."""
    vectors = scaled(df, columns)
    model = BisectingKMeans(k=k, seed=SEED, featuresCol="features", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).drop("features")


def _apart(x: Column, y: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, d: total + d)


def seeded_clusters(kpi: DataFrame, seeds: DataFrame, rounds: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """K-means started from the best row of each discipline; the seeds keep the clusters they founded.

    Centres are a table of one row per discipline. Each round assigns the rows to the nearest centre and takes the means, until
    no centre moves farther than ``tolerance``; a centre without rows stays where it is.
    """
    columns = ["total_lots", "avg_time_to_close", "avg_lot_value", "sum_lot_value"]
    keys = [c for c in ("project_name", "discipline", "actor_name") if c in kpi.columns]
    point = F.array(*(F.col(c).cast("double") for c in columns))
    table = checkpointed(kpi.fillna(0.0, subset=columns))
    founders = grouping.ranked_rows(seeds.fillna(0.0, subset=columns), "discipline").withColumn("cluster", (F.col("rank") - 1).cast("int"))
    founders = checkpointed(founders.drop("rank"))
    rest = checkpointed(table.join(founders.select(*keys), keys, "left_anti"))
    centres = founders.select("cluster", point.alias("centre"))

    def assigned(centres: DataFrame) -> DataFrame:
        # one entry per discipline
        every = centres.agg(F.collect_list(F.struct("cluster", "centre")).alias("list"))
        nearest = F.array_min(F.transform("_centres.list", lambda c: F.struct(_apart(c["centre"], point).alias("d"), c["cluster"].alias("i"))))
        return grouping.with_row(rest, every, "_centres").withColumn("cluster", nearest["i"]).drop("_centres")

    for _ in range(rounds):
        means = assigned(centres).groupBy("cluster").agg(F.array(*(F.avg(F.col(c).cast("double")) for c in columns)).alias("mean"))
        moved = checkpointed(centres.join(means, "cluster", "left").select(
            "cluster", F.coalesce("mean", "centre").alias("centre"), _apart(F.col("centre"), F.coalesce("mean", "centre")).alias("step")))
        centres, step = moved.select("cluster", "centre"), moved.agg(F.max("step")).first()[0]
        if step is None or step <= tolerance ** 2:
            break
    labelled = assigned(centres)
    return labelled.unionByName(founders.select(*labelled.columns))


def efficiency_groups(clusters: DataFrame) -> DataFrame:
    """Clusters gathered into three groups by their means, groups named by their normalised score."""
    metrics = MORE_IS_BETTER + LESS_IS_BETTER
    means = checkpointed(clusters.groupBy("cluster").agg(*(F.avg(m).alias(m) for m in metrics)))
    vectors = VectorAssembler(inputCols=metrics, outputCol="features").transform(means)
    model = KMeans(k=3, seed=SEED, featuresCol="features", predictionCol="efficiency_group").fit(vectors)
    groups = model.transform(vectors).drop("features")
    centres = groups.groupBy("efficiency_group").agg(*(F.avg(m).alias(m) for m in metrics))
    bounds = grouping.with_whole_stats(
        centres, "_b", **{f"{e}_{m}": getattr(F, e)(m) for m in metrics for e in ("min", "max")})

    def unit(m):
        return F.coalesce(F.try_divide(F.col(m) - F.col(f"_b.min_{m}"), F.col(f"_b.max_{m}") - F.col(f"_b.min_{m}")),
                          F.lit(0.5))

    score = sum((unit(m) for m in MORE_IS_BETTER), F.lit(0.0)) + sum((1 - unit(m) for m in LESS_IS_BETTER), F.lit(0.0))
    scored = bounds.withColumn("efficiency_score", score)
    # three rows at most
    ranked = grouping.ranked_rows(scored, F.desc("efficiency_score"), "efficiency_group")
    names = F.create_map(*(F.lit(x) for i, n in enumerate(EFFICIENCY) for x in (i + 1, n)))
    named = ranked.select("efficiency_group", "efficiency_score", names[F.col("rank")].alias("label"))
    return groups.select("cluster", "efficiency_group", *metrics).join(named, "efficiency_group")


def actors_per_group(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct people per cluster and per efficiency label, labels as columns."""
    pairs = clusters.join(groups.select("cluster", "label"), "cluster").groupBy("cluster", "label").agg(
        F.countDistinct("actor_name").alias("actors"))
    return grouping.pivoted(pairs, ["cluster"], "label", EFFICIENCY, F.sum("actors"), fill=0)


def actor_clusters(lots: DataFrame, k: int = 4, rounds: int = 30) -> DataFrame:
    """People per discipline clustered by money, lots, suppliers and which suppliers they use.

    Features are rows (person, feature, value), each divided by its deviation: three sums, and a flag for every supplier used.
    K-means starts from the clusters by the three sums; each round takes the centres as rows (cluster, feature, mean) and
    assigns people by |c|^2 - 2 x c, a join and a sum. No supplier is cut and no list of suppliers is gathered.
    With at most ``k`` people each is a cluster, those of equal features one together: the clusters that k-means ends with.
    """
    keys = ["discipline", "actor_name"]
    sums = ["total_eur", "total_lots", "suppliers_count"]
    per_pair = checkpointed(lots.groupBy(*keys, "winner_name").agg(F.count("*").alias("n"), F.sum("total_price_eur").alias("eur")))
    people = per_pair.groupBy(*keys).agg(F.sum("eur").alias("total_eur"), F.sum("n").alias("total_lots"), F.count("*").alias("suppliers_count"))
    people = checkpointed(people.withColumn("person", F.monotonically_increasing_id()))
    same = [people[c].eqNullSafe(per_pair[c]) for c in keys]
    flags = per_pair.where(F.col("winner_name").isNotNull()).join(people, same).select(
        "person", F.concat(F.lit("uses "), "winner_name").alias("feature"), F.lit(1.0).alias("x"))
    raw = people.select("person", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in sums)))
                        .alias("f")).select("person", "f.*").unionByName(flags)
    # a flag is 0 for everyone without a row
    everyone = people.count()
    n, total, squares = F.lit(float(everyone)), F.sum("x"), F.sum(F.col("x") * F.col("x"))
    deviation = F.sqrt(F.greatest(F.try_divide(squares - total * total / n, n - 1), F.lit(0.0)))
    scale = raw.groupBy("feature").agg(deviation.alias("deviation"))
    cells = checkpointed(raw.join(scale, "feature").select(
        "person", "feature", F.coalesce(F.try_divide("x", "deviation"), F.lit(0.0)).alias("x")))

    if everyone <= k:
        place = _own_clusters(cells)
        return people.join(place, "person").select(*keys, *sums, "cluster")
    start = scaled(people, sums)
    place = checkpointed(_k_means(start, k).transform(start).select("person", "cluster"))
    for _ in range(rounds):
        size = place.groupBy("cluster").agg(F.count("*").alias("size"))
        centre = cells.join(place, "person").groupBy("cluster", "feature").agg(F.sum("x").alias("total")).join(size, "cluster")
        centre = checkpointed(centre.select("cluster", "feature", (F.col("total") / F.col("size")).alias("mean")))
        norm = centre.groupBy("cluster").agg(F.sum(F.col("mean") * F.col("mean")).alias("norm"))
        product = cells.join(centre, "feature").groupBy("person", "cluster").agg(F.sum(F.col("x") * F.col("mean")).alias("product"))
        # rounded, so that the order of a sum cannot move a person between equally near centres
        gap = F.round(F.col("norm") - 2 * F.col("product"), 9)
        nearest = product.join(norm, "cluster").groupBy("person").agg(F.min_by("cluster", F.struct(gap, "cluster")).alias("cluster"))
        nearest = checkpointed(nearest)
        settled = nearest.join(place, ["person", "cluster"], "left_anti").isEmpty()
        place = nearest
        if settled:
            break
    return people.join(place, "person").select(*keys, *sums, "cluster")


def _own_clusters(cells: DataFrame) -> DataFrame:
    """(person, cluster) of a few people, equal ones together."""
    size = cells.groupBy("person").agg(F.count("*").alias("n"))
    others = cells.select(F.col("person").alias("other"), "feature", "x")
    shared = cells.join(others, ["feature", "x"]).groupBy("person", "other").agg(F.count("*").alias("shared"))
    sizes = shared.join(size, "person").join(size.select(F.col("person").alias("other"), F.col("n").alias("n_other")), "other")
    first = sizes.where("shared = n AND shared = n_other").groupBy("person").agg(F.min("other").alias("first"))
    return first.select("person", (F.dense_rank().over(Window.orderBy("first")) - 1).alias("cluster"))


def actor_cluster_stats(clusters: DataFrame) -> DataFrame:
    stats = clusters.groupBy("cluster").agg(
        F.count("*").alias("actors"), F.avg("total_eur").alias("mean_eur"), F.avg("total_lots").alias("mean_lots"))
    medians = exact_quantiles(clusters, ["cluster"], "total_eur", {"median_eur": 0.5})
    return stats.join(medians, "cluster")

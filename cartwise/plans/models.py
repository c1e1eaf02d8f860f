"""Rating preparation for the factorisation models (L1, L6) and the models
themselves (L2-L5, G9, G10).  L7-L9 are in ``gmf.py``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise import config as C
from cartwise.operators import aggregates as A
from cartwise.operators import filters as FL
from cartwise.operators import projections as PR
from cartwise.operators.joins import ROWS, salted_join
from cartwise.operators.mips import top_products
from cartwise.operators.scaling import dense_index, minmax, standardise
from cartwise.operators.windows import scale_per_item
from cartwise.scope import persist, stored

AREA, CUST, ITEM = "customer_area", "customernumber", "model_number"


def als_ratings(invoices: DataFrame, area: str | None = None, cap: float | None = None,
                index: bool = True) -> DataFrame:
    """L1: turnover per (area, customer, model) (A2), share of the model's mean in
    its area (P7), purchased flag (P9), capped if asked for (P8), standardised (M2)
    and min-max scaled (M1) over the area, customer and model indexed (M3).  One
    area, or all of them in one plan."""
    df = invoices if area is None else FL.for_area(invoices, area)
    df = stored(df.select(AREA, CUST, ITEM, "sales_value"), "lines")  # their joins' shuffle files go first
    t = A.customer_item_value(FL.drop_null_keys(df, [ITEM]), (AREA, CUST, ITEM))
    t = stored(FL.positive_only(t, "turnover"), "turnover")  # read for a statistic and for its rows
    t = persist(PR.with_base(t, "turnover", base="mean", item_col=ITEM, keys=[AREA],
                             base_col="avg_turnover"))  # for scalings, indexes and its rows
    ids = []
    if index:  # before the scalings, which are worked out on reading
        t = dense_index(t, CUST, "customer_id")
        t = stored(dense_index(t, ITEM, "product_id"), "indexed")
        ids = ["customer_id", "product_id"]
    t = (PR.over_base(t, "turnover", "avg_turnover").withColumn("purchased", PR.purchased_flag())
         .withColumn("rating", PR.cap("raw_rating", cap)))
    t = standardise(t, "rating", "std_scaled_rating", by=[AREA])
    t = minmax(t, "rating", "minmax_scaled_rating", 0.0, 1.0, by=[AREA])
    return t.select(*(c for c in t.columns if c not in ids), *ids)


def ncf_ratings(invoices: DataFrame, area: str | None = None, cap: float | None = None,
                lo: str | None = None, hi: str | None = None,
                min_months: int = C.NCF_MIN_MONTHS, min_items: int = C.NCF_MIN_ITEMS
                ) -> DataFrame:
    """Loyal (F18) and diverse (F19) customers, one area or all (F12):
    quantity per (area, customer, model) (A1), share of the model mean (P7), capped
    if asked for (P8), min-max scaled over the area (M1), per-model scaled flag
    (W3, P10)."""
    df = invoices if lo is None else FL.date_between(invoices, "calendar_day", lo, hi)
    df = stored(df.select(AREA, CUST, ITEM, "soldnumber", "sales_year", "sales_month"), "lines")  # read four times
    df = FL.min_active_months(df, min_months)
    df = FL.min_distinct_items(df, min_items)
    df = df if area is None else FL.for_area(df, area)
    q = (FL.drop_null_keys(df.select(AREA, CUST, ITEM, "soldnumber"), [ITEM]).groupBy(AREA, CUST, ITEM)
         .agg(F.sum("soldnumber").alias("product_orders")))
    q = stored(FL.positive_only(q, "product_orders"), "quantities")
    q = stored(PR.with_base(q, "product_orders", base="mean", item_col=ITEM, keys=[AREA], base_col="avg_order"), "shares")
    q = PR.over_base(q, "product_orders", "avg_order").withColumn("rating", PR.cap("raw_rating", cap))
    q = minmax(q, "rating", "minmax_scaled_rating", 0.0, 1.0, by=[AREA])
    q = scale_per_item(q, "rating", "interaction_round", ITEM, 3, keys=[AREA])
    q = q.withColumn("interaction_round", PR.binarise("interaction_round"))
    q = q.withColumn("interaction", F.round("minmax_scaled_rating", 6))
    return FL.dropna_any(q)


# ---------------------------------------------------------------- L2: split
def hash_split(df: DataFrame, fraction: float, seed: int = C.SEED,
               keys: tuple[str, ...] = (CUST, ITEM)) -> tuple[DataFrame, DataFrame]:
    """L2: deterministic train/test split by the md5 of the row key.  Unlike
    ``randomSplit`` it does not depend on partitioning or re-execution order,
    so a recomputed partition (lost executor) lands on the same side."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % 10000
    flagged = df.withColumn("_train", bucket < F.lit(int(round(fraction * 10000))))
    return (flagged.where("_train").drop("_train"), flagged.where(~F.col("_train")).drop("_train"))


def item_mean_predictions(train: DataFrame, test: DataFrame, label: str,
                          keys: tuple[str, ...] = (AREA, ITEM)) -> DataFrame:
    """The baseline that a model has to beat: a test row is predicted by its item's
    training mean; items without training rows are left out."""
    mean = train.groupBy(*keys).agg(F.avg(label).alias("prediction"), F.count(F.lit(1)).alias(ROWS))
    return salted_join(test, mean, keys)


# ---------------------------------------------------------------- L3-L5: ALS
#: Ratings of an ALS block; blocks of fewer ratings than that (or the shuffle partitions, if fewer).
BLOCK_RATINGS, LEAST_BLOCKS = 1_000_000, 12


def als_blocks(train: DataFrame) -> int:
    """The number of user and of item blocks for ``train``."""
    least = min(LEAST_BLOCKS, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, math.ceil(train.count() / BLOCK_RATINGS))


def fit_als(train: DataFrame, rank: int = C.ALS_RANK, max_iter: int = C.ALS_MAX_ITER,
            reg: float = C.ALS_REG, alpha: float = C.ALS_ALPHA,
            rating_col: str = "minmax_scaled_rating", seed: int = C.SEED,
            blocks: int | None = None, implicit: bool = True):
    """L3: non-negative ALS; factor blocks are shuffled by Spark ML and lineage is
    cut every 10 iterations in the session's checkpoint folder.  ``blocks`` is the
    number of user and of item blocks, by default a block for each ``BLOCK_RATINGS``
    ratings: every block sends a message to every other one in each of the half-steps,
    so their number follows the ratings and not the shuffle partitions."""
    from pyspark.ml.recommendation import ALS
    n = blocks or als_blocks(train)
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha,
              userCol="customer_id", itemCol="product_id", ratingCol=rating_col,
              coldStartStrategy="drop", nonnegative=True, implicitPrefs=implicit, seed=seed,
              checkpointInterval=10, numUserBlocks=n, numItemBlocks=n)
    return als.fit(train)


def als_recommend(model, ratings: DataFrame, k: int = C.ALS_TOP_K) -> DataFrame:
    """The ``k`` items of largest inner product per customer, exactly,
    without scoring every pair (``operators.mips``); ids resolved to numbers."""
    from cartwise.operators.joins import resolve_ids
    flat = top_products(model.userFactors, model.itemFactors, k).select(
        F.col("customer").cast("double").alias("customer_id"), "rank",
        F.col("product").cast("double").alias("product_id"), F.col("score").alias("rating"))
    users = ratings.select("customer_id", CUST).distinct()
    items = ratings.select("product_id", ITEM).distinct()
    return resolve_ids(flat, users, items)


def regression_metrics(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """MAE, MSE and RMSE in one aggregate (one row)."""
    err = F.col(label) - F.col(prediction)
    return pred.agg(F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
                    F.sqrt(F.avg(err * err)).alias("rmse"), F.count("*").alias("n"))


def als_pipeline(invoices: DataFrame, area: str | None = C.ALS_AREA, rank: int = C.ALS_RANK,
                 max_iter: int = C.ALS_MAX_ITER, k: int = C.ALS_TOP_K, blocks: int | None = None):
    """L1-L5 end to end: ratings, 70/30 split, fit, held-out metrics, top-k.  The
    ratings are read five times, so they are persisted."""
    ratings = persist(als_ratings(invoices, area, C.RATING_CAP))
    train, test = hash_split(ratings, C.ALS_TRAIN_FRACTION)
    model = fit_als(train, rank=rank, max_iter=max_iter, blocks=blocks)
    metrics = regression_metrics(model.transform(test), "minmax_scaled_rating")
    return model, ratings, metrics, als_recommend(model, ratings, k)


# ---------------------------------------------------------------- G9, G10
def factors_long(factors: DataFrame, layer: str, id_col: str = "id",
                 vec_col: str = "features") -> DataFrame:
    """A factor/weight matrix in long form (layer, Row, Column, Value)."""
    return factors.select(F.lit(layer).alias("layer"), F.col(id_col).cast("string").alias("Row"),
                          F.posexplode(vec_col).alias("Column", "Value")).select(
        "layer", "Row", F.col("Column").cast("string").alias("Column"),
        F.col("Value").cast("double").alias("Value"))


def project_2d(vectors: DataFrame, source: int, id_col: str = "id",
               vec_col: str = "features") -> DataFrame:
    """Linear 2-D points of embedding vectors by PCA (distributed covariance); G10's
    own points keep neighbours together (``operators.landmarks``)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = vectors.select(F.col(id_col).alias("Index"),
                       array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    pca = PCA(k=2, inputCol="_v", outputCol="_p").fit(v)
    p = pca.transform(v).select("Index", vector_to_array("_p").alias("_a"))
    return p.select("Index", F.col("_a")[0].alias("tsne1"), F.col("_a")[1].alias("tsne2"),
                    F.lit(source).alias("Source"))


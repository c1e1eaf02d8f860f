"""Registered queries for models (L2-L9, W7, J9, X21, G9, G10) and the
interpretability tables (G1-G8, G11, A13, A14, F21-F24, U1)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cartwise import config as C
from cartwise.operators import filters as FL
from cartwise.operators import interpret as G
from cartwise.operators.aggregates import node_degree, value_range
from cartwise.operators.joins import resolve_ids
from cartwise.operators.landmarks import points_2d
from cartwise.operators.scaling import dense_index, join_scalar
from cartwise.plans import bundles as B
from cartwise.plans import gmf as GMF
from cartwise.plans import models as MO
from cartwise.plans.queries import (
    als_input, bundles_out, columns, mixed_parts, ncf_input, pooled_rules, product_rows, r6,
    register, sim_parts,
)
from cartwise.scope import once, persist, stored

CA, CU, MN = "customer_area", "customernumber", "model_number"
_MODEL_CACHE: dict = {}


def als(spark, root):
    """ALS pipeline at the fixed settings, fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _MODEL_CACHE:
        _MODEL_CACHE.clear()  # models of an ended session are dead
        _MODEL_CACHE[key] = MO.als_pipeline(columns(spark, root, CA, CU, MN, "sales_value"), area=None)
    return _MODEL_CACHE[key]


# ------------------------------------------------------------------ models (rows only)
@register("random_split")
def q_split(spark, root):
    r = als_input(spark, root, False)
    train, test = MO.hash_split(r, C.ALS_TRAIN_FRACTION)
    return (train.select(CU, MN, F.lit("train").alias("side"))
            .unionByName(test.select(CU, MN, F.lit("test").alias("side"))))


@register("als_fit")
def q_als_fit(spark, root):
    model = als(spark, root)[0]
    return MO.factors_long(model.userFactors, "user")


@register("als_recommend")
def q_als_recommend(spark, root):
    return als(spark, root)[3].select(CU, MN, "rank", "rating")


@register("recommend_top_k")
def q_top_k(spark, root):
    return als(spark, root)[3].select("customer_id", "rank", "product_id")


def _indexed(spark, root):
    return als_input(spark, root)


def _picked(ratings):
    """Each customer's three best-rated models as an array of structs, by id."""
    r = ratings.withColumn("_r", F.round("minmax_scaled_rating", 6))
    w = Window.partitionBy("customer_id").orderBy(F.desc("_r"), "product_id")
    top = r.withColumn("pos", F.row_number().over(w)).where("pos <= 3")
    return top.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", "product_id", F.col("_r").alias("rating")))).alias("recommendations"))


@register("id_resolve")
def q_id_resolve(spark, root):
    r = _indexed(spark, root)
    flat = _picked(r).select("customer_id", F.explode("recommendations").alias("r")).select(
        "customer_id", "r.product_id")
    return resolve_ids(flat, r.select("customer_id", CU).distinct(),
                       r.select("product_id", MN).distinct()).select("customer_id", CU, "product_id", MN)


@register("struct_fields")
def q_struct_fields(spark, root):
    return _picked(_indexed(spark, root)).select(
        "customer_id", F.explode("recommendations").alias("r")).select(
        "customer_id", F.col("r.product_id").alias("product_id"), F.col("r.rating").alias("rating"))


def _metrics_out(m):
    return m.select(r6("mae"), r6("mse"), r6("rmse"), "n")


@register("rmse_eval")
def q_rmse(spark, root):
    r = als_input(spark, root, False)
    pred = MO.item_mean_predictions(*MO.hash_split(r, C.ALS_TRAIN_FRACTION), "minmax_scaled_rating")
    return _metrics_out(MO.regression_metrics(pred, "minmax_scaled_rating"))


@register("als_metrics")
def q_als_metrics(spark, root):
    return als(spark, root)[2]


def _ncf(spark, root, index=False):
    r = ncf_input(spark, root)
    if not index:
        return r
    return once(("ncf indexed", root), lambda: stored(
        dense_index(dense_index(r.select(CA, CU, MN, "interaction"), CU, "customer_id"), MN, "product_id"), "ncf-indexed"))


def _gmf(spark, root):
    """The logistic factorisation at the fixed number of factors, fitted once."""
    def build():
        train, test = MO.hash_split(_ncf(spark, root, True), C.NCF_TRAIN_FRACTION)
        return test, GMF.fit(train, test, [GMF.Point()])
    return once(("gmf", root), build)


@register("gmf_fit")
def q_gmf(spark, root):
    return GMF.predict(*_gmf(spark, root)).select(CU, MN, "interaction", "prediction")


@register("fit_metrics")
def q_fit_metrics(spark, root):
    pred = MO.item_mean_predictions(*MO.hash_split(_ncf(spark, root), C.NCF_TRAIN_FRACTION), "interaction")
    return _metrics_out(MO.regression_metrics(pred, "interaction"))


@register("gmf_metrics")
def q_gmf_metrics(spark, root):
    """Errors of the fitted model, with its loss and that of the items' means."""
    train, test = MO.hash_split(_ncf(spark, root, True), C.NCF_TRAIN_FRACTION)
    loss = GMF.cross_entropy(F.col("interaction"), F.col("prediction")).alias("log_loss")
    pred = persist(GMF.predict(*_gmf(spark, root)))
    means = MO.item_mean_predictions(train, test, "interaction").agg(loss).withColumnRenamed("log_loss", "item_mean_log_loss")
    return join_scalar(join_scalar(MO.regression_metrics(pred, "interaction"), pred.agg(loss)), means)


#: Two values of every dimension of the viewer's sweep.
SWEEP = GMF.grid((8, 32), (0.0, 0.1), (1e-4, 1e-2), (0.02, 0.1))


@register("param_sweep")
def q_sweep(spark, root):
    train, test = MO.hash_split(_ncf(spark, root, True), C.NCF_TRAIN_FRACTION)
    return GMF.sweep(train, test, SWEEP)


@register("als_factors_long")
def q_als_factors(spark, root):
    model = als(spark, root)[0]
    return MO.factors_long(model.itemFactors, "item")


@register("embedding_points")
def q_points(spark, root):
    model = als(spark, root)[0]
    emb = spark.read.parquet(f"{root}/embeddings.parquet")
    return points_2d(model.itemFactors, 1).unionByName(points_2d(emb, 2, "vec_id", "embedding"))


# ------------------------------------------------------------------ value-checked tables
def _emb_long(spark, root):
    emb = spark.read.parquet(f"{root}/embeddings.parquet")
    return emb.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("layer"),
                      F.col("vec_id").cast("string").alias("Row"),
                      F.posexplode("embedding").alias("Column", "Value")).select(
        "layer", "Row", F.col("Column").cast("string").alias("Column"),
        F.round(F.col("Value").cast("double"), 6).alias("Value"))


@register("factor_matrix_long")
def q_factor_long(spark, root):
    return _emb_long(spark, root)


@register("value_range")
def q_value_range(spark, root):
    return value_range(_emb_long(spark, root))


def _coord_points(spark, root):
    emb = spark.read.parquet(f"{root}/embeddings.parquet")
    return emb.select(F.col("vec_id").alias("Index"),
                      F.round(F.col("embedding")[0].cast("double"), 6).alias("tsne1"),
                      F.round(F.col("embedding")[1].cast("double"), 6).alias("tsne2"),
                      F.col("label").alias("Source"))


@register("point_brush")
def q_point_brush(spark, root):
    return FL.in_box(_coord_points(spark, root), 0.5, -0.5, -0.5, 0.5, "tsne1", "tsne2")


@register("source_filter")
def q_source_filter(spark, root):
    return FL.by_source(_coord_points(spark, root), 1, "Source")


def _edges(spark, root):
    return G.rule_edges(pooled_rules(spark, root))


@register("rule_edges")
def q_rule_edges(spark, root):
    return _edges(spark, root).select("from", "to", r6("value"))


@register("node_degree")
def q_node_degree(spark, root):
    return node_degree(_edges(spark, root))


@register("rule_nodes")
def q_rule_nodes(spark, root):
    return G.rule_nodes(_edges(spark, root)).select("id", "label", "title", "value")


@register("two_hop")
def q_two_hop(spark, root):
    return G.neighbourhood(_edges(spark, root), "blue bolt", 2)


EDGE_PICK = ["blue bolt", "small ring", "red widget"]


@register("edge_filter")
def q_edge_filter(spark, root):
    e = _edges(spark, root)
    return FL.select_nodes(G.rule_nodes(e), e, "edge", "from", EDGE_PICK)


@register("visible_nodes")
def q_visible_nodes(spark, root):
    e = _edges(spark, root)
    nodes = G.rule_nodes(e)
    return FL.subgraph_nodes(nodes, FL.select_nodes(nodes, e, "edge", "from", EDGE_PICK)).select(
        "id", "value")


def _products(spark, root):
    """D2 over the whole history; a tree and its marks read it six times."""
    return product_rows(spark, root)


@register("hierarchy_tree")
def q_tree(spark, root):
    return G.hierarchy_edges(_products(spark, root))


@register("hierarchy_paths")
def q_paths(spark, root):
    leaves = _products(spark, root).select(MN).distinct()
    return G.ancestor_nodes(_products(spark, root), leaves)


def _marks(spark, root):
    p = sim_parts(spark, root, False)
    actual = p.top.select(CU, F.col("item").alias(MN))
    predicted = (p.top.join(p.neighbours.select("customer_area", "item", "other"),
                            ["customer_area", "item"])
                 .select(CU, F.col("other").alias(MN)))
    return G.compare_sets(actual, predicted, _products(spark, root))


@register("actual_vs_predicted")
def q_compare(spark, root):
    return _marks(spark, root)


@register("pruned_tree")
def q_pruned(spark, root):
    return G.prune_tree(G.hierarchy_edges(_products(spark, root)), _marks(spark, root))


@register("marked_links")
def q_marked(spark, root):
    return G.marked_links(G.hierarchy_edges(_products(spark, root)), _marks(spark, root))


@register("union_bundles")
def q_union(spark, root):
    return bundles_out(B.union_bundles(mixed_parts(spark, root)))


@register("area_recommendations")
def q_area_view(spark, root):
    return G.area_view(B.union_bundles(mixed_parts(spark, root)))

"""Registered queries for the smaller operators (sources, filters,
projections, scalar functions, aggregates, joins, scaling, rating prep)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartwise import functions as X
from cartwise.operators import aggregates as A
from cartwise.operators import filters as FL
from cartwise.operators import projections as PR
from cartwise.operators import scaling as M
from cartwise.operators.joins import with_group_stat
from cartwise.plans import dataset as D
from cartwise.plans.queries import (
    all_ratings, als_input, arr, columns, invoices, mixed_parts, money, ncf_input, parts,
    pooled_rules, r6, register, top10, window,
)
from cartwise.scope import once, stored
from cartwise.session import CHECKPOINT_CONF
from cartwise.sources import io as IO
from cartwise.sources import testdata as TD

CA, CU, MN = "customer_area", "customernumber", "model_number"


def scratch(spark, tag: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{spark.conf.get(CHECKPOINT_CONF)}/cartwise-{tag}-{uuid.uuid4().hex}"


def ds(col: str):
    return F.date_format(col, "yyyy-MM-dd").alias(col)


# ------------------------------------------------------------------ 2.1 sources
@register("scan_parquet")
def q_scan(spark, root):
    return IO.read_table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@register("semantic_scan")
def q_semantic(spark, root):
    return IO.semantic_select(IO.read_table(spark, root, "customer"), {
        "c_custkey": "customer", "c_name": "custcontact", "c_mktsegment": "customerindustry",
        " c_acctbal": "balance"})


@register("company_scan")
def q_company(spark, root):
    return IO.read_table(spark, root, "customer", company_code=7, company_col="c_nationkey")


@register("csv_scan")
def q_csv(spark, root):
    path = scratch(spark, "csv")
    (IO.read_table(spark, root, "part").select("p_partkey", "p_name", "p_retailprice")
     .write.mode("overwrite").option("header", True).csv(path))
    return IO.read_csv(spark, path, "p_partkey bigint, p_name string, p_retailprice double")


def _ratings_out(r):
    return r.select(CA, CU, MN, "product_orders", "avg_order", r6("raw_rating"), r6("rating"),
                    "interaction")


@register("parquet_sink")
def q_parquet_sink(spark, root):
    path = scratch(spark, "sink")
    IO.write_table(_ratings_out(all_ratings(spark, root)), path)
    return spark.read.parquet(path)


def _top_rows(spark, root):
    return top10(spark, root, rated=all_ratings(spark, root)).select(CA, CU, MN, "row", "interaction")


@register("area_sink")
def q_area_sink(spark, root):
    path = scratch(spark, "area")
    IO.write_by_area(_top_rows(spark, root), path)
    return spark.read.parquet(path)


@register("area_result_read")
def q_area_read(spark, root):
    path = scratch(spark, "area")
    IO.write_by_area(_top_rows(spark, root), path)
    return IO.read_area(spark, path, "Metal")


# ------------------------------------------------------------------ 2.2 filters
def _orders_monthly(spark, root):
    return IO.read_table(spark, root, "orders").select(
        "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyyMM").alias(
            "calendar_yearmonth"))


@register("latest_month")
def q_latest_month(spark, root):
    return FL.latest_snapshot(_orders_monthly(spark, root), "calendar_yearmonth",
                              F.col("o_orderstatus") == "O")


@register("global_max")
def q_global_max(spark, root):
    return FL.latest_month(_orders_monthly(spark, root), "calendar_yearmonth",
                           F.col("o_orderstatus") == "O").withColumnRenamed(
        "_latest_month", "last_month")


@register("active_customers")
def q_active_customers(spark, root):
    src = TD.sources(spark, root)
    return D.active_customers(src["casa"], src["casa_md"])


@register("code_range")
def q_code_range(spark, root):
    casa = TD.customer_activity(spark, root)
    return casa.where(FL.code_between("sales_region", "000000000012", "000000000014")).select(
        "customer", "sales_region")


@register("not_blank")
def q_not_blank(spark, root):
    p = IO.read_table(spark, root, "part").select(
        "p_partkey", F.when(F.col("p_size") > 45, F.lit(" ")).otherwise(F.col("p_type"))
        .alias("label"))
    return p.where(X.not_blank("label"))


@register("active_products")
def q_active_products(spark, root):
    return FL.active_products(TD.products(spark, root)).select(
        "s_p_product_number", "n_product_family_nr", "product_name")


def _cust_orders(spark, root):
    c = IO.read_table(spark, root, "customer").select("c_custkey")
    # small orders and customers without any get nulls
    big = F.col("o_totalprice") > 250000
    o = IO.read_table(spark, root, "orders").select("o_custkey", *(
        F.when(big, F.col(k)).alias(k) for k in ("o_orderkey", "o_orderdate")))
    return c.join(o, c.c_custkey == o.o_custkey, "left").drop("o_custkey")


@register("drop_null_keys")
def q_drop_null_keys(spark, root):
    return FL.drop_null_keys(_cust_orders(spark, root), ["o_orderkey"]).select(
        "c_custkey", "o_orderkey")


@register("not_null")
def q_not_null(spark, root):
    return _cust_orders(spark, root).where(FL.not_null("o_orderkey")).select(
        "c_custkey", "o_orderkey")


@register("dropna_any")
def q_dropna_any(spark, root):
    return FL.dropna_any(_cust_orders(spark, root)).select("c_custkey", "o_orderkey",
                                                           ds("o_orderdate"))


@register("drop_negative")
def q_drop_negative(spark, root):
    li = IO.read_table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") - 50000).alias("margin"))
    return FL.drop_negative(li, "margin").select("l_orderkey", "l_linenumber", r6("margin"))


def _lines(df):
    return df.select(CU, "sales_receipt", MN, ds("calendar_day"))


@register("trailing_12m")
def q_trailing(spark, root):
    return _lines(window(spark, root))


@register("fixed_range")
def q_fixed_range(spark, root):
    return _lines(FL.date_between(invoices(spark, root), "calendar_day", "1997-01-01",
                                  "1997-12-31"))


@register("area_filter")
def q_area_filter(spark, root):
    return _lines(FL.for_area(invoices(spark, root), "Metal"))


@register("family_exclude")
def q_family_exclude(spark, root):
    out = FL.exclude_families(invoices(spark, root),
                              {"Metal": ["LARGE/Brand#4/L", "STANDARD/Brand#16/L"]})
    return out.select(CA, CU, "sales_receipt", MN, "product_family")


def _qty(spark, root):
    return A.customer_item_qty(invoices(spark, root), (CA, CU, MN))


@register("positive_only")
def q_positive_only(spark, root):
    return FL.positive_only(_qty(spark, root), "product_orders")


@register("loyal_customers")
def q_loyal(spark, root):
    return FL.min_active_months(invoices(spark, root), 5).select(CU).distinct()


@register("diverse_customers")
def q_diverse(spark, root):
    df = FL.min_distinct_items(FL.min_active_months(invoices(spark, root), 5), 5)
    return df.select(CU).distinct()


@register("rowcount_guard")
def q_rowcount_guard(spark, root):
    md = TD.customer_master(spark, root)
    return FL.expect_reduced(md, FL.active_customer_master(md))


# ------------------------------------------------------------------ 2.3 projections
@register("region_label")
def q_region_label(spark, root):
    return PR.label_region(TD.customer_activity(spark, root).select("customer", "sales_region"))


@register("area_label")
def q_area_label(spark, root):
    c = TD.customer_activity(spark, root).select(
        "customer", F.col("sales_sector_of_customer").alias("customerdivision"))
    return PR.label_area(c)


@register("positional_rename")
def q_positional_rename(spark, root):
    return PR.positional_rename(IO.read_table(spark, root, "lineitem"),
                                ["l_orderkey", "l_partkey", "l_quantity"],
                                ["sales_receipt", "product_number", "soldnumber"])


@register("rename_columns")
def q_rename_columns(spark, root):
    return PR.rename(TD.products(spark, root), D.PRODUCT_RENAMES).select(
        "article_number", "product_field", "product_group", "product_class", "product_family",
        "productmodel")


@register("drop_columns")
def q_drop_columns(spark, root):
    return PR.drop_columns(TD.products(spark, root),
                           [" n_ac_status", "b_ac_is_in_eshop", "partition_value",
                            "not_a_column", "product_name", "n_product_area_nr"])


@register("share_rating")
def q_share_rating(spark, root):
    r = PR.raw_rating(FL.positive_only(_qty(spark, root), "product_orders"), "product_orders",
                      "share", MN, [CA], "avg_order")
    return r.select(CA, CU, MN, r6("raw_rating"))


def _turnover(spark, root):
    """Stored: a rating reads it for the items' means and for its rows."""
    def build():
        lines = stored(columns(spark, root, CA, CU, MN, "sales_value"), "lines")
        return stored(FL.positive_only(A.customer_item_value(lines, (CA, CU, MN)), "turnover"), "turnover")
    return once(("turnover", root), build)


@register("mean_rating")
def q_mean_rating(spark, root):
    r = PR.raw_rating(_turnover(spark, root), "turnover", "mean", MN, [CA], "avg_turnover")
    return r.select(CA, CU, MN, money("turnover", 4), money("avg_turnover"), r6("raw_rating"))


@register("cap_outlier")
def q_cap_outlier(spark, root):
    r = PR.raw_rating(_turnover(spark, root), "turnover", "mean", MN, [CA], "avg_turnover")
    return r.select(CA, CU, MN, F.round(PR.cap("raw_rating", 2.0), 6).alias("rating"))


@register("binary_interaction")
def q_binary(spark, root):
    from cartwise.plans.queries import ratings
    return all_ratings(spark, root).select(CA, CU, MN, PR.binarise("interaction").alias("interacted"))


@register("cast_keys")
def q_cast_keys(spark, root):
    df = invoices(spark, root).select(CU, MN, "cchierl3").distinct()
    return PR.cast_keys(df, [CU, MN, "cchierl3"], "bigint")


# ------------------------------------------------------------------ 2.7 scalar functions
def _part(spark, root):
    return IO.read_table(spark, root, "part")


@register("name_prefix")
def q_name_prefix(spark, root):
    p = _part(spark, root)
    return p.select("p_partkey",
                    X.name_prefix(F.concat_ws(":", "p_name", "p_brand")).alias("with_sep"),
                    X.name_prefix("p_type").alias("without_sep"))


@register("trim_text")
def q_trim(spark, root):
    return _part(spark, root).select("p_partkey", X.trim_text(
        F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("name"))


@register("like_match")
def q_like(spark, root):
    return _part(spark, root).where(X.like("p_type", "S%") & X.like("p_name", "%ring%", True)
                                    ).select("p_partkey", "p_type", "p_name")


@register("concat_month")
def q_concat_month(spark, root):
    return invoices(spark, root).select(
        CU, X.year_month_key("sales_year", "sales_month").alias("month_year")).distinct()


@register("rule_string")
def q_rule_string(spark, root):
    return pooled_rules(spark, root).select(
        arr("antecedent"), arr("consequent"), X.rule_text("antecedent", "consequent").alias("rules"))


@register("list_text")
def q_list_text(spark, root):
    a = parts(spark, root).actual
    return a.select(CA, CU, X.list_text("actual_products").alias("actual_products"))


@register("describe_bundle")
def q_describe(spark, root):
    from cartwise.plans import bundles as B
    u = B.union_bundles(mixed_parts(spark, root))
    return u.select(CA, CU, "method", X.describe_bundle(
        "actual_products", "most_similar_items", "recommend").alias("description"))


@register("truncate_label")
def q_truncate(spark, root):
    return _part(spark, root).select("p_partkey", X.truncate_label("p_name").alias("label"))


@register("strip_brackets")
def q_strip_brackets(spark, root):
    a = parts(spark, root).actual
    text = F.concat(F.lit("['"), F.array_join("actual_products", "', '"), F.lit("']"))
    return a.select(CA, CU, F.concat_ws(",", X.parse_list_text(text)).alias("actual_products"))


@register("split_text")
def q_split_text(spark, root):
    a = parts(spark, root).actual
    s = X.split_text(F.concat_ws(",", "actual_products"), ",")
    return a.select(CA, CU, F.size(s).alias("n"), F.array_join(s, "|").alias("joined"))


@register("year_month")
def q_year_month(spark, root):
    return invoices(spark, root).select(
        "sales_receipt", X.year_of("calendar_day").alias("y"),
        X.month_of("calendar_day").alias("m")).distinct()


@register("month_start")
def q_month_start(spark, root):
    o = IO.read_table(spark, root, "orders")
    return o.select("o_orderkey", F.date_format(X.month_start("o_orderdate", 1), "yyyy-MM-dd")
                    .alias("year_back"), F.date_format(X.month_start("o_orderdate"), "yyyy-MM-dd")
                    .alias("month_first"))


@register("round_n")
def q_round_n(spark, root):
    from cartwise.plans.queries import ratings
    r = all_ratings(spark, root)
    return r.select(CA, CU, MN, F.round("raw_rating", 3).alias("r3"),
                    F.round("raw_rating", 5).alias("r5"), F.round("raw_rating", 6).alias("r6"))


@register("array_set_sorted")
def q_sorted_set(spark, root):
    inv = invoices(spark, root)
    g = inv.groupBy("sales_receipt").agg(X.sorted_set(F.collect_set("product_name")).alias("s"))
    return g.select("sales_receipt", arr("s"), F.size("s").alias("n"))


@register("array_concat")
def q_array_concat(spark, root):
    r = pooled_rules(spark, root)
    return r.select(arr("antecedent"), arr("consequent"),
                    F.concat_ws(",", X.concat_arrays("antecedent", "consequent")).alias("joined"))


@register("array_unique")
def q_array_unique(spark, root):
    m = parts(spark, root).matched
    return m.select(CA, CU, F.concat_ws(",", X.unique(X.concat_arrays(
        "actual_products", "consequent"))).alias("items"))


@register("array_length")
def q_array_length(spark, root):
    a = parts(spark, root).actual
    return a.select(CA, CU, F.size("actual_products").alias("n"))


@register("array_get")
def q_array_get(spark, root):
    r = pooled_rules(spark, root)
    return r.select(arr("antecedent"), X.first_item("consequent").alias("consequent_item"))


@register("array_slice")
def q_array_slice(spark, root):
    a = parts(spark, root).actual
    return a.select(CA, CU, F.concat_ws(",", X.slice_head("actual_products", 2)).alias("head"))


@register("array_explode")
def q_array_explode(spark, root):
    r = pooled_rules(spark, root)
    return r.select(arr("antecedent"), arr("consequent"),
                    F.explode("antecedent").alias("antecedent_split"))


@register("set_overlap")
def q_set_overlap(spark, root):
    m = parts(spark, root).matched
    return m.select(CA, CU, F.round(X.jaccard("actual_products", "highest_similarity"), 6)
                    .alias("jaccard"))


# ------------------------------------------------------------------ 2.5 aggregates
@register("orders_per_item")
def q_orders_per_item(spark, root):
    return A.customer_item_qty(invoices(spark, root))


@register("turnover_per_item")
def q_turnover_per_item(spark, root):
    return A.customer_item_value(invoices(spark, root)).select(CU, MN, money("turnover", 4))


@register("item_total")
def q_item_total(spark, root):
    return A.item_total(A.customer_item_qty(invoices(spark, root)))


@register("item_mean")
def q_item_mean(spark, root):
    m = A.item_mean(A.customer_item_value(invoices(spark, root)))
    return m.select(MN, money("avg_turnover"))


@register("active_months")
def q_active_months(spark, root):
    return A.active_months(invoices(spark, root))


@register("distinct_items")
def q_distinct_items(spark, root):
    return A.distinct_items(invoices(spark, root))


@register("customer_item_set")
def q_item_set(spark, root):
    t = parts(spark, root).top
    return A.item_sets(t, CU, "item").select(CU, arr("actual_products"))


@register("interaction_pivot")
def q_pivot(spark, root):
    from cartwise.plans.queries import ratings
    return A.interaction_matrix(all_ratings(spark, root))


@register("distinct_rows")
def q_distinct_rows(spark, root):
    return IO.read_table(spark, root, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity").distinct()


@register("distinct_subset")
def q_distinct_subset(spark, root):
    return D.product_list(invoices(spark, root))


@register("product_list")
def q_product_list(spark, root):
    return D.product_list(window(spark, root))


# ------------------------------------------------------------------ 2.4 joins
@register("customer_master_join")
def q_master_join(spark, root):
    src = TD.sources(spark, root)
    latest = FL.latest_month(src["casa"], "calendar_yearmonth",
                             F.col("active_customer_cr") == "X")
    casa = FL.in_month(src["casa"], latest, "calendar_yearmonth").drop("customer_sales_view")
    md = FL.in_month(src["casa_md"], latest, "calendar_yearmonth").drop("calendar_yearmonth")
    j = casa.join(md, casa.customer == md.customer_sales_view)
    return j.select("customer", "sales_region", "customer_status")


@register("invoice_customer_join")
def q_inv_cust(spark, root):
    src = TD.sources(spark, root)
    cust = D.active_customers(src["casa"], src["casa_md"])
    inv = src["invoices"]
    return inv.join(cust, inv.soldtoparty == cust.customer).select(
        "soldtoparty", "order_number", "product", "sales_region", "region")


@register("invoice_product_join")
def q_inv_prod(spark, root):
    src = TD.sources(spark, root)
    prod = PR.rename(FL.active_products(src["products"]), D.PRODUCT_RENAMES)
    inv = src["invoices"]
    return inv.join(prod, prod.article_number == inv.product).select(
        "order_number", "product", "productmodel", "product_family")


@register("join_back_agg")
def q_join_back(spark, root):
    inv = invoices(spark, root).select(CU, "sales_receipt", MN, "sales_value")
    j = with_group_stat(inv, [CU], F.sum("sales_value"), "customer_total")
    return j.select(CU, "sales_receipt", MN, r6("customer_total"))


# ------------------------------------------------------------------ 2.8 scaling / L1, L6
def _als(spark, root, index=True):
    return als_input(spark, root, index)


@register("als_ratings")
def q_als_ratings(spark, root):
    r = _als(spark, root)
    return r.select(CA, CU, MN, money("turnover", 4), money("avg_turnover"), r6("raw_rating"), "purchased",
                    r6("rating"), r6("std_scaled_rating"), r6("minmax_scaled_rating"),
                    "customer_id", "product_id")


@register("minmax_scale")
def q_minmax(spark, root):
    r = _als(spark, root, False)
    return r.select(CA, CU, MN, r6("minmax_scaled_rating"))


@register("standard_scale")
def q_standard(spark, root):
    r = _als(spark, root, False)
    return r.select(CA, CU, MN, r6("std_scaled_rating"))


@register("string_index")
def q_string_index(spark, root):
    r = _als(spark, root, False)
    return M.dense_index(r, CU, "customer_id").select(CU, "customer_id").distinct()


@register("assemble_vector")
def q_vector(spark, root):
    r = M.to_vector(_als(spark, root, False), "rating", "rating_vector")
    return r.select(CA, CU, MN, F.round(M.from_vector("rating_vector"), 6).alias("rating"))


@register("ncf_ratings")
def q_ncf_ratings(spark, root):
    r = ncf_input(spark, root)
    return r.select(CA, CU, MN, "product_orders", r6("avg_order"), r6("raw_rating"), r6("rating"),
                    "interaction_round", "interaction")


@register("item_minmax_window")
def q_item_minmax(spark, root):
    from cartwise.operators.windows import scale_per_item
    r = ncf_input(spark, root)
    return scale_per_item(r, "rating", "scaled", MN, 3, keys=[CA]).select(CA, CU, MN, "scaled")


@register("purchased_flag")
def q_purchased(spark, root):
    return _als(spark, root, False).select(CA, CU, MN, "purchased")


@register("basket_window")
def q_basket_window(spark, root):
    """Receipts of the whole history, areas pooled."""
    from cartwise.plans.queries import pooled_baskets
    return pooled_baskets(spark, root).select(CU, "sales_receipt", arr("items"), "count")

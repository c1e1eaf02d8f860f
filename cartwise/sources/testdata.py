"""Adapter: present the driver's TPC-H-style tables as the four business
sources the bundle recommender reads (customer activity, customer master,
products, invoices), with business (semantic) column names.

Mapping (SURVEY 1.3): customer -> c_custkey, receipt -> l_orderkey,
model/product -> p_partkey, product name -> p_name, day -> o_orderdate,
quantity -> l_quantity, value -> l_extendedprice * (1 - l_discount),
region code -> 11 + n_regionkey, zero-padded, division -> market segment.
Product hierarchy: 'ALL' > p_type > p_type/p_brand > p_type/p_brand/size band
> p_partkey.  Flags are derived from real columns: a customer is in status 4
only with a positive account balance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise import config as C
from cartwise.sources.io import read_table

# Test-data adapter values: market segment -> customer division code.
SEGMENT_DIVISIONS = {
    "AUTOMOBILE": "AU",
    "BUILDING": "CO",
    "FURNITURE": "WO",
    "HOUSEHOLD": "EL",
    "MACHINERY": "ME",
}
# Snapshot month the customer tables are tagged with.
SNAPSHOT_MONTH = "200108"
# As-of date for trailing windows on the test data (its last order month).
AS_OF = "2001-08-15"


def _division(segment: str) -> F.Column:
    expr = None
    for seg, code in SEGMENT_DIVISIONS.items():
        cond = F.col(segment) == F.lit(seg)
        expr = F.when(cond, F.lit(code)) if expr is None else expr.when(cond, F.lit(code))
    return expr.otherwise(F.col(segment))


def size_band(col: str = "p_size") -> F.Column:
    return (F.when(F.col(col) <= 10, F.lit("S"))
            .when(F.col(col) <= 25, F.lit("M"))
            .otherwise(F.lit("L")))


def customer_activity(spark: SparkSession, root: str) -> DataFrame:
    """Monthly customer activity snapshot (one month in the test data)."""
    cust = read_table(spark, root, "customer")
    nation = read_table(spark, root, "nation").select("n_nationkey", "n_regionkey")
    # nation is a fixed 25-row dimension: broadcasting it is size-bounded.
    return (cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey)
            .select(
                F.col("c_custkey").cast("string").alias("customer"),
                F.col("c_custkey").cast("string").alias("customer_sales_view"),
                F.lit(SNAPSHOT_MONTH).alias("calendar_yearmonth"),
                F.lit(C.ACTIVE_FLAG).alias("active_customer_cr"),
                F.when(F.col("c_acctbal") >= 5000, F.lit("A")).otherwise(F.lit("B"))
                .alias("sml_turnover_class_cr"),
                F.lpad((F.col("n_regionkey") + 11).cast("string"), C.REGION_CODE_WIDTH, "0")
                .alias("sales_region"),
                _division("c_mktsegment").alias("sales_sector_of_customer"),
            ))


def customer_master(spark: SparkSession, root: str) -> DataFrame:
    """Customer master data snapshot."""
    cust = read_table(spark, root, "customer")
    return cust.select(
        F.col("c_custkey").cast("string").alias("customer_sales_view"),
        F.lit(SNAPSHOT_MONTH).alias("calendar_yearmonth"),
        F.lit(C.CUSTOMER_ACCOUNT_GROUP).alias("customer_account_group"),
        F.lit("").alias("deletion_flag_for_customer_sales_level"),
        F.when(F.col("c_acctbal") > 0, F.lit(C.CUSTOMER_STATUS_ACTIVE)).otherwise(F.lit(1))
        .alias("customer_status"),
        F.lit(C.SALES_CHANNEL).alias("sales_channel"),
    )


def products(spark: SparkSession, root: str) -> DataFrame:
    """Product master with its five-level hierarchy."""
    part = read_table(spark, root, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("s_p_product_number"),
        F.lit("ALL").alias("n_product_area_nr"),
        F.col("p_type").alias("n_product_group_nr"),
        F.concat_ws("/", "p_type", "p_brand").alias("n_product_class_nr"),
        F.concat_ws("/", "p_type", "p_brand", size_band()).alias("n_product_family_nr"),
        F.col("p_partkey").cast("string").alias("n_product_model_nr"),
        F.col("p_name").alias("product_name"),
        F.when(F.col("p_size") == 50, 4).otherwise(C.PRODUCT_STATUS_ACTIVE).alias("n_ac_status"),
        F.when(F.col("p_size") == 49, "false").otherwise(C.PRODUCT_IN_ESHOP).alias("b_ac_is_in_eshop"),
        F.lit(C.PRODUCT_PARTITION).alias("partition_value"),
    )


def invoice_headers(spark: SparkSession, root: str) -> DataFrame:
    """What ``invoices`` has from an order, with keys as they are stored."""
    return read_table(spark, root, "orders").select(
        F.col("o_orderkey").alias("order_number"), F.col("o_custkey").alias("soldtoparty"),
        F.col("o_orderdate").cast("date").alias("calendar_day"), F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("order_reason_statistic"), F.col("o_orderstatus").alias("customer_hierarchy_level_1"),
        F.col("o_totalprice").alias("custturnover_inv"))


def invoice_lines(spark: SparkSession, root: str) -> DataFrame:
    """What ``invoices`` has from an order line, with keys as they are stored."""
    return read_table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("order_number"), F.col("l_partkey").alias("product"),
        F.col("l_returnflag").alias("business_code"), F.col("l_suppkey").cast("string").alias("contact_point"),
        F.col("l_linestatus").alias("customer_hierarchy_level_2"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("customer_hierarchy_level_3"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("turnover_inv"),
        F.col("l_quantity").alias("invoice_quantity_in_sales_unit_inv"))


def invoices(spark: SparkSession, root: str) -> DataFrame:
    """Invoice lines: one row per order line, with order header fields."""
    # keys are text before the join, so that lines stay partitioned by ``order_number``
    li = read_table(spark, root, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order_number"), "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    od = read_table(spark, root, "orders").select(
        F.col("o_orderkey").cast("string").alias("_order"), "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    j = li.join(od, li.order_number == F.col("_order"))
    return j.select(
        F.col("o_orderdate").cast("date").alias("calendar_day"),
        F.col("o_custkey").cast("string").alias("soldtoparty"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("order_reason_statistic"),
        "order_number",
        F.col("l_returnflag").alias("business_code"),
        F.col("l_suppkey").cast("string").alias("contact_point"),
        F.col("o_orderstatus").alias("customer_hierarchy_level_1"),
        F.col("l_linestatus").alias("customer_hierarchy_level_2"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("customer_hierarchy_level_3"),
        F.col("o_totalprice").alias("custturnover_inv"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("turnover_inv"),
        F.col("l_quantity").alias("invoice_quantity_in_sales_unit_inv"),
        F.col("l_partkey").cast("string").alias("product"),
    )


def sources(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {
        "casa": customer_activity(spark, root),
        "casa_md": customer_master(spark, root),
        "products": products(spark, root),
        "invoices": invoices(spark, root),
        "headers": invoice_headers(spark, root),
        "lines": invoice_lines(spark, root),
    }

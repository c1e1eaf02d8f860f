"""What is shuffled grows with the rows, not with pairs, salts or partitions."""

import datetime
import re

from pyspark.sql import functions as F

from cartwise.config import BundleConfig
from cartwise.operators import interpret as G
from cartwise.operators import joins as J
from cartwise.operators import rules as R
from cartwise.operators import similarity as S
from cartwise.operators.scaling import minmax, standardise
from cartwise.operators.windows import top_items
from cartwise.plans import bundles as B
from cartwise.plans import dataset as D
from cartwise.plans import gmf as GMF
from cartwise.plans import models as MO
from cartwise.scope import CLEAN_UP, scope, stored


def test_only_hot_keys_repeat_their_statistic(spark):
    stat = spark.range(100).selectExpr("cast(id as string) as k", "id as s")
    hot = spark.createDataFrame([("7", 16)], "k string, _salts int")
    got = J.repeated(stat, hot, ["k"])
    assert got.count() == 115 and got.where("k = '7'").select("_salt").distinct().count() == 16
    rows = spark.range(1000).selectExpr("cast(id % 100 as string) as k", "id as v")
    assert J.salted_join(rows, stat, ["k"]).where("cast(k as long) = s").count() == 1000


def bought(spark):
    rows = [("a", "c%d" % c, "item %d" % (i * (c + 1) % 23)) for c in range(12) for i in range(8)]
    rows = sorted(set(rows)) + [("a", None, "item 1"), (None, "c1", "item 1"), ("a", "c1", None)]
    return spark.createDataFrame(rows, "customer_area string, customernumber string, item string")


def pairs_by_hand(b, ordered):
    held, found = {}, {}
    for area, cust, item in b.dropna().collect():
        held.setdefault((area, cust), []).append(item)
    for items in held.values():
        for x in items:
            for y in items:
                if x < y or (x != y and not ordered):
                    found[x, y] = found.get((x, y), 0) + 1
    return found


def test_a_purchase_is_one_row_whatever_its_pairs(spark):
    b = bought(spark)
    counts = b.groupBy("customer_area", "item").agg(F.count("*").alias("_n"))
    rows, tasks = S.partner_rows(b, counts, ["customer_area"], "customernumber", F.col("item"), 1024, lambda e, x: x > e)
    assert rows.count() <= b.dropna().count() and tasks >= 1
    assert rows.agg(F.sum(F.size("_with"))).first()[0] == sum(pairs_by_hand(b, True).values())


def test_partners_of_a_hot_item_are_dealt(spark, monkeypatch):
    b = bought(spark)
    whole = {(r.a, r.b): r.co for r in S.co_purchase(b).collect()}
    top = sorted(map(tuple, S.top_similar_items(b).collect()), key=str)
    monkeypatch.setattr(S, "HOT_BUYERS", 2)
    assert {(r.a, r.b): r.co for r in S.co_purchase(b, chunk=3).collect()} == whole == pairs_by_hand(b, True)
    assert sorted(map(tuple, S.top_similar_items(b, chunk=3).collect()), key=str) == top


def sources(spark):
    casa = spark.createDataFrame([("1", "1", "200108", "X", "000000000011", "ME"), ("2", "2", "200108", "X", "000000000012", "AU")],
                                 "customer string, customer_sales_view string, calendar_yearmonth string, active_customer_cr string, "
                                 "sales_region string, sales_sector_of_customer string")
    md = spark.createDataFrame([("1", "200108", "DEBI", "", 4, "RV")] * 2 + [("2", "200108", "DEBI", "", 4, "RV")],
                               "customer_sales_view string, calendar_yearmonth string, customer_account_group string, "
                               "deletion_flag_for_customer_sales_level string, customer_status int, sales_channel string")
    prod = spark.createDataFrame([("p", "ALL", "g", "c", "f", "m", n, 5, "true", "ACTUAL") for n in ("name", "name", "other")],
                                 "s_p_product_number string, n_product_area_nr string, n_product_group_nr string, n_product_class_nr string, "
                                 "n_product_family_nr string, n_product_model_nr string, product_name string, n_ac_status int, "
                                 "b_ac_is_in_eshop string, partition_value string")
    day = datetime.date(2001, 1, 2)
    lines = [(day, c, day, "r", "o1", "b", "k", "x", "y", None, 9.0, v, 1.0, "p") for c, v in
             [("1", 5.0), ("1", 5.0), ("1", 6.0), ("2", -1.0), ("2", 2.0)]]
    inv = spark.createDataFrame(lines, "calendar_day date, soldtoparty string, order_date date, order_reason_statistic string, "
                                "order_number string, business_code string, contact_point string, customer_hierarchy_level_1 string, "
                                "customer_hierarchy_level_2 string, customer_hierarchy_level_3 string, custturnover_inv double, "
                                "turnover_inv double, invoice_quantity_in_sales_unit_inv double, product string")
    return {"casa": casa, "casa_md": md, "products": prod, "invoices": inv}


def test_lines_merge_before_the_joins(spark):
    fact = D.build_invoices(sources(spark))
    got = sorted((r.customernumber, r.sales_value, r.product_name) for r in fact.collect())
    assert got == [(c, v, n) for c, v in (("1", 5.0), ("1", 6.0), ("2", 2.0)) for n in ("name", "other")]
    plan = fact.select("customernumber", "sales_value")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Project") and plan.index("Join") < plan.index("Aggregate")


def test_als_blocks_follow_the_ratings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert MO.als_blocks(spark.range(1000)) == 12
        assert MO.als_blocks(spark.range(30_500_000)) == 31
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_few_strata(spark):
    assert [GMF.block_count(n) for n in (0, 400_000, 25_000_000)] == [2, 2, 4]


def test_ratings_are_built_once_for_both_indexes(spark):
    lines = [("a", "c%d" % (i % 5), "m%d" % (i % 3), float(i + 1)) for i in range(20)]
    inv = spark.createDataFrame(lines, "customer_area string, customernumber string, model_number string, sales_value double")
    with scope() as own:
        r = MO.als_ratings(inv)
        assert r.count() == 15 and len(own.frames) == 1 and own.frames[0].storageLevel.useMemory
        own.release()


def small_invoices(spark):
    rows = [("Metal" if c % 2 else "Wood", f"c{c}", f"m{(c * i) % 7}", f"r{c}{i}", float(i + 1), 10.0 * i + 1, 1997, i % 7 + 1)
            for c in range(9) for i in range(8)]
    return spark.createDataFrame(rows, "customer_area string, customernumber string, model_number string, sales_receipt string, "
                                 "soldnumber double, sales_value double, sales_year int, sales_month int")


def test_ratings_build_the_lines_once(spark):
    """Statistics joined back multiplied the plan: item_minmax_window had 7959 exchanges."""
    inv = small_invoices(spark)
    with scope() as own:
        for r in (D.customer_ratings(inv), MO.als_ratings(inv, index=False), MO.ncf_ratings(inv, min_months=2, min_items=1)):
            assert r.count() > 0
            leaves = r._jdf.queryExecution().optimizedPlan().collectLeaves()
            read = [leaves.apply(i).output().mkString(",") for i in range(leaves.size())]
            assert not any("sales_receipt" in columns for columns in read), read  # a column of the lines only
        own.release()


def shuffle_files(spark) -> set[str]:
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in held.mkString("\n").splitlines() if "shuffle_" in f}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = spark.conf.get(CLEAN_UP, None)
    was = shuffle_files(spark)
    counted = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert sorted(map(tuple, counted.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert not shuffle_files(spark) - was and spark.conf.get(CLEAN_UP, None) == before
    top = B.BundleParts(bundle_invoices(spark), CFG).neighbours
    assert top.count() > 0 and "Scan parquet" in top._jdf.queryExecution().executedPlan().toString()


CFG = BundleConfig(min_support=0.05, min_confidence=0.1)


def bundle_invoices(spark):
    rows = [(("Metal", "Wood")[c % 2], f"c{c}", f"m{(c * i) % 7}", f"r{c}{i // 3}", float(i + 1), f"f{i % 2}")
            for c in range(12) for i in range(9)]
    return spark.createDataFrame(rows, "customer_area string, customernumber string, model_number string, sales_receipt string, "
                                 "soldnumber double, product_family string")


def test_steps_of_a_bundle_run_do_not_repeat_each_others_plans(spark):
    """The plan of bundle_by_rule had 75 million characters."""
    with scope() as own:
        p = B.BundleParts(bundle_invoices(spark), CFG)
        assert p.rules.count() > 0 and p.matched.count() > 0
        for frame in (p.rules, p.top, p.matched, p.unmatched):
            assert len(frame._jdf.queryExecution().toString()) < 20_000
        whole = R.best_rule(R.jaccard_candidates(p.top, p.rules), p.rules)
        columns = ["customer_area", "customernumber", "antecedent", "consequent", "jaccard"]
        assert sorted(map(tuple, R.best_match(p.top, p.rules).select(columns).collect())) == sorted(
            map(tuple, whole.select(columns).collect()))
        own.release()


def test_marks_are_counted_where_they_are_listed(spark):
    products = spark.createDataFrame([("all", "g1", "c1", "f1", "m1"), ("all", "g1", "c2", "f2", "m2"), ("all", "g1", "c2", "f2", "m3")],
                                     "product_field string, product_group string, product_class string, product_family string, model_number string")
    actual = spark.createDataFrame([("x", "m1"), ("x", "m1"), ("y", "m2"), (None, "m2")], "customernumber string, model_number string")
    predicted = spark.createDataFrame([("x", "m1"), ("x", "m2"), ("z", "m3"), ("z", None)], "customernumber string, model_number string")
    marks = G.compare_sets(actual, predicted, products)
    got = {(r.customernumber, r.level, r.node): r.status for r in marks.collect()}
    assert got["x", 4, "m1"] == "actual" and got["x", 0, "all"] == got["x", 3, "f1"] == "predicted"
    assert got["y", 3, "f2"] == got[None, 4, "m2"] == "actual" and len(got) == 23
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate")]


def test_an_areas_rows_do_not_meet_in_one_task(spark):
    """AQE may broadcast the bounds of the areas, but only after this shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = small_invoices(spark)
        scaled = minmax(rows, "soldnumber", "to", 0.0, 10.0, by=["customer_area"])
        top = top_items(scaled, 2, ["customer_area", "customernumber"], "to", "model_number")
        for r in (top, standardise(rows, "soldnumber", "to", by=["customer_area"])):
            plan = r._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(customer_area" in plan  # the bounds themselves
            assert not re.search(r"hashpartitioning\(customer_area#\d+, \d+\)", plan[:plan.find("BroadcastExchange")])
        assert top.count() == 18
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

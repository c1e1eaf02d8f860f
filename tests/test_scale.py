"""No default cuts, mining at each area's own count, hot keys, session folders,
and release of persisted frames."""

import pytest
from pyspark.sql import functions as F

from cartwise import config as C
from cartwise.config import BundleConfig
from cartwise.operators import aggregates as A
from cartwise.operators import filters as FL
from cartwise.operators import interpret as G
from cartwise.operators import projections as PR
from cartwise.operators import rules as R
from cartwise.operators.joins import salted_join, with_group_stat
from cartwise.operators.windows import scale_per_item
from cartwise.scope import once, persist, scope, shared
from cartwise.session import ensure_checkpoint_dir


def test_no_frequency_cap_by_default(spark):
    b = spark.range(5000).select(F.lit("X").alias("customer_area"),
                                 F.expr("if(id % 2 = 0, array('a', 'b'), array('c'))").alias("items"))
    assert BundleConfig().max_itemset_freq is None
    got = {(tuple(r.antecedent), r.consequent[0]) for r in R.area_rules(b, min_support=0.1).collect()}
    assert got == {(("a",), "b"), (("b",), "a")}
    assert R.area_rules(b, min_support=0.1, max_freq=C.MAX_ITEMSET_FREQ).count() == 0


def test_small_amounts_are_not_rounded_away(spark):
    df = spark.createDataFrame([("c", "m", 0.004), ("c", "n", 0.0), ("d", "m", 0.00001)],
                               "customernumber string, model_number string, sales_value double")
    t = FL.positive_only(A.customer_item_value(df), "turnover")
    assert {(r[0], r[1]): r[2] for r in t.collect()} == {("c", "m"): 0.004, ("d", "m"): 0.00001}


def test_cap_is_off_without_a_limit(spark):
    df = spark.createDataFrame([(50.0,)], "x double")
    assert df.select(PR.cap("x"), PR.cap("x", 10.0)).first()[:] == (50.0, 10.0)


def test_uneven_areas_are_mined_at_their_own_count(spark):
    big = spark.range(5000).selectExpr("'big' as customer_area", "array_distinct(transform(sequence(1, 4), "
                                       "i -> cast(pmod(xxhash64(id, i), 30) as string))) as items")
    small = spark.range(20).selectExpr("'small' as customer_area", "array('1', cast(id % 3 + 2 as string)) as items")
    both = big.unionByName(small)
    fits = R.area_fits(both, {"big": 5000, "small": 20}, min_support=0.01)
    assert [areas for areas, _ in fits] == [["small"], ["big"]]
    raw = {areas[0]: sets for areas, sets in fits}
    assert raw["big"].agg(F.min("freq")).first()[0] >= 50
    sets, _ = R.area_itemsets(both, min_support=0.01)
    got = {(r.customer_area, tuple(r["items"]), r.freq) for r in sets.collect()}
    want = set()
    for area in ("big", "small"):
        one = R.frequent_itemsets(both.where(F.col("customer_area") == area), 0.01)
        want |= {(area, tuple(r["items"]), r.freq) for r in one.collect()}
    assert got == want


def test_fit_groups():
    assert R.fit_groups({"a": 3, "b": 5, "c": 7, "d": 100}) == [["a", "b"], ["c"], ["d"]]


@pytest.fixture
def no_broadcast(spark):
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def skewed(spark, n=20_000):
    return spark.range(n).selectExpr("if(id % 10 < 8, 'hot', cast(id % 50 as string)) as model_number",
                                     "id as customer", "cast(id % 7 + 1 as double) as v")


def test_a_hot_key_is_dealt_over_tasks(spark, no_broadcast):
    rows = skewed(spark)
    stat = rows.groupBy("model_number").agg(F.sum("v").alias("s"))
    joined = salted_join(rows, stat, ["model_number"])
    assert "_salt" in joined._jdf.queryExecution().executedPlan().toString()
    largest = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 0.6 * rows.count()
    plain = rows.join(stat, "model_number")
    assert joined.select(*plain.columns).exceptAll(plain).count() == 0 and joined.count() == plain.count()


def test_stat_joins_are_salted(spark, no_broadcast):
    rows = skewed(spark, 500)
    for df in (with_group_stat(rows, ["model_number"], F.sum("v"), "s"),
               PR.raw_rating(rows, "v", keys=[]), scale_per_item(rows, "v", "o")):
        assert "_salt" in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 500


def test_checkpoint_folder_is_only_made_locally():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Context:
        def __init__(self, master):
            self.master, self.made = master, None

        def getCheckpointDir(self):
            return self.made

        def setCheckpointDir(self, path):
            self.made = path

    class Session:
        def __init__(self, master, **conf):
            self.sparkContext, self.conf = Context(master), Conf(conf)

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session("spark://host:7077"))
    assert ensure_checkpoint_dir(Session("local[2]"))
    shared = Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs:///shared"})
    assert ensure_checkpoint_dir(shared) == "hdfs:///shared" == shared.sparkContext.made


def test_one_shared_scope_at_a_time(spark):
    with scope(shared("a")):
        part = once("k", lambda: persist(spark.range(5)))
    with scope(shared("a")):
        assert once("k", lambda: None) is part
    shared("b")
    assert not part.storageLevel.useMemory
    with scope(shared("a")):
        assert once("k", lambda: 1) == 1


def test_persisted_frames_go_with_their_scope(spark):
    with scope() as own:
        part = once("k", lambda: persist(spark.range(10)))
        assert once("k", lambda: None) is part
        out = part.selectExpr("id + 1 as id")
    assert part.storageLevel.useMemory and out.count() == 10
    own.release()
    assert not part.storageLevel.useMemory and out.count() == 10


def test_a_label_at_two_levels_gives_no_duplicates(spark):
    edges = spark.createDataFrame([("ALL", "x", 1), ("x", "x", 2), ("x", "y", 3)], "parent string, child string, level int")
    marked = spark.createDataFrame([("c", 1, "x", "actual"), ("c", 2, "x", "predicted")],
                                   "customernumber string, level int, node string, status string")
    assert {tuple(r) for r in G.prune_tree(edges, marked).collect()} == {("c", "x", "x", 2), ("c", "x", "y", 3)}
    links = G.marked_links(edges, marked).collect()
    assert {tuple(r) for r in links} == {("c", "ALL", "x", 1, "actual"), ("c", "x", "x", 2, "predicted")}
    assert len(links) == 2


def test_node_titles(spark):
    edges = spark.createDataFrame([("1", "2", 0.5)], "from string, to string, value double")
    names = spark.createDataFrame([("1", "b"), ("1", "a")], "model_number string, product_name string")
    got = {r["id"]: r["title"] for r in G.rule_nodes(edges, names).collect()}
    assert got == {"1": "a", "2": None}


def test_invoice_time_levels_hold(spark):
    from cartwise.plans import dataset as D
    from cartwise.sources import testdata as TD
    src = TD.sources(spark, "/root/testdata/sf0.001")
    plain = D.build_invoices(src)
    was = src["invoices"].withColumn("product_family_int_product", F.lit("before"))
    assert D.build_invoices(src | {"invoices": was}).select("product_family").distinct().collect() == [("before",)]
    got = D.build_invoices(src | {"invoices": was})
    assert got.columns == plain.columns and got.count() <= plain.count()


def test_repeated_source_rows_merge(spark):
    """Repeated lines, customers and products, also ones that differ in a column that the
    result doesn't hold, leave the same distinct rows."""
    from cartwise.plans import dataset as D
    from cartwise.sources import testdata as TD
    src = TD.sources(spark, "/root/testdata/sf0.001")
    plain = D.build_invoices(src)
    n = plain.count()
    assert n > 0 and plain.distinct().count() == n
    extra = {k: df.withColumn("not_in_the_result", F.lit(1)).unionByName(df.withColumn("not_in_the_result", F.lit(2)))
             for k, df in src.items() if k in ("invoices", "products")}
    for k in ("casa", "casa_md"):
        extra[k] = src[k].unionAll(src[k])
    got = D.build_invoices(extra)
    assert got.columns == plain.columns and got.count() == n
    assert got.exceptAll(plain).count() == 0


def test_date_filters_reach_the_scan(spark):
    from cartwise.plans.queries import QUERIES
    spark.catalog.clearCache()  # else a kept fact of another test stands in for the scan
    for name in ("trailing_12m", "fixed_range"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        scan = next(x for x in plan.splitlines() if "o_orderdate" in x and "PushedFilters" in x)
        assert "(o_orderdate" in scan[scan.index("PushedFilters"):], scan


def test_both_kinds_of_bundles(spark):
    # at sf0.001 every area's minimum count is 1, so every customer matches a rule there
    from cartwise.plans.queries import QUERIES
    df = QUERIES["union_bundles"](spark, "/root/testdata/sf0.01")
    got = {r["method"]: r["count"] for r in df.groupBy("method").count().collect()}
    assert got.get("rule", 0) > 0 and got.get("similarity", 0) > 0

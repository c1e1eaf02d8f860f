"""Slim invoice lines, rounds of neighbours and what stays on disk."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from cartwise.operators import similarity as S
from cartwise.plans import dataset as D
from cartwise.plans import models as MO
from cartwise.scope import scope


def sources(spark):
    casa = spark.createDataFrame(
        [("1", "1", "200108", "X", "000000000011", "ME"), ("1", "1", "200108", "X", "000000000012", "ME"),
         ("2", "2", "200108", "X", "000000000012", None), ("3", "3", "200108", "X", "000000000013", "AU")],
        "customer string, customer_sales_view string, calendar_yearmonth string, active_customer_cr string, "
        "sales_region string, sales_sector_of_customer string")
    md = spark.createDataFrame([(c, "200108", "DEBI", "", 4, "RV") for c in "123"],
                               "customer_sales_view string, calendar_yearmonth string, customer_account_group string, "
                               "deletion_flag_for_customer_sales_level string, customer_status int, sales_channel string")
    prod = spark.createDataFrame([(p, "ALL", "g", "c", "f", m, n, 5, "true", "ACTUAL") for p, m, n in (
        ("7", "m", "name"), ("7", "m", "name"), ("7", "m", "other"), ("8", None, "none"), ("9", "m", "name"))],
        "s_p_product_number string, n_product_area_nr string, n_product_group_nr string, n_product_class_nr string, "
        "n_product_family_nr string, n_product_model_nr string, product_name string, n_ac_status int, "
        "b_ac_is_in_eshop string, partition_value string")
    day = datetime.date(2001, 1, 2)
    heads = [(1, 1, day, day, "r", "x", 9.0), (1, 1, day, day, "r", "x", 9.0), (1, 1, day, None, "r", "x", 9.0), (2, 2, day, day, "r", "x", 9.0),
             (3, 3, day, day, "r", "x", 9.0), (None, 3, day, day, "r", "x", 9.0), (4, None, day, day, "r", "x", 9.0)]
    head = spark.createDataFrame(heads, "order_number long, soldtoparty long, calendar_day date, order_date date, "
                                        "order_reason_statistic string, customer_hierarchy_level_1 string, custturnover_inv double")
    lines = [(o, p, flag, "k", y, None, v, 1.0) for o in (1, 2, 3, 4, None) for p in (7, 8, 9, None)
             for flag, y, v in (("b", None, 5.0), ("b", None, 5.0), (None, "b", 5.0), ("b", "b", 5.0), ("b", None, -1.0), ("b", None, None))]
    line = spark.createDataFrame(lines, "order_number long, product long, business_code string, contact_point string, "
                                        "customer_hierarchy_level_2 string, customer_hierarchy_level_3 string, turnover_inv double, "
                                        "invoice_quantity_in_sales_unit_inv double")
    text = [F.col(c).cast("string").alias(c) if c in ("soldtoparty", "product", "order_number") else c
            for c in dict.fromkeys(head.columns + line.columns)]
    return {"casa": casa, "casa_md": md, "products": prod, "headers": head, "lines": line, "invoices": head.join(line, "order_number").select(*text)}


def test_slim_columns_are_those_of_the_whole_layout(spark):
    src = sources(spark)
    whole = D.build_invoices(src)
    for names in (["customer_area", "customernumber", "model_number", "sales_value"], ["soldnumber"], ["sales_year", "sales_receipt"],
                  ["product_name", "product_family", "customer_area"], whole.columns):
        want = sorted(map(str, map(tuple, whole.select(*names).collect())))
        assert want and sorted(map(str, map(tuple, D.invoice_columns(src, names).collect()))) == want
    assert {tuple(r) for r in D.invoice_columns(src, ["product_name"], merged=False).collect()} == {("name",), ("other",)}


def test_lines_move_only_what_is_asked_for(spark):
    plan = D.invoice_columns(sources(spark), ["customernumber", "model_number", "soldnumber"])._jdf.queryExecution().optimizedPlan().toString()
    merging = next(line for line in plan.splitlines() if "Aggregate" in line and "_l#" in line)
    assert "xxhash64" not in merging and "contact_point" not in merging and "turnover_inv" not in merging


def test_rounds_find_the_same_neighbours(spark, monkeypatch):
    rows = sorted({("a" if c % 3 else "b", "c%d" % c, "item %d" % (i * (c + 1) % 23)) for c in range(12) for i in range(8)})
    rows += [("a", None, "item 1"), (None, "c1", "item 1"), ("a", "c1", None)]
    b = spark.createDataFrame(rows, "customer_area string, customernumber string, item string")
    whole = sorted(map(tuple, S.top_similar_items(b).collect()), key=str)
    done = []
    kept = S.stored
    monkeypatch.setattr(S, "stored", lambda df, tag: done.append(tag) or kept(df, tag))
    monkeypatch.setattr(S, "ROUND_PAIRS", 100)
    for chunk in (1024, 3):
        assert whole and sorted(map(tuple, S.top_similar_items(b, chunk=chunk).collect()), key=str) == whole
    assert done.count("round") >= 6


def test_ratings_are_not_built_twice(spark):
    """Their lines were: once for the items' means and once for the rows."""
    lines = [("a", "c%d" % (i % 5), "m%d" % (i % 3), float(i + 1)) for i in range(20)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    schema = "customer_area string, customernumber string, model_number string, sales_value double"
    inv = spark.createDataFrame(lines, schema).mapInArrow(count, schema)
    with scope() as own:
        assert MO.als_ratings(inv).count() == 15 and read.value == 20
        own.release()


def test_pairs_are_counted_in_tiles(spark, monkeypatch):
    """Every purchase moved an array of its customer's items, by name."""
    rows = sorted({("a" if c % 3 else "b", "c%d" % c, "item %d" % (i * (c + 1) % 23)) for c in range(12) for i in range(8)})
    rows += [("a", None, "item 1"), (None, "c1", "item 1"), ("a", "c1", None), ("a", "c1", "item 2"), ("b", "c0", "only")]
    want, held, buyers = {}, {}, {}
    for area, cust, item in rows:
        buyers[area, item] = buyers.get((area, item), 0) + 1
        if None not in (area, cust, item):
            held.setdefault((area, cust), []).append(item)
    for (area, _), items in held.items():
        for x in items:
            for y in items:
                if x < y:
                    want[area, x, y] = want.get((area, x, y), 0) + 1
    want = {(a, x, y, n, buyers[a, x], buyers[a, y]) for (a, x, y), n in want.items()}
    b = spark.createDataFrame(rows, "customer_area string, customernumber string, item string")
    for chunk, blocks in ((1024, 1), (1024, 4), (3, 1), (3, 4)):
        monkeypatch.setattr(S.T, "block_count", lambda pairs, partitions: blocks)
        found = [tuple(r) for r in S.co_purchase(b, chunk=chunk).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    empty = S.co_purchase(b.limit(0))
    assert empty.count() == 0 and [c for c in empty.columns] == ["customer_area", "a", "b", "co", "n_a", "n_b"]


def test_blocks_and_sums_of_tiles(monkeypatch):
    from cartwise.operators import tiles as T
    assert [T.block_count(n, 200) for n in (0, 66e6, 660e6)] == [5, 5, 9] and T.block_count(0, 1) == 1
    keys = np.array([5, 3, 5, 3, 3])
    [(k, n)] = T.summed([(keys, None), (np.array([9, 3]), np.array([2, 4]))])
    assert k.tolist() == [3, 5, 9] and n.tolist() == [7, 2, 2]
    ends = np.array([0, 3, 3, 5])
    x, y = T.within(np.arange(5), ends)
    assert list(zip(x, y)) == [(0, 1), (0, 2), (1, 2), (3, 4)]
    x, y = T.crossed(np.arange(5), ends, np.arange(10, 14), np.array([0, 1, 2, 4]))
    assert list(zip(x, y)) == [(0, 10), (1, 10), (2, 10), (3, 12), (3, 13), (4, 12), (4, 13)]


def test_a_step_is_run_once_and_old_factors_go(spark, monkeypatch):
    """A checkpoint ran every step of a fit twice, and all of its states stayed."""
    import os

    from cartwise.plans import gmf as G
    rows = [(u, i, 0.2 + 0.6 * (u % 2 == i % 2)) for u in range(12) for i in range(8) if (u * i) % 5]
    train = spark.createDataFrame(rows, "customer_id long, product_id long, interaction double")
    kept, tables = G.stored, []
    monkeypatch.setattr(G, "stored", lambda df, tag: tables.append((tag, kept(df, tag))) or tables[-1][1])
    model = G.fit(train, train, [G.Point(factors=2), G.Point(factors=3)], epochs=3, blocks=2)
    left = [tag for tag, table in tables if os.path.exists(table.stored_at.removeprefix("file://"))]
    assert len([tag for tag, _ in tables if tag == "state"]) >= 2 and left.count("state") <= 2 and "ratings" not in left
    assert model.customers.count() == 2 * len({u for u, _, _ in rows}) and {len(r.vec) for r in model.products.collect()} == {3, 4}
    assert G.predict(train, model, [1]).select("point").distinct().collect()[0][0] == 1

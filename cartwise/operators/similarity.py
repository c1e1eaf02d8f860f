"""Item-item cosine similarity and the fallback bundles (section 2.10, J5, J7, J10).

The customer x item matrix is never pivoted: it stays in long form and the
co-purchase counts come from arrays: each purchase meets the array of what its
customer bought, goes with it to its item's task, and pairs are counted there.  A
customer with a very long history is split into hash chunks of about ``chunk`` items;
chunk pairs are separate join groups, so no group holds more than chunk x chunk pairs
of one customer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise import config as C
from cartwise.operators import tiles as T
from cartwise.operators.joins import ROWS, salted_join
from cartwise.operators.scaling import ordered_numbers
from cartwise.scope import stored

DEFAULT_CHUNK = 1024
#: Pairs that a task counts, on average; buyers of an item whose partners stay together.
TASK_PAIRS, HOT_BUYERS = 4_000_000, 100_000
#: Pairs that are shuffled at once where only an item's best are kept.
ROUND_PAIRS = 500_000_000


def purchases(ratings: DataFrame, keys: Sequence[str] = ("customer_area",),
              cust: str = "customernumber", item: str = "model_number",
              value: str = "interaction", use_raw: bool = False) -> DataFrame:
    """A8 + P10: binary (keys, customer, item) rows with a positive summed value
    (or every purchase with ``use_raw``)."""
    df = ratings.select(*keys, cust, F.col(item).alias("item"), value)
    g = df.groupBy(*keys, cust, "item").agg(F.sum(value).alias("_v"))
    if not use_raw:
        g = g.where(F.col("_v") > 0)
    return g.drop("_v")


def item_ids(bought: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, item, _id, _n): a whole number and the number of buyers of each item
    of a group.  Numbers come from a range-partitioned sort (row numbers within
    partitions of a hash), so they fit in 32 bits and don't depend on run order."""
    counts = bought.groupBy(*keys, "item").agg(F.count("*").alias("_n"))
    buckets = 64  # a bucket's items are numbered in order; bucket b takes b, b + 64, ...
    of = F.pmod(F.xxhash64(*keys, "item"), F.lit(buckets))
    w = Window.partitionBy("_b").orderBy(*keys, "item")
    return (counts.withColumn("_b", of)
            .withColumn("_id", (F.row_number().over(w) - 1) * buckets + F.col("_b")).drop("_b"))


def partner_rows(bought: DataFrame, counts: DataFrame, keys: Sequence[str], cust: str, entry: Column,
                 chunk: int, mine: Callable[[Column, Column], Column]) -> tuple[DataFrame, int]:
    """(keys, _e, _with): for every purchase its item's ``entry`` and the entries of the
    same customer that ``mine(entry, other)`` lets through, one array for each chunk; and
    the number of tasks that hold ``TASK_PAIRS`` of these pairs each.

    A pair is a place in an array here, not a row, so shuffling purchases with their
    arrays moves a fraction of what rows of pairs would.  ``counts`` has (keys, item)
    once, with what ``entry`` reads."""
    lists, pairs = customer_lists(bought, counts, keys, cust, entry, chunk)
    return met_rows(lists, keys, cust, mine), task_count(lists, pairs)


def task_count(df: DataFrame, pairs: float) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))


def customer_lists(bought: DataFrame, counts: DataFrame, keys: Sequence[str], cust: str, entry: Column,
                   chunk: int) -> tuple[DataFrame, float]:
    """(keys, cust, _m, _c, _l): the entries of a customer's ``_m`` chunks, chunk ``_c`` in
    ``_l``; and the number of ordered pairs in them."""
    whole = bought.dropna(subset=[*keys, cust, "item"])
    held = whole.groupBy(*keys, cust).agg(F.count(F.lit(1)).alias("_k"))
    pairs = held.agg(F.sum(F.col("_k").cast("double") * F.col("_k"))).first()[0] or 0.0
    # customers of more than a chunk: at most a row for each ``chunk`` purchases
    many = held.where(F.col("_k") > chunk).select(*keys, cust, F.ceil(F.col("_k") / F.lit(chunk)).cast("int").alias("_m"))
    b = (salted_join(whole, counts, [*keys, "item"]).join(F.broadcast(many), [*keys, cust], "left")
         .withColumn("_m", F.coalesce("_m", F.lit(1))))
    lists = (b.withColumn("_c", F.pmod(F.xxhash64("item"), F.col("_m")).cast("int"))
             .groupBy(*keys, cust, "_m", "_c").agg(F.collect_list(entry).alias("_l")))
    return lists, pairs


def met_rows(lists: DataFrame, keys: Sequence[str], cust: str, mine: Callable[[Column, Column], Column],
             own: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``partner_rows`` for the entries that ``own`` lets through.  A customer
    of one chunk meets in its row."""
    chosen = F.col("_own") if own is None else F.filter("_own", own)
    # every ordered pair of chunks of a customer is a group of its own
    many, places = lists.where("_m > 1"), F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    left = many.select(*keys, cust, F.col("_c").alias("ca"), places.alias("cb"), F.col("_l").alias("_own"))
    right = many.select(*keys, cust, places.alias("ca"), F.col("_c").alias("cb"), F.col("_l").alias("_others"))
    met = left.join(right, [*keys, cust, "ca", "cb"]).select(*keys, "_own", "_others").unionByName(
        lists.where("_m = 1").select(*keys, F.col("_l").alias("_own"), F.col("_l").alias("_others")))
    met = met.select(*keys, F.explode(chosen).alias("_e"), "_others")
    rows = met.select(*keys, "_e", F.filter("_others", lambda x: mine(F.col("_e"), x)).alias("_with"))
    return rows.where(F.size("_with") > 0)


def _number(col: str) -> Column:
    return F.shiftrightunsigned(col, 32)


def _buyers(col: str) -> Column:
    return F.col(col).bitwiseAND(F.lit(0xFFFFFFFF))


def partner_counts(bought: DataFrame, ids: DataFrame, keys: Sequence[str], cust: str, chunk: int,
                   mine: Callable[[Column, Column], Column]) -> DataFrame:
    """(_e, _o, co): the number of shared customers of an item and each partner that
    ``mine`` lets through.  Both are packed: number in the upper 32 bits, number of buyers
    in the lower.

    An item's arrays meet in one task, where its pairs are counted without another
    shuffle; the partners of an item of more than ``HOT_BUYERS`` buyers are dealt over
    several by a hash."""
    return _counted(*partner_rows(bought, ids, keys, cust, _entry(), chunk, mine))


def _entry() -> Column:
    return F.shiftleft("_id", 32) + F.col("_n")


def _counted(rows: DataFrame, tasks: int) -> DataFrame:
    classes = F.ceil(_buyers("_e") / F.lit(HOT_BUYERS)).cast("int")
    part = F.when(classes <= 1, F.col("_with")).otherwise(
        F.filter("_with", lambda x: F.pmod(F.xxhash64(x), classes) == F.col("_class")))
    dealt = (rows.select("_e", "_with", F.explode(F.sequence(F.lit(0), F.greatest(classes, F.lit(1)) - 1)).alias("_class"))
             .select("_e", "_class", part.alias("_with")).repartition(tasks, "_e", "_class"))
    return (dealt.select("_e", "_class", F.explode("_with").alias("_o"))
            .groupBy("_e", "_class", "_o").agg(F.count(F.lit(1)).alias("co")).drop("_class"))


def pair_counts(bought: DataFrame, ids: DataFrame, keys: Sequence[str],
                cust: str, chunk: int) -> DataFrame:
    """(_pair, co, _nn): the number of shared customers of every item pair, and the
    product of the items' numbers of buyers; the smaller id stands in the upper 32 bits
    of ``_pair``."""
    counted = partner_counts(bought, ids, keys, cust, chunk, lambda e, x: x > e)
    return counted.select((F.shiftleft(_number("_e"), 32) + _number("_o")).alias("_pair"), "co",
                          (_buyers("_e") * _buyers("_o")).alias("_nn"))


def co_purchase(bought: DataFrame, keys: Sequence[str] = ("customer_area",),
                cust: str = "customernumber", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Number of shared customers for every item pair a < b (keys, a, b, co, n_a, n_b).

    All pairs are the result, so they are counted in tiles of items (``operators.tiles``):
    a customer's items travel as numbers, once to each of their tiles, and a counted pair is
    named there.  Purchases, numbers and customers' lists are stored."""
    keys = list(keys)
    bought = stored(bought, "bought")
    counts = bought.groupBy(*keys, "item").agg(F.count("*").alias("_n"))
    ids = stored(ordered_numbers(counts, [*keys, "item"], "_id"), "ids")
    lists, pairs = customer_lists(bought, ids.withColumn(ROWS, F.col("_n")), keys, cust, F.col("_id"), chunk)
    lists = stored(lists, "lists")
    many = lists.where("_m > 1").select(*keys, cust, "_c", "_l")  # two chunks of a customer meet as well
    other = many.select(*keys, cust, F.col("_c").alias("_d"), F.col("_l").alias("right_ids"))
    met = many.join(other, [*keys, cust]).where("_c < _d").select(F.col("_l").alias("left_ids"), "right_ids")
    names = ids.dropna(subset=[*keys, "item"]).select(*keys, "item", F.col("_id").alias("id"), F.col("_n").alias("n"))
    blocks = T.block_count(pairs / 2, int(bought.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return T.pairs_of_lists(names, lists.select(F.col("_l").alias("ids")), met, keys, blocks)


def item_cosine(bought: DataFrame, keys: Sequence[str] = ("customer_area",),
                cust: str = "customernumber", chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Cosine of binary item columns, co / sqrt(n_a * n_b), for pairs with
    at least one shared customer, both directions (keys, item, other, co, sim).
    Each pair is counted once and turned into its two directions in its row."""
    keys = list(keys)
    sim = (F.col("co") / F.sqrt((F.col("n_a") * F.col("n_b")).cast("double"))).alias("sim")
    both = F.explode(F.array(F.struct(F.col("a").alias("item"), F.col("b").alias("other")),
                             F.struct(F.col("b").alias("item"), F.col("a").alias("other"))))
    return (co_purchase(bought, keys, cust, chunk).select(*keys, "co", sim, both.alias("_d"))
            .select(*keys, "_d.item", "_d.other", "co", "sim"))


def top_similar(sims: DataFrame, k: int = C.NEIGHBOURS_PER_ITEM,
                keys: Sequence[str] = ("customer_area",),
                digits: int = C.SIMILARITY_DIGITS) -> DataFrame:
    """The ``k`` most similar other items per item (sim desc, item asc),
    self never returned; scores rounded.  Kept as row_number <= k so each map
    task pre-limits before the shuffle (WindowGroupLimit)."""
    keys = list(keys)
    w = Window.partitionBy(*keys, "item").orderBy(F.desc("sim"), F.asc("other"))
    return (sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("sim_score", F.round("sim", digits)))


def _directions(pairs: DataFrame) -> DataFrame:
    """Both directions of counted pairs, scored: (_i, _o, co, sim)."""
    i, j = F.shiftrightunsigned("_pair", 32), F.col("_pair").bitwiseAND(F.lit(0xFFFFFFFF))
    both = F.explode(F.array(F.struct(i.alias("_i"), j.alias("_o")), F.struct(j.alias("_i"), i.alias("_o"))))
    return pairs.select(both.alias("_d"), "co", (F.col("co") / F.sqrt(F.col("_nn").cast("double"))).alias("sim")).select(
        "_d._i", "_d._o", "co", "sim")


def reaching(pairs: DataFrame, k: int) -> DataFrame:
    """The directions of counted pairs that can be among the ``k`` best of their item.

    An item's partners fall into ``k`` classes by number; the least of the classes'
    best scores is reached by ``k`` partners, so it is a floor of the k-th best.  It takes
    one aggregate, combined before the shuffle; what is below is never sorted.  Items
    with an empty class keep all."""
    each = _directions(pairs)
    classes = each.groupBy("_i", F.pmod("_o", F.lit(k)).alias("_c")).agg(F.max("sim").alias("_best"))
    floor = classes.groupBy("_i").agg(F.min("_best").alias("_floor"), F.count("*").alias("_k")).where(F.col("_k") == k)
    kept = each.join(floor.drop("_k"), "_i", "left").where(F.col("_floor").isNull() | (F.col("sim") >= F.col("_floor")))
    return kept.drop("_floor")


def top_similar_items(bought: DataFrame, k: int = C.NEIGHBOURS_PER_ITEM, keys: Sequence[str] = ("customer_area",),
                      cust: str = "customernumber", digits: int = C.SIMILARITY_DIGITS,
                      chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """I1 + W4 in one: the rows of ``top_similar(item_cosine(...))``.

    Items are numbered in the order of their names, so ties break on numbers; an item's
    partners are counted and cut to its ``k`` best where its arrays meet, and only those
    get names.  Purchases and customers' lists are stored.  Items go in rounds of
    ``ROUND_PAIRS`` pairs on average: only a round's winners stay, so arrays on disk don't
    grow with the pairs."""
    keys = list(keys)
    bought = stored(bought, "bought")
    counts = bought.groupBy(*keys, "item").agg(F.count("*").alias("_n"))
    ids = stored(ordered_numbers(counts, [*keys, "item"], "_id"), "ids")
    lists, pairs = customer_lists(bought, ids.withColumn(ROWS, F.col("_n")), keys, cust, _entry(), chunk)
    lists, rounds = stored(lists, "lists"), max(1, math.ceil(pairs / ROUND_PAIRS))
    best = Window.partitionBy("_i").orderBy(F.desc("sim"), F.asc("_o"))

    def winners(at: int) -> DataFrame:
        own = None if rounds == 1 else lambda e: F.pmod(F.xxhash64(e, F.lit("round")), F.lit(rounds)) == at
        counted = _counted(met_rows(lists, keys, cust, lambda e, x: x != e, own), task_count(lists, pairs / rounds))
        sim = F.col("co") / F.sqrt((_buyers("_e") * _buyers("_o")).cast("double"))
        each = counted.select(_number("_e").alias("_i"), _number("_o").alias("_o"), "co", sim.alias("sim"))
        top = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return top if rounds == 1 else stored(top, "round")

    top = reduce(DataFrame.unionByName, map(winners, range(rounds)))
    named = top.join(ids.select(F.col("_id").alias("_i"), *keys, "item"), "_i").join(
        ids.select(F.col("_id").alias("_o"), F.col("item").alias("other")), "_o")
    return named.select(*keys, "item", "other", "co", "sim", "rank", F.round("sim", digits).alias("sim_score"))


def head_neighbours(unmatched: DataFrame, top: DataFrame, keys: Sequence[str] = ("customer_area",),
                    cust: str = "customernumber",
                    n_items: int = C.FALLBACK_ITEMS_PER_CUSTOMER) -> DataFrame:
    """W6 + J7: the first ``n_items`` products of each unmatched customer (rank
    order) joined to their nearest neighbours."""
    keys = list(keys)
    heads = unmatched.select(*keys, cust, F.explode(F.slice("actual_products", 1, n_items))
                             .alias("item"))
    return heads.join(top.select(*keys, "item", "other", "rank", "sim_score"), [*keys, "item"])


def attach_names(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Names of neighbour and source item (inner joins; a model with several
    names fans out, as in the original)."""
    names = products.select("model_number", "product_name")
    return (rows.join(names.withColumnRenamed("model_number", "other")
                      .withColumnRenamed("product_name", "similar_product_name"), "other")
            .join(names.withColumnRenamed("model_number", "item")
                  .withColumnRenamed("product_name", "actual_product_name"), "item"))


def collect_recommendations(rows: DataFrame, keys: Sequence[str] = ("customer_area",),
                            cust: str = "customernumber") -> DataFrame:
    """Per (customer, item) the distinct neighbours in rank order and the
    distinct names (sorted); bounded by neighbours per item."""
    keys = list(keys)
    aggs = [F.array_sort(F.collect_set(F.struct("rank", "other"))).alias("_l")]
    named = "similar_product_name" in rows.columns
    if named:
        aggs += [F.array_sort(F.collect_set("similar_product_name")).alias("similar_names"),
                 F.array_sort(F.collect_set("actual_product_name")).alias("actual_names")]
    g = rows.groupBy(*keys, cust, "item").agg(*aggs)
    return g.select(*keys, cust, "item",
                    F.array_distinct(F.transform("_l", lambda x: x["other"])).alias(
                        "most_similar_items"),
                    *(["similar_names", "actual_names"] if named else []))


def score_lists(rows: DataFrame, keys: Sequence[str] = ("customer_area",),
                cust: str = "customernumber") -> DataFrame:
    """A11 (scores): per (customer, item) the neighbour scores in rank order,
    kept as a typed array paired by position with the neighbours."""
    keys = list(keys)
    g = (rows.select(*keys, cust, "item", "rank", "other", "sim_score").distinct()
         .groupBy(*keys, cust, "item")
         .agg(F.array_sort(F.collect_list(F.struct("rank", "other", "sim_score"))).alias("_s")))
    return g.select(*keys, cust, "item", F.transform("_s", lambda x: x["sim_score"]).alias("sim_score"))


def score_left_join(reco: DataFrame, scores: DataFrame, keys: Sequence[str] = ("customer_area",),
                    cust: str = "customernumber") -> DataFrame:
    """Scores onto recommendations, left join on (customer, item)."""
    return reco.join(scores, [*keys, cust, "item"], "left")


def fallback_bundles(unmatched: DataFrame, top: DataFrame, products: DataFrame | None = None,
                     keys: Sequence[str] = ("customer_area",), cust: str = "customernumber",
                     n_items: int = C.FALLBACK_ITEMS_PER_CUSTOMER) -> DataFrame:
    """For customers without a rule, their first ``n_items`` products each
    bundled with its nearest neighbours.  One row per (customer, product);
    recommend = product ++ neighbours (order-keeping distinct)."""
    keys = list(keys)
    rows = head_neighbours(unmatched, top, keys, cust, n_items)
    if products is not None:
        rows = attach_names(rows, products)
    reco = collect_recommendations(rows, keys, cust)
    out = score_left_join(reco, score_lists(rows, keys, cust), keys, cust)
    out = out.withColumn("actual_products", F.array("item"))
    out = out.withColumn("recommend", F.array_distinct(F.concat("actual_products",
                                                                "most_similar_items")))
    if products is not None:
        out = out.withColumn("recommend_name", F.array_distinct(
            F.concat("actual_names", "similar_names"))).drop("actual_names", "similar_names")
    return out.withColumn("rules_count", F.size("recommend")).drop("item")

"""Orders joined with their items: totals per order and the most expensive orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.checkpoints import checkpoint_timed
from millrace.sources.text import sample_rows


def join_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Inner join on `order_id`. A hot order is split at run time, as an inner join allows on either side."""
    return orders.join(items, "order_id")


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """order_id, order_date, sum_goods_price: the item total per order and date.

    Items are summed up before they meet the orders, so a hot order sends one row per task. Orders are dealt out by
    order_id, which both the count of copies per (order_id, order_date) and the join accept: one shuffle for each side.
    """
    per_order = items.groupBy("order_id").agg(F.sum("goods_price").alias("item_sum"))
    copies = orders.repartition("order_id").groupBy("order_id", "order_date").agg(F.count(F.lit(1)).alias("copies"))
    return copies.join(per_order, "order_id").select(
        "order_id", "order_date", (F.col("item_sum") * F.col("copies")).cast("double").alias("sum_goods_price"))


def top_orders(
    orders: DataFrame, items: DataFrame, n: int = 5, fraction: float = 1.0, seed: int = 42, checkpoint: bool = False
) -> DataFrame:
    """The `n` orders with the highest item total; ties by newest date, then by id.

    With `checkpoint` the joined rows are checkpointed before they are summed up, as a run that measures the
    cost of a checkpoint needs it.
    """
    orders, items = sample_rows(orders, fraction, seed), sample_rows(items, fraction, seed)
    if checkpoint:
        joined, _ = checkpoint_timed(
            join_orders(orders.select("order_id", "order_date"), items.select("order_id", "goods_price")), "orders")
        totals = joined.groupBy("order_id", "order_date").agg(
            F.sum("goods_price").cast("double").alias("sum_goods_price"))
    else:
        totals = order_totals(orders, items)
    return totals.orderBy(
        F.desc_nulls_last("sum_goods_price"), F.desc_nulls_last("order_date"), "order_id").limit(n)

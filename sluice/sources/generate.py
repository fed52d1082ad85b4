"""Seeded related tables: every attribute is a function of the row's number, every reference resolves."""

from __future__ import annotations

from fractions import Fraction
from math import floor
from random import Random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables and their share of all rows (fixed values).
SHARES = {"stock": 1, "purchase": 3, "select_product": 2, "add_to_cart": 2}
STATES = ("SC", "RS", "PR", "SP", "RJ", "MG", "BA", "PE")
STATUS = ("created", "paid", "shipped", "delivered", "returned")


def split_rows(total: int, seed: int, jitter: float = 0.1) -> dict[str, int]:
    """Rows of each table, together exactly `total`: one for each, the rest by largest remainder of jittered shares."""
    if total < len(SHARES):
        raise ValueError(f"{len(SHARES)} tables need a row each")
    draw = Random(seed)
    shares = {name: Fraction(share * (1 + draw.uniform(-jitter, jitter))) for name, share in SHARES.items()}
    quota = {name: (total - len(SHARES)) * share / sum(shares.values()) for name, share in shares.items()}
    rows = {name: 1 + floor(q) for name, q in quota.items()}
    for name in sorted(quota, key=lambda n: floor(quota[n]) - quota[n])[: total - sum(rows.values())]:
        rows[name] += 1
    return rows


def _draw(seed: int, name: str, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(n) if isinstance(n, int) else n)


def _pick(seed: int, name: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(seed, name, len(values)) + 1).cast("int"))


def generate(spark: SparkSession, total: int, seed: int = 1) -> dict[str, DataFrame]:
    """stock, purchase, select_product and add_to_cart; product references are keys of stock."""
    rows = split_rows(total, seed)
    products = max(1, rows["stock"])
    user = F.concat(F.lit("u"), _draw(seed, "user", max(1, total // 50)))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + _draw(seed, "time", 30_000_000))
    product = lambda name: _draw(seed, name, products) + 1
    numbers = lambda name: spark.range(1, rows[name] + 1)
    return {
        "stock": numbers("stock").select(
            F.col("id").alias("product_id"), F.concat(F.lit("Product "), "id").alias("product_name"), (_draw(seed, "category", 12) + 1).alias("category_id"),
            _pick(seed, "state", STATES).alias("state"), (_draw(seed, "cents", 99_000) / 100 + 1).alias("price"), _draw(seed, "quantity", 500).alias("quantity_available"), at.alias("timestamp"),
        ),
        "purchase": numbers("purchase").select(
            F.concat(F.lit("ORD-"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("order_number"), user.alias("user_id"), product("bought").alias("product_id"),
            _pick(seed, "status", STATUS).alias("order_status"), (_draw(seed, "items", 9) + 1).alias("quantity"), (_draw(seed, "rating", 5) + 1).alias("rating"), at.alias("timestamp"),
        ),
        "select_product": numbers("select_product").select(user.alias("user_id"), product("viewed").alias("selected_product_id"), _draw(seed, "suggested", 20).alias("suggested_product_count"), at.alias("timestamp")),
        "add_to_cart": numbers("add_to_cart").select(F.concat(F.lit("cart-"), _draw(seed, "cart", max(1, total // 10))).alias("shopping_cart_id"), user.alias("user_id"), product("carted").alias("cart_product_id"), (_draw(seed, "pieces", 9) + 1).alias("cart_quantity"), at.alias("timestamp")),
    }

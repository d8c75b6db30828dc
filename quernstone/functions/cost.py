"""Token costs. The vendor decides how cached tokens count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import model_alias

#: Factors of cached tokens against input tokens.
CACHE_WRITE, CACHE_READ = 1.25, 0.10


class PriceError(Exception):
    """A model without a price: cost is never taken to be zero."""


PRICE = "vendor string, model string, input_price double, output_price double"


def price_table(spark: SparkSession, prices: Sequence[tuple]) -> DataFrame:
    """The caller's prices, in USD per million tokens, by the model's id without a date."""
    return spark.createDataFrame(list(prices), PRICE)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """The same from a JSON file of objects; none is shipped, as prices change."""
    return spark.read.schema(PRICE).option("multiLine", True).json(path)


def cost_usd(vendor: Column, prompt: Column, completion: Column, write: Column, read: Column, input_price: Column, output_price: Column) -> Column:
    """``added``: cache tokens come on top of prompt tokens; ``inside``: cached tokens are
    part of them; ``own``: free."""
    added = prompt + CACHE_WRITE * write + CACHE_READ * read
    inside = F.greatest(prompt - read, F.lit(0)) + CACHE_READ * read
    tokens = F.when(vendor == "added", added).when(vendor == "inside", inside).otherwise(F.lit(0.0))
    return tokens * input_price / 1e6 + F.when(vendor == "own", F.lit(0.0)).otherwise(completion * output_price / 1e6)


def priced(calls: DataFrame, prices: DataFrame, check: bool = True) -> DataFrame:
    """``calls`` (model, prompt_tokens, completion_tokens, cache_write_tokens,
    cache_read_tokens) with ``cost_usd``; the price is found by the model without date.
    ``check`` looks once for models that have no price, among the distinct models only."""
    named = calls.withColumn("alias", model_alias(F.col("model")))
    prices = prices.withColumnRenamed("model", "alias")
    if check:
        models = calls.select("model").distinct().withColumn("alias", model_alias(F.col("model")))
        missing = [r[0] for r in models.join(prices.select("alias"), "alias", "left_anti").select("model").limit(10).collect()]
        if missing:
            raise PriceError(f"no price for {', '.join(map(str, missing))}")
    out = named.join(prices, "alias", "left")
    c = F.col
    return out.withColumn("cost_usd", cost_usd(c("vendor"), c("prompt_tokens"), c("completion_tokens"), c("cache_write_tokens"), c("cache_read_tokens"), c("input_price"), c("output_price")))

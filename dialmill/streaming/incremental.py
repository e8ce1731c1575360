"""Restartable processing (ST1 to ST4, J11, J12, J15): batch anti joins, and checkpointed streams of files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialmill.runtime import stash
from dialmill.sources import readers


def todo(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose key isn't done."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("missing_in", F.lit("b")).unionByName(y.join(x, key, "left_anti").withColumn("missing_in", F.lit("a")))


def cached(requests: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Requests with the cached value, null where it must be asked for."""
    c = cache.select(F.col(key).alias("__k"), F.col(value))
    return requests.join(c, requests[key] == c["__k"], "left").drop("__k")


def ask(requests: DataFrame, judge: Callable[[dict], str | None], name: str = "value", tries: int = 3, pause: float = 0.0) -> DataFrame:
    """requests with the judge's value, null after ``tries`` failures; one Python process a task, batch by batch.

    After a failure a task waits ``pause`` seconds, twice as long after each further one (ST4). A retried task asks
    again, so the judge must be idempotent.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                got = None
                for n in range(tries):
                    try:
                        got = judge(row)
                    except (OSError, ValueError):
                        got = None
                    if got is not None:
                        break
                    if pause and n + 1 < tries:
                        time.sleep(pause * 2**n)
                out.append(got)
            yield pdf.assign(**{name: out})

    return requests.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in requests.dtypes) + f", `{name}` string")


def said(reply: Column, reasoning: Column) -> Column:
    """A judge's text: its reply, or where that is blank its reasoning."""
    return F.coalesce(F.nullif(F.trim(reply), F.lit("")), F.nullif(F.trim(reasoning), F.lit("")))


def answered(requests: DataFrame, path: str, key: str, judge: Callable[[dict], str | None], name: str = "value", **how) -> DataFrame:
    """requests with their values, through a cache table at path (ST2): only keys that aren't there are asked.

    Failures aren't cached, so a rerun asks for them again; cached values stay as they are. ``cached`` says which were there.
    """
    spark = requests.sparkSession
    kind = dict(requests.dtypes)[key]
    there = spark.read.schema(f"`{key}` {kind}, `{name}` string").parquet(path) if readers.first_existing(spark, path) else spark.createDataFrame([], f"`{key}` {kind}, `{name}` string")
    before = stash(cached(requests, there, key, name).withColumn("cached", F.col(name).isNotNull()), "cache-met")
    fresh = stash(ask(before.filter("NOT cached").drop(name), judge, name, **how), "cache-asked")
    fresh.filter(F.col(name).isNotNull()).select(key, name).dropDuplicates([key]).write.mode("append").parquet(path)
    return before.filter("cached").unionByName(fresh)


def stream_table(spark: SparkSession, path: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Stateful deduplication: the first row of each key over all batches (ST3)."""
    return stream.dropDuplicates(keys)


def drain(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what is there and stop; a rerun continues after the last committed batch (ST1, K5)."""
    def batch(df: DataFrame, n: int) -> None:
        (transform(df) if transform else df).write.mode("overwrite").parquet(f"{path}/batch={n}")  # a repeated batch replaces itself

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

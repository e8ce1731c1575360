"""Sources (S1 to S26): explicit schemas, never inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialmill.runtime import placed

STRINGS = "array<string>"
SEED = (
    "seed_id string, split string, category_id int, category string, subcategory string, scenario string, user_goal string, customer_role string, service_stage string, "
    "required_facts array<string>, required_questions array<string>, required_actions array<string>, prohibited_actions array<string>, tool_required boolean, tool_name string"
)
TOOLS = "tools array<struct<name:string, description:string, parameters:struct<properties:map<string,struct<type:string, enum:array<string>>>, required:array<string>>>>"
RECORD = "seed_id string, split string, category_id int, category string, subcategory string, scenario string, sample_type string, variant string, tool_name string, messages array<struct<role:string, content:string>>, tool_call struct<name:string, arguments:map<string,string>>"
PAIR = "messages array<struct<role:string, content:string>>, chosen struct<role:string, content:string>, rejected struct<role:string, content:string>, seed_id string, category_id int, defect_type string, source string, score_chosen int, score_rejected int, margin int, len_chosen int, len_rejected int"
ANSWER = "seed_id string, category_id int, category string, subcategory string, question string, answer string, model string"


def seeds(spark: SparkSession, *paths: str, expect: int | None = None) -> DataFrame:
    """Rule rows of JSON-lines files, later files' rows last; blank lines are skipped. With expect, another count raises."""
    out = spark.read.schema(SEED).json([*paths])
    if expect is not None and (n := out.count()) != expect:
        raise ValueError(f"{expect} seeds expected, {n} found")
    return out


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def checked_seeds(spark: SparkSession, *paths: str, expect: int, split: str | None = None, per_category: int | None = None) -> DataFrame:
    """Seeds sorted by id; another count, split or number in a category raises."""
    out = seeds(spark, *paths, expect=expect)
    if split is not None and (n := out.filter(~F.col("split").eqNullSafe(split)).count()):
        raise ValueError(f"{n} seeds of another split than {split}")
    if per_category is not None and (odd := out.groupBy("category_id").count().filter(F.col("count") != per_category).limit(5).collect()):
        raise ValueError(f"{per_category} seeds a category expected: {[(r.category_id, r['count']) for r in odd]}")
    return out.orderBy("seed_id")


def keyed_folder(spark: SparkSession, path: str, key: str, schema: str = SEED) -> DataFrame:
    """The rows of a folder's JSON-lines files, one per key: the last file's, by name."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(path).withColumn("__order", F.concat_ws("|", "_metadata.file_name", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")))
    return last_by_key(rows, key, "__order").drop("__order")


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first of the paths that is there, in any store that Spark reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    return None


def prompt(spark: SparkSession, path: str) -> str:
    """A text file, whole, as a parameter of generation."""
    return spark.read.text(path, wholetext=True).first().value


def questions(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A fixed list of questions with their numbers."""
    return spark.createDataFrame(list(enumerate(texts)), "n int, question string")


def tool_names(spark: SparkSession, path: str) -> list[str]:
    """Registered names; without a registry none, which turns the check of names off (S10). As many as there are tools."""
    return [r.tool_name for r in tools(spark, path).select("tool_name").collect()] if first_existing(spark, path) else []


def tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with their file and line number) of JSON-lines files."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    lines = placed(raw, ["file"], ["__block", "__row"]).filter(F.trim("value") != "")
    parsed = lines.withColumn("ok", F.try_parse_json("value").isNotNull()).withColumn("row", F.from_json("value", schema))
    return parsed.filter("ok").select("row.*"), parsed.filter("NOT ok").select("file", (F.col("__place") + 1).alias("line_number"), F.col("value").alias("line"))


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad row fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tools(spark: SparkSession, path: str) -> DataFrame:
    """tool_name, description, properties, required of a registry document."""
    one = spark.read.schema(TOOLS).option("multiLine", True).json(path).select(F.explode("tools").alias("t"))
    return one.select(F.col("t.name").alias("tool_name"), F.col("t.description").alias("description"), F.col("t.parameters.properties").alias("properties"), F.col("t.parameters.required").alias("required"))


def array_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of a JSON array document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers of a .jsonl file or a JSON array, by suffix."""
    return spark.read.schema(ANSWER).option("multiLine", not path.endswith(".jsonl")).json(path)


def with_aliases(rows: DataFrame) -> DataFrame:
    """Rule inputs whose lists may be named without ``required_``; missing columns get empty defaults."""
    has = {c.lower() for c in rows.columns}
    out = rows
    for name in ("facts", "questions", "actions"):
        got = [F.col(c) for c in (f"required_{name}", name) if c in has]
        out = out.withColumn(f"required_{name}", F.coalesce(*got, F.array().cast(STRINGS)))
    for name, default in (("prohibited_actions", F.array().cast(STRINGS)), ("tool_required", F.lit(False)), ("scenario", F.lit("")), ("user_goal", F.lit(""))):
        out = out.withColumn(name, F.coalesce(F.col(name), default) if name in has else default)
    return out


def trainer_messages(spark: SparkSession, *paths: str) -> DataFrame:
    """The messages of several training files as one stream."""
    return spark.read.schema("messages array<struct<role:string, content:string>>").json([*paths])

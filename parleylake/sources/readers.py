"""Sources: JSONL, JSON, CSV and Parquet rows, manifests, held-out sets, restored JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JSON_COLUMNS = ("tools", "messages", "metadata", "context", "chosen", "rejected")


def jsonl(spark: SparkSession, path: str, schema: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """One object a line, blank lines skipped; FAILFAST stops at a bad line, DROPMALFORMED leaves it out."""
    reader = spark.read.option("mode", mode)
    return (reader.schema(schema) if schema else reader).json(path)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(raw, file): lines with text, unparsed; what the adapters read."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("raw"), F.col("_metadata.file_name").alias("file"))


def any_rows(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None, recursive: bool = False) -> DataFrame:
    """Rows of a path by its ending: .parquet, .csv, .json (one array or object), else JSONL."""
    fmt = fmt or next((f for f in ("parquet", "csv", "json") if path.rstrip("/").endswith("." + f)), "jsonl")
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if schema:
        reader = reader.schema(schema)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "csv":
        return reader.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    return reader.option("multiLine", fmt == "json").option("mode", "FAILFAST").json(path)


def restore(rows: DataFrame, columns: tuple[str, ...] = JSON_COLUMNS) -> DataFrame:
    """JSON text columns as VARIANT, kept as a string value where the text is not JSON."""
    for name in columns:
        if name in rows.columns and rows.schema[name].dataType.typeName() == "string":
            rows = rows.withColumn(name, F.coalesce(F.try_parse_json(name), F.to_variant_object(F.struct(F.col(name).alias("text")))))
    return rows


def identified(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """``record_id``: the key, with #n on its nth repetition in file and row order."""
    nth = F.row_number().over(Window.partitionBy("__k").orderBy(*order))
    return rows.withColumn("__k", key).withColumn("__n", nth).withColumn("record_id", F.when(F.col("__n") == 1, F.col("__k")).otherwise(F.concat_ws("#", "__k", F.col("__n").cast("string")))).drop("__k", "__n")


def evaluation_examples(splits: dict[str, DataFrame], quarantined: DataFrame | None = None, ident: str = "example_id") -> DataFrame:
    """Rows of all splits, each id once with its splits; quarantined ids left out."""
    every = None
    for number, (name, rows) in enumerate(sorted(splits.items())):
        part = rows.withColumn("__split", F.lit(name)).withColumn("__order", F.lit(number))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    if quarantined is not None:
        every = every.join(quarantined.select(ident).distinct(), ident, "left_anti")
    fields = [c for c in every.columns if c not in (ident, "__split", "__order")]
    return every.groupBy(ident).agg(F.min_by(F.struct(*fields), "__order").alias("r"), F.array_sort(F.collect_set("__split")).alias("splits")).select(ident, "r.*", "splits")


def preference_pairs(rows: DataFrame, least: int = 0) -> DataFrame:
    """Distinct (prompt, chosen, rejected); an empty field, an equal pair or too few rows is an error."""
    pairs = rows.select("prompt", "chosen", "rejected").dropDuplicates()
    bad = pairs.where("prompt is null or chosen is null or rejected is null or prompt = '' or chosen = rejected").limit(1).count()
    if bad:
        raise ValueError("preference pairs need a prompt and two different replies")
    if pairs.count() < least:
        raise ValueError(f"fewer than {least} preference pairs")
    return pairs


def samples(rows: DataFrame) -> DataFrame:
    """(id, prompt) of benchmark rows: prompt, or the user messages' text; id, or a hash of the prompt."""
    prompt = F.col("prompt") if "prompt" in rows.columns else F.lit(None).cast("string")
    if "messages" in rows.columns:
        prompt = F.coalesce(prompt, F.array_join(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["content"]), " "))
    ident = F.col("id").cast("string") if "id" in rows.columns else F.lit(None).cast("string")
    return rows.select(F.coalesce(ident, F.sha2(prompt, 256)).alias("id"), prompt.alias("prompt"))


def checked(rows: DataFrame, ident: str, n: int | None = None) -> DataFrame:
    """Rows whose ids are unique and, if ``n`` is given, as many as their manifest says."""
    counted = rows.agg(F.count("*").alias("n"), F.count_distinct(ident).alias("d")).first()
    if counted["n"] != counted["d"]:
        raise ValueError(f"{ident} repeats")
    if n is not None and counted["n"] != n:
        raise ValueError(f"{counted['n']} rows; the manifest has {n}")
    return rows

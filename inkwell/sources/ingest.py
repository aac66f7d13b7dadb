"""Strict ingestion of JSON lines and plain text, and plain sinks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from inkwell.functions.text import preview


@pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(x: Column) -> Column:
    """Canonical composition. Plain ASCII, which it cannot change, stays in the JVM's column; the rest goes through Arrow."""
    return F.when(x.rlike(r"[^\x00-\x7F]"), _nfc(F.when(x.rlike(r"[^\x00-\x7F]"), x))).otherwise(x)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of each text file, lines from 1, one trailing carriage return dropped, no last empty line. Line
    numbers need a file whole, so a file is one row; split large inputs into files."""
    files = spark.read.format("binaryFile").load(path)
    good = F.try_validate_utf8(F.col("content").cast("string"))
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace(good, "\n$", ""), "\n")).alias("n", "line"))
    return lines.select("path", (F.col("n") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def shape_error(x: Column) -> Column:
    """What forbids a text, or null."""
    return F.when(x != F.btrim(x, F.lit(" \t\n\x0b\x0c\r")), "text must not have leading or trailing whitespace").when(
        x.rlike(r"[\n\r\t]"), "text must not contain line breaks or tabs")


def ingest(lines: DataFrame, source: str, prompt_id: str, form: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(records, issues) from numbered lines.

    records: id, text, source, prompt_id, line_no. issues: line_no, id, severity (error or warning), message. ``auto`` means JSON
    lines if the first line with content begins with a brace. Only the key ``text`` is read; others are reported as dropped. An id is
    the prompt and twelve digits of the content's sha256, with -dK for the K-th copy. Callers that want all or nothing
    check ``issues`` for errors before they write.
    """
    if form == "auto":
        first = lines.where(F.btrim("line") != "").orderBy("line_no").limit(1).select(F.ltrim("line").startswith("{").alias("j")).first()
        form = "jsonl" if first is None or first.j else "text"
    rows = lines.where(F.btrim("line") != "")
    if form == "jsonl":
        keys = F.json_object_keys("line")
        rows = rows.select(
            "line_no", keys.alias("keys"), F.get_json_object("line", "$.text").alias("text"),
            F.try_variant_get(F.try_parse_json("line"), "$.text", "string").isNull().alias("no_text"),
            (F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), "$.text", "variant")) == "STRING").alias("is_string"),
            F.try_parse_json("line").isNull().alias("bad"))
        error = (
            F.when(F.col("bad"), "invalid JSON").when(F.col("keys").isNull(), "record: expected a JSON object")
            .when(~F.array_contains("keys", "text"), "text: missing").when(~F.coalesce("is_string", F.lit(False)), "text: must be a string")
            .when(F.col("text") == "", "text: must not be empty"))
        dropped = F.array_remove("keys", "text")
    else:
        rows = rows.select("line_no", F.col("line").alias("text"))
        error, dropped = F.lit(None).cast("string"), F.array().cast("array<string>")
    rows = rows.select("line_no", "text", dropped.alias("dropped"), F.coalesce(error, shape_error(F.col("text"))).alias("error"))
    good = rows.where("error is null").withColumn("final", nfc(F.col("text")))
    copy = F.row_number().over(Window.partitionBy("final").orderBy("line_no"))
    digest = F.substring(F.sha2(F.concat(F.lit(f"{source}\0{prompt_id}\0"), "final"), 256), 1, 12)
    base = F.concat(F.lit(prompt_id + "-"), digest)
    told = good.withColumn("copy", copy).withColumn(
        "id", F.when(F.col("copy") > 1, F.concat(base, F.lit("-d"), F.col("copy").cast("string"))).otherwise(base))
    records = told.select("id", F.col("final").alias("text"), F.lit(source).alias("source"), F.lit(prompt_id).alias("prompt_id"), "line_no")
    errors = rows.where("error is not null").select("line_no", F.lit(None).cast("string").alias("id"), F.lit("error").alias("severity"), F.col("error").alias("message"))
    noted = F.concat(
        F.transform("dropped", lambda k: F.concat(F.lit("dropped input key "), k)),
        F.when(F.col("final") != F.col("text"), F.array(F.concat(F.lit("text normalized to NFC: "), preview(F.col("text"))))).otherwise(F.array().cast("array<string>")))
    warnings = told.select("line_no", "id", F.lit("warning").alias("severity"), F.explode(noted).alias("message"))
    return records, errors.union(warnings)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines. Strict reading fails on the first bad line; the other drops bad lines."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines through Spark's commit protocol; an existing path is an error unless ``overwrite``."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)

"""Sources and sinks beside plain tables: permissive JSON lines, trees of references, cached arrays with digests, archives, contracts and reports."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import os
import tarfile
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.contracts import Rules
from inkwell.sources.ingest import nfc


def permissive_jsonl(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """Rows of the lines that are JSON objects once a trailing comma is cut off; other lines are left out."""
    text = F.regexp_replace(F.btrim(line), r",\s*\z", "")
    told = lines.withColumn("__row", F.from_json(F.when(text.startswith("{"), text), schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return told.where("__row is not null and __row._corrupt_record is null").select(*[c for c in lines.columns if c != line], "__row.*").drop("_corrupt_record")


def reference_texts(spark: SparkSession, root: str, exclude_dirs: Sequence[str] = (), exclude_ids: DataFrame | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """The distinct NFC texts below a folder with the first file that has each; rows of excluded folders and ids don't count."""
    rows = spark.read.schema("id string, text string").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    rows = rows.select("id", "text", F.col("_metadata.file_path").alias("path")).where("text is not null")
    for name in exclude_dirs:
        rows = rows.where(~F.contains("path", F.lit(f"/{name}/")))
    if exclude_ids is not None:
        rows = rows.join(exclude_ids.select("id").distinct(), "id", "left_anti")
    return rows.withColumn("text", nfc(F.col("text"))).groupBy("text").agg(F.min("path").alias("path"))


def write_cache(df: DataFrame, path: str, key: str) -> dict:
    """Store a table of arrays as Parquet, refusing a folder that is there, and return its manifest: rows and an order-free digest."""
    df.write.mode("errorifexists").parquet(path)
    return cache_manifest(df.sparkSession.read.parquet(path), key)


def cache_manifest(df: DataFrame, key: str) -> dict:
    got = df.agg(F.count(F.lit(1)).alias("rows"), F.expr("bit_xor(xxhash64(struct(*)))").alias("digest"), F.count_distinct(key).alias("keys")).first()
    return {"rows": got["rows"], "digest": got["digest"] or 0, "keys": got["keys"]}


def load_cache(spark: SparkSession, path: str, manifest: Mapping, key: str) -> DataFrame:
    """A stored table, checked against its manifest."""
    df = spark.read.parquet(path)
    found = cache_manifest(df, key)
    if dict(manifest) != found:
        raise ValueError(f"{path} is not what its manifest says: {found} instead of {dict(manifest)}")
    return df


def archive(members: Mapping[str, bytes], root: str, mtime: int = 0) -> bytes:
    """A tar.gz with the same bytes for the same members: sorted names, fixed times, owners and modes. For release files, which the driver holds."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name in sorted(members):
            info = tarfile.TarInfo(f"{root}/{name}")
            info.size, info.mtime, info.mode, info.uid, info.gid = len(members[name]), mtime, 0o644, 0, 0
            tar.addfile(info, io.BytesIO(members[name]))
    packed = io.BytesIO()
    with gzip.GzipFile(fileobj=packed, mode="wb", mtime=mtime) as out:
        out.write(raw.getvalue())
    return packed.getvalue()


def write_atomic(path: str, data: bytes, overwrite: bool = False) -> str:
    """Write a driver's file whole or not at all and return its digest; without ``overwrite`` an existing file is an error."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as out:
        out.write(data)
    try:
        if overwrite:
            os.replace(part, path)
        else:
            os.link(part, path)  # fails where the file is there
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return hashlib.sha256(data).hexdigest()


def load_rules(path: str) -> Rules:
    """A contract from JSON, or YAML where its library is there. Of a schema with spans, the target's rules count."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        told = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        told = yaml.safe_load(text)
    target = told.get("spans", {}).get("target", {})
    return Rules(
        types=tuple(told["types"]), statuses=tuple(told["statuses"]), required=tuple(told.get("required", ("id", "annotation_status", "type", "target"))),
        optional=tuple(told.get("optional", ("note",))), null_target_types=tuple(target.get("null_for_types", told.get("null_target_types", ()))),
        null_label_statuses=tuple(told.get("null_label_statuses", ())), note_statuses=tuple(told.get("note_required_statuses", ())),
        trainable=tuple(told.get("trainable_statuses", ("complete",))), provenances=tuple(told.get("provenances", ("human", "rule"))))


def has_spans(path: str) -> bool:
    """Whether a schema file declares several spans."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        told = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        told = yaml.safe_load(text)
    return isinstance(told, dict) and "spans" in told


def report(issues: DataFrame, most: int = 20) -> str:
    """Findings (line, severity, message) as text: counts by severity, then the first lines. The driver gets ``most`` rows and the counts."""
    counts = {r["severity"]: r["count"] for r in issues.groupBy("severity").count().collect()}
    head = ", ".join(f"{n} {s}s" for s, n in sorted(counts.items())) or "no findings"
    rows = issues.orderBy("line", "severity", "message").limit(most).collect()
    rest = sum(counts.values()) - len(rows)
    return "\n".join([head, *[f"  line {r['line']}: {r['severity']}: {r['message']}" for r in rows], *([f"  and {rest} more"] if rest else [])])


def markdown(df: DataFrame, most: int = 100) -> str:
    """A small result as a Markdown table of at most ``most`` rows in their order."""
    rows = df.limit(most).collect()
    shown = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *[[shown(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)

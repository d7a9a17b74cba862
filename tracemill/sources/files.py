"""Files in and out."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
EXAMPLE = (
    T.StructType()
    .add("id", T.StringType())
    .add("question", T.StringType())
    .add("answers", T.ArrayType(T.StringType()))
    .add("gold_doc_ids", T.ArrayType(T.StringType()))
    .add("corpus", T.ArrayType(PASSAGE))
    .add("corpus_doc_ids", T.ArrayType(T.StringType()))
)
INDEX_VERSION = 1


def check_root(path: str, roots: Sequence[str]) -> str:
    """The path, if it lies under one of the roots."""
    place = os.path.normpath(path)
    if not any(place == os.path.normpath(r) or place.startswith(os.path.normpath(r) + os.sep) for r in roots):
        raise ValueError(f"path is outside approved paths: {path}")
    return path


def read_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_records(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """(record): the JSON text of each row of a .jsonl file, or of each element of a JSON array; a single
    object counts as one row where ``single`` is set, and is an error otherwise."""
    if path.endswith(".jsonl"):
        return spark.read.text(path).where("trim(value) != ''").select(F.col("value").alias("record"))
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    if not single and whole.where("not startswith(value, '[')").limit(1).count():
        raise ValueError(f"a JSON array was expected: {path}")
    many = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return whole.select(F.explode(many).alias("record"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples with their defaults; rows without id, question or answers are an error."""
    rows = read_lines(spark, path, EXAMPLE)
    corpus = F.transform(F.coalesce("corpus", F.array().cast(T.ArrayType(PASSAGE))), lambda p: p.withField("title", F.coalesce(p["title"], F.lit(""))))
    ok = F.assert_true(F.col("id").isNotNull() & F.col("question").isNotNull() & F.col("answers").isNotNull(), "an example needs id, question and answers")
    out = rows.withColumn("_ok", ok).where("_ok is null").drop("_ok").withColumn("corpus", corpus)
    none = F.array().cast("array<string>")
    return out.withColumn("gold_doc_ids", F.coalesce("gold_doc_ids", none)).withColumn("corpus_doc_ids", F.coalesce("corpus_doc_ids", F.transform("corpus", lambda p: p["doc_id"]), none))


def first_wins(passages: DataFrame, pos: str = "pos") -> DataFrame:
    """The first passage of each document id."""
    return passages.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct("title", "text"), pos).alias("p"), F.min(pos).alias(pos)).select("doc_id", "p.title", "p.text", pos)


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists", roots: Sequence[str] | None = None) -> None:
    """JSON lines, one file a task; null fields are kept. Where ``roots`` are given, the path must lie under one."""
    if roots is not None:
        check_root(path, roots)
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_lines(rows: DataFrame, path: str, roots: Sequence[str] | None = None) -> None:
    write_lines(rows, path, "append", roots)


def write_report(report: DataFrame, path: str, roots: Sequence[str] | None = None) -> None:
    """A summary of one row as one JSON document; more rows are an error."""
    if len(report.take(2)) > 1:
        raise ValueError("a report has one row")
    write_lines(report.coalesce(1), path, "overwrite", roots)


def write_parquet(rows: DataFrame, path: str, roots: Sequence[str] | None = None) -> bool:
    """Parquet, unless there are no rows: then nothing is written and the answer is False."""
    if roots is not None:
        check_root(path, roots)
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def save_index(corpus: DataFrame, path: str, buckets: int = 16) -> None:
    """Passages, postings (clustered by term) and document frequencies under ``path``, with a version."""
    from tracemill.operators import lexical

    first = first_wins(corpus)
    posts = lexical.postings(first, ["doc_id", "pos"], lexical.passage_text(F.col("title"), F.col("text")))
    first.write.mode("overwrite").parquet(f"{path}/passages")
    posts.repartition(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    lexical.document_frequency(posts).write.mode("overwrite").parquet(f"{path}/terms")
    corpus.sparkSession.range(1).select(F.lit(INDEX_VERSION).alias("version")).write.mode("overwrite").parquet(f"{path}/version")


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    version = spark.read.parquet(f"{path}/version").first()["version"]
    if version != INDEX_VERSION:
        raise ValueError(f"unsupported index version: {version}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("passages", "postings", "terms")}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, flags, notes) of a quality manifest: lines, a list, {"rows": [...]}, or a mapping id -> entry. An
    entry is an object or a plain flag; a reason is added to its notes."""
    if path.endswith(".jsonl"):
        entries = spark.read.text(path).where("trim(value) != ''").select(F.col("value").alias("e"), F.lit(None).cast("string").alias("key"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
        rows = F.coalesce(F.when(F.col("v").startswith("["), F.col("v")), F.get_json_object("v", "$.rows"))
        fields = F.from_json("v", "map<string,string>")
        listed = F.transform(F.from_json(rows, "array<string>"), lambda x: F.struct(x.alias("e"), F.lit(None).cast("string").alias("key")))
        mapped = F.transform(F.map_entries(fields), lambda x: F.struct(x["value"].alias("e"), x["key"].alias("key")))
        entries = whole.select(F.explode(F.coalesce(listed, mapped)).alias("x")).select("x.e", "x.key")
    f = F.from_json("e", "map<string,string>")
    listing = lambda c: F.when(c.isNull(), F.array().cast("array<string>")).when(c.startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    clean = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    is_object = F.col("e").startswith("{")
    flags = F.when(is_object, listing(F.coalesce(f["flags"], f["quality_flags"]))).otherwise(F.array("e"))
    notes = F.when(is_object, listing(F.coalesce(f["notes"], f["quality_notes"], f["note"]))).otherwise(F.array().cast("array<string>"))
    reason = F.when(F.coalesce(F.trim(f["reason"]), F.lit("")) != "", F.array(F.trim(f["reason"]))).otherwise(F.array().cast("array<string>"))
    out = entries.select(F.trim(F.coalesce("key", f["id"], f["example_id"])).alias("id"), F.array_sort(F.array_distinct(clean(flags))).alias("flags"), F.concat(clean(notes), F.when(is_object, reason).otherwise(F.array().cast("array<string>"))).alias("notes"))
    return out.where("id is not null and id != ''")

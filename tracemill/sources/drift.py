"""Files whose fields drift: one consistent table, and a list of what changed from file to file.

The layouts of all files are read in parallel (partial counts by file, field and type), folded through a
lattice of types, and compared with the file of the same feed delivered just before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.session import cut_lineage

#: A field belongs to a layout if it isn't null in more than this share of the readable records of a file.
LAYOUT_SHARE = 0.25
TYPES = ("string", "number", "boolean", "array", "object")

# Fields of raw multi-hop rows with the same meaning (fixed values); others mean the same if they are equal
# without case, underscores and a plural s.
FAMILIES: dict[str, tuple[str, ...]] = {
    "record_id": ("_id", "id", "uid", "record_id", "row_id", "qid", "key"),
    "question": ("question", "query_text", "query", "question_text", "prompt"),
    "answer": ("answer", "answers", "final_answer", "gold_answer", "answer_text"),
    "context": ("context", "contexts", "paragraphs", "passages"),
    "supporting_facts": ("supporting_facts", "supports", "evidence", "evidences"),
    "note": ("annotator_note", "comment", "comments", "note", "remark"),
    "level": ("level", "difficulty"),
    "type": ("type", "hop_type", "question_type"),
    "tags": ("tags", "keywords", "labels"),
    "reviewed": ("reviewed", "is_checked", "checked", "verified"),
    "score": ("score", "quality_score", "rating"),
    "meta": ("meta", "provenance", "metadata", "origin"),
}


def plain_name(field: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(field, "[^A-Za-z0-9]", "")), "(?<=..)s$", "")


def family(field: Column, families: Mapping[str, Sequence[str]] = FAMILIES) -> Column:
    """The meaning of a field: the family that has its plain name, or its plain name (or what it is, if it has no letter
    or digit). Spellings that differ in case, signs or a plural s have one meaning."""
    named: dict[str, str] = {}
    for name, fields in families.items():
        for f in fields:
            named.setdefault(_plain(f), name)
    known = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    plain = plain_name(field)
    return F.coalesce(known[plain], F.when(plain != "", plain), field)


def _plain(field: str) -> str:
    """As ``plain_name``, for the names of the families."""
    return re.sub("(?<=..)s$", "", re.sub("[^A-Za-z0-9]", "", field).lower())


def json_fields(rows: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """(*keys, field, kind, value): the top-level fields of JSON objects; broken JSON has none. A field that
    is null has kind null. ``exact`` tells long from double. The values stay variants: nothing leaves the JVM."""
    spark = rows.sparkSession
    parsed = rows.select(*keys, F.try_parse_json(text).alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    wide = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    schema = F.schema_of_variant("value")
    kind = (
        F.when(F.col("value").isNull() | (schema == "VOID"), "null")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("number")
    )
    exact = F.when(schema == "BIGINT", "long").otherwise("double")
    return wide.select(*keys, F.col("key").alias("field"), kind.alias("kind"), F.when(kind == "number", exact).otherwise(kind).alias("exact"), "value")


def layouts(raw: DataFrame, share: float = LAYOUT_SHARE) -> DataFrame:
    """(feed, file_name, place, field, kind): the layout of every file, files numbered in order of delivery.

    The kind is the commonest of a field's non-null values (ties: string, number, boolean, array, object). A
    file without any readable record has an empty layout, but keeps its place: one row with a null field.
    """
    files = raw.groupBy("feed", "file_name").agg(F.min("delivered_at").alias("at"), F.count_if(F.coalesce(F.expr("schema_of_variant(try_parse_json(record)) like 'OBJECT%'"), F.lit(False))).alias("readable"))
    files = files.where("file_name is not null").withColumn("place", F.row_number().over(Window.partitionBy("feed").orderBy("at", "file_name")))
    counts = json_fields(raw, "record", ["feed", "file_name"]).where("kind != 'null'").groupBy("feed", "file_name", "field", "kind").agg(F.count("*").alias("n"))
    order = F.array_position(F.array(*map(F.lit, TYPES)), F.col("kind"))
    fields = counts.groupBy("feed", "file_name", "field").agg(F.sum("n").alias("n"), F.max_by("kind", F.struct(F.col("n"), -order)).alias("kind"))
    own = files.alias("f").join(fields.alias("x"), F.expr("f.feed <=> x.feed and f.file_name = x.file_name and x.n > f.readable * %r" % share), "left")
    return own.select("f.feed", "f.file_name", "f.place", "x.field", "x.kind")


def layout_changes(raw: DataFrame, families: Mapping[str, Sequence[str]] = FAMILIES, share: float = LAYOUT_SHARE) -> DataFrame:
    """(file_name, change, old_field, new_field): each file's layout against that of the file of the same feed
    delivered just before; the first one has no changes.

    ``added`` (no old field), ``removed`` (no new field), ``renamed`` (a field leaves and another one with the
    same meaning comes) and ``type_changed`` (both names; a field renamed at once gives both rows). Several
    fields of one meaning are paired in the order of their names. Lines delivered twice count twice; broken
    lines don't count; an empty table has no changes.
    """
    # layouts are small, a row for each field of a file, and are used five times below
    layout = cut_lineage(layouts(raw, share))
    files = layout.select("feed", "place", "file_name").distinct()
    now = layout.where("field is not null").select("feed", "place", "field", "kind")
    before = now.select("feed", (F.col("place") + 1).alias("place"), F.col("field").alias("old"), F.col("kind").alias("old_kind"))
    both = now.alias("n").join(before.alias("b"), F.expr("n.feed <=> b.feed and n.place = b.place and n.field = b.old"), "full_outer")
    both = both.select(
        F.coalesce("n.feed", "b.feed").alias("feed"), F.coalesce("n.place", "b.place").alias("place"), F.col("n.field").alias("new"), F.col("n.kind").alias("new_kind"), "b.old", "b.old_kind"
    ).where("place > 1")
    same = both.where("new is not null and old is not null and new_kind != old_kind").select("feed", "place", F.lit("type_changed").alias("change"), "old", "new")
    loose = both.where("new is null or old is null").withColumn("field", F.coalesce("new", "old")).withColumn("meaning", family(F.col("field"), families))
    side = F.col("new").isNull()
    nth = F.row_number().over(Window.partitionBy("feed", "place", "meaning", side).orderBy("field"))
    loose = loose.withColumn("nth", nth)
    # a leaving and a coming field of one meaning and rank are one renamed field
    met = loose.groupBy("feed", "place", "meaning", "nth").agg(F.max("old").alias("old"), F.max("new").alias("new"), F.max("old_kind").alias("old_kind"), F.max("new_kind").alias("new_kind"))
    kinds = F.when(F.col("old").isNull(), F.array(F.lit("added"))).when(F.col("new").isNull(), F.array(F.lit("removed"))).when(F.col("old_kind") != F.col("new_kind"), F.array(F.lit("renamed"), F.lit("type_changed"))).otherwise(F.array(F.lit("renamed")))
    moved = met.select("feed", "place", F.explode(kinds).alias("change"), "old", "new")
    changes = same.unionByName(moved).alias("c").join(files.alias("f"), F.expr("c.feed <=> f.feed and c.place = f.place"))
    return changes.select("f.file_name", "c.change", F.coalesce("c.old", F.lit("")).alias("old_field"), F.coalesce("c.new", F.lit("")).alias("new_field"))


#: The lattice of types: each with what is directly above it. Arrays, objects and whatever differs meet in text.
ABOVE = {"null": "boolean long timestamp array object".split(), "long": ["double"], "double": ["string"], "boolean": ["string"], "timestamp": ["string"], "array": ["string"], "object": ["string"], "string": []}


def promote(kinds: Sequence[str]) -> str:
    """The least type of the lattice above all of ``kinds``; without any value the type is string."""

    def above(kind: str) -> set[str]:
        return {kind}.union(*[above(k) for k in ABOVE[kind]])

    real = sorted(set(kinds) - {"null"})
    shared = set.intersection(*[above(k) for k in real]) if real else {"string"}
    least = next(k for k in sorted(shared) if shared <= above(k))
    return "string" if least in ("array", "object") else least  # kept as JSON text


def union_schema(raw: DataFrame, families: Mapping[str, Sequence[str]] = FAMILIES, max_fields: int = 500) -> list[tuple[str, str]]:
    """(meaning, type) of the consistent table: each meaning with the least type above all kinds its fields
    ever had, in any file. More than ``max_fields`` meanings, each of which is a column, are an error, not a cut."""
    kinds = json_fields(raw, "record", ["file_name"]).groupBy(family(F.col("field"), families).alias("meaning")).agg(F.collect_set("exact").alias("kinds"))
    rows = kinds.orderBy("meaning").limit(max_fields + 1).collect()
    if len(rows) > max_fields:
        raise ValueError(f"more than {max_fields} different fields")
    return [(r["meaning"], promote(r["kinds"])) for r in rows]


def consistent_table(raw: DataFrame, families: Mapping[str, Sequence[str]] = FAMILIES, keys: Sequence[str] = ("raw_id", "feed", "file_name", "line_no")) -> DataFrame:
    """All readable records in the union schema: the keys, then one column for each meaning, named f_<meaning>.

    A value is cast to the column's type; arrays and objects are JSON text. Where a record has several fields
    of one meaning, the first that isn't null counts, in the order of the family, else
    by name. However many spellings a meaning has, they are told in the row, none is listed. Broken JSON has no row.
    """
    schema = union_schema(raw, families)
    rank = F.create_map(*[F.lit(x) for fields in families.values() for i, f in enumerate(fields) for x in (f, i)])
    read = raw.withColumn("_v", F.try_parse_json("record")).where("_v is not null and schema_of_variant(_v) like 'OBJECT%'")
    fields = F.map_entries(F.try_variant_get("_v", F.lit("$"), "map<string,variant>"))
    told = F.transform(fields, lambda f: F.struct(family(f["key"], families).alias("meaning"), F.coalesce(rank[f["key"]], F.lit(1_000)).alias("rank"), f["key"].alias("field"), f["value"].alias("value")))
    by_rank = lambda x, y: F.when(x["rank"] != y["rank"], x["rank"] - y["rank"]).when(x["field"] < y["field"], -1).when(x["field"] > y["field"], 1).otherwise(0)
    read = read.withColumn("_told", F.array_sort(told, by_rank))

    def value(meaning: str, kind: str) -> Column:
        mine = F.transform(F.filter("_told", lambda t: t["meaning"] == meaning), lambda t: F.try_variant_get(t["value"], F.lit("$"), kind))
        return F.get(F.filter(mine, lambda x: x.isNotNull()), F.lit(0))

    taken: set[str] = set()
    columns = []
    for meaning, kind in schema:
        name = "f_" + meaning
        while name.lower() in taken:  # meanings without letters may fall together for a reader that ignores case
            name += "_"
        taken.add(name.lower())
        columns.append(value(meaning, kind).alias(name))
    return read.select(*keys, *columns)


# -- parquet files, by their footers ------------------------------------------------------------------------------


def _kind(arrow: str) -> str:
    """The type of the lattice of an Arrow type."""
    for starts, kind in (("bool", "boolean"), (("int", "uint"), "long"), (("float", "double", "half", "decimal"), "double"), (("timestamp", "date"), "timestamp"), (("list", "large_list", "fixed"), "array"), (("struct", "map"), "object")):
        if arrow.startswith(starts):
            return kind
    return "string"


def file_schemas(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_name, place, field, kind) of parquet files, one row a field, in the order of ``paths``. The footers are read in parallel,
    a task for some files; no data is."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for pdf in batches:
            rows = [(p, n, f.name, _kind(str(f.type))) for p, n in zip(pdf["file_name"], pdf["place"]) for f in pq.read_schema(p.removeprefix("file:"))]
            yield pd.DataFrame(rows, columns=["file_name", "place", "field", "kind"])

    files = spark.createDataFrame([(p, i + 1) for i, p in enumerate(paths)], "file_name string, place int")
    return files.repartition(max(1, min(len(paths), 1_000))).mapInPandas(read, "file_name string, place int, field string, kind string")


def read_drifting(spark: SparkSession, paths: Sequence[str], families: Mapping[str, Sequence[str]] = FAMILIES, max_fields: int = 500) -> DataFrame:
    """All rows of parquet files whose columns drift, with one column for each meaning. Files of equal columns
    are one scan; a missing column is null; of several columns of one meaning the first by name that isn't null counts."""
    heads = cut_lineage(file_schemas(spark, paths).withColumn("meaning", family(F.col("field"), families)))
    kinds = heads.groupBy("meaning").agg(F.collect_set("kind").alias("kinds")).orderBy("meaning").limit(max_fields + 1).collect()
    if len(kinds) > max_fields:
        raise ValueError(f"more than {max_fields} different fields")
    schema = [(r["meaning"], promote(r["kinds"])) for r in kinds]
    layout = F.sort_array(F.collect_list(F.struct("meaning", "field", "kind"))).alias("layout")
    groups = heads.groupBy("file_name").agg(layout).groupBy("layout").agg(F.collect_list("file_name").alias("files")).collect()
    out = None
    for g in groups:
        scan = spark.read.parquet(*g["files"])
        own = {m: [(x["field"], x["kind"]) for x in g["layout"] if x["meaning"] == m] for m, _ in schema}
        cast = lambda f, k, to: F.to_json(F.col(f"`{f}`")) if k in ("array", "object") else F.col(f"`{f}`").cast(to)
        part = scan.select(*[(F.coalesce(*[cast(f, k, to) for f, k in own[m]]) if own[m] else F.lit(None).cast(to)).alias("f_" + m) for m, to in schema])
        out = part if out is None else out.unionByName(part)
    return out

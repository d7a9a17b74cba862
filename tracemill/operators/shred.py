"""Deeply nested records as flat tables.

Adjacency-table shredding: every nested value becomes nodes (record, node, parent, label, ordinal, kind,
scalar). Nested columns are shredded by expressions derived from their schema, JSON text by a walker over
the parsed document, both into the same table. Object nodes are then joined with their scalar children and
pivoted into entity tables, which keep the link to their parent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.session import cut_lineage

#: A node: path from the record, path of the parent, field name (or null in arrays), place among its
#: siblings from 0, object / array / scalar / null, and the text of a scalar.
NODE = "struct<node:string,parent:string,label:string,ordinal:int,kind:string,scalar:string>"
ADJACENCY = "record string, node string, parent string, label string, ordinal int, kind string, scalar string"


def _node(path: Column, parent: Column, label: str | None, ordinal: Column, kind: Column, scalar: Column) -> Column:
    return F.struct(
        path.alias("node"), parent.alias("parent"), F.lit(label).cast("string").alias("label"), ordinal.cast("int").alias("ordinal"), kind.alias("kind"), scalar.cast("string").alias("scalar")
    )


def _nodes(value: Column, kind: T.DataType, path: Column, parent: Column, label: str | None, ordinal: Column) -> Column:
    """Array of all nodes of a typed value, depth first, as one expression without a shuffle or Python."""
    here = lambda name, scalar=F.lit(None): F.array(_node(path, parent, label, ordinal, F.when(value.isNull(), "null").otherwise(name), scalar))
    if isinstance(kind, T.StructType):
        parts = [here("object")]
        for i, f in enumerate(kind.fields):
            parts.append(_nodes(value[f.name], f.dataType, F.concat(path, F.lit("." + f.name)), path, f.name, F.lit(i)))
        return F.when(value.isNull(), here("object")).otherwise(F.concat(*parts))
    if isinstance(kind, T.ArrayType):
        inner = F.flatten(F.transform(value, lambda x, i: _nodes(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), path, None, i)))
        return F.when(value.isNull(), here("array")).otherwise(F.concat(here("array"), inner))
    return here("scalar", value)


def shred_columns(rows: DataFrame, record: str, columns: Sequence[str]) -> DataFrame:
    """Adjacency rows of nested columns (structs and arrays of any depth, in the order they are stored).

    Only the nested fields of ``columns`` are read. Null values have a node of kind null; a null ``record``
    has no rows; rows with the same record are shredded each.
    """
    parts = [_nodes(F.col(c), rows.schema[c].dataType, F.lit("$." + c), F.lit("$"), c, F.lit(i)) for i, c in enumerate(columns)]
    wide = rows.where(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("record"), F.explode(F.concat(*parts)).alias("n"))
    return wide.select("record", "n.*")


def walk(value: object, path: str, parent: str, label: str | None, ordinal: int, keep: Iterable[str] | None = None) -> Iterator[tuple]:
    """Nodes of a parsed JSON value, depth first, fields in the order they were written."""
    stack = [(value, path, parent, label, ordinal)]
    while stack:
        value, path, parent, label, ordinal = stack.pop()
        if isinstance(value, dict):
            yield path, parent, label, ordinal, "object", None
            stack.extend((v, f"{path}.{k}", path, k, i) for i, (k, v) in reversed(list(enumerate(value.items()))) if keep is None or path != "$" or k in keep)
        elif isinstance(value, list):
            yield path, parent, label, ordinal, "array", None
            stack.extend((v, f"{path}[{i}]", path, None, i) for i, v in reversed(list(enumerate(value))))
        elif value is None:
            yield path, parent, label, ordinal, "null", None
        else:
            yield path, parent, label, ordinal, "scalar", value if isinstance(value, str) else json.dumps(value)


def shred_json(rows: DataFrame, record: str, text: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Adjacency rows of JSON text. ``fields`` names the top-level fields that are wanted (default: all).

    Broken JSON, null text and a null ``record`` have no rows; a document nested deeper than the parser
    allows counts as broken; keys that recur in an object keep their last value.
    """
    keep = None if fields is None else frozenset(fields)

    def shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["record", "node", "parent", "label", "ordinal", "kind", "scalar"]
        for pdf in batches:
            out: list[tuple] = []
            for key, doc in zip(pdf["record"], pdf["doc"]):
                try:
                    value = json.loads(doc)
                except (ValueError, RecursionError, TypeError):
                    continue
                out += [(key, *n) for n in walk(value, "$", "", None, 0, keep)]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    wanted = rows.select(F.col(record).cast("string").alias("record"), F.col(text).alias("doc")).where("record is not null and doc is not null")
    return wanted.mapInPandas(shred, ADJACENCY)


def entities(adjacency: DataFrame, members: Column, scalars: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """Entity table: the nodes that ``members`` selects, pivoted by the object they belong to.

    One row for each record and owner (the expression ``owner`` of the adjacency table), with one column
    for each of ``scalars`` (an aggregate over the owner's nodes). Nodes of an owner are neighbours in their
    record, so the partial aggregate folds them before anything is shuffled.
    """
    return adjacency.where(members).groupBy(*group, "record", "owner").agg(*[c.alias(n) for n, c in scalars.items()])


def _at(field: str, inner: str) -> Column:
    """Pattern of the nodes at the path ``$.field``, where ``[]`` stands for any place in an array."""
    return F.lit("^" + re.escape(f"$.{field}").replace(r"\[\]", r"\[\d+\]") + inner + "$")


def parent_child(adjacency: DataFrame, field: str, columns: Sequence[str]) -> DataFrame:
    """(record, parent, ordinal, *columns): the entity table of the objects at ``$.field`` or in the array there.

    ``field`` may lie at any depth, as in ``metadata.passages`` or ``turns[].calls``; ``parent`` is the node that
    holds the object and ``ordinal`` its place there. Nulls in the place of objects have no row.
    """
    path = _at(field, r"(?:\[\d+\])?")
    # what can't lie under the path is left out before any pattern is matched
    head = "$." + field.partition("[]")[0]
    adjacency = adjacency.where(F.col("node").startswith(head))
    own = adjacency.withColumn("owner", F.when((F.col("kind") == "object") & F.regexp_like("node", path), F.col("node")).otherwise(F.col("parent")))
    itself = F.col("owner") == F.col("node")
    pick = {c: F.max(F.when(~itself & (F.col("label") == c), F.col("scalar"))) for c in columns}
    link = {"_parent": F.max(F.when(itself, F.col("parent"))), "_ordinal": F.max(F.when(itself, F.col("ordinal")))}
    made = entities(own, F.regexp_like("owner", path), link | pick).where("_parent is not null")
    return made.select("record", F.col("_parent").alias("parent"), F.col("_ordinal").alias("ordinal"), *columns)


def child_values(adjacency: DataFrame, field: str) -> DataFrame:
    """(record, parent, ordinal, value): the scalars and nulls in the array at ``$.field``, whose node is the parent."""
    inner = adjacency.where(F.col("label").isNull() & F.col("kind").isin("scalar", "null") & F.regexp_like("parent", _at(field, "")))
    return inner.select("record", "parent", "ordinal", F.col("scalar").alias("value")).distinct()


# -- references that resolve inside their own record ---------------------------------------------------------


def _named(adjacency: DataFrame, tab: str, refs: str, targets: str) -> tuple[DataFrame, DataFrame]:
    """(references, targets) of a table: the values of the list ``refs``, and the objects of the list ``targets``,
    each pivoted from its node and its scalar children, by their doc_id."""
    tab_name = F.lit(tab).alias("tab")
    listed = adjacency.where((F.col("parent") == f"$.{refs}") & (F.col("kind") == "scalar"))
    own = listed.select(tab_name, "record", F.col("ordinal").alias("ref_no"), F.col("scalar").alias("name"), F.lit(0).alias("sub_no"))
    objects = parent_child(adjacency, targets, ["doc_id"]).where("doc_id is not null")
    return own, objects.select(tab_name, "record", F.col("ordinal").alias("child_no"), F.col("doc_id").alias("name"), F.lit(1).alias("parts"))


def _owned(adjacency: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    """Nodes of context and supporting facts with the entry or fact they belong to, and what tells that a node is
    the entry or fact itself, lies right inside it, or is an element of its list of sentences."""
    node, inside = F.col("node"), F.col("parent") == F.col("owner")
    direct = F.col("parent").isin("$.context", "$.supporting_facts")
    listed_entry = r"^(\$\.(?:context|supporting_facts)\[\d+\])"
    # the owner is the entry or fact itself; titles of a mapping may hold dots and brackets, so what belongs to
    # its entries is told by the parent
    owner = F.when(direct, node).when(F.regexp_like("node", F.lit(listed_entry + r"[.\[]")), F.regexp_extract("node", listed_entry, 1)).otherwise(F.col("parent"))
    nested = adjacency.where(node.startswith("$.context") | node.startswith("$.supporting_facts")).where("node not in ('$.context', '$.supporting_facts')").withColumn("owner", owner)
    tail = F.substring(node, F.length("owner") + 1, F.lit(1_000_000))
    in_list = ~inside & ~direct & F.regexp_like(tail, F.lit(r"^(?:\.sentences|\.text|\[1\])\[\d+\]$"))
    return nested, direct, inside, in_list


def context_entries(adjacency: DataFrame) -> DataFrame:
    """(record, child_no, title, url_slug, sentences) of every context entry, in the forms that
    ``context_entities`` names; ``sentences`` are (sub_no, text). Where an entry has both, sentences go before text."""
    nested, direct, inside, in_list = _owned(adjacency)
    nested = nested.where(F.col("owner").startswith("$.context"))
    scalar, bare, mapped = F.col("kind") == "scalar", F.col("label").isNull(), F.col("owner").startswith("$.context.")
    leaf, place = F.col("kind").isin("scalar", "null"), F.col("ordinal")
    single = (direct & mapped & scalar) | (inside & ~mapped & scalar & (F.col("label").isin("sentences", "text") | (bare & (place == 1))))
    listed = leaf & (in_list | (inside & mapped & bare & ~direct))
    field = F.when((F.col("label") == "text") | F.col("parent").endswith("].text"), 1).otherwise(0)
    sentence = F.struct(F.when(single, 0).otherwise(place).alias("sub_no"), field.alias("field"), F.col("scalar").alias("text"))
    text_of = lambda c: F.max(F.when(c, F.col("scalar")))
    made = entities(
        nested,
        F.lit(True),
        {
            "child_no": F.max(F.when(direct, place)),
            "name": F.max(F.when(direct, F.col("label"))),
            "title": text_of(inside & ~mapped & scalar & ((F.col("label") == "title") | (bare & (place == 0)))),
            "url_slug": text_of(inside & ~mapped & scalar & (F.col("label") == "url_slug")),
            "found": F.collect_set(F.when(single | listed, sentence)),
        },
    ).where("child_no is not null")
    first = F.array_min(F.transform("found", lambda x: x["field"]))
    kept = F.transform(F.filter("found", lambda x: x["field"] == F.col("_first")), lambda x: F.struct(x["sub_no"].alias("sub_no"), x["text"].alias("text")))
    return made.withColumn("_first", first).select("record", "child_no", F.coalesce("name", "title").alias("title"), "url_slug", F.array_sort(kept).alias("sentences"))


def context_entities(adjacency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(supporting facts, context entries) of raw multi-hop rows, from their adjacency table.

    A context entry is a pair [title, sentences], an object with title and sentences or text, or a field of
    a mapping title -> sentences; sentences may be plain text, which is one sentence. A supporting fact is a
    pair [title, index] or an object with title and sent_id or sent_idx; an index may be missing (0) or text.
    """
    nested, direct, inside, in_list = _owned(adjacency)
    scalar, bare = F.col("kind") == "scalar", F.col("label").isNull()
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    text_of = lambda c: F.max(F.when(c, F.col("scalar")))
    made = entities(
        nested,
        F.lit(True),
        {
            "ordinal": F.max(F.when(direct, F.col("ordinal"))),
            "field": F.max(F.when(direct, F.col("label"))),
            "kind": F.max(F.when(direct, F.col("kind"))),
            "title": text_of(inside & scalar & ((F.col("label") == "title") | (bare & (F.col("ordinal") == 0)))),
            "in_list": one(in_list),
            "plain": one(inside & scalar & (F.col("label").isin("sentences", "text") | (bare & (F.col("ordinal") == 1)))),
            "elements": one(inside & scalar & bare),
            "first": text_of(inside & (F.col("label") == "sent_id")),
            "second": text_of(inside & (F.col("label") == "sent_idx")),
            "third": text_of(inside & bare & (F.col("ordinal") == 1)),
        },
        ["tab"],
    )
    made = cut_lineage(made)  # a row an entry or fact, used for both sides of the join: the text is walked once
    is_fact = F.col("owner").startswith("$.supporting_facts[")
    index = F.coalesce("first", "second", "third")
    number = F.when(index.isNull(), 0).otherwise(F.expr("try_cast(trim(coalesce(first, second, third)) as int)"))
    facts = made.where(is_fact).select("tab", "record", F.col("ordinal").alias("ref_no"), F.col("title").alias("name"), number.alias("sub_no"))
    listed = F.greatest("in_list", "plain")
    mapped = F.when(F.col("kind") == "scalar", 1).otherwise(F.col("elements"))
    parts = F.when(F.col("field").isNull(), listed).otherwise(mapped).cast("int")
    contexts = made.where(~is_fact & F.col("ordinal").isNotNull()).select("tab", "record", F.col("ordinal").alias("child_no"), F.coalesce("field", "title").alias("name"), parts.alias("parts"))
    return facts, contexts.where("name is not null")


def resolved_references(qa: DataFrame, rollouts: DataFrame, raw: DataFrame) -> DataFrame:
    """(tab, parent_id, ref_no, child_no, sub_no): every reference that resolves inside its own record.

    Positions count from 0. A reference that fits several targets has a row for each; null names refer to
    nothing; repeated deliveries of a record give its rows once; broken JSON has none.
    """
    # of the passages only the field that is referred to is read and shredded
    bare = lambda passages: F.transform(passages, lambda p: F.struct(p["doc_id"].alias("doc_id")))
    one = shred_columns(qa.select("id", "gold_doc_ids", bare(F.col("corpus")).alias("corpus")), "id", ["gold_doc_ids", "corpus"])
    meta = F.struct(F.col("metadata.gold_doc_ids").alias("gold_doc_ids"), bare(F.col("metadata.candidate_passages")).alias("candidate_passages"))
    two = shred_columns(rollouts.select("rollout_id", meta.alias("metadata")), "rollout_id", ["metadata"])
    refs, targets = _named(one, "qa_examples", "gold_doc_ids", "corpus")
    more = _named(two, "rollouts_for_grpo", "metadata.gold_doc_ids", "metadata.candidate_passages")
    refs, targets = refs.unionByName(more[0]), targets.unionByName(more[1])
    three = shred_json(raw, "raw_id", "record", ["context", "supporting_facts"]).withColumn("tab", F.lit("raw_records"))
    facts, contexts = context_entities(three)
    refs, targets = refs.unionByName(facts), targets.unionByName(contexts)
    found = refs.where("name is not null and sub_no >= 0").join(targets, ["tab", "record", "name"]).where("sub_no < parts")
    return found.select("tab", F.col("record").alias("parent_id"), "ref_no", "child_no", F.col("sub_no").cast("int").alias("sub_no")).distinct()

"""Duplicates hidden by formatting: records equal but for white space, case, punctuation or field order.

Every record gets canonical bytes. The task that reads it folds copies it still holds together, so that few
representatives of a text leave a task. The representatives are split by recursive radix partitioning
(buckets of too many bytes are split by further bytes until each fits), and every bucket is counted in a trie
with terminal counters. No limit depends on the size of the table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import cut_lineage

#: Canonical bytes that the first level of the partitioning looks at; each further level looks at twice as many.
STEP = 24
#: Canonical bytes of a bucket, beyond which it is split (a trie needs some fifteen times as much), and bytes of texts
#: that a task holds to fold copies.
BUCKET_BYTES, FOLD_BYTES = 8_000_000, 64_000_000
#: Bytes between two nodes of a trie.
STRIDE = 16


def canonical(value: object) -> str:
    """Letters (with their accents) and digits of a value, in folded case; null is empty."""
    if not isinstance(value, str):
        return ""
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold())
    return folded if folded.isalnum() else "".join(c for c in folded if c.isalnum() or unicodedata.category(c)[0] == "M")


def canonical_bytes(title: object, text: object, record: object) -> bytes | None:
    """Canonical title and text, told apart by a zero byte; None without any letter or digit in the text.
    The fields of a JSON record count where title and text are null; unreadable JSON has neither."""
    if title is None and text is None and isinstance(record, str):
        try:
            fields = json.loads(record)
        except ValueError:
            return None
        if not isinstance(fields, dict):
            return None
        title, text = fields.get("title"), fields.get("text")
    body = canonical(text)
    return (canonical(title) + "\0" + body).encode("utf-8", "surrogatepass") if body else None


class Trie:
    """Counts of byte strings: inner nodes by chunks of STRIDE bytes, a terminal counter [smallest id, copies]
    where a string ends. Chunks shorter than the stride only end strings, so no string hides another."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, smallest: int, copies: int) -> list[int]:
        node = self.root
        for i in range(0, len(key) - STRIDE, STRIDE):
            node = node.setdefault(key[i : i + STRIDE], {})
        end = b"$" + key[(max(0, len(key) - 1) // STRIDE) * STRIDE :]
        terminal = node.get(end)
        if terminal is None:
            terminal = node[end] = [smallest, copies]
        else:
            terminal[0] = min(terminal[0], smallest)
            terminal[1] += copies
        return terminal


def _null(x: object) -> object:
    return x if isinstance(x, str) else None


def _fold_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, rep, canon, copies, low): each record with the representative of its text in this task; canonical
    bytes, copies and the smallest id only on the representatives, which come after the task's records."""
    columns = ["id", "rep", "canon", "copies", "low"]
    reps: dict[bytes, list[int]] = {}
    context = TaskContext.get()
    made, held = (context.partitionId() if context else 0) << 36, 0  # numbers of representatives differ between tasks

    def folded() -> Iterator[pd.DataFrame]:
        rows = [(None, r, key, n, low) for key, (r, n, low) in reps.items()]
        for k in range(0, len(rows), 20_000):
            yield pd.DataFrame(rows[k : k + 20_000], columns=columns).astype({"id": "Int64"})

    for pdf in batches:
        members = []
        for i, title, text, record in zip(pdf["id"], pdf["title"], pdf["text"], pdf["record"]):
            if (key := canonical_bytes(_null(title), _null(text), _null(record))) is None:
                continue
            if (mine := reps.get(key)) is None:
                mine = reps[key] = [made, 0, i]
                made += 1
                held += len(key) + 200
            mine[1] += 1
            mine[2] = min(mine[2], i)
            members.append((i, mine[0], None, 0, 0))
        yield pd.DataFrame(members, columns=columns)
        if held > FOLD_BYTES:
            yield from folded()
            reps, held = {}, 0
    yield from folded()


def radix_buckets(reps: DataFrame, limit: int = BUCKET_BYTES, step: int = STEP) -> DataFrame:
    """``reps`` with the column bucket: the shortest start of canon, of ``step`` bytes or two, four, eight times as many,
    of which all rows hold no more than ``limit`` bytes, or all bytes where they end before. Oversized starts
    stay a table; each level reads only what was oversized before."""
    done, live, width = None, reps, step
    while True:
        start = F.substring("canon", 1, width)
        live = live.withColumn("bucket", start)
        sizes = live.groupBy("bucket").agg(F.sum(F.length("canon")).alias("bytes"))
        big = cut_lineage(sizes.where((F.col("bytes") > limit) & (F.length("bucket") == width)).select("bucket"))
        if big.isEmpty():
            return live if done is None else done.unionByName(live)
        fits = live.join(big, "bucket", "left_anti").select(*reps.columns, "bucket")
        done = fits if done is None else done.unionByName(fits)
        live = cut_lineage(live.join(big, "bucket", "left_semi").select(*reps.columns))
        width *= 2


def _count_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One trie a bucket; a bucket's rows are neighbours, so that one trie lives at a time."""
    name, trie, held, done = None, Trie(), [], []
    columns = ["rep", "keep", "total"]
    for pdf in batches:
        for bucket, key, rep, copies, low in zip(pdf["bucket"], pdf["canon"], pdf["rep"], pdf["copies"], pdf["low"]):
            if bucket != name:
                done += [(r, end[0], end[1]) for r, end in held]
                name, trie, held = bucket, Trie(), []
                if len(done) >= 20_000:
                    yield pd.DataFrame(done, columns=columns)
                    done = []
            held.append((rep, trie.add(bytes(key), low, copies)))
    yield pd.DataFrame(done + [(r, end[0], end[1]) for r, end in held], columns=columns)


def format_copies(rows: DataFrame, id_column: str = "passage_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, keep, copies): every record with the smallest id of its set and the size of the set.

    Records are equal if title and text (or these fields inside the JSON of ``record``, where both are null)
    have the same letters, with accents, and digits in folded case. A null title equals an empty one; records
    without a letter or digit in the text, or with unreadable JSON, have no row. Tables without the column
    record have no JSON; other columns are ignored; repeated ids count as copies; an empty table gives none.
    """
    record = F.col("record") if "record" in rows.columns else F.lit(None).cast("string")
    wanted = rows.select(F.col(id_column).cast("long").alias("id"), F.col("title").cast("string").alias("title"), F.col("text").cast("string").alias("text"), record.alias("record"))
    folded = cut_lineage(wanted.where("id is not null").mapInPandas(_fold_task, "id long, rep long, canon binary, copies long, low long"))
    reps = folded.where("canon is not null").select("canon", "rep", "copies", "low")
    buckets = radix_buckets(reps, bucket_bytes).repartition(F.col("bucket")).sortWithinPartitions("bucket")
    kept = buckets.mapInPandas(_count_task, "rep long, keep long, total long")
    # a representative stands for the copies of one task at most, so this join has no hot key
    members = folded.where("canon is null").select("id", "rep")
    return members.join(kept, "rep").select("id", "keep", F.col("total").alias("copies"))


def copies_found(rows: DataFrame, id_column: str = "passage_id") -> DataFrame:
    """(keep_id, copy_id): the smallest id of each set of at least two records with each other id."""
    found = format_copies(rows, id_column).where("copies > 1 and id != keep")
    return found.select(F.col("keep").alias("keep_id"), F.col("id").alias("copy_id"))


def kept_records(rows: DataFrame, id_column: str = "passage_id") -> DataFrame:
    """(keep_id, copies): one row for each set of records, with its number of copies."""
    return format_copies(rows, id_column).where("id = keep").select(F.col("keep").alias("keep_id"), "copies").distinct()

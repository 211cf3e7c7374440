"""Writers of traces and reports. Spark's tasks write; one folder a group key."""

from __future__ import annotations

import shutil
import sqlite3
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.plans.lineage import lookup
from spanweave.sources.shards import KEY_TYPE


def write_events(events: DataFrame, path: str) -> None:
    """Events as Parquet, in folders by machine, process and phase, so that readers skip what they don't ask for."""
    events.write.partitionBy("machine", "process", "phase").parquet(path)


def venn_documents(inclusive: DataFrame, by: list[str], overlap_type: str, size: str = "time_us") -> DataFrame:
    """A JSON document for each group of ``by``: metadata, and numbered sets with sizes; single sets have a label.

    ``inclusive``: ``by, region, size``; a group has at most as many rows as its categories have sets. Sizes may be exclusive, too: a
    label that is in sets of several only has a single set of size 0 that is marked ``implied``, so that readers find its name.
    """
    grouped = inclusive.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.size("region").alias("n"), "region", F.col(size).cast("double").alias("size")))).alias("rows"))
    labels = F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["region"]))))
    grouped = grouped.withColumn("labels", labels)
    sets = F.transform(
        "rows",
        lambda r: F.struct(
            F.transform(r["region"], lambda x: F.array_position(F.col("labels"), x) - 1).alias("sets"), r["size"].alias("size"), F.when(r["n"] == 1, F.get(r["region"], F.lit(0))).alias("label"), F.lit(None).cast("boolean").alias("implied")
        ),
    )
    named = F.flatten(F.transform(F.filter("rows", lambda r: r["n"] == 1), lambda r: r["region"]))
    implied = F.transform(F.array_except("labels", named), lambda x: F.struct(F.array(F.array_position(F.col("labels"), x) - 1).alias("sets"), F.lit(0.0).alias("size"), x.alias("label"), F.lit(True).alias("implied")))
    metadata = F.struct(*by, F.lit(overlap_type).alias("overlap_type"), F.lit(1).alias("version"))
    return grouped.select(*by, F.to_json(F.struct(metadata.alias("metadata"), F.concat(implied, sets).alias("venn"))).alias("value"))


def write_venn(documents: DataFrame, by: list[str], path: str) -> None:
    documents.write.partitionBy(*by).text(path)


def chrome_events(lanes: DataFrame) -> DataFrame:
    """One JSON object a line for trace viewers: ``process`` and lane as pid and tid."""
    event = F.struct(F.col("event_name").alias("name"), F.lit("X").alias("ph"), F.col("process").alias("pid"), F.col("lane").alias("tid"), F.col("start_us").alias("ts"), (F.col("end_us") - F.col("start_us")).alias("dur"), F.col("category").alias("cat"))
    return lanes.select(F.to_json(event).alias("value"))


def write_csv(report: DataFrame, path: str) -> None:
    report.write.option("header", True).csv(path)


#: Events of a shard, about: denser stretches of time have several.
SHARD_EVENTS = 20_000


def with_part(events: DataFrame, by: list[str], stretch: Column) -> DataFrame:
    """Adds ``part``: the stretch of time and, where a group has many events in it, which of its shares an event is in.

    Shares are dealt by a hash of the whole event, so that reruns agree; a group's events in a stretch are counted first.
    """
    given = events.withColumn("__stretch", stretch)
    counts = given.groupBy(*by, "__stretch").agg(F.ceil(F.count("*") / SHARD_EVENTS).alias("__shares"))
    share = F.pmod(F.xxhash64(*events.columns), F.col("__shares"))
    return lookup(given, counts, [*by, "__stretch"], "inner").withColumn("part", F.struct(F.col("__stretch").alias("stretch"), share.alias("share"))).drop("__stretch", "__shares")


def shard_rows(events: DataFrame, width: int) -> DataFrame:
    """A trace as nested rows of the kind ``category_events``: one for each process and stretch of ``width`` µs, several where that has many events, so that none grows with the trace."""
    group = [F.col("machine").alias("machine_name"), F.col("process").alias("process_name"), "phase", "part"]
    event = F.struct(F.lit(0).cast("long").alias("thread_id"), F.col("start_us").alias("start_time_us"), F.col("duration_us"), F.col("event_name").alias("name"))
    dealt = with_part(events, ["machine", "process", "phase"], F.floor(F.col("start_us") / width))
    lists = dealt.groupBy(*group, "category").agg(F.collect_list(event).alias("events"))
    return lists.groupBy("machine_name", "process_name", "phase", "part").agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("events")))).alias("category_events")).drop("part")


def overlap_document(regions: DataFrame, size: str = "time_us") -> DataFrame:
    """One JSON document of all regions (``procs, ops, non_ops`` and a size), a dictionary whose keys name their type.

    A report's regions are few: they are sets of categories. Read back by ``shards.overlap_rows``.
    """
    key = F.to_json(F.struct(F.lit(KEY_TYPE).alias("typename"), "procs", "ops", "non_ops"))
    pairs = regions.agg(F.array_sort(F.collect_list(F.concat(F.lit("["), key, F.lit(", "), F.col(size).cast("string"), F.lit("]")))).alias("p"))
    return pairs.select(F.concat(F.lit('{"typename": "dict", "key_value_pairs": ['), F.array_join("p", ", "), F.lit("]}")).alias("value"))


def write_databases(df: DataFrame, path: str, table: str) -> DataFrame:
    """Writes ``df`` as database files (SQLite) with one table each, a file a partition, into the folder ``path`` (a URI); returns ``file, n``.

    The work is done when the result is read. A file is made on the task's disk and then put in place; one that a lost executor left is
    put there again under the same name.
    """
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    columns = ", ".join(f'"{c}" {kinds.get(k, "TEXT")}' for c, k in df.dtypes)
    marks = ", ".join("?" for _ in df.columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n = f"part-{TaskContext.get().partitionId():06}.db", 0
        with tempfile.TemporaryDirectory() as own:
            base = sqlite3.connect(f"{own}/{name}")
            base.execute(f'CREATE TABLE "{table}" ({columns})')
            for batch in batches:
                n += batch.num_rows
                base.executemany(f'INSERT INTO "{table}" VALUES ({marks})', zip(*[c.to_pylist() for c in batch.columns], strict=True))
            base.commit()
            base.close()
            if n:
                store, folder = fs.FileSystem.from_uri(path)
                store.create_dir(folder, recursive=True)
                with open(f"{own}/{name}", "rb") as source, store.open_output_stream(f"{folder}/{name}") as copy:
                    shutil.copyfileobj(source, copy, 4 << 20)
        yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]}, schema=pa.schema([("file", pa.string()), ("n", pa.int64())]))

    return df.mapInArrow(write, "file string, n long")

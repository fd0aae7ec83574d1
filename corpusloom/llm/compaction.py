"""Executed compaction: files written by day, then packed into larger ones by first fit, in lockstep over many days.

Rows go to pieces by day, lot and piece (see ``pieces``), each piece to one file. Files are numbered without gaps and written by a shuffle straight to the partition
of their number, so a file is what one task writes, streaming; no piece has more than about R/343 of a table's R rows, and a table of D days has at most
4 * (D + 150) files, however many rows. Small files are packed by first fit, largest first, with numpy: a block of days is a matrix of what is left of each
group, and for each rank of size one boolean argmax places the file of every day of the block at once. A group of several files is
written as one: the rows of its files in joining order, each file's in the order they have there. Then the new files move in and the
old ones go; files that join no other are not touched.

What goes to the driver or into a broadcast is counts, and, one at a time, the paths of the files that move or go; a table of days or files is broadcast only where its
counted rows fit BROADCAST_BYTES. A task that is lost writes its file again under a new name, and only committed files count.

Defined cases: rows without a time are a day of their own (null), before all others; a null id counts as empty (crc32 of no bytes, an empty place in the list of
ids) and sorts first; values that are null, not finite or beyond 2^56 count 0 cents; equal rows stay; rows that tie in time and id are ordered by the other
plain columns; columns of any names stay as they are; an empty table writes nothing and gives no rows. Each call writes into a new folder and leaves it there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, numbered, scratch, shared_dir, staged, table, unstage

LOTS, SMALL, FULL = 150, 600, 400  # a lot, a file that is packed and a full group have about 1/LOTS, under 1/SMALL and at most 1/FULL of all rows
DAYS_TOGETHER = 32  # days in a block
ROW_BYTES = 64
KEYS = ["_day", "_lot", "_piece"]


def share(rows: int, parts: int) -> int:
    return 1 + rows // parts


def pieces(df: DataFrame, rows: int, time: str, key: str) -> DataFrame:
    """df with _day, _lot and _piece. A day's rows make one lot for each 1/LOTS of the table that they have, so that a large day is many files."""
    day = F.unix_date(F.to_date(F.col(time))).cast("long")
    days = staged(df.groupBy(day.alias("_d")).agg(F.count("*").alias("_r")), "days")
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    per_day = broadcast_if_small(days, days.count(), ROW_BYTES)
    rest = df.withColumn("_day", day).join(per_day, F.col("_day").eqNullSafe(F.col("_d")))
    lot = F.shiftright(h, 4) % (1 + F.floor(F.col("_r") / share(rows, LOTS)))
    return rest.withColumns({"_lot": lot.cast("long"), "_piece": F.least(h % 4, F.shiftright(h, 2) % 4).cast("long")}).drop("_d", "_r")


def _inner(df: DataFrame, *more: Column) -> DataFrame:
    """df with its columns named by place, so that no name of a caller's clashes, and more columns."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], *more)


def _outer(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _place(df: DataFrame, name: str) -> str:
    return f"c{df.columns.index(name)}"


def _plain(df: DataFrame) -> list[str]:
    """Columns that can be ordered by."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "struct", "array", "variant")]


def _same_keys(a: str, b: str) -> Column:
    return F.col(f"{a}._day").eqNullSafe(F.col(f"{b}._day")) & (F.col(f"{a}._lot") == F.col(f"{b}._lot")) & (F.col(f"{a}._piece") == F.col(f"{b}._piece"))


def write_files(cut: DataFrame, names: list[str], folder: str, time: str, key: str) -> DataFrame:
    """Write the rows of cut (columns by place, and KEYS), one file for each key, in the order of time and key; _file, KEYS, _rows of the files."""
    files = staged(numbered(cut.groupBy(*KEYS).agg(F.count("*").alias("_rows")), "_file", *KEYS), "files")
    n = files.count()
    if n:
        by = broadcast_if_small(files.drop("_rows"), n, ROW_BYTES)
        rows = cut.alias("a").join(by.alias("b"), _same_keys("a", "b")).select("a.*", "b._file").drop(*KEYS)
        order = [time, key, *[c for c in _plain(rows) if c not in (time, key, "_file")]]
        _outer(rows.repartitionById(n, F.col("_file").cast("int")).sortWithinPartitions(*order), names).write.parquet(folder)
    return files


def first_fit(sizes: np.ndarray, most: int) -> np.ndarray:
    """For each day (row) and rank (column) of a matrix of falling sizes, 0 where a day has no more, the group its file joins: the earliest with room, else the next new one. -1 where there is no file.

    left[day, group] is what a group can still take; groups not opened yet can take all, and come after those opened.
    """
    days, ranks = sizes.shape
    left, at, rows = np.full((days, max(ranks, 1)), most), np.full((days, ranks), -1), np.arange(days)
    for rank in range(ranks):
        size = sizes[:, rank]
        group = (left >= size[:, None]).argmax(axis=1)
        there = size > 0
        left[rows[there], group[there]] -= size[there]
        at[there, rank] = group[there]
    return at


def _pack_block(block: pd.DataFrame, most: int) -> pd.DataFrame:
    """_group and _nth (place in it) of the files of a block of days."""
    block = block.sort_values(["_day", "_rows", "_lot", "_piece"], ascending=[True, False, True, True], na_position="first").reset_index(drop=True)
    codes = pd.factorize(block["_day"], use_na_sentinel=False)[0]
    rank = block.groupby(codes).cumcount().to_numpy()
    sizes = np.zeros((codes.max() + 1, rank.max() + 1), dtype=np.int64)
    sizes[codes, rank] = block["_rows"]
    group = first_fit(sizes, most)[codes, rank]
    block["_group"] = group
    block["_nth"] = block.groupby([codes, group]).cumcount()
    return block[["_file", "_group", "_nth"]].astype("int64")


def pack(files: DataFrame, small: int, most: int) -> DataFrame:
    """_file, _group, _nth of the files (KEYS, _file, _rows) of fewer than small rows; a group holds at most `most` rows of one day."""
    few = files.filter(F.col("_rows") < small).withColumn("_block", F.floor(F.col("_day") / DAYS_TOGETHER))
    return few.groupBy("_block").applyInPandas(lambda block: _pack_block(block, most), "_file long, _group long, _nth long")


def groups_of(files: DataFrame, packed: DataFrame) -> DataFrame:
    """_target (number), _file, _nth, KEYS (of the first file), _sources of each group of several files."""
    joined = files.join(packed, "_file")
    of_day = Window.partitionBy("_day", "_group")
    several = joined.withColumn("_n", F.count("*").over(of_day)).filter("_n > 1")
    name = F.concat_ws("-", "_lot", "_piece")
    listed = F.array_sort(F.collect_list(F.struct("_nth", "_file", name.alias("s"), "_lot", "_piece")))
    each = several.groupBy("_day", "_group").agg(listed.alias("_all"))
    wanted = each.select("_day", F.col("_all")[0]["_lot"].alias("_lot"), F.col("_all")[0]["_piece"].alias("_piece"), F.array_join(F.col("_all.s"), ",").alias("_sources"), F.transform("_all", lambda x: F.struct(x["_file"].alias("_file"), x["_nth"].alias("_nth"))).alias("_members"))
    return numbered(wanted, "_target", *KEYS).select("_target", *KEYS, "_sources", F.explode("_members").alias("_m")).select("_target", *KEYS, "_sources", "_m.*")


def _number(name: Column) -> Column:
    """The task that wrote a file is in its name, and is the file's number."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("long")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _paths(spark: SparkSession, folder: str) -> Iterator:
    fs, at = _fs(spark, folder)
    if fs.exists(at):
        found = fs.listFiles(at, False)
        while found.hasNext():
            yield found.next().getPath()


def merge_files(spark: SparkSession, schema, folder: str, groups: DataFrame) -> str:
    """Write each group of files of the folder as one file beside the folder; where they are."""
    beside, n = f"{folder}.merged", groups.agg(F.max("_target")).first()[0]
    members = broadcast_if_small(groups.select("_file", "_target", "_nth"), groups.count(), ROW_BYTES)
    rows = spark.read.schema(schema).parquet(folder)
    of = rows.metadataColumn("_metadata")
    loose = _inner(rows, _number(of["file_name"]).alias("_file"), of["row_index"].alias("_row")).join(members, "_file")
    _outer(loose.repartitionById(n + 1, F.col("_target").cast("int")).sortWithinPartitions("_nth", "_row"), rows.columns).write.parquet(beside)
    return beside


def swap(spark: SparkSession, folder: str, beside: str, groups: DataFrame) -> None:
    """Move the merged files in and delete those they replace; one path at a time passes through the driver."""
    old = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.parquet").load(folder).select("path").withColumn("_file", _number(F.element_at(F.split("path", "/"), -1)))
    paths = staged(old.join(broadcast_if_small(groups.select("_file"), groups.count(), ROW_BYTES), "_file", "left_semi").select("path"), "replaced")
    fs, _ = _fs(spark, folder)
    for p in _paths(spark, beside):
        if p.getName().startswith("part-"):
            fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/merged-{p.getName()}"))
    for r in paths.toLocalIterator():
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(r["path"]), False)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(beside), True)
    unstage(paths)


def digests(rows: DataFrame) -> DataFrame:
    """name, ids_sha256 of rows (name, row, id): the ids of each file in order, joined by commas. A file's ids pass through one task as a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for batch in batches:
            done = []
            for key, ids in batch.groupby("name", sort=False)["id"]:
                text = ",".join(ids)
                if key == name:
                    state.update(b"," + text.encode())
                    continue
                if name is not None:
                    done.append((name, state.hexdigest()))
                name, state = key, hashlib.sha256(text.encode())
            if done:
                yield pd.DataFrame(done, columns=["name", "ids_sha256"])
        if name is not None:
            yield pd.DataFrame([(name, state.hexdigest())], columns=["name", "ids_sha256"])

    return rows.repartition("name").sortWithinPartitions("name", "row").select("name", "id").mapInPandas(run, "name string, ids_sha256 string")


def compact(spark: SparkSession, df: DataFrame, folder: str, time: str, key: str) -> DataFrame:
    """Write df into the folder by pieces and compact it there; KEYS, _sources, rewritten and name of each file that is there then."""
    with scratch() as keep:
        n_rows = df.count()
        time, key = _place(df, time), _place(df, key)
        files = keep(write_files(pieces(_inner(df), n_rows, time, key), df.columns, folder, time, key))
        packed = staged(pack(files, share(n_rows, SMALL), share(n_rows, FULL)), "packed")
        groups = staged(groups_of(files, packed), "groups")
        if not groups.isEmpty():
            swap(spark, folder, merge_files(spark, df.schema, folder, groups), groups)
        whole = files.join(groups.select("_file"), "_file", "left_anti").select(F.col("_file").alias("_target"), *KEYS, F.concat_ws("-", "_lot", "_piece").alias("_sources"), F.lit(False).alias("rewritten"))
        merged = groups.filter("_nth = 0").drop("_nth", "_file").withColumn("rewritten", F.lit(True))
        return keep(staged(whole.unionByName(merged), "compacted"))


def described(spark: SparkSession, schema, folder: str, files: DataFrame, key: str, value: str) -> DataFrame:
    """What is in each file of a compacted folder, read from the files."""
    rows = spark.read.schema(schema).parquet(folder)
    of, value = rows.metadataColumn("_metadata"), F.col(f"`{value}`").cast("double")
    cents = F.when(F.abs(value) < 2.0**56, F.floor(100 * value + 0.5).cast("long")).otherwise(0)
    seen = rows.select(of["file_name"].alias("name"), of["row_index"].alias("row"), F.col(f"`{key}`").alias("_id"), cents.alias("_cents"))
    sums = seen.groupBy("name").agg(F.count("*").alias("n_rows"), F.min("_id").alias("min_click_id"), F.max("_id").alias("max_click_id"), F.sum("_cents").alias("cents"))
    hashes = digests(seen.select("name", "row", F.coalesce(F.col("_id").cast("string"), F.lit("")).alias("id")))
    found = sums.join(hashes, "name").withColumns({"_target": _number(F.col("name")), "rewritten": F.col("name").startswith("merged-")})
    out = found.join(files, ["_target", "rewritten"])
    columns = F.lit(",".join(rows.columns))
    return out.select(F.col("_day").alias("day"), F.col("_lot").alias("lot"), F.col("_piece").alias("piece"), "n_rows", "min_click_id", "max_click_id", "cents", F.col("_sources").alias("sources"), "ids_sha256", columns.alias("columns"), F.concat(F.lit(f"{folder}/"), "name").alias("path"), "rewritten")


def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    clicks = table(spark, sf_dir, "clicks")
    folder = f"{shared_dir(spark)}/op11-{uuid.uuid4().hex}"
    files = compact(spark, clicks, folder, "arrived_at", "click_id")
    if files.isEmpty():
        empty = "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean"
        return spark.createDataFrame([], empty)
    return described(spark, clicks.schema, folder, files, "click_id", "value")

"""Files whose records span lines, read by many tasks.

A JSON array or a CSV with line feeds in its cells has no line that is known to
begin a record, so ``multiLine`` readers take a whole file in one task. Here
Spark's text source reads such a file in byte ranges, cut at a character that
every record ends with (``}`` or a line feed) into fragments. Whether a
fragment ends a record depends on the quotes and brackets before it: sums of
each byte range (one row a range) are added up in the order of the file, then
those of blocks of fragments (one row a block) within each range, then within
each block, and fragments are put together by the number of records that have
ended before them. No task sorts more than some blocks: blocks and texts are
dealt over as many tasks as their rows and bytes need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir


#: Tells fragments apart and orders them: file, start of the byte range, place in it.
_KEY = ["file", "start", "place"]
#: Fragments that follow each other in a range, 4,096 at most.
_BLOCK = ["file", "start", "block"]
BLOCK_BITS = 12
#: Fragments, and bytes of their texts, that a task is to hold.
TASK_ROWS, TASK_BYTES = 1 << 18, 128 << 20


def _fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``value`` of each fragment with its file, its range's start, a number
    that grows with its place in the range, and its block."""
    place = F.monotonically_increasing_id()  # counts within a task that reads, the task's number in front
    return (spark.read.option("lineSep", separator).text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), place.alias("place"))
             .withColumn("block", F.shiftright("place", BLOCK_BITS)))


def _tasks(marks: DataFrame) -> int:
    """Over how many tasks the fragments and their texts (``size`` bytes) are dealt."""
    n, size = marks.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return max(1 + n // TASK_ROWS, 1 + size // TASK_BYTES, marks.sparkSession.sparkContext.defaultParallelism)


def _range_sums(rows: DataFrame, value: str, total: str) -> DataFrame:
    """The sum of ``value`` over all earlier ranges of a row's file, as ``total``."""
    per = rows.groupBy("file", "start").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("file", "start", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(total))


def _running(rows: DataFrame, value: str, total: str, tasks: int) -> DataFrame:
    """``rows`` with the sum of ``value`` over all earlier fragments of the file:
    over earlier ranges (one row a range), over earlier blocks of the range (one
    row a block) and within the fragment's own block."""
    per = rows.groupBy(*_BLOCK).agg(F.sum(value).alias("_of_block"))
    earlier = Window.partitionBy("file", "start").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.select(*_BLOCK, F.coalesce(F.sum("_of_block").over(earlier), F.lit(0)).alias("_blocks"))
    base = (blocks.join(_range_sums(per, "_of_block", "_ranges"), ["file", "start"])
            .select(*_BLOCK, (F.col("_ranges") + F.col("_blocks")).alias("_base")))
    within = Window.partitionBy(*_BLOCK).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.repartition(tasks, *_BLOCK).withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(base, _BLOCK).withColumn(total, F.col("_within") + F.col("_base")).drop("_within", "_base")


def _records(rows: DataFrame, marks: DataFrame, separator: str, tasks: int) -> DataFrame:
    """Fragments put together: ``file``, ``number`` and ``record``. ``marks``
    tells of each fragment (by its key) whether it ends a record (``ends``). A
    record's fragments are as large as the record."""
    numbered = _running(marks.withColumn("_ends", F.col("ends").cast("int")), "_ends", "number", tasks).select(*_KEY, "number")
    parts = F.sort_array(F.collect_list(F.struct("start", "place", "value")))
    texts = rows.select("place", "value")  # a place is told apart without its file, whose name is long
    if tasks >= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # fewer tasks the engine deals by itself
        texts = texts.repartition(tasks, "place")
    found = texts.join(numbered, "place")
    return (found.repartition(tasks, "file", "number").groupBy("file", "number").agg(parts.alias("_parts"))
            .select("file", "number", F.array_join(F.col("_parts.value"), separator).alias("record")))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``number`` and ``record`` (its JSON text) of the objects in
    files that hold one array of objects each, however the files are laid out."""
    ensure_checkpoint_dir(spark)
    rows = _fragments(spark, path, "}")
    plain = F.regexp_replace("value", r"\\.", "")  # without escaped characters

    def opened(start: str) -> Column:  # brackets outside of strings, of a fragment that begins outside or inside of one
        return _count(F.regexp_replace(F.concat(F.lit(start), plain), '"[^"]*("|$)', ""), "{")

    # only numbers are summed up; the texts are moved once, when records are put together
    marks = rows.select(*_KEY, "block", F.octet_length("value").alias("size"), _count(plain, '"').alias("_quotes"),
                        opened("").alias("_out"), opened('"').alias("_in")).checkpoint(eager=True)
    tasks = _tasks(marks)
    marks = _running(marks, "_quotes", "_before", tasks)
    closes = (F.col("_before") + F.col("_quotes")) % 2 == 0  # the bracket after the fragment stands outside of a string
    marks = marks.select(*_KEY, "block", closes.alias("_closes"), F.when(F.col("_before") % 2 == 0, F.col("_out")).otherwise(F.col("_in")).alias("_opened"))
    marks = _running(marks.withColumn("_depth", F.col("_opened") - F.col("_closes").cast("int")).checkpoint(eager=True), "_depth", "_deep", tasks)
    deepest = F.col("_deep") + F.col("_opened")
    marks = marks.select(*_KEY, "block", (F.col("_closes") & (deepest == 1)).alias("ends")).checkpoint(eager=True)
    found = _records(rows, marks, "}", tasks)
    text = F.concat(F.regexp_replace("record", r"^[\s,\[]+", ""), F.lit("}"))
    return found.where(F.contains("record", F.lit("{"))).select("file", "number", text.alias("record"))


def read_json_array(spark: SparkSession, path: str, schema: StructType, time_pattern: str) -> DataFrame:
    """The objects of array files as rows of ``schema`` (other fields are left out, absent ones null)."""
    parsed = F.from_json("record", schema, {"timestampNTZFormat": time_pattern})
    return json_array_records(spark, path).select(parsed.alias("_r")).select("_r.*")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``number`` and ``record`` of the records of RFC-4180 files; the
    header is number 0 of each file. Empty lines between records are none."""
    ensure_checkpoint_dir(spark)
    rows = _fragments(spark, path, "\n")
    marks = rows.select(*_KEY, "block", F.octet_length("value").alias("size"), _count(F.col("value"), '"').alias("_quotes")).checkpoint(eager=True)
    tasks = _tasks(marks)
    marks = _running(marks, "_quotes", "_before", tasks)
    marks = marks.select(*_KEY, "block", ((F.col("_before") + F.col("_quotes")) % 2 == 0).alias("ends")).checkpoint(eager=True)
    found = _records(rows, marks, "\n", tasks)
    return found.where(F.regexp_replace("record", r"\r$", "") != "")


def read_csv_split(spark: SparkSession, path: str, schema: StructType, time_pattern: str) -> DataFrame:
    """The records of CSV files with a header as rows of ``schema``, by position."""
    options = {"escape": '"', "timestampNTZFormat": time_pattern, "mode": "PERMISSIVE"}
    # from_csv takes names without dots; they are given back afterwards
    named = StructType()
    for i, f in enumerate(schema.fields):
        named.add(f"c{i}", f.dataType)
    parsed = F.from_csv(F.regexp_replace("record", r"\r$", ""), F.lit(named.simpleString()[len("struct<"):-1].replace(":", " ")), options)
    rows = csv_records(spark, path).where("number > 0").select(parsed.alias("_r"))
    return rows.select(*[F.col(f"_r.c{i}").alias(f.name) for i, f in enumerate(schema.fields)])

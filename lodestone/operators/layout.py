"""Reading order of words with bounding boxes: lines, columns, page text.  Pages are the partitions of all windows.

Words are dealt to tasks by page once, to as many as keep a task's words about the same in number whatever there are in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C


#: Words of a task, about.
TASK_WORDS = 500_000


def dealt(words: DataFrame, by: list[str]) -> DataFrame:
    """words with all of a page in one task, and about TASK_WORDS in each."""
    tasks = -(-words.count() // TASK_WORDS)
    return words.repartition(max(tasks, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def lines_of_words(words: DataFrame, by: list[str]) -> DataFrame:
    """by, line_no, line: words in order of (top, x0); one at least 3.0 off the word before opens a line."""
    return _lines(dealt(words, by), by)


def column_ranges(words: DataFrame, by: list[str]) -> DataFrame:
    """by, x_start, x_end, column_no: runs of occupied bins, joined over gaps below 12, of 50 or more.  Needs page_left and page_right."""
    return _columns(dealt(words, by), by)


def _lines(words: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("top", "x0", "text")
    step = F.coalesce((F.abs(F.col("top") - F.lag("top").over(order)) >= C.LINE_TOLERANCE).cast("int"), F.lit(0))
    placed = words.withColumns({"_at": F.row_number().over(order), "_new": step})
    placed = placed.withColumn("line_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    grouped = placed.groupBy(*by, "line_no").agg(F.array_sort(F.collect_list(F.struct("_at", "text"))).alias("_words"))
    return grouped.select(*by, "line_no", F.array_join(F.col("_words.text"), " ").alias("line"))


def _columns(words: DataFrame, by: list[str]) -> DataFrame:
    bin_of = lambda c: ((F.col(c) - F.col("page_left")) / C.BIN_WIDTH).cast("int")
    last = F.greatest(F.lit(1), ((F.col("page_right") - F.col("page_left")) / C.BIN_WIDTH).cast("int") + 1) - 1
    spans = words.select(*by, "page_left", F.greatest(F.lit(0), bin_of("x0")).alias("a"), F.least(last, bin_of("x1")).alias("b")).where("a <= b")
    order = Window.partitionBy(*by).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # bins [a, b] cover [a, b + 1) widths; the gap to what came before is (a - reach - 1) widths
    gap = (F.col("a") - F.col("_reach") - 1) * C.BIN_WIDTH
    runs = spans.withColumn("_reach", reach).withColumn("_new", F.coalesce((gap >= C.MIN_GUTTER_WIDTH).cast("int"), F.lit(0)))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*by, "_run").agg((F.first("page_left") + F.min("a") * C.BIN_WIDTH).alias("x_start"), (F.first("page_left") + (F.max("b") + 1) * C.BIN_WIDTH).alias("x_end"))
    wide = merged.where(F.col("x_end") - F.col("x_start") >= C.MIN_COLUMN_WIDTH)
    return wide.select(*by, "x_start", "x_end", F.row_number().over(Window.partitionBy(*by).orderBy("x_start")).alias("column_no"))


def page_texts(words: DataFrame, by: list[str]) -> DataFrame:
    """by, text: column after column if there are two or more (words outside all are lost), else line after line."""
    words = dealt(words, by)
    columns = _columns(words, by).groupBy(*by).agg(F.collect_list(F.struct("x_start", "x_end", "column_no")).alias("_columns"))
    placed = words.join(columns.hint("shuffle_hash"), by, "left")  # both are dealt alike, and a task holds its pages' columns only
    inside = F.filter("_columns", lambda c: (F.col("x0") >= c["x_start"]) & (F.col("x0") < c["x_end"]))
    several = F.coalesce(F.size("_columns"), F.lit(0)) > 1
    placed = placed.withColumn("column_no", F.explode(F.when(several, inside["column_no"]).otherwise(F.array(F.lit(1))))).drop("_columns")
    lines = _lines(placed, [*by, "column_no"])
    parts = lines.groupBy(*by, "column_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("part"))
    return parts.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.struct("column_no", "part")))["part"], "\n\n").alias("text"))

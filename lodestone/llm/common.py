"""What the operators of this subpackage share: shared-folder tables, words, joins on skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.batches import giving_back
from lodestone.tables import materialize, workspace

__all__ = ["HEAVY", "WORD", "giving_back", "join_skewed", "materialize", "numbered", "shuffle_partitions", "text_of", "workspace"]

#: Words of the contracts: maximal runs outside space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ..., which clash with no other name; toDF(*docs.columns) brings the names back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


#: A key with more than one row in HEAVY of all is joined by broadcast; there are at most HEAVY such keys.
HEAVY = 2000


def join_skewed(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of rows with table, which has one row per combination of keys (not null) and the number of rows with it in weight.

    Keys with over total / HEAVY rows (HEAVY of them at most, which bounds the broadcast) are looked up in a broadcast table;
    all others are shuffled, and none of these fills a task.
    """
    heavy = F.col(weight) * HEAVY > F.lit(total)
    hot, cold = table.where(heavy), table.where(~heavy | heavy.isNull())
    found = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("shuffle_merge"), keys, "left")
    return found.unionByName(rest)

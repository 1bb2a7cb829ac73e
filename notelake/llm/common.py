"""What the operators of this subpackage share: intermediate tables and row handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from notelake.sources.interim import forget, keep, new_path, shared_folder

__all__ = ["forget", "id_and_text", "keep", "new_path", "one_row_each", "packed", "shared_folder"]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that other columns of the input can't clash; null texts become empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns of ``docs``, whatever their names, as one struct ``row``, and beside it the expressions ``keys``; ``select("row.*")`` gives the columns back."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*quoted).alias("row"), *[value.alias(name) for name, value in keys.items()])


def one_row_each(docs: DataFrame, wanted: DataFrame, digest: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, all columns, for each row of ``wanted``: (doc_id, digest, n), distinct keys and how many rows have them.

    ``digest`` is the expression over ``docs`` that made the keys; of rows that share
    a key the longest text stays. A null id matches a null id.
    """
    keyed = packed(docs, id=F.col(id_col), digest=digest)
    # a sort-merge join at every size: the keys grow with the corpus, so they are never broadcast
    keys = wanted.select(F.col("doc_id").alias("own"), F.col("digest").alias("key"), "n").hint("merge")
    on = keyed["id"].eqNullSafe(keys["own"]) & (keyed["digest"] == keys["key"])
    if wanted.filter("n > 1").isEmpty():
        return keyed.join(keys, on, "left_semi").select("row.*")
    found, text = keyed.join(keys, on), F.col("row").getField(text_col)
    longest = F.max_by("row", F.struct(F.char_length(text), text))
    repeated = found.filter("n > 1").groupBy("own", "key").agg(longest.alias("row"))
    return found.filter("n = 1").select("row").unionByName(repeated.select("row")).select("row.*")

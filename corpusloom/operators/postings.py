"""Word look-up by posting tables: the rows that hold a word, without a scan of the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.operators.tables import fts

# Folders of words, and parts into which the rows of a word are spread within its folder.
SLOTS, PARTS = 64, 8
WORD = r"[\p{L}\p{N}_]+"


def words_of(text: Column) -> Column:
    """The distinct words of a text, in lower case; words are the runs that ``fts`` takes as whole."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def store_postings(df: DataFrame, key: str, text: str, path: str) -> None:
    """Write ``word, key`` of every word and row, and how many rows each word has.

    A folder holds the words of one hash value; the rows of one word, of which a frequent one
    has very many, are spread over several tasks, and sorted so that a look-up passes over the other words.
    """
    found = df.select(F.col(key).alias("key"), F.explode(words_of(F.col(text))).alias("word")).withColumn("slot", _slot(F.col("word")))
    spread = found.repartition("slot", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    spread.sortWithinPartitions("slot", "word", "key").write.partitionBy("slot").parquet(f"{path}/rows")
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    counts = stored.groupBy("slot", "word").agg(F.count(F.lit(1)).alias("n"))
    counts.repartition("slot").sortWithinPartitions("slot", "word").write.partitionBy("slot").parquet(f"{path}/counts")


class Postings:
    """A stored posting table; ``key`` is the column that it names rows by."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def _of(self, part: str, words: list[str]) -> DataFrame:
        """Rows of some words: only their folders are read."""
        named = self.spark.createDataFrame([(w,) for w in words], "word string").select("word", _slot(F.col("word")).alias("slot")).collect()
        table = self.spark.read.parquet(f"{self.path}/{part}")
        return table.where(F.col("slot").isin([r["slot"] for r in named]) & F.col("word").isin(words))

    def keys(self, words: list[str]) -> DataFrame:
        """Keys of the rows that hold all words, which are one or more; the rarest is read first, the others only keep some of its rows."""
        counts = {r["word"]: r["n"] for r in self._of("counts", words).select("word", "n").collect()}
        order = sorted(set(words), key=lambda w: (counts.get(w, 0), w))
        found = self._of("rows", order[:1]).select("key")
        for word in order[1:]:
            found = found.join(self._of("rows", [word]).select("key"), "key", "left_semi")
        return found

    def lookup(self, df: DataFrame, text: str, terms: list[str]) -> DataFrame:
        """Rows of ``df`` whose text holds all terms, as ``fts`` finds them.

        The words of the terms name the rows, then the terms themselves are looked for in these. Terms without
        any letter or number are looked for in all rows.
        """
        split = self.spark.createDataFrame([(" ".join(terms),)], "t string").select(words_of(F.col("t")).alias("w")).first()["w"]
        rows = df
        if split:
            keys = self.keys(split).select(F.col("key").alias(self.key))
            rows = df.join(keys, self.key, "left_semi")
        return rows.where(fts(F.col(text), terms))

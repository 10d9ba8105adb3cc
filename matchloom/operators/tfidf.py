"""TF-IDF fitted relationally: terms, document frequencies and a vocabulary cut by corpus frequency."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean


def terms(text: Column, stop: list[str]) -> Column:
    """Words of two letters or more that aren't stop words, and pairs of words that follow each other then."""
    w = F.filter(F.regexp_extract_all(clean(text), F.lit(r"\b\w\w+\b"), F.lit(0)), lambda x: ~x.isin(stop))
    pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


class FrequencyTable:
    """Frequencies by batch in a folder: a growing corpus is fitted by adding a batch and summing up, never by reading texts again."""

    def __init__(self, spark, path: str, vectorizer: TfIdf):
        self.spark, self.path, self.vectorizer = spark, path, vectorizer

    def add(self, rows: DataFrame, batch: str) -> None:
        """A batch added again under its name replaces itself."""
        self.vectorizer.frequencies(rows).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def fit(self) -> TfIdf:
        return self.vectorizer.fit_frequencies(self.spark.read.parquet(self.path).drop("batch"))


class TfIdf:
    def __init__(self, max_features: int = 100, min_df: int = 2, max_df: float = 0.8, stop: list[str] | None = None):
        self.max_features, self.min_df, self.max_df = max_features, min_df, max_df
        self.stop, self.vocabulary = stop or StopWordsRemover.loadDefaultStopWords("english"), None

    def _counts(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", F.explode(terms(F.col("description"), self.stop)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))

    def frequencies(self, rows: DataFrame) -> DataFrame:
        """(term, df, cf) of ``rows`` (id, description), and a row of a null term whose df is the number of rows. Those of batches add up."""
        every = rows.agg(F.lit(None).cast("string").alias("term"), F.count("*").alias("df"), F.lit(0).cast("long").alias("cf"))
        return self._counts(rows).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).unionByName(every)

    def fit(self, rows: DataFrame) -> TfIdf:
        """``vocabulary``: (term, at, idf), alphabetical, of at most ``max_features`` rows."""
        return self.fit_frequencies(self.frequencies(rows))

    def fit_frequencies(self, *batches: DataFrame) -> TfIdf:
        """From :meth:`frequencies` of any number of batches, without their texts."""
        both = reduce(DataFrame.unionByName, batches).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        n = both.where("term IS NULL").select(F.col("df").alias("docs"))
        df = both.where("term IS NOT NULL").crossJoin(F.broadcast(n))  # one row
        cut = df.where((F.col("df") >= self.min_df) & (F.col("df") <= self.max_df * F.col("docs"))).orderBy(F.desc("cf"), "term").limit(self.max_features)
        idf = F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1
        made = cut.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("at"), idf.alias("idf"))
        # As many rows as features: what is transformed later doesn't count the corpus again.
        self.vocabulary = cut.sparkSession.createDataFrame(made.collect(), made.schema)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """(id, tfidf): L2-normalised, ``max_features`` wide whatever the vocabulary's size."""
        if self.vocabulary is None:
            raise ValueError("fit the vectorizer first")
        hit = self._counts(rows).join(F.broadcast(self.vocabulary), "term").select("id", "at", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
        per = hit.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        place = F.sequence(F.lit(0), F.lit(self.max_features - 1))
        vec = F.transform(place, lambda i: F.coalesce(F.try_element_at("m", i) / F.col("norm"), F.lit(0.0)))
        return rows.select("id").join(per, "id", "left").select("id", vec.alias("tfidf"))

    def top_terms(self, n: int) -> DataFrame:
        return self.vocabulary.orderBy("term").limit(n).select("term")

    def save(self, path: str) -> None:
        if self.vocabulary is None:
            raise ValueError("fit the vectorizer first")
        self.vocabulary.coalesce(1).write.mode("overwrite").parquet(f"{path}/vocabulary")
        kept = [(self.max_features, self.min_df, self.max_df, self.stop)]
        self.vocabulary.sparkSession.createDataFrame(kept, self._SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    _SCHEMA = "max_features int, min_df int, max_df double, stop array<string>"

    @classmethod
    def load(cls, spark, path: str) -> TfIdf:
        out = cls(*spark.read.schema(cls._SCHEMA).json(f"{path}/settings").first())
        out.vocabulary = spark.read.parquet(f"{path}/vocabulary")
        return out

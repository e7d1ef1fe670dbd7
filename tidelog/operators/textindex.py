"""An inverted text index as two tables: postings (token, entity_id), distinct, and the vocabulary.

The vocabulary is kept apart because a token whose postings were all removed is still known.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """White space separates; inside a piece what isn't a letter or number is dropped; lower case; no empty tokens."""
    # Over the whole text at once: dropping characters joins no two pieces, since white space stays.
    cleaned = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}]+", ""))
    return F.array_remove(F.split(cleaned, r"\p{IsWhite_Space}+"), "")


def tokenized(docs: DataFrame, entity: str, text: str) -> DataFrame:
    """(entity_id, pos, token): the tokens of each text in their order."""
    return docs.select(F.col(entity).alias("entity_id"), F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def _postings(docs: DataFrame, entity: str, text: str) -> DataFrame:
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"), F.col(entity).alias("entity_id")).distinct()


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    vocabulary: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, entity: str, text: str) -> TextIndex:
        postings = _postings(docs, entity, text)
        return cls(postings, postings.select("token").distinct())

    def insert(self, docs: DataFrame, entity: str, text: str) -> TextIndex:
        new = _postings(docs, entity, text)
        return TextIndex(self.postings.unionByName(new).distinct(), self.vocabulary.unionByName(new.select("token")).distinct())

    def remove(self, docs: DataFrame, entity: str, text: str) -> TextIndex:
        """Removes the postings of the given texts' tokens; the tokens stay known."""
        return replace(self, postings=self.postings.join(_postings(docs, entity, text), ["token", "entity_id"], "left_anti"))

    def _only(self, query: str) -> tuple[DataFrame, DataFrame]:
        """Postings and vocabulary of the query's tokens; a filter by them goes down to the texts' tokens, before any
        shuffle."""
        spark = self.postings.sparkSession
        wanted = spark.createDataFrame([(query,)], "q string").select(F.array_distinct(tokens(F.col("q"))).alias("t")).first()["t"]
        hit = F.col("token").isin(wanted) if wanted else F.lit(False)
        return self.postings.where(hit), self.vocabulary.where(hit)

    def search_and(self, query: str) -> DataFrame:
        """Entities with all tokens of the query that are known; unknown ones don't count. None known: nothing."""
        postings, vocabulary = self._only(query)
        n_known = vocabulary.agg(F.count(F.lit(1)).alias("n_known"))
        found = postings.groupBy("entity_id").agg(F.count("token").alias("n"))
        return found.join(n_known, F.col("n") == F.col("n_known")).select("entity_id")

    def search_or(self, query: str) -> DataFrame:
        """Entities with any token of the query."""
        return self._only(query)[0].select("entity_id").distinct()

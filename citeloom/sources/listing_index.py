"""A listing that is kept offline: its rows and an inverted index over the words of its titles, refreshed by what has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import resolve as R
from citeloom.sources.store import StoredTable
from citeloom.storage import Kept


class ListingIndex:
    """Two stored tables: ``rows`` by (kind, url) and ``postings`` by (kind, word), each bucketed by these.

    The number of titles of a word is counted where its postings lie, without a
    shuffle, and documents' words are joined to them there.
    """

    def __init__(self, spark: SparkSession, path: str, prefix: str = "listing", parts: int = 16, buckets: int = 8):
        self.spark = spark
        self._rows = StoredTable(spark, f"{prefix}_rows", f"{path.rstrip('/')}/rows", ["kind", "url"], parts, buckets)
        self._postings = StoredTable(spark, f"{prefix}_postings", f"{path.rstrip('/')}/postings", ["kind", "w"], parts, buckets)

    @property
    def rows(self) -> DataFrame:
        return self._rows.read()

    @property
    def postings(self) -> DataFrame:
        return self._postings.read()

    def refresh(self, listing: DataFrame, complete: bool = True) -> dict[str, list[int]]:
        """Takes a listing in: new and changed rows replace what is stored of their urls; if it is ``complete``, urls that it lacks go.

        Postings are only touched where a title's words changed: a row that
        merely moved costs a rewrite of its row. Returns the rewritten parts.
        """
        kept, keys = Kept(self.spark), ["kind", "url"]
        fresh = kept(R.listing_words(listing))
        self._rows.declare(fresh.schema)
        self._postings.declare(R.listing_postings(fresh).schema)
        old = self.rows
        same = old.select(*keys, F.struct("pos", "listed_on", "words").alias("was"))
        change = fresh.join(same, keys, "left").withColumn("is", F.struct("pos", "listed_on", "words"))
        changed = kept(change.filter(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.col("is"))).withColumn("reworded", F.col("was").isNull() | ~F.col("was.words").eqNullSafe(F.col("words"))))
        # Kept, as the first replacement changes what it is read from.
        gone = kept((old.join(fresh, keys, "left_anti") if complete else old.filter("false")).select(*keys))
        reworded = changed.filter("reworded")
        done = {
            "rows": self._rows.replace(changed.select(*fresh.columns), changed.select(*keys).unionByName(gone), keys),
            "postings": self._postings.replace(R.listing_postings(reworded), reworded.select(*keys).unionByName(gone), keys),
        }
        kept.close()
        return done

    def nearest(self, documents: DataFrame, kept: Kept) -> DataFrame:
        """The best stored row of each document: ref, url, score."""
        known = kept(R.word_counts(self.postings))
        return R.nearest(documents, self.rows, self.postings, known, kept)

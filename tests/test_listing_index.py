"""The stored listing index: refreshes touch what changed, look-ups equal a full comparison."""

import random

from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import resolve as R
from citeloom.sources.listing_index import ListingIndex
from citeloom.storage import Kept

LISTING = "kind string, title string, url string, listed_on string, pos int"
DOCS = "ref int, document_type string, title string, short_title string, identifier string, date string"


def listing(spark, titles):
    return spark.createDataFrame([("act", t, f"/legal/acts/{k}", "01-02-2020", p) for p, (k, t) in enumerate(titles)], LISTING)


def test_nearest_equals_comparing_all(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    titles = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(150)] + [(900, "Amendment to w1 w2"), (901, ""), (902, "w1 w1")]
    asked = [(i, "act", " ".join(rng.choices(words, k=rng.randrange(1, 9))), None, None, None) for i in range(60)] + [(70, "act", "nothing known", None, None, None), (71, "act", None, None, None, None), (72, "circular", "w1", None, None, None)]
    docs, rows = spark.createDataFrame(asked, DOCS), listing(spark, titles)
    kept = Kept(spark)
    index = ListingIndex(spark, f"file://{tmp_path}/i", "t_listing_nearest", parts=2, buckets=2)
    index.refresh(rows)
    got = {r.ref: (r.url, r.score) for r in index.nearest(docs, kept).collect()}
    pairs = R._targets(docs).join(R.listing_words(rows), "kind").withColumn("score", T.jaccard(F.col("target"), F.col("words"))).filter("score > 0")
    want = {r.ref: (r.b.url, r.b.score) for r in R.best(pairs, "b").collect()}
    assert got == want and len(want) > 40
    kept.close()


def test_an_update_changes_only_what_it_must(spark, tmp_path):
    index = ListingIndex(spark, f"file://{tmp_path}/i", "t_listing_update", parts=32, buckets=1)
    titles = [(i, f"alpha{i} beta{i % 3}") for i in range(40)]
    index.refresh(listing(spark, titles))
    assert index.rows.count() == 40 and index.postings.count() == 80
    moved = index.refresh(listing(spark, titles[::-1]))  # only positions
    assert moved["rows"] and not moved["postings"] and index.postings.count() == 80
    assert index.refresh(listing(spark, titles[::-1])) == {"rows": [], "postings": []}
    update = [(7, "gamma7 beta1")] + [t for t in titles if t[0] not in (3, 7)]
    done = index.refresh(listing(spark, update[::-1]))
    assert 0 < len(done["postings"]) <= 5  # alpha7, gamma7, alpha3 and the betas' parts
    told = {(r.w, r.url) for r in index.postings.collect()}
    assert ("gamma7", "/legal/acts/7") in told and not any(w in ("alpha7", "alpha3") or u.endswith("/3") for w, u in told) and len(told) == 78
    part = index.refresh(listing(spark, [(99, "delta")]), complete=False)  # what it lacks stays
    assert index.rows.count() == 40 and len(part["postings"]) == 1
    kept = Kept(spark)
    doc = spark.createDataFrame([(1, "act", "gamma7 beta1", None, None, None)], DOCS)
    assert [tuple(r) for r in index.nearest(doc, kept).collect()] == [(1, "/legal/acts/7", 1.0)]
    kept.close()

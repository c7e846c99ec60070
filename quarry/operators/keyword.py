"""Keyword ranking: BM25 over file names, captions, tags and bodies with a weight for each field."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.porter import stem, stemmed
from quarry.functions.scalar import spoken_filename, words
from quarry.session import spread, written

#: Weight of a term's occurrences in each field.
FIELDS = {"filenames": 0.3, "caption": 1.0, "tags": 0.8, "body": 0.6}
K1, B = 1.2, 0.75


def documents(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(hash, filenames, caption, tags, body) of every asset, whatever its status; file names of present files, as words, by id."""
    present = files.where(F.col("present") & F.col("hash").isNotNull())
    names = present.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("id", spoken_filename(F.col("filename")).alias("w")))).alias("n"))
    joined = spread(assets.select("hash", "caption", "tags", "body")).join(names, "hash", "left")
    return joined.select("hash", F.coalesce(F.array_join("n.w", " "), F.lit("")).alias("filenames"), F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce(F.array_join("tags", " "), F.lit("")).alias("tags"), F.coalesce("body", F.lit("")).alias("body"))


def bm25(docs: DataFrame, terms: Sequence[str], weights: dict[str, float] | None = None, stems: bool = False) -> DataFrame:
    """(hash, bm25, keyword) of documents with any of the terms; ``keyword`` is the share of the best. A repeated term counts as often.

    idf is at least 1e-6; a document's length is all its words. One pass counts the terms of each document and writes these few numbers a
    document; collection statistics (one row) and scores are read from there, so no text is cut into words twice. With ``stems``, words that have the stem of a term are found through the dictionary of distinct words, the
    only thing the stemmer sees.
    """
    weights = weights or FIELDS
    tokens = docs.select("hash", *[words(F.col(f)).alias(f) for f in weights])
    wanted = list(dict.fromkeys(terms))
    if not wanted:
        return docs.select("hash", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("keyword")).limit(0)
    forms = [[t] for t in wanted]
    if stems:
        goal = [stem(t) for t in wanted]
        starts = sorted({t[:2] for t in wanted})  # stemming never touches the first two letters
        near = F.array_distinct(F.filter(F.concat(*weights), lambda w: F.substring(w, 1, 2).isin(*starts)))
        found = tokens.select(F.explode(near).alias("w")).distinct().withColumn("s", stemmed(F.col("w"))).where(F.col("s").isin(*goal)).collect()
        forms = [sorted({t, *(r["w"] for r in found if r["s"] == g)}) for t, g in zip(wanted, goal, strict=True)]

    def frequency(form: list[str]) -> Column:
        return sum((F.lit(w) * F.size(F.filter(f, lambda x: x.isin(*form))) for f, w in weights.items()), F.lit(0.0))

    length = sum((F.size(f) for f in weights), F.lit(0))
    counted = written(tokens.select("hash", length.alias("dl"), *[frequency(form).alias(f"f{i}") for i, form in enumerate(forms)]), "terms")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(wanted))])
    rows = counted.where(" or ".join(f"f{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, t in enumerate(wanted):
        f, d = F.col(f"f{i}"), F.col(f"d{i}")
        idf = F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(1e-6))
        score = score + F.lit(float(list(terms).count(t))) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    scored = rows.select("hash", score.alias("bm25"))
    top = scored.agg(F.max("bm25").alias("_top"))
    return scored.crossJoin(F.broadcast(top)).select("hash", "bm25", F.when(F.col("_top") > 0, F.col("bm25") / F.col("_top")).otherwise(0.0).alias("keyword"))


class KeywordIndex:
    """Postings in the shared folder, so that a search reads only its own terms.

    ``postings`` (bucket, term, hash, f = weighted occurrences, dl) is partitioned by the hash of the term and sorted by term, so a search
    opens a bucket per term and skips the row groups of others; ``terms`` has how many documents hold each term, ``totals`` is one row. The
    number of buckets grows with the postings, and every bucket is split by document, the more the more documents there are: a term of
    all documents is read by many tasks. With ``stems`` the terms are stems.
    """

    #: Postings of a bucket's part, about, and documents from which buckets are split.
    ROWS, SPLIT = 2_000_000, 500_000

    def __init__(self, docs: DataFrame, path: str, weights: dict[str, float] | None = None, stems: bool = False):
        self.spark, self.path, self.stems = docs.sparkSession, path, stems
        weights = weights or FIELDS
        tokens = docs.select("hash", *[words(F.col(f)).alias(f) for f in weights])
        length = sum((F.size(f) for f in weights), F.lit(0))

        def weighted(field: str, weight: float) -> Column:
            return F.transform(field, lambda x: F.struct(x.alias("term"), F.lit(weight).alias("w")))

        each = F.flatten(F.array(*[weighted(f, w) for f, w in weights.items()]))
        counted = tokens.select("hash", length.alias("dl"), F.explode_outer(each).alias("x")).groupBy("hash", "dl", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("f"))
        if stems:
            forms = counted.select("term").where("term is not null").distinct().withColumn("stem", stemmed(F.col("term")))
            counted = counted.join(forms, "term", "left").groupBy("hash", "dl", F.col("stem").alias("term")).agg(F.sum("f").alias("f"))
        counted = written(counted, "postings")  # a document without words has one row, its term null
        self.totals = counted.select("hash", "dl").distinct().agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), F.lit(counted.count()).alias("postings")).first()
        parts = max(1, -(-self.totals["n"] // self.SPLIT))
        self.buckets = max(8, -(-self.totals["postings"] // (self.ROWS * parts)))
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        kept = counted.where("term is not null").withColumn("bucket", bucket)
        kept.repartition(self.buckets * parts, "bucket", F.pmod(F.xxhash64("hash"), F.lit(parts))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        kept.groupBy("bucket", "term").agg(F.count("*").alias("d")).repartition("bucket").sortWithinPartitions("bucket", "term").write.parquet(f"{path}/terms")
        schema = kept.select("hash", "dl", "term", "f", "bucket").schema
        self.rows = self.spark.read.schema(schema).parquet(f"{path}/postings")
        self.terms = self.spark.read.schema("bucket int, term string, d long").parquet(f"{path}/terms")

    def _bucket(self, terms: Sequence[str]) -> set[int]:
        one = self.spark.sql("SELECT * FROM VALUES (1) AS t(x)")
        return set(one.select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int").alias(f"b{i}") for i, t in enumerate(terms)]).first())

    def search(self, terms: Sequence[str]) -> DataFrame:
        """(hash, bm25, keyword), as ``bm25`` gives."""
        weight: dict[str, int] = {}
        for t in terms:
            t = stem(t) if self.stems else t
            weight[t] = weight.get(t, 0) + 1
        if not weight:
            return self.rows.select("hash", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("keyword")).limit(0)
        mine = F.col("bucket").isin(*self._bucket(list(weight))) & F.col("term").isin(*weight)
        n, mean = self.totals["n"], self.totals["mean"] or 1.0
        # a row a term of the query
        idf = {r["term"]: weight[r["term"]] * max(math.log((n - r["d"] + 0.5) / (r["d"] + 0.5)), 1e-6) for r in self.terms.where(mine).collect()}
        if not idf:
            return self.rows.select("hash", F.lit(0.0).alias("bm25"), F.lit(0.0).alias("keyword")).limit(0)
        times = F.element_at(F.create_map(*[F.lit(x) for pair in idf.items() for x in pair]), F.col("term"))
        part = times * F.expr(f"f * {K1 + 1}D / (f + {K1}D * ({1 - B}D + {B}D * dl / {float(mean)!r}D))")
        scored = self.rows.where(mine).groupBy("hash").agg(F.sum(part).alias("bm25"))
        top = scored.agg(F.max("bm25").alias("_top"))
        return scored.crossJoin(F.broadcast(top)).selectExpr("hash", "bm25", "CASE WHEN _top > 0 THEN bm25 / _top ELSE 0D END AS keyword")

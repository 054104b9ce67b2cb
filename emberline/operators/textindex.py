"""An inverted index of TF-IDF weights, and exact top-k search that reads only the postings that can matter.

For each level and term the index knows how many postings there are and the largest weight, so a query's term can
add at most its own weight times that to a score. Postings of the term with the largest bound are read first; their k-th best
sum is a floor. Terms whose bounds together stay below the floor cannot lift a text over it by
themselves: texts are sought among the postings of the other terms only, and the rest is read for those texts alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import retrieval as V

#: Buckets of terms, and what scores may lie apart by rounding.
BUCKETS, SLACK = 64, 1e-8


def _counts(texts: DataFrame, keys: list[str], stop_words: tuple[str, ...]) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(V.WORD), F.lit(0))
    return texts.select(*keys, F.explode(words).alias("term")).where(~F.col("term").isin(*stop_words)).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class TextIndex:
    spark: SparkSession
    path: str
    stop_words: tuple[str, ...]
    #: Postings that the last search read, of how many of its terms.
    read: int = 0
    total: int = 0

    @classmethod
    def build(cls, corpus: DataFrame, path: str, features: int = 1000, stop_words: tuple[str, ...] = ()) -> TextIndex:
        """Index of (level, id, text), ids unique in a level: idf is ln((1 + n) / (1 + df)) + 1 over all texts, the vocabulary their
        `features` most frequent terms (ties by the term), and a text's weights have length 1."""
        spark, n = corpus.sparkSession, corpus.count()
        counts = _counts(corpus, ["level", "id"], stop_words)
        vocabulary = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).orderBy(F.col("total").desc(), "term").limit(features)
        idf = vocabulary.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
        idf.write.parquet(f"{path}/idf")
        w = counts.join(F.broadcast(spark.read.parquet(f"{path}/idf")), "term").select("level", "id", "term", (F.col("tf") * F.col("idf")).alias("w"))  # `features` rows
        norm = w.groupBy("level", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        postings = w.join(norm, ["level", "id"]).select("level", "id", "term", (F.col("w") / F.col("norm")).alias("w"), _bucket("term").alias("bucket"))
        # a frequent term's postings are dealt to several files, sorted so that row groups of other terms are skipped
        postings.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        spark.read.parquet(f"{path}/postings").groupBy("level", "term").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("most")).write.parquet(f"{path}/terms")
        corpus.select("level", "id").write.parquet(f"{path}/texts")
        return cls(spark, path, stop_words)

    def _postings(self, wanted: dict[str, list[str]]) -> DataFrame:
        """Postings of some terms of each level; only their buckets are read."""
        terms = sorted({t for ts in wanted.values() for t in ts})
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket("term")).distinct().collect()]
        own = F.lit(False)
        for level, ts in wanted.items():
            own = own | ((F.col("level") == level) & F.col("term").isin(*ts)) if ts else own
        return self.spark.read.parquet(f"{self.path}/postings").where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms) & own)

    def search(self, text: str, k: int) -> DataFrame:
        """(level, rank, id, score): of each level the k texts most like a text, as a scan of all would rank them: scores to 9 digits, ties
        to the smaller id, texts without a shared term last. What is read is counted in `read`."""
        spark = self.spark
        asked = _counts(spark.createDataFrame([(text,)], "text string"), [], self.stop_words).join(spark.read.parquet(f"{self.path}/idf"), "term")
        q = {r["term"]: r["tf"] * r["idf"] for r in asked.collect()}  # the terms of one text
        length = sum(x * x for x in q.values()) ** 0.5
        q = {t: x / length for t, x in q.items()}
        known = spark.read.parquet(f"{self.path}/terms").where(F.col("term").isin(*q)).collect() if q else []
        bounds: dict[str, dict[str, float]] = {}
        for r in known:
            bounds.setdefault(r["level"], {})[r["term"]] = q[r["term"]] * r["most"]
        self.total, self.read = sum(r["n"] for r in known), 0
        sizes = {(r["level"], r["term"]): r["n"] for r in known}
        weight = F.element_at(F.create_map(*(F.lit(x) for pair in q.items() for x in pair)), F.col("term")) if q else F.lit(0.0)

        def summed(wanted: dict[str, list[str]]) -> DataFrame:
            return self._postings(wanted).groupBy("level", "id").agg(F.sum(F.col("w") * weight).alias("part"))

        def floors(sums: DataFrame) -> dict[str, float]:
            best = Window.partitionBy("level").orderBy(F.col("part").desc())
            rows = sums.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).collect()  # a row a level
            return {r["level"]: r["part"] for r in rows}

        lead = {level: [max(b, key=lambda t: (b[t], t))] for level, b in bounds.items()}  # noqa: B023
        floor = floors(summed(lead)) if lead else {}
        seek: dict[str, list[str]] = {}
        rest: dict[str, list[str]] = {}
        for level, b in bounds.items():
            spare, left = floor.get(level, 0.0) - SLACK, []
            for t in sorted(b, key=lambda t: (b[t], t)):  # noqa: B023
                if b[t] >= spare:
                    break
                spare -= b[t]
                left.append(t)
            rest[level], seek[level] = left, [t for t in b if t not in left]
        self.read = sum(sizes[level, t] for level, ts in seek.items() for t in ts)
        out = spark.createDataFrame([], spark.read.parquet(f"{self.path}/texts").schema.add("score", "double"))
        if seek:
            found = summed(seek)
            more = F.element_at(F.create_map(*(F.lit(x) for level in seek for x in (level, sum(bounds[level][t] for t in rest[level])))), F.col("level"))
            least = F.element_at(F.create_map(*(F.lit(x) for level in seek for x in (level, floor.get(level, 0.0) - SLACK))), F.col("level"))
            able = found.where(F.col("part") + more >= least)
            if any(rest.values()):
                others = self._postings(rest).join(able.select("level", "id"), ["level", "id"], "left_semi")
                self.read += others.count()
                able = able.unionByName(others.groupBy("level", "id").agg(F.sum(F.col("w") * weight).alias("part"))).groupBy("level", "id").agg(F.sum("part").alias("part"))
            out = able.select("level", "id", F.round("part", 9).alias("score"))
        best = Window.partitionBy("level").orderBy(F.col("score").desc(), "id")
        top = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("level", "id", "score")
        # where fewer texts share a term, the first others follow with 0
        first = Window.partitionBy("level").orderBy("id")
        zeros = spark.read.parquet(f"{self.path}/texts").join(top.select("level", "id"), ["level", "id"], "left_anti").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("level", "id", F.lit(0.0).alias("score"))
        return top.unionByName(zeros).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("level", "rank", "id", "score")

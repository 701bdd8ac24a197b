"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

The ledger keeps one row for each canonical key - how many records had it and the smallest id among them - in hash buckets.
A new batch is aggregated by key (map-side first, so a key that holds a third of the batch stays cheap), brought into the
ledger's buckets and full-outer-joined with them bucket by bucket: the ledger itself is never shuffled. Counts are added, the
earliest representative is kept, and the result is written as a new version. How many buckets there are follows the
number of keys.

A version counts once the manifest names it, beside the batch that made it. A job that dies before leaves a folder that
nothing reads and the next batch removes; a batch that comes again adds nothing. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.session import remove, scratch_path

#: Keys in a bucket before there are twice as many buckets; keys that join by broadcast at most, and records such a key has at least.
BUCKET_ROWS, HOT_MOST, HOT_LEAST = 2_000_000, 20_000, 20_000

_BLANK = r"[\p{IsWhite_Space}\p{P}\p{S}]"
_NAMED = rf"(?:P\.{_BLANK}*)?([A-Z]{_BLANK}*[0-9]+{_BLANK}*[A-Z])"
_ONE = "[A-Z][0-9]+[A-Z]"


def squeezed(column: Column) -> Column:
    """Upper case without white space and punctuation of any script."""
    return F.regexp_replace(F.upper(column), _BLANK + "+", "")


def canonical(column: Column) -> Column:
    """What writings of one variant have in common; null for null and for white space only.

    Letter case, white space, punctuation (symbols such as ``+`` and ``|`` included) and a ``p.`` before a substitution are
    dropped, substitutions are sorted. Other text stays where it stood among the substitutions, whose places ``#`` marks.
    """
    blank = F.regexp_replace(column, r"\p{IsWhite_Space}+", "") == ""
    bare = F.regexp_replace(F.regexp_replace(F.upper(column), _NAMED, "$1"), _BLANK + "+", "")
    subs = F.array_join(F.array_sort(F.regexp_extract_all(bare, F.lit(f"({_ONE})"), F.lit(1))), "+")
    return F.when(~blank, F.concat_ws("|", subs, F.nullif(F.regexp_replace(F.regexp_replace(bare, _ONE, "#"), "^#*$", ""), F.lit(""))))


class Ledger:
    """Counts and earliest representatives by key in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        """The ledger kept at ``root``, as its manifest describes it; a new one where there is none."""
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.batches: set[str] = set()
        self.versions: list[tuple[str, int, int]] = []
        if self._names("manifest"):
            # one row a batch
            for r in spark.read.schema(_MANIFEST).json(f"{self.root}/manifest").orderBy("number").collect():
                self.batches.add(r["batch"])
                self.versions.append((r["version"], r["buckets"], r["keys"]))

    def _names(self, folder: str = "") -> list[str]:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}".rstrip("/"))
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []

    def rows(self) -> DataFrame | None:
        """(keys, n, first) of all keys, in their buckets; None while there are none."""
        if not self.versions:
            return None
        version, buckets, _ = self.versions[-1]
        name = f"ledger_{version}"
        if not self.spark.catalog.tableExists(name):
            keys = ", ".join(f"`{k}`" for k in self.keys)
            columns = ", ".join([*(f"`{k}` STRING" for k in self.keys), "n BIGINT", "first BIGINT"])
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{self.root}/{version}'")
        return self.spark.table(name)

    def add(self, records: DataFrame, rec_id: str, batch: str) -> bool:
        """Count a batch in, once: a batch whose name the manifest holds adds nothing. Records with a null key don't count.

        Returns whether the batch was new. Keys are texts.
        """
        if batch in self.batches:
            return False
        known = records.dropna(subset=self.keys)
        news = known.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n"), F.min(rec_id).cast("bigint").alias("first"))
        old, version = self.rows(), f"v{uuid.uuid4().hex}"
        least = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        _, buckets, held = self.versions[-1] if self.versions else ("", least, 0)
        wide = buckets
        while held > wide * BUCKET_ROWS:
            wide *= 2
        merged = news if buckets == least else news.repartition(buckets, *self.keys)
        if old is not None:
            a, b = old.withColumnsRenamed({"n": "n_a", "first": "first_a"}), merged.withColumnsRenamed({"n": "n_b", "first": "first_b"})
            merged = a.join(b.hint("merge"), self.keys, "full_outer").select(
                *self.keys, (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"), F.least("first_a", "first_b").alias("first")
            )
        if wide != buckets or old is None:
            merged = merged.repartition(wide, *self.keys)
        path = f"{self.root}/{version}"
        merged.write.format("parquet").bucketBy(wide, *self.keys).sortBy(*self.keys).option("path", path).saveAsTable(f"ledger_{version}")
        count = self.spark.table(f"ledger_{version}").count()
        row = (len(self.versions) + 1, batch, version, wide, count)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        self.versions.append((version, wide, count))
        self.batches.add(batch)
        self._tidy()
        return True

    def _tidy(self) -> None:
        """Remove all versions but the last two: the one before may still be read."""
        kept = {v for v, _, _ in self.versions[-2:]}
        for name in self._names():
            if name.startswith("v") and name not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS ledger_{name}")
                remove(self.spark, f"{self.root}/{name}")


_MANIFEST = "number int, batch string, version string, buckets int, keys bigint"


def keyed(records: DataFrame) -> DataFrame:
    """Records with their two keys. A null or blank original or a null query_id gives a null key, so no copies."""
    return records.withColumn("query_key", squeezed(F.col("query_id"))).withColumn("variant_key", canonical(F.col("original")))


_KEYS = ["query_key", "variant_key"]


def build(records: DataFrame, root: str | None = None, batches: int = 3) -> tuple[Ledger, DataFrame]:
    """A ledger of variant records, fed in batches by time of receipt, and the records (rec_id, keys) it was fed with.

    Keys are worked out once and written by batch; records without a time come last. A ``root`` that holds these batches
    already is read, not fed again.
    """
    spark = records.sparkSession
    seconds = F.col("received_at").cast("double")
    span = records.agg(F.min(seconds).alias("a"), F.max(seconds).alias("b")).first()
    low, width = (span["a"] or 0.0), max(((span["b"] or 0.0) - (span["a"] or 0.0)) / batches, 1.0)
    no = F.coalesce(F.least(F.floor((seconds - low) / width), F.lit(batches - 1)), F.lit(batches - 1)).cast("int")
    slim = keyed(records.select("rec_id", "query_id", "original", "received_at")).dropna(subset=_KEYS).select("rec_id", *_KEYS, no.alias("batch"))
    path = scratch_path(spark, "keyed")
    slim.write.partitionBy("batch").parquet(path)
    told = spark.read.schema("rec_id bigint, query_key string, variant_key string, batch int").parquet(path)
    book = Ledger(spark, root or scratch_path(spark, "ledger"), _KEYS)
    for i in range(batches):
        book.add(told.filter(F.col("batch") == i), "rec_id", f"{low}-{width}-{i}")
    return book, told


def collapsed(records: DataFrame) -> DataFrame:
    """One row for each set of copies and each single record: keep_id, the keys, how many copies."""
    rows = build(records)[0].rows()
    return rows.select(F.col("first").alias("keep_id"), "query_key", F.col("variant_key").alias("normalized"), F.col("n").alias("n_copies"))


def copies(records: DataFrame) -> DataFrame:
    """(keep_id, dup_id): every record but the first of each set of copies, beside the first.

    Keys with at least HOT_LEAST records and a HOT_MOST-th of all, so HOT_MOST keys at most, are joined by broadcast: a set that
    holds a third of the table never meets in one task. All others meet in the ledger's buckets, whose rows stay where they are.
    """
    book, told = build(records)
    twice = book.rows().filter(F.col("n") > 1).withColumnRenamed("first", "keep_id")
    hot_from = max(HOT_LEAST, told.count() // HOT_MOST + 1)
    hot = twice.filter(F.col("n") >= hot_from).drop("n")
    slim = told.drop("batch")
    out = lambda df: df.filter(F.col("rec_id") != F.col("keep_id")).select("keep_id", F.col("rec_id").alias("dup_id"))
    rest = slim.join(F.broadcast(hot), _KEYS, "left_anti").join(twice.filter(F.col("n") < hot_from).drop("n"), _KEYS)
    return out(slim.join(F.broadcast(hot), _KEYS)).unionByName(out(rest))

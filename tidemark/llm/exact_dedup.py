"""Exact deduplication by a keyed stream.

``Deduplicator`` keeps a home folder: a table of fingerprints, the stream's checkpoint, and what the state gave out. Each
call of ``add`` appends the fingerprints of new documents (stable id, digest, length, content locator) and lets the stream
take them in. Its state, kept on disk by the RocksDB store and never expired, holds for each digest the row that stays with
its locator, the first row ever seen (the witness) with its locator, and the count; a later call is judged against all
earlier ones. Every hit is checked on its full bytes: the witness is fetched by its locator, and each new row with its digest
is compared with it. Where a digest covers different texts, its rows are told apart by the text itself.

A locator is the file of the content and the number of the row in it. Documents that do not come from Parquet files are
written to the home folder first.

Only DataFrame functions run on executors. Copies are pre-aggregated before each shuffle, so a group that holds a third
of all rows costs one row a task.

Defined cases: a null text is an empty one; all empty texts are one group; repeated rows count singly and share the
verdict (``keep_first`` lets one of them stay); a row without a doc_id takes part like any other and stays only where its
text is longer than all others or none of them has an id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WS, Scratch, checked, located, save, shared_dir, stay, table, text_or_empty

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Each of many small stores would reserve some megabytes of disk for its log ahead of need.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
PRINTS = "doc_id long, text_sha256 string, digest string, n_chars long, call long, file string, at long"


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, WS + "+", "")


def text_digest() -> Column:
    return F.sha2(normalised(text_or_empty()).cast("binary"), 256)


def best_row() -> Column:
    """Most code points, then the smallest doc_id, rows without one last."""
    return F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg_id"), "file", "at"))


class Deduplicator:
    """Documents of any number of calls, judged against each other. ``home`` must be a folder that driver and executors
    share; a new object on the same folder goes on where the last one stopped. ``digest_hex`` shortens the digest that keys
    the state (tests force collisions by it)."""

    def __init__(self, spark: SparkSession, home: str | None = None, digest_hex: int = 64, files_per_trigger: int | None = None):
        self.spark, self.digest_hex, self.files_per_trigger = spark, digest_hex, files_per_trigger
        self.home = home or shared_dir(spark, "dedup")

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def prints(self) -> DataFrame:
        """Fingerprints of all rows so far."""
        if not self.exists("prints"):
            return self.spark.createDataFrame([], PRINTS)
        return self.spark.read.schema(PRINTS).parquet(f"{self.home}/prints")

    def state(self) -> DataFrame:
        """(digest, best, witness, n): what the stream's state last gave out for each digest."""
        changes = self.spark.read.option("basePath", f"{self.home}/state").parquet(f"{self.home}/state")
        newest = F.max_by(F.struct("best", "witness", "n"), "batch").alias("x")
        return changes.groupBy("digest").agg(newest).select("digest", "x.*")

    def clashes(self) -> DataFrame:
        """(digest) of different texts."""
        if not self.exists("clashes"):
            return self.spark.createDataFrame([], "digest string")
        return self.spark.read.schema("digest string").parquet(f"{self.home}/clashes").distinct()

    def add(self, docs: DataFrame) -> int:
        """Take in the rows of ``docs``; returns the number of the call, which ``verdicts`` knows them by."""
        last = self.prints().agg(F.max("call")).first()[0]
        call = 0 if last is None else last + 1
        docs = located(docs)
        digest = F.substring("text_sha256", 1, self.digest_hex)
        prints = docs.select("doc_id", text_digest().alias("text_sha256"), F.length(text_or_empty()).cast("long").alias("n_chars"), F.lit(call).cast("long").alias("call"), "file", "at")
        prints.withColumn("digest", digest).select(*[x.split()[0] for x in PRINTS.split(", ")]).write.mode("append").parquet(f"{self.home}/prints")
        self.advance()
        self.compare(docs, call)
        return call

    def advance(self) -> None:
        """Run the stream until it has taken in all fingerprints. Each micro-batch writes the keys that it changed, under
        its own number, so one that is run again after a failure overwrites itself."""
        before = {k: self.spark.conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            self.spark.conf.set(k, v)
        try:
            reader = self.spark.readStream.schema(PRINTS)
            if self.files_per_trigger:
                reader = reader.option("maxFilesPerTrigger", self.files_per_trigger)
            # The witness is of the earliest call, so no later one replaces it.
            witness = F.min(F.struct("call", "file", "at")).alias("witness")
            state = reader.parquet(f"{self.home}/prints").groupBy("digest").agg(best_row().alias("best"), witness, F.count(F.lit(1)).alias("n"))

            def changed(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{self.home}/state/batch={number}")

            query = state.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{self.home}/log").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

    def fetch(self, wanted: DataFrame, docs: DataFrame, call: int) -> DataFrame:
        """(digest, known) of the locators of ``wanted`` (digest, call, file, at): the normalised text there. Files of earlier
        calls are opened only where a locator names them."""
        text = normalised(text_or_empty()).alias("known")
        found = docs.join(checked(save(wanted.where(F.col("call") == call), "dedup-wanted")), ["file", "at"]).select("digest", text)
        earlier = save(wanted.where(F.col("call") < call), "dedup-earlier")
        files = [r["file"] for r in earlier.select("file").distinct().collect()]  # one name for each file of content
        if files:
            rows = self.spark.read.schema("text string").parquet(*files).select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
            found = found.unionByName(rows.join(checked(earlier), ["file", "at"]).select("digest", text))
        return found

    def compare(self, docs: DataFrame, call: int) -> None:
        """Check the full bytes of every hit of this call; digests of different texts are put on record."""
        with Scratch():
            mine = self.prints().where(F.col("call") == call).select("digest").distinct()
            hits = self.state().where("n > 1").join(mine, "digest", "left_semi")
            known = save(self.fetch(hits.select("digest", "witness.*"), docs, call), "dedup-witnesses")
            norm = normalised(text_or_empty()).alias("norm")
            rows = docs.select(norm).withColumn("digest", F.substring(F.sha2(F.col("norm").cast("binary"), 256), 1, self.digest_hex))
            differ = rows.join(checked(known), "digest").where("norm <> known").select("digest").distinct()
            differ.write.mode("append").parquet(f"{self.home}/clashes")

    def contents(self, digests: DataFrame) -> DataFrame:
        """Fingerprints with the normalised text of all rows of these digests, read by their locators."""
        rows = save(self.prints().join(checked(digests), "digest", "left_semi"), "dedup-apart")
        files = [r["file"] for r in rows.select("file").distinct().collect()]  # one name for each file of content
        texts = self.spark.read.schema("text string").parquet(*files).select(normalised(text_or_empty()).alias("norm"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return rows.join(texts, ["file", "at"])

    def verdicts(self, call: int | None = None) -> DataFrame:
        """One row for each row taken in (by this call, or by all): doc_id, keep_id, group_size, kept, text_sha256, locator of
        the row that stays."""
        prints = self.prints()
        rows = prints if call is None else prints.where(F.col("call") == call)
        clashes = save(self.clashes(), "dedup-clashes")
        apart = not clashes.isEmpty()
        hits = self.state().where("n > 1")
        groups = hits.join(checked(clashes), "digest", "left_anti") if apart else hits
        groups = checked(save(groups.select("digest", "best", F.col("n").alias("size")), "dedup-groups"))
        plain = rows.join(checked(clashes), "digest", "left_anti") if apart else rows
        result = self.judged(plain.join(groups, "digest", "left"))
        if apart:  # one digest, several texts: their rows are told apart by the text itself
            split = self.contents(clashes)
            own = split.groupBy("norm").agg(best_row().alias("best"), F.count(F.lit(1)).alias("size"))
            named = split if call is None else split.where(F.col("call") == call)
            result = result.unionByName(self.judged(named.join(own, "norm")))
        return result

    @staticmethod
    def judged(rows: DataFrame) -> DataFrame:
        alone = F.col("size").isNull()
        keep_id = F.when(alone, F.col("doc_id")).otherwise(-F.col("best.neg_id"))
        kept = alone | (F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_chars") == F.col("best.n_chars")))
        place = F.when(alone, F.struct("file", "at")).otherwise(F.struct(F.col("best.file"), F.col("best.at")))
        return rows.select(
            "doc_id", keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), "text_sha256",
            F.concat_ws("#", place["file"], place["at"]).alias("locator"),
        )


def exact_groups(docs: DataFrame, digest_hex: int = 64, files_per_trigger: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, locator of the row that stays."""
    stream = Deduplicator(docs.sparkSession, digest_hex=digest_hex, files_per_trigger=files_per_trigger)
    stream.add(docs)
    return stream.verdicts()


def keep_first(docs: DataFrame, digest_hex: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each group of equal texts."""
    stream = Deduplicator(docs.sparkSession, digest_hex=digest_hex)
    stream.add(docs)
    clashes = save(stream.clashes(), "dedup-clashes")
    digest = F.substring(text_digest(), 1, digest_hex)
    if clashes.isEmpty():
        prints, key = stream.prints().withColumn("key", F.col("digest")), digest
        groups = stream.state().where("n > 1").withColumnRenamed("digest", "key")
    else:  # a digest does not name a text: the whole text does
        key = normalised(text_or_empty())
        prints = stream.contents(stream.prints().select("digest").distinct()).withColumn("key", F.col("norm"))
        groups = prints.groupBy("key").agg(best_row().alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    verdicts = groups.select("key", F.lit(True).alias("keep"), (-F.col("best.neg_id")).alias("doc_id"), F.col("best.n_chars").alias("n_chars"))
    verdicts = save(verdicts, "dedup-verdicts")
    best = checked(verdicts.select("key", F.col("doc_id").alias("best_id"), F.col("n_chars").alias("best_chars")))
    same = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("n_chars") == F.col("best_chars"))
    twins = prints.join(best, "key").where(same).groupBy("key").count().where("count > 1").select("key")
    return stay(docs, key, verdicts, save(twins, "dedup-twins"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(n_chars) OVER w AS most, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AND n_chars = most AS kept, sha256(norm) AS text_sha256 FROM g
"""

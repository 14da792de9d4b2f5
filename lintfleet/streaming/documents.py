"""Document change feeds as streams.

Each micro-batch writes its own folder, named by batch id and overwritten when the batch is run again, so a
restarted query neither loses nor doubles rows. Readers pick the latest version; nothing is kept on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintfleet.plans import facts as FX
from lintfleet.plans import lint_rules as L
from lintfleet.plans.statements import split_statements, statement_key
from lintfleet.session import new_path
from lintfleet.streaming.folders import Folder, Folders

BATCH = "batch"


def read_stream(spark: SparkSession, folder: str, files: str = "*", max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; `files` is a glob on their names."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def latest_versions(feed: DataFrame) -> DataFrame:
    """The newest state of each document, whatever order changes arrive in.

    Works on a stream (the state per document is one row) and on a table.
    """
    # equal versions: the change that arrived last, then a fixed order, so that the result does not depend on the plan
    order = [c for c in ("version", "at", "op", "content") if c in feed.columns]
    newest = F.max_by(F.struct("op", "content", "version"), F.struct(*order)).alias("d")
    return feed.groupBy("doc_id").agg(newest).select("doc_id", "d.version", "d.op", "d.content")


def open_documents(versions: DataFrame) -> DataFrame:
    """Documents that are still open: latest row over all written batches, closed ones gone."""
    return latest_versions(versions).filter(F.col("op") != "close")


def without_duplicates(feed: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each change once, when its copies arrive within the allowed lateness."""
    return feed.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["doc_id", "version"])


def run(df: DataFrame, name: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over all that is available now, one batch after the other, and waits for it."""
    query: StreamingQuery = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", new_path(df.sparkSession, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


def collected(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream into a folder of the shared scratch space and reads it back."""
    path = new_path(df.sparkSession, name)
    run(df, name, to_folder(path), mode)
    return df.sparkSession.read.parquet(path)


class IncrementalLint:
    """Lints changed documents only, and each distinct statement text only once.

    Findings of statement-level rules depend on the text alone, so they are kept under the text's hash, in folders by
    the first digits of the hash. A batch analyses the texts not seen before and joins its statements with what is
    known; it reads only the folders its own hashes fall into.

    Every change leaves a row in `versions`, closes and empty texts included. The newest version over all batches
    decides which findings count, so closed and emptied documents have none, late versions change nothing, and of a
    version delivered again the last delivery counts.

    A batch becomes visible as a whole. Folders of many batches are merged into one; versions that a newer one replaced
    and their findings go then. Scratch tables of a batch are gone with the next one.
    """

    KNOWN = "stmt_key string, found array<struct<ord:int,rule:string,message:string>>, batch int, slot string"

    def __init__(self, spark: SparkSession, root: str, rules: list[str], digits: int = 1, fan: int = 8):
        """`digits` of the hash name a folder: more of them for a long history with small batches. `fan` folders are merged."""
        self.spark, self.rules, self.digits = spark, rules, digits
        stateful = [r.name for r in L.RULES.values() if r.name in rules and (r.needs or r.build)]
        if stateful:
            raise ValueError(f"rules that need other statements cannot be cached: {stateful}")
        tables = {"known": self.KNOWN, "versions": None, "findings": None, "statements": None, "fresh": None}
        self.store = Folders(spark, root, tables, {"known": ["slot"]}, fan)

    def _slot(self) -> Column:
        return F.substring("stmt_key", 1, self.digits).alias("slot")

    def _scratch(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Written, so that all who read it see the same rows; never published."""
        return self.store.read(name, [self.store.write(name, df, batch_id)])

    def _newest(self, entries: list[Folder]) -> DataFrame:
        """Per document the newest version and the batch that delivered it last."""
        versions = self.store.read("versions", entries)
        return versions.groupBy("doc_id").agg(F.max(F.struct("version", BATCH)).alias("d")).select("doc_id", "d.*")

    def _current(self, findings: DataFrame, entries: list[Folder]) -> DataFrame:
        return findings.join(self._newest(entries), ["doc_id", "version", BATCH], "left_semi").select(findings.columns)

    def _analysed(self, fresh: DataFrame) -> DataFrame:
        keyed = fresh.select(F.col("stmt_key").alias("script_id"), F.lit(1).alias("pos"), "text")
        hits = L.lint(FX.extract(keyed, arrays=L.arrays_of(self.rules)), self.rules).groupBy(F.col("script_id").alias("stmt_key"))
        hits = hits.agg(F.sort_array(F.collect_list(F.struct("ord", "rule", "message"))).alias("found"))
        return fresh.select("stmt_key").join(hits, "stmt_key", "left")

    def process(self, changes: DataFrame, batch_id: int) -> None:
        earlier, batch = self.store.before(batch_id), F.lit(batch_id).alias(BATCH)
        newest = latest_versions(changes).persist()
        added = [self.store.write("versions", newest.select("doc_id", "version", "op", batch), batch_id)]
        still_open = newest.filter(F.col("op") != "close").select("doc_id", "version", "content")
        statements = split_statements(still_open, ["doc_id", "version"], "content")
        statements = self._scratch(statements.select("doc_id", "version", "stmt_no", "text", statement_key(F.col("text")).alias("stmt_key")), "statements", batch_id)
        newest.unpersist()

        slots = [r.slot for r in statements.select(self._slot()).distinct().collect()]  # at most 16 ** digits
        texts = statements.groupBy("stmt_key").agg(F.first("text").alias("text"))
        known = self.store.read("known", earlier).filter(F.col("slot").isin(slots))
        fresh = self._scratch(texts.join(known, "stmt_key", "left_anti"), "fresh", batch_id)
        if not fresh.isEmpty():
            added.append(self.store.write("known", self._analysed(fresh).select("stmt_key", "found", batch, self._slot()), batch_id))

        known = self.store.read("known", earlier + added).filter(F.col("slot").isin(slots) & (F.size("found") > 0))
        found = statements.select("doc_id", "version", "stmt_no", "stmt_key").join(known.select("stmt_key", "found"), "stmt_key")
        added.append(self.store.write("findings", found.select("doc_id", "version", "stmt_no", F.inline("found"), batch), batch_id))
        last = {"versions": lambda rows, _: rows.groupBy("doc_id").agg(F.max(F.struct("version", BATCH, "op")).alias("d")).select("doc_id", "d.version", "d.op", f"d.{BATCH}"),
                "findings": self._current}
        self.store.publish(batch_id, added, last)

    def findings(self) -> DataFrame:
        """Findings of each document's newest version."""
        entries = self.store.snapshot()
        return self._current(self.store.read("findings", entries), entries).drop(BATCH)

"""Tables that batches add to: parquet folders under one manifest, merged as they become many.

A batch writes its folders first and then publishes them with a new manifest, a small file put in place by one rename.
Readers see the folders of one manifest, so a crash before the rename leaves nothing visible, and a batch that runs
again takes the place of its former self. Where `fan` folders of one table were merged equally often, a later publication
carries one folder in their place; so there are at most `fan - 1` folders for each power of `fan`, and each row is
rewritten once per power. Folders of the manifest before the newest stay, so that readers of it can finish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

KEPT = 2  # manifests whose folders stay
DIGITS = 12  # of a manifest's number, so that names sort
NAMED = "folder_"  # folders are named like a partition, so that tables with partitions are read from several


@dataclass(frozen=True)
class Folder:
    """A folder of a table with the rows of batches `low` to `high`; `merges` says how often they were rewritten."""

    table: str
    name: str
    low: int
    high: int
    merges: int = 0


class Folders:
    """One writer at a time, any number of readers.

    `schemas` gives the columns of each table (None: as they were written), `partitions` those that name folders inside
    of a folder. What is written and never published is gone with the next publication.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str | None], partitions: dict[str, list[str]] | None = None, fan: int = 8):
        if fan < 2:
            raise ValueError("fan has to be 2 or more")
        self.spark, self.root, self.schemas, self.partitions, self.fan = spark, root, schemas, partitions or {}, fan
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------------ files

    def _children(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path))

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _manifests(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._children("manifest") if n.endswith(".json"))

    def _entries(self, number: int) -> list[Folder]:
        """Read by the file system: a batch looks into several manifests, and each would be a job of its own."""
        source = self._fs.open(self._path(f"{self.root}/manifest/{number:0{DIGITS}}.json"))
        try:
            lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").splitlines()
        finally:
            source.close()
        return [Folder(**json.loads(line)) for line in lines]

    # ------------------------------------------------------------------ reading

    def snapshot(self) -> list[Folder]:
        """What the newest manifest lists. Tables that are read together are read from one snapshot."""
        numbers = self._manifests()
        return self._entries(numbers[-1]) if numbers else []

    def read(self, table: str, entries: Iterable[Folder] | None = None) -> DataFrame:
        """Rows of a table, of these folders or of the newest snapshot."""
        names = [e.name for e in (self.snapshot() if entries is None else entries) if e.table == table]
        schema = self.schemas[table]
        if not names:
            if schema is None:
                raise ValueError(f"nothing is published in {self.root}/{table}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/{n}" for n in names]).drop(NAMED)

    def _others(self, batch: int) -> list[Folder]:
        entries = self.snapshot()
        merged = [e for e in entries if e.low <= batch <= e.high and e.merges]
        if merged:
            raise ValueError(f"batch {batch} is merged into {merged[0].table}/{merged[0].name}")
        return [e for e in entries if e.high != batch]

    def before(self, batch: int) -> list[Folder]:
        """The folders of earlier batches. A batch that was merged with others can't be run again."""
        return [e for e in self._others(batch) if e.high < batch]

    # ------------------------------------------------------------------ writing

    def write(self, table: str, df: DataFrame, low: int, high: int | None = None, merges: int = 0) -> Folder:
        """Writes a folder that nobody sees before it is published."""
        folder = Folder(table, f"{NAMED}={low}-{low if high is None else high}-{uuid.uuid4().hex}", low, low if high is None else high, merges)
        df.write.partitionBy(*self.partitions.get(table, [])).parquet(f"{self.root}/{table}/{folder.name}")
        return folder

    def publish(self, batch: int, added: list[Folder], merge: dict[str, Callable[[DataFrame, list[Folder]], DataFrame]] | None = None) -> list[Folder]:
        """Makes a batch's folders visible, all at once, in place of what the batch published before.

        `merge` says by table what becomes of the rows of folders that are merged, given all folders of earlier batches;
        a table without one is merged as it is. The newest batch is never merged, since it may run again.
        """
        entries = self._others(batch) + added
        for table in self.schemas:
            for level in range(max((e.merges for e in entries), default=0) + 1):
                alike = [e for e in entries if e.table == table and e.merges == level and e.high < batch]
                if len(alike) < self.fan:
                    continue
                rows = self.read(table, alike)
                if merge and table in merge:
                    rows = merge[table](rows, [e for e in entries if e.high < batch])
                # files of the advised size, however many rows one folder name has
                rows = rows.hint("rebalance", *self.partitions.get(table, []))
                one = self.write(table, rows, min(e.low for e in alike), max(e.high for e in alike), level + 1)
                entries = [e for e in entries if e not in alike] + [one]
        self._replace(entries)
        return entries

    def _replace(self, entries: list[Folder]) -> None:
        numbers = self._manifests()
        number = numbers[-1] + 1 if numbers else 0
        draft, final = (self._path(f"{self.root}/manifest/{n}") for n in (f"draft-{uuid.uuid4().hex}", f"{number:0{DIGITS}}.json"))
        out = self._fs.create(draft)
        out.write(bytearray("\n".join(json.dumps(asdict(e)) for e in entries).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"manifest {number} is there already: {self.root} has another writer")
        self._clean(entries)

    def _clean(self, entries: list[Folder]) -> None:
        """Drops folders that no kept manifest lists, those of a writer that crashed among them, and older manifests."""
        numbers = self._manifests()
        for number in numbers[:-KEPT]:
            self._delete(f"manifest/{number:0{DIGITS}}.json")
        for name in self._children("manifest"):
            if name.startswith("draft-"):
                self._delete(f"manifest/{name}")
        listed = {(e.table, e.name) for n in numbers[-KEPT:-1] for e in self._entries(n)} | {(e.table, e.name) for e in entries}
        for table in self.schemas:
            for name in self._children(table):
                if (table, name) not in listed:
                    self._delete(f"{table}/{name}")

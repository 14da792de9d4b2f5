"""Facts by content: a table shared by runs, in which each statement text is analysed once.

Facts depend on a statement's text alone, so they are kept under its hash. A run compares its distinct hashes with those
of the table, analyses the texts that are missing, and joins the facts to its statements. Only hashes are compared: the
texts that are known already are neither shuffled to be compared nor read by any pattern.
"""

from __future__ import annotations

import hashlib
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet.plans import facts as FX
from lintfleet.plans import tokens as T
from lintfleet.plans.statements import statement_key
from lintfleet.session import materialize
from lintfleet.streaming.folders import Folders


class KnownFacts:
    """One writing run at a time. Facts of another version of the analysis lie in a folder of their own.

    What `extract` returns reads the table's folders; they stay until the second publication after it.
    """

    def __init__(self, spark: SparkSession, root: str, digits: int = 1, fan: int = 8):
        """Folders inside are named by `digits` of the hash; `fan` publications are merged into one."""
        self.digits = digits
        self.store = Folders(spark, f"{root}/{self.version()}", {"facts": None, "fresh": None}, {"facts": ["slot"]}, fan)

    @staticmethod
    def version() -> str:
        code = "".join(inspect.getsource(m) for m in (FX, T))
        return hashlib.sha256(code.encode()).hexdigest()[:16]

    def extract(self, statements: DataFrame, text: str = "text") -> DataFrame:
        """`statements` with all columns of `facts.extract`. A null text has facts like an empty one; an empty table has none."""
        keyed = statements.withColumn(text, F.coalesce(text, F.lit(""))).withColumn("stmt_key", statement_key(F.col(text)))
        keyed = materialize(keyed, "statements")
        entries = self.store.snapshot()
        batch = 1 + max((e.high for e in entries), default=-1)
        fresh = keyed.select("stmt_key").distinct()
        if entries:
            fresh = fresh.join(self.store.read("facts", entries).select("stmt_key"), "stmt_key", "left_anti")
        fresh = self.store.read("fresh", [self.store.write("fresh", fresh, batch)])
        if not entries or not fresh.isEmpty():
            texts = keyed.select("stmt_key", text).join(fresh, "stmt_key", "left_semi").groupBy("stmt_key").agg(F.first(text).alias(text))
            found = FX.extract(texts, text).drop(text).withColumn("slot", F.substring("stmt_key", 1, self.digits))
            # written in one go, and visible only when whole
            entries = self.store.publish(batch, [self.store.write("facts", found, batch)])
        facts = self.store.read("facts", entries).drop("slot")
        return keyed.join(facts, "stmt_key").drop("stmt_key")

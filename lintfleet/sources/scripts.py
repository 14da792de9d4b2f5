"""Script sources and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintfleet.sources.globs import globs_to_regex

# File extensions taken for scripts.
EXTENSIONS = ["sql", "pg"]


def is_script(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin(EXTENSIONS)


def keep_scripts(df: DataFrame, path: str = "path") -> DataFrame:
    """I01 on a table of files: only paths with a script extension (lower case) stay."""
    return df.filter(is_script(F.col(path)))


def read_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Scripts below the given folders as (script_id, path, content). Other files are not read."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{sql,pg}").text(roots, wholetext=True)
    path = F.col("_metadata.file_path")
    rows = texts.select(path.alias("path"), F.col("value").alias("content"))
    return rows.select(F.xxhash64("path").alias("script_id"), "path", "content")


def path_filter(path: Column, include: list[str], ignore: list[str], vcs_ignore: list[str] | None = None) -> Column:
    """Included (or no include list), and neither ignored nor below an ignored folder of the version control."""
    included = path.rlike(globs_to_regex(include)) if include else F.lit(True)
    ignored = path.rlike(globs_to_regex(ignore)) if ignore else F.lit(False)
    parents = [g.rstrip("/") for g in vcs_ignore or []]
    hidden = path.rlike(globs_to_regex([p for g in parents for p in (g, f"{g}/**")])) if parents else F.lit(False)
    return included & ~ignored & ~hidden


def migration(path: Column) -> Column:
    """struct(sequence, name) from `<digits>_<name>.sql`, of the file or else its folder; null when neither fits.

    Leading zeros go first, so a number of zeros only is no number.
    """
    name_of_file = F.regexp_extract(path, r"([^/]+)$", 1)
    name_of_folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)

    def parse(name: Column) -> Column:
        digits = F.regexp_extract(name, r"^0*([0-9]+)_", 1)
        number = F.when(~name.rlike(r"^0+_") & (digits != ""), digits).try_cast("decimal(20,0)")
        number = F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)
        rest = F.regexp_replace(F.regexp_replace(name, r"^[0-9]+_", ""), r"\.sql$", "")
        return F.when(number.isNotNull(), F.struct(number.alias("sequence"), rest.alias("name")))

    return F.coalesce(parse(name_of_file), parse(name_of_folder))


def after_cutoff(df: DataFrame, after: int, path: str = "path") -> DataFrame:
    """Drops migrations whose number is at most `after`; other scripts stay."""
    return df.filter(F.coalesce(migration(F.col(path))["sequence"] > after, F.lit(True)))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of added, removed and changed scripts between two corpus snapshots.

    Contents are compared by hash, so the full outer join moves paths and hashes only.
    """
    before = old.select("path", F.sha2("content", 256).alias("old_hash"))
    after = new.select("path", F.sha2("content", 256).alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
    )
    return before.join(after, "path", "full_outer").select("path", status.alias("status")).filter("status is not null")


def changed_scripts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scripts of the new snapshot that are to be checked: added or changed ones."""
    todo = changes(old, new).filter(F.col("status") != "removed").select("path")
    return new.join(todo, "path", "left_semi")

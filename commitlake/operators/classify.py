"""Language and test classification of paths, learned language tables and renames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commitlake.functions.paths import extension, file_name, glob_match, path_key

OTHER, UNCOUNTED = "Other", ""
#: Folder names of test code in any case; of specifications, for the extensions beside them; name patterns with the
#: extensions they hold for (fixed values).
TEST_DIRS = ("test", "tests", "__tests__", "testdata")
SPEC_DIRS = ("spec", "specs")
SPEC_EXTENSIONS = ("rb", "js", "jsx", "ts", "tsx", "mjs", "cjs", "coffee")
CAPITAL_DIR = r"^\w+Tests?$"
TEST_NAMES = (
    (r"_test\.go$", ()),
    (r"^test_.*\.py$", ()),
    (r"_test\.py$", ()),
    (r"^conftest\.py$", ()),
    (r"\.(test|spec)\.[^.]+$", ("js", "jsx", "ts", "tsx", "mjs", "cjs")),
    (r"Tests?\.[^.]+$", ("java", "kt", "cs", "swift")),
    (r"_(spec|test)\.rb$", ()),
    (r"_test\.dart$", ()),
    (r"_test\.exs$", ()),
)


@dataclass
class TestRules:
    """Which paths are tests: exclude before include before the built-in rules, which ``replace`` leaves out."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    replace: bool = False

    def is_test(self, path: Column) -> Column:
        """False for NULL; a backslash separates folders as a slash does."""
        norm = F.replace(path, F.lit("\\"), F.lit("/"))
        own = F.lit(False) if self.replace else builtin_is_test(norm)
        return F.when(glob_match(norm, self.exclude), False).when(glob_match(norm, self.include), True).otherwise(F.coalesce(own, F.lit(False)))


def builtin_is_test(path: Column) -> Column:
    """The built-in rules: folders, specification folders, capitalised folders, file names."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = file_name(path)
    ext = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    hit = F.exists(dirs, lambda d: F.lower(d).isin(*TEST_DIRS) | d.rlike(CAPITAL_DIR))
    hit = hit | (ext.isin(*SPEC_EXTENSIONS) & F.exists(dirs, lambda d: F.lower(d).isin(*SPEC_DIRS)))
    for pattern, extensions in TEST_NAMES:
        hit = hit | (name.rlike(pattern) & (ext.isin(*extensions) if extensions else F.lit(True)))
    return hit


def parse_extension_table(lines: DataFrame, text: str, order: str) -> DataFrame:
    """key, language of lines ``<extension> <language>``; a later line of a key wins; lines of one word are left out."""
    parts = F.split(F.trim(F.col(text)), r"\s+", 2)
    rows = lines.where(F.size(parts) == 2).select(F.lower(parts[0]).alias("key"), F.trim(parts[1]).alias("language"), F.col(order).alias("at"))
    return rows.groupBy("key").agg(F.max_by("language", "at").alias("language"))


def with_language(df: DataFrame, path: str, table: DataFrame) -> DataFrame:
    """``df`` with ``language``: the table's entry of the path, else of its extension, else Other.

    ``table``: key, language, one row for each key; keys of paths start with a slash. Spark broadcasts it where it
    is below the session's limit and shuffles it otherwise. NULL paths are Other.
    """
    by_path = table.select(F.col("key").alias("l_path_key"), F.col("language").alias("l_by_path"))
    by_ext = table.select(F.col("key").alias("l_ext_key"), F.col("language").alias("l_by_ext"))
    joined = df.join(by_path, path_key(F.col(path)) == F.col("l_path_key"), "left").join(by_ext, extension(F.col(path)) == F.col("l_ext_key"), "left")
    return joined.select(*df.columns, F.coalesce("l_by_path", "l_by_ext", F.lit(OTHER)).alias("language"))


def learn_language_table(files: DataFrame, base: DataFrame) -> DataFrame:
    """key, language learned from ``files`` (path, language): a language for each extension, and every odd path.

    An extension takes its language in ``base`` (key, language) if any file has it, else that of most files, ties by
    name. Files without extension, or of another language than their extension's, are entries of their own.
    """
    known = files.withColumn("key", extension(F.col("path")))
    counted = known.where(F.col("key").isNotNull()).groupBy("key", "language").agg(F.count("*").alias("n"))
    usual = base.select("key", F.col("language").alias("base_language"))
    ranked = counted.join(usual, "key", "left").withColumn("is_base", F.coalesce(F.col("language") == F.col("base_language"), F.lit(False)))
    first = Window.partitionBy("key").orderBy(F.desc("is_base"), F.desc("n"), "language")
    learned = ranked.withColumn("r", F.row_number().over(first)).where("r = 1").select("key", "language")
    odd = known.join(learned.withColumnRenamed("language", "usual_language"), "key", "left").where(F.col("usual_language").isNull() | (F.col("language") != F.col("usual_language")))
    return learned.unionByName(odd.groupBy(path_key(F.col("path")).alias("key")).agg(F.max("language").alias("language")))


def merge_language_tables(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """key, language of both tables; the overlay wins."""
    both = base.select("key", F.col("language").alias("b")).join(overlay.select("key", F.col("language").alias("o")), "key", "full")
    return both.select("key", F.coalesce("o", "b").alias("language"))


def rename_plan(renames: DataFrame, table: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(learned entries key, language; renames that change language: seq).

    ``renames``: seq (0 is the newest), old, new, old_language, new_language (NULL where not counted). A name that is
    neither in ``present`` (path) nor in ``table`` learns the first language, newest first and old name before new,
    that differs from what the table gives it.
    """
    sides = F.explode(F.array(F.struct((F.col("seq") * 2).alias("at"), F.col("old").alias("name"), F.col("old_language").alias("seen")), F.struct((F.col("seq") * 2 + 1).alias("at"), F.col("new").alias("name"), F.col("new_language").alias("seen"))))
    named = with_language(renames.select(sides.alias("x")).select("x.*"), "name", table)
    free = named.join(present.select(F.col("path").alias("name")), "name", "left_anti").withColumn("key", path_key(F.col("name"))).join(table.select("key"), "key", "left_anti")
    learned = free.where((F.col("seen") != "") & (F.col("seen") != F.col("language"))).groupBy("key").agg(F.min_by("seen", "at").alias("language"))
    after = merge_language_tables(table, learned)
    both = with_language(renames, "old", after).withColumnRenamed("language", "old_by_table")
    both = with_language(both, "new", after).withColumnRenamed("language", "new_by_table")
    counted = F.coalesce(F.nullif("old_language", F.lit("")), F.nullif("new_language", F.lit(""))).isNotNull()
    differs = ~F.col("old_language").eqNullSafe(F.col("new_language")) | (F.col("old_by_table") != F.col("new_by_table"))
    return learned, both.where(counted & differs).select("seq")


def adjust_rows(file_rows: DataFrame, drops: DataFrame, added: DataFrame) -> DataFrame:
    """``file_rows`` (pos, section, path, code, comment, blank) without the (pos, path) in ``drops``, plus ``added``,
    summed by pos, section and path."""
    kept = file_rows.join(drops.select("pos", "path").distinct(), ["pos", "path"], "left_anti")
    columns = ["pos", "section", "path", "code", "comment", "blank"]
    return kept.select(*columns).unionByName(added.select(*columns)).groupBy("pos", "section", "path").agg(*(F.sum(c).alias(c) for c in columns[3:]))

"""Sources: source trees, requirements, JSON lines, and the keys hidden in paths and addresses."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where requirements are looked for, in order of precedence, by kind of data set.
REQUIREMENTS = {
    "search": ("requirements.txt", "test_requirements.txt", "dev_requirements.txt", "requirements-dev.txt", "requirements/base.txt", "requirements/requirements.txt"),
    "completion": (
        "requirements.txt", "requirements-dev.txt", "requirements-test.txt", "test_requirements.txt", "dev-requirements.txt", "requirements/base.txt", "requirements/dev.txt", "requirements/test.txt",
    ),
}


def numbered_files(files: DataFrame) -> DataFrame:
    """files(repo, path, ...) with file_ord, the place of the path in its repository from 0: paths alone are put in order, contents stay
    where they are."""
    order = files.select("repo", "path").withColumn("file_ord", (F.row_number().over(Window.partitionBy("repo").orderBy("path")) - 1).cast("int"))
    return files.join(order, ["repo", "path"])


def source_files(spark: SparkSession, root: str, repo: str, pattern: str = "*.py") -> DataFrame:
    """files(repo, path, content, file_ord): every matching file below a folder; unreadable bytes become marks of their own."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = "/" + root.split("://", 1)[-1].strip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^\\Q" + base + "\\E", "")
    return numbered_files(raw.select(F.lit(repo).alias("repo"), relative.alias("path"), F.decode("content", "UTF-8").alias("content"))).select("repo", "path", "content", "file_ord")


def folder_name(path: Column) -> Column:
    """The dotted folder of a file; empty at the root."""
    return F.regexp_replace(F.regexp_replace(path, r"/?[^/]*$", ""), "/", ".")


def module_name(path: Column) -> Column:
    """The module a file is: folder.file; a package's own file is its folder, or ``main`` at the root."""
    file = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.py$", "")
    folder = folder_name(path)
    return F.when(file == "__init__", F.when(folder == "", "main").otherwise(folder)).when(folder == "", file).otherwise(F.concat_ws(".", folder, file))


def path_to_module(path: Column) -> Column:
    """A path as a dotted module name: without .py, and without a trailing package file."""
    dotted = F.translate(F.regexp_replace(path, r"\.py$", ""), "/\\", "..")
    return F.regexp_replace(dotted, r"\.__init__$", "")


def example_path_to_module(path: Column) -> Column:
    """The same for completion examples, where test folders of one layout are moved up and package files are cut off."""
    moved = F.when(path.startswith("tme/tests/"), F.regexp_replace(path, "^tme/tests/", "tests/")).otherwise(path)
    return path_to_module(F.regexp_replace(moved, r"/__init__\.py$", ""))


def requirement_lines(spark: SparkSession, path: str, repo: str) -> DataFrame:
    return spark.read.text(path).select(F.lit(repo).alias("repo"), F.col("value").alias("line"))


def requirements(lines: DataFrame) -> DataFrame:
    """(repo, package): import names of the packages that requirement lines name."""
    name = F.trim(F.split(F.trim("line"), r"==|>=|<=|~=").getItem(0))
    kept = lines.where((F.trim("line") != "") & ~F.trim("line").startswith("#"))
    return kept.select("repo", F.translate(name, "-", "_").alias("package")).distinct()


def requirement_file(root: str, kind: str = "search") -> str | None:
    """The repository's requirements file, if one of the usual places has it."""
    return next((str(p) for n in REQUIREMENTS[kind] if (p := Path(root) / n).is_file()), None)


def choose_requirement_file(files: DataFrame, kind: str = "search") -> DataFrame:
    """(repo, path): of many repositories' files(repo, path), the requirements file each uses; a null path, which stands for an empty
    file, where it has none."""
    rank = F.nullif(F.array_position(F.array(*(F.lit(n) for n in REQUIREMENTS[kind])), F.col("path")), F.lit(0))
    return files.select("repo", "path", rank.alias("rank")).groupBy("repo").agg(F.min_by("path", "rank").alias("path"))


def stdlib(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m,) for m in sorted(sys.stdlib_module_names)], "package string")


def categorised_imports(imports: DataFrame, required: DataFrame) -> DataFrame:
    """imports(repo, module) with ``category``: stdlib, installed or local, by the top-level name."""
    std = F.broadcast(stdlib(imports.sparkSession).withColumn("std", F.lit(True)))
    top = imports.withColumn("package", F.split("module", r"\.").getItem(0))
    joined = top.join(std, "package", "left").join(required.withColumn("req", F.lit(True)), ["repo", "package"], "left")
    return joined.withColumn("category", F.when(F.col("std"), "stdlib").when(F.col("req"), "installed").otherwise("local")).drop("std", "req", "package")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def blob_address(url: Column) -> Column:
    """struct(owner, repo, commit, file, first_line, last_line) of a blob address on a code host."""
    parts = F.split(F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^\w+://[^/]+/", ""), "/")
    lines = lambda g: F.nullif(F.regexp_extract(url, r"#L(\d+)(?:-L(\d+))?$", g), F.lit("")).cast("int")
    blob = F.try_element_at(parts, F.lit(3)) == "blob"
    at = lambda i: F.when(blob, F.try_element_at(parts, F.lit(i)))
    return F.struct(
        at(1).alias("owner"), at(2).alias("repo"), at(4).alias("commit"),
        F.when(blob, F.array_join(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), "/")).alias("file"), lines(1).alias("first_line"), lines(2).alias("last_line"),
    )


def repo_key_splits(key: Column) -> Column:
    """array<struct(owner, repo, commit)>: every way to read ``owner-repo-commit`` where owner and repo may hold dashes."""
    parts = F.split(key, "-")
    last = F.size(parts) - 1
    cut = lambda a, n: F.array_join(F.slice(parts, a, n), "-")
    ways = F.when(last >= 2, F.sequence(F.lit(1), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(ways, lambda i: F.struct(cut(F.lit(1), i).alias("owner"), cut(i + 1, last - i).alias("repo"), F.element_at(parts, -1).alias("commit")))


def tables(spark: SparkSession, at: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{at}/{n}.parquet") for n in names}

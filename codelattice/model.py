"""The code graph as two tables, and the identity of its nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ("Repo", "Module", "Class", "Function", "Method", "Field", "GlobalVariable", "Import")
EDGE_TYPES = ("CONTAINS", "HAS_METHOD", "HAS_FIELD", "INHERITS", "USES")

_S = T.StringType()


def _struct(*names: str, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*(T.StructField(n, _S) for n in names), *(T.StructField(n, k) for n, k in kinds.items())])


NODES = _struct(
    "node_id", "label", "repo", "name", "local_name", "class", "signature", "module_name", "code", "description", "member_descriptions", "alias", "module", "dotted_folder_name",
    embedding=T.ArrayType(T.FloatType()), file_ord=T.IntegerType(),
)
EDGES = _struct("src", "dst", "type", "source_association_type", "target_association_type")
#: What the parser gives for a file.
RAW_NODES = _struct("repo", "type", "name", "local_name", "class", "signature", "code", "module_name", "module", "alias", "dotted_folder_name", file_ord=T.IntegerType())
RAW_EDGES = _struct(
    "repo", "type", "source", "target", "source_association_type", "target_association_type", "source_module_name", "target_module_name", "source_signature", "target_signature",
    "source_class", "target_class", file_ord=T.IntegerType(),
)

#: The columns that make up a node's identity, by label.
KEYS = {
    "Repo": ("name",),
    "Module": ("name",),
    "Class": ("name", "signature", "module_name"),
    "Function": ("name", "signature", "module_name"),
    "Method": ("name", "class", "signature", "module_name"),
    "Field": ("name", "class", "module_name"),
    "GlobalVariable": ("name", "module_name"),
    "Import": ("name", "module"),
}


def node_id(label: Column | str = "label", repo: Column | str | None = "repo") -> Column:
    """``Label:key parts`` by label, behind the repo (two repos never share a node); null parts count as empty text."""
    label = F.col(label) if isinstance(label, str) else label
    out = F.lit(None).cast("string")
    for name, keys in KEYS.items():
        parts = F.concat_ws(":", F.lit(name), *(F.coalesce(F.col(k), F.lit("")) for k in keys))
        out = F.when(label == name, parts).otherwise(out)
    if repo is None:
        return out
    return F.when(label == "Repo", out).otherwise(F.concat_ws("/", F.coalesce(F.col(repo) if isinstance(repo, str) else repo, F.lit("")), out))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

"""Results as JSON documents and report views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def _renamed(kind: DataType, names: dict[str, str], of: str) -> str:
    if isinstance(kind, StructType):
        return "struct<" + ",".join(f"`{names.get(f'{of}.{f.name}') or camel(f.name)}`:{_renamed(f.dataType, names, f.name)}" for f in kind) + ">"
    if isinstance(kind, ArrayType):
        return f"array<{_renamed(kind.elementType, names, of)}>"
    return kind.simpleString()


def as_document(df: DataFrame, kind: str, version: str, parameters: dict, *keys: str, names: dict[str, str] | None = None) -> DataFrame:
    """keys and json: one indented document per row, camelCase, with format version, algorithm version, parameters and the row's other columns.

    names: the keys of fields, as `list.field`, whose names in the document differ from their own.
    """
    fields = [F.col(f.name).cast(_renamed(f.dataType, names or {}, f.name)).alias(camel(f.name)) for f in df.schema if f.name not in keys]
    settings = F.struct(*(F.lit(v).alias(camel(k)) for k, v in parameters.items()))
    body = F.struct(F.lit(kind).alias("formatVersion"), F.lit(version).alias("algorithmVersion"), settings.alias("parameters"), *fields)
    return df.select(*keys, F.to_json(body, {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def as_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """One row, json: a document with a list of rows for each of a few small views, in order of their columns."""
    out = None
    for name, view in sections.items():
        one = view.agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(camel(c)) for c in view.columns)))).alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out.select(F.to_json(F.struct(*sections), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def write_documents(documents: DataFrame, path: str) -> None:
    """UTF-8 files without a byte order mark, a document per line: each record can be read on its own."""
    one_line = F.regexp_replace("json", r"\n\s*", "")
    documents.select(one_line.alias("value")).write.mode("error").text(path)


def read_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What write_documents() wrote, as rows."""
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def top_paths(decoded: DataFrame, n: int = 12) -> DataFrame:
    """The report of best paths: text, rank, score, relative_score, segmentation, output."""
    return decoded.filter(F.col("rank") <= n).select("text", "rank", "score", "relative_score", "segmentation", "output")


def competitive(decoded: DataFrame, window: float = 4.0) -> DataFrame:
    """(text, n): how many paths are within `window` of the best."""
    return decoded.groupBy("text").agg(F.count_if(F.col("relative_score") >= -window).alias("n"))


def ranked_edges(edges: DataFrame) -> DataFrame:
    """Edges by start, longest and best first, with their rank at that start."""
    order: list[Column] = [F.desc(F.col("end") - F.col("start")), F.desc("local_score")]
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("text", "start").orderBy(*order, "output", "kind")))

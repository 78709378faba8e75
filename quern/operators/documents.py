"""Search documents: source records of several kinds brought to one schema, with ids and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import search_document_id, search_text

#: Columns of a search document, in order.
COLUMNS = ("search_document_id", "kind", "object_name", "title", "search_text", "source_key", "confidence", "metadata", "content_hash")


def draft(rows: DataFrame, kind: str, name: Column, title: Column, sections: dict[str, Column], source_key: Column, confidence: Column | None = None, metadata: dict[str, Column] | None = None) -> DataFrame:
    """Search documents of one kind. The hash covers what is searched and not the row's other columns."""
    body = search_text({"Title": title, **sections})
    entries = [x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]
    meta = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()) if entries else F.expr("cast(map() as map<string,string>)")
    out = rows.select(
        search_document_id(F.lit(kind), source_key).alias("search_document_id"),
        F.lit(kind).alias("kind"),
        name.cast("string").alias("object_name"),
        title.cast("string").alias("title"),
        body.alias("search_text"),
        source_key.cast("string").alias("source_key"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (confidence if confidence is not None else F.lit(None)).cast("double"))).alias("confidence"),
        meta.alias("metadata"),
    )
    return out.withColumn("content_hash", F.sha2(F.concat_ws("\n", "kind", "search_text"), 256)).select(*COLUMNS)


def table_rows(rows: DataFrame, table: str, key: Column, values: Column) -> DataFrame:
    """A document for each row of a control table; its text is the row's values by name."""
    text = F.array_join(F.transform(F.filter(F.array_sort(F.map_entries(values)), lambda e: F.trim(F.coalesce(e["value"], F.lit(""))) != ""), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    return draft(rows, "table_row", F.lit(table), F.concat_ws(" ", F.lit(table), key), {"Values": text}, F.concat_ws("|", F.lit(table), key), metadata={"table": F.lit(table)})


def fields(rows: DataFrame, table: Column, field: Column, description: Column) -> DataFrame:
    """A document for each field definition."""
    return draft(rows, "master_field", field, F.concat_ws("-", table, field), {"Description": description}, F.concat_ws("|", table, field), metadata={"table": table, "field": field})


def code_units(rows: DataFrame, unit: Column, kind: Column, code: Column, key: Column) -> DataFrame:
    """A document for each code unit; its text is the code's first 2,000 characters, a property of the document's schema."""
    return draft(rows, "code_unit", unit, F.concat_ws(" ", kind, unit), {"Code": F.substring(code, 1, 2000)}, key, metadata={"unit_type": kind})


def corpus(parts: list[DataFrame]) -> DataFrame:
    """All documents of several adapters, one row an id: the one with the smallest content hash."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    rest = [c for c in COLUMNS if c != "search_document_id"]
    first = both.groupBy("search_document_id").agg(F.min_by(F.struct(*rest), "content_hash").alias("r"))
    return first.select("search_document_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def deviations(pairs: DataFrame, key: str, field: str, left: str, right: str) -> DataFrame:
    """(key, field, value, class) of values that one of two string arrays has: only_left, only_right, or case_only where
    the other has it in another case."""
    lowered = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    a, b = F.coalesce(left, F.array().cast("array<string>")), F.coalesce(right, F.array().cast("array<string>"))
    tagged = F.concat(
        F.transform(F.array_except(a, b), lambda v: F.struct(v.alias("value"), F.when(F.array_contains(lowered(F.col(right)), F.lower(v)), "case_only").otherwise("only_left").alias("class"))),
        F.transform(F.filter(F.array_except(b, a), lambda v: ~F.array_contains(lowered(F.col(left)), F.lower(v))), lambda v: F.struct(v.alias("value"), F.lit("only_right").alias("class"))),
    )
    return pairs.select(key, field, F.inline(tagged))

"""Master data and control tables: keys, definitions, entities of fields, relations of rows, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import first_filled

# Rules from field names to entity types, the first that matches counts, with confidence.
FIELD_RULES = (
    (r"^(MANDT|CLIENT)$", "client_id", 0.99),
    (r"^(KUNNR|CUSTKEY|.*CUSTOMER.*)$", "customer", 0.95),
    (r"^(LIFNR|SUPPKEY|.*VENDOR.*)$", "vendor", 0.95),
    (r"^(MATNR|PARTKEY|.*MATERIAL.*)$", "material", 0.95),
    (r"^(VKORG|VTWEG|SPART)$", "sales_area", 0.9),
    (r"^(WERKS|LGORT)$", "plant", 0.9),
    (r"^(NATIONKEY|LAND1)$", "country", 0.8),
    (r".*(STATUS|FLAG)$", "status", 0.6),
    (r".*KEY$", "other_key", 0.5),
)


def record_key(number: Column, field: Column, position: Column, values: Column, listed: list[str], ids: list[str]) -> Column:
    """The canonical key of a master-data record: its row number, field name with position, listed key fields, id fields,
    or else 24 digits of the hash of its values."""
    all_listed = F.concat_ws("|", *(F.concat(F.lit(f"{k}="), F.element_at(values, F.lit(k))) for k in listed))
    complete = F.lit(bool(listed))
    for k in listed:
        complete = complete & F.element_at(values, F.lit(k)).isNotNull()
    by_id = first_filled(values, *ids) if ids else F.lit(None).cast("string")
    hashed = F.substring(F.sha2(F.to_json(F.array_sort(F.map_entries(values))), 256), 1, 24)
    return F.coalesce(F.concat(F.lit("ROW|"), number.cast("string")), F.when(field.isNotNull(), F.concat_ws("|", F.lit("FIELD"), field, position.cast("string"))), F.when(complete, F.concat(F.lit("KEY|"), all_listed)), F.concat(F.lit("ID|"), by_id), F.concat(F.lit("HASH|"), hashed))


def with_definition(rows: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their table's definition where there is one (of several the least by its columns), and whether there is."""
    rest = [c for c in definitions.columns if c not in keys]
    one = definitions.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_d")).select(*keys, "_d.*", F.lit(True).alias("_known")) if rest else definitions.distinct().withColumn("_known", F.lit(True))
    return rows.join(one, keys, "left").withColumn("has_definition", F.coalesce("_known", F.lit(False))).drop("_known")


def field_entity(field: Column) -> Column:
    """(type, confidence) of a field's name; null without a rule."""
    out = None
    upper = F.upper(field)
    for pattern, kind, confidence in FIELD_RULES:
        hit = F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))
        out = F.when(upper.rlike(pattern), hit) if out is None else out.when(upper.rlike(pattern), hit)
    return out


# Entities of a field by its name, element, domain and description together (blob) or its name alone, in the
# order in which they are tried: type, pattern of the blob, pattern of the name, confidence.
ENTITY_RULES = (
    ("material_number", r"\b(MATNR|MATERIAL)\b", r"MATNR", 0.85),
    ("customer_number", r"\b(KUNNR|CUSTOMER|KUNDE)\b", r"KUNNR", 0.85),
    ("vendor_number", r"\b(LIFNR|VENDOR|LIEFERANT)\b", r"LIFNR", 0.85),
    ("technical_system_name", r"\b(RFCDEST|LOGSYS|DESTINATION|SYSID|SERVER|HOST)\b", r"DEST|LOGSYS|RFC", 0.8),
    ("status_value", r"\b(STATUS|STAT|STCD|STATE)\b", r"(STATUS|STAT)$", 0.75),
)
CODES = (r"\b(PARAM|KEY|CODE|KZ|FLAG|IND|TYPE|ART)\b", r"^(KEY|PARAM|VAL|CODE|KZ)")
PARAMETERS = (r"PARAM|KEY", r"PARAM|KEY|VAL")
TEXTS = (r"\b(TEXT|DESCR|BEZEICH|NAME|VTEXT|REMARK|COMMENT)\b", r"(TEXT|DESCR|NAME|BEZ)$")
NUMBERS = ("material_number", "customer_number", "vendor_number")


def kind_of(field: Column) -> Column:
    """(type, confidence) of a field by its description, a struct (name, element, domain, data_type, description, length,
    is_key)."""
    upper = lambda c: F.upper(F.trim(F.coalesce(field[c].cast("string"), F.lit(""))))
    name, element, domain, kind = upper("name"), upper("element"), upper("domain"), upper("data_type")
    blob, length, is_key = F.concat_ws(" ", name, element, domain, upper("description")), F.coalesce(field["length"], F.lit(0)), F.coalesce(field["is_key"], F.lit(False))
    named = lambda patterns: blob.rlike(patterns[0]) | name.rlike(patterns[1])
    answer = lambda kind, confidence: F.struct(F.lit(kind).alias("type"), F.lit(confidence).cast("double").alias("confidence"))
    found = F.when((name == "MANDT") | (element == "MANDT") | (domain == "MANDT") | (kind == "CLNT"), answer("client_id", 0.95))
    for entity, of_blob, of_name, confidence in ENTITY_RULES:
        found = found.when(named((of_blob, of_name)), answer(entity, confidence))
    code = F.when(named(PARAMETERS), F.lit("parameter_or_mapping_value")).otherwise("code_value")
    found = found.when(named(CODES), F.struct(code.alias("type"), F.when(is_key, 0.8).otherwise(0.7).alias("confidence"))).when(named(TEXTS) | ((kind == "CHAR") & (length >= 20)), answer("description_text", 0.7))
    found = found.when(is_key, answer("primary_key_value", 0.9)).when((kind == "CHAR") & (length > 0) & (length <= 10), answer("code_value", 0.55)).otherwise(answer("field_value", 0.4))
    return found


def entity_of(kind: Column, value: Column) -> Column:
    """(type, normalized, confidence) of a field's value by the field's kind_of; null for a blank value. Numbers are
    normalised without leading zeros, texts stay, anything else is in upper case. What a field is depends on no value, so
    its kind is found once a field, not once a value."""
    plain = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    bare = F.regexp_replace(plain, "^0+(?=.)", "")
    normal = F.when(kind["type"].isin(*NUMBERS), F.when(F.regexp_replace(plain, "^0+", "") == "", plain).otherwise(bare)).when(kind["type"].isin("client_id", "description_text", "field_value"), plain).otherwise(F.upper(plain))
    return F.when(plain != "", F.struct(kind["type"].alias("type"), normal.alias("normalized"), kind["confidence"].alias("confidence")))


def row_entities(rows: DataFrame, key: str, values: str = "values", least: float = 0.55) -> DataFrame:
    """(key, field, value, entity_type, confidence) of fields that name an entity; clients and blank values are left out."""
    pairs = rows.select(key, F.explode(values).alias("field", "value")).filter("trim(value) <> ''").withColumn("e", field_entity(F.col("field")))
    return pairs.filter((F.col("e.confidence") >= least) & (F.col("e.type") != "client_id")).select(key, "field", F.trim("value").alias("value"), F.col("e.type").alias("entity_type"), "e.confidence")


def row_relations(rows: DataFrame, table: str, key: str, primary: str, values: str) -> DataFrame:
    """(from, relation, to): a row's key fields, its other values and its table."""
    row = F.concat_ws("|", F.lit(table), F.col(key).cast("string"))
    keys = rows.select(row.alias("from"), F.lit("HAS_KEY").alias("relation"), F.explode(primary).alias("f", "v"))
    others = rows.select(row.alias("from"), F.lit("HAS_VALUE").alias("relation"), F.explode(values).alias("f", "v"))
    named = keys.unionByName(others).filter("v is not null").select("from", "relation", F.concat_ws("=", "f", "v").alias("to"))
    return named.unionByName(rows.select(row.alias("from"), F.lit("ROW_OF").alias("relation"), F.lit(table).alias("to")))


def merge_objects(objects: DataFrame, order: str) -> DataFrame:
    """(type, name, display_name, attributes map, order) to one row an object: the first display name that isn't null, and
    of each attribute the last value."""
    first = F.min_by(F.when(F.col("display_name").isNotNull(), F.col("display_name")), F.when(F.col("display_name").isNotNull(), F.col(order)))
    names = objects.groupBy("type", "name").agg(first.alias("display_name"))
    pairs = objects.select("type", "name", order, F.explode("attributes").alias("k", "v")).groupBy("type", "name", "k").agg(F.max_by("v", order).alias("v"))
    merged = pairs.groupBy("type", "name").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", "v"))), ";").alias("attributes"))
    return names.join(merged, ["type", "name"], "left")


def contexts_of(edges: DataFrame, metadata: Column) -> DataFrame:
    """(from, to, metadata 'k=v;k=v') to one row an edge: occurrences and the sorted distinct values of each key."""
    pairs = edges.withColumn("m", F.split(metadata, ";")).select("from", "to", F.explode_outer("m").alias("kv"))
    values = pairs.filter(F.contains("kv", F.lit("="))).groupBy("from", "to", F.trim(F.substring_index("kv", "=", 1)).alias("k")).agg(F.array_join(F.array_sort(F.collect_set(F.trim(F.regexp_replace("kv", "^[^=]*=", "")))), ",").alias("vs"))
    joined = values.groupBy("from", "to").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", "vs"))), ";").alias("contexts"))
    counts = edges.groupBy("from", "to").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.join(joined, ["from", "to"], "left").withColumn("contexts", F.coalesce("contexts", F.lit("")))


def flat_text(values: Column, most: int = 80) -> Column:
    """Keys and values of a map as one text, by key, the first `most` entries."""
    return F.array_join(F.transform(F.slice(F.array_sort(F.map_entries(values)), 1, most), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")


def structure_flags(field: Column, append: Column, content: Column) -> list[Column]:
    return [F.upper(field).rlike("^(Z|Y)|_Z|^/").alias("_is_z_field"), append.isNotNull().alias("_is_append_include"), content.isNotNull().alias("_linked_to_content")]


def field_score(name: Column, description: Column, terms: list[str]) -> Column:
    """Of a master field for a question: custom names 35, one, two or three terms in its description 25, 40 or 60, names
    that hold a term 20, generic names -10."""
    low = F.lower(F.coalesce(description, F.lit("")))
    hits = sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    in_name = F.lit(False)
    for t in terms:
        in_name = in_name | F.contains(F.lower(name), F.lit(t.lower()))
    described = F.when(hits >= 3, 60).when(hits == 2, 40).when(hits == 1, 25).otherwise(0)
    return F.when(F.upper(name).rlike("^(Z|Y)|_Z|^/"), 35).otherwise(0) + described + F.when(in_name, 20).otherwise(0) - F.when(F.length(name) <= 2, 10).otherwise(0)

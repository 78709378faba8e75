"""Small fixtures for what the test tables don't show."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import question
from quern.functions import text as X
from quern.operators import canonical, code, gate, incremental, index, link, search, vectors
from quern.sources import jsonl
from quern.streaming import sync


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first()["r"]


def test_text_functions(spark):
    v = F.col("v")
    assert one(spark, X.fold_search(v), "äöüß é Ä") == "aeoeuess e Ä"
    assert one(spark, X.fold_plain(v), "Äöß É") == "aoss e"
    assert one(spark, X.bm25_tokens(v), "Die Größe, a X1 b_c!") == ["die", "groesse", "x1", "b_c"]
    assert one(spark, X.char_trigrams(v), "ab") == ["AB"] and one(spark, X.char_trigrams(v), "-") == [] and one(spark, X.fold_plain(v), "ǅ ﬁ Ｆ") == "dz fi f" and one(spark, X.char_trigrams(v), "ab-cd") == ["ABC", "BCD"]
    assert one(spark, X.word_pairs(X.bm25_tokens(v)), "aa bb cc") == ["aa bb", "bb cc"] and one(spark, X.word_pairs(X.bm25_tokens(v)), "aa") == []
    assert one(spark, X.normal_literal(v), "0000") == "0" and one(spark, X.normal_literal(v), "004711") == "4711" and one(spark, X.normal_literal(v), "ab") == "AB"
    assert [one(spark, X.light_stem(v), w) for w in ("großen", "virtuelles", "Lagerorte", "tests", "Belege", "Kontos", "es", "Klass", "aktives", "rotes")] == ["gross", "virtuell", "lagerort", "tests", "beleg", "konto", "es", "klass", "aktiv", "rotes"]
    assert one(spark, X.symbols(v), "call Z_SEND_IDOC for VBAK-VKORG and /ABC/TAB x") == ["Z_SEND_IDOC", "VBAK-VKORG", "VKORG", "VBAK"]
    assert one(spark, X.symbols(v), "ZCL_A=>SEND_B z_mat yfoo AB1 ABC TABLE") == ["ZCL_A=>SEND_B", "SEND_B", "ZCL_A", "Z_MAT", "YFOO", "AB1"]
    assert one(spark, X.key_value_map(v), "a=1; b = 2=3;a=4;x") == {"a": "4", "b": "2=3"}
    assert one(spark, X.source_key_part(v, "TABLE"), "S1|TABLE|T001|X") == "T001" and one(spark, X.source_key_part(v, "NONE"), "S1|TABLE") is None
    assert set(one(spark, X.compound_parts(v), "materialnummer")) == {"materialnummer", "nummer", "material"} and set(one(spark, X.compound_parts(v), "Prüfort")) == {"prufort", "pruf", "ort"} and one(spark, X.compound_parts(v), "Nahort") == ["nahort"] and set(one(spark, X.compound_parts(v), "ab-Lager_x1y")) == {"ab-lager_x1y", "lager", "x1y"}
    assert one(spark, X.drop_prefixes(F.split(v, " ")), "kunde kundennummer art") == ["kundennummer", "art"]
    assert one(spark, X.is_custom_name(v), "ZZFIELD") and one(spark, X.is_custom_name(v), "/NS/F") and not one(spark, X.is_custom_name(v), "MATNR")
    assert one(spark, X.search_text({"Title": v, "Empty": F.lit(" ")}), "abc") == "Title: abc"
    assert one(spark, X.content_terms(v), "the plant the Plant code") == ["plant", "code"]
    assert "materialnummer" in one(spark, X.search_tokens(v), "Material-Nummer") and "material" in one(spark, X.search_tokens(v), "Material-Nummer")


def test_jsonl_scans(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('﻿{"a": 1, "b": "x"}\n\n{"a": 2}\nnot json\n[1]\n{"a": 3, "b": \n', encoding="utf-8")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert sorted(r.a for r in jsonl.scan(spark, str(f), schema).collect()) == [1, 2]
    _, bad = jsonl.parse_lines(spark.read.text(str(f)), schema)
    assert sorted(r.error for r in bad.collect()) == ["malformed", "no object", "no object"]
    assert jsonl.count_lines(spark, str(f)) == 5
    assert [r.a for r in jsonl.scan_matching(spark, str(f), ['"x"'], schema).collect()] == [1]
    assert jsonl.file_stamps(spark, str(f)).transform(jsonl.fingerprint).first().n_files == 1


def test_publish_all_or_none(spark, tmp_path):
    df, out = spark.range(3), f"file://{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        jsonl.published(spark, out)
    first = jsonl.publish({"a": df, "b": df}, out)
    with pytest.raises(FileExistsError):
        jsonl.publish({"b": df, "c": df}, out)
    assert jsonl.published(spark, out) == first and spark.read.json(f"{first}/a").count() == 3
    broken = df.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        jsonl.publish({"a": spark.range(5), "b": broken}, out, overwrite=True)
    # the version before is still the one that readers see, whole, and nothing is left of the other
    assert jsonl.published(spark, out) == first and spark.read.json(f"{first}/b").count() == 3 and len(list((tmp_path / "out").glob("v-*"))) == 1
    second = jsonl.publish({"a": spark.range(5)}, out, overwrite=True)
    assert jsonl.published(spark, out) == second and spark.read.json(f"{second}/a").count() == 5


def test_header_and_routes(spark):
    lines = spark.createDataFrame([(json.dumps({"record_type": "header", "export_type": "X", "system_id": "S", "schema_version": "1"}),), ('{"record_type": "row"}',)], "value string")
    assert jsonl.header_of(lines).collect() == [Row(export_type="X", system_id="S", schema_version="1")]
    routed = canonical.route(spark.createDataFrame([("header",), ("row",), (None,), ("odd",)], "record_type string"), ("header", "row"))
    assert {k: v.count() for k, v in routed.items()} == {"header": 1, "row": 1, "other": 2}


def test_relations_roll_up_and_split(spark):
    edges = spark.createDataFrame([("P", "A", "INCLUDES", "P", "B", "ctx-b"), ("P", "A", "INCLUDES", "P", "B", "ctx-a"), ("P", "A", "CALLS", "P", "UNRESOLVED_X", "c")], "from_type string, from_name string, relation_type string, to_type string, to_name string, context string")
    rolled = canonical.aggregate_relations(edges, "context")
    known, open_ends = canonical.split_unresolved(rolled)
    assert [(r.occurrence_count, r.contexts) for r in known.collect()] == [(2, "ctx-a|ctx-b")] and open_ends.count() == 1


def test_required_fields_and_stable_hash(spark):
    df = spark.createDataFrame([(1, None, " "), (2, "x", "y")], "id int, a string, b string")
    assert [r.missing for r in canonical.required_fields(df, ["b", "a"]).orderBy("id").collect()] == [["a", "b"], []]
    a, b = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")), F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.lit("1"))
    assert one(spark, canonical.stable_hash(a) == canonical.stable_hash(b))


def test_repair_lines(spark):
    sources = spark.createDataFrame([("s", "a = 1.\n  b = 2.\nc = 3.\nc = 3.")], "source_key string, source_code string")
    evidence = spark.createDataFrame([("s", 2, "b = 2."), ("s", 3, "a = 1."), ("s", 1, "c = 3."), ("s", 1, "zzz")], "source_key string, line int, quote string")
    assert sorted((r.quote, r.status, r.fixed_line) for r in code.repair_lines(evidence, sources).collect()) == [("a = 1.", "moved", 1), ("b = 2.", "exact", 2), ("c = 3.", "mismatch", None), ("zzz", "mismatch", None)]


def test_links(spark):
    left = spark.createDataFrame([(1, "0042"), (2, "7"), (3, "x")], "id int, k string")
    right = spark.createDataFrame([("42",), ("07",), ("007",)], "key string")
    assert {r.id: (r.status, r.match) for r in link.padded_join(left, right, "k", "key").collect()} == {1: ("resolved", "42"), 2: ("ambiguous", "007"), 3: ("unresolved", None)}
    accesses = spark.createDataFrame([(1, "A", "01"), (1, "B", "x"), (2, "A", "1"), (3, "A", "9")], "access_id int, field string, literal string")
    rows = spark.createDataFrame([(10, "A", "1"), (10, "B", "X"), (11, "A", "001"), (11, "B", "y")], "row_id int, field string, value string")
    assert {r.access_id: (r.kind, r.n_rows, r.confidence) for r in link.resolve_literals(accesses, rows, "access_id").collect()} == {1: ("RESOLVES_TABLE_ROW", 1, 0.9), 2: ("CANDIDATE", 2, 0.5), 3: ("UNRESOLVED", 0, 0.0)}


def test_vectors_and_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.5, 0.0]), ([1.0, 0.0], [1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(search.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]
    assert one(spark, vectors.valid_vector(F.lit("AAAA"), 1)) is False and one(spark, vectors.decode_vector(F.lit("AACAPw=="))) == [1.0]


def test_gate_metadata_and_evidence(spark):
    df = spark.createDataFrame([(1, {"a": "1"}), (2, {"a": "2"}), (3, {})], "id int, m map<string,string>")
    assert [r.id for r in df.filter(gate.metadata_filter(F.col("m"), {"a": 1, "b": ""})).collect()] == [1]
    before, after = spark.createDataFrame([("x", 1)], "kind string, key int"), spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "kind string, key int")
    assert {r.kind: r.n_new for r in gate.evidence_delta(before, after, "key", "kind").collect()} == {"x": 1, "y": 1}


def test_index_tables(spark):
    df = spark.createDataFrame([(1, "Z_SEND_IDOC"), (2, "Z_READ")], "id int, name string")
    found = {(r.symbol, r.id) for r in index.symbol_map(df, "name", "id").collect()}
    assert ("SEND", 1) in found and ("Z_READ", 2) in found and ("Z", 1) not in found
    capped = index.capped_postings(spark.createDataFrame([("a", i) for i in range(5)], "k string, id int"), "k", "id", 2).first()
    assert (capped.ids, capped.n) == ([0, 1], 5)


def test_relation_expansion(spark):
    seeds = spark.createDataFrame([(1, 100.0), (2, 12.0), (3, 1.0)], "doc_id long, score double")
    edges = spark.createDataFrame([(1, 9), (2, 9), (3, 8)], "from_id long, to_id long")
    assert {r.doc_id: round(r.boost, 3) for r in search.expand_relations(seeds, edges).collect()} == {9: 3.46, 8: 0.8}


def test_file_sync_resumes(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.StringType()), T.StructField("created", T.LongType())])
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        sync.sync_files(spark, source, schema, target, check, "id", "h", "created").awaitTermination()
        return sorted(tuple(r) for r in sync.current(spark, target).select("id", "h", "created").collect())

    assert put([(1, "a", 1), (2, "b", 1)]) == [(1, "a", 1), (2, "b", 1)]
    assert put([(2, "b", 5), (1, "c", 5), (3, "d", 5)]) == [(1, "c", 1), (2, "b", 1), (3, "d", 5)]


def test_windows_over_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = sync.windowed_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()
    assert sync.event_sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert search.bm25_scores(docs, ["a"]).count() == 0 and index.postings(docs).count() == 0
    assert incremental.changes(docs.withColumn("h", F.lit("")), docs.withColumn("h", F.lit("")), "doc_id", "h").count() == 0


def test_questions(spark):
    q = question.normalise("Wie wird die Nachrichtenfindung für Z_SEND_IDOC und große Lieferungen gesteuert?")
    assert q.terms == ["nachrichtenfindung", "z_send_idoc", "grosse", "lieferungen", "gesteuert"] and q.symbols == ["Z_SEND_IDOC"]
    assert "große lieferungen gesteuert" in q.phrases and question.stem("großen") == "gross" and question.normalise("").terms == []
    found = lambda text: one(spark, question.literals(F.col("v")), text)
    l = found("Wo ist MATNR 4711 oder 'ABC' hart codiert?")
    assert l.is_literal and l["values"] == ["ABC", "4711", "MATNR"] and l.fields == []
    l = found("MATNR = 4711 hart codiert?")
    assert l.is_literal and l["values"] == ["4711", "MATNR"] and l.fields == ["MATNR"]
    assert found("VKORG = 1000 fest?").is_literal and not found("Wie viele Aufträge gibt es 2024?").is_literal and not found("").is_literal
    assert {"ORDERS", "zmat1"} <= set(found("Sind Konstanten: ORDERS, zmat1")["values"])


def test_kinds_of_fields_are_found_once_a_field(spark):
    """Not once a value: no pattern of a field's description is left in the plan."""
    from quern.catalog_text import field_entities

    plan = field_entities(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and "MATERIAL)" not in plan

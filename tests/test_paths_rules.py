import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import graph, link, rules


def test_paths_equal_plain_search(spark):
    rng = random.Random(3)
    edges = [(f"e{i:03d}", f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice(["STRONG", "weak"]), rng.randrange(3)) for i in range(90)]
    df = spark.createDataFrame(edges, "edge_id string, from_id string, to_id string, relation string, rank int")
    got = {r.node_id: (r.seed_id, r.distance, r.path, r["rank"]) for r in graph.paths_from(spark.createDataFrame([("n0",), ("n1",), ("n0",)], "node_id string"), df, 4, ("WEAK",)).collect()}
    want, frontier = {s: (s, 0, [], None) for s in ("n0", "n1")}, {"n0", "n1"}
    for hop in range(1, 5):
        labels, strong = {}, set()
        for e, a, b, relation, rank in edges:
            for x, y in ((a, b), (b, a)):
                if x in frontier and y not in want:
                    label = (rank, want[x][2] + [e], want[x][0])
                    labels[y] = min(labels.get(y, label), label)
                    strong |= {y} if relation == "STRONG" else set()
        want |= {y: (seed, hop, path, rank) for y, (rank, path, seed) in labels.items()}
        frontier = strong
    assert got == want and max(d for _, d, _, _ in got.values()) >= 3


def test_rounds_end_when_nothing_is_new(spark):
    nexts = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 0), (20, 21)], "a int, b int")
    step = lambda added: added.join(nexts, added.k == nexts.a).select(F.col("b").alias("k"))
    found = graph.until_nothing_new(spark.createDataFrame([(3,), (3,), (8,)], "k int"), step, "k")
    assert sorted((r.k, r["round"]) for r in found.collect()) == [(0, 2), (1, 3), (2, 4), (3, 0), (4, 1), (5, 2), (6, 3), (7, 4), (8, 0), (9, 1)]
    with pytest.raises(RuntimeError):
        graph.until_nothing_new(spark.createDataFrame([(3,)], "k int"), step, "k", 4)
    assert graph.until_nothing_new(spark.createDataFrame([], "k int"), step, "k").count() == 0


def test_contains_join_equals_every_pair(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab_É€.%") for _ in range(n))
    needles = [(i, rng.choice("xy"), word(rng.randrange(0, 7))) for i in range(60)] + [(99, "x", None)]
    names = [(i, rng.choice("xy"), word(rng.randrange(0, 25))) for i in range(120)] + [(999, "x", None), (1000, "x", "ab" * 20_000)]
    left, right = spark.createDataFrame(needles, "needle_id int, scope string, needle string"), spark.createDataFrame(names, "name_id int, scope string, name string")
    found = link.contains_join(left, right)
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, j) for i, s, a in needles if a for j, t, b in names if b and s == t and a in b)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contains_join_multiplies_classes_last(spark):
    needles = [(i, "x", "ab" if i % 2 else "b") for i in range(300)] + [(1, "x", "b"), (None, "x", "c"), (None, "x", "ab")]
    names = [(j, "x", "xabx" if j % 3 else "bc") for j in range(200)] + [(None, "x", "cc"), (7, "x", "cc"), (7, "y", "ab")]
    found = link.contains_join(spark.createDataFrame(needles, "needle_id int, scope string, needle string"), spark.createDataFrame(names, "name_id int, scope string, name string"))
    want = {(i, j) for i, s, a in needles for j, t, b in names if s == t and a in b}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    # pairs of ids are neither shuffled nor compared
    assert not re.search(r"keys=\[needle_id#\d+L?, name_id#\d+", found._jdf.queryExecution().executedPlan().toString())


def test_contains_join_holds_few_pairs_at_a_time(spark, monkeypatch):
    """Parts of a class are of bounded size however large it is, and a task's generated code is given a piece of them at a time."""
    monkeypatch.setattr(link, "PART", 50, raising=False)
    needles = [(i, "x", "ab" if i % 2 else "b") for i in range(900)] + [(None, "x", "ab")]
    names = [(f"n{j}", "x", "xabx") for j in range(2000)] + [("n1", "x", "c"), (None, "x", "b")]
    left, right = spark.createDataFrame(needles, "needle_id int, scope string, needle string"), spark.createDataFrame(names, "name_id string, scope string, name string")
    found = link.contains_join(left, right)
    got = [tuple(r) for r in found.collect()]
    want = {(i, j) for i, s, a in needles for j, t, b in names if a in b}
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = re.findall(r"(\*\(\d+\) )?Generate (\w+\(\w+)", plan)
    assert [bool(code) for code, _ in made[:3]] == [True, True, False] and made[2][1] == "inline(flatten", made[:3]
    parts = link._alike(right, "name_id", "name", 7)[1].select("class", F.size(F.flatten("pieces")).alias("n"), F.array_max(F.transform("pieces", F.size)).alias("most")).collect()
    assert sum(r.n for r in parts) == 2001 and max(r.n for r in parts) < 100 and max(r.most for r in parts) == 7


def test_hits_meet_documents_without_a_nested_loop(spark):
    hits = spark.createDataFrame([(f"h{i}", "method", f"M{i}", None, None) for i in range(3000)], "hit_id string, kind string, technical_name string, table_name string, field_name string")
    docs = spark.createDataFrame([(1, "class", "calls m17x", "k|M2999", None, "M5", None, None), (2, None, None, None, None, None, None, None)], "doc_id int, unit_type string, title string, source_key string, object_name string, subobject_name string, table_name string, field_name string")
    found = link.match_hits(hits, docs)
    assert sorted(r.hit_id for r in found.collect()) == ["h1", "h17", "h2", "h29", "h299", "h2999", "h5"]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "text, name, kind, reason",
    [
        ("Funktionsbaustein: sd_x (y)", "SD_X", "function_module", "named_function"), ("IT_TAB", "IT_TAB", rules.INTERNAL, "parameter_or_variable"), ("zco_a->b_c d", "ZCO_A->B_C", "sap_proxy_or_webservice", "proxy"), ("VBAK", "VBAK", rules.INTERNAL, "database_table"),
        ("VBAK->x RFC", "VBAK->X", "rfc_destination", "rfc"), ("Parameter", "PARAMETER", rules.INTERNAL, "internal_comment"), ("Parameter der RFC", "PARAMETER DER RFC", "rfc_destination", "rfc"), ("READ_TEXT", "READ_TEXT", "function_module", "function_like_name"), ("ZCL_X", "ZCL_X", rules.INTERNAL, "helper_class"),
        ("", "", rules.INTERNAL, "plain_name"), (None, "", rules.INTERNAL, "plain_name"),
    ],
)
def test_interfaces(spark, text, name, kind, reason):
    row = spark.createDataFrame([(text,)], "t string").select(rules.interface_name(F.col("t")).alias("name"), rules.interface_kind(F.col("t")).alias("k")).first()
    assert (row.name, row.k.kind, row.k.reason) == (name, kind, reason)


def test_all_matches_and_exceptions(spark):
    table = (rules.Rule("a", "has_x", "x", but="y"), rules.Rule("b", "has_z_named", "z", also=("name", "^n")), rules.Rule("c", "has_x_too", "x"))
    df = spark.createDataFrame([("x", "n"), ("xy", "n"), ("z", "m"), ("xz", "n"), (None, None)], "text string, name string")
    columns = {"text": F.col("text"), "name": F.col("name")}
    got = [(r.k.kind, r.a) for r in df.select(rules.first_match(table, columns, ("d", "none")).alias("k"), rules.all_matches(table, columns).alias("a")).collect()]
    assert got == [("a", ["has_x", "has_x_too"]), ("c", ["has_x_too"]), ("d", []), ("a", ["has_x", "has_z_named", "has_x_too"]), ("d", [])]


def test_rounds_read_neither_orders_nor_lines_again(spark, monkeypatch):
    """Pairs of customer and part are written once, however many rounds follow."""
    from quern import catalog_text

    taken = []
    monkeypatch.setattr(catalog_text.graph, "until_nothing_new", lambda seeds, step, key: taken.append(step(seeds)) or seeds)
    catalog_text.rounds_of_shared_parts(spark, "/root/testdata/sf0.001")
    read = taken[0].inputFiles()
    assert read and not [f for f in read if "lineitem" in f or "orders" in f]

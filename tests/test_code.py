import random
import re
import time

import pytest

from quern.operators import code


def frame(spark, *sources):
    return spark.createDataFrame([(f"S{i}", s) for i, s in enumerate(sources)], "source_key string, source_code string")


def found(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


OPEN = [("FUNCTION", r"\s*FUNCTION\s+([/\w]+)"), ("FORM", r"\s*FORM\s+([/\w]+)\b"), ("MODULE", r"\s*MODULE\s+([/\w]+)\b"), ("CLASS", r"\s*CLASS\s+([/\w]+)\s+(?:IMPLEMENTATION|DEFINITION)\b"), ("METHOD", r"\s*METHOD\s+([/\w]+)\b")]


def plain_units(source):
    """Line by line, with a stack."""
    lines, stack, out = source.split("\n"), [], []

    def close(n):
        kind, name, start, _ = stack.pop()
        out.append((kind, name, start, n, stack[-1][1] if stack else None))

    for n, line in enumerate(lines, 1):
        if stack and re.match(rf"\s*END{stack[-1][0]}\b", line, re.I):
            close(n)
            continue
        for kind, p in OPEN:
            m = re.match(p, line, re.I)
            if m and (not stack or (kind == "METHOD" and any(s[3] for s in stack))):
                stack.append((kind, m[1].upper(), n, bool(re.match(r"\s*CLASS\s+\S+\s+IMPLEMENTATION\b", line, re.I))))
                break
    while stack:
        close(len(lines))
    return sorted(out, key=str)


LINES = [
    "FORM a.", "ENDFORM.", "  form b USING x.", "FUNCTION /n/f.", "ENDFUNCTION.", "CLASS c DEFINITION.", "CLASS c IMPLEMENTATION.", "CLASS d DEFINITION DEFERRED.", "ENDCLASS.", "METHOD m.", "METHOD if~m.", "ENDMETHOD.", "MODULE p INPUT.",
    "ENDMODULE.", "x = 1.", "* FORM z.", "", "FORMAT color.", "ENDFORMS.", "METHODS k.",
]


def test_units_equal_a_stack(spark):
    rng = random.Random(7)
    sources = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(0, 40))) for _ in range(120)] + ["", None, "FORM a.\r\nENDFORM.\rx"]
    got = {}
    for r in code.units_of(frame(spark, *sources)).collect():
        got.setdefault(r.source_key, []).append((r.unit_type, r.unit_name, r.start_line, r.end_line, r.parent))
    for i, s in enumerate(sources):
        assert sorted(got.get(f"S{i}", []), key=str) == plain_units((s or "").replace("\r\n", "\n").replace("\r", "\n")), s


def test_innermost_units(spark):
    rng = random.Random(8)
    sources = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(5, 40))) for _ in range(60)]
    df = frame(spark, *sources)
    lines = code.lines_of(df).select("source_key", "line")
    for r in code.in_units(lines, code.units_of(df)).collect():
        around = [u for u in plain_units(sources[int(r.source_key[1:])]) if u[2] <= r.line <= u[3]]
        assert r.unit_name == (max(around, key=lambda u: (u[2], -u[3]))[1] if around else None)


def test_statements(spark):
    source = "a = 'x.y'. b = 1.5. \" c = 2.\n* d.\nc = 'it''s'\n  \" e.\n  + 2.\n\n\"f\nopen"
    assert [(r.line, r.text.strip(), r.comment) for r in code.statements_of(frame(spark, source)).orderBy("line").collect()] == [
        (1, "a = 'x.y'.", False), (1, "b = 1.5.", False), (2, "* d.", True), (3, "c = 'it''s'\n  + 2.", False), (4, '" e.', True), (7, '"f', True), (8, "open", False)
    ]
    assert code.statements_of(frame(spark, None, "", "\n \n")).count() == 0


@pytest.mark.parametrize(
    "text, fields",
    [
        ("x-matnr = '1'", "MATNR"), ("IF '1' = ls-kunnr", "KUNNR"), ("WHERE werks IN ('0','1')", "WERKS"), ("WHERE lgort BETWEEN '0' AND '1'", "LGORT"), ("MOVE '1' TO ls-vkorg", "VKORG"), ("r_vtweg-low = '1'", "VTWEG"),
        ("PARAMETERS p TYPE spart DEFAULT '1'", "SPART"), ("PARAMETERS p TYPE c DEFAULT '1'", ""), ("PARAMETERS p_spart DEFAULT '1'", "SPART"), ("DATA x TYPE vbak-auart VALUE '1'", "AUART"), ("sign = 'I' low = '1' high = t_bukrs", "BUKRS"), ("WRITE '1'", ""), ("lv_matnr2 = '1'", ""), ("matnr = kunnr + '1'", ""),
    ],
)
def test_binding_forms(spark, text, fields):
    got = {r.value: r.fields for r in code.literals_of(frame(spark, text + ".")).collect()}
    assert got["1"] == fields


def test_literals(spark):
    source = "* old '4711' matnr = '4712'\nmatnr = '0004711'. x = 'x'. y = 'NAME1'. z = ''. CALL FUNCTION 'Z_F'.\nCALL TRANSACTION 'VA01'. a = '" + "l" * 61 + "'. mestyp = 'ORDERS'. c = '?'."
    assert found(code.literals_of(frame(spark, source)), "line", "value", "normalized", "kind", "fields", "roles", "comment") == [
        (1, "4711", "4711", "numeric", "", "generic_literal", True), (1, "4712", "4712", "numeric", "MATNR", "material_number", True), (2, "0004711", "4711", "numeric", "MATNR", "material_number", False),
        (2, "Z_F", "Z_F", "function_module", "", "generic_literal", False), (3, "?", "?", "char", "", "generic_literal", False), (3, "ORDERS", "ORDERS", "message_type", "MESTYP", "message_type", False), (3, "VA01", "VA01", "transaction", "", "generic_literal", False),
    ]


def test_accesses_and_sub_selects(spark):
    source = "SELECT * FROM t1 WHERE a IN ( SELECT b FROM t2 WHERE c = 1 ).\nDELETE FROM t3 WHERE a = '1'. DELETE ADJACENT DUPLICATES FROM x.\nINSERT ls_x INTO TABLE lt_x. MODIFY t4 FROM y. UPDATE t5\n SET a = 1 WHERE b = 2. SELECT x FROM lt_t INTO y. modify it_a."
    assert found(code.accesses_of(frame(spark, source)), "line", "operation", "table_name") == [(1, "read", "T1"), (1, "read", "T2"), (2, "delete", "T3"), (3, "modify", "T4"), (3, "update", "T5")]


def test_last_assignment_before_the_use(spark):
    source = """CONSTANTS c_g TYPE c VALUE 'G'.
g = 'late'.
FORM f.
  SELECT * FROM t WHERE a = v.
  v = '1'. SELECT * FROM t WHERE a = v AND b EQ c_g.
  IF x = 'no'. v = 'it''s'. ENDIF.
  SELECT * FROM t
    WHERE a = @v AND d = 5 and e <= w.
  MOVE 'm' TO w.
ENDFORM.
FORM h.
  SELECT * FROM t WHERE a = v AND g = g AND z NE '0'.
  g = 'own'. SELECT * FROM t WHERE g = g.
ENDFORM."""
    assert found(code.conditions_of(frame(spark, source)), "line", "unit_name", "field", "operator", "value_kind", "raw_value", "resolved") == sorted(
        [
            (4, "F", "A", "=", "variable", "v", None), (5, "F", "A", "=", "variable", "v", "1"), (5, "F", "B", "=", "variable", "c_g", "G"), (7, "F", "A", "=", "variable", "@v", "it's"), (7, "F", "D", "=", "literal", "5", "5"), (7, "F", "E", "<=", "variable", "w", None),
            (12, "H", "A", "=", "variable", "v", None), (12, "H", "G", "=", "variable", "g", "late"), (12, "H", "Z", "<>", "literal", "0", "0"), (13, "H", "G", "=", "variable", "g", "own"),
        ],
        key=lambda r: (r[0], r[2]),
    )


def test_macros_and_windows(spark):
    source = "DEFINE add_line.\nEND-OF-DEFINITION.\nadd_line 'x'.\nadd_line 'y'.\nZZ_MAC a b.\nIF x = 1.\n SELECT * FROM t1 INTO y.\n z = 2.\nENDIF.\n"
    assert found(code.macros_of(frame(spark, source)), "line", "name", "resolved") == [(3, "ADD_LINE", True), (5, "ZZ_MAC", False)]
    assert found(code.windows_of(frame(spark, source)), "line", "table_name", "first", "last") == [(7, "T1", 6, 9)]


def test_statements_are_cut_without_a_shuffle(spark):
    df = frame(spark, "a = 12'b'3 'c' 4.\r\n\n  5 \ufdd1\ufdd2'd' \" 'e'\n* 6'f' \" 'g'\n'h\n. x = '.'.5 .")
    quoted = code.quoted_of(df)
    for of in (code.statements_of(df), quoted, code.accesses_of(df), code.calls_of(df)):
        plan = of._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan
    assert found(quoted, "line", "value", "before", "after", "comment") == [
        (1, "b", "a = 12", "3 'c' 4.", False), (1, "c", "a = 12'b'3 ", " 4.", False), (3, "d", "  5 ", " \n'h\n.", False), (4, "f", "* 6", ' " \'g\'', True), (5, "h", "", "\n.", False), (6, ".", " x = ", ".5 .", False),
    ]


def test_plans_have_no_python(spark):
    df = frame(spark, "x = 1.")
    for of in (code.units_of, code.literals_of, code.accesses_of, code.conditions_of, code.calls_of, code.macros_of, code.windows_of):
        plan = of(df)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_long_sources(spark):
    source = "\n".join(f"FORM f{i}.\n x{i} = '{i}'.\nENDFORM." for i in range(7000)) + "\ny IN ( " + ", ".join(f"'{i}'" for i in range(3000)) + " )."
    df, began = frame(spark, source), time.perf_counter()
    assert code.units_of(df).count() == 7000 and code.literals_of(df).count() == 10_000
    assert time.perf_counter() - began < 60

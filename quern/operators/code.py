"""ABAP sources as relations: lines, statements, units, literals, table accesses, calls and macros.

A source is one row and is cut into its statements where it is read: each line's strings and full stops are marked and the
lines joined again, so that nothing is shuffled or sorted for it. Statements, and what is found in them, are a row each. Line
numbers start at 1. A window spans one source. Sources are (source_key, source_code); null and empty code has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields that bind a literal, with the role that it then has.
ROLES = {
    "MATNR": "material_number", "KUNNR": "customer_number", "LIFNR": "vendor_number", "WERKS": "plant", "LGORT": "storage_location", "VKORG": "sales_org", "VTWEG": "distr_channel",
    "SPART": "division", "BUKRS": "company_code", "AUART": "order_type", "BSART": "order_type", "KSCHL": "condition_type", "MESTYP": "message_type", "IDOCTP": "idoc_type",
}
# Literals that say nothing.
NOISE = r"(?i)^(?:true|false|abap_true|abap_false|x|space|initial|sy-uname|sy-datum|NAME1|ORT01|ARKTX|ERNAM|ERDAT|AEDAT)$"
# Lines that open a unit (kind, pattern of the line with its name); a unit ends with END and its kind.
OPENERS = (
    ("FUNCTION", r"(?i)^\s*FUNCTION\s+([/A-Za-z_][/A-Za-z0-9_]*)\s*\.?"),
    ("FORM", r"(?i)^\s*FORM\s+([/A-Za-z_][/A-Za-z0-9_]*)\b"),
    ("MODULE", r"(?i)^\s*MODULE\s+([/A-Za-z_][/A-Za-z0-9_]*)\b"),
    ("CLASS", r"(?i)^\s*CLASS\s+([/A-Za-z_][/A-Za-z0-9_]*)\s+(?:IMPLEMENTATION|DEFINITION)\b"),
    ("METHOD", r"(?i)^\s*METHOD\s+([/A-Za-z_][/A-Za-z0-9_]*)\b"),
)
IMPLEMENTATION = r"(?i)^\s*CLASS\s+\S+\s+IMPLEMENTATION\b"
# How a literal is bound to a field {f}: what stands before it on its line, what follows it in its statement.
BEFORE = (
    r"\b(?:[A-Z0-9_]+-)?{f}\b\s*(?:=|EQ|NE|CP|IN)\s*$",
    r"\b(?:[A-Z0-9_]+-)?{f}\b[^.]{{0,100}}?\b(?:IN|BETWEEN)\b[^.]{{0,120}}?$",
    r"\b(?:[A-Z0-9_]*{f}[A-Z0-9_]*)-(?:LOW|HIGH)\s*=\s*$",
    r"\b[A-Z0-9_]*{f}[A-Z0-9_]*\b[^.\n]{{0,80}}?\bdefault\s+$",
    r"\b(?:TYPE|LIKE)\s+[A-Z0-9_-]*{f}\b[^.\n]{{0,40}}?\bVALUE\s+$",
)
AFTER = r"^\s*(?:=|EQ|NE)\s*(?:[A-Z0-9_]+-)?{f}\b"
MOVED, MOVED_TO = r"(?i)\bMOVE\s+$", r"^\s+TO\s+[^.\n]*\b{f}\b"
LOW, LOW_OF = r"(?i)\blow\s*=\s*$", r"^[^.]{{0,120}}?\b(?:[A-Z0-9_]*{f})"
# Names that are not those of database tables.
INTERNAL = r"^(L_|G_|LT_|GT_|LS_|GS_|IT_|IS_|WA_|<|SY)"
NOT_TABLES = ("ADJACENT", "SET", "INTO", "CORRESPONDING")
NAME = r"[/A-Za-z_][/A-Za-z0-9_]*"
# Marks, characters that Unicode keeps from text. What stands before a line's number where a part of a line or
# a string begins, what follows that number, and what follows a string and a statement.
PART, QUOTED, AT, UNQUOTED, END = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4"
#: A string up to its quote or the end of the line, a comment, a full stop that is no decimal point.
STRING, REMARK, STOP = "('[^']*(?:''[^']*)*'?)", '"[^\n]*', r"(\.)(?![0-9])"
CONDITION = rf"(?i)^\s*({NAME})\s*(EQ|NE|<>|<=|>=|LT|GT|LE|GE|=|<|>)\s*(.+?)\s*$"
# Statements that open with an underscored word and are no macro calls.
KEYWORDS = ("END_OF_SELECTION", "START_OF_SELECTION", "CLASS_DATA", "FIELD_SYMBOLS")


def _lines(code: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(code, F.lit("")), "\r\n?", "\n"), "\n")


def _is_comment(line: Column) -> Column:
    return line.rlike(r'^\s*[*"]')


def lines_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, line, text)."""
    return sources.select(key, F.posexplode(_lines(F.col(code))).alias("at", "text")).select(key, (F.col("at") + 1).alias("line"), "text")


def _marked(line: Column, number: Column, comment: bool) -> Column:
    """A line with its marks, behind the line's end before it. In a comment no full stop ends a statement; in code what is
    remarked behind a statement is dropped."""
    n, empty = number.cast("string"), QUOTED + AT + UNQUOTED
    begin = F.concat(F.lit(PART), n, F.lit(AT))
    # one pass: a string between its marks, of anything else empty marks with what is kept of it
    found = F.regexp_replace(line, f"{STRING}|({REMARK})" if comment else f"{STRING}|{REMARK}|{STOP}", f"{QUOTED}{AT}$1{UNQUOTED}$2")
    if not comment:
        found = F.replace(found, F.lit(empty + "."), F.concat(F.lit("." + END), begin))
    found = F.replace(F.replace(found, F.lit(empty), F.lit("")), F.lit(QUOTED), F.concat(F.lit(QUOTED), n))
    return F.concat(F.when(number > 1, "\n").otherwise(""), begin, found)


def statements_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, stmt, line, text, comment, marked): statements that aren't blank, the line where they begin and their text, which
    marked has with the marks of its strings. Narrow. A line of comment is a statement of its own (its line, negative) and
    doesn't end one. The marks' characters count as nothing."""
    lines = sources.select(key, _lines(F.translate(F.col(code), PART + QUOTED + AT + UNQUOTED + END, "")).alias("lines"))
    own = F.array_join(F.transform("lines", lambda t, i: F.when((F.length(t) > 0) & ~_is_comment(t), _marked(t, i + 1, False))), "")
    comments = F.filter(F.transform("lines", lambda t, i: F.when(_is_comment(t), F.struct((-1 - i).cast("long").alias("stmt"), F.lit(True).alias("comment"), _marked(t, i + 1, True).alias("piece")))), lambda c: c.isNotNull())
    cut = F.transform(F.split(own, END), lambda p, i: F.struct(i.cast("long").alias("stmt"), F.lit(False).alias("comment"), p.alias("piece")))
    found = lines.select(key, F.inline(F.concat(cut, comments)))
    line = F.regexp_extract("piece", f"{PART}([0-9]+){AT} *[^{PART} \n]", 1)
    marked = found.select(key, "stmt", F.when(line != "", line).cast("int").alias("line"), "comment", F.regexp_replace("piece", f"{PART}[0-9]+{AT}", "").alias("marked")).filter("line is not null")
    return marked.select(key, "stmt", "line", F.regexp_replace("marked", f"{QUOTED}[0-9]+{AT}|{UNQUOTED}", "").alias("text"), "comment", "marked")


def units_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, unit_type, unit_name, start_line, end_line, parent), narrow.

    A unit opens outside of others, but for methods, which open inside the implementation of a class too, and closes with
    the end of its kind while it is the innermost; what else lies inside is its content. Open units end with the source.
    """
    kinds = "|".join(k for k, _ in OPENERS)

    def event(at: Column) -> Column:
        line, i = at["line"], at["i"]
        opened = F.coalesce(*(F.when(line.rlike(p), F.struct(F.lit(k).alias("kind"), F.upper(F.regexp_extract(line, p, 1)).alias("name"))) for k, p in OPENERS))
        ended = F.upper(F.regexp_extract(line, rf"(?i)^\s*END({kinds})\b", 1))
        return F.struct((i + 1).alias("line"), F.coalesce(opened["kind"], ended).alias("kind"), opened["name"].alias("name"), line.rlike(IMPLEMENTATION).alias("holds"))

    # opening and closing lines in order, folded with the stack of open units
    found = sources.select(key, _lines(F.col(code)).alias("lines"))
    # most lines have no word of a border and are looked at once
    likely = F.filter(F.transform("lines", lambda t, i: F.when(t.rlike(rf"(?i)^\s*(?:END)?(?:{kinds})"), F.struct(t.alias("line"), i.alias("i")))), lambda x: x.isNotNull())
    found = found.withColumn("events", F.filter(F.transform(likely, event), lambda e: e["kind"] != ""))
    unit = "array<struct<line:int,kind:string,name:string,holds:boolean>>"
    begin = F.expr(f"named_struct('open', cast(array() as {unit}), 'closed', cast(array() as array<struct<unit_type:string,unit_name:string,start_line:int,end_line:int,parent:string>>))")

    def closed_unit(top: Column, end: Column, parent: Column) -> Column:
        return F.struct(top["kind"].alias("unit_type"), top["name"].alias("unit_name"), top["line"].alias("start_line"), end.alias("end_line"), parent.alias("parent"))

    def step(s: Column, e: Column) -> Column:
        depth, top = F.size(s["open"]), F.try_element_at(s["open"], F.lit(-1))
        closes = e["name"].isNull() & (depth > 0) & (top["kind"] == e["kind"])
        opens = e["name"].isNotNull() & ((depth == 0) | ((e["kind"] == "METHOD") & F.exists(s["open"], lambda u: u["holds"])))
        done = F.struct(F.slice(s["open"], F.lit(1), F.greatest(depth - 1, F.lit(0))).alias("open"), F.concat(s["closed"], F.array(closed_unit(top, e["line"], F.try_element_at(s["open"], F.lit(-2))["name"]))).alias("closed"))
        more = F.struct(F.concat(s["open"], F.array(e)).alias("open"), s["closed"].alias("closed"))
        return F.when(F.coalesce(closes, F.lit(False)), done).when(opens, more).otherwise(s)

    folded = found.withColumn("s", F.aggregate("events", begin, step))
    left = F.transform("s.open", lambda u, i: closed_unit(u, F.size("lines"), F.when(i > 0, F.get("s.open", i - 1)["name"])))
    return folded.select(key, F.inline(F.concat("s.closed", left)))


def in_units(found: DataFrame, units: DataFrame, key: str = "source_key") -> DataFrame:
    """Rows (key, line, ...) with unit_name, the innermost unit around the line or null: the last border at or before it,
    where a unit's begin is a border to it and the line after its end one to its parent."""
    begins = units.select(key, F.col("start_line").alias("line"), F.lit(1).alias("_order"), "start_line", F.col("unit_name").alias("_unit"))
    ends = units.select(key, (F.col("end_line") + 1).alias("line"), F.lit(0).alias("_order"), -F.col("start_line"), F.col("parent").alias("_unit"))
    borders = begins.union(ends).select(key, "line", "_order", "start_line", F.struct("_unit").alias("_border"))
    rows = found.withColumns({"_order": F.lit(2), "start_line": F.lit(0)})
    over = Window.partitionBy(key).orderBy("line", "_order", "start_line").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.unionByName(borders, allowMissingColumns=True).withColumn("unit_name", F.last("_border", ignorenulls=True).over(over)["_unit"])
    return marked.filter("_order = 2").select(*found.columns, "unit_name")


def _bound(field: str, before: Column, after: Column) -> Column:
    fits = [before.rlike("(?i)" + p.format(f=field)) for p in BEFORE]
    fits += [after.rlike("(?i)" + AFTER.format(f=field)), before.rlike(MOVED) & after.rlike("(?i)" + MOVED_TO.format(f=field)), before.rlike(LOW) & after.rlike("(?i)" + LOW_OF.format(f=field))]
    out = fits[0]
    for x in fits[1:]:
        out = out | x
    return out


def quoted_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, line, value, before, after, comment) of each quoted literal that isn't blank: what stands before it on its line and
    what follows it in its statement."""
    pieces = statements_of(sources, key, code).select(key, "comment", F.split("marked", f"[{QUOTED}{UNQUOTED}]").alias("cut")).filter(F.size("cut") > 1)
    # every other piece is a string with its line, the first and the last are none
    one = pieces.select(key, "comment", "cut", F.explode(F.sequence(F.lit(2), F.size("cut") - 1, F.lit(2))).alias("i")).select(key, "comment", "cut", "i", F.element_at("cut", F.col("i")).alias("own"))
    plain = lambda parts: F.regexp_replace(F.array_join(parts, UNQUOTED), f"{UNQUOTED}(?:[0-9]+{AT})?", "")
    value = F.replace(F.regexp_extract("own", f"{AT}'(.*?)'?$", 1), F.lit("''"), F.lit("'"))
    named = one.select(key, F.substring_index("own", AT, 1).cast("int").alias("line"), value.alias("value"), "comment", "cut", "i").filter(F.col("value").rlike(r"\S"))
    before = F.substring_index(plain(F.slice("cut", F.lit(1), F.col("i") - 1)), "\n", -1)
    return named.select(key, "line", "value", before.alias("before"), plain(F.slice("cut", F.col("i") + 1, F.size("cut"))).alias("after"), "comment")


def literals_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, line, value, normalized, kind, fields, roles, comment) of quoted literals of up to 60 characters that say
    something, each once a line and set of fields.

    fields are those of ROLES that the literal is bound to by comparison, list, range, MOVE, default or declared value, in
    ROLES' order; without any the role is generic_literal.
    """
    named = quoted_of(sources, key, code).filter((F.length("value") <= 60) & ~F.col("value").rlike(NOISE))
    bound = named.withColumn("upper", F.upper(F.concat_ws(" ", "before", "after")))
    fields = F.array_compact(F.array(*(F.when(F.col("upper").contains(f) & _bound(f, F.col("before"), F.col("after")), f) for f in ROLES)))
    typed = (
        F.when(F.col("before").rlike(r"(?i)\bCALL\s+FUNCTION\b"), "function_module").when(F.col("before").rlike(r"(?i)\bCALL\s+TRANSACTION\b"), "transaction").when(F.concat_ws(" ", "before", "after").rlike(r"(?i)\b(?:MESTYP|MESSAGE\s+TYPE)\b"), "message_type")
        .when(F.concat_ws(" ", "before", "after").rlike(r"(?i)\bIDOCTP\b"), "idoc_type").when(F.col("value").rlike("^[0-9]+$"), "numeric").when(F.length("value") == 1, "char").otherwise("string")
    )
    trimmed = F.trim("value")
    normal = F.when(trimmed.rlike("^[0-9]+$"), F.regexp_replace(trimmed, "^0+(?=[0-9])", "")).otherwise(F.upper(trimmed))
    roles = F.create_map(*(F.lit(x) for f in ROLES.items() for x in f))
    kinds = F.array_distinct(F.transform("fields", lambda f: roles[f]))
    return bound.select(key, "line", "value", normal.alias("normalized"), typed.alias("kind"), fields.alias("fields"), "comment").select(
        key, "line", "value", "normalized", "kind", F.array_join("fields", ",").alias("fields"), F.when(F.size("fields") == 0, "generic_literal").otherwise(F.array_join(kinds, ",")).alias("roles"), "comment"
    ).dropDuplicates([key, "line", "normalized", "fields", "comment"])


# Shapes of literals that are no material numbers, in the order in which they are tried.
NO_MATERIALS = (
    ("too_long", r"^.{41,}$"), ("date_or_year", r"^(?:19|20)\d{2}(?:(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))?$"), ("boolean", r"(?i)^(?:true|false|abap_true|abap_false|x|space|initial)$"), ("field_name_literal", r"(?i)-(?:MATNR|LOW|HIGH|SIGN|OPTION)$"),
    ("program_name", r"(?i)^SAP[A-Z0-9_]+$"), ("ddic_field_name", r"(?i)^(?:NAME1|ORT01|KUNNR|LIFNR|WERKS|ARKTX|ERNAM|ERDAT|MATNR)$"), ("semantic_token", r"(?i)^0?MATERIAL$"), ("too_short_numeric", r"^\d{1,3}$"), ("too_long_numeric", r"^\d{19,}$"),
)
MATERIAL = r"(?i)^(?:\d{4,18}|(?=.*\d)(?=.*[A-Z])[A-Z0-9]{4,18})$"
# What stands before a literal that belongs to another field, and what binds one to MATNR beside BEFORE and AFTER.
AGAINST = r"(?i)\bFIELDNAME\s+(?:EQ|=)\s*$|\bBDC_FIELD\s+USING\s+$|\b(?:KSCHL|MSGTY|MSGNO|AUART|BSART|VBTYP|VTWEG|SPART|VKORG)\b\s*(?:=|EQ|NE)\s*$|\b(?:FKDAT|BUDAT|ERDAT|AEDAT|FBUDA|DATUM|DATAB|DATBI)\b[^.\n]{0,60}default\s+$"
RANGE, RANGE_OF = r"(?i)\b(?:LOW|HIGH)\s*=\s*$", r"(?i)^[^.]{0,80}?\b(?:RANGE\s+OF\s+MATNR|FOR\s+[A-Z0-9_]*MATNR)\b"
VALUE, VALUE_OF = r"(?i)\bVALUE\s+$", r"(?i)^[^.\n]{0,40}?\b(?:TYPE|LIKE)\s+[A-Z0-9_-]*MATNR\b"


def materials_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, line, value, accepted, reason, comment) of literals in statements that name MATNR: material numbers, and what
    isn't one with the reason.

    A literal must have the shape of a material number, must not be bound to another field, and must be an operand of
    MATNR: that the statement names the field elsewhere isn't enough. A rejection by shape comes before one by binding.
    """
    named = quoted_of(sources, key, code).filter(F.concat_ws(" ", "before", "after").rlike(r"(?i)\b(?:[A-Z0-9_]+-)?[A-Z0-9_]*MATNR\b|\bMATNR_"))
    value = F.trim("value")
    digits = F.regexp_replace(value, r"\s+", "")
    shape = F.coalesce(*(F.when(value.rlike(p), F.lit(reason)) for reason, p in NO_MATERIALS), F.when(~value.rlike(MATERIAL), F.lit("not_material_shaped")))
    before, after = F.col("before"), F.col("after")
    bound = _bound("MATNR", before, after) | (before.rlike(RANGE) & after.rlike(RANGE_OF)) | (before.rlike(VALUE) & after.rlike(VALUE_OF))
    reason = F.coalesce(shape, F.when(before.rlike(AGAINST), F.lit("bound_to_other_field")), F.when(~bound, F.lit("not_bound")))
    return named.select(key, "line", F.when(digits.rlike(r"^\d+$"), digits).otherwise(F.upper(value)).alias("value"), reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("operand_of_field")).alias("reason"), "comment").distinct()


def accesses_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, stmt, line, operation, table_name, condition): reads, updates, inserts, changes and deletions of database tables, with
    the text of a WHERE. Each SELECT of a statement is a read; names of internal tables are none."""
    found = statements_of(sources, key, code).filter("not comment").select(key, "stmt", "line", "text", F.split("text", r"(?i)(?=\bSELECT\b)").alias("p"), F.lower(F.regexp_extract("text", r"(?i)^\s*(UPDATE|INSERT|MODIFY|DELETE)\b", 1)).alias("change"))
    entry = lambda operation, text: F.struct(operation.alias("operation"), text.alias("text"))
    reads = F.filter(F.transform("p", lambda piece, i: F.when(piece.rlike(r"(?i)^SELECT\b"), entry(F.lit("read"), F.array_join(F.slice("p", i + 1, F.size("p")), "")))), lambda r: r.isNotNull())
    changes = F.filter(F.array(entry(F.col("change"), F.col("text"))), lambda c: c["operation"] != "")
    both = found.select(key, "stmt", "line", F.inline(F.concat(reads, changes)))
    target = F.when(F.col("operation") == "read", F.regexp_extract("text", rf"(?is)\bFROM\s+({NAME})\b", 1)).when(F.col("operation") == "update", F.regexp_extract("text", rf"(?i)\bUPDATE\s+({NAME})\s+SET\b", 1))
    target = target.otherwise(F.regexp_extract("text", rf"(?i)\b(?:INSERT|MODIFY|DELETE)\b\s+(?:FROM\s+)?(?:INTO\s+)?(?:TABLE\s+)?({NAME})\b", 1))
    both = both.select(key, "stmt", "line", "operation", target.alias("table_name"), "text")
    named = both.withColumn("table_name", F.upper("table_name")).filter((F.col("table_name") != "") & ~F.col("table_name").rlike(INTERNAL) & ~F.col("table_name").isin(*NOT_TABLES))
    where = F.trim(F.regexp_replace(F.regexp_extract("text", r"(?is)\bWHERE\b(.*?)\.?\s*$", 1), r"\s+", " "))
    return named.select(key, "stmt", "line", "operation", "table_name", F.when(F.col("operation").isin("read", "update", "delete"), where).otherwise("").alias("condition"))


def assignments_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, stmt, line, variable, value): statements that give a variable a literal or number: by `=`, MOVE, or a declaration's
    VALUE."""
    found = statements_of(sources, key, code).filter("not comment").select(key, "stmt", "line", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    forms = (
        (r"(?i)^\s*(?:DATA\()?([A-Za-z_][A-Za-z0-9_]*)\)?\s*=\s*('(?:[^']|'')*'|-?[0-9]+(?:\.[0-9]+)?)\s*\.?$", 1, 2),
        (r"(?i)^\s*MOVE\s+('(?:[^']|'')*')\s+TO\s+([A-Za-z_][A-Za-z0-9_]*)\s*\.?$", 2, 1),
        (r"(?i)^\s*(?:CONSTANTS|DATA)\s*:?\s*([A-Za-z_][A-Za-z0-9_]*)\b[^']*\bVALUE\s+('(?:[^']|'')*')\s*\.?$", 1, 2),
    )
    variable, value = (F.coalesce(*(F.when(F.col("text").rlike(p), F.regexp_extract("text", p, of[k])) for p, *of in forms)) for k in (0, 1))
    named = found.select(key, "stmt", "line", F.upper(variable).alias("variable"), value.alias("raw")).filter("variable is not null")
    return named.select(key, "stmt", "line", "variable", F.when(F.col("raw").startswith("'"), F.replace(F.regexp_extract("raw", "^'(.*)'$", 1), F.lit("''"), F.lit("'"))).otherwise(F.col("raw")).alias("value"))


def conditions_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, line, operation, table_name, unit_name, field, operator, value_kind, raw_value, resolved) of each part of a WHERE.

    A variable has the value of its last assignment before the statement in the same unit, else of the last one outside of
    all units: one window over uses and assignments. resolved is null where there is none.
    """
    units = units_of(sources, key, code)
    part = F.explode(F.split("condition", r"(?i)\bAND\b")).alias("part")
    found = accesses_of(sources, key, code).filter("condition <> ''").select(key, "stmt", "line", "operation", "table_name", part).filter(F.col("part").rlike(CONDITION))
    rhs = F.regexp_extract("part", CONDITION, 3)
    cut = found.select(key, "stmt", "line", "operation", "table_name", F.upper(F.regexp_extract("part", CONDITION, 1)).alias("field"), F.upper(F.regexp_extract("part", CONDITION, 2)).alias("operator"), F.regexp_replace(rhs, "[.,;]+$", "").alias("rhs"))
    literal, number = F.col("rhs").rlike("^'.*'$"), F.col("rhs").rlike(r"^-?[0-9]+(?:\.[0-9]+)?$")
    kinds = cut.select(
        key, "stmt", "line", "operation", "table_name", "field", F.when(F.col("operator") == "EQ", "=").when(F.col("operator") == "NE", "<>").otherwise(F.col("operator")).alias("operator"), F.when(literal | number, "literal").otherwise("variable").alias("value_kind"),
        F.when(literal, F.replace(F.regexp_extract("rhs", "^'(.*)'$", 1), F.lit("''"), F.lit("'"))).otherwise(F.col("rhs")).alias("raw_value"),
    )
    uses = kinds.withColumn("_use", F.lit(True)).withColumn("variable", F.upper(F.regexp_replace("raw_value", "^@", "")))
    both = in_units(uses.unionByName(assignments_of(sources, key, code), allowMissingColumns=True), units, key)
    inside = Window.partitionBy(key, "unit_name", "variable").orderBy("stmt", F.col("_use").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    anywhere = Window.partitionBy(key, "variable").orderBy("stmt", F.col("_use").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = both.withColumn("own", F.last("value", ignorenulls=True).over(inside)).withColumn("outer", F.last(F.when(F.col("unit_name").isNull(), F.col("value")), ignorenulls=True).over(anywhere))
    resolved = F.when(F.col("value_kind") == "literal", F.col("raw_value")).otherwise(F.coalesce("own", "outer"))
    return known.filter("_use").select(key, "line", "operation", "table_name", "unit_name", "field", "operator", "value_kind", "raw_value", resolved.alias("resolved"))


# Statements that call, with the pattern of the name.
CALLS = (
    ("function", r"(?i)\bCALL\s+FUNCTION\s+'?([A-Za-z0-9_/]+)'?"), ("transaction", r"(?i)\bCALL\s+TRANSACTION\s+'?([A-Za-z0-9_/]+)'?"), ("method", r"(?i)\bCALL\s+METHOD\s+([A-Za-z0-9_/>=~-]+)"),
    ("perform", r"(?i)\bPERFORM\s+([A-Za-z0-9_/]+)"), ("submit", r"(?i)\bSUBMIT\s+([A-Za-z0-9_/]+)"), ("include", r"(?i)^\s*INCLUDE\s+([A-Za-z0-9_/]+)"), ("raise", r"(?i)\bRAISE\s+([A-Za-z0-9_/]+)"),
    ("message", r"(?i)^\s*MESSAGE\s+([A-Za-z][0-9]{3})\b"), ("authority", r"(?i)\bAUTHORITY-CHECK\s+OBJECT\s+'([A-Za-z0-9_/]+)'"),
)


def calls_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, line, kind, name) of calls, performs, submits, includes, messages and authority checks, by their statement's first line."""
    found = statements_of(sources, key, code).filter("not comment").select(key, "line", "text")

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), F.upper(n).alias("name")))

    each = F.concat(*(of_kind(k, p) for k, p in CALLS))
    return found.select(key, "line", F.inline(each))


def macros_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, line, name, resolved): macro calls, the first line of each name; resolved if the source DEFINEs it.

    A call is a statement whose first word is a name that the source defines, or one in upper case with an underscore that is
    no keyword and is followed by arguments alone.
    """
    found = statements_of(sources, key, code).filter("not comment").select(key, "line", "text")
    first = r"^\s*([A-Za-z][A-Za-z0-9_]*)(?=[\s.])(?!\s*(?:=|-|\())"
    defined = lines_of(sources, key, code).select(key, F.upper(F.regexp_extract("text", r"(?i)^\s*DEFINE\s+([A-Za-z0-9_]+)", 1)).alias("name")).filter("name <> ''").distinct().withColumn("resolved", F.lit(True))
    named = found.withColumn("word", F.regexp_extract("text", first, 1)).withColumn("name", F.upper("word")).filter("name <> ''").join(defined, [key, "name"], "left")
    looks = (F.col("word") == F.col("name")) & F.col("name").contains("_") & ~F.col("text").rlike("[=(]") & ~F.col("name").isin(*KEYWORDS)
    return named.filter(F.col("resolved") | looks).groupBy(key, "name").agg(F.min("line").alias("line"), F.coalesce(F.first("resolved"), F.lit(False)).alias("resolved")).select(key, "line", "name", "resolved")


def windows_of(sources: DataFrame, key: str = "source_key", code: str = "source_code") -> DataFrame:
    """(key, line, table_name, first, last) of each table access: up to five lines before it, 14 after, or from the nearest IF
    among those five to the ENDIF that follows within 40 lines."""
    numbers = lambda p: F.filter(F.transform("lines", lambda t, i: F.when(t.rlike(p), i + 1)), lambda n: n.isNotNull())
    shape = sources.select(key, _lines(F.col(code)).alias("lines")).select(key, F.size("lines").alias("n_lines"), numbers(r"(?i)^\s*IF\b").alias("ifs"), numbers(r"(?i)^\s*ENDIF\b").alias("ends"))
    found = accesses_of(sources, key, code).select(key, "line", "table_name").distinct().join(shape, key)
    first = F.greatest(F.lit(1), F.col("line") - 5)
    opened = F.array_max(F.filter("ifs", lambda n: (n >= first) & (n < F.col("line"))))
    closed = F.array_min(F.filter("ends", lambda n: (n >= F.col("line")) & (n <= F.col("line") + 40)))
    last = F.least("n_lines", F.col("line") + 14)
    return found.select(key, "line", "table_name", F.coalesce(opened, first).alias("first"), F.when(opened.isNotNull(), F.coalesce(closed, last)).otherwise(last).alias("last"))


def repair_lines(evidence: DataFrame, sources: DataFrame, key: str = "source_key") -> DataFrame:
    """evidence (key, line, quote) with fixed_line and status: exact, moved (found on one other line only) or mismatch.

    Sources are exploded into lines and joined on the trimmed line, so a source is never searched once a quote.
    """
    lines = lines_of(sources, key).select(key, F.col("line").alias("at"), F.trim("text").alias("trimmed"))
    one = lines.groupBy(key, "trimmed").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("only"), F.collect_set("at").alias("all"))
    out = evidence.withColumn("trimmed", F.trim("quote")).join(one, [key, "trimmed"], "left")
    exact = F.coalesce(F.array_contains("all", F.col("line")), F.lit(False))
    status = F.when(exact, "exact").when(F.col("n") == 1, "moved").otherwise("mismatch")
    return out.select(*evidence.columns, status.alias("status"), F.when(exact, F.col("line")).when(F.col("n") == 1, F.col("only")).alias("fixed_line"))

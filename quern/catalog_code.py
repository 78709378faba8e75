"""Queries over ABAP sources, each with its SQL.

The given tables hold no code, so a source is written for each part from three of BLOCKS, chosen by its key, with its key,
brand and size in them: some 1,700 different ones. The SQL finds the same in DuckDB by other means where there are any:
units by stepping through the opening and closing lines one by one, full stops by a look at the next token.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import query, table
from quern.operators import code, evidence

BLOCKS = (
    """FORM read_orders.
  SELECT * FROM vbak INTO TABLE lt WHERE vkorg = '{org}' AND auart = 'ZOR'.
  IF ls_item-matnr = '{matnr}'.
    CALL FUNCTION 'Z_SEND'.
  ENDIF.
ENDFORM.
""",
    """CLASS lcl_{k} DEFINITION.
  PUBLIC SECTION.
    METHODS run.
ENDCLASS.
CLASS lcl_{k} IMPLEMENTATION.
  METHOD run.
    lv_plant = '{size}'.
    SELECT SINGLE * FROM marc WHERE matnr = lv_matnr AND werks = lv_plant.
  ENDMETHOD.
  METHOD stop. PERFORM read_orders. ENDMETHOD.
    SUBMIT zreport.
  ENDMETHOD.
ENDCLASS.
""",
    """FUNCTION z_get_{k}.
  CONSTANTS c_type TYPE auart VALUE 'Z{size}'.
  DATA(lv_org) = '{org}'.
  SELECT vbeln FROM vbak WHERE vkorg = lv_org AND auart = c_type.
  MOVE '{brand}' TO lv_org.
  SELECT vbeln FROM vbap
    WHERE vkorg = lv_org
      AND kwmeng >= 1.5 AND matnr <> '{matnr}'.
ENDFUNCTION.
""",
    """MODULE status_0100 OUTPUT.
* FORM commented_out. 'C{size}'
  FORM not_nested.
  PERFORM fill_{k} USING 'A' 'B.C'.
  ENDFORM.
ENDMODULE.
""",
    """METHOD alone.
  WRITE 'it''s. {brand}'. WRITE: / 'x', 'two words'. " 'no. literal'
  METHOD inner.
  lv_factor = 2.5.
ENDMETHOD.
""",
    """* ranges
r_matnr-low = '{matnr}'. r_matnr-option = 'EQ'.
s_werks-high = 'W{size}'.
CASE sy-tcode.
  WHEN 'VA0{size}' OR 'VA02'.
    DELETE FROM zlog WHERE id = lv_id.
ENDCASE.
""",
    """  SELECT a~matnr, b~werks   " fields. 'of both'
    INTO TABLE lt_both
    FROM mara AS a
    WHERE kunnr BETWEEN '{k}' AND '9{k}'
      AND lifnr IN ('L1', 'L{size}').
""",
    """PARAMETERS p_vkorg TYPE vkorg DEFAULT '{org}'.
CONSTANTS c_auart TYPE vbak-auart VALUE 'ZOR'.
FORM use_constant.
  SELECT * FROM vbak WHERE auart = c_auart AND bukrs = lv_none.
ENDFORM.
""",
    """CALL TRANSACTION 'VA01' USING bdc.
CALL METHOD lo_{k}->run( ).
AUTHORITY-CHECK OBJECT 'V_VBAK_VKO' ID 'VKORG' FIELD '{org}'.
INCLUDE zinc_{size}.
IF '{org}' = ls_vbak-vkorg.
  UPDATE zstat SET done = 'X' WHERE id = '{matnr}'.
ENDIF.
""",
    """INSERT INTO ztab VALUES ls_tab.
MODIFY ztab FROM ls_tab. MODIFY lt_tab FROM ls_tab.
INSERT ls_x INTO TABLE lt_x.
Z_MACRO lv_{k} lv_b.
""",
    """IF sy-subrc <> 0.
  MOVE '{size}' TO ls_item-werks.
  mestyp = 'ORDERS'. idoctp = 'ORDERS05'.
  PERFORM write_log IN PROGRAM zlog.

  RAISE not_found.
ENDIF.
""",
    """FORM open_end.
  lv_kschl = 'PR0{size}'.
  PERFORM read_orders.
  SELECT * FROM konv WHERE kschl = lv_kschl.
""",
)
PLACES = {"{org}": "(1000 + p_partkey % 7)::varchar", "{matnr}": "lpad(p_partkey::varchar, 18, '0')", "{k}": "p_partkey::varchar", "{size}": "p_size::varchar", "{brand}": "p_brand"}


def sources(spark, sf):
    """A source for each part, written from its row."""
    key, blocks = F.col("p_partkey"), F.array(*map(F.lit, BLOCKS))
    pick = lambda n: F.element_at(blocks, (F.floor(n) % len(BLOCKS) + 1).cast("int"))
    text = F.concat(F.concat(F.lit("REPORT z"), key.cast("string"), F.lit(".\n")), pick(key), pick(key / 12), pick(key * 7 / 5))
    values = {"{org}": (1000 + key % 7).cast("string"), "{matnr}": F.lpad(key.cast("string"), 18, "0"), "{k}": key.cast("string"), "{size}": F.col("p_size").cast("string"), "{brand}": F.col("p_brand")}
    for mark, value in values.items():
        text = F.replace(text, F.lit(mark), value)
    # a part's row is small and its source isn't: rows are dealt by number before they are written out
    parts = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(F.concat(F.lit("S"), key.cast("string")).alias("source_key"), text.alias("source_code"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _source_sql() -> str:
    pick = "blocks[({n}) % " + str(len(BLOCKS)) + " + 1]"
    text = f"'REPORT z' || p_partkey || '.' || chr(10) || {pick.format(n='p_partkey')} || {pick.format(n='p_partkey // 12')} || {pick.format(n='p_partkey * 7 // 5')}"
    for mark, value in PLACES.items():
        text = f"replace({text}, '{mark}', {value})"
    return f"""src as (select 'S' || p_partkey as source_key, {text} as source_code from part cross join (select [{', '.join(map(_quoted, BLOCKS))}] as blocks)),
    ln as (select source_key, unnest(string_split(source_code, chr(10))) as t, unnest(range(1, len(string_split(source_code, chr(10))) + 1)) as line from src)"""


SOURCES = _source_sql()
#: Tokens: a full stop before a digit of the same line is none of a statement's end.
STATEMENTS = SOURCES + r""",
    tk as (select source_key, line, regexp_matches(t, '^\s*[*"]') as comment, unnest(regexp_extract_all(t, '''[^'']*(?:''''[^'']*)*''?|"[^\n]*|\.|[^''".]+')) as token,
        unnest(range(len(regexp_extract_all(t, '''[^'']*(?:''''[^'']*)*''?|"[^\n]*|\.|[^''".]+')))) as pos from ln),
    nx as (select *, lead(token) over (partition by source_key, line order by pos) as following from tk where comment or not starts_with(token, '"')),
    st as (select *, case when pos = 0 and line > 1 then chr(10) || token else token end as word, case when comment then -line else
        coalesce(sum((token = '.' and not comment and not regexp_matches(coalesce(following, ''), '^[0-9]'))::int) over (partition by source_key order by line, pos rows between unbounded preceding and 1 preceding), 0) end as stmt from nx),
    wd as (select *, coalesce(sum(length(word)) over (partition by source_key, stmt order by line, pos rows between unbounded preceding and 1 preceding), 0) as begin_at from st),
    sm as (select source_key, stmt, comment, min(line) filter (where trim(token) <> '') as line, string_agg(word, '' order by line, pos) as text from wd group by source_key, stmt, comment having min(line) filter (where trim(token) <> '') is not null)"""
KINDS = " ".join(
    rf"when regexp_matches(t, '^\s*{k}\s+[/A-Za-z_][/A-Za-z0-9_]*\s*{more}', 'i') then '{k}'"
    for k, more in (("FUNCTION", ""), ("FORM", r"\b"), ("MODULE", r"\b"), ("CLASS", r"\s+(?:IMPLEMENTATION|DEFINITION)\b"), ("METHOD", r"\b"))
)
UNITS = (
    SOURCES
    + rf""",
    ev as (select *, row_number() over (partition by source_key order by line) as n from (select source_key, line, case {KINDS} end as opens, nullif(upper(regexp_extract(t, '^\s*END(FUNCTION|FORM|MODULE|CLASS|METHOD)\b', 1, 'i')), '') as ends,
        upper(regexp_extract(t, '^\s*[A-Za-z]+\s+([/A-Za-z_][/A-Za-z0-9_]*)', 1)) as name, regexp_matches(t, '^\s*CLASS\s+\S+\s+IMPLEMENTATION\b', 'i') as holds from ln) where opens is not null or ends is not null),
    walk as (select source_key, 0::bigint as n, []::struct(k varchar, name varchar, line bigint, holds boolean)[] as stack, null::struct(k varchar, name varchar, line bigint, holds boolean) as done, null::bigint as ended, null::varchar as parent from src
        union all select w.source_key, e.n, case when len(stack) > 0 and stack[-1].k = e.ends then stack[:-2] when e.opens is not null and (len(stack) = 0 or e.opens = 'METHOD' and len([x for x in stack if x.holds]) > 0)
            then list_append(stack, {{'k': e.opens, 'name': e.name, 'line': e.line, 'holds': e.holds}}) else stack end,
            case when len(stack) > 0 and stack[-1].k = e.ends then stack[-1] end, e.line, case when len(stack) > 1 and stack[-1].k = e.ends then stack[-2].name end
            from walk w join ev e on e.source_key = w.source_key and e.n = w.n + 1),
    rest as (select source_key, stack, (select max(line) from ln where ln.source_key = l.source_key) as n_lines, range(1, len(stack) + 1) as places from (select *, row_number() over (partition by source_key order by n desc) as r from walk) l where r = 1),
    un as (select source_key, done.k as unit_type, done.name as unit_name, done.line as start_line, ended as end_line, parent from walk where done is not null
        union all select source_key, stack[i].k, stack[i].name, stack[i].line, n_lines, case when i > 1 then stack[i - 1].name end from (select *, unnest(places) as i from rest))"""
)
#: Field, role and whether a literal with `b` before it on its line and `a` after it in its statement is bound to it.
FIELDS = {
    "MATNR": "material_number", "KUNNR": "customer_number", "LIFNR": "vendor_number", "WERKS": "plant", "LGORT": "storage_location", "VKORG": "sales_org", "VTWEG": "distr_channel",
    "SPART": "division", "BUKRS": "company_code", "AUART": "order_type", "BSART": "order_type", "KSCHL": "condition_type", "MESTYP": "message_type", "IDOCTP": "idoc_type",
}
BOUND = r"""select source_key, line, pos, '@f' as field, '@r' as role, @p as place from lit where contains(upper(b || ' ' || a), '@f') and (
    regexp_matches(b, '\b(?:[A-Z0-9_]+-)?@f\b\s*(?:=|EQ|NE|CP|IN)\s*$', 'i') or regexp_matches(b, '\b(?:[A-Z0-9_]+-)?@f\b[^.]{0,100}?\b(?:IN|BETWEEN)\b[^.]{0,120}?$', 'i')
    or regexp_matches(b, '\b(?:[A-Z0-9_]*@f[A-Z0-9_]*)-(?:LOW|HIGH)\s*=\s*$', 'i') or regexp_matches(b, '\b[A-Z0-9_]*@f[A-Z0-9_]*\b[^.\n]{0,80}?\bdefault\s+$', 'i')
    or regexp_matches(b, '\b(?:TYPE|LIKE)\s+[A-Z0-9_-]*@f\b[^.\n]{0,40}?\bVALUE\s+$', 'i') or regexp_matches(a, '^\s*(?:=|EQ|NE)\s*(?:[A-Z0-9_]+-)?@f\b', 'i')
    or regexp_matches(b, '\bMOVE\s+$', 'i') and regexp_matches(a, '^\s+TO\s+[^.\n]*\b@f\b', 'i') or regexp_matches(b, '\blow\s*=\s*$', 'i') and regexp_matches(a, '^[^.]{0,120}?\b(?:[A-Z0-9_]*@f)', 'i'))"""
LITERALS = (
    STATEMENTS
    + r""",
    raw as (select w.source_key, w.line, w.comment, w.pos, replace(regexp_extract(token, '^''(.*?)''?$', 1), '''''', '''') as value, string_split(substr(text, 1, (begin_at + length(word) - length(token))::bigint), chr(10))[-1] as b, substr(text, (begin_at + length(word) + 1)::bigint) as a
        from wd w join sm s on s.source_key = w.source_key and s.stmt = w.stmt and s.comment = w.comment where starts_with(token, '''')),
    lit as (select * from raw where regexp_matches(value, '\S') and length(value) <= 60 and not regexp_matches(value, '^(?:true|false|abap_true|abap_false|x|space|initial|sy-uname|sy-datum|NAME1|ORT01|ARKTX|ERNAM|ERDAT|AEDAT)$', 'i')),
    fb as (@fields@),
    bd as (select source_key, line, pos, string_agg(field, ',' order by place) as fields, list(role order by place) as roles from fb group by all),
    found as (select distinct l.source_key, l.line, value, case when regexp_matches(trim(value), '^[0-9]+$') then coalesce(nullif(ltrim(trim(value), '0'), ''), '0') else upper(trim(value)) end as normalized,
        case when regexp_matches(b, '\bCALL\s+FUNCTION\b', 'i') then 'function_module' when regexp_matches(b, '\bCALL\s+TRANSACTION\b', 'i') then 'transaction' when regexp_matches(b || ' ' || a, '\b(?:MESTYP|MESSAGE\s+TYPE)\b', 'i') then 'message_type'
            when regexp_matches(b || ' ' || a, '\bIDOCTP\b', 'i') then 'idoc_type' when regexp_matches(value, '^[0-9]+$') then 'numeric' when length(value) = 1 then 'char' else 'string' end as kind,
        coalesce(fields, '') as fields, case when fields is null then 'generic_literal' else array_to_string(list_distinct(roles), ',') end as roles, comment from lit l left join bd on bd.source_key = l.source_key and bd.line = l.line and bd.pos = l.pos)"""
).replace("@fields@", " union all ".join(BOUND.replace("@f", f).replace("@r", r).replace("@p", str(n)) for n, (f, r) in enumerate(FIELDS.items())))
ACCESSES = (
    STATEMENTS
    + r""",
    cd as (select source_key, stmt, line, text from sm where not comment),
    acc as (select source_key, stmt, line, 'read' as operation, upper(regexp_extract(text, '\bFROM\s+([/A-Za-z_][/A-Za-z0-9_]*)\b', 1, 'is')) as table_name, text from cd where regexp_matches(text, '\bSELECT\b', 'i')
        union all select source_key, stmt, line, lower(op), upper(case when upper(op) = 'UPDATE' then regexp_extract(text, '\bUPDATE\s+([/A-Za-z_][/A-Za-z0-9_]*)\s+SET\b', 1, 'i') else regexp_extract(text, '\b(?:INSERT|MODIFY|DELETE)\b\s+(?:FROM\s+)?(?:INTO\s+)?(?:TABLE\s+)?([/A-Za-z_][/A-Za-z0-9_]*)\b', 1, 'i') end), text
            from (select *, regexp_extract(text, '^\s*(UPDATE|INSERT|MODIFY|DELETE)\b', 1, 'i') as op from cd) where op <> ''),
    ac as (select source_key, stmt, line, operation, table_name, case when operation in ('read', 'update', 'delete') then trim(regexp_replace(regexp_extract(text, '\bWHERE\b(.*?)\.?\s*$', 1, 'is'), '\s+', ' ', 'g')) else '' end as condition
        from acc where table_name <> '' and not regexp_matches(table_name, '^(L_|G_|LT_|GT_|LS_|GS_|IT_|IS_|WA_|<|SY)') and table_name not in ('ADJACENT', 'SET', 'INTO', 'CORRESPONDING'))"""
)
CALLS = STATEMENTS + ", cl as (" + " union all ".join(rf"select source_key, line, '{k}' as kind, upper(unnest(regexp_extract_all(text, '{p}', 1))) as name from sm where not comment" for k, p in (
    ("function", r"(?i)\bCALL\s+FUNCTION\s+''?([A-Za-z0-9_/]+)''?"), ("transaction", r"(?i)\bCALL\s+TRANSACTION\s+''?([A-Za-z0-9_/]+)''?"), ("method", r"(?i)\bCALL\s+METHOD\s+([A-Za-z0-9_/>=~-]+)"), ("perform", r"(?i)\bPERFORM\s+([A-Za-z0-9_/]+)"),
    ("submit", r"(?i)\bSUBMIT\s+([A-Za-z0-9_/]+)"), ("include", r"(?i)^\s*INCLUDE\s+([A-Za-z0-9_/]+)"), ("raise", r"(?i)\bRAISE\s+([A-Za-z0-9_/]+)"), ("message", r"(?i)^\s*MESSAGE\s+([A-Za-z][0-9]{3})\b"), ("authority", r"(?i)\bAUTHORITY-CHECK\s+OBJECT\s+''([A-Za-z0-9_/]+)''"),
)) + ")"


@query(f"with recursive {UNITS} select * from un")
def code_units(spark, sf):
    return code.units_of(sources(spark, sf))


@query(f"with {LITERALS} select * from found")
def code_literals(spark, sf):
    return code.literals_of(sources(spark, sf))


@query(rf"""with {LITERALS}, mat as (select *, trim(value) as v from raw where regexp_matches(value, '\S') and regexp_matches(b || ' ' || a, '\b(?:[A-Z0-9_]+-)?[A-Z0-9_]*MATNR\b|\bMATNR_', 'i')),
    why as (select *, case when length(v) > 40 then 'too_long' when regexp_matches(v, '^(19|20)[0-9]{{2}}((0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01]))?$') then 'date_or_year' when lower(v) in ('true', 'false', 'abap_true', 'abap_false', 'x', 'space', 'initial') then 'boolean'
        when regexp_matches(v, '-(MATNR|LOW|HIGH|SIGN|OPTION)$', 'i') then 'field_name_literal' when regexp_matches(v, '^SAP[A-Z0-9_]+$', 'i') then 'program_name' when upper(v) in ('NAME1', 'ORT01', 'KUNNR', 'LIFNR', 'WERKS', 'ARKTX', 'ERNAM', 'ERDAT', 'MATNR') then 'ddic_field_name'
        when upper(v) in ('MATERIAL', '0MATERIAL') then 'semantic_token' when regexp_matches(v, '^[0-9]{{1,3}}$') then 'too_short_numeric' when regexp_matches(v, '^[0-9]{{19,}}$') then 'too_long_numeric'
        when not (regexp_matches(v, '^[0-9]{{4,18}}$') or (regexp_matches(v, '^[A-Z0-9]{{4,18}}$', 'i') and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]', 'i'))) then 'not_material_shaped'
        when regexp_matches(b, '\bFIELDNAME\s+(?:EQ|=)\s*$|\bBDC_FIELD\s+USING\s+$|\b(?:KSCHL|MSGTY|MSGNO|AUART|BSART|VBTYP|VTWEG|SPART|VKORG)\b\s*(?:=|EQ|NE)\s*$|\b(?:FKDAT|BUDAT|ERDAT|AEDAT|FBUDA|DATUM|DATAB|DATBI)\b[^.\n]{{0,60}}default\s+$', 'i') then 'bound_to_other_field'
        when fb.field is null then 'not_bound' else 'operand_of_field' end as reason from mat left join (select source_key as k, line as n, pos as p, field from fb where field = 'MATNR') fb on fb.k = source_key and fb.n = line and fb.p = pos)
    select distinct source_key, line, case when regexp_matches(v, '^[0-9]+$') then v else upper(v) end as value, reason = 'operand_of_field' as accepted, reason, comment from why""")
def material_literals(spark, sf):
    """Accepted and rejected material numbers, each with its reason."""
    return code.materials_of(sources(spark, sf))


@query(f"with {ACCESSES} select source_key, line, operation, table_name, condition from ac")
def code_accesses(spark, sf):
    return code.accesses_of(sources(spark, sf)).drop("stmt")


@query(rf"""with recursive {ACCESSES}, {UNITS.removeprefix(SOURCES + ',')},
    pt as (select source_key, stmt, line, operation, table_name, unnest(string_split_regex(condition, '(?i)\bAND\b')) as part from ac where condition <> ''),
    cn as (select *, row_number() over () as id from (select source_key, stmt, line, operation, table_name, upper(g1) as field, upper(g2) as op, regexp_replace(g3, '[.,;]+$', '') as rhs from
        (select *, regexp_extract(part, '^\s*([/A-Za-z_][/A-Za-z0-9_]*)\s*(EQ|NE|<>|<=|>=|LT|GT|LE|GE|=|<|>)\s*(.+?)\s*$', 1, 'i') as g1, regexp_extract(part, '^\s*([/A-Za-z_][/A-Za-z0-9_]*)\s*(EQ|NE|<>|<=|>=|LT|GT|LE|GE|=|<|>)\s*(.+?)\s*$', 2, 'i') as g2, regexp_extract(part, '^\s*([/A-Za-z_][/A-Za-z0-9_]*)\s*(EQ|NE|<>|<=|>=|LT|GT|LE|GE|=|<|>)\s*(.+?)\s*$', 3, 'i') as g3 from pt) where g1 <> '')),
    asg as (select source_key, stmt, line, upper(coalesce(nullif(regexp_extract(x, '^\s*(?:DATA\()?([A-Za-z_][A-Za-z0-9_]*)\)?\s*=\s*(?:''(?:[^'']|'''')*''|-?[0-9]+(?:\.[0-9]+)?)\s*\.?$', 1, 'i'), ''), nullif(regexp_extract(x, '^\s*MOVE\s+''(?:[^'']|'''')*''\s+TO\s+([A-Za-z_][A-Za-z0-9_]*)\s*\.?$', 1, 'i'), ''),
            nullif(regexp_extract(x, '^\s*(?:CONSTANTS|DATA)\s*:?\s*([A-Za-z_][A-Za-z0-9_]*)\b[^'']*\bVALUE\s+''(?:[^'']|'''')*''\s*\.?$', 1, 'i'), ''))) as variable,
            coalesce(nullif(regexp_extract(x, '''(.*)''', 1), ''), regexp_extract(x, '=\s*(-?[0-9.]*[0-9])', 1)) as value from (select source_key, stmt, line, trim(regexp_replace(text, '\s+', ' ', 'g')) as x from sm where not comment)),
    inu as (select c.source_key, c.line, max_by(u.unit_name, u.start_line) as unit_name from (select source_key, line from cn union select source_key, line from asg where variable is not null) c join un u on u.source_key = c.source_key and c.line between u.start_line and u.end_line group by all),
    use as (select c.*, i.unit_name, case when op = 'EQ' then '=' when op = 'NE' then '<>' else op end as operator, case when regexp_matches(rhs, '^''.*''$') or regexp_matches(rhs, '^-?[0-9]+(?:\.[0-9]+)?$') then 'literal' else 'variable' end as value_kind,
        case when regexp_matches(rhs, '^''.*''$') then replace(rhs[2:-2], '''''', '''') else rhs end as raw_value from cn c left join inu i using (source_key, line)),
    own as (select u.id, max_by(a.value, a.stmt) as value from use u join asg a on a.source_key = u.source_key and a.variable = upper(u.raw_value) and a.stmt < u.stmt left join inu i on i.source_key = a.source_key and i.line = a.line where i.unit_name is not distinct from u.unit_name group by 1),
    outside as (select u.id, max_by(a.value, a.stmt) as value from use u join asg a on a.source_key = u.source_key and a.variable = upper(u.raw_value) and a.stmt < u.stmt left join inu i on i.source_key = a.source_key and i.line = a.line where i.unit_name is null group by 1)
    select source_key, line, operation, table_name, unit_name, field, operator, value_kind, raw_value, case when value_kind = 'literal' then raw_value else coalesce(own.value, outside.value) end as resolved from use left join own using (id) left join outside using (id)""")
def code_conditions(spark, sf):
    """Values of a WHERE, variables with what was last assigned to them."""
    return code.conditions_of(sources(spark, sf))


@query(f"with {CALLS} select * from cl")
def code_calls(spark, sf):
    return code.calls_of(sources(spark, sf))


@query(f"with {LITERALS} select normalized as value, count(*) as n, min(source_key) as first_source from found where not comment and list_contains(string_split(roles, ','), 'sales_org') group by 1")
def literal_lookup(spark, sf):
    found = code.literals_of(sources(spark, sf)).filter(F.array_contains(F.split("roles", ","), "sales_org") & ~F.col("comment"))
    return found.groupBy(F.col("normalized").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("source_key").alias("first_source"))


@query(f"""with {LITERALS}, o as (select normalized, comment, source_key || '|' || line as place from found where list_contains(string_split(fields, ','), 'MATNR'))
    select normalized, count(*) filter (where not comment) as n_active, count(*) filter (where comment) as n_comment, count(distinct place) filter (where not comment) as n_places, min(place) filter (where not comment) as first_place, count(*) filter (where not comment) > 1 as multi_use from o group by 1 having count(*) filter (where not comment) > 0""")
def hardcoded_inventory(spark, sf):
    found = code.literals_of(sources(spark, sf)).filter(F.array_contains(F.split("fields", ","), "MATNR")).withColumn("active", ~F.col("comment"))
    return evidence.hardcoded_inventory(found, "normalized", "active", ["source_key", "line"])


@query(f"""with recursive {CALLS}, {UNITS.removeprefix(SOURCES + ',')}, t as (select unit_name as name, min(source_key || '|' || unit_name) as callee from un group by 1)
    select source_key, line, kind, name as called, callee from cl left join t using (name)""")
def callee_resolution(spark, sf):
    found = sources(spark, sf)
    units = code.units_of(found).withColumn("id", F.concat_ws("|", "source_key", "unit_name"))
    return evidence.callees(code.calls_of(found).withColumnRenamed("name", "called"), units, "unit_name", "id")


@query(rf"""with {ACCESSES}, a as (select distinct source_key, line, table_name from ac), n as (select source_key, max(line) as n_lines from ln group by 1), i as (select source_key, line as pos from ln where regexp_matches(t, '^\s*IF\b', 'i')), e as (select source_key, line as pos from ln where regexp_matches(t, '^\s*ENDIF\b', 'i')),
    o as (select a.*, n_lines, (select max(pos) from i where i.source_key = a.source_key and pos between greatest(1, a.line - 5) and a.line - 1) as opened, (select min(pos) from e where e.source_key = a.source_key and pos between a.line and a.line + 40) as closed from a join n using (source_key))
    select source_key, line, table_name, coalesce(opened, greatest(1, line - 5)) as first, case when opened is not null then coalesce(closed, least(n_lines, line + 14)) else least(n_lines, line + 14) end as last from o""")
def access_windows(spark, sf):
    return code.windows_of(sources(spark, sf))

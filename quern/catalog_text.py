"""More queries of the catalogue: text functions, sources, and operators on evidence, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.catalog import BM25, EDGES, RANK, TERMS, TOKENS, graph_edges, query, rounded, table
from quern.functions import question
from quern.functions import text as X
from quern.operators import evidence, gate, graph, grounding, incremental, index, link, masterdata, profile, rules, search, selection, stored_index, vectors
from quern.session import materialize, scratch_path
from quern.sources import jsonl

# Words

WORDS = """w as (select distinct unnest([x for x in regexp_split_to_array(coalesce(text, ''), '[^A-Za-zÄÖÜäöüß0-9_/.-]+') if x <> '']) as word from documents),
    f as (select word, replace(lower(strip_accents(word)), 'ß', 'ss') as t from w)"""
ROOT = "regexp_matches(left(t, length(t) - {n}), '(uell|isch|iv|ig|lich)$')"
STEM = " ".join(f"when ends_with(t, '{e}') and length(t) >= {4 + len(e)} and (length(t) >= {5 + len(e)} or {ROOT.format(n=len(e))}) then left(t, length(t) - {len(e)})" for e in X.ADJECTIVE_ENDINGS)
TAILS = ", ".join(f"'{t.replace('ü', 'u')}'" for t in X.COMPOUND_TAILS)


def words(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.array_distinct(X.raw_words("text"))).alias("word")).distinct()


@query(f"""with {WORDS}, s as (select word, t, case when length(t) < 4 then t {STEM} else t end as b from f)
    select word, case when length(t) >= 4 and length(b) >= 6 and ends_with(b, 's') and not ends_with(b, 'ss') then left(b, length(b) - 1) else b end as stem from s""")
def word_stems(spark, sf):
    return words(spark, sf).select("word", X.light_stem("word").alias("stem"))


@query(f"""with {WORDS}, c as (select word, t, [x for x in [{TAILS}] if ends_with(t, x) and length(t) > length(x) + 3] as hits from f)
    select word, array_to_string(list_sort(list_distinct(list_concat(list_concat(case when length(t) >= 4 then [t] else [] end, [left(t, length(t) - length(x)) for x in hits]), list_concat(hits, [p for p in regexp_split_to_array(t, '[_./-]+') if length(p) >= 3])))), '|') as parts from c""")
def word_parts(spark, sf):
    return words(spark, sf).select("word", F.array_join(F.array_sort(X.compound_parts("word")), "|").alias("parts"))


@query("""with t as (select p_partkey, regexp_replace(upper(p_name || ' ' || p_size), '[^A-Z0-9]', '', 'g') as t, regexp_replace(upper(left(p_name, p_size % 4)), '[^A-Z0-9]', '', 'g') as s from part)
    select p_partkey, array_to_string([substr(t, i, 3) for i in range(1, length(t) - 1)], '|') as trigrams, case when length(s) >= 3 then array_to_string([substr(s, i, 3) for i in range(1, length(s) - 1)], '|') else s end as short from t""")
def name_trigrams(spark, sf):
    whole, short = F.concat_ws(" ", "p_name", F.col("p_size").cast("string")), F.substring("p_name", F.lit(1), F.col("p_size") % 4)
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.char_trigrams(whole), "|").alias("trigrams"), F.array_join(X.char_trigrams(short), "|").alias("short"))


SPLIT = "[^a-z0-9äöüßàáâãåçèéêëìíîïñòóôõùúûýÿ_/-]+"
FOLDED = f"translate(replace(replace(replace(replace(x, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '{X.ACCENTED}', '{X.BASE}')"


@query(f"""with w as (select doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '{SPLIT}') if length(x) >= 2] as ws from documents),
    p as (select doc_id, list_concat(list_concat(ws, [{FOLDED} for x in ws]), list_concat([y for y in flatten([regexp_split_to_array(x, '[_/-]+') for x in ws]) if length(y) >= 4], [regexp_replace(x, '[_/-]+', '', 'g') for x in ws if regexp_matches(x, '[_/-]')])) as ts from w)
    select doc_id, len(list_distinct(ts)) as n_tokens, sha256(array_to_string(list_sort(list_distinct(ts)), ' ')) as tokens_hash from p""")
def search_token_sets(spark, sf):
    tokens = table(spark, sf, "documents").select("doc_id", X.search_tokens("text").alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("tokens_hash"))


@query(f"with d as (select {TOKENS} as toks from documents), p as (select unnest([toks[i] || ' ' || toks[i + 1] for i in range(1, len(toks))]) as pair from d) select pair, count(*) as n from p group by pair having count(*) >= 3")
def word_pair_counts(spark, sf):
    pairs = table(spark, sf, "documents").select(F.explode(X.word_pairs(X.bm25_tokens("text"))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query(f"with d as (select doc_id, list_distinct([x for x in {TOKENS} if x not in ({', '.join(repr(w) for w in X.STOPWORDS)})]) as ts from documents) select doc_id, len(ts) as n_terms, sha256(array_to_string(list_sort(ts), ' ')) as terms_hash from d")
def query_terms(spark, sf):
    terms = table(spark, sf, "documents").select("doc_id", X.content_terms("text").alias("t"))
    return terms.select("doc_id", F.size("t").alias("n_terms"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("terms_hash"))


@query("""with w as (select p_partkey, list_distinct(regexp_split_to_array(p_name || ' ' || p_name || 's ' || lower(p_type), ' ')) as ts from part)
    select p_partkey, array_to_string(list_sort([t for t in ts if length(t) < 4 or len([o for o in ts if o <> t and starts_with(o, t)]) = 0]), '|') as terms from w""")
def longest_terms(spark, sf):
    terms = F.array_distinct(F.split(F.concat(F.col("p_name"), F.lit(" "), F.col("p_name"), F.lit("s "), F.lower("p_type")), " "))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(X.drop_prefixes(terms)), "|").alias("terms"))


@query("select p_partkey, k, v from part cross join lateral (values ('size', (p_size + 1)::varchar), ('type', p_type)) as x(k, v)")
def metadata_pairs(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("size="), size, F.lit("; type = "), F.col("p_type"), F.lit(" ;size="), (F.col("p_size") + 1).cast("string"), F.lit(";x"))
    return table(spark, sf, "part").select("p_partkey", F.explode(X.key_value_map(text)).alias("k", "v"))


@query("select p_partkey, p_brand as table_part, case when p_size > 25 then p_type end as field_part from part")
def source_key_parts(spark, sf):
    key = F.concat_ws("|", F.lit("S1"), F.lit("TABLE"), "p_brand", F.when(F.col("p_size") > 25, F.concat(F.lit("FIELD|"), F.col("p_type"))))
    return table(spark, sf, "part").select("p_partkey", X.source_key_part(key, "TABLE").alias("table_part"), X.source_key_part(key, "FIELD").alias("field_part"))


# Questions, written from the parts

QUESTION = """case p_partkey % 5 when 0 then 'Wo ist MATNR = 00' || p_partkey || ' in ZCL_' || p_type || '=>SEND_' || p_size || ' hart codiert?' when 1 then 'Steht "' || p_brand || '" fest im Code von z_part' || p_size || '?'
    when 2 then 'Wie viele ' || p_name || ' mit VBAK-VKORG ' || p_size || '?' when 3 then 'VKORG ' || (p_size * 100) || ' fest? TABLE ORDERS05' else upper(p_name) || ' und ' || p_type || ' - ' || p_type end"""
STOP = ", ".join(f"'{w}'" for w in X.NO_SYMBOLS)
SYMBOLS = f"""q as (select p_partkey, {QUESTION} as q from part),
    pr as (select p_partkey, q, list_zip(regexp_extract_all(q, '\\b([A-Z][A-Z0-9_]{{2,}})\\s*[-.]\\s*([A-Z][A-Z0-9_]{{2,}})\\b', 1), regexp_extract_all(q, '\\b([A-Z][A-Z0-9_]{{2,}})\\s*[-.]\\s*([A-Z][A-Z0-9_]{{2,}})\\b', 2)) as z,
      '\\b([A-Z][A-Z0-9_/]{{2,}})\\s*(?:=>|->)\\s*([A-Z][A-Z0-9_~/]{{2,}})\\b' as path from q),
    fam as (select p_partkey, q, unnest([{{'k': 1, 'kind': 'method_path', 's': regexp_extract_all(q, path, 0)}}, {{'k': 2, 'kind': 'uppercase_token', 's': list_concat(regexp_extract_all(q, path, 1), regexp_extract_all(q, path, 2))}},
      {{'k': 3, 'kind': 'compound_field', 's': [x[1] || '-' || x[2] for x in z]}}, {{'k': 4, 'kind': 'uppercase_token', 's': list_concat([x[1] for x in z], [x[2] for x in z])}},
      {{'k': 5, 'kind': 'zy_name', 's': regexp_extract_all(q, '\\b([ZzYy]{{1,2}}_?[A-Za-z0-9_]{{2,}})\\b', 1)}}, {{'k': 6, 'kind': 'uppercase_token', 's': [x for x in regexp_extract_all(q, '\\b([A-Z][A-Z0-9_]{{2,}})\\b', 1) if length(x) >= 4 or regexp_matches(x, '[0-9]')]}}]) as f from pr),
    one as (select p_partkey, k, kind, pos, trim(raw) as raw, upper(trim(raw)) as norm from (select p_partkey, f.k as k, f.kind as kind, unnest(f.s) as raw, unnest(range(len(f.s))) as pos from fam)),
    sy as (select p_partkey, norm, arg_min(kind, k * 1000 + pos) as kind, arg_min(raw, k * 1000 + pos) as raw from one where norm not in ({STOP}) group by all)"""


def questions(spark, sf):
    cases = [("0", "concat('Wo ist MATNR = 00', p_partkey, ' in ZCL_', p_type, '=>SEND_', p_size, ' hart codiert?')"), ("1", "concat('Steht \"', p_brand, '\" fest im Code von z_part', p_size, '?')"), ("2", "concat('Wie viele ', p_name, ' mit VBAK-VKORG ', p_size, '?')"), ("3", "concat('VKORG ', p_size * 100, ' fest? TABLE ORDERS05')")]
    text = "case p_partkey % 5 " + " ".join(f"when {k} then {v}" for k, v in cases) + " else concat(upper(p_name), ' und ', p_type, ' - ', p_type) end"
    return table(spark, sf, "part").select("p_partkey", F.expr(text).alias("q"))


@query(f"with {SYMBOLS} select p_partkey, norm, kind from sy")
def question_symbols(spark, sf):
    return questions(spark, sf).select("p_partkey", F.explode(X.symbol_matches("q")).alias("m")).select("p_partkey", "m.norm", "m.kind")


NONE = ", ".join(f"'{w}'" for w in question.NO_LITERALS)
FIELD = "'(?i)\\b([A-Z][A-Z0-9_]{2,})\\s*[=:]?\\s*[''\"]?([A-Z0-9_]{2,}|[0-9]{2,})[''\"]?'"


@query(f"""with {SYMBOLS},
    c as (select p_partkey, q, regexp_matches(q, '(?i)\\b(hart\\s*codiert|hartcodiert|hard\\s*cod(?:ed|ing)?|fest\\s*(?:verdrahtet|codiert|im\\s+code)|konstanten?|fest\\s+im\\s+code|stehen\\s+fest)\\b') as cue, [x for x in list_zip(regexp_extract_all(q, {FIELD}, 1), regexp_extract_all(q, {FIELD}, 2)) if upper(x[1]) not in ({NONE})] as b from q),
    u as (select p_partkey, list(raw) as syms from sy where kind = 'uppercase_token' or norm in ('ORDERS', 'ORDRSP', 'DESADV', 'INVOIC', 'DELVRY', 'WMMBXY') or regexp_full_match(norm, 'Z[A-Z0-9]{{3,}}') group by 1),
    v as (select p_partkey, q, cue, list_distinct([upper(x[1]) for x in b if upper(x[1]) in ({', '.join(f"'{f}'" for f in question.BOUND_FIELDS)})]) as fields,
      list_distinct([x for x in list_concat(list_concat([x[2] for x in b], regexp_extract_all(q, '\\b([0-9]{{3,}})\\b', 1)), list_concat([trim(x) for x in regexp_extract_all(q, '[''"]([^''"]{{1,64}})[''"]', 1)], case when cue then coalesce(syms, []) else [] end)) if length(x) >= 2 and upper(x) not in ({NONE})]) as vals from c left join u using (p_partkey))
    select p_partkey, len(vals) > 0 and (cue or (len(fields) > 0 and regexp_matches(q, '(?i)fest|hart|code'))) as is_literal, array_to_string(list_sort(vals), '|') as vals, array_to_string(list_sort(fields), '|') as fields from v""")
def question_literals(spark, sf):
    found = questions(spark, sf).select("p_partkey", question.literals(F.col("q")).alias("l"))
    return found.select("p_partkey", "l.is_literal", F.array_join(F.array_sort("l.values"), "|").alias("vals"), F.array_join(F.array_sort("l.fields"), "|").alias("fields"))


@query("""with n as (select p_partkey, upper(p_type) as plain, 'Z' || upper(p_type) as zed, '/NS/' || p_size as spaced, 'A_Z' || p_size as inner_ from part) select p_partkey, regexp_matches(plain, '^(Z|Y)|_Z|^/') as plain, true as zed, true as spaced, true as inner_ from n""")
def custom_names(spark, sf):
    size = F.col("p_size").cast("string")
    names = {"plain": F.col("p_type"), "zed": F.concat(F.lit("z"), F.col("p_type")), "spaced": F.concat(F.lit("/NS/"), size), "inner_": F.concat(F.lit("a_z"), size)}
    return table(spark, sf, "part").select("p_partkey", *(X.is_custom_name(c).alias(n) for n, c in names.items()))


TOPIC = " ".join(f"when ends_with(n, '{e}') and length(n) >= {4 + len(e)} then left(n, length(n) - {len(e)})" for e in X.TOPIC_ENDINGS)


@query(f"""with {WORDS}, s as (select word, regexp_replace(strip_accents(replace(lower(word), 'ß', '')), '[^a-z0-9]+', '', 'g') as n from w) select word, case when length(n) < 5 then n {TOPIC} else n end as stem from s""")
def topic_stems(spark, sf):
    return words(spark, sf).select("word", X.topic_stem("word").alias("stem"))


@query("""with m as (select p_partkey, lower(p_type) as field, p_brand as tbl, upper('Z_' || p_type) as tech, p_name as title from part)
    select p_partkey, case when contains(tech, 'Z_PROMO') or contains(tech, 'STANDARD') then 100 else 0 end
      + case when contains(field, 'economy') then 120 when contains(lower(title), 'economy') then 90 when contains(field, 'red bolt') then 120 when contains(lower(title), 'red bolt') then 90 else 0 end
      + case when n = 2 then 70 else n * 12 end + case when contains(field, 'large') or contains(lower(tbl), 'large') or contains(field, 'bolt') then 45 else 0 end as boost
    from (select *, (contains(field, 'large') or contains(lower(tbl), 'large') or contains(lower(title), 'large') or contains(lower(tech), 'large'))::int + (contains(field, 'bolt') or contains(lower(title), 'bolt'))::int as n from m)""")
def lexical_field_boosts(spark, sf):
    fields = {"technical_name": F.concat(F.lit("Z_"), F.col("p_type")), "field_text": F.col("p_type"), "table_text": F.col("p_brand"), "title": F.col("p_name")}
    return table(spark, sf, "part").select("p_partkey", search.field_boosts(fields, ["Z_PROMO", "STANDARD", "X"], ["Economy", "red bolt", "abc"], ["large", "bolt", "of"]).alias("boost"))


# Links by kind


@query("""with c as (select o_orderkey, substr('1245678 9AtX', (1 + o_orderkey % 12)::int, 1) as code from orders),
    m as (select * from (values ('1', 'Print output'), ('2', 'Fax'), ('4', 'Telex'), ('5', 'External send'), ('6', 'EDI'), ('7', 'Simple mail'), ('8', 'Special function'), ('9', 'Events (workflow)'), ('A', 'Distribution (ALE)'), ('T', 'Workflow task')) as t(k, text))
    select o_orderkey, code, case when code = '6' then 'Own EDI' else coalesce(text, 'unbekannt') end as medium_text, case when code = '6' then 'CONFIG_TEXT' when text is not null then 'GENERIC_SAP_MAPPING' else 'UNRESOLVED' end as resolution from c left join m on upper(trim(code)) = k""")
def medium_texts(spark, sf):
    code = F.substring(F.lit("1245678 9AtX"), (1 + F.col("o_orderkey") % 12).cast("int"), F.lit(1))
    own = spark.createDataFrame([(" 6", "Own EDI"), ("6", "Zweiter Text"), ("5", " ")], "code string, text string")
    return link.resolve_media(table(spark, sf, "orders").select("o_orderkey", code.alias("code")), "code", own, english=True)


HITS_OF = (("h1", "ddic_field", "RED BOLT", "ECONOMY", "F7"), ("h2", "ddic_field", "NONE", "PROMO", "F1"), ("h3", "table_profile", "BRAND#12", "", ""), ("h4", "control_table", "WIDGET", "", ""), ("h5", "method", "COLD", "", ""), ("h6", "program", "B3", "", ""), ("h7", "other", "COLD", "", ""))


@query(f"""with h as (select * from (values {', '.join(map(str, HITS_OF))}) as t(hit_id, kind, tech, tbl, fld)),
    d as (select p_partkey as doc_id, (['master_field', 'table_profile', 'class'])[1 + p_size % 3] as unit, upper(p_name) as title, 'K|' || upper(p_type) || '|F' || p_size as key, upper(p_brand) as obj, 'B' || (p_size % 5) as sub, upper(p_type) as mt, 'F' || (p_size % 9) as mf from part)
    select distinct hit_id, doc_id from h join d on (kind = 'ddic_field' and unit = 'master_field' and (title = tech or (mt = tbl and mf = fld) or contains(key, '|' || tbl || '|' || fld)))
      or (kind in ('table_profile', 'control_table') and unit = 'table_profile' and (key = 'TABLE_PROFILE:' || tech or obj = tech or contains(title, tech))) or (kind in ('method', 'program') and (contains(key, tech) or contains(title, tech) or obj = tech or sub = tech))""")
def hit_documents(spark, sf):
    hits = spark.createDataFrame(HITS_OF, "hit_id string, kind string, technical_name string, table_name string, field_name string")
    size = F.col("p_size")
    unit = F.element_at(F.array(*map(F.lit, ("master_field", "table_profile", "class"))), (1 + size % 3).cast("int"))
    key = F.concat(F.lit("K|"), "p_type", F.lit("|F"), size.cast("string"))
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), unit.alias("unit_type"), F.col("p_name").alias("title"), key.alias("source_key"), F.col("p_brand").alias("object_name"), F.concat(F.lit("B"), (size % 5).cast("string")).alias("subobject_name"), F.col("p_type").alias("table_name"), F.concat(F.lit("F"), (size % 9).cast("string")).alias("field_name"))
    return link.match_hits(hits, docs)


# Sources and sinks: written as JSON lines and read back

CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_mktsegment", T.StringType())])


def customer_lines(spark, sf):
    folder = scratch_path(spark, "customers")
    return jsonl.publish({"customer": table(spark, sf, "customer").select(*CUSTOMER.names)}, folder) + "/customer"


@query("select c_custkey, c_name, c_mktsegment from customer")
def jsonl_records(spark, sf):
    return jsonl.scan(spark, customer_lines(spark, sf), CUSTOMER)


@query("select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def jsonl_prefiltered(spark, sf):
    return jsonl.scan_matching(spark, customer_lines(spark, sf), ['"BUILDING"', '"MACHINERY"'], CUSTOMER).select("c_custkey", "c_mktsegment")


@query("select error, count(*) as n from (select case when o_orderkey % 5 = 0 then 'malformed' when o_orderkey % 7 = 0 then 'no object' else 'none' end as error from orders where o_orderkey % 11 <> 0) group by error")
def jsonl_errors(spark, sf):
    key = F.col("o_orderkey")
    line = F.when(key % 11 == 0, " ").when(key % 5 == 0, F.concat(F.lit('{"k": '), key.cast("string"))).when(key % 7 == 0, "[1]").otherwise(F.concat(F.lit('{"k": '), key.cast("string"), F.lit("}")))
    good, bad = jsonl.parse_lines(table(spark, sf, "orders").select(line.alias("value")), T.StructType([T.StructField("k", T.LongType())]))
    return good.select(F.lit("none").alias("error")).unionByName(bad.select("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_custkey from orders where o_orderkey in (1, 2, 3, 7, 32, 100000)")
def fetch_by_id(spark, sf):
    return jsonl.fetch(spark, f"{sf}/orders.parquet", "o_orderkey", [1, 2, 3, 7, 32, 100000]).select("o_orderkey", "o_custkey")


# Sets


@query("select c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("select l_partkey % 500 as k from lineitem intersect select s_suppkey from supplier")
def intersect_keys(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_partkey") % 500).alias("k")).intersect(table(spark, sf, "supplier").select("s_suppkey"))


@query("select doc_id, lang, source from documents where lang <> 'de' union all select doc_id + 1000000, 'de', 'new' from documents where lang = 'fr'")
def partition_replaced(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    batch = docs.filter("lang = 'fr'").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit("de").alias("lang"), F.lit("new").alias("source"))
    return incremental.replace_partition(docs, "lang", "de", batch)


@query("select o_orderkey, o_orderpriority from orders order by o_orderpriority, o_orderkey limit 25")
def batch_by_priority(spark, sf):
    return incremental.next_batch(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 25)


# Indexes


@query("""with p as (select distinct l_partkey, l_orderkey from lineitem), r as (select *, row_number() over (partition by l_partkey order by l_orderkey) as r, count(*) over (partition by l_partkey) as n from p)
    select l_partkey, string_agg(l_orderkey, '|' order by l_orderkey) as ids, max(n) as n from r where r <= 5 group by 1""")
def capped_postings(spark, sf):
    lists = index.capped_postings(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey", 5)
    return lists.select("l_partkey", F.array_join(F.transform("ids", lambda i: i.cast("string")), "|").alias("ids"), "n")


@query("""with u as (select p_partkey, upper(trim(p_name)) as u from part) select distinct unnest(list_concat([u], [x for x in regexp_split_to_array(u, '[^A-Z0-9]+') if length(x) >= 3])) as symbol, p_partkey as id from u""")
def symbol_names(spark, sf):
    return index.symbol_map(table(spark, sf, "part"), "p_name", "p_partkey")


VALUES = "v as (select 'brand' as field, p_brand as value from part union all select 'size', p_size::varchar from part union all select 'name', p_name || p_partkey from part)"


@query(f"with {VALUES}, k as (select field from v group by field having count(distinct value) <= 50) select field, value, count(*) as n from v where field in (select field from k) group by 1, 2")
def values_by_field(spark, sf):
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in (("brand", F.col("p_brand")), ("size", F.col("p_size").cast("string")), ("name", F.concat("p_name", F.col("p_partkey").cast("string"))))))
    return index.values_by_field(table(spark, sf, "part").select(F.inline(pairs)), 50)


@query("select doc_id, lang from documents where lang in ('de', 'es')")
def soft_types(spark, sf):
    docs = table(spark, sf, "documents")
    kept = docs.filter(grounding.soft_type_filter(F.col("lang"), ["de", "es", "xx"], ["de", "en", "es", "fr"], 0.8))
    return kept.filter(grounding.soft_type_filter(F.col("lang"), ["xx"], ["de", "en"], 0.9) & grounding.soft_type_filter(F.col("lang"), ["en"], ["en"], 0.5)).select("doc_id", "lang")


# Rows, links and graph


@query("select p_partkey, 'brand ' || p_brand || ' size ' || p_size || case when p_size > 10 then ' type ' || p_type else '' end as flat from part")
def flat_rows(spark, sf):
    values = F.map_filter(F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand")), lambda k, v: (k != "type") | (F.col("p_size") > 10))
    return table(spark, sf, "part").select("p_partkey", masterdata.flat_text(values).alias("flat"))


@query("""select p_partkey, regexp_matches(upper(p_type), '^(Z|Y)|_Z|^/') or p_size % 3 = 0 as _is_z_field, p_size > 25 as _is_append_include, p_size <= 40 as _linked_to_content from part""")
def field_flags(spark, sf):
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("z"), F.col("p_type"))).otherwise(F.col("p_type"))
    flags = masterdata.structure_flags(name, F.when(F.col("p_size") > 25, F.lit("A")), F.when(F.col("p_size") <= 40, F.lit("C")))
    return table(spark, sf, "part").select("p_partkey", *flags)


@query("""with e as (select case when l_orderkey % 7 = 0 then 'O?' else 'O' || l_orderkey end as from_id, 'P' || l_partkey as to_id, case when l_linenumber = 3 then 'DYNAMIC_UNRESOLVED' when l_linenumber = 2 then null else 'HAS' end as relation, l_linenumber as n from lineitem)
    select from_id, to_id, relation, n from e where from_id <> 'O?' and (relation is null or relation = 'HAS')""")
def known_edges(spark, sf):
    source = F.when(F.col("l_orderkey") % 7 == 0, "O?").otherwise(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")))
    relation = F.when(F.col("l_linenumber") == 3, "DYNAMIC_UNRESOLVED").when(F.col("l_linenumber") != 2, "HAS")
    return graph.resolved_edges(table(spark, sf, "lineitem").select(source.alias("from_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("to_id"), relation.alias("relation"), F.col("l_linenumber").alias("n")))


@query("select l_orderkey, l_linenumber, p_brand, s_name from lineitem left join (select p_partkey as l_partkey, p_brand from part where p_size < 30) using (l_partkey) left join (select s_suppkey as l_suppkey, s_name from supplier) using (l_suppkey)")
def star_rows(spark, sf):
    part = table(spark, sf, "part").filter("p_size < 30").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return link.star_lookup(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), [(part, "l_partkey"), (supplier, "l_suppkey")]).select("l_orderkey", "l_linenumber", "p_brand", "s_name")


@query("select o_orderkey, o_custkey % 3 = 0 or o_custkey % 3 = 1 as padded from orders")
def equivalent_values(spark, sf):
    other = F.when(F.col("o_custkey") % 3 == 0, F.lpad(F.col("o_custkey").cast("string"), 10, "0")).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("0")))
    return table(spark, sf, "orders").select("o_orderkey", X.same_value(F.col("o_custkey").cast("string"), other).alias("padded"))


# Gates and evidence


@query("""select o_orderkey, case when o_orderstatus = 'F' and o_custkey % 3 = 0 then 'CLOSED' when o_totalprice > 250000 then 'DEEP_ANALYSIS' when o_custkey % 4 > 0 and o_orderkey % 2 = 0 then 'RETRIEVAL' when o_totalprice < 50000 then 'EXACT' else 'RETRIEVAL' end as gate from orders""")
def search_gates(spark, sf):
    decision = grounding.budget_gate(F.col("o_orderstatus") == "F", F.col("o_custkey") % 3, F.col("o_totalprice") > 250000, F.col("o_custkey") % 4, F.col("o_orderkey") % 2, F.col("o_totalprice") < 50000)
    return table(spark, sf, "orders").select("o_orderkey", decision.alias("gate"))


@query("""with s as (select o_orderpriority, (o_orderstatus = 'F')::int as done, 1 as countable, o_custkey % 2 = 0 or o_orderpriority like '1%' as locked from orders),
    g as (select o_orderpriority, case when bool_or(not locked) then sum(done) filter (where not locked) else sum(done) end as done, case when bool_or(not locked) then sum(countable) filter (where not locked) else sum(countable) end as countable from s group by 1)
    select o_orderpriority, done, countable, case when countable > 0 then round(100 * done / countable::double) else 0 end as percent from g""")
def step_progress(spark, sf):
    steps = table(spark, sf, "orders").withColumn("locked", (F.col("o_custkey") % 2 == 0) | F.col("o_orderpriority").startswith("1"))
    return steps.groupBy("o_orderpriority").agg(*profile.progress((F.col("o_orderstatus") == "F").cast("int"), F.lit(1), F.col("locked")))


@query("""select event_id, round(case event_type when 'view' then 20.0 when 'click' then 40.0 else 5.0 end + 10 * (value / 1000) - case when user_id % 4 = 0 then 30 else 0 end, 6) as score,
    round(100 + least(200, 40.0 * (user_id % 8)) + least(100, value), 6) as tiered from events""")
def evidence_scores(spark, sf):
    kind = F.when(F.col("event_type") == "view", 20.0).when(F.col("event_type") == "click", 40.0).otherwise(5.0)
    path = F.when(F.col("user_id") % 4 != 0, F.lit("p"))
    tiered = evidence.exact_coverage_rank(F.lit(100.0), F.col("user_id") % 8, F.col("value"))
    return rounded(table(spark, sf, "events").select("event_id", evidence.evidence_score(kind, F.col("value") / 1000, path).alias("score"), tiered.alias("tiered")), "score", "tiered")


@query("""with s as (select doc_id, case lang when 'de' then 5.0 when 'fr' then -20.0 else 0.0 end + 3.0 * (contains(text, 'nation')::int + contains(text, 'attion')::int) as useful, n_chars from documents)
    select doc_id, useful from s where useful > 0 order by useful desc, n_chars, doc_id limit 30""")
def useful_hits(spark, sf):
    has = lambda w: F.contains(F.col("text"), F.lit(w)).cast("int")
    hits = table(spark, sf, "documents").withColumn("r", F.struct("n_chars", "doc_id"))
    return evidence.usefulness(hits, {"de": 5.0, "fr": -20.0}, "lang", has("nation") + has("attion"), "r", 30).select("doc_id", "useful")


@query("select l_returnflag, count(*) as n_new from (select distinct l_returnflag, l_partkey from lineitem where l_orderkey % 2 = 0 except select l_returnflag, l_partkey from lineitem where l_orderkey % 2 = 1) group by 1")
def new_evidence(spark, sf):
    lines = table(spark, sf, "lineitem")
    return gate.evidence_delta(lines.filter("l_orderkey % 2 = 1"), lines.filter("l_orderkey % 2 = 0"), "l_partkey", "l_returnflag")


@query("""with s as (select doc_id, n_chars::double / 100 as score from documents order by round(n_chars::double / 100, 6) desc, doc_id limit 5), e as (select doc_id as from_id, (doc_id * 7) % 100 as to_id from documents union all select doc_id, (doc_id * 3) % 100 from documents)
    select to_id as doc_id, round(sum(greatest(0.8, least(2.5, 0.08 * score))), 6) as boost from e join s on from_id = doc_id group by 1""")
def relation_boosts(spark, sf):
    docs = table(spark, sf, "documents")
    edges = docs.select(F.col("doc_id").alias("from_id"), F.explode(F.array(F.col("doc_id") * 7 % 100, F.col("doc_id") * 3 % 100)).alias("to_id"))
    return rounded(search.expand_relations(docs.select("doc_id", (F.col("n_chars") / 100).alias("score")), edges), "boost")


@query("select doc_id as id from documents where doc_id % 3 > 0")
def embeddings_to_make(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    key = lambda version: F.sha2(F.concat_ws("|", "content_hash", F.lit("m"), F.lit(version)), 256).alias("embedding_key")
    stored = docs.filter("id % 3 = 0").select("id", key("2")).unionByName(docs.filter("id % 3 = 1").select("id", key("1")))
    return vectors.pending_embeddings(docs, stored, "m", "2").select("id")


@query(f"select doc_id, len([t for t in {list(dict.fromkeys(TERMS))!r} if list_contains(toks, t)]) as n_terms from (select doc_id, {TOKENS} as toks from documents)")
def terms_covered(spark, sf):
    return table(spark, sf, "documents").select("doc_id", search.term_coverage("text", TERMS).alias("n_terms"))


# Paths, rounds and rules

RANKED = f"""{EDGES}, k as (select from_id || '>' || to_id as edge_id, from_id, to_id, relation, case when relation = 'IN_NATION' and from_id like 'S%' then 1 when relation = 'IN_NATION' then 2 else 3 end as rank from e),
    m as (select *, from_id as a, to_id as b from k union all select *, to_id, from_id from k)"""


def ranked_edges(spark, sf):
    rank = F.when((F.col("relation") == "IN_NATION") & F.col("from_id").startswith("S"), 1).when(F.col("relation") == "IN_NATION", 2).otherwise(3)
    return graph_edges(spark, sf).select(F.concat_ws(">", "from_id", "to_id").alias("edge_id"), "from_id", "to_id", "relation", rank.alias("rank"))


def _hop(n: int) -> str:
    """Labels of hop n: paths are compared as texts of their edges, which are parted by a character below all of theirs."""
    known = " union all ".join(f"select node_id from p{i}" for i in range(n))
    return f"""p{n} as (select node_id, seed_id, {n} as distance, path, rank, open from (select b as node_id, seed_id, path || chr(1) || edge_id as path, m.rank, bool_or(relation <> 'IN_REGION') over (partition by b) as open,
        row_number() over (partition by b order by m.rank, path || chr(1) || edge_id, seed_id) as r from p{n - 1} join m on m.a = node_id where open) where r = 1 and node_id not in ({known}))"""


@query(f"""with {RANKED}, p0 as (select node_id, node_id as seed_id, 0 as distance, '' as path, null::int as rank, true as open from (values ('C1'), ('S1'), ('C7')) as s(node_id)), {_hop(1)}, {_hop(2)}, {_hop(3)}
    select node_id, seed_id, distance, replace(ltrim(path, chr(1)), chr(1), ' ') as path, rank from ({' union all '.join(f'select * from p{i}' for i in range(4))})""")
def graph_paths(spark, sf):
    """Shortest paths with the evidence of their last edge; regions are reached and not expanded."""
    seeds = spark.createDataFrame([("C1",), ("S1",), ("C7",)], "node_id string")
    found = graph.paths_from(seeds, ranked_edges(spark, sf), 3, ("IN_REGION",))
    return found.withColumn("path", F.array_join("path", " "))


@query("""with recursive c as (select distinct o_custkey as c, l_partkey as p from orders join lineitem on l_orderkey = o_orderkey where l_quantity >= 48),
    walk(c, n) as (select min(c) as c, 0 as n from c union select y.c, n + 1 from walk w join c x on x.c = w.c join c y on y.p = x.p where n < 40)
    select c as o_custkey, min(n) as round from walk group by c""")
def rounds_of_shared_parts(spark, sf):
    """Customers by shared parts from the first one, until a round finds nobody new: their number depends on the data."""
    lines = table(spark, sf, "lineitem").filter("l_quantity >= 48").select("l_orderkey", "l_partkey")
    # written once: a round reads the pairs twice, and neither orders nor lines again
    bought = materialize(lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct(), "bought")

    def step(added):
        parts = added.join(bought, "o_custkey").select("l_partkey").distinct()
        return parts.join(bought, "l_partkey").select("o_custkey")

    return graph.until_nothing_new(bought.agg(F.min("o_custkey").alias("o_custkey")).filter("o_custkey is not null"), step, "o_custkey")


INTERFACE_TEXTS = (
    "Funktionsbaustein: SD_{k} (aus {w})", "ZCO_{w}_NEW->UPDATE_{k}", "IT_{k}", "RFC Destination {w}{k}", "open dataset {k}.csv", "Z_{k} parameter", "soap parameter {w}", "VBAK (Tabelle {k})", "ZCL_{w}->RUN", "read_{k}", "cx_ai_{k}",
    "/IDOC/{k}", "  OData \n URL {k}", "Testsystem {k}", "call function date_{k}", "{w}", "Logical Port {k}",
)


@query(rf"""with t as (select p_partkey, replace(replace(([{', '.join(repr(x) if chr(39) not in x else x for x in INTERFACE_TEXTS).replace(chr(92) + 'n', chr(10))}])[1 + p_partkey % {len(INTERFACE_TEXTS)}], '{{k}}', p_partkey::varchar), '{{w}}', p_type) as raw from part),
    c as (select p_partkey, trim(regexp_replace(raw, '\s+', ' ', 'g')) as x from t),
    n as (select *, upper(case when regexp_matches(x, 'funktionsbaustein\s*:?\s*[A-Z0-9_/]+', 'i') then regexp_extract(x, 'funktionsbaustein\s*:?\s*([A-Z0-9_/]+)', 1, 'i') when regexp_matches(x, '^[A-Z0-9_/]+->[A-Z0-9_/]+', 'i') then regexp_extract(x, '^([A-Z0-9_/]+->[A-Z0-9_/]+)', 1, 'i') else trim(split_part(x, '(', 1)) end) as name from c),
    r as (select *, case when regexp_matches(x, 'klassenvariablen|interne|import-tabelle|export-tabelle|parameter', 'i') and not regexp_matches(x, 'web\s*service|soap|proxy|rfc|idoc|http|rest|file|datei', 'i') then 'internal_method_or_variable:internal_comment'
      when regexp_matches(name, '^(I_|E_|C_|L_|G_|LT_|GT_|LS_|GS_|IT_|IS_|WA_|P_|R_)') then 'internal_method_or_variable:parameter_or_variable' when regexp_matches(x, '\bcx_ai_', 'i') then 'internal_method_or_variable:runtime_exception'
      when regexp_matches(name, '^(VBPA|KNVA|VBSK|MARA|VBAK|VBAP|EKKO|EKPO|ZEXTO_)') and not contains(name, '->') then 'internal_method_or_variable:database_table' when regexp_matches(x, '\bidoc\b|/idoc', 'i') then 'idoc:idoc' when regexp_matches(x, '\brfc\b|destination\b', 'i') then 'rfc_destination:rfc'
      when regexp_matches(x, '\bhttp\b|\brest\b|\burl\b|\bodata\b', 'i') then 'http_or_rest:http' when regexp_matches(x, '\bfile\b|datei|dataset|csv', 'i') then 'file_interface:file' when regexp_matches(x, 'logical[_\s-]?port|soap|web\s*service|proxy|zco_|zotco_', 'i') then 'sap_proxy_or_webservice:proxy'
      when regexp_matches(x, 'funktionsbaustein', 'i') then 'function_module:named_function' when regexp_matches(x, 'call function', 'i') and regexp_matches(name, '^(DATE_|SD_|READ_|CACL_|NUMBER_)') then 'function_module:called_function' when regexp_matches(name, '^(DATE_|SD_|READ_|CACL_|NUMBER_)[A-Z0-9_/]*$') then 'function_module:function_like_name'
      when regexp_matches(x, 'optitool|prodsystem|testsystem|testsys', 'i') then 'external_system_name:system_label' when starts_with(name, 'ZCL_') then 'internal_method_or_variable:helper_class' else 'internal_method_or_variable:plain_name' end as k from n)
    select p_partkey, name, split_part(k, ':', 1) as kind, split_part(k, ':', 2) as reason from r""")
def interface_kinds(spark, sf):
    text = F.element_at(F.array(*map(F.lit, INTERFACE_TEXTS)), (F.col("p_partkey") % len(INTERFACE_TEXTS) + 1).cast("int"))
    raw = F.replace(F.replace(text, F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{w}"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", rules.interface_name(raw).alias("name"), rules.interface_kind(raw).alias("k")).select("p_partkey", "name", "k.kind", "k.reason")


@query("""select distinct s_suppkey, p_partkey from supplier join part on contains(upper(p_name), upper(substr(s_name, 1 + s_suppkey % 3, 4))) or contains(upper(p_name), (['BOLT', 'RED', 'X', 'NG', 'MALL RI', 'ZZZZ'])[1 + s_suppkey % 6])""")
def names_in_names(spark, sf):
    """Parts whose names hold a word or a part of the name of a supplier."""
    key, suppliers = F.col("s_suppkey"), table(spark, sf, "supplier")
    word = F.element_at(F.array(*map(F.lit, ("BOLT", "RED", "X", "NG", "MALL RI", "ZZZZ"))), (key % 6 + 1).cast("int"))
    needles = suppliers.select(key.alias("needle_id"), F.lit("").alias("scope"), F.explode(F.array(F.upper(F.expr("substr(s_name, 1 + s_suppkey % 3, 4)")), word)).alias("needle"))
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("name_id"), F.lit("").alias("scope"), F.upper("p_name").alias("name"))
    return link.contains_join(needles, names).toDF("s_suppkey", "p_partkey")


# Stored index

_stored: dict[tuple[str, str], str] = {}


def stored(spark, sf) -> str:
    """The folder of the index of documents, which is written once a session: two thirds of them first, the rest, with
    changes and a deletion that are taken back, as a delta."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored:
        docs, folder = table(spark, sf, "documents").select("doc_id", "text"), scratch_path(spark, "index")
        late = F.col("doc_id") % 3 == 2
        stored_index.build(docs.withColumn("text", F.when(F.col("doc_id") % 30 == 0, F.lit("nation licensed before")).otherwise(F.col("text"))).filter(~late | (F.col("doc_id") % 30 == 2)), folder)
        stored_index.update(docs.filter(late | (F.col("doc_id") % 30 == 0)), None, folder)
        _stored[key] = folder
    return _stored[key]


@query(f"with {BM25} select doc_id, round(score, 6) as score, {RANK.format('score')} as rank from bm order by round(score, 6) desc, doc_id limit 20")
def bm25_stored(spark, sf):
    """bm25_topk from the stored index: reads the terms' buckets alone."""
    return rounded(search.top_k(stored_index.bm25(spark, stored(spark, sf), TERMS), 20), "score").select("doc_id", "score", "rank")


# Tiers and passes


@query("""with f as (select p_partkey as id, p_size::double as score, 'named' as reason from part where contains(p_name, 'bolt')), l as (select distinct a.l_partkey as from_id, b.l_partkey as to_id, 'same_order' as reason from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey where a.l_quantity > 40 and b.l_quantity > 40),
    u as (select id, 1 as tier, score, reason from f union all select to_id, 2, max(score) * 0.5, l.reason from l join f on from_id = id group by to_id, l.reason),
    r as (select *, row_number() over (partition by id order by tier, score desc, reason) as p from u) select id as p_partkey, tier, round(score, 6) as score, reason from r where p = 1 order by tier, score desc, id limit 200""")
def tiered_candidates(spark, sf):
    """Parts of a name, then parts ordered with them: tier, score and reason of each."""
    first = table(spark, sf, "part").filter("p_name like '%bolt%'").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"), F.lit("named").alias("reason"))
    lines = table(spark, sf, "lineitem").filter("l_quantity > 40").select("l_orderkey", "l_partkey").distinct()
    named = lines.join(first.select(F.col("id").alias("l_partkey")), "l_partkey", "left_semi")  # links are wanted from the first tier alone
    links = named.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("from_id")).join(lines.toDF("k", "to_id"), "k").filter("from_id <> to_id").select("from_id", "to_id", F.lit("same_order").alias("reason"))
    return rounded(selection.in_tiers(first, links, 0.5, 200).withColumnRenamed("id", "p_partkey"), "score")


@query("""with m as (select p_partkey, p_brand, p_name, case when p_brand = 'Brand#12' and p_size < 10 then 'brand' when contains(p_name, 'red') and p_size > 40 then 'name' end as via, p_size from part),
    s as (select * from m where via is not null union all select p_partkey, p_brand, p_name, 'sibling', p_size from m where via is null and contains(p_name, 'bolt') and p_brand in (select p_brand from m where via is not null))
    select p_partkey, p_brand, via as found_by from s order by case via when 'brand' then 1 when 'name' then 2 else 3 end, p_partkey limit 300""")
def exclusive_passes(spark, sf):
    """Parts by brand, by name, then bolts of the brands found: each by the first pass that takes it, with one limit."""
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    passes = [("brand", (F.col("p_brand") == "Brand#12") & (F.col("p_size") < 10)), ("name", F.contains("p_name", F.lit("red")) & (F.col("p_size") > 40))]
    return selection.in_passes(rows, passes, ("sibling", "p_brand", F.contains("p_name", F.lit("bolt"))), ["p_partkey"], 300).select("p_partkey", "p_brand", "found_by")


# Entities of fields by their description

FIELDS = (
    ("MANDT", "MANDT", "MANDT", "CLNT", "Client", 3, True, "'100'"), ("ZKEY", "CHAR10", "", "CHAR", "", 10, True, "lpad(c_custkey::varchar, 8, '0')"), ("PARTNER", "KUNNR", "KUNNR", "CHAR", "Kunde", 10, False, "lpad(c_custkey::varchar, 10, '0')"),
    ("ZZMATNR", "", "", "CHAR", "", 18, False, "'00000' || c_nationkey"), ("LIEF", "ELIFN", "", "CHAR", "Vendor", 10, False, "'000'"), ("RFCDEST_OUT", "", "", "CHAR", "", 32, False, "lower(c_mktsegment)"), ("ORDSTAT", "", "", "CHAR", "", 1, False, "'a'"),
    ("CODE_1", "", "", "CHAR", "", 4, False, "'x' || c_nationkey"), ("ART", "", "", "CHAR", "", 4, True, "'za'"), ("BEZ", "", "", "CHAR", "", 4, False, "c_name"), ("LONGFIELD", "", "", "CHAR", "", 40, False, "c_mktsegment"), ("ZID", "", "", "NUMC", "", 8, True, "'a7'"),
    ("SHORT", "", "", "CHAR", "", 2, False, "'q'"), ("AMOUNT", "", "", "CURR", "", 15, False, "c_acctbal::varchar"), ("EMPTY", "", "", "CHAR", "", 2, False, "' '"),
)
BLOB = "' ' || name || ' ' || element || ' ' || domain || ' ' || description || ' '"


@query(f"""with f as ({' union all '.join(f"select c_custkey, '{n}' as name, '{e}' as element, '{d}' as domain, '{t}' as kind, upper('{x}') as description, {size} as length, {key} as is_key, trim({v}) as value from customer" for n, e, d, t, x, size, key, v in FIELDS)}),
    k as (select *, {BLOB} as b, case when 'MANDT' in (name, element, domain) or kind = 'CLNT' then 'client_id' when regexp_matches({BLOB}, '\\b(MATNR|MATERIAL)\\b') or contains(name, 'MATNR') then 'material_number' when regexp_matches({BLOB}, '\\b(KUNNR|CUSTOMER|KUNDE)\\b') or contains(name, 'KUNNR') then 'customer_number'
      when regexp_matches({BLOB}, '\\b(LIFNR|VENDOR|LIEFERANT)\\b') or contains(name, 'LIFNR') then 'vendor_number' when regexp_matches({BLOB}, '\\b(RFCDEST|LOGSYS|DESTINATION|SYSID|SERVER|HOST)\\b') or regexp_matches(name, 'DEST|LOGSYS|RFC') then 'technical_system_name'
      when regexp_matches({BLOB}, '\\b(STATUS|STAT|STCD|STATE)\\b') or regexp_matches(name, '(STATUS|STAT)$') then 'status_value' when regexp_matches({BLOB}, '\\b(PARAM|KEY|CODE|KZ|FLAG|IND|TYPE|ART)\\b') or regexp_matches(name, '^(KEY|PARAM|VAL|CODE|KZ)')
        then case when regexp_matches(name, 'PARAM|KEY|VAL') or regexp_matches({BLOB}, 'PARAM|KEY') then 'parameter_or_mapping_value' else 'code_value' end
      when regexp_matches({BLOB}, '\\b(TEXT|DESCR|BEZEICH|NAME|VTEXT|REMARK|COMMENT)\\b') or regexp_matches(name, '(TEXT|DESCR|NAME|BEZ)$') or kind = 'CHAR' and length >= 20 then 'description_text' when is_key then 'primary_key_value' when kind = 'CHAR' and length between 1 and 10 then 'code_value' else 'field_value' end as entity_type from f where value <> '')
    select c_custkey, name as field, entity_type, case when entity_type in ('material_number', 'customer_number', 'vendor_number') then coalesce(nullif(ltrim(value, '0'), ''), value) when entity_type in ('client_id', 'description_text', 'field_value') then value else upper(value) end as normalized,
      case entity_type when 'client_id' then 0.95 when 'technical_system_name' then 0.8 when 'status_value' then 0.75 when 'description_text' then 0.7 when 'primary_key_value' then 0.9 when 'field_value' then 0.4 when 'parameter_or_mapping_value' then if(is_key, 0.8, 0.7)
        when 'code_value' then case when name in ('SHORT') then 0.55 when is_key then 0.8 else 0.7 end else 0.85 end::double as confidence from k""")
def field_entities(spark, sf):
    """Entities of each customer's fields, by what is known of the field."""
    names = ("name", "element", "domain", "data_type", "description", "length", "is_key")
    value = lambda text: F.expr(re.sub(r"(\w+)::varchar", r"cast(\1 as string)", text)).cast("string")
    described = [F.struct(F.lit(row[0]).alias("name"), masterdata.kind_of(F.struct(*(F.lit(x).alias(c) for x, c in zip(row[:7], names, strict=True)))).alias("kind"), value(row[7]).alias("value")) for row in FIELDS]
    # a small file of customers makes fifteen rows each: they are dealt by number first
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_name", "c_acctbal").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    rows = customers.select("c_custkey", F.explode(F.array(*described)).alias("f"))
    found = rows.select("c_custkey", F.col("f.name").alias("field"), masterdata.entity_of(F.col("f.kind"), F.col("f.value")).alias("e")).filter("e is not null")
    return found.select("c_custkey", "field", F.col("e.type").alias("entity_type"), "e.normalized", "e.confidence")

"""Queries over the test tables, one for each operator, with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import canonical, documents, evidence, fuse, gate, graph, grounding, incremental, index, link, masterdata, profile, search, vectors
from quern.plans import retrieval
from quern.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TERMS = ["therhean", "eranea", "attion", "nation", "licensed"]
IN_TERMS = "('" + "', '".join(TERMS) + "')"
FOLD = f"translate(replace(replace(replace(replace(coalesce({{}}, ''), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '{X.ACCENTED}', '{X.BASE}')"
TOKENS = f"[x for x in regexp_split_to_array(lower({FOLD.format('text')}), '[^a-z0-9_]+') if length(x) >= 2]"
#: Terms of TERMS in documents, with their document's length and the corpus's statistics.
HITS = f"""d as (select doc_id, source, lang, {TOKENS} as toks from documents),
    st as (select count(*) as n, avg(len(toks)) as avgdl from d),
    t as (select doc_id, len(toks) as dl, unnest(toks) as term from d),
    tf as (select doc_id, dl, term, count(*) as tf from t where term in {IN_TERMS} group by all),
    df as (select term, count(*) as df from tf group by term)"""
BM25 = f"{HITS}, bm as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from tf join df using (term) cross join st group by doc_id)"
TFIDF = "ti as (select doc_id, sum((1 + ln(1 + tf)) * ln(1 + n / df::double)) as score from tf join df using (term) cross join st group by doc_id)"
RANK = "row_number() over (order by round({0}, 6) desc, doc_id)"
LISTS = f"""{BM25}, {TFIDF},
    l as (select 'bm25' as list, doc_id, {RANK.format('score')} as rank, score from bm union all select 'tfidf', doc_id, {RANK.format('score')}, score from ti),
    lists as (select * from l where rank <= 50)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# Retrieval


@query(f"with {BM25} select doc_id, round(score, 6) as score, {RANK.format('score')} as rank from bm order by round(score, 6) desc, doc_id limit 20")
def bm25_topk(spark, sf):
    return rounded(search.top_k(search.bm25_scores(table(spark, sf, "documents"), TERMS), 20), "score").select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {HITS}, {TFIDF} select doc_id, round(score, 6) as score, {RANK.format('score')} as rank from ti order by round(score, 6) desc, doc_id limit 20")
def tfidf_topk(spark, sf):
    return rounded(search.top_k(search.tfidf_scores(table(spark, sf, "documents"), TERMS), 20), "score").select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with d as (select {TOKENS} as toks from documents), t as (select unnest(list_distinct(toks)) as term from d) select term, count(*) as df from t group by term order by df desc, term limit 50")
def doc_freq_top(spark, sf):
    return index.document_frequency(table(spark, sf, "documents")).orderBy(F.desc("df"), "term").limit(50)


@query(f"with d as (select doc_id, {TOKENS} as toks from documents), t as (select doc_id, unnest(toks) as term from d) select term, doc_id, count(*) as tf from t group by all")
def postings(spark, sf):
    return index.postings(table(spark, sf, "documents"))


@query(f"""with {HITS}, {TFIDF},
    m as (select doc_id, cast(lower(source) = 'src1' or lower(lang) = 'src1' as double) + cast(lower(source) = 'de' or lower(lang) = 'de' as double) as exact,
      (case when contains(lower(concat_ws(' ', source, lang)), 'src1') then 0.5 else 0.0 end) + (case when contains(lower(concat_ws(' ', source, lang)), 'de') then 0.5 else 0.0 end) as meta from documents),
    c as (select doc_id, max(quality)::double as confidence from labels group by doc_id),
    v as (select vec_id as doc_id, list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)) as vector from embeddings),
    s as (select documents.doc_id, 4 * exact + 1.2 * coalesce(ti.score, 0) + 3 * (case when vector >= 0.15 then vector else 0 end) + meta + 0.5 * coalesce(confidence, 0) as score from documents join m using (doc_id) left join ti using (doc_id) left join v using (doc_id) left join c using (doc_id) where exact > 0 or meta > 0 or ti.score is not null or vector >= 0.15
      union all select doc_id, 3 * vector + 0.5 * coalesce(confidence, 0) from v left join c using (doc_id) where vector >= 0.15 and doc_id not in (select doc_id from documents))
    select doc_id, round(score, 6) as score, {RANK.format('score')} as rank from s order by round(score, 6) desc, doc_id limit 20""".replace("tf as (select doc_id, dl, term, count(*) as tf from t where term in " + IN_TERMS, "tf as (select doc_id, dl, term, count(*) as tf from t where term in ('src1', 'de')"))
def hybrid_score(spark, sf):
    confidence = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").cast("double").alias("confidence"))
    rows = table(spark, sf, "embeddings")
    vector = rows.filter("vec_id = 0").first()["embedding"]
    return rounded(retrieval.hybrid(table(spark, sf, "documents"), confidence, ["src1", "de"], 20, rows.select(F.col("vec_id").alias("doc_id"), "embedding"), vector), "score").select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""with {BM25},
    n as (select doc_id, count(*) as n_terms from tf group by doc_id),
    w as (select list_distinct([substr('THERHEAN', i, 3) for i in range(1, 7)]) as want),
    g as (select doc_id, contains(lower(text), 'of retin') as has_phrase, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') as up from documents),
    o as (select doc_id, has_phrase, len([x for x in want if contains(up, x)]) / len(want)::double as overlap from g cross join w),
    s as (select o.doc_id, (case when has_phrase then 120.0 else 0 end) + (case when n_terms = 5 then 70.0 else 0 end) + 12.0 * coalesce(n_terms, 0) + (case when overlap >= 0.6 then 35.0 else 0 end) + least(40.0, 6 * coalesce(bm.score, 0)) as score
      from o left join n using (doc_id) left join bm using (doc_id) where has_phrase or n_terms > 0)
    select doc_id, round(score, 6) as score, {RANK.format('score')} as rank from s order by round(score, 6) desc, doc_id limit 40""")
def lexical_topk(spark, sf):
    return rounded(retrieval.lexical(table(spark, sf, "documents"), TERMS, "of retin", 40), "score").select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""with q as (select embedding::double[] as q from embeddings where vec_id = 0),
    s as (select vec_id, coalesce(list_cosine_similarity(embedding::double[], q), 0) as score from embeddings cross join q)
    select vec_id, round(score, 6) as score, row_number() over (order by round(score, 6) desc, vec_id) as rank from s where score >= 0.15 order by round(score, 6) desc, vec_id limit 20""")
def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    vector = rows.filter("vec_id = 0").first()["embedding"]
    return rounded(search.cosine_topk(rows, vector, 20), "score").select("vec_id", "score", F.col("rank").cast("long").alias("rank"))


PHRASES = ["licensed under", "all rights reserved", "of the", "nicht"]


@query(f"""select doc_id, phrase from (select doc_id, case {' '.join(f"when contains(h, '{p}') then '{p}'" for p in PHRASES)} end as phrase from (select doc_id, {FOLD.format("lower(text)")} as h from documents)) where phrase is not null""")
def phrase_match(spark, sf):
    return search.phrase_hits(table(spark, sf, "documents"), PHRASES)


@query("""with w as (select list_distinct([substr('METALLIC', i, 3) for i in range(1, 7)]) as want),
    g as (select p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') as up from part)
    select p_partkey, round(len([x for x in want if contains(up, x)]) / len(want)::double, 6) as overlap from g cross join w where len([x for x in want if contains(up, x)]) > 0""")
def trigram_match(spark, sf):
    return rounded(table(spark, sf, "part").select("p_partkey", search.trigram_overlap(F.col("p_name"), "metallic").alias("overlap")).filter("overlap > 0"), "overlap")


# Fusion, tiers and budgets


@query(f"""with {LISTS}, f as (select doc_id, sum(1.0 / (60 + rank)) * (1 + 0.15 * (count(distinct list) - 1)) + 0.01 * max(score) as rrf, count(distinct list) as n_lists from lists group by doc_id)
    select doc_id, round(rrf, 6) as rrf, n_lists, {RANK.format('rrf')} as rank from f order by round(rrf, 6) desc, doc_id limit 20""")
def rrf_fusion(spark, sf):
    return rounded(retrieval.fused(table(spark, sf, "documents"), TERMS, 20), "rrf").select("doc_id", "rrf", "n_lists", F.col("rank").cast("long").alias("rank"))


@query(f"""with {LISTS}, g as (select doc_id, max(score) filter (where list = 'bm25') as bs, min(rank) filter (where list = 'bm25') as br, sum(1.0 / (60 + rank)) as agg, count(*) filter (where list <> 'bm25') as support, max(score) filter (where list <> 'bm25') as other from lists group by doc_id)
    select doc_id, round(case when bs is not null then bs + 0.5 * agg + 0.25 * support + greatest(0, (20 - br) * 0.05) else agg + 0.1 * least(coalesce(other, 0), 5) end, 6) as fused, bs is not null as in_baseline from g""")
def baseline_fusion(spark, sf):
    return rounded(fuse.baseline_fusion(retrieval.ranked_lists(table(spark, sf, "documents"), TERMS, 50), "bm25"), "fused")


TIER = "case when contains(text, 'Licensed') then 1 when n_chars >= 2000 then 2 else 3 end"


@query(f"""select doc_id, source, tier, place from (select doc_id, source, {TIER} as tier, row_number() over (partition by {TIER}, source order by n_chars desc, doc_id) as place from documents) where place <= 3""")
def tiered_merge(spark, sf):
    tier = F.when(F.contains(F.col("text"), F.lit("Licensed")), 1).when(F.col("n_chars") >= 2000, 2).otherwise(3)
    return fuse.tiered(table(spark, sf, "documents"), tier, F.col("n_chars"), "source", 3).select("doc_id", "source", "tier", "place")


@query("""with b as (select source, case when source in ('src0', 'src1') then 8 else 3 end as budget from (select distinct source from documents)),
    k as (select doc_id, source, n_chars from (select d.*, row_number() over (partition by d.source order by n_chars desc, doc_id) as place, budget from documents d join b using (source)) where place <= budget)
    select doc_id, source, n_chars from k order by n_chars desc, doc_id limit 56""")
def per_source_budget(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    budget = docs.select("source").distinct().withColumn("budget", F.when(F.col("source").isin("src0", "src1"), 8).otherwise(3))
    return fuse.budgets(docs, "source", budget, [F.desc("n_chars"), F.col("doc_id")], 56).select("doc_id", "source", "n_chars")


@query("select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) where r = 1")
def best_per_key(spark, sf):
    return fuse.best_per_key(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id")


@query("select o_orderpriority, n, n - coalesce(lead(n) over (order by n desc, o_orderpriority), 0) as gap from (select o_orderpriority, count(*)::double as n from orders group by 1)")
def gap_to_next(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return fuse.with_gap(counts, "n", "o_orderpriority")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r <= 2")
def per_group_topn(spark, sf):
    return fuse.best_per_group(table(spark, sf, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 2).select("user_id", "event_id", "value")


# Canonical records


@query("""select lang, n_chars, min(doc_id) as first_id, count(*) as n_rows, count(distinct sha256(coalesce(text, ''))) as n_contents,
    case when count(*) = 1 then 'unique' when count(distinct sha256(coalesce(text, ''))) = 1 then 'duplicate' else 'collision' end as status from documents group by lang, n_chars""")
def dedupe_collision(spark, sf):
    hashed = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", canonical.content_hash("text").alias("h"))
    return canonical.dedupe_report(hashed, ["lang", "n_chars"], "h", "doc_id")


@query("select sha256(coalesce(text, '')) as content_hash, min(doc_id) as first_id, count(*) as n_rows from documents group by 1 having count(*) > 1")
def exact_dup_groups(spark, sf):
    return canonical.duplicate_groups(table(spark, sf, "documents"), "doc_id", "text")


@query("select doc_id, lang, source, n_chars from (select *, row_number() over (partition by source, lang order by doc_id) as r from documents) where r = 1")
def first_per_key(spark, sf):
    return canonical.first_per_key(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), ["source", "lang"], "doc_id")


@query("select doc_id, lang, source, n_chars from (select *, row_number() over (partition by source, lang order by doc_id desc) as r from documents) where r = 1")
def last_per_key(spark, sf):
    return canonical.last_per_key(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), ["source", "lang"], "doc_id")


@query("""select 'customer' as from_type, o_custkey as from_name, 'BUYS' as relation_type, 'part' as to_type, l_partkey as to_name, count(*) as occurrence_count, string_agg(distinct l_returnflag, '|' order by l_returnflag) as contexts
    from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey""")
def relation_aggregate(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = lines.select(F.lit("customer").alias("from_type"), F.col("o_custkey").alias("from_name"), F.lit("BUYS").alias("relation_type"), F.lit("part").alias("to_type"), F.col("l_partkey").alias("to_name"), "l_returnflag")
    return canonical.aggregate_relations(edges, "l_returnflag")


@query("""select event_type as type, 'u' || (user_id % 10) as name, string_agg(distinct coalesce(json_extract_string(props, '$.k'), ''), '|' order by coalesce(json_extract_string(props, '$.k'), '')) as reasons,
    string_agg(distinct event_type, '|') as sources, min(floor(value))::bigint as priority, bool_or(value > 100) as requires_validation from events group by 1, 2""")
def request_rollup(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("type"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("name"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("reason"), F.col("event_type").alias("source"), F.floor("value").alias("priority"), (F.col("value") > 100).alias("requires_validation"))
    return canonical.request_rollup(rows)


PROFILED = ["c_name", "c_nationkey", "c_mktsegment"]


@query(" union all ".join(f"select '{c}' as field, count({c}) as n_filled, count(*) - count({c}) as n_null, count(distinct {c}) as n_distinct, min(length({c}::varchar)) as min_len, max(length({c}::varchar)) as max_len from customer" for c in PROFILED))
def field_profile(spark, sf):
    return canonical.field_profile(table(spark, sf, "customer"), PROFILED)


@query("select o_orderkey, 'CUST=' || o_custkey || '|PRIO=' || trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g')) || '|STAT=' || o_orderstatus as pk from orders")
def primary_key(spark, sf):
    values = F.create_map(F.lit("STAT"), F.col("o_orderstatus"), F.lit("PRIO"), F.col("o_orderpriority"), F.lit("CUST"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", canonical.primary_key(values, ["CUST"]).alias("pk"))


# Graph

NODES = """n as (select 'R' || r_regionkey as node_id, 'region' as type, r_name as name, 'region' as source, true as authoritative from region
    union all select 'N' || n_nationkey, 'nation', n_name, 'nation', true from nation
    union all select 'C' || c_custkey, 'customer', c_name, 'customer', false from customer
    union all select 'S' || s_suppkey, 'supplier', s_name, 'supplier', false from supplier
    union all select 'N' || c_nationkey, 'nation', 'nation ' || c_nationkey, 'customer', false from customer)"""
EDGES = """e as (select 'N' || n_nationkey as from_id, 'R' || n_regionkey as to_id, 'IN_REGION' as relation from nation
    union all select 'C' || c_custkey, 'N' || c_nationkey, 'IN_NATION' from customer
    union all select 'S' || s_suppkey, 'N' || s_nationkey, 'IN_NATION' from supplier)"""


def graph_nodes(spark, sf):
    def part(name, prefix, key, label, source, known):
        return table(spark, sf, source).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_id"), F.lit(name).alias("type"), label.alias("name"), F.lit(source).alias("source"), F.lit(known).alias("authoritative"))

    parts = [part("region", "R", "r_regionkey", F.col("r_name"), "region", True), part("nation", "N", "n_nationkey", F.col("n_name"), "nation", True), part("customer", "C", "c_custkey", F.col("c_name"), "customer", False), part("supplier", "S", "s_suppkey", F.col("s_name"), "supplier", False)]
    parts.append(part("nation", "N", "c_nationkey", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), "customer", False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_edges(spark, sf):
    def part(source, a, x, b, y, relation):
        return table(spark, sf, source).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("from_id"), F.concat(F.lit(b), F.col(y).cast("string")).alias("to_id"), F.lit(relation).alias("relation"))

    return part("nation", "N", "n_nationkey", "R", "n_regionkey", "IN_REGION").unionByName(part("customer", "C", "c_custkey", "N", "c_nationkey", "IN_NATION")).unionByName(part("supplier", "S", "s_suppkey", "N", "s_nationkey", "IN_NATION"))


@query(f"with {NODES} select node_id, type, string_agg(distinct name, '|' order by name) as names, string_agg(distinct source, '|' order by source) as sources, bool_or(authoritative) as authoritative from n group by node_id, type")
def node_merge(spark, sf):
    return graph.merge_nodes(graph_nodes(spark, sf))


@query("""with x as (select 'P' || l_partkey as from_id, 'SUPPLIED_BY' as relation, 'S' || l_suppkey as to_id, l_linestatus as evidence_class, l_returnflag as context, l_linestatus = 'F' as authoritative from lineitem)
    select from_id, relation, to_id, evidence_class, count(*) as occurrences, string_agg(distinct context, '|' order by context) as contexts, bool_or(authoritative) as authoritative, substr(sha1(from_id || '|' || relation || '|' || to_id || '|' || evidence_class), 1, 24) as edge_id from x group by 1, 2, 3, 4""")
def edge_merge(spark, sf):
    lines = table(spark, sf, "lineitem")
    edges = lines.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("from_id"), F.lit("SUPPLIED_BY").alias("relation"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("to_id"), F.col("l_linestatus").alias("evidence_class"), F.lit(1).alias("occurrences"), F.col("l_returnflag").alias("context"), (F.col("l_linestatus") == "F").alias("authoritative"))
    return graph.merge_edges(edges)


@query("""with x as (select upper(p_brand) as name, 'part' as type from part union all select upper(p_type), 'kind' from part union all select upper(c_mktsegment), 'segment' from customer union all select upper(p_brand), 'brand' from part)
    select name, count(distinct type) as n_types, string_agg(distinct type, '|' order by type) as types, case when starts_with(name, '/') then 'namespace' else 'conflict' end as kind from x group by name having count(distinct type) > 1""")
def name_collision(spark, sf):
    p, c = table(spark, sf, "part"), table(spark, sf, "customer")
    rows = p.select(F.col("p_brand").alias("name"), F.lit("part").alias("type")).unionByName(p.select(F.col("p_type").alias("name"), F.lit("kind").alias("type"))).unionByName(c.select(F.col("c_mktsegment").alias("name"), F.lit("segment").alias("type"))).unionByName(p.select(F.col("p_brand").alias("name"), F.lit("brand").alias("type")))
    return graph.name_collisions(rows)


@query(f"with {EDGES} select seed, to_id, relation from (select from_id as seed, to_id, relation, row_number() over (partition by from_id order by relation, to_id) as r from (select distinct * from e) where from_id in ('C1', 'C2', 'N3', 'S1')) where r <= 24")
def graph_neighbors(spark, sf):
    seeds = spark.createDataFrame([("C1",), ("C2",), ("N3",), ("S1",)], "node_id string")
    return graph.neighbours(seeds, graph_edges(spark, sf), 24)


TWO_HOPS = f"""{EDGES}, b as (select from_id, to_id from e union select to_id, from_id from e), h0 as (select 'C1' as node_id union select 'S1'),
    h1 as (select distinct to_id as node_id from b join h0 on from_id = node_id where to_id not in (select node_id from h0)),
    h2 as (select distinct to_id as node_id from b join h1 on from_id = node_id where to_id not in (select node_id from h0 union select node_id from h1)),
    f as (select node_id, 0 as distance from h0 union all select node_id, 1 from h1 union all select node_id, 2 from h2)"""


@query(f"with {TWO_HOPS} select node_id, distance from f")
def bfs_2hop(spark, sf):
    seeds = spark.createDataFrame([("C1",), ("S1",)], "node_id string")
    return graph.bounded_search(seeds, graph_edges(spark, sf), 2)


@query(f"""with {TWO_HOPS}, deg as (select to_id as node_id, count(*) as occ from e group by 1)
    select node_id, distance, (case when node_id like 'N%' or node_id like 'R%' then 0 else 1 end) * 1000 + (case when distance <= 1 then 0 else 1 end) * 100 + 20 + distance * 10 - least(coalesce(occ, 0), 50) as cost from f left join deg using (node_id) order by cost, node_id limit 30""")
def graph_rank(spark, sf):
    found = bfs_2hop(spark, sf)
    degree = graph_edges(spark, sf).groupBy(F.col("to_id").alias("node_id")).agg(F.count(F.lit(1)).alias("occ"))
    known = F.when(F.col("node_id").rlike("^[NR]"), 0).otherwise(1)
    cost = graph.candidate_cost(known, F.when(F.col("distance") <= 1, 0).otherwise(1), F.lit(1), F.col("distance"), F.coalesce("occ", F.lit(0)))
    return found.join(degree, "node_id", "left").select("node_id", "distance", cost.alias("cost")).orderBy("cost", "node_id").limit(30)


@query(f"with {EDGES} select from_id, to_id, relation, case relation when 'IN_NATION' then 'LOCATED_IN' else 'RELATED' end as relation_unified from e")
def relation_unify(spark, sf):
    return graph.unify_relations(graph_edges(spark, sf), {"IN_NATION": "LOCATED_IN"})


@query("select 'P' || l_partkey as from_id, 'SUPPLIED_BY' as relation, 'S' || l_suppkey as to_id, max(l_discount) as confidence from lineitem group by l_partkey, l_suppkey")
def edge_max_merge(spark, sf):
    lines = table(spark, sf, "lineitem")
    return graph.max_merge_edges(lines.select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("from_id"), F.lit("SUPPLIED_BY").alias("relation"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("to_id"), F.col("l_discount").alias("confidence")))


# Links


@query("select doc_id, lang, source from documents where doc_id in (select doc_id from labels)")
def semi_referenced(spark, sf):
    return link.referenced(table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels"), "doc_id")


@query("select doc_id, lang, source from documents where doc_id not in (select doc_id from labels)")
def anti_pending(spark, sf):
    return link.unreferenced(table(spark, sf, "documents").select("doc_id", "lang", "source"), table(spark, sf, "labels"), "doc_id")


@query("""with n as (select n_nationkey as c_nationkey, n_name as label from nation where n_nationkey < 10), r as (select n_nationkey as c_nationkey, r_name as label from nation join region on n_regionkey = r_regionkey where n_nationkey < 20)
    select c_custkey, coalesce(n.label, r.label) as label, case when n.label is not null then 'nation' when r.label is not null then 'region' else 'unresolved' end as via from customer left join n using (c_nationkey) left join r using (c_nationkey)""")
def chain_fallback(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    first = nation.filter("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    second = nation.filter("n_nationkey < 20").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("label"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return link.fallback_chain(rows, [(first, "c_nationkey", "nation"), (second, "c_nationkey", "region")], "label").select("c_custkey", "label", "via")


@query("""select source, doc_id, lang, n_chars from (select *, row_number() over (partition by source order by case lang when 'de' then 0 when 'fr' then 1 else 2 end, doc_id) as r from documents) where r = 1""")
def lang_pref_lookup(spark, sf):
    return link.preferred(table(spark, sf, "documents"), "source", "lang", ("de", "fr"), "n_chars", "doc_id")


@query("select o_orderkey, o_custkey, c_custkey as match, case when c_custkey is null then 'unresolved' else 'resolved' end as status from orders left join customer on o_custkey = substr(c_name, 10)::bigint")
def padded_key_join(spark, sf):
    names = table(spark, sf, "customer").select(F.substring("c_name", 10, 20).alias("code"), "c_custkey")
    linked = link.padded_join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey", "code")
    return linked.select("o_orderkey", "o_custkey", F.col("match").cast("long").alias("match"), "status")


@query("""with a as (select o_orderkey as access_id, 'brand' as field, 'Brand#' || (1 + o_orderkey % 5) || (1 + o_custkey % 5) as literal from orders union all select o_orderkey, 'size', lpad((1 + o_custkey % 50)::varchar, 6, '0') from orders),
    r as (select p_partkey as row_id, 'brand' as field, p_brand as value from part union all select p_partkey, 'size', p_size::varchar from part),
    h as (select access_id, row_id, count(distinct a.field) as got from a join r on a.field = r.field and (case when regexp_matches(literal, '^[0-9]+$') then ltrim(literal, '0') else upper(literal) end) = (case when regexp_matches(value, '^[0-9]+$') then ltrim(value, '0') else upper(value) end) group by 1, 2),
    c as (select access_id, count(*) as n_rows, min(row_id) as first_row from h where got = 2 group by 1)
    select o_orderkey as access_id, coalesce(n_rows, 0) as n_rows, first_row, case when n_rows = 1 then 'RESOLVES_TABLE_ROW' when n_rows > 1 then 'CANDIDATE' else 'UNRESOLVED' end as kind, case when n_rows = 1 then 0.9 when n_rows > 1 then greatest(0.2, least(0.7, round(1.0 / n_rows, 6))) else 0.0 end::double as confidence from orders left join c on o_orderkey = access_id""")
def code_row_resolution(spark, sf):
    orders, part = table(spark, sf, "orders"), table(spark, sf, "part")
    brand = F.concat(F.lit("Brand#"), (1 + F.col("o_orderkey") % 5).cast("string"), (1 + F.col("o_custkey") % 5).cast("string"))
    accesses = orders.select(F.col("o_orderkey").alias("access_id"), F.inline(F.array(F.struct(F.lit("brand").alias("field"), brand.alias("literal")), F.struct(F.lit("size").alias("field"), F.lpad((1 + F.col("o_custkey") % 50).cast("string"), 6, "0").alias("literal")))))
    rows = part.select(F.col("p_partkey").alias("row_id"), F.inline(F.array(F.struct(F.lit("brand").alias("field"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("field"), F.col("p_size").cast("string").alias("value")))))
    return rounded(link.resolve_literals(accesses, rows, "access_id"), "confidence")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'red') or contains(lower(p_name), 'bolt')")
def substring_any(spark, sf):
    return table(spark, sf, "part").filter(link.contains_any(F.col("p_name"), ["RED", "bolt", "a"])).select("p_partkey", "p_name")


@query("select doc_id from documents where regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')")
def token_contains(spark, sf):
    return table(spark, sf, "documents").filter(link.contains_token(F.col("text"), "the")).select("doc_id")


# Profiles and inventories


@query("""with c as (select 'event_type' as field, event_type as value, count(*) as n from events group by 2 union all select 'user_id', user_id::varchar, count(*) from events group by 2)
    select field, value, n, place from (select *, row_number() over (partition by field order by n desc, value) as place from c) where place <= 6""")
def value_distribution(spark, sf):
    return profile.value_distribution(table(spark, sf, "events"), ["event_type", "user_id"])


@query("select o_orderpriority, count(*) as n from orders group by 1 order by n desc, 1 limit 3")
def top_counts(spark, sf):
    return profile.top_counts(table(spark, sf, "orders"), "o_orderpriority", 3)


PROFILE_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n_rows, count(distinct {k}) as n_keys, count(*) filter (where {k} is null) as n_null_keys, case when count(*) = 0 then 'EMPTY' when count(*) <= 80 then 'SMALL_CUSTOMIZING' when count(distinct {k}) = count(*) then 'MASTER_DATA' else 'TRANSACTIONAL' end as category from {t}" for t, k in PROFILE_KEYS.items()))
def table_profile(spark, sf):
    out = None
    for name, key in PROFILE_KEYS.items():
        part = profile.table_profile(table(spark, sf, name), name, key, profile.table_category(F.col("n_rows"), F.col("n_keys")))
        out = part if out is None else out.unionByName(part)
    return out


@query("select l_orderkey, count(*) as n_rows, count(distinct l_partkey) as n_children from lineitem group by 1 having count(*) >= 2")
def rule_groups_parent(spark, sf):
    return profile.parent_groups(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("select (case when l_discount > 0 then '1' else '0' end) || (case when l_tax > 0 then '1' else '0' end) || '1' as signature, count(*) as n_rows from lineitem group by 1 having count(*) >= 3")
def rule_groups_signature(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.when(F.col("l_discount") > 0, "x").alias("a"), F.when(F.col("l_tax") > 0, "x").alias("b"), F.col("l_returnflag").alias("c"))
    return profile.signature_groups(lines, ["a", "b", "c"])


@query("select upper(substr(p_name, 1, 12)) as prefix, count(*) as n_rows from part group by 1 having count(*) >= 3")
def rule_groups_prefix(spark, sf):
    return profile.prefix_groups(table(spark, sf, "part"), "p_name")


@query("""with g as (select lang, count(*) filter (where regexp_matches(text, '[0-9]')) as hits, count(*) as n from documents group by lang),
    s as (select *, hits * 100 + hits / n::double * 20 + least(n, 50) * 0.01 as score from g),
    w as (select *, score - coalesce(lead(score) over (order by score desc, lang), 0) as gap from s)
    select lang, hits, n, round(score, 6) as score, round(gap, 6) as gap, case when hits >= 10 and hits / n::double >= 0.35 and gap >= 50 then 'HIGH' when hits >= 5 and hits / n::double >= 0.2 then 'MEDIUM' else 'LOW' end as confidence from w""")
def density_selection(spark, sf):
    return rounded(profile.density_selection(table(spark, sf, "documents"), "lang", F.col("text").rlike("[0-9]")), "score", "gap")


@query("""select o_orderpriority, count(distinct o_orderkey) as n_items, count(distinct o_custkey) as n_partners, count(*) as n_rows, max(n_all) as n_all, round(count(distinct o_orderkey) / max(n_all)::double, 6) as share
    from orders cross join (select count(distinct o_orderkey) as n_all from orders) group by 1""")
def inventory_agg(spark, sf):
    return rounded(profile.inventory(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", "o_custkey"), "share")


@query("""select conv_id, count(distinct turn) as n_members, min(turn) as min_distance, string_agg(distinct role, '|' order by role) as roles, case when count(distinct role) > 1 then 'MIXED' when max(role) = 'assistant' then 'PRODUCER' else 'CONSUMER' end as class from conversations group by 1""")
def entity_rollup(spark, sf):
    return profile.entity_rollup(table(spark, sf, "conversations"), "conv_id", "turn", "turn", "role")


@query("""select field, string_agg(value, '|' order by value) filter (where r <= 24) as values, count(*) as n from (select field, value, row_number() over (partition by field order by value) as r from
    (select distinct 'p_brand' as field, p_brand as value from part union all select distinct 'p_type', p_type from part)) group by field""")
def value_catalogue(spark, sf):
    return profile.value_catalogue(table(spark, sf, "part"), ["p_brand", "p_type"])


# Gates and evaluation

CONCEPTS = ["nation", "licensed", "the", "nicht", "dans"]


@query("""with m as (select source, contains(t, 'nation')::int as c0, contains(t, 'licensed')::int as c1, contains(s, ' the ')::int as c2, contains(t, 'nicht')::int as c3, contains(t, 'dans')::int as c4 from
    (select source, lower(coalesce(text, '')) as t, ' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g') || ' ' as s from documents)),
    g as (select source, max(c0) + max(c1) + max(c2) + max(c3) + max(c4) as covered, count(*) filter (where (c0 + c1 + c2 + c3 + c4) * 2 >= 5) as supporting from m group by source)
    select source, covered, supporting, case when supporting = 0 or covered / 5.0 < 0.34 then 'insufficient' when covered / 5.0 >= 0.75 then 'answerable' when covered / 5.0 >= 0.6 then 'partially' else 'insufficient' end as verdict from g""")
def coverage_gate(spark, sf):
    return gate.coverage_by_group(table(spark, sf, "documents"), "source", "text", CONCEPTS)


@query(f"""with {BM25}, ranked as (select doc_id, {RANK.format('score')} as rank from bm), rel as (select doc_id from labels where quality = 1), c as (select unnest([3, 5, 10, 50]) as cut)
    select cut, count(rel.doc_id) as n_hits, round(count(rel.doc_id) / cut::double, 6) as precision, round(count(rel.doc_id) / (select count(*) from rel)::double, 6) as recall from ranked join c on rank <= cut left join rel using (doc_id) group by cut""")
def hit_at_k(spark, sf):
    ranked = search.top_k(search.bm25_scores(table(spark, sf, "documents"), TERMS), 50)
    return rounded(gate.hits_at(ranked, table(spark, sf, "labels").filter("quality = 1").select("doc_id"), (3, 5, 10, 50)), "precision", "recall")


@query("select o_orderkey, case when o_orderstatus = 'F' then 'AUTHORITATIVE' when o_totalprice > 200000 then 'CODE_DERIVED' when o_totalprice > 100000 then 'INFERRED' else 'UNSUPPORTED' end as tier from orders")
def claim_tier(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", gate.claim_tier(F.col("o_orderstatus") == "F", price > 200000, price > 100000).alias("tier"))


@query("select doc_id, lang from documents where lang in ('de', 'fr') or contains(text, 'Licensed')")
def type_filter(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(gate.type_filter(F.col("lang"), ["de", "fr"], F.contains(F.col("text"), F.lit("Licensed")))).select("doc_id", "lang")


@query("select event_id from events where json_extract_string(props, '$.k') = '7'")
def metadata_filter(spark, sf):
    rows = table(spark, sf, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return rows.filter(gate.metadata_filter(F.col("m"), {"k": "7", "other": " "})).select("event_id")


# Incremental


@query("select doc_id, case when doc_id % 10 = 0 then 'added' when doc_id % 10 = 1 then 'removed' when doc_id % 10 = 2 then 'changed' else 'unchanged' end as change from documents")
def incremental_changes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", canonical.content_hash("text").alias("h"))
    old = docs.filter("doc_id % 10 <> 0").withColumn("h", F.when(F.col("doc_id") % 10 == 2, F.lit("old")).otherwise(F.col("h")))
    return incremental.changes(old, docs.filter("doc_id % 10 <> 1"), "doc_id", "h")


@query("select doc_id, lang from documents where doc_id % 2 = 1 or doc_id % 10 = 2")
def incremental_pending(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", canonical.content_hash("text").alias("h"))
    old = docs.filter("doc_id % 2 = 0").withColumn("h", F.when(F.col("doc_id") % 10 == 2, F.lit("old")).otherwise(F.col("h")))
    return incremental.pending(old, docs, "doc_id", "h").select("doc_id", "lang")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'new' else 'old' end as h, case when o_orderkey % 3 = 2 then 2 else 1 end as created from orders where o_orderkey % 3 < 2 union all select o_orderkey, 'new', 2 from orders where o_orderkey % 3 = 2")
def incremental_upsert(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey")
    old = keys.filter("o_orderkey % 3 < 2").select("o_orderkey", F.lit("old").alias("h"), F.lit(1).alias("created"))
    new = keys.filter("o_orderkey % 3 <> 1").select("o_orderkey", F.lit("new").alias("h"), F.lit(2).alias("created"))
    return incremental.upsert(old, new, "o_orderkey", "h", "created")


@query("select doc_id, 'left_only' as side from documents where doc_id not in (select doc_id from labels) union all select distinct doc_id, 'right_only' from labels where doc_id not in (select doc_id from documents)")
def set_diff(spark, sf):
    return incremental.both_ways(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("select event_type, date_trunc('hour', ts) as window_start, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, sf):
    return rounded(sync.windowed_events(table(spark, sf, "events")), "total", digits=4)


# Scalars


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"select doc_id, sha256({FOLD.format('lower(text)')}) as folded from documents")
def fold_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.search_key("text"), 256).alias("folded"))


@query("select doc_id, 'sd_' || substr(sha256(concat_ws('|', source, lang, doc_id::varchar)), 1, 32) as sd_id from documents")
def search_document_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.search_document_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("sd_id"))


@query("select c_custkey, case when regexp_matches(substr(c_name, 10), '^[0-9]+$') then coalesce(nullif(ltrim(substr(c_name, 10), '0'), ''), '0') else upper(substr(c_name, 10)) end as literal from customer")
def normalize_literal(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.normal_literal(F.substring("c_name", 10, 50)).alias("literal"))


@query("""with u as (select page_id, list_distinct(regexp_extract_all(url, '[a-z0-9]+')) as parts from pages) select page_id, unnest(parts) as part from u""")
def url_symbols(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("url", F.lit("([a-z0-9]+)"), 1))).alias("part"))


@query("""with v as (select page_id, unnest(list_distinct(regexp_extract_all(html, '"([^"<>]{1,60})"', 1))) as value from pages)
    select value, count(*) as n, min(page_id) as first_page from v group by value""")
def literal_index(spark, sf):
    found = table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('"([^"<>]{1,60})"'), 1))).alias("value"))
    return found.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query("""select doc_id, case when p > 0 then substr(t, greatest(1, p - 60), 240) else substr(t, 1, 220) end as snippet from
    (select doc_id, t, instr(lower(t), 'nation') as p from (select doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t from documents))""")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.snippet("text", F.lit("nation")).alias("snippet"))


@query("select vec_id, true as same from embeddings")
def vector_codec(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("b", vectors.encode_vector(F.col("embedding")))
    return rows.select("vec_id", (vectors.valid_vector(F.col("b"), F.size("embedding")) & (vectors.decode_vector(F.col("b")) == F.col("embedding"))).alias("same"))


# Grounding and gates


@query("""select doc_id, n_chars, status as topic_status from (select doc_id, n_chars, case when t >= 2 or (t >= 1 and e > 0) then 'confirmed' when t >= 1 then 'possible' else 'not_relevant' end as status from
    (select doc_id, n_chars, contains(lower(text), 'licensed')::int + contains(lower(text), 'version')::int as t, contains(lower(text), 'apache')::int as e from documents)) where status <> 'not_relevant'""")
def topic_grounding(spark, sf):
    has = lambda w: F.contains(F.lower("text"), F.lit(w)).cast("int")
    hits = table(spark, sf, "documents").select("doc_id", "n_chars", (has("licensed") + has("version")).alias("t"), has("apache").alias("e"))
    return grounding.ground_topics(hits, grounding.topic_status(F.col("t"), F.col("e"), True), "n_chars", "doc_id").select("doc_id", "n_chars", "topic_status")


@query("""with n as (select unnest(['red', 'bolt', 'small ring', 'promo', 'zzz', 'lonely']) as name), h as (select name, contains(lower(p_name), name) as s, contains(lower(p_type), name) as w from part cross join n)
    select name, case when count(*) filter (where s) > 0 then 'confirmed' when count(*) filter (where w and not s) > 0 then 'possible' when name like 'zz%' and sum(count(*) filter (where s and name <> 'lonely')) over () > 0 then 'contradicted' else 'not_found' end as status, count(*) filter (where s) as n_strong, count(*) filter (where w and not s) as n_weak from h group by name""")
def entity_grounding(spark, sf):
    names = spark.createDataFrame([(n, "own" if n == "lonely" else "word") for n in ("red", "bolt", "small ring", "promo", "zzz", "lonely")], "name string, kind string")
    return grounding.entity_report(table(spark, sf, "part"), names, "p_name", "p_type", "p_partkey")


@query("""with m as (select p_partkey, contains(lower(p_name), 'bolt')::int as own, contains(lower(p_name), 'red')::int as shared, p_size >= 25 as named from part)
    select p_partkey, case when own >= 1 then 'PRIMARY' when shared >= 1 and named then 'SECONDARY' else 'EXCLUDED' end as tier, case when own = 0 and shared >= 1 and not named then 'shared_token_only' when own + shared = 0 then 'no_token' end as reason from m""")
def process_tiers(spark, sf):
    has = lambda w: F.contains(F.lower("p_name"), F.lit(w)).cast("int")
    return table(spark, sf, "part").select("p_partkey", grounding.process_tier(has("bolt"), has("red"), F.col("p_size") >= 25).alias("t")).select("p_partkey", "t.tier", "t.reason")


@query("select c_mktsegment as obj, max(c_nationkey % 4) as coverage, min(c_custkey % 3) as distance from customer group by 1 having max(c_nationkey % 4) >= 2 and min(c_custkey % 3) <= 1 order by coverage desc, distance, obj limit 5")
def strong_seeds(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("obj"), (F.col("c_nationkey") % 4).alias("cov"), (F.col("c_custkey") % 3).alias("dist"))
    return grounding.strong_seeds(rows, "obj", "cov", "dist", 3)


@query("""with s as (select doc_id from documents where contains(text, 'Licensed')), o as (select distinct source from documents where doc_id in (select doc_id from s))
    select doc_id from s union select doc_id from documents where n_chars > 3000 and source in (select source from o)""")
def support_expansion(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", (F.col("n_chars") > 3000).alias("strong"), F.contains("text", F.lit("Licensed")).alias("hit"))
    return grounding.support_by_object(docs, docs.filter("hit"), "source", "strong", "doc_id")


@query("select p_partkey from part where not contains(upper(p_name), 'WIDGET') and (p_size < 10 or contains(upper(p_name), 'RED'))")
def noise_filter(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") >= 10, "control_table").otherwise("program").alias("kind"))
    return grounding.without_noise(rows, "p_name", "kind", ["red"], noise=("WIDGET",)).select("p_partkey")


@query("select kind, need, coalesce(n, 0) as n, coalesce(n, 0) >= need as met from (values ('click', 10), ('none', 1), ('view', 1000000)) as w(kind, need) left join (select event_type as kind, count(*) as n from events group by 1) using (kind)")
def evidence_budget(spark, sf):
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return grounding.claim_budget(counts, {"click": 10, "none": 1, "view": 1_000_000})


@query("select o_orderkey, case when o_orderstatus = 'F' then 'code_resolved' when n_rows <= 80 then 'small_customizing' when o_totalprice > 300000 then 'hardcoding' when o_orderstatus <> 'P' and n_rows <= 100 then 'ungrouped' when n_rows <= 20 and 1 >= 15 then 'high_score' else 'not_primary' end as why from (select *, o_custkey % 200 as n_rows from orders)")
def row_relevance(spark, sf):
    n = F.col("o_custkey") % 200
    why = gate.row_relevance(F.col("o_orderstatus") == "F", n, F.col("o_totalprice") > 300000, F.col("o_orderstatus") == "P", F.lit(1))
    return table(spark, sf, "orders").select("o_orderkey", why.alias("why"))


# Master data


@query("""with e as (select c_custkey, 'CUSTKEY' as field, c_custkey::varchar as value, 'customer' as entity_type, 0.95 as confidence from customer union all select c_custkey, 'NATIONKEY', c_nationkey::varchar, 'country', 0.8 from customer)
    select c_custkey, field, value, entity_type, confidence::double as confidence from e""")
def row_entities(spark, sf):
    values = F.create_map(F.lit("CUSTKEY"), F.col("c_custkey").cast("string"), F.lit("NATIONKEY"), F.col("c_nationkey").cast("string"), F.lit("MANDT"), F.lit("100"), F.lit("OTHERKEY"), F.lit("x"), F.lit("VENDOR"), F.lit(" "))
    return masterdata.row_entities(table(spark, sf, "customer").select("c_custkey", values.alias("values")), "c_custkey")


@query("""select 'nation|' || n_nationkey as "from", 'HAS_KEY' as relation, 'N_NATIONKEY=' || n_nationkey as "to" from nation union all select 'nation|' || n_nationkey, 'HAS_VALUE', 'N_NAME=' || n_name from nation
    union all select 'nation|' || n_nationkey, 'HAS_VALUE', 'N_REGIONKEY=' || n_regionkey from nation union all select 'nation|' || n_nationkey, 'ROW_OF', 'nation' from nation""")
def row_relations(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.create_map(F.lit("N_NATIONKEY"), F.col("n_nationkey").cast("string")).alias("pk"), F.create_map(F.lit("N_NAME"), F.col("n_name"), F.lit("N_REGIONKEY"), F.col("n_regionkey").cast("string")).alias("values"))
    return masterdata.row_relations(rows, "nation", "n_nationkey", "pk", "values")


@query("""with m as (select 'segment' as type, c_mktsegment as name, max_by(c_name, c_custkey) as last_name, max_by(c_nationkey, c_custkey) as last_nation from customer group by 2), f as (select c_mktsegment as name, min_by(c_name, c_custkey) as display_name from customer where c_custkey % 2 = 1 group by 1)
    select type, name, display_name, 'last=' || last_name || ';nation=' || last_nation as attributes from m left join f using (name)""")
def object_merge(spark, sf):
    rows = table(spark, sf, "customer").select(F.lit("segment").alias("type"), F.col("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")).alias("display_name"), F.create_map(F.lit("last"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("attributes"), "c_custkey")
    return masterdata.merge_objects(rows, "c_custkey")


@query("""select o_custkey as "from", o_orderstatus as "to", count(*) as occurrences, 'prio=' || string_agg(distinct o_orderpriority, ',' order by o_orderpriority) || ';stat=' || o_orderstatus as contexts from orders group by 1, 2""")
def parsed_contexts(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("from"), F.col("o_orderstatus").alias("to"), F.concat(F.lit("prio="), "o_orderpriority", F.lit("; stat = "), "o_orderstatus").alias("meta"))
    return masterdata.contexts_of(rows, F.col("meta"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 'ROW|' || o_orderkey when o_orderkey % 4 = 1 then 'FIELD|F' || o_custkey || '|3' when o_orderkey % 4 = 2 then 'KEY|A=' || o_custkey || '|B=x' else 'ID|' || o_custkey end as key from orders")
def record_keys(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.col("o_custkey").cast("string")
    values = F.when(k == 2, F.create_map(F.lit("A"), text, F.lit("B"), F.lit("x"))).otherwise(F.create_map(F.lit("A"), text, F.lit("ID"), text))
    key = masterdata.record_key(F.when(k == 0, F.col("o_orderkey")), F.when(k == 1, F.concat(F.lit("F"), text)), F.lit(3), values, ["A", "B"], ["NO", "ID"])
    return table(spark, sf, "orders").select("o_orderkey", key.alias("key"))


@query("select l_orderkey, l_linenumber, l_partkey, p_brand, p_partkey is not null as has_definition from lineitem left join (select p_partkey, p_brand from part where p_partkey % 2 = 0) on l_partkey = p_partkey")
def definition_join(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    known = table(spark, sf, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return masterdata.with_definition(rows, known, ["l_partkey"])


@query("""select p_partkey, (case when p_size > 40 then 35 else 0 end) + (case h when 3 then 60 when 2 then 40 when 1 then 25 else 0 end) + (case when n then 20 else 0 end) as score from
    (select p_partkey, p_size, contains(lower(p_type), 'steel')::int + contains(lower(p_type), 'promo')::int + contains(lower(p_type), 'small')::int as h, contains(lower(p_name), 'small') as n from part)""")
def master_field_score(spark, sf):
    name = F.concat(F.when(F.col("p_size") > 40, "Z").otherwise("a"), "p_name")
    return table(spark, sf, "part").select("p_partkey", masterdata.field_score(name, F.col("p_type"), ["steel", "promo", "small"]).alias("score"))


# Evidence


@query("select doc_id, source, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents) where r <= 2")
def two_per_object(spark, sf):
    return evidence.at_most_per_object(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", 2, [F.desc("n_chars"), F.col("doc_id")])


@query("select c_nationkey, c_mktsegment, c_custkey from (select *, row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) as r from customer) where r = 1 order by c_custkey limit 5")
def first_per_location(spark, sf):
    return evidence.distinct_places(table(spark, sf, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment"], ["c_custkey"], 5)


@query("select doc_id, lang, n_chars from (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as r from documents) where r <= case lang when 'de' then 3 when 'en' then 4 else 1 end order by n_chars desc, doc_id limit 8")
def coherent_selection(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return evidence.coherent_selection(rows, "lang", {"de": 3, "en": 4}, 1, [F.desc("n_chars"), F.col("doc_id")], 8)


@query("""with s as (select doc_id, row_number() over (order by doc_id desc) as rank from labels where toxic = 1 order by doc_id desc limit 20), p as (select doc_id, row_number() over (order by n_chars desc, doc_id) as rank from documents order by n_chars desc, doc_id limit 200),
    m as (select doc_id, min(k) as k from (select doc_id, rank as k from s union all select doc_id, 1000000000 + rank from p) group by 1)
    select doc_id, row_number() over (order by k) as rank, k < 1000000000 as is_seed from m""")
def preserved_merge(spark, sf):
    seeds = search.top_k(table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.col("doc_id").alias("score")), 20)
    primary = search.top_k(table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score")), 200)
    return evidence.preserved_merge(seeds, primary, "doc_id", "rank").withColumn("rank", F.col("rank").cast("long"))


@query("select event_type as kind, 'u' || user_id as norm, max(value) as confidence, min(event_id) as first_round, max(value) >= 0.55 and length('u' || user_id) >= 3 as strong from events group by 1, 2")
def anchor_merge(spark, sf):
    return evidence.anchor_merge(table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("u"), "user_id").alias("norm"), F.col("value").alias("confidence"), F.col("event_id").alias("round")))


@query("select coalesce(doc_id, l.doc_id) as doc_id, lang, quality, d.doc_id is not null as in_types, l.doc_id is not null as in_processing from (select doc_id, lang from documents where doc_id % 3 > 0) d full join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)")
def inventory_rows(spark, sf):
    quality = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return evidence.full_inventory(table(spark, sf, "documents").filter("doc_id % 3 > 0").select("doc_id", "lang"), quality, "doc_id")


@query("""with c as (select o_orderpriority as v, count(*) as n from orders group by 1), t as (select * from c order by n desc, v limit 3)
    select count(*) as n_values, count(distinct o_custkey) as n_owners, count(distinct o_orderstatus) as n_partners, (select string_agg(v || '=' || n, ',' order by n desc, v) from t) as top_values from orders""")
def seed_profile(spark, sf):
    return evidence.seed_profile(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority", 3)


@query("select l_returnflag || l_linestatus as rule, count(distinct l_partkey) as n_members, min(l_discount) as least, max(l_discount) as most from lineitem group by 1")
def rule_rollup(spark, sf):
    return evidence.rule_rollup(table(spark, sf, "lineitem").withColumn("rule", F.concat("l_returnflag", "l_linestatus")), "rule", "l_partkey", "l_discount")


@query("select source, n_records, case when n_records > 0 then 'available' else 'empty' end as status from (select 'documents' as source, count(*) as n_records from documents union all select 'labels', count(*) from labels union all select 'none', count(*) from labels where false)")
def source_coverage(spark, sf):
    labels = table(spark, sf, "labels")
    return evidence.source_coverage({"documents": table(spark, sf, "documents"), "labels": labels, "none": labels.filter("false")})


@query("""with t as (select distinct lang as kind, doc_id from documents where n_chars > 1000), f as (select distinct lang as kind, doc_id from documents where n_chars > 2000 or doc_id % 7 = 0)
    select kind, count(t.doc_id) as n_true, count(f.doc_id) as n_found, count(*) filter (where t.doc_id is not null and f.doc_id is not null) as n_common, round(n_common / nullif(n_true, 0)::double, 6) as recall, round(n_common / nullif(n_found, 0)::double, 6) as precision from t full join f using (kind, doc_id) group by kind""")
def recall_precision(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("kind"), "doc_id", "n_chars")
    return rounded(evidence.prediction_metrics(docs.filter("n_chars > 1000"), docs.filter("n_chars > 2000 or doc_id % 7 = 0"), ["kind", "doc_id"]), "recall", "precision")


@query("select o_custkey, o_orderkey from orders where o_custkey in (select o_custkey from orders where o_totalprice > 300000) and o_totalprice <= 300000")
def sibling_units(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return evidence.sibling_units(orders.filter("o_totalprice > 300000"), orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


# Search documents


@query("""with p as (select p_partkey::varchar as k, p_name, p_brand, p_size::varchar as s from part), d as (
    select 'table_row' as kind, 'part' as object_name, 'part ' || k as title, 'Title: part ' || k || chr(10) || 'Values: P_BRAND=' || p_brand || '; P_SIZE=' || s as search_text, 'part|' || k as source_key from p
    union all select 'master_field', 'F' || k, 'PART-F' || k, 'Title: PART-F' || k || chr(10) || 'Description: ' || p_name, 'PART|F' || k from p)
    select 'sd_' || substr(sha256(kind || '|' || source_key), 1, 32) as search_document_id, kind, object_name, title, search_text, source_key, sha256(kind || chr(10) || search_text) as content_hash from d""")
def search_documents(spark, sf):
    part = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    values = F.create_map(F.lit("P_BRAND"), F.col("p_brand"), F.lit("P_SIZE"), F.col("p_size").cast("string"), F.lit("EMPTY"), F.lit(" "))
    rows = documents.table_rows(part, "part", key, values)
    found = documents.corpus([rows, documents.fields(part, F.lit("PART"), F.concat(F.lit("F"), key), F.col("p_name")), rows])
    return found.drop("confidence", "metadata")


@query("""select p_partkey, f as field, v as value, c as class from part cross join (values ('tables', 'vbak', 'case_only'), ('tables', 'LIPS', 'only_left'), ('tables', 'VBAP', 'only_right')) as x(f, v, c)""")
def deviations(spark, sf):
    pairs = table(spark, sf, "part").select("p_partkey", F.lit("tables").alias("field"), F.array(F.lit("vbak"), F.lit("LIPS"), F.lit("T001")).alias("a"), F.array(F.lit("VBAK"), F.lit("VBAP"), F.lit("T001")).alias("b"))
    return documents.deviations(pairs, "p_partkey", "field", "a", "b")


from quern import catalog_code, catalog_text  # noqa: E402, F401  (register their queries)

"""The engine's own queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import chunking, citations, metrics, prep, profile, quantiles, retrieval, sync
from tesserae.operators.kinds import infer_kinds
from tesserae.operators.conditions import Filter, QueryError
from tesserae.operators.joins import small
from tesserae.operators.table_query import TableRequest, compile_request
from tesserae.sources.html import html_blocks_udf, sections_udf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calculated(df: DataFrame, operation: str, column: str | None = None, filters: tuple = (), by: tuple = (), order: str = "desc", limit: int | None = None, places: int | None = None, repair: bool = False) -> DataFrame:
    """A request's lazy result with its keys under their own names."""
    plan = compile_request(TableRequest("t", operation, column, tuple(Filter(*f) if not isinstance(f[2] if len(f) > 2 else None, tuple) else Filter(f[0], f[1], None, f[2]) for f in filters), by, order, limit), df, repair=repair)
    value = F.col("value") if places is None else F.round("value", places)
    return plan.limited.select(*(F.col(f"key{i}").alias(g) for i, g in enumerate(plan.groups)), value.alias("value"))


# ---------------------------------------------------------------- table calculator


@query("select count(*) as value from orders")
def tq_count_rows(spark, sf_dir):
    return calculated(read(spark, sf_dir, "orders"), "count")


@query("select count(c_name) as value from customer where c_acctbal > 0")
def tq_count_col(spark, sf_dir):
    return calculated(read(spark, sf_dir, "customer"), "count", "c_name", (("c_acctbal", ">", "0"),))


@query("select count(distinct o_custkey) as value from orders where o_orderstatus = 'F'")
def tq_nunique(spark, sf_dir):
    return calculated(read(spark, sf_dir, "orders"), "nunique", "o_custkey", (("o_orderstatus", "==", "f"),))


@query("select o_orderpriority, round(sum(o_totalprice), 2) as value from orders where o_orderstatus = 'F' group by 1 order by 2 desc, 1 limit 5")
def tq_sum_group_top(spark, sf_dir):
    return calculated(read(spark, sf_dir, "orders"), "sum", "o_totalprice", (("o_orderstatus", "==", "f"),), ("o_orderpriority",), limit=5, places=2)


@query("select l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) as value from lineitem group by 1, 2")
def tq_mean_two_keys(spark, sf_dir):
    return calculated(read(spark, sf_dir, "lineitem"), "mean", "l_extendedprice", by=("l_returnflag", "l_linestatus"), places=4)


@query("select round(median(l_extendedprice), 4) as value from lineitem")
def tq_median(spark, sf_dir):
    return calculated(read(spark, sf_dir, "lineitem"), "median", "l_extendedprice", places=4)


@query("select 'min' as op, strftime(min(l_shipdate), '%Y-%m-%d') as value from lineitem union all select 'max', strftime(max(l_shipdate), '%Y-%m-%d') from lineitem")
def tq_min_max_date(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    return _union([calculated(df, op, "l_shipdate").select(F.lit(op).alias("op"), F.col("value").cast("date").cast("string").alias("value")) for op in ("min", "max")])


_NUMERIC = (("==", 17), ("!=", 17), (">", 40), (">=", 40), ("<", 5), ("<=", 5))


@query(" union all ".join([f"select '{op}' as op, count(*) as value from lineitem where l_quantity {'=' if op == '==' else op} {v}" for op, v in _NUMERIC] + ["select 'in', count(*) from lineitem where l_quantity in (1, 2, 3)"]))
def tq_filter_numeric(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    parts = [calculated(df, "count", filters=(("l_quantity", op, v),)).select(F.lit(op).alias("op"), "value") for op, v in _NUMERIC]
    parts.append(calculated(df, "count", filters=(("l_quantity", "in", (1, 2, 3)),)).select(F.lit("in").alias("op"), "value"))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_FOLD = "replace(strip_accents(lower({})), 'ß', 'ss')"


@query(
    f"select 'eq' as op, count(*) as value from customer where {_FOLD.format('c_mktsegment')} = 'building' union all select 'ne', count(*) from customer where {_FOLD.format('c_mktsegment')} <> 'building' "
    f"union all select 'in', count(*) from customer where {_FOLD.format('c_mktsegment')} in ('building', 'machinery') union all select 'contains', count(*) from customer where contains({_FOLD.format('c_mktsegment')}, 'build')"
)
def tq_filter_text(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    asked = {"eq": ("c_mktsegment", "==", " Building "), "ne": ("c_mktsegment", "!=", "BUILDING"), "in": ("c_mktsegment", "in", ("building", "Machinery")), "contains": ("c_mktsegment", "contains", "BUILD")}
    return _union([calculated(df, "count", filters=(f,)).select(F.lit(op).alias("op"), "value") for op, f in asked.items()])


@query("select 'is_null' as op, count(*) as value from documents left join labels using (doc_id) where quality is null union all select 'not_null', count(*) from documents left join labels using (doc_id) where quality is not null")
def tq_filter_null(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return _union([calculated(df, "count", filters=(("quality", op),)).select(F.lit(op).alias("op"), "value") for op in ("is_null", "not_null")])


_DAYS = {"==": "ts >= date '2024-01-15' and ts < date '2024-01-16'", "!=": "ts < date '2024-01-15' or ts >= date '2024-01-16'", ">": "ts >= date '2024-01-16'", ">=": "ts >= date '2024-01-15'", "<": "ts < date '2024-01-15'", "<=": "ts < date '2024-01-16'"}


@query(" union all ".join(f"select '{op}' as op, count(*) as value from events where {c}" for op, c in _DAYS.items()))
def tq_filter_date_day(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    return _union([calculated(df, "count", filters=(("ts", op, "2024-01-15"),)).select(F.lit(op).alias("op"), "value") for op in _DAYS])


@query("select s_nationkey, count(*) as value from supplier group by 1 order by 2, 1 limit 7")
def tq_group_asc_limit(spark, sf_dir):
    return calculated(read(spark, sf_dir, "supplier"), "count", by=("s_nationkey",), order="asc", limit=7)


@query("select event_type, round(sum(value), 2) as value from events where value is not null group by 1")
def tq_sum_events(spark, sf_dir):
    return calculated(read(spark, sf_dir, "events"), "sum", "value", by=("event_type",), places=2)


@query("select count(*) as value, 1 as notes from customer where c_mktsegment = 'MACHINERY'")
def tq_near_match(spark, sf_dir):
    """A misspelt value is repaired to the one that is meant."""
    plan = compile_request(TableRequest("t", "count", filters=(Filter("c_mktsegment", "==", "MACHINERRY"),)), read(spark, sf_dir, "customer"))
    return plan.result.withColumn("notes", F.lit(len(plan.notes)))


@query("select o_orderpriority, round(sum(o_totalprice), 2) as value from orders group by 1")
def tq_amount_text(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderpriority", F.format_string("$%,.2f", "o_totalprice").alias("price"))
    return calculated(df, "sum", "price", by=("o_orderpriority",), places=2)


_BAD = {
    "contains on a number": ("count", None, (("o_totalprice", "contains", "1"),)),
    "sum of text": ("sum", "o_orderstatus", ()),
    "no value": ("count", None, (("o_orderstatus", "==", None),)),
    "order of text": ("count", None, (("o_orderstatus", ">", "a"),)),
    "in on a date": ("count", None, (("o_orderdate", "in", ("2020",)),)),
    "unknown column": ("count", None, (("nothing_like_it", "==", "1"),)),
    "not a number": ("count", None, (("o_totalprice", "==", "abc"),)),
    "no column": ("sum", None, ()),
}


@query("select * from (values ('contains on a number', true), ('sum of text', true), ('no value', true), ('order of text', true), ('in on a date', true), ('unknown column', true), ('not a number', true), ('no column', true)) v(asked, refused)")
def tq_error_paths(spark, sf_dir):
    df, out = read(spark, sf_dir, "orders"), []
    for name, (op, column, filters) in _BAD.items():
        try:
            calculated(df, op, column, filters)
            out.append((name, False))
        except QueryError:
            out.append((name, True))
    return spark.createDataFrame(out, "asked string, refused boolean")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in _TABLES))
def catalog_counts(spark, sf_dir):
    return _union([calculated(read(spark, sf_dir, t), "count").select(F.lit(t).alias("table_name"), F.col("value").alias("n")) for t in _TABLES])


@query("select * from (values ('r_regionkey', 'integer'), ('r_name', 'text'), ('n_nationkey', 'integer'), ('n_name', 'text'), ('n_regionkey', 'integer'), ('ts', 'date'), ('event_type', 'text'), ('value', 'decimal'), ('event_id', 'integer'), ('user_id', 'integer'), ('props', 'text')) v(column_name, kind)")
def column_kinds(spark, sf_dir):
    kinds = {}
    for t in ("region", "nation", "events"):
        kinds |= infer_kinds(read(spark, sf_dir, t))
    return spark.createDataFrame(list(kinds.items()), "column_name string, kind string")


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")


@query(" union all ".join(f"select '{c}' as column_name, round(min({c}), 2)::double as low, round(max({c}), 2)::double as high, round(avg({c}), 4) as mean, round(median({c}), 4)::double as median, count(distinct {c}) as distinct_values, count(*) - count({c}) as missing from lineitem" for c in _NUMBERS))
def profile_numeric(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(*_NUMBERS)
    found = profile.profile(df, row=None)
    rows = [(c, float(p["min"]), float(p["max"]), p["mean"], p["median"], p["d"], p["missing"]) for c, p in found.items()]
    df = spark.createDataFrame(rows, "column_name string, low double, high double, mean double, median double, distinct_values long, missing long")
    return df.withColumns({c: F.round(c, n) for c, n in (("low", 2), ("high", 2), ("mean", 4), ("median", 4))})


@query()
def profile_lines(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    found = profile.profile(df, row="c_custkey")
    return spark.createDataFrame([(c, profile.column_line(c, p)) for c, p in found.items()], "column_name string, line string")


@query("select 'c_mktsegment' as column_name, value, count from (select c_mktsegment as value, count(*) as count, min(c_custkey) as at from customer group by 1 order by 2 desc, 3 limit 5)")
def value_counts(spark, sf_dir):
    return profile.value_counts(read(spark, sf_dir, "customer"), ["c_mktsegment"], 5, "c_custkey").select(F.col("column").alias("column_name"), "value", "count")


@query("select n_nationkey + 1 as row, (n_nationkey + 1)::varchar || ' | ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey as line from nation")
def row_render(spark, sf_dir):
    return profile.render_rows(read(spark, sf_dir, "nation").withColumn("_row", F.col("n_nationkey").cast("long") + 1))


@query()
def row_groups(spark, sf_dir):
    df = read(spark, sf_dir, "customer").withColumn("_row", F.col("c_custkey"))
    lines = profile.render_rows(df).withColumn("table_id", F.concat(F.lit("part-"), F.floor(F.col("row") / 500).cast("string")))
    return profile.row_groups(lines).select("table_id", "first", "last", F.size("lines").alias("n"))


# ---------------------------------------------------------------- tokens and keyword search

_TOKENS = "regexp_extract_all(strip_accents(lower(@)), '[\\p{L}\\p{N}_]+')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_STEM = (
    "case when length(t) <= 3 or regexp_matches(t, '[0-9]') then t when t like '%ies' and length(t) > 4 then t[:-4] || 'y' "
    "when regexp_matches(t, '(ch|sh|x|z|ss)es$') then t[:-3] when regexp_matches(t, '(ss|us|is)$') then t when t like '%s' then t[:-2] else t end"
)
_TERMS = (
    "d as (select doc_id as id, " + _TOKENS.replace("@", "regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')") + " as w from documents), "
    f"e as (select id, unnest(list_filter(w, lambda x: not list_contains({_STOP}, x))) as t from d), s as (select id, {_STEM} as term from e)"
)


@query("with " + _TERMS + " select term, count(distinct id) as df, count(*) as tf from s group by term")
def tokens_df(spark, sf_dir):
    """Document frequency of every keyword."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(T.parted(F.col("text")))).alias("t")).select("doc_id", T.keywords(F.col("t")).alias("term"))
    return docs.where("term is not null").groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


_BM25 = (
    "with " + _TERMS + ", p as (select id, term, count(*) as tf from s group by 1, 2), l as (select id, count(*) as dl from s group by 1), "
    "n as (select count(*) as n from documents), a as (select (select count(*) from s) / (select n from n) as avgdl), "
    "f as (select term, ln(n.n - count(*) + 0.5) - ln(count(*) + 0.5) as idf from p, n group by term, n.n), m as (select avg(idf) as mean from f), "
    "q as (select item_id as qid, " + _TOKENS.replace("@", "regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g')") + " as w from benchmark), "
    f"qe as (select qid, unnest(list_filter(w, lambda x: not list_contains({_STOP}, x))) as t from q), qs as (select distinct qid, {_STEM} as term from qe), "
    "c as (select qid, p.id, sum(case when length(qs.term) >= 3 and regexp_matches(qs.term, '[0-9]') then 3 else 1 end * case when idf < 0 then 0.25 * mean else idf end * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score "
    "from qs join f using (term) join p using (term) join l on l.id = p.id, m, a group by 1, 2), "
    "r as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as bm25_rank from c where score > 0) "
)


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    index = retrieval.KeywordIndex.build(read(spark, sf_dir, "documents"), "doc_id")
    return index.search(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text"), k)


@query(_BM25 + "select qid, id, round(score, 4) as score, bm25_rank from r where bm25_rank <= 10")
def bm25_topk(spark, sf_dir):
    """The ten best documents for each benchmark question."""
    return _bm25(spark, sf_dir, 10).select("qid", "id", F.round("score", 4).alias("score"), F.col("bm25_rank").cast("long").alias("bm25_rank"))


_COSINE = "round(1 - list_dot_product(e.embedding::double[], q.v) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.v, q.v))), 12)"
_ASKED = "q as (select vec_id as qid, embedding::double[] as v from embeddings where vec_id % 20 = 0)"


def _vectors(spark: SparkSession, sf_dir: str, k: int, by: str | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Every vector whose id is divisible by 20 against all (or the given) vectors."""
    all_ = read(spark, sf_dir, "embeddings")
    asked = all_.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    near = retrieval.dense_search_many(all_ if chunks is None else chunks, asked, k, "vec_id", by=by)
    return near.select("qid", F.col("id").alias("vec_id"), *([by] if by else []), F.round("distance", 6).alias("distance"), "dense_rank")


@query(f"with {_ASKED} select qid, vec_id, round({_COSINE}, 6) as distance, row_number() over (partition by qid order by {_COSINE}, vec_id)::int as dense_rank from embeddings e, q qualify dense_rank <= 10")
def dense_topk(spark, sf_dir):
    return _vectors(spark, sf_dir, 10)


@query(f"with {_ASKED} select qid, vec_id, round({_COSINE}, 6) as distance, row_number() over (partition by qid order by {_COSINE}, vec_id)::int as dense_rank from embeddings e, q where label = 3 qualify dense_rank <= 10")
def dense_topk_filtered(spark, sf_dir):
    return _vectors(spark, sf_dir, 10, chunks=read(spark, sf_dir, "embeddings").where("label = 3"))


@query(f"with {_ASKED} select qid, vec_id, label, round({_COSINE}, 6) as distance, row_number() over (partition by qid, label order by {_COSINE}, vec_id)::int as dense_rank from embeddings e, q qualify dense_rank <= 3")
def dense_topk_per_topic(spark, sf_dir):
    return _vectors(spark, sf_dir, 3, by="label")


_GRAMS = "case when len(w) <= 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end"
_SHARED = (
    "gw as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from benchmark), ga as (select item_id, " + _GRAMS + " as g from gw), "
    "gd as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from documents), gb as (select doc_id, " + _GRAMS + " as g from gd), "
    "gx as (select item_id, len(g) as n, unnest(g) as x from ga), gy as (select doc_id, len(g) as n, unnest(g) as x from gb), "
    "shared as (select item_id, doc_id, any_value(gx.n) + any_value(gy.n) as n, count(*) as k from gx join gy using (x) group by 1, 2)"
)


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, n, k): word 3-grams of a benchmark text and a document, in sum and in common. An equi-join on their hashes."""
    grams = lambda t, key, n: read(spark, sf_dir, t).select(key, T.shingle_hashes(F.col("text")).alias("g")).select(key, F.size("g").alias(n), F.explode("g").alias("x"))
    return grams("documents", "doc_id", "nb").join(small(grams("benchmark", "item_id", "na")), "x").groupBy("item_id", "doc_id").agg(F.max(F.col("na") + F.col("nb")).alias("n"), F.count("*").alias("k"))


@query(
    _BM25 + ", " + _SHARED + ", z as (select item_id as qid, doc_id as id, row_number() over (partition by item_id order by k desc, doc_id) as dense_rank from shared qualify dense_rank <= 24), "
    "u as (select coalesce(z.qid, r.qid) as qid, coalesce(z.id, r.id) as id, dense_rank, bm25_rank, coalesce(1 / (60 + dense_rank), 0) + coalesce(1 / (60 + bm25_rank), 0) as score "
    "from z full join (select * from r where bm25_rank <= 24) r on z.qid = r.qid and z.id = r.id) "
    "select qid, id, dense_rank, bm25_rank, round(score, 8) as score, row_number() over (partition by qid order by score desc, coalesce(dense_rank, 1000000000), id) as rank from u qualify rank <= 6"
)
def rrf_fuse(spark, sf_dir):
    """BM25 fused with a second ranking (by shared word 3-grams), as both legs of a hybrid search."""
    near = _shared(spark, sf_dir).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("id"), (-F.col("k")).cast("double").alias("distance"))
    near = near.withColumn("dense_rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("dense_rank") <= 24)
    out = retrieval.fuse(near, _bm25(spark, sf_dir, 24), 6)
    long_ = lambda c: F.col(c).cast("long").alias(c)
    return out.select("qid", "id", long_("dense_rank"), long_("bm25_rank"), F.round("score", 8).alias("score"), long_("rank"))


@query(
    "with h as (select doc_id as id, lang as topic_id, n_chars as list_pos, row_number() over (partition by lang order by n_chars, doc_id) as topic_rank from documents), "
    "o as (select *, dense_rank() over (order by topic_id) as topic_order from h) select id, topic_id, topic_rank, row_number() over (order by 1.0 / (60 + topic_rank) desc, topic_order, id) as merged_rank from o qualify merged_rank <= 40"
)
def cross_topic_merge(spark, sf_dir):
    """Documents of several topics interleaved by their rank in each topic."""
    docs = read(spark, sf_dir, "documents")
    order = Window.partitionBy("lang").orderBy("n_chars", "doc_id")
    hits = docs.select(F.lit(0).alias("qid"), F.col("doc_id").alias("id"), F.col("lang").alias("topic_id"), F.row_number().over(order).alias("list_pos"), F.lit(0.0).alias("score"), F.lit(0.0).alias("distance"), F.lit(1).alias("bm25_rank")).where("list_pos <= 40")
    topics = docs.select(F.col("lang").alias("topic_id")).distinct().withColumn("topic_order", F.dense_rank().over(Window.orderBy("topic_id")))
    merged = retrieval.rank_across(hits.join(F.broadcast(topics), "topic_id"))  # a row for each topic
    return merged.where("merged_rank <= 40").select("id", "topic_id", F.col("topic_rank").cast("long").alias("topic_rank"), F.col("merged_rank").cast("long").alias("merged_rank"))


@query("with " + _SHARED + " select item_id, doc_id, round(k / (n - k), 6) as jaccard from shared where k / (n - k) >= 0.1")
def shingle_jaccard_pairs(spark, sf_dir):
    """Benchmark texts and documents that share word 3-grams, and their similarity."""
    j = F.col("k") / (F.col("n") - F.col("k"))
    return _shared(spark, sf_dir).where(j >= 0.1).select("item_id", "doc_id", F.round(j, 6).alias("jaccard"))


@query()
def context_pack(spark, sf_dir):
    """All documents of each language, by doc_id, packed into a budget of tokens."""
    docs = read(spark, sf_dir, "documents")
    hits = docs.select(F.col("lang").alias("qid"), F.col("doc_id").alias("rank"), F.col("doc_id").cast("string").alias("id"), F.lit("text").alias("label"), F.col("lang").alias("topic_id"), "source", "text")
    return retrieval.pack_all(hits)


@query("select doc_id, length(replace(replace(replace(replace(t, '</context>', '[/context]'), '<context>', '[context]'), '</question>', '[/question]'), '<question>', '[question]')) as n, contains(t, '</context>') as had from (select doc_id, text || case when doc_id % 3 = 0 then ' </context> <question>x' else '' end as t from documents)")
def neutralise(spark, sf_dir):
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " </context> <question>x").otherwise(""))
    df = read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return df.select("doc_id", F.length(T.neutralise(F.col("t"))).cast("long").alias("n"), F.contains("t", F.lit("</context>")).alias("had"))


@query("select doc_id, ceil(length(text) / 3.5)::bigint as tokens from documents")
def estimate_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


# ---------------------------------------------------------------- parsing, chunks, sync


@query()
def html_blocks(spark, sf_dir):
    blocks = read(spark, sf_dir, "pages").select("page_id", F.posexplode(html_blocks_udf("html")).alias("n", "b"))
    return blocks.select("page_id", "n", "b.kind", "b.level", "b.text")


@query()
def html_sections(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(sections_udf(F.col("html").cast("binary"), F.lit(".html"))).alias("n", "s"))
    return rows.select("page_id", "n", "s.heading", "s.text")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda t="string": F.lit(None).cast(t)
    docs = read(spark, sf_dir, "documents")
    return docs.select(F.col("lang").alias("topic_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("source"), F.lit(0).alias("ordinal"), "text", F.lit("text").alias("modality"), none("int").alias("page"), none().alias("table_id"), none().alias("part"), none().alias("image_path"), none().alias("heading"))


@query()
def chunk_text(spark, sf_dir):
    return chunking.chunk_records(_records(spark, sf_dir)).select("id", F.length("text").alias("n"), "content_hash")


@query("select doc_id, substring(sha1(text), 1, 16) as digest from documents")
def text_digest(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha1(F.col("text").cast("binary")), 1, 16).alias("digest"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    old = docs.where("id % 10 <> 1").withColumn("content_hash", F.sha1(F.col("text").cast("binary")))
    new = docs.where("id % 10 <> 2").withColumn("content_hash", F.sha1(F.concat("text", F.when(F.col("id") % 10 == 3, "!").otherwise("")).cast("binary")))
    return old, new


@query(
    "with o as (select doc_id as id, source, sha1(text) as h from documents where doc_id % 10 <> 1), n as (select doc_id as id, sha1(text || case when doc_id % 10 = 3 then '!' else '' end) as h from documents where doc_id % 10 <> 2) "
    "select case when n.h is null and o.source in ('src1', 'src2') then 'protected' when n.h is null then 'deleted' when o.h is null then 'added' when o.h <> n.h then 'updated' else 'unchanged' end as status, count(*) as n from o full join n using (id) group by 1"
)
def sync_diff(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return sync.diff(old, new, spark.createDataFrame([("src1",), ("src2",)], "source string")).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "with h as (select source, sha1(doc_id || ':' || sha1(text)) as h from documents) select source, sha1(count(*) || ':' || sum(('0x' || substring(h, 1, 15))::bigint::hugeint) || ':' || sum(('0x' || substring(h, 16, 15))::bigint::hugeint)) as fingerprint from h group by source"
)
def fingerprint(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), F.sha1(F.col("text").cast("binary")).alias("content_hash"))
    return sync.fingerprints(docs, "source")


# ---------------------------------------------------------------- chat, citations, evaluation


@query(
    "with r as (select conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t, row_number() over (partition by conv_id order by turn desc) as r from conversations) "
    "select conv_id, string_agg(case when role = 'user' then 'User: ' else 'Assistant: ' end || case when length(t) <= 600 then t else substring(t, 1, 600) || '…' end, chr(10) order by turn) as history from r where r <= 6 group by conv_id"
)
def format_history(spark, sf_dir):
    return citations.format_history(read(spark, sf_dir, "conversations"))


@query("select conv_id, turn, list_transform(regexp_extract_all(t, '\\[(\\d+)\\]', 1), lambda x: x::int)::varchar as numbers from (select conv_id, turn, text || ' [' || turn || '] and [' || (turn + 7) || ']' as t from conversations)")
def citation_markers(spark, sf_dir):
    t = F.concat("text", F.lit(" ["), "turn", F.lit("] and ["), F.col("turn") + 7, F.lit("]"))
    df = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.chunk_markers(t).alias("n"))
    return df.select("conv_id", "turn", F.concat(F.lit("["), F.array_join(F.col("n").cast("array<string>"), ", "), F.lit("]")).alias("numbers"))


@query("select conv_id, turn, turn between 1 and 5 as valid, length(text || ' says' || case when turn between 1 and 5 then ' [' || turn || ']' else '' end) as n from conversations where not regexp_matches(text, '\\[C?\\d+\\]')")
def citation_strip(spark, sf_dir):
    df = read(spark, sf_dir, "conversations").where(~F.col("text").rlike(r"\[C?\d+\]"))
    none = F.array().cast("array<int>")
    df = df.select("conv_id", "turn", F.concat("text", F.lit(" says ["), "turn", F.lit("] [C9]")).alias("text"), none.alias("used"), F.lit(5).alias("n_items"), none.alias("used_calculations"), none.alias("ok_calculations"))
    out = citations.check_markers(df)
    return out.select("conv_id", "turn", (F.size("valid") > 0).alias("valid"), F.length("clean_text").cast("long").alias("n"))


_LABELS = "l as (select item_id as qid, item_id as label, 'en' as topic, 'src' || (item_id % 20) as source from benchmark), r as (select item_id as qid, row_number() over (partition by item_id order by k desc, doc_id) as pos, lang as topic, source from shared join documents using (doc_id))"


@query(
    f"with {_SHARED}, {_LABELS}, m as (select r.qid, count(distinct pos) as hits, count(distinct label) as found from r join l on r.qid = l.qid and r.topic = l.topic and r.source = l.source where pos <= 6 group by 1), "
    "c as (select qid, count(*) as considered from r where pos <= 6 group by 1) select l.qid, round(coalesce(coalesce(hits, 0) / considered, 0), 6) as precision, coalesce(found, 0)::double as recall, coalesce(considered, 0) as considered from l left join c using (qid) left join m using (qid)"
)
def retrieval_metrics(spark, sf_dir):
    """The first six documents for each benchmark text, against one label each."""
    none = lambda t: F.lit(None).cast(t)
    labels = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("item_id").alias("label"), F.lit("en").alias("topic"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"), none("int").alias("page"), none("string").alias("contains"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("topic"), "source", "text")
    got = _shared(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("k"), "doc_id"))).where("pos <= 6")
    got = got.select(F.col("item_id").alias("qid"), "doc_id", "pos").join(docs, "doc_id").withColumn("page", none("int"))
    return metrics.score_retrieval(got, labels, 6).select("qid", F.round("precision", 6).alias("precision"), "recall", "considered")


@query("select grouping(source) = 1 as is_total, source, count(*) as questions, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from documents join labels using (doc_id) group by grouping sets ((), (source))")
def run_summary_rollup(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    out = metrics.summarize_run(df, "source", rates=["quality", "toxic"])
    return out.select("is_total", "source", "questions", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


@query("select event_type, (list(value order by value))[floor(0.95 * (count(value) - 1))::int + 1] as p95 from events group by 1")
def p95_floor(spark, sf_dir):
    return quantiles.floor_rank(read(spark, sf_dir, "events"), ["event_type"], "value", 0.95).withColumnRenamed("value", "p95")


@query("select lang, round(avg(case when quality = 1 and toxic = 0 then 1.0 when quality = 1 then 0.5 else 0.0 end), 6) as relevance from documents join labels using (doc_id) group by 1")
def judge_scores(spark, sf_dir):
    df = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "full").when(F.col("quality") == 1, "partial").otherwise("none")
    return df.groupBy("lang").agg(F.round(F.avg(metrics.relevance(verdict)), 6).alias("relevance"))


@query()
def numbers_check(spark, sf_dir):
    df = read(spark, sf_dir, "documents")
    answer = F.concat("text", F.lit(" it is 2,451 [3] or 2.438845"))
    expected = F.array(F.struct(F.lit(2451.0).alias("value"), F.lit(0.0).alias("tol")), F.struct(F.lit(2.4388).alias("value"), F.lit(0.01).alias("tol")))
    return df.select("doc_id", F.size(T.numbers(answer)).alias("n"), T.numbers_ok(answer, expected).alias("ok"))


@query("select doc_id, contains(trim(lower(regexp_replace(regexp_replace(text, '\\[C?\\d+\\]', '', 'g'), '\\s+', ' ', 'g'))), 'the and') as ok from documents")
def contains_all(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.contains_all(F.col("text"), F.array(F.lit("The  AND"))).alias("ok"))


@query("select * from (values (1, true), (2, false), (3, true)) v(id, ok)")
def routing_accuracy(spark, sf_dir):
    df = spark.createDataFrame([(1, ["a", "b"], ["b", "a", "a"]), (2, ["a"], ["a", "c"]), (3, [], [])], "id int, got array<string>, want array<string>")
    return df.select("id", metrics.same_set(F.col("got"), F.col("want")).alias("ok"))


# ---------------------------------------------------------------- preparing samples


@query("select o_orderpriority, count(*) as n, round(avg(o_totalprice), 2) as mean from orders where o_custkey in (select o_custkey from orders group by 1 order by count(*) desc, 1 limit 6) group by 1")
def prep_topn_semi(spark, sf_dir):
    df = prep.in_top(read(spark, sf_dir, "orders"), "o_custkey", 6)
    return df.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query(
    "with s as (select event_type, user_id, count(*) as size from events group by 1, 2 having count(*) >= 2 order by size desc, event_type, user_id limit 20), "
    "r as (select e.*, size, row_number() over (partition by e.event_type, e.user_id order by event_id) as rank from events e join s on e.event_type = s.event_type and e.user_id = s.user_id) select event_type, user_id, event_id, size, rank from r where rank <= 12"
)
def prep_group_min_size_topn(spark, sf_dir):
    out = prep.bounded_groups(read(spark, sf_dir, "events"), ["event_type", "user_id"], "event_id", 2, 20, 12)
    return out.select("event_type", "user_id", "event_id", "size", F.col("rank").cast("long").alias("rank"))


@query("with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by md5(p_partkey || ':42'), p_partkey) as r from part) select p_partkey, p_brand from r where r <= 2 order by md5(p_partkey || ':42'), p_partkey limit 30")
def prep_stratified(spark, sf_dir):
    return prep.stratified(read(spark, sf_dir, "part"), "p_brand", "p_partkey", 2, 42, 30).select("p_partkey", "p_brand")


@query("select doc_id, source from documents where length(text) between 600 and 2500")
def prep_between_length(spark, sf_dir):
    return prep.length_between(read(spark, sf_dir, "documents"), "text", 600, 2500).select("doc_id", "source")


@query("select doc_id from documents where doc_id not in (select doc_id from labels) order by md5(doc_id || ':7'), doc_id limit 100")
def prep_anti_complement(spark, sf_dir):
    rest = prep.complement(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")
    return prep.sample(rest, "doc_id", 100, 7).select("doc_id")


@query("select sum(n) over () as n, sum(large) over () as hits, event_type, large from (select event_type, count(*) as n, count(*) filter (where value > 50) as large from events group by 1) qualify large > 0")
def prep_conditional_count(spark, sf_dir):
    each = prep.count_if_map(read(spark, sf_dir, "events"), "event_type", F.col("value") > 50)
    return each.select("n", "hits", F.explode("by_value").alias("event_type", "large"))

"""Queries of single operators: each applies one to a whole table, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import chunking, citations, metrics, pdf, prep, profile, retrieval, spelling, vision
from tesserae.operators.kinds import infer_kinds
from tesserae.queries import _FOLD, _union, calculated, query, read
from tesserae.sources.html import sections_udf
from tesserae.sources.tables import unkept


# ---------------------------------------------------------------- table calculator
_MOMENT = "timestamp '2024-01-15 12:00:00'"
_CMP = {"==": "=", "!=": "<>", ">": ">", ">=": ">=", "<": "<", "<=": "<="}


@query(" union all ".join(f"select '{op}' as op, count(*) as value from events where ts {c} {_MOMENT}" for op, c in _CMP.items()))
def tq_filter_instant(spark, sf_dir):
    """Dates against a value with a time of day."""
    df = read(spark, sf_dir, "events")
    return _union([calculated(df, "count", filters=(("ts", op, "2024-01-15 12:00:00"),)).select(F.lit(op).alias("op"), "value") for op in _CMP])


@query("select op, count(*) filter (where case op when 'yes' then c_acctbal > 0 when 'not yes' then not c_acctbal > 0 when 'FALSE' then not c_acctbal > 0 else c_acctbal > 0 end) as value from customer, (values ('yes'), ('not yes'), ('FALSE'), ('1')) v(op) group by op")
def tq_filter_boolean(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select((F.col("c_acctbal") > 0).alias("solvent"))
    asked = {"yes": ("==", "yes"), "not yes": ("!=", "yes"), "FALSE": ("==", "FALSE"), "1": ("==", "1")}
    return _union([calculated(df, "count", filters=(("solvent", *f),)).select(F.lit(k).alias("op"), "value") for k, f in asked.items()])


@query("select 'count' as op, 0 as value union all select 'equal', 0 union all select 'is_null', count(*) from orders")
def tq_empty_column(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(None).cast("string").alias("nothing"))
    parts = {"count": calculated(df, "count", "nothing"), "equal": calculated(df, "count", filters=(("nothing", "==", "x"),)), "is_null": calculated(df, "count", filters=(("nothing", "is_null"),))}
    return _union([p.select(F.lit(k).alias("op"), "value") for k, p in parts.items()])


@query("select distinct p_type as value from part where p_type = 'ECONOMY'")
def tq_suggestions(spark, sf_dir):
    """Values that look like one that is not there and is not clearly any of them."""
    return spark.createDataFrame([(v,) for v in spelling.suggested(read(spark, sf_dir, "part"), "p_type", ["ECONOMICS"])[:1]], "value string")


@query(f"select p_partkey, trim(regexp_replace(regexp_replace({_FOLD.format('p_name')} || ' no ' || p_partkey, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) as k from part")
def squash_values(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.squash(F.concat("p_name", F.lit("  No. "), "p_partkey")).alias("k"))


@query("select p_brand, round(median(p_retailprice), 4)::double as value from part group by 1 order by 2 desc, 1 limit 20")
def tq_median_by_group(spark, sf_dir):
    return calculated(read(spark, sf_dir, "part"), "median", "p_retailprice", by=("p_brand",), places=4)


@query("select o_orderkey, case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then null else round(o_totalprice, 2) end as x from orders")
def numeric_text(spark, sf_dir):
    """Numbers that a text spells as a whole."""
    n, k = F.format_string("%.2f", "o_totalprice"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(n, F.lit("d"))).when(k == 1, F.concat(n, F.lit(" EUR"))).when(k == 2, F.concat(F.lit("  +"), n)).otherwise(n)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(T.numeric(text), 2).alias("x"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def date_spellings(spark, sf_dir):
    """Five spellings of each date, read back."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(d, "d MMM yyyy")).when(k == 2, F.upper(F.date_format(d, "MMM d, yyyy"))).when(k == 3, F.date_format(d, "M/d/yyyy")).otherwise(F.date_format(d, "yyyy/M/d"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.to_instant(text).cast("date").cast("string").alias("day"))


# ---------------------------------------------------------------- text


@query(
    "select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(nfc_normalize(t), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as t "
    "from (select doc_id, '  a' || chr(7) || chr(9) || ' b  ' || chr(13) || chr(10) || ' ' || chr(10) || chr(10) || chr(10) || regexp_replace(text, '[^a-z .]', '', 'g') || '   ' as t from documents)"
)
def clean_text(spark, sf_dir):
    t = F.concat(F.lit("  a\x07\t b  \r\n \n\n\n"), F.regexp_replace("text", "[^a-z .]", ""), F.lit("   "))
    return read(spark, sf_dir, "documents").select("doc_id", T.clean(t).alias("t"))


@query("select doc_id, regexp_replace(regexp_replace(source || ' / ' || doc_id, '[^A-Za-z0-9_.-]', '_', 'g'), '^_+|_+$', '', 'g') as name from documents")
def safe_names(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.safe_name(F.concat("source", F.lit(" / "), "doc_id")).alias("name"))


@query("select doc_id, list_transform(list_filter(regexp_extract_all(regexp_replace(t, '\\[C?\\d+\\]', '', 'g'), '(?:^|[^\\p{L}\\p{N}_.0-9-])(-?\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda x: x <> ''), lambda x: replace(x, ',', '')::double)::varchar as numbers from (select doc_id, 'in ' || doc_id || ' [3] of 1,' || (100 + doc_id % 800) || '.5, v' || doc_id || ' or -' || (doc_id % 7) as t from documents)")
def numbers_found(spark, sf_dir):
    d = F.col("doc_id")
    t = F.concat(F.lit("in "), d, F.lit(" [3] of 1,"), 100 + d % 800, F.lit(".5, v"), d, F.lit(" or -"), d % 7)
    n = read(spark, sf_dir, "documents").select("doc_id", T.numbers(t).alias("n"))
    return n.select("doc_id", F.concat(F.lit("["), F.array_join(F.col("n").cast("array<string>"), ", "), F.lit("]")).alias("numbers"))


@query("select doc_id, 'infor' || 'mation ' || substring(sha1(text), 1, 4) || 'pre-' || chr(10) || 'X' as t from documents")
def hyphens(spark, sf_dir):
    t = F.concat(F.lit("infor-\nmation "), F.substring(F.sha1(F.col("text").cast("binary")), 1, 4), F.lit("pre-\nX"))
    return read(spark, sf_dir, "documents").select("doc_id", T.hyphen_repair(t).alias("t"))


@query("select doc_id, 'as shown, again' || case when doc_id % 2 = 0 then '' else ' (2020)' end || ' by ' || lang as t from documents")
def citations_stripped(spark, sf_dir):
    said = F.when(F.col("doc_id") % 2 == 0, F.lit(" (Smith et al., 2020; Doe and Roe, 1999a)")).otherwise(F.lit(" (2020)"))
    t = F.concat(F.lit("as shown ["), F.col("doc_id") % 9 + 1, F.lit("–12, 15], again"), said, F.lit(" by "), "lang")
    return read(spark, sf_dir, "documents").select("doc_id", T.strip_citations(t).alias("t"))


@query("select p_partkey, case when p_retailprice = floor(p_retailprice) then (p_retailprice::bigint)::varchar when p_retailprice >= 10000 then round(p_retailprice)::bigint::varchar else regexp_replace(regexp_replace(printf('%.3f', round(p_retailprice, 3)), '0+$', ''), '\\.$', '') end as t from part where p_retailprice < 100000")
def number_texts(spark, sf_dir):
    """Numbers in a column's description; here in the rows that render_rows() makes of them."""
    df = read(spark, sf_dir, "part").where("p_retailprice < 100000").select(F.col("p_partkey").alias("_row"), "p_retailprice")
    return profile.render_rows(df).select(F.col("row").alias("p_partkey"), F.regexp_extract("line", r"\| (.*)$", 1).alias("t"))


# ---------------------------------------------------------------- labels, places, citations
_META = "case doc_id % 4 when 0 then 'text' when 1 then 'table' when 2 then 'image' else 'text' end"


def _meta(spark, sf_dir):
    d, n = read(spark, sf_dir, "documents"), F.col("doc_id") % 4
    modality = F.when(n == 1, "table").when(n == 2, "image").otherwise("text")
    page = F.when(n.isin(2, 3), F.col("doc_id") % 9 + 1).cast("int")
    table_id = F.when(n == 1, F.when(F.col("doc_id") % 8 == 1, "main").when(F.col("doc_id") % 8 == 5, "p3t2"))
    part = F.when(n == 1, F.when(F.col("doc_id") % 3 == 0, "summary").when(F.col("doc_id") % 3 == 1, "rows-1-9").otherwise("sample-10-20"))
    heading = F.when(n == 0, F.concat(F.lit("About "), "lang"))
    return d.select("doc_id", "lang", "source", modality.alias("modality"), page.alias("page"), table_id.alias("table_id"), part.alias("part"), F.when(n == 2, F.concat(F.lit("pics\\f"), "doc_id", F.lit(".png"))).alias("image_path"), heading.alias("heading"))


_SAID = "case doc_id % 3 when 0 then '{}' when 1 then 'rows 1-9' else 'sample rows 10-20' end"


@query(
    f"select doc_id, case {_META} when 'table' then 'table ' || source || case when doc_id % 8 = 1 then '' else ' p.3' end || ' ' || {_SAID.format('(summary)')} "
    "when 'image' then 'image f' || doc_id || '.png p.' || (doc_id % 9 + 1) else 'text' || case when doc_id % 4 = 3 then ' p.' || (doc_id % 9 + 1) else '' end end as label from documents"
)
def labels_of_chunks(spark, sf_dir):
    return _meta(spark, sf_dir).select("doc_id", chunking.make_label(*(F.col(c) for c in ("modality", "source", "page", "table_id", "part", "image_path"))).alias("label"))


@query(
    f"select doc_id, case {_META} when 'table' then case when doc_id % 8 = 1 then '' else 'p.3, table 2, ' end || {_SAID.format('summary')} when 'image' then 'p.' || (doc_id % 9 + 1) "
    "else case when doc_id % 4 = 3 then 'p.' || (doc_id % 9 + 1) else 'section: About ' || lang end end as place from documents"
)
def places_of_chunks(spark, sf_dir):
    return _meta(spark, sf_dir).select("doc_id", citations.location(*(F.col(c) for c in ("modality", "page", "table_id", "part", "heading"))).alias("place"))


@query("select doc_id % 50 as answer_id, 't · ' || source || ' · section: About ' || lang || ' · text' as display, list(doc_id order by doc_id)::varchar as numbers from documents where doc_id % 4 = 0 group by 1, 2")
def sources_grouped(spark, sf_dir):
    cited = _meta(spark, sf_dir).where("modality = 'text' and heading is not null")
    cited = cited.select((F.col("doc_id") % 50).alias("answer_id"), F.lit("t").alias("topic_id"), "source", "modality", "page", "table_id", "part", "heading", F.col("doc_id").alias("number"), F.col("doc_id").cast("string").alias("chunk_id"))
    return citations.sources(cited).select("answer_id", "display", F.concat(F.lit("["), F.array_join(F.col("numbers").cast("array<string>"), ", "), F.lit("]")).alias("numbers"))


@query("select conv_id, turn, 1 + (turn between 2 and 5)::int as valid, 2 - (turn between 2 and 5)::int - (turn = 1)::int as invalid, (turn % 3 = 0)::int as good, 1 - (turn % 3 = 0)::int as bad from conversations where not regexp_matches(text, '\\[C?\\d+\\]')")
def citation_checks(spark, sf_dir):
    """Declared and written markers together: chunk 1 and 9 are declared, the turn is written; calculation C(turn % 3) stands in the text, C0 has worked."""
    df = read(spark, sf_dir, "conversations").where(~F.col("text").rlike(r"\[C?\d+\]"))
    one = lambda *x: F.array(*map(F.lit, x)).cast("array<int>")
    df = df.select("conv_id", "turn", F.concat("text", F.lit(" ["), "turn", F.lit("] [C"), F.col("turn") % 3, F.lit("]")).alias("text"), one(1, 9).alias("used"), F.lit(5).alias("n_items"), one().alias("used_calculations"), one(0).alias("ok_calculations"))
    out = citations.check_markers(df.where("turn <> 0 and turn <> 9").unionByName(df.where("turn = 0 or turn = 9")))
    return out.select("conv_id", "turn", F.size("valid").alias("valid"), F.size("invalid").alias("invalid"), F.size("valid_calculations").alias("good"), F.size("invalid_calculations").alias("bad"))


# ---------------------------------------------------------------- retrieval and evaluation


@query(
    "with h as (select item_id % 5 as qid, lang as topic, doc_id as id, n_chars, row_number() over (partition by item_id % 5, lang order by n_chars, doc_id) as list_pos from documents, (select distinct item_id % 5 as item_id from benchmark) where doc_id % 5 = item_id), "
    "k as (select * from h where n_chars % 100 / 100.0 <= 0.45 or n_chars % 3 = 0) select qid, topic, id, row_number() over (partition by qid, topic order by list_pos) as topic_rank from k"
)
def distance_floor(spark, sf_dir):
    """Hits beyond a distance go unless a keyword found them, and each topic's ranks close up."""
    d = read(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("qid"), F.col("lang").alias("topic_id"), F.col("doc_id").alias("id"), "n_chars")
    pos = F.row_number().over(retrieval.Window.partitionBy("qid", "topic_id").orderBy("n_chars", "id"))
    hits = d.select("qid", "topic_id", F.lit(0).alias("topic_order"), "id", pos.alias("list_pos"), F.lit(1.0).alias("score"), (F.col("n_chars") % 100 / 100.0).alias("distance"), F.when(F.col("n_chars") % 3 == 0, 1).alias("bm25_rank"))
    out = retrieval.rank_across(hits, 0.45)
    return out.select("qid", F.col("topic_id").alias("topic"), "id", F.col("topic_rank").cast("long").alias("topic_rank"))


@query(
    "with w as (select doc_id as id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from documents where lang = 'en'), g as (select id, case when len(w) <= 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from w), "
    "x as (select id, len(g) as n, unnest(g) as t from g), p as (select b.id, a.id as earlier, count(*) as k, any_value(a.n) + any_value(b.n) as s from x a join x b using (t) where a.id < b.id group by 1, 2) select id, min(earlier) as earlier from p where k >= 0.9 * (s - k) group by 1"
)
def near_copies(spark, sf_dir):
    """English documents that are near copies of one before them."""
    d = read(spark, sf_dir, "documents").where("lang = 'en'").select(F.lit(0).alias("qid"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("id"), "text")
    return retrieval.near_copies(d).select("id", F.col("like").alias("earlier"))


@query("select count(r) as questions, round(avg(r), 6) as recall, round(avg(p), 6) as precision, count(*) filter (where r = 1) as full_recall, count(*) filter (where r = 0) as no_recall from (select case when quality is null then null else quality::double end as r, toxic::double as p from documents left join labels using (doc_id))")
def retrieval_summary(spark, sf_dir):
    df = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("quality").cast("double").alias("recall"), F.col("toxic").cast("double").alias("precision"))
    out = metrics.summarize_retrieval(df)
    return out.select("questions", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), "full_recall", "no_recall")


_VERDICT = "from documents left join labels using (doc_id) group by doc_id % 40"


@query(f"select doc_id % 40 as qid, count(quality) as claims, round(avg(quality), 6) as faithfulness {_VERDICT}")
def faithfulness_scores(spark, sf_dir):
    df = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    out = metrics.faithfulness(df.select((F.col("doc_id") % 40).alias("qid"), F.when(F.col("quality") == 1, "supported").when(F.col("quality") == 0, "unsupported").alias("verdict")))
    return out.select("qid", "claims", F.round("faithfulness", 6).alias("faithfulness"))


@query(f"select doc_id % 40 as qid, count(toxic) as facts, round(avg(1 - toxic), 6) as correctness {_VERDICT}")
def correctness_scores(spark, sf_dir):
    df = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    out = metrics.correctness(df.select((F.col("doc_id") % 40).alias("qid"), F.when(F.col("toxic") == 0, "present").when(F.col("toxic") == 1, "missing").alias("verdict")))
    return out.select("qid", "facts", F.round("correctness", 6).alias("correctness"))


@query("select event_type is null as is_total, event_type, count(*) as questions, round(avg(value), 6) as seconds_mean, (list(value order by value))[floor(0.95 * (count(value) - 1))::int + 1] as seconds_p95 from events group by grouping sets ((), (event_type))")
def run_summary_times(spark, sf_dir):
    out = metrics.summarize_run(read(spark, sf_dir, "events"), "event_type", seconds="value")
    return out.select("is_total", "event_type", "questions", F.round("seconds_mean", 6).alias("seconds_mean"), "seconds_p95")


@query("select doc_id, list_filter(['recall', 'correctness', 'faithfulness'], lambda x: case x when 'recall' then quality < 1 when 'correctness' then toxic * 0.5 < 0.67 else 1 - toxic < 0.8 end)::varchar as reasons from labels where quality < 1 or toxic * 0.5 < 0.67 or 1 - toxic < 0.8")
def failure_reasons(spark, sf_dir):
    df = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("recall"), (F.col("toxic") * 0.5).alias("correctness"), (1.0 - F.col("toxic")).alias("faithfulness"))
    return metrics.failures(df).select("doc_id", F.concat(F.lit("["), F.array_join("reasons", ", "), F.lit("]")).alias("reasons"))


@query("select user_id as qid, count(*) as calls, sum(event_id) as prompt_tokens, sum(length(props)) as output_tokens from events group by 1")
def token_usage(spark, sf_dir):
    return metrics.token_usage(read(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("prompt_tokens"), F.length("props").alias("output_tokens")))


# ---------------------------------------------------------------- parsing, tables, PDF pages


@query("select n_nationkey, 'Nations > ' || n_name as heading, 'It has the number ' || n_nationkey || '.' || chr(10) || chr(10) || '# not a heading' as text from (select n_nationkey, n_name from nation) where true union all select n_nationkey, 'Nations', 'Region ' || n_regionkey from nation")
def markdown_sections(spark, sf_dir):
    """Markdown made of each row, read as sections; a sign of a heading inside a fence is text."""
    n = lambda c: F.col(c).cast("string")
    md = F.concat(F.lit("# Nations\nRegion "), n("n_regionkey"), F.lit("\n\n## "), n("n_name"), F.lit(" ##\n\nIt has the number "), n("n_nationkey"), F.lit(".\n\n```\n# not a heading\n```\n## Empty\n"))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(sections_udf(md.cast("binary"), F.lit(".md"))).alias("s"))
    return rows.select("n_nationkey", F.col("s.heading").alias("heading"), F.replace(F.replace("s.text", F.lit("```\n"), F.lit("")), F.lit("\n```"), F.lit("")).alias("text"))


@query("select p_partkey, p_name as heading, 'Brand ' || p_brand || chr(10) || chr(10) || 'size | ' || p_size as text from part")
def html_of_rows(spark, sf_dir):
    """HTML made of each row, read as sections: hidden text goes, table rows have their cells."""
    n = lambda c: F.col(c).cast("string")
    html = F.concat(F.lit("<html><head><title>t</title><style>x</style></head><body><h2>"), n("p_name"), F.lit("</h2><script>no</script><div><p>Brand <b>"), n("p_brand"), F.lit("</b></p></div><table><tr><td>size</td><td>"), n("p_size"), F.lit("</td></tr></table></body></html>"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(sections_udf(html.cast("binary"), F.lit(".html"))).alias("s"))
    return rows.select("p_partkey", "s.heading", "s.text")


@query("select p_brand as source, p_type as table_id, count(*) as n from part where not (p_size < 10) and (p_brand, p_type) not in (select p_brand, p_type from part where p_size < 10) group by 1, 2")
def manifest_unkept(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("table_id"), "p_size")
    return unkept(parts, parts.where("p_size < 10").select("source", "table_id").distinct()).groupBy("source", "table_id").agg(F.count("*").alias("n"))


_BLOCKS = "b as (select p_partkey % 20 as page, p_partkey as seq, (p_size % 10)::double as x0, (p_size % 7)::double as y0, (p_size % 10 + 3)::double as x1, (p_size % 7 + 2)::double as y1 from part), t as (select s_suppkey % 20 as page, (s_nationkey % 8)::double as x0, (s_suppkey % 5)::double as y0, (s_nationkey % 8 + 4)::double as x1, (s_suppkey % 5 + 2)::double as y1 from supplier)"


@query(f"with {_BLOCKS} select page, seq from b where not exists (select 1 from t where t.page = b.page and greatest(least(b.x1, t.x1) - greatest(b.x0, t.x0), 0) * greatest(least(b.y1, t.y1) - greatest(b.y0, t.y0), 0) >= 0.6 * (b.x1 - b.x0) * (b.y1 - b.y0))")
def blocks_outside_tables(spark, sf_dir):
    p, s = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    d = lambda c: c.cast("double")
    x, y = F.col("p_size") % 10, F.col("p_size") % 7
    blocks = p.select((F.col("p_partkey") % 20).alias("page"), F.col("p_partkey").alias("seq"), d(x).alias("x0"), d(y).alias("y0"), d(x + 3).alias("x1"), d(y + 2).alias("y1"), F.col("p_name").alias("text"))
    x, y = F.col("s_nationkey") % 8, F.col("s_suppkey") % 5
    tables = s.select((F.col("s_suppkey") % 20).alias("page"), d(x).alias("x0"), d(y).alias("y0"), d(x + 4).alias("x1"), d(y + 2).alias("y1"))
    return pdf.outside_tables(blocks, tables).select("page", "seq")


@query("select p_brand as doc, p_partkey as seq from part where (p_brand, regexp_replace(p_name, '[0-9]+', '#', 'g')) not in (select p_brand, k from (select p_brand, regexp_replace(p_name, '[0-9]+', '#', 'g') as k, count(distinct p_size) as on_ from part group by 1, 2) join (select p_brand, count(distinct p_size) as pages from part group by 1) using (p_brand) where pages >= 4 and on_ >= pages * 0.5)")
def running_heads(spark, sf_dir):
    blocks = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_size").alias("page"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("text"))
    return pdf.without_running_heads(blocks).select("doc", "seq")


_REFS = "c as (select doc_id % 30 as doc, (doc_id // 90) as page, doc_id as seq, case when doc_id % 90 between 60 and 89 and doc_id // 90 = 6 then '7. References' when doc_id // 90 = 8 and doc_id % 90 < 30 then 'Appendix A' else text end as t from documents)"


@query(
    f"with {_REFS}, a as (select *, sum(length(t)) over (partition by doc) as whole, coalesce(sum(length(t)) over (partition by doc order by page, seq rows between unbounded preceding and 1 preceding), 0) as before from c), "
    "h as (select doc, max(page * 1000000 + seq) as cut from a where t = '7. References' and before >= 0.3 * whole group by doc), "
    "k as (select a.*, cut, min(case when t = 'Appendix A' and a.page * 1000000 + a.seq > cut then a.seq end) over (partition by a.doc, page) as back from a left join h using (doc)) "
    "select doc, page, seq from k where cut is null or page * 1000000 + seq < cut or (back is not null and seq >= back)"
)
def references_cut(spark, sf_dir):
    d = F.col("doc_id")
    page = F.floor(d / 90)
    t = F.when((d % 90).between(60, 89) & (page == 6), "7. References").when((page == 8) & (d % 90 < 30), "Appendix A").otherwise(F.col("text"))
    blocks = read(spark, sf_dir, "documents").select((d % 30).alias("doc"), page.alias("page"), d.alias("seq"), t.alias("text"))
    return pdf.without_references(blocks).select("doc", "page", "seq")


@query("select doc_id as page from documents where doc_id % 3 = 0 and n_chars % 60 < 25")
def scanned_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "documents").select(F.lit(1).alias("doc"), F.col("doc_id").alias("page"), (F.col("n_chars") % 60).alias("chars"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(0).alias("images"))
    return pdf.scanned_pages(pages).select("page")


@query(
    "with f as (select p_brand as doc, p_partkey % 30 as page, p_partkey as seq, p_name || (p_partkey % 9) as digest, (p_size * 11) as width, (p_partkey % 400 + 20) as height from part), "
    "g as (select *, count(*) over (partition by doc) as z from f where least(width, height) >= 50 and greatest(width, height) <= 10 * least(width, height)), pages as (select doc, max(page) as pages from f group by doc), "
    "logos as (select doc, digest from g join pages using (doc) group by doc, digest, pages having count(distinct page) >= greatest(3, ceil(pages / 2))), "
    "k as (select * from g where (doc, digest) not in (select doc, digest from logos)), o as (select * from k qualify row_number() over (partition by doc, digest order by page, seq) = 1), "
    "m as (select * from o qualify row_number() over (partition by doc order by width * height desc, page, seq) <= 25) select doc, page, seq, row_number() over (partition by doc, page order by seq) as number from m"
)
def figures_selected(spark, sf_dir):
    f = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), (F.col("p_partkey") % 30).alias("page"), F.col("p_partkey").alias("seq"), F.concat("p_name", F.col("p_partkey") % 9).alias("digest"), (F.col("p_size") * 11).alias("width"), (F.col("p_partkey") % 400 + 20).alias("height"), F.lit(0.5).alias("cover"))
    return pdf.select_figures(f).select("doc", "page", "seq", F.col("number").cast("long").alias("number"))


@query("select c_custkey as row, c_name from customer order by md5(c_custkey || ':42'), c_custkey limit 500")
def row_sample(spark, sf_dir):
    return profile.sampled(read(spark, sf_dir, "customer").withColumn("_row", F.col("c_custkey"))).select(F.col("_row").alias("row"), "c_name")


@query(
    "with recursive l as (select c_custkey as r, length(c_custkey || ' | ' || c_custkey || ' | ' || c_name || ' | ' || c_nationkey || ' | ' || c_mktsegment) as n, row_number() over (order by c_custkey) as i from customer), "
    "w(i, r, size, grp) as (select i, r, n + 1, 1 from l where i = 1 union all select l.i, l.r, case when w.size + l.n > 1000 then l.n + 1 else w.size + l.n + 1 end, w.grp + case when w.size + l.n > 1000 then 1 else 0 end from w join l on l.i = w.i + 1) "
    "select min(r) as first, max(r) as last, count(*)::int as n from w group by grp"
)
def row_groups_packed(spark, sf_dir):
    """Rows of one table as text, in groups of up to 1,000 characters."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.col("c_custkey").alias("_row"))
    return profile.row_groups(profile.render_rows(df).withColumn("table_id", F.lit("main"))).select("first", "last", F.size("lines").alias("n"))


@query("select 'c' || column_name as column_name, kind from (values ('_custkey', 'integer'), ('_name', 'text'), ('_nationkey', 'integer'), ('_acctbal', 'decimal'), ('_mktsegment', 'text'), ('_price', 'amount_text'), ('_day', 'date'), ('_none', 'empty'), ('_open', 'boolean')) v(column_name, kind)")
def column_kinds_all(spark, sf_dir):
    """Each kind, judged by all rows of a table."""
    df = read(spark, sf_dir, "customer")
    df = df.select("*", F.format_string("$%,.2f", "c_acctbal").alias("c_price"), F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")), "d/M/yyyy").alias("c_day"), F.lit(None).cast("string").alias("c_none"), (F.col("c_acctbal") > 0).alias("c_open"))
    return spark.createDataFrame(list(infer_kinds(df).items()), "column_name string, kind string")


# ---------------------------------------------------------------- preparing samples


@query("select count(*) as n, round(avg(o_totalprice), 4) as mean from orders")
def prep_facts(spark, sf_dir):
    return prep.facts(read(spark, sf_dir, "orders"), "o_totalprice").select("n", F.round("mean", 4).alias("mean"))


@query("select doc_id from documents where doc_id in (select doc_id from labels) and lang is not null")
def prep_members(spark, sf_dir):
    return prep.members(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id", ["lang"]).select("doc_id")


@query("select s_suppkey as k, row_number() over (order by md5(s_suppkey || ':3'), s_suppkey) as place from supplier")
def prep_shuffled(spark, sf_dir):
    df = read(spark, sf_dir, "supplier")
    out = prep.shuffled([df.where("s_acctbal > 5000"), df.where("not s_acctbal > 5000")], "s_suppkey", 3)
    return spark.createDataFrame([(r["s_suppkey"], i) for i, r in enumerate(out.select("s_suppkey").collect(), 1)], "k long, place long")  # the table of suppliers, to show the order


@query("select p_partkey, p_name, p_size from part order by md5(p_partkey || ':5'), p_partkey limit 300")
def prep_reduced(spark, sf_dir):
    return prep.reduced(read(spark, sf_dir, "part"), ["p_brand", "p_type", "p_retailprice", "not_there"], "p_partkey", 300, 5)


@query("select event_id from events where event_type = 'error' and value is not null and props is not null")
def prep_having(spark, sf_dir):
    return prep.having(read(spark, sf_dir, "events"), {"event_type": "error"}, ["value", "props"]).select("event_id")


@query(
    "with s as (select event_type, user_id, count(*) as size from events group by 1, 2 having count(*) >= 8 order by size desc, event_type, user_id limit 20), r as (select e.event_type, e.user_id, e.event_id, size, row_number() over (partition by e.event_type, e.user_id order by event_id) as rank from events e join s on e.event_type = s.event_type and e.user_id = s.user_id) "
    "select event_type, user_id, 'Events of ' || event_type || ' ' || user_id || ' (' || any_value(size) || ')' || chr(10) || string_agg('- ' || event_id, chr(10) order by rank) as text from r where rank <= 12 group by 1, 2"
)
def prep_group_texts(spark, sf_dir):
    groups = prep.bounded_groups(read(spark, sf_dir, "events"), ["event_type", "user_id"], "event_id", 8, 20, 12)
    return prep.group_texts(groups, ["event_type", "user_id"], F.concat(F.lit("- "), F.col("event_id").cast("string")), "Events of")


@query("select doc_id, source, length(text) as text_chars from documents")
def prep_computed(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("text_chars"))


@query("select doc_id from documents where regexp_matches(coalesce(text, ''), '(?i)the') and regexp_matches(coalesce(text, ''), '(?i)and') and length(coalesce(text, '')) between 200 and 3000")
def prep_reports(spark, sf_dir):
    return prep.reports(read(spark, sf_dir, "documents"), "text", ["the", "and"], 200, 3000).select("doc_id")


@query("select event_id, '{\"k\":' || regexp_extract(props, '(\\d+)', 1) || ',\"list\":[{\"v\":' || user_id || '}]}' as props from events")
def prep_without_fields(spark, sf_dir):
    """Nested fields of a name go, however deep they stand."""
    k = F.from_json("props", "k int")["k"]
    nested = F.struct(k.alias("k"), F.lit("secret").alias("apikey"), F.array(F.struct(F.col("user_id").alias("v"), F.lit("x").alias("apikey"))).alias("list"))
    out = prep.without_fields(read(spark, sf_dir, "events").select("event_id", nested.alias("props"), F.lit("y").alias("apikey")), ["apikey"])
    return out.select("event_id", F.to_json("props").alias("props"))


@query("select round(sum(o_totalprice) filter (where o_orderkey % 5 <> 0), 2) as total, count(*) filter (where o_orderkey % 5 = 0) as left_out from orders")
def prep_parsed_total(spark, sf_dir):
    text = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "$").otherwise(""), F.format_string("%.2f", "o_totalprice"))
    return prep.parsed_total(read(spark, sf_dir, "orders").select(text.alias("total")), "total").select(F.round("total", 2).alias("total"), "left_out")


@query(
    "with c as (select p_brand as doc, p_size as page, p_partkey as t from part where p_partkey % 3 <> 0), v as (select doc, page, t, 1 as col, 'Name' as name, 'part ' || t as text, null::double as number from c union all select doc, page, t, 2, 'Name_2', 'x ' || page, null from c "
    "union all select doc, page, t, 3, 'code', lpad((t % 90 + 1)::varchar, 3, '0'), null from c union all select doc, page, t, 4, 'column 4', '1,' || (100 + t % 800) || '.5', 1000 + (100 + t % 800) + 0.5 from c) "
    "select t, 1 as row, col, name, text, number from v"
)
def tables_tidied(spark, sf_dir):
    """One table of each part that has a row with enough in it: repeated and missing names, codes, amounts, an empty row and an empty column."""
    p, t = read(spark, sf_dir, "part"), F.col("p_partkey")
    head = F.array(*(F.lit(x) for x in ("0-Name", "empty", "1-Name", "code", None)))
    full = F.array(F.concat(F.lit("part "), t), F.lit(" "), F.concat(F.lit("x \n "), F.col("p_size")), F.lpad((t % 90 + 1).cast("string"), 3, "0"), F.concat(F.lit("1,"), 100 + t % 800, F.lit(".5")))
    some = F.array(*(F.lit(None).cast("string") for _ in range(4)), F.lit("alone"))
    rows = F.array(head, F.when(t % 3 != 0, full).otherwise(some), F.array(*(F.lit("") for _ in range(5))))
    cells = p.select(F.col("p_brand").alias("doc"), F.col("p_size").alias("page"), t.alias("table"), F.posexplode(rows).alias("row", "r")).select("doc", "page", "table", "row", F.posexplode("r").alias("col", "text"))
    return pdf.tidy_tables(cells).select(F.col("table").alias("t"), "row", "col", "name", "text", "number")


@query("select p_partkey, least(w, h) >= 16 as ok, greatest(floor(w * s + 0.5), 1)::int as width, greatest(floor(h * s + 0.5), 1)::int as height, case when p_partkey % 2 = 0 then 'image/png' else 'image/jpeg' end as mime from (select p_partkey, w, h, least(1.0, 2000.0 / greatest(w, h, 1)) as s from (select p_partkey, (p_size * 97)::double as w, (p_retailprice * 2)::int::double as h from part))")
def pictures_fitted(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    f = vision.fitted((F.col("p_size") * 97).cast("double"), F.round(F.col("p_retailprice") * 2).cast("int").cast("double"), F.col("p_partkey") % 2 == 0)
    return p.select("p_partkey", f.alias("f")).select("p_partkey", "f.*")

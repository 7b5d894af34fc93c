"""The queries opN_<name> of this subpackage and their SQL, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linedup, mixing, ordermin, packing, quality, simhash, tokenfile, topk, toxicity, urlfilter
from .tokens import public_path

Query = Callable[[SparkSession, str], DataFrame]

#: Dated entries of the production block list: domain, category, action, date.
URL_LIST = [
    ("spam-farm.example.org", "spam", "add", "2024-01-10"),
    ("spam-farm.example.org", "spam", "remove", "2024-04-01"),
    ("spam-farm.example.org", "spam", "add", "2024-06-15"),
    ("cheap-pills.example.com", "pharma", "add", "2024-02-01"),
    ("cheap-pills.example.com", "spam", "add", "2024-03-01"),
    ("cheap-pills.example.com", "pharma", "remove", "2024-09-01"),
    ("tionsh.example.net", "mirror", "add", "2024-05-01"),
    ("tionsh.example.net", "mirror", "remove", "2024-05-08"),
    ("tionble.example.com", "tracker", "add", "2024-03-10"),
    ("tionble.example.com", "tracker", "add", "2024-07-01"),
    ("blog.ththth.example.org", "adult", "add", "2024-01-01"),
    ("blog.ththth.example.org", "adult", "remove", "2024-12-01"),
    ("ththth.example.org", "tracker", "add", "2024-11-01"),
]

_ENTRIES = ",\n    ".join(f"('{d}', '{c}', '{a}', timestamp '{t} 00:00:00')" for d, c, a, t in URL_LIST)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (without repeated lines) of every document."""
    return linedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages judged by URL_LIST; a page's fetch time is 2024-01-01 plus 8 hours a page, over 366 days in turn."""
    pages = table(spark, sf_dir, "pages")
    hours = F.col("page_id") * 8 % (366 * 24)
    fetched = F.timestamp_seconds(F.lit(1_704_067_200) + hours * 3600)
    entries = spark.createDataFrame(URL_LIST, "domain string, category string, action string, dated string")
    return urlfilter.judge(pages.select("page_id", "url", fetched.alias("fetched")), entries)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_line_dedup, op2_toxicity, op3_best_fit_packing, op4_source_mixing, op5_quality_classifier, op6_order_minhash, op7_token_files, op8_simhash_dedup, op9_exact_top_k, op10_url_filter)}

OP9_SQL = """
with v as (
  select vec_id, [cast(floor(256 * cast(c as double)) as bigint) for c in embedding] as x from embeddings
  where vec_id is not null and embedding is not null and len([c for c in embedding if c is null or not isfinite(c)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum([p[1] * p[2] for p in list_zip(q.x, c.x)]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

OP10_SQL = f"""
with e(domain, category, action, since) as (values
    {_ENTRIES}),
i as (select * from (select *, lead(since) over (partition by domain, category order by since) as until from e) where action = 'add'),
p as (
  select page_id, timestamp '2024-01-01 00:00:00' + to_hours(cast(page_id * 8 % (366 * 24) as integer)) as fetched,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) as host
  from pages),
m as (
  select p.page_id, i.*, row_number() over (partition by p.page_id order by length(i.domain) desc, i.category) as place,
    count(*) over (partition by p.page_id) as n
  from p join i on (p.host = i.domain or ends_with(p.host, '.' || i.domain)) and i.since <= p.fetched and (i.until is null or p.fetched < i.until))
select p.page_id, p.host, p.fetched, cast(coalesce(m.n, 0) as integer) as n_active, m.domain as matched_domain, m.category, m.since as listed_since,
  m.n is not null as blocked
from p left join m on m.page_id = p.page_id and m.place = 1
"""

SQL: dict[str, str] = {"op9_exact_top_k": OP9_SQL, "op10_url_filter": OP10_SQL}

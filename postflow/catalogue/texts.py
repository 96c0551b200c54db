"""Readers and text functions over documents, pages and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import similarity, text as X
from ..functions.titles import normalize_title
from ..operators.inference import text_groups
from ..operators.prefilter import matched_term, strong_term, title_exclusion
from ..session import cut
from ..sources import readers
from ..schemas import TABLES, struct_of
from .shared import (
    PROFILE, moment, sql_content_hash, sql_first_term, sql_indel_similarity, sql_strip, sql_tidy, sql_words, stamp, table, texts,
)

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL counterpart."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- text ----------------------------------------------------------------------------------

_BLOCK = "p|div|br|li|ul|ol|h[1-6]|tr|table|thead|tbody|section|article|header|footer|blockquote|pre|hr|dd|dt"


def _sql_plain(html: str) -> str:
    steps = [
        (r"(?s)<!--.*?(-->|\z)", "''"),
        (r"(?is)<script(\s[^>]*)?>.*?(</script\s*>|\z)", "''"),
        (r"(?is)<style(\s[^>]*)?>.*?(</style\s*>|\z)", "''"),
        (r"<[!?][^>]*>", "''"),
        (r"(?i)<li([\s/][^>]*)?>", "chr(10) || '- '"),
        (rf"(?i)</?({_BLOCK})([\s/][^>]*)?>", "chr(10)"),
        (r"</?[a-zA-Z][^>]*>", "''"),
    ]
    e = html
    for pattern, to in steps:
        e = f"regexp_replace({e}, '{pattern}', {to}, 'g')"
    # The references the pages hold; the last one also without its semicolon.
    for name, to in (("&quot;", "'\"'"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)")):
        e = f"replace({e}, '{name}', {to})"
    return f"regexp_replace({e}, '&amp;?', '&', 'g')"


@query(f"SELECT page_id, {sql_tidy(_sql_plain('html'))} AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "pages")
    return pages.select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query(f"""
SELECT doc_id, {sql_content_hash('source', 'split_part(text, chr(10), 1)', 'lang', 'text')} AS content_hash,
       {sql_words('source')} AS company
FROM documents""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    title = F.substring_index("text", "\n", 1)
    return docs.select(
        "doc_id",
        X.content_hash(F.col("source"), title, F.col("lang"), F.col("text")).alias("content_hash"),
        X.normalize_company(F.col("source")).alias("company"),
    )


@query("SELECT event_id, sha256(replace(props, ' ', '')) AS raw_hash FROM events")
def raw_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.raw_hash(F.col("props")).alias("raw_hash"))


@query(f"""
WITH d AS (SELECT doc_id, {sql_content_hash("''", "''", "''", 'text')} AS h FROM documents)
SELECT h AS content_hash, min(doc_id) AS lead_doc, count(*) AS postings FROM d GROUP BY h""")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit("")
    docs = texts(spark, sf_dir, "documents").select(
        X.content_hash(nothing, nothing, nothing, F.col("text")).alias("content_hash"),
        F.timestamp_seconds("doc_id").alias("first_seen"), "source", F.col("doc_id").alias("source_job_id"),
    )
    return text_groups(docs).select("content_hash", F.col("lead.source_job_id").alias("lead_doc"), "postings")


_TITLE = "split_part(text, chr(10), 1)"


@query(f"""
WITH d AS (SELECT doc_id, {sql_words(_TITLE)} AS t, {sql_words("text || ' ' || text")} AS w, {sql_words('text')} AS b FROM documents)
SELECT doc_id, coalesce({sql_first_term('t', PROFILE.title_exclude)}, {sql_first_term('t', PROFILE.seniority_exclude, True)}) AS excluded_by,
       coalesce({sql_first_term('t', PROFILE.title_include)},
                {sql_first_term("(t || ' ' || b)", [*PROFILE.strong, *PROFILE.supporting])}) AS matched_on,
       {sql_first_term("(t || ' ' || b)", [*PROFILE.title_include, *PROFILE.strong])} AS strong_on
FROM d""")
def term_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    title, body = F.col("title"), F.col("text")
    return docs.select(
        "doc_id",
        title_exclusion(title, PROFILE).alias("excluded_by"),
        matched_term(title, body, PROFILE).alias("matched_on"),
        strong_term(title, body, PROFILE).alias("strong_on"),
    )


_TERMS = [*PROFILE.title_include, *PROFILE.strong, *PROFILE.supporting]


@query(f"""
SELECT doc_id, term FROM (SELECT doc_id, {sql_first_term(sql_words('text'), _TERMS)} AS term FROM documents)
WHERE term IS NOT NULL""")
def first_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", X.words_only(F.col("text")).alias("words"))
    terms = spark.createDataFrame(list(enumerate(_TERMS)), "ordinal INT, term STRING")
    return X.first_terms(docs, "doc_id", "words", terms)


@query("""
SELECT p_partkey, p_name AS normalized_title, sha256(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'))
       || chr(31) || p_name || chr(31) || p_type) AS canonical_key FROM part""")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles wrapped in every kind of noise come back to the bare name."""
    part = table(spark, sf_dir, "part")
    noisy = F.concat(
        F.col("p_brand"), F.lit(" | "), F.initcap("p_name"), F.lit(" (Remote) - Lisbon"),
        F.when(F.col("p_size") > 25, F.lit(" [Req 12345]")).otherwise(F.lit(" | All Genders")),
    )
    title = normalize_title(noisy, F.col("p_brand"))
    return part.select(
        "p_partkey", title.alias("normalized_title"),
        X.canonical_key(F.col("p_brand"), title, F.col("p_type")).alias("canonical_key"),
    )


@query(f"""
WITH n AS (SELECT DISTINCT p_brand, p_size, p_name AS one,
             split_part(p_name, ' ', 2) || ' ' || split_part(p_type, ' ', 1) || ' ' || p_size AS two,
             array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS a FROM part),
s AS (SELECT *, array_to_string(list_sort(string_split(two, ' ')), ' ') AS b FROM n)
SELECT p_brand, p_size, one, two, a AS sorted_words, round({sql_indel_similarity('a', 'b')}, 6) AS ratio FROM s
UNION ALL SELECT p_brand, p_size, one, 'reversed', a, 100.0 FROM s""")
def token_sort_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against their second word with type and size, and against their own words reversed."""
    one, words = F.col("p_name"), F.split("p_name", " ")
    two = F.concat_ws(" ", words[1], F.split("p_type", " ")[0], F.col("p_size").cast("string"))
    pairs = table(spark, sf_dir, "part").select("p_brand", "p_size", one.alias("one"), two.alias("two")).distinct()
    reversed_ = pairs.select("p_brand", "p_size", "one", F.array_join(F.reverse(F.split("one", " ")), " ").alias("other"), F.lit("reversed").alias("two"))
    every = pairs.select("p_brand", "p_size", "one", F.col("two").alias("other"), "two").unionByName(reversed_)
    return every.select(
        "p_brand", "p_size", "one", "two", similarity.sorted_tokens(F.col("one")).alias("sorted_words"),
        F.round(similarity.token_sort_ratio(F.col("one"), F.col("other")), 6).alias("ratio"),
    )


@query(f"""
SELECT doc_id,
  'Company: ' || source || chr(10) || 'Title: ' || lang || chr(10) || 'Location: not stated (parsed as region unknown, remote)'
  || chr(10) || chr(10) || 'Description:' || chr(10) ||
  CASE WHEN b = '' THEN '(empty)' ELSE b END AS rendered
FROM (SELECT *, {sql_strip('text')} AS b FROM documents)""")
def render_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    return docs.select("doc_id", X.render_posting(
        F.col("source"), F.col("lang"), F.lit(None).cast("string"), F.lit("unknown"), F.lit("remote"), F.col("text"),
    ).alias("rendered"))


# --- readers -------------------------------------------------------------------------------

# Every document becomes one landed response in the format its source uses.
_FORMATS = ["greenhouse", "lever", "ashby", "remoteok", "arbeitnow", "remotive", "hn", "workday"]


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    escape = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    twice = F.replace(F.replace(escape, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    key = F.col("doc_id").cast("string")

    def body(**fields):
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    def within(item, name=None):
        listed = F.concat(F.lit("["), item, F.lit("]"))
        return listed if name is None else F.concat(F.lit(f'{{"{name}":'), listed, F.lit("}"))

    place = F.struct(F.col("lang").alias("name"))
    bodies = {
        "greenhouse": within(body(id=F.col("doc_id"), title=F.col("source"), location=place, content=twice,
                                  first_published=F.lit("2024-05-01T10:00:00+02:00")), "jobs"),
        "lever": within(body(id=key, text=F.col("source"), categories=F.struct(F.col("lang").alias("location")),
                             descriptionPlain=F.col("text"), createdAt=F.lit(1714550400000))),
        "ashby": within(body(id=key, title=F.col("source"), location=F.col("lang"), descriptionPlain=F.col("text"),
                             isListed=F.lit(True), publishedAt=F.lit("2024-05-01T08:00:00Z")), "jobs"),
        "remoteok": within(body(id=key, position=F.col("source"), company=F.lit(" Acme "), location=F.col("lang"),
                                description=twice, date=F.lit("2024-05-01T08:00:00"))),
        "arbeitnow": within(body(slug=key, title=F.col("source"), company_name=F.lit("Acme"), location=F.col("lang"),
                                 description=twice, created_at=F.lit(1714550400)), "data"),
        "remotive": within(body(id=F.col("doc_id"), title=F.col("source"), company_name=F.lit("Acme"),
                                candidate_required_location=F.col("lang"), description=escape,
                                publication_date=F.lit("2024-05-01T08:00:00")), "jobs"),
        "hn": within(body(id=F.col("doc_id"), text=F.concat(F.lit("<p>"), F.col("source"), F.lit("</p><p>"), escape),
                          created_at=F.lit("2024-05-01T08:00:00Z"), children=F.array()), "children"),
        "workday": F.lit("{}"),
    }
    source = F.element_at(F.array(*[F.lit(f) for f in _FORMATS]), (number % len(_FORMATS)) + 1)
    chosen = F.coalesce(*[F.when(source == f, b) for f, b in bodies.items()])
    # A page that says 503, one that is no JSON, one of another shape, an empty board.
    answered = (
        F.when(F.col("lang") == "fr", F.lit("<html>busy</html>"))
        .when((F.col("lang") == "es") & (source != "workday"), F.lit('{"total": 0}'))
        .otherwise(chosen)
    )
    # Written once, like the files a fetcher lands; every reader then scans its own source.
    return cut(docs.select(
        source.alias("source"), key.alias("company_slug"), F.lit("2024-06-01 00:00:00").cast("timestamp").alias("fetched_at"),
        F.when(F.col("lang") == "de", F.lit(503)).otherwise(F.lit(200)).alias("http_status"), answered.alias("body"),
    ))


_SQL_LANDED = f"""
d AS (SELECT *, list_value({', '.join(f"'{f}'" for f in _FORMATS)})[(regexp_extract(source, '([0-9]+)$', 1)::INT % 8) + 1] AS kind
      FROM documents)"""


@query(f"""
WITH {_SQL_LANDED}
SELECT kind AS source, doc_id::VARCHAR AS source_job_id, source AS title,
       CASE WHEN kind <> 'hn' THEN lang END AS location_raw,
       CASE WHEN kind IN ('lever', 'ashby') THEN {sql_strip('text')}
            WHEN kind = 'hn' THEN {sql_tidy("source || chr(10) || chr(10) || text")}
            ELSE {sql_tidy('text')} END AS description,
       CASE WHEN kind IN ('remoteok', 'arbeitnow', 'remotive') THEN 'Acme' END AS company_name,
       CASE WHEN kind IN ('remoteok', 'remotive') THEN TRUE END AS is_remote,
       '2024-05-01 08:00:00' AS posted_at
FROM d WHERE kind <> 'workday' AND lang NOT IN ('de', 'fr', 'es')""")
def read_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, _ = readers.read_sources(_landed(spark, sf_dir))
    return postings.select(
        "source", "source_job_id", "title", "location_raw", "description", "company_name", "is_remote",
        stamp("posted_at").alias("posted_at"),
    )


_SQL_OUTCOMES = f"""
WITH {_SQL_LANDED},
r AS (SELECT doc_id::VARCHAR AS company_slug, kind AS source,
      CASE WHEN kind = 'workday' THEN 'No reader for source workday' WHEN lang = 'de' THEN 'HTTP 503'
           WHEN lang = 'fr' THEN 'Non-JSON response'
           WHEN lang = 'es' THEN 'Unexpected ' || CASE kind WHEN 'greenhouse' THEN 'Greenhouse' WHEN 'lever' THEN 'Lever'
             WHEN 'ashby' THEN 'Ashby' WHEN 'remoteok' THEN 'RemoteOK' WHEN 'arbeitnow' THEN 'Arbeitnow'
             WHEN 'remotive' THEN 'Remotive' ELSE 'Hacker News' END || ' payload: no item list' END AS error
      FROM d)
SELECT company_slug, source, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status,
       CASE WHEN error IS NULL THEN 1 END AS item_count, error FROM r"""


@query(_SQL_OUTCOMES)
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, runs = readers.read_sources(_landed(spark, sf_dir))
    return runs.select("company_slug", "source", "status", "item_count", "error")


@query(f"SELECT * FROM ({_SQL_OUTCOMES}) WHERE source IN ('lever', 'remotive')")
def narrowed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only two of the sources are read."""
    wanted = ["lever", "remotive"]
    _, runs = readers.read_sources(_landed(spark, sf_dir).where(F.col("source").isin(wanted)), only=wanted)
    return runs.select("company_slug", "source", "status", "item_count", "error")


@query(f"""SELECT source, status, count(*) * 2 AS runs, count(*) AS later, sum(item_count) * 2 AS items FROM ({_SQL_OUTCOMES})
GROUP BY source, status""")
def fetch_run_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of a second poll, a day later, behind those of the first."""
    landed = _landed(spark, sf_dir)
    first = readers.read_sources(landed)[1]
    second = readers.read_sources(landed.withColumn("fetched_at", F.col("fetched_at") + F.expr("INTERVAL 1 DAY")))[1]
    after = readers.append_runs(readers.append_runs(spark.createDataFrame([], struct_of(TABLES["fetch_runs"])), first), second)
    first_day = after.agg(F.min("started_at").alias("first_day"))
    return after.crossJoin(F.broadcast(first_day)).groupBy("source", "status").agg(  # one row
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("started_at") > F.col("first_day")).alias("later"),
        F.sum("item_count").alias("items"))


@query(f"""
WITH {_SQL_LANDED}
SELECT kind AS source, doc_id::VARCHAR AS company_slug, source AS title,
  length(CASE WHEN kind IN ('lever', 'ashby') THEN {sql_strip('text')}
              WHEN kind = 'hn' THEN {sql_tidy("source || chr(10) || chr(10) || text")}
              ELSE {sql_tidy('text')} END) AS n_chars
FROM d WHERE kind <> 'workday' AND lang NOT IN ('de', 'fr', 'es')""")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every source again, from the stored payloads alone."""
    stored, _ = readers.read_sources(_landed(spark, sf_dir))
    again = readers.replay(stored.select("source", "company_slug", "raw"))
    return again.select("source", "company_slug", "title", F.length("description").alias("n_chars"))


@query("""
SELECT event_id, strftime(CASE event_id % 16
  WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts)
  WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN date_trunc('minute', ts) WHEN 5 THEN date_trunc('second', ts)
  END, '%Y-%m-%d %H:%M:%S') AS parsed FROM events""")
def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accepted form of a moment, and the forms that look like one but are none."""
    from ..functions.times import parse_iso_datetime

    events = table(spark, sf_dir, "events").withColumn("at", moment("ts"))
    at = F.col("at")
    thursday = F.date_add(F.date_trunc("week", at).cast("date"), 3)
    week = F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(thursday).cast("string"), 2, "0"),
                    F.lit("-"), (F.weekday(at) + 1).cast("string"))
    whole, day = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(at, "yyyy-MM-dd")
    forms = [
        F.concat(F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")),
        F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.date_format(at, "yyyyMMdd"), week,
        F.date_format(at, "yyyy-MM-dd HH:mm"),
        F.concat(F.date_format(at - F.expr("INTERVAL 210 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(",25-0330")),
        F.date_format(at, "'T'HH:mm"), F.date_format(at, "HH:mm"), F.date_format(at, "yyyy"), F.date_format(at, "yyyy-MM"),
        F.date_format(at, "yyyy-M-'1'"), F.concat(whole, F.lit(" Europe/Berlin")), F.concat(whole, F.lit(" UTC")),
        F.concat(whole, F.lit("GMT+1")), F.concat(F.lit(" "), day, F.lit(" ")), F.concat(F.lit("soon "), F.col("event_type")),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 16 + 1).cast("int"))
    return events.select("event_id", stamp(parse_iso_datetime(text)).alias("parsed"))

"""Discovery: sightings, candidate companies, boards and the review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import discovery as D
from ..sources.dimensions import load_watchlist
from ..session import working_folder
from ..streaming.incremental import write_sightings
from .scoring import as_table
from .shared import moment, stamp, table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


NOW = "2002-01-01 00:00:00"


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sightings: the source is the company, its languages and sizes the roles."""
    docs = table(spark, sf_dir, "documents")
    size = F.when(F.col("n_chars") > 1000, F.lit(" long ")).otherwise(F.lit(" "))
    return docs.select(
        F.lit("docs").alias("source"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("source_job_id"),
        F.col("doc_id").alias("position"), F.col("source").alias("name"),
        F.array(F.col("lang"), size, F.concat_ws(" ", "lang", (F.col("n_chars") % 7).cast("string"))).alias("roles"),
        F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("http://x/"), "doc_id")).otherwise(F.lit("")).alias("careers_url"),
        F.concat(F.lit("T"), "doc_id").alias("title"), F.concat(F.lit("u"), "doc_id").alias("url"),
    )


@query("""
WITH s AS (SELECT source AS c, doc_id, lang, n_chars FROM documents),
r0 AS (SELECT c, doc_id, 0 AS n, lang AS role FROM s UNION ALL SELECT c, doc_id, 1, 'long' FROM s WHERE n_chars > 1000
       UNION ALL SELECT c, doc_id, 2, lang || ' ' || (n_chars % 7) FROM s),
r1 AS (SELECT c, role, min((doc_id, n)) AS first FROM r0 GROUP BY ALL),
r2 AS (SELECT c, role, first, row_number() OVER (PARTITION BY c ORDER BY first) AS k FROM r1),
roles AS (SELECT c, string_agg(role, ',' ORDER BY k) AS roles FROM r2 WHERE k <= 12 GROUP BY c),
e0 AS (SELECT c, doc_id, row_number() OVER (PARTITION BY c ORDER BY doc_id DESC) AS k FROM s),
ev AS (SELECT c, string_agg('T' || doc_id, ',' ORDER BY doc_id) AS evidence FROM e0 WHERE k <= 30 GROUP BY c),
t AS (SELECT c, count(*) AS sightings, 'http://x/' || min(doc_id) FILTER (WHERE n_chars % 5 = 0) AS careers_url FROM s GROUP BY c)
SELECT t.c AS candidate_key, sightings, careers_url, roles, evidence FROM t LEFT JOIN roles USING (c) LEFT JOIN ev USING (c)""")
def candidate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sightings = _sightings(spark, sf_dir).withColumn("candidate_key", F.col("name")).withColumn(
        "_order", F.struct("position", "source", "source_job_id"))
    return D.roll_up(sightings, F.lit(NOW).cast("timestamp")).select(
        "candidate_key", F.col("_count").alias("sightings"), F.col("_careers_url").alias("careers_url"),
        F.array_join("_roles", ",").alias("roles"),
        F.array_join(F.transform("_evidence", lambda e: e["title"]), ",").alias("evidence"))


@query("""
WITH r AS (SELECT source AS c, doc_id, 0 AS n, lang AS role FROM documents
  UNION ALL SELECT source, doc_id, 1, 'long' FROM documents WHERE n_chars > 1000
  UNION ALL SELECT source, doc_id, 2, lang || ' ' || (n_chars % 7) FROM documents)
SELECT c AS candidate_key, role, count(*) AS sightings, min(doc_id) AS first_doc FROM r GROUP BY ALL""")
def candidate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every role of every candidate, not only those beside it in the queue."""
    sightings = _sightings(spark, sf_dir).withColumn("candidate_key", F.col("name")).withColumn(
        "_order", F.struct("position", "source", "source_job_id"))
    return D.role_mentions(sightings).select(
        "candidate_key", "role", "sightings", F.col("at._order.position").alias("first_doc"))


def _watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as watched companies, named like the first customers, on numbered boards."""
    nation = table(spark, sf_dir, "nation")
    key = F.lpad(F.col("n_nationkey").cast("string"), 9, "0")
    board = F.when(F.col("n_regionkey") == 0, F.lit("lever")).when(F.col("n_regionkey") == 1, F.lit("ashby")).otherwise(F.lit("greenhouse"))
    return nation.select(
        F.col("n_name").alias("slug"), F.concat(F.lit("Customer #"), key).alias("name"), board.alias("ats_type"),
        F.create_map(F.lit("token"), F.concat(F.lit("C"), (F.col("n_nationkey") * 40).cast("string"))).alias("ats_config"),
        F.lit("lab").alias("tier"), F.lit(True).alias("active"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidate companies. Some have a board, some were decided on."""
    customer = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    ats = F.when(segment == "BUILDING", F.lit("lever")).when(segment == "MACHINERY", F.lit("ashby")).when(
        segment == "FURNITURE", F.lit("greenhouse"))
    token = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    status = F.when(F.col("c_acctbal") < 0, F.lit("rejected")).when(F.col("c_acctbal") > 9500, F.lit("approved")).otherwise(F.lit("pending"))
    name_key = F.replace(F.replace(F.lower("c_name"), F.lit("#"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return as_table(
        customer, "candidate_companies", name=F.col("c_name"), name_key=name_key, status=status, ats_type=ats,
        ats_token=F.when(ats.isNotNull(), token), board_jobs=F.col("c_nationkey"), sightings=F.col("c_nationkey") + 1,
        first_seen=F.lit("2001-01-01"), last_seen=F.lit("2001-01-01"),
        decided_at=F.when(status != "pending", F.timestamp_seconds("c_custkey")))


_SQL_CANDIDATES = """
k AS (SELECT c_custkey, c_name, replace(lower(c_name), '#', ' ') AS name_key, c_nationkey, c_acctbal,
  CASE WHEN c_acctbal < 0 THEN 'rejected' WHEN c_acctbal > 9500 THEN 'approved' ELSE 'pending' END AS status,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'lever' WHEN 'MACHINERY' THEN 'ashby' WHEN 'FURNITURE' THEN 'greenhouse' END AS ats FROM customer),
w AS (SELECT n_name AS slug, 'customer ' || lpad(n_nationkey::VARCHAR, 9, '0') AS name_key,
  CASE n_regionkey WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'greenhouse' END AS ats, 40 * n_nationkey AS token FROM nation),
m AS (SELECT k.*, coalesce(a.slug, b.slug) AS watched_slug FROM k LEFT JOIN w a ON a.name_key = k.name_key
  LEFT JOIN w b ON b.ats = k.ats AND b.token = k.c_custkey)"""


@query(f"WITH {_SQL_CANDIDATES} SELECT name_key, watched_slug FROM m")
def watched_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    watchlist = _watchlist(spark, sf_dir)
    matched = D.watched_as(_customers(spark, sf_dir), D.watched_names(watchlist), D.watched_boards(watchlist))
    return matched.select("name_key", "watched_slug")


@query(f"""WITH {_SQL_CANDIDATES},
u AS (SELECT name_key, slug, 0 AS rank FROM w UNION ALL SELECT replace(lower(slug), '_', ' '), slug, 0 FROM w
  UNION ALL SELECT name_key, c_name, 1 FROM k)
SELECT name_key, arg_min(slug, (rank, slug)) AS slug FROM u GROUP BY name_key""")
def watched_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names watched by the list or by the stored companies, the list first where both have one."""
    companies = table(spark, sf_dir, "customer").select(F.col("c_name").alias("slug"), F.col("c_name").alias("name"))
    return D.watched_names(_watchlist(spark, sf_dir), companies)


@query(f"""WITH {_SQL_CANDIDATES}
SELECT name_key, CASE WHEN status = 'pending' AND watched_slug IS NOT NULL THEN 'approved' ELSE status END AS status,
  CASE WHEN status = 'pending' THEN watched_slug END AS slug,
  CASE WHEN status = 'pending' AND watched_slug IS NOT NULL THEN '{NOW}' WHEN status <> 'pending' THEN strftime(make_timestamp(c_custkey * 1000000), '%Y-%m-%d %H:%M:%S') END AS decided_at
FROM m""")
def approve_watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = D.approve_watched(_customers(spark, sf_dir), _watchlist(spark, sf_dir), F.lit(NOW))
    return marked.select("name_key", "status", "slug", stamp("decided_at").alias("decided_at"))


@query(f"""WITH {_SQL_CANDIDATES}
SELECT name_key, replace(name_key, ' ', '-') AS proposed_slug, ats IS NOT NULL AS has_board, c_nationkey + 1 AS sightings,
  CASE ats WHEN 'lever' THEN 'https://jobs.lever.co/c' || c_custkey WHEN 'ashby' THEN 'https://jobs.ashbyhq.com/c' || c_custkey
    WHEN 'greenhouse' THEN 'https://job-boards.greenhouse.io/c' || c_custkey END AS page_url,
  row_number() OVER (ORDER BY ats IS NULL, c_nationkey DESC, lower(c_name), name_key) AS position
FROM m WHERE status = 'pending' AND watched_slug IS NULL""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = D.review_queue(_customers(spark, sf_dir), _watchlist(spark, sf_dir), F.lit(NOW))
    return queue.select("name_key", "proposed_slug", "has_board", "sightings", "page_url", "position")


@query(f"""WITH {_SQL_CANDIDATES}
SELECT name_key, c_custkey::VARCHAR AS decided, row_number() OVER (ORDER BY c_custkey DESC) AS position FROM m WHERE status = 'rejected'""")
def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest, _ = D.rejected(_customers(spark, sf_dir))
    return newest.select("name_key", F.unix_seconds("decided_at").cast("string").alias("decided"), "position")


# Orders are decisions on their customer: open ones approve, fulfilled ones reject, partial
# ones take a rejection back. An urgent approval asks for a slug the watchlist has.
_SQL_DECISIONS = f"""
{_SQL_CANDIDATES},
d AS (SELECT o_orderkey AS seq, o_custkey AS c, CASE o_orderstatus WHEN 'O' THEN 'approve' WHEN 'F' THEN 'reject' ELSE 'unreject' END AS decision,
  o_orderpriority = '1-URGENT' AS urgent FROM orders),
j AS (SELECT d.*, m.name_key, m.status, m.ats, EXISTS (SELECT 1 FROM w WHERE w.ats = m.ats AND w.token = m.c_custkey) AS board_taken
  FROM d JOIN m ON m.c_custkey = d.c),"""


@query(f"""WITH {_SQL_DECISIONS}
g AS (SELECT name_key, min(seq) AS granted FROM j WHERE decision = 'approve' AND status <> 'approved' AND ats IS NOT NULL AND NOT board_taken
      AND NOT urgent GROUP BY name_key),
t AS (SELECT j.*, granted, coalesce(last_value(CASE WHEN decision IN ('reject', 'unreject') THEN decision END IGNORE NULLS) OVER (
  PARTITION BY j.name_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'reject', status = 'rejected') AS rej
  FROM j LEFT JOIN g ON g.name_key = j.name_key)
SELECT name_key, seq, decision, CASE WHEN status = 'approved' OR coalesce(granted < seq, FALSE) THEN 'refused: already in the watchlist'
  WHEN decision = 'approve' AND seq = granted THEN 'approved' WHEN decision = 'approve' AND ats IS NULL THEN 'refused: no board'
  WHEN decision = 'approve' AND urgent THEN 'refused: slug taken' WHEN decision = 'approve' THEN 'refused: board already watched'
  WHEN decision = 'reject' THEN 'rejected' WHEN rej THEN 'pending' ELSE 'refused: not rejected' END AS reason FROM t""")
def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _customers(spark, sf_dir)
    keys = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.replace(F.lower("c_name"), F.lit("#"), F.lit(" ")).alias("name_key"))
    decision = F.when(F.col("o_orderstatus") == "O", F.lit("approve")).when(F.col("o_orderstatus") == "F", F.lit("reject")).otherwise(F.lit("unreject"))
    decisions = table(spark, sf_dir, "orders").join(keys, F.col("o_custkey") == F.col("c_custkey")).select(
        "name_key", decision.alias("decision"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("NATION_1")).alias("slug"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("tier"), F.col("o_orderkey").alias("seq"),
        moment("o_orderdate").alias("decided_at"))
    decided = D.apply_decisions(candidates, decisions, _watchlist(spark, sf_dir))
    return decided.outcomes.select("name_key", "seq", "decision", "reason")


# --- boards ----------------------------------------------------------------------------------

_SQL_BOARDS = """
b AS (SELECT CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'greenhouse' WHEN p_type IN ('MEDIUM', 'LARGE') THEN 'lever' ELSE 'ashby' END AS ats,
  'brand' || CASE WHEN p_size > 40 THEN '-' ELSE '' END || substr(p_brand, 7) || CASE WHEN p_size < 10 THEN '-ai' WHEN p_size < 15 THEN 'ai' ELSE '' END AS token,
  count(*) FILTER (WHERE p_retailprice > 905) AS jobs FROM part GROUP BY ALL)"""


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind, size = F.col("p_type"), F.col("p_size")
    ats = F.when(kind.isin("ECONOMY", "SMALL"), F.lit("greenhouse")).when(kind.isin("MEDIUM", "LARGE"), F.lit("lever")).otherwise(F.lit("ashby"))
    token = F.concat(
        F.lit("brand"), F.when(size > 40, F.lit("-")).otherwise(F.lit("")), F.substring("p_brand", 7, 10),
        F.when(size < 10, F.lit("-ai")).when(size < 15, F.lit("ai")).otherwise(F.lit("")))
    return part.groupBy(ats.alias("ats_type"), token.alias("ats_token")).agg(F.count_if(F.col("p_retailprice") > 905).alias("board_jobs"))


@query(f"""WITH {_SQL_BOARDS},
n AS (SELECT DISTINCT p_brand, substr(p_brand, 7) AS x, max(p_size) OVER (PARTITION BY p_brand) > 49 AS hinted FROM part),
v AS (SELECT p_brand, hinted, x, unnest(CASE WHEN hinted THEN ['brand-' || x] ELSE [] END ||
  ['brand' || x, 'brand' || x || 'ai', 'brand' || x || '-ai', 'brand-' || x, 'brand-' || x || 'ai', 'brand-' || x || '-ai']) AS token,
  generate_subscripts(CASE WHEN hinted THEN ['brand-' || x] ELSE [] END ||
  ['brand' || x, 'brand' || x || 'ai', 'brand' || x || '-ai', 'brand-' || x, 'brand-' || x || 'ai', 'brand-' || x || '-ai'], 1) AS pos FROM n),
h AS (SELECT p_brand, ats, b.token, jobs, pos, (hinted AND ats = 'lever' AND b.token = 'brand-' || x) AS is_hint FROM v JOIN b ON v.token = b.token WHERE jobs > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY is_hint DESC, jobs DESC, pos,
  CASE ats WHEN 'greenhouse' THEN 0 WHEN 'lever' THEN 1 ELSE 2 END) AS k FROM h)
SELECT p_brand AS name_key, ats AS ats_type, token AS ats_token, jobs AS board_jobs, CASE ats
  WHEN 'greenhouse' THEN 'https://boards-api.greenhouse.io/v1/boards/' || token || '/jobs'
  WHEN 'lever' THEN 'https://api.lever.co/v0/postings/' || token || '?mode=json'
  ELSE 'https://api.ashbyhq.com/posting-api/job-board/' || token END AS board_url FROM r WHERE k = 1""")
def board_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands find their board among the spellings; some name it by link."""
    number = F.substring("p_brand", 7, 10)
    link = F.concat(F.lit("https://jobs.lever.co/Brand-"), number)
    names = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").alias("top")).select(
        F.col("p_brand").alias("name_key"), F.col("p_brand").alias("name"), F.when(F.col("top") > 49, link).alias("careers_url"))
    return D.lookup_boards(names, _boards(spark, sf_dir))


# --- sightings -------------------------------------------------------------------------------

@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def sightings_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("docs").alias("source"), F.col("doc_id").alias("source_job_id"))
    seen = table(spark, sf_dir, "benchmark").select(F.lit("docs").alias("source"), F.col("item_id").alias("source_job_id"))
    return D.new_sightings(docs, seen).select("doc_id")


@query("SELECT doc_id, doc_id % 3 AS piece FROM documents")
def stream_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three listings as a stream, each with all keys of the one before: a key is kept where it comes first."""
    landed = working_folder(spark, "listings")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("docs").alias("source"), F.col("doc_id").alias("source_job_id"))
    for piece in range(3):
        listing = docs.where(F.col("doc_id") % 3 <= piece).withColumn("piece", F.lit(piece).cast("long"))
        listing.write.mode("append").parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).option("maxFilesPerTrigger", 1).parquet(landed)
    return write_sightings(stream, working_folder(spark, "seen")).select("doc_id", "piece")


@query("SELECT doc_id, doc_id IN (SELECT item_id FROM benchmark) AS touched FROM documents")
def sightings_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("docs").alias("source"), F.col("doc_id").alias("source_job_id"), F.timestamp_seconds(F.lit(0)).alias("last_seen"))
    listed = table(spark, sf_dir, "benchmark").select(F.lit("docs").alias("source"), F.col("item_id").alias("source_job_id"))
    touched = D.touch_seen(stored, listed, F.lit(NOW))
    return touched.select("doc_id", (F.col("last_seen") == F.lit(NOW).cast("timestamp")).alias("touched"))


@query("""
WITH s AS (SELECT o_orderkey, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
m AS (SELECT s.*, c_name, c_mktsegment AS seg, c_acctbal, c_nationkey FROM s JOIN customer ON c_custkey = c)
SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS source_job_id,
  CASE WHEN seg = 'BUILDING' THEN 'unattributed' WHEN c < 25 OR c_acctbal > 9500 THEN 'already_watched'
       WHEN c_acctbal < 0 THEN 'seen_again' WHEN seg = 'MACHINERY' THEN 'already_watched'
       WHEN seg = 'FURNITURE' THEN 'seen_again' WHEN k = 1 THEN 'new_candidate' ELSE 'seen_again' END AS outcome FROM m""")
def attach_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sightings of their customer.

    Customers are watched by name, approved or rejected before, found on a watched board
    (machinery) or on the board of a known candidate (furniture), or new.
    """
    customer = table(spark, sf_dir, "customer")
    key = F.replace(F.lower("c_name"), F.lit("#"), F.lit(" "))
    segment = F.col("c_mktsegment")
    known = as_table(
        customer.where("c_acctbal < 0 OR c_acctbal > 9500").where("c_mktsegment <> 'BUILDING'"), "candidate_companies",
        name=F.col("c_name"), name_key=key, status=F.when(F.col("c_acctbal") < 0, F.lit("rejected")).otherwise(F.lit("approved")),
        sightings=F.lit(1), probed_at=F.lit(NOW), first_seen=F.lit(NOW), last_seen=F.lit(NOW))
    holder = as_table(
        table(spark, sf_dir, "region").where("r_regionkey = 0"), "candidate_companies", name=F.lit("Holder"), name_key=F.lit("holder"),
        status=F.lit("pending"), ats_type=F.lit("lever"), ats_token=F.lit("furniture"), sightings=F.lit(1),
        first_seen=F.lit(NOW), last_seen=F.lit(NOW))
    watchlist = _watchlist(spark, sf_dir)
    machines = watchlist.where("slug = 'NATION_0'").withColumn("ats_type", F.lit("ashby")).withColumn(
        "ats_config", F.create_map(F.lit("token"), F.lit("machinery")))
    boards = table(spark, sf_dir, "region").where("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, F.lit("lever")).otherwise(F.lit("ashby")).alias("ats_type"),
        F.when(F.col("r_regionkey") == 0, F.lit("furniture")).otherwise(F.lit("machinery")).alias("ats_token"),
        F.lit(5).cast("bigint").alias("board_jobs"))
    link = F.when(segment == "MACHINERY", F.lit("https://jobs.ashbyhq.com/machinery")).when(
        segment == "FURNITURE", F.lit("https://jobs.lever.co/furniture"))
    sightings = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit("orders").alias("source"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("source_job_id"),
        F.col("o_orderkey").alias("position"), F.when(segment != "BUILDING", F.col("c_name")).alias("name"),
        F.array("o_orderpriority").alias("roles"), link.alias("careers_url"), F.col("o_orderpriority").alias("title"),
        F.lit("u").alias("url"))
    attached = D.attach_candidates(
        sightings, known.unionByName(holder), D.watched_names(watchlist), D.watched_boards(machines), boards, F.lit(NOW), 7)
    return attached.outcomes.select("source_job_id", "outcome")



@query("""
SELECT n_name AS slug, 'Customer #' || lpad(n_nationkey::VARCHAR, 9, '0') AS name,
  CASE n_regionkey WHEN 0 THEN 'lever' WHEN 1 THEN 'ashby' ELSE 'greenhouse' END AS ats_type,
  'C' || n_nationkey * 40 AS token, 'discovered' AS tier, n_nationkey % 2 = 0 AS active FROM nation""")
def watchlist_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watchlist as it is loaded: checked, with default tier and flag."""
    entries = _watchlist(spark, sf_dir).select(
        "slug", "name", F.col("ats_type").alias("ats"), F.col("ats_config")["token"].alias("token"),
        F.lit(None).cast("string").alias("tier"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("slug"), "n_nationkey")
    flagged = entries.join(nation, "slug").withColumn("active", F.when(F.col("n_nationkey") % 2 == 1, F.lit(False)))
    loaded = load_watchlist(flagged.drop("n_nationkey"))
    return loaded.select("slug", "name", "ats_type", F.col("ats_config")["token"].alias("token"), "tier", "active")

"""Snapshots, openings and places over orders, part, customer and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import quality as Q, reconcile as R, resolve as S
from ..operators.places import expand_regions, location_match, parse_location
from ..operators.prefilter import unjudged as unjudged_postings
from ..functions.places_data import REGION_GROUPS
from ..schemas import TABLES, struct_of
from ..session import cut, working_folder
from ..sources.store import empty_state, read_state, write_state
from ..streaming.incremental import reconcile_stream
from .scoring import as_table
from .shared import PROFILE, moment, sql_indel_similarity, stamp, table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


NOW = "2001-09-01 00:00:00"


# --- snapshot reconciliation -----------------------------------------------------------------

# Stored state: orders placed before mid 1998. The poll lists what was placed since 1997.
def _state(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    raw = F.concat(key, F.lit("|O"))
    return orders.where("o_orderdate < '1998-07-01'").select(
        F.col("o_orderpriority").alias("company_slug"), F.col("o_custkey").cast("string").alias("job_key"),
        F.lit("orders").alias("source"), key.alias("source_job_id"),
        F.concat(F.lit("old/"), key).alias("url"), F.sha2(raw, 256).alias("raw_hash"),
        F.lit("text").alias("content_hash"), moment("o_orderdate").alias("first_seen"),
        moment("o_orderdate").alias("last_seen"), (F.col("o_orderstatus") != "P").alias("is_open"),
    )


def _snapshot(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    raw = F.concat(key, F.lit("|"), F.col("o_orderstatus"))
    return orders.where("o_orderdate >= '1997-01-01'").select(
        F.lit("orders").alias("source"), key.alias("source_job_id"), F.col("o_orderpriority").alias("company_slug"),
        F.concat(F.lit("new/"), key).alias("url"), raw.alias("raw"), F.sha2(raw, 256).alias("raw_hash"),
        F.when(F.col("o_orderstatus") == "P", F.lit("other text")).otherwise(F.lit("text")).alias("content_hash"),
    )


def _runs(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("company_slug", "source").agg(
        F.count(F.lit(1)).alias("item_count"), F.lit("ok").alias("status"))


def _sql_reconcile(listed: str, spoke: str) -> str:
    """`listed` rows count as seen; boards in `spoke` may close."""
    return f"""
WITH s AS (SELECT o_orderkey AS k, o_orderpriority AS board, o_orderdate AS d, o_orderstatus <> 'P' AS was_open
           FROM orders WHERE o_orderdate < '1998-07-01'),
n AS (SELECT o_orderkey AS k, o_orderpriority AS board, o_orderstatus AS st
      FROM orders WHERE o_orderdate >= '1997-01-01' AND {listed}),
j AS (SELECT coalesce(s.k, n.k) AS k, s.k IS NULL AS is_new, n.k IS NOT NULL AS seen, coalesce(s.board, n.board) AS board,
      s.d, was_open, st FROM s FULL OUTER JOIN n ON s.k = n.k)
SELECT k::VARCHAR AS source_job_id, board AS company_slug,
  CASE WHEN is_new OR (seen AND st <> 'O') THEN 'new/' ELSE 'old/' END || k AS url,
  CASE WHEN seen AND st = 'P' THEN 'other text' ELSE 'text' END AS content_hash,
  CASE WHEN is_new THEN '{NOW}' ELSE strftime(d, '%Y-%m-%d %H:%M:%S') END AS first_seen,
  CASE WHEN seen THEN '{NOW}' ELSE strftime(d, '%Y-%m-%d %H:%M:%S') END AS last_seen,
  CASE WHEN seen THEN TRUE WHEN {spoke} THEN FALSE ELSE was_open END AS is_open,
  CASE WHEN is_new THEN 'new' WHEN seen AND st <> 'O' THEN 'updated' WHEN seen THEN 'seen'
       WHEN {spoke} AND was_open THEN 'closed' ELSE 'untouched' END AS change
FROM j"""


def _shown(reconciled: DataFrame) -> DataFrame:
    return reconciled.select(
        "source_job_id", "company_slug", "url", "content_hash", stamp("first_seen").alias("first_seen"),
        stamp("last_seen").alias("last_seen"), "is_open", "change")


@query(_sql_reconcile("TRUE", "TRUE"))
def snapshot_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    snapshot = _snapshot(orders)
    return _shown(R.reconcile(_state(orders), snapshot, _runs(snapshot), F.lit(NOW)))


@query(f"SELECT * EXCLUDE (change), CASE WHEN change IN ('new', 'updated') THEN change END AS fetched FROM ({_sql_reconcile('TRUE', 'TRUE')})")
def stored_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The poll between two versions of the store: parts that differ are rewritten, payloads of new and changed ones added."""
    orders, root = table(spark, sf_dir, "orders"), working_folder(spark, "store")
    write_state(spark, root, empty_state(spark).with_(postings=_state(orders)), parts=8)
    state, snapshot = read_state(spark, root), _snapshot(orders)
    after = cut(R.reconcile(state.postings, snapshot, _runs(snapshot), F.lit(NOW)))
    fresh = R.fresh_payloads(state.postings, after, snapshot)
    write_state(spark, root, state.with_(postings=after.drop("change"), new_payloads=fresh), parts=8)
    state = read_state(spark, root)
    fetched = state.payloads.select(*R.PAYLOAD, F.lit(True).alias("_fetched"))
    rows = state.postings.join(fetched, R.PAYLOAD, "left")
    kind = F.when(F.col("_fetched") & (F.col("first_seen") == F.lit(NOW).cast("timestamp")), F.lit("new")).when(F.col("_fetched"), F.lit("updated"))
    return _shown(rows.withColumn("change", kind)).withColumnRenamed("change", "fetched")


_QUIET = "('5-LOW', '4-NOT SPECIFIED')"


@query(_sql_reconcile(f"o_orderpriority NOT IN {_QUIET}", f"board NOT IN {_QUIET}"))
def reconcile_failed_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One board fails and one answers with nothing: neither may close anything."""
    reconciled, _ = _failed_board(spark, sf_dir)
    return _shown(reconciled)


def _failed_board(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    listed = _snapshot(orders)
    snapshot = listed.where(f"company_slug NOT IN {_QUIET}")
    # A failed response may still have left rows behind; they must not count.
    leftovers = listed.where("company_slug = '5-LOW'")
    status = F.when(F.col("company_slug") == "5-LOW", F.lit("failed")).otherwise(F.lit("ok"))
    count = F.when(F.col("company_slug") == "4-NOT SPECIFIED", F.lit(0)).otherwise(F.col("item_count"))
    runs = _runs(listed).withColumn("status", status).withColumn("item_count", count)
    return R.reconcile(_state(orders), snapshot.unionByName(leftovers), runs, F.lit(NOW)), runs


@query(f"""
WITH r AS ({_sql_reconcile(f"o_orderpriority NOT IN {_QUIET}", f"board NOT IN {_QUIET}")}),
c AS (
  SELECT company_slug, change AS counter, count(*) AS n FROM r GROUP BY ALL
  UNION ALL SELECT o_orderpriority, 'fetched', CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN count(*) ELSE 0 END
    FROM orders WHERE o_orderdate >= '1997-01-01' GROUP BY o_orderpriority
  UNION ALL SELECT '5-LOW', 'failed', 1
  UNION ALL SELECT '9-OTHER', 'skipped', count(*) FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderkey % 7 = 0)
SELECT company_slug, CASE WHEN company_slug IS NOT NULL THEN 'orders' END AS source,
  {", ".join(f"coalesce(sum(n) FILTER (WHERE counter = '{c}'), 0)::BIGINT AS {name}" for c, name in (
      ("fetched", "fetched"), ("failed", "failed"), ("new", "new_postings"), ("updated", "updated"), ("closed", "closed"),
      ("skipped", "skipped"), ("new", "new_jobs"), ("closed", "repointed")))}
FROM c WHERE counter NOT IN ('seen', 'untouched') GROUP BY GROUPING SETS ((company_slug), ())""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of a poll in which a board fails and a company claims the postings of others."""
    reconciled, runs = _failed_board(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    claims = _snapshot(orders.where("o_orderkey % 7 = 0")).withColumn("company_slug", F.lit("9-OTHER"))
    refused = R.refused_sightings(_state(orders), _snapshot(orders).unionByName(claims))
    board = ["company_slug", "source"]
    new, closed = (reconciled.where(F.col("change") == c).select(*board) for c in ("new", "closed"))
    return R.board_report(reconciled, runs, refused, new, closed)


@query("""
WITH y AS (SELECT year(o_orderdate) AS yr, o_orderpriority AS board, max(o_orderdate) AS last_good FROM orders GROUP BY ALL),
polls AS (SELECT o_custkey AS k, year(o_orderdate) AS yr, min(o_orderpriority) AS board FROM orders GROUP BY ALL),
owner AS (SELECT k, arg_min(board, (yr, board)) AS board FROM polls GROUP BY k),
mine AS (SELECT p.* FROM polls p JOIN owner o ON p.k = o.k AND p.board = o.board),
lastpoll AS (SELECT board, max(yr) AS yr FROM polls GROUP BY board)
SELECT m.k::VARCHAR AS source_job_id, m.board AS company_slug, min(m.yr) AS first_year, max(m.yr) AS last_year,
       max(m.yr) = any_value(l.yr) AS is_open
FROM mine m JOIN lastpoll l ON m.board = l.board GROUP BY m.k, m.board""")
def reconcile_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly polls in one batch: each customer is a posting, listed in the years it ordered."""
    snapshots, runs = _yearly_polls(spark, sf_dir)
    nothing = spark.createDataFrame([], struct_of(TABLES["postings"]))
    return _polled(R.reconcile_polls(nothing, snapshots, runs))


_SQL_FAILED_POLLS = """
WITH polls AS (SELECT o_custkey AS k, year(o_orderdate) AS yr, min(o_orderpriority) AS board FROM orders GROUP BY ALL),
good AS (SELECT * FROM polls WHERE (yr + length(board)) % 3 <> 0),
owner AS (SELECT k, arg_min(board, (yr, board)) AS board FROM good GROUP BY k),
mine AS (SELECT p.* FROM good p JOIN owner o ON p.k = o.k AND p.board = o.board),
lastpoll AS (SELECT board, max(yr) AS yr FROM good GROUP BY board)
SELECT m.k::VARCHAR AS source_job_id, m.board AS company_slug, min(m.yr) AS first_year, max(m.yr) AS last_year,
       max(m.yr) = any_value(l.yr) AS is_open
FROM mine m JOIN lastpoll l ON m.board = l.board GROUP BY m.k, m.board"""


@query(_SQL_FAILED_POLLS)
def reconcile_failed_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third poll fails and leaves its rows behind, and the early ones come a second time, too late."""
    snapshots, runs = _yearly_polls(spark, sf_dir)
    runs = _with_failures(runs)
    early = F.year("fetched_at") <= 1996
    nothing = spark.createDataFrame([], struct_of(TABLES["postings"]))
    state = R.reconcile_polls(nothing, snapshots.where(early), runs.where(early))
    return _polled(R.reconcile_polls(state, snapshots, runs))


def _with_failures(runs: DataFrame) -> DataFrame:
    fails = (F.year("fetched_at") + F.length("company_slug")) % 3 == 0
    return runs.withColumn("status", F.when(fails, F.lit("failed")).otherwise(F.lit("ok")))


@query(_SQL_FAILED_POLLS)
def stream_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same polls as a stream, a file of complete polls at a time, the early ones once more in between.

    State is compacted after every other batch, so later ones read a base and the changes since.
    """
    polls = cut(_yearly_polls(spark, sf_dir)[0])
    landed = working_folder(spark, "polls")
    year = F.year("fetched_at")
    for piece in (year <= 1995, year == 1996, year.between(1997, 1998), year <= 1995, year.between(1999, 2000), year > 2000):
        # One file a batch: a poll must not come in parts.
        polls.where(piece).coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(polls.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    return _polled(reconcile_stream(stream, working_folder(spark, "stored"), _parsed, compact_every=2))


def _parsed(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return landed, _with_failures(_poll_runs(landed))


def _yearly_polls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    polled = orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.min("o_orderpriority").alias("company_slug"))
    key = F.col("o_custkey").cast("string")
    snapshots = polled.select(
        F.lit("orders").alias("source"), key.alias("source_job_id"), "company_slug", key.alias("url"),
        key.alias("raw"), key.alias("raw_hash"), key.alias("content_hash"),
        F.make_timestamp("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("fetched_at"))
    return snapshots, _poll_runs(snapshots)


def _poll_runs(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("company_slug", "source", "fetched_at").agg(
        F.count(F.lit(1)).alias("item_count"), F.lit("ok").alias("status"))


def _polled(after: DataFrame) -> DataFrame:
    return after.select("source_job_id", "company_slug", F.year("first_seen").alias("first_year"),
                        F.year("last_seen").alias("last_year"), "is_open")


@query("""
WITH p AS (SELECT o_custkey AS job, o_orderkey AS k, o_orderdate AS d, o_orderstatus <> 'F' AS is_open FROM orders),
prim AS (SELECT job, arg_max(k, (d, k)) AS k, arg_max(is_open, (d, k)) AS is_open FROM p GROUP BY job),
old AS (SELECT job, arg_min(k, (d, lpad(k::VARCHAR, 12, '0'))) AS k FROM p WHERE is_open GROUP BY job)
SELECT prim.job::VARCHAR AS job_key, lpad((CASE WHEN NOT prim.is_open AND old.k IS NOT NULL THEN old.k ELSE prim.k END)::VARCHAR, 12, '0') AS primary_source_job_id,
       (NOT prim.is_open AND old.k IS NOT NULL) AS repointed
FROM prim LEFT JOIN old ON prim.job = old.job""")
def repoint_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer is an opening shown from its newest order; fulfilled orders are closed."""
    orders = table(spark, sf_dir, "orders")
    postings = orders.select(
        F.col("o_custkey").cast("string").alias("job_key"), F.lit("orders").alias("source"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("source_job_id"),
        moment("o_orderdate").alias("first_seen"), (F.col("o_orderstatus") != "F").alias("is_open"))
    newest = F.max(F.struct("first_seen", "source_job_id"))
    jobs = postings.groupBy("job_key").agg(newest.alias("newest")).select(
        "job_key", F.lit("orders").alias("primary_source"), F.col("newest.source_job_id").alias("primary_source_job_id"))
    return R.repoint(jobs, postings).select("job_key", "primary_source_job_id", "repointed")


@query("""
WITH p AS (SELECT o_custkey AS job, o_orderkey AS k, o_orderdate AS d, o_orderpriority AS pr FROM orders),
prim AS (SELECT job, arg_max(pr, (d, lpad(k::VARCHAR, 12, '0'))) AS pr, max(d) AS last_d, min(d) AS first_d FROM p GROUP BY job)
SELECT job::VARCHAR AS job_key, CASE WHEN pr = '1-URGENT' THEN 'stored' ELSE pr END AS title,
  strftime(last_d, '%Y-%m-%d') AS last_seen, strftime(first_d, '%Y-%m-%d') AS posted_at FROM prim""")
def refresh_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job takes the title of its primary order unless the text hash is the one it has."""
    orders = table(spark, sf_dir, "orders")
    place = F.struct(F.array(F.lit("us")).alias("regions"), F.lit("us").alias("region"), F.lit("onsite").alias("work_mode"))
    postings = orders.select(
        F.col("o_custkey").cast("string").alias("job_key"), F.lit("orders").alias("source"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("source_job_id"),
        moment("o_orderdate").alias("last_seen"), moment("o_orderdate").alias("posted_at"),
        F.col("o_orderpriority").alias("title"), F.sha2("o_orderpriority", 256).alias("content_hash"),
        F.lit("here").alias("location_raw"), place.alias("location"), F.lit("text").alias("description"), F.lit("u").alias("url"))
    newest = postings.groupBy("job_key").agg(F.max(F.struct("last_seen", "source_job_id")).alias("n"))
    declared = struct_of(TABLES["jobs"])
    known = {
        "job_key": F.col("job_key"), "title": F.lit("stored"), "content_hash": F.sha2(F.lit("1-URGENT"), 256),
        "primary_source": F.lit("orders"), "primary_source_job_id": F.col("n.source_job_id"),
    }
    jobs = newest.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in declared.fields])
    return R.refresh_jobs(jobs, postings).select(
        "job_key", "title", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"),
        F.date_format("posted_at", "yyyy-MM-dd").alias("posted_at"))


@query("""
WITH w AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'),
s AS (SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_acctbal < 5000)
SELECT coalesce(w.k, s.k)::VARCHAR AS slug, CASE WHEN w.k IS NOT NULL THEN 'lab' ELSE 'infra' END AS tier,
       coalesce(w.c_acctbal >= 0, FALSE) AS active, s.k IS NULL AS added
FROM w FULL OUTER JOIN s ON w.k = s.k""")
def sync_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumn("slug", F.col("c_custkey").cast("string"))
    config = F.create_map(F.lit("token"), F.col("slug"))
    watchlist = customer.where("c_mktsegment <> 'BUILDING'").select(
        "slug", F.col("c_name").alias("name"), F.lit("lever").alias("ats_type"), config.alias("ats_config"),
        F.lit("lab").alias("tier"), (F.col("c_acctbal") >= 0).alias("active"))
    stored = customer.where("c_acctbal < 5000").select(
        "slug", F.col("c_name").alias("name"), F.lit("lever").alias("ats_type"), config.alias("ats_config"),
        F.lit("infra").alias("tier"), F.lit(True).alias("active"), F.lit("2000-01-01").cast("timestamp").alias("created_at"))
    now = F.lit(NOW)
    return R.sync_companies(stored, watchlist, now).select(
        "slug", "tier", "active", (F.col("created_at") == now.cast("timestamp")).alias("added"))


# --- openings --------------------------------------------------------------------------------

@query("""
SELECT p_partkey, sha256(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) || chr(31) || p_name || chr(31) || p_type) AS canonical_key,
       min(p_partkey) OVER (PARTITION BY p_brand, p_type, list_sort(string_split(p_name, ' '))) AS opening
FROM part""")
def canonical_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings by company, region and the words of the title in any order."""
    part = table(spark, sf_dir, "part").withColumnsRenamed({"p_brand": "company", "p_name": "title", "p_type": "region"})
    titled = S.with_identity(part)
    openings = titled.groupBy("block", "text").agg(F.min("p_partkey").alias("opening"))
    return titled.join(openings, ["block", "text"]).select("p_partkey", "canonical_key", "opening")


def _part_postings(spark: SparkSession, sf_dir: str, title) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.lit("part").alias("source"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("source_job_id"),
        F.lit(None).cast("string").alias("job_key"), F.timestamp_seconds("p_partkey").alias("first_seen"),
        F.col("p_brand").alias("company"), title.alias("title"), F.col("p_type").alias("region"))


def _no_jobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "job_key STRING, canonical_key STRING, company STRING, title STRING, region STRING, first_seen TIMESTAMP")


@query("""
WITH f AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type,
             replace(array_to_string(list_sort(string_split(p_name, ' ')), ' '), 'cold widget', 'old widget')) AS founder FROM part)
SELECT lpad(p_partkey::VARCHAR, 12, '0') AS source_job_id, sha256('part' || chr(31) || lpad(founder::VARCHAR, 12, '0')) AS job_key,
       CASE WHEN p_partkey = founder THEN 'create' ELSE 'attach' END AS action FROM f""")
def resolved_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole resolution over short names, where one pair of names is alike enough."""
    postings = _part_postings(spark, sf_dir, F.col("p_name"))
    found = S.resolve_openings(postings, _no_jobs(spark))
    return found.assignments.select("source_job_id", "job_key", "action")


# The titles of one brand and type in order of arrival; a title joins the founders unless one
# of them is alike. Then every part goes to the founder it is most like of those before it.
_SQL_FUZZY = f"""
WITH RECURSIVE p AS (SELECT p_partkey AS k, p_brand || '/' || p_type AS block,
  array_to_string(list_sort(string_split(p_name || ' assembly grade ' || p_size, ' ')), ' ') AS text FROM part),
t AS (SELECT block, text, min(k) AS k, row_number() OVER (PARTITION BY block ORDER BY min(k)) AS i FROM p GROUP BY block, text),
r AS (
  SELECT block, i, [{{'k': k, 'text': text}}] AS founders FROM t WHERE i = 1
  UNION ALL
  SELECT t.block, t.i, CASE WHEN len(list_filter(r.founders, lambda f: {sql_indel_similarity('f.text', 't.text')} >= 95)) > 0
    THEN r.founders ELSE list_append(r.founders, {{'k': t.k, 'text': t.text}}) END
  FROM r JOIN t ON t.block = r.block AND t.i = r.i + 1),
f AS (SELECT block, unnest(arg_max(founders, i)) AS f FROM r GROUP BY block),
m AS (SELECT p.k, f.f.k AS founder, {sql_indel_similarity('f.f.text', 'p.text')} AS ratio
      FROM p JOIN f ON f.block = p.block AND f.f.k <= p.k)"""


@query(_SQL_FUZZY + """
SELECT lpad(k::VARCHAR, 12, '0') AS source_job_id,
  sha256('part' || chr(31) || lpad(arg_min(founder, (-ratio, founder))::VARCHAR, 12, '0')) AS job_key,
  CASE WHEN arg_min(founder, (-ratio, founder)) = k THEN 'create' ELSE 'attach' END AS action
FROM m WHERE ratio >= 95 GROUP BY k""")
def fuzzy_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution over longer titles, where neighbouring sizes are alike and the order decides."""
    title = F.concat_ws(" ", "p_name", F.lit("assembly grade"), F.col("p_size").cast("string"))
    found = S.resolve_openings(_part_postings(spark, sf_dir, title), _no_jobs(spark))
    return found.assignments.select("source_job_id", "job_key", "action")


# Every distinct part is a stored job with one posting, titled by a hash so that only equal
# titles are alike. A quarter of the postings moves to a new title, a quarter to the title of
# the first job of its brand and type; parts that repeat another one arrive as new postings.
_SQL_KNOWN = """
WITH j AS (SELECT p_brand, p_type, p_name, p_size, min(p_partkey) AS k FROM part GROUP BY ALL),
m AS (SELECT p_brand, p_type, min(k) AS first FROM j GROUP BY ALL),
a AS (SELECT j.*, first, CASE WHEN k % 4 = 1 THEN 'rename' WHEN k % 4 = 2 AND k <> first THEN 'merge' ELSE 'keep' END AS action
      FROM j JOIN m ON m.p_brand = j.p_brand AND m.p_type = j.p_type)"""


def _known_openings(spark: SparkSession, sf_dir: str) -> S.Resolution:
    part = table(spark, sf_dir, "part")
    kind = ["p_brand", "p_type", "p_name", "p_size"]
    hashed = F.concat(F.lit("x"), F.substring(F.md5(F.concat_ws("/", "p_name", F.col("p_size").cast("string"))), 1, 20))
    known = part.groupBy(*kind).agg(F.min("p_partkey").alias("k")).withColumn("title", hashed)
    identity = [F.col("p_brand").alias("company"), F.col("p_type").alias("region")]
    jobs = S.with_identity(known.select(
        F.concat(F.lit("j"), "k").alias("job_key"), "title", *identity, F.timestamp_seconds("k").alias("first_seen"))).select(
        "job_key", "canonical_key", "company", "title", "region", "first_seen")
    first = known.groupBy("p_brand", "p_type").agg(F.min_by("title", "k").alias("first_title"))
    moved = F.when(F.col("k") % 4 == 1, F.concat(F.lit("y"), F.substring(F.md5(F.concat(F.lit("y"), "k")), 1, 20))).when(
        F.col("k") % 4 == 2, F.col("first_title")).otherwise(F.col("title"))
    stored = known.join(first, ["p_brand", "p_type"]).select(
        F.col("k").alias("key"), F.concat(F.lit("j"), "k").alias("job_key"), moved.alias("title"), *identity)
    fresh = part.join(known.select(F.col("k").alias("p_partkey")), "p_partkey", "left_anti").select(
        F.col("p_partkey").alias("key"), F.lit(None).cast("string").alias("job_key"), hashed.alias("title"), *identity)
    postings = stored.unionByName(fresh).select(
        F.lit("part").alias("source"), F.lpad(F.col("key").cast("string"), 12, "0").alias("source_job_id"), "job_key",
        F.timestamp_seconds("key").alias("first_seen"), "company", "title", "region")
    return S.resolve_openings(postings, jobs)


@query(_SQL_KNOWN + """
SELECT lpad(k::VARCHAR, 12, '0') AS source_job_id, 'j' || k AS job_key, action FROM a
UNION ALL
SELECT lpad(p_partkey::VARCHAR, 12, '0'), 'j' || k, 'attach' FROM part JOIN j USING (p_brand, p_type, p_name, p_size) WHERE p_partkey <> k""")
def known_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings against stored jobs: kept, renamed, merged or attached."""
    return _known_openings(spark, sf_dir).assignments.select("source_job_id", "job_key", "action")


@query(_SQL_KNOWN + " SELECT 'j' || k AS kept_from, 'j' || first AS merged_into FROM a WHERE action = 'merge'")
def opening_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored jobs turn out to be another one."""
    return _known_openings(spark, sf_dir).merges.select("kept_from", "merged_into")


@query(_SQL_KNOWN + """
SELECT 'j' || k AS job_key, sha256(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) || chr(31)
  || 'y' || left(md5('y' || k), 20) || chr(31) || p_type) AS canonical_key FROM a WHERE action = 'rename'""")
def renamed_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored jobs whose posting moved to a title of its own."""
    return _known_openings(spark, sf_dir).renamed.select("job_key", "canonical_key")


def _merged(spark: SparkSession, sf_dir: str) -> S.Merged:
    """Customers are jobs, and every third takes the next two over; orders are postings and showings."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    plan = customer.where(key % 3 != 0).select(
        key.cast("string").alias("job_key"), (key - key % 3).cast("string").alias("survivor"))
    plan = plan.join(customer.select(key.cast("string").alias("survivor")), "survivor", "left_semi").select("job_key", "survivor")
    job = F.col("o_custkey").cast("string").alias("job_key")
    dated = orders.groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp").alias("posted_at"))
    jobs = as_table(customer.join(dated, key == F.col("o_custkey"), "left"), "jobs", job_key=key.cast("string"),
                    posted_at=F.col("posted_at"), first_seen=F.timestamp_seconds("c_custkey"))
    postings = orders.select(job, F.col("o_orderkey").cast("string").alias("source_job_id"))
    shown = orders.groupBy(job, F.col("o_orderdate").cast("date").alias("digest_date")).agg(
        F.lit("priority").alias("section"), F.min("o_orderkey").alias("position"))
    showings = as_table(shown, "digest_appearances", **{c: F.col(c) for c in ("job_key", "digest_date", "section", "position")})
    return S.merge_openings(plan, jobs, postings, spark.createDataFrame([], struct_of(TABLES["applications"])), showings)


_SQL_MERGED = """
WITH s AS (SELECT c_custkey AS job, CASE WHEN c_custkey - c_custkey % 3 IN (SELECT c_custkey FROM customer) THEN c_custkey - c_custkey % 3 ELSE c_custkey END AS survivor FROM customer)"""


@query(_SQL_MERGED + " SELECT o_orderkey::VARCHAR AS source_job_id, survivor::VARCHAR AS job_key FROM orders JOIN s ON job = o_custkey")
def merged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).postings.select("source_job_id", "job_key")


@query(_SQL_MERGED + """,
d AS (SELECT survivor, o_orderdate::DATE AS day, job <> survivor AS moved, min(o_orderkey) AS position FROM orders JOIN s ON job = o_custkey GROUP BY survivor, o_orderdate::DATE, job)
SELECT survivor::VARCHAR AS job_key, strftime(day, '%Y-%m-%d') AS digest_date, arg_min(position, (moved, position)) AS position FROM d GROUP BY ALL""")
def merged_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Showings of one day become one; the survivor's own goes before those it took over."""
    return _merged(spark, sf_dir).appearances.select(
        "job_key", F.date_format("digest_date", "yyyy-MM-dd").alias("digest_date"), F.col("position").cast("bigint").alias("position"))


@query(_SQL_MERGED + """
SELECT survivor::VARCHAR AS job_key, strftime(min(o_orderdate), '%Y-%m-%d') AS posted_at FROM s LEFT JOIN orders ON job = o_custkey GROUP BY survivor""")
def merged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving jobs with the earliest day of all they stand for."""
    return _merged(spark, sf_dir).jobs.select("job_key", F.date_format("posted_at", "yyyy-MM-dd").alias("posted_at"))


@query("""
WITH p AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, c_acctbal >= 9000 AS applied, c_acctbal < 1000 AS scored,
             coalesce(min(o_orderdate), TIMESTAMP '1900-01-01') AS d
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT n, m, min(k) AS hub, arg_min(k, (NOT applied, NOT scored, d, lpad(k::VARCHAR, 12, '0'))) AS best FROM p GROUP BY ALL HAVING count(*) > 1)
SELECT lpad(p.k::VARCHAR, 12, '0') AS job_key,
  lpad((CASE WHEN p.applied THEN p.k WHEN hub.applied THEN hub.k ELSE g.best END)::VARCHAR, 12, '0') AS survivor
FROM p JOIN g ON p.n = g.n AND p.m = g.m JOIN p hub ON hub.k = g.hub""")
def merge_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation and segment are linked to the first of them and merge."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    since = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").cast("timestamp").alias("since"))
    jobs = customer.join(since, "c_custkey", "left").select(
        F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("job_key"), "c_nationkey", "c_mktsegment", "c_acctbal",
        F.coalesce("since", F.lit("1900-01-01").cast("timestamp")).alias("first_seen"))
    hubs = jobs.groupBy("c_nationkey", "c_mktsegment").agg(F.min("job_key").alias("merged_into"))
    pairs = jobs.join(hubs, ["c_nationkey", "c_mktsegment"]).select(F.col("job_key").alias("kept_from"), "merged_into")
    ranks = S.ranked_jobs(jobs, jobs.where("c_acctbal >= 9000"), jobs.where("c_acctbal < 1000"))
    return S.survivors(pairs, ranks)


# --- places ----------------------------------------------------------------------------------

# Location texts by nation, as boards write them.
_PLACES = [
    "San Francisco, CA | London", "Lisbon (Hybrid)", "Remote - U.S.", "Zürich, CH; Berlin", "Tokyo, Japan",
    "Remote-Friendly, United States", "Europe", "Amsterdam & Toronto", "2 Locations", "New York or NYC",
    "India - Remote", "Milan, IT", "Dublin, IE; Paris", "Washington D.C.", "Anywhere", "Porto, Portugal",
    "Ontario – Remote", "Belgrade / Kyiv", "Sydney, Australia", "", "Lausanne", "Remote International",
    "Munich, Germany", "Vancouver", "asdf",
]
# What their pieces resolve to: the part of the gazetteer the texts above use.
_KEYS = {
    "san francisco": "us", "ca": "us", "london": "uk", "lisbon": "portugal", "u s": "us", "zürich": "switzerland",
    "ch": "switzerland", "berlin": "germany", "tokyo": "other", "japan": "other", "united states": "us",
    "amsterdam": "netherlands", "toronto": "canada", "new york": "us", "nyc": "us", "india": "other", "milan": "italy",
    "it": "italy", "dublin": "ireland", "ie": "ireland", "paris": "france", "washington d c": "us", "porto": "portugal",
    "portugal": "portugal", "ontario": "canada", "belgrade": "other", "kyiv": "other", "sydney": "australia",
    "australia": "australia", "lausanne": "switzerland", "munich": "germany", "germany": "germany", "vancouver": "canada",
}


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SQL_PLACES = f"""
c AS (SELECT c_custkey, c_mktsegment, {_sql_list(_PLACES)}[c_nationkey + 1] AS raw FROM customer),
pieces AS (SELECT c_custkey, pos, trim(trim(piece), '.') AS piece FROM (
    SELECT c_custkey, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos FROM (
      SELECT c_custkey, regexp_split_to_array(translate(lower(raw), '()', ',,'), '\\||;|/|&|,|\\bor\\b|\\band\\b| - |–|—') AS parts FROM c))),
keyed AS (SELECT c_custkey, pos, trim(piece) AS piece, trim(regexp_replace(replace(piece, '.', ' '), ' +', ' ', 'g')) AS k FROM pieces),
gaz AS (SELECT unnest({_sql_list(_KEYS)}) AS k, unnest({_sql_list(_KEYS.values())}) AS token),
hits AS (SELECT c_custkey, pos, token FROM keyed JOIN gaz USING (k)),
firsts AS (SELECT c_custkey, token, min(pos) AS pos FROM hits WHERE token <> 'other' GROUP BY ALL),
found AS (SELECT c_custkey, list(token ORDER BY pos) AS regions FROM firsts GROUP BY c_custkey),
flags AS (SELECT c_custkey, bool_or(contains(piece, 'remote')) AS r, bool_or(contains(piece, 'hybrid')) AS h FROM keyed GROUP BY c_custkey),
places AS (SELECT c.c_custkey, coalesce(regions, []) AS regions,
  CASE WHEN regions IS NOT NULL THEN regions[1] WHEN o.c_custkey IS NOT NULL THEN 'other' ELSE 'unknown' END AS region,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'hybrid' WHEN c_mktsegment = 'BUILDING' THEN 'remote'
       WHEN c_mktsegment = 'FURNITURE' THEN 'onsite' WHEN r THEN 'remote' WHEN h THEN 'hybrid'
       WHEN o.c_custkey IS NOT NULL THEN 'onsite' ELSE 'unknown' END AS work_mode
  FROM c LEFT JOIN found USING (c_custkey) LEFT JOIN flags USING (c_custkey)
  LEFT JOIN (SELECT DISTINCT c_custkey FROM hits) o USING (c_custkey))"""


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    raw = F.element_at(F.array(*[F.lit(p) for p in _PLACES]), F.col("c_nationkey") + 1)
    segment = F.col("c_mktsegment")
    place = parse_location(
        raw,
        workplace_type=F.when(segment == "MACHINERY", F.lit("Hybrid")).otherwise(segment),
        is_remote=F.when(segment == "BUILDING", F.lit(True)).when(segment == "FURNITURE", F.lit(False))
        .when(segment == "MACHINERY", F.lit(True)),
    )
    return customer.select("c_custkey", place.alias("place")).select("c_custkey", "place.*")


@query(f"WITH {_SQL_PLACES} SELECT c_custkey, array_to_string(regions, ',') AS regions, region, work_mode FROM places")
def place_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).withColumn("regions", F.array_join("regions", ","))


_EU = _sql_list(REGION_GROUPS["eu"])


@query(f"""
WITH {_SQL_PLACES},
p AS (SELECT *, CASE WHEN len(regions) = 0 THEN [region] ELSE regions END AS listed FROM places),
m AS (SELECT *,
  CASE WHEN work_mode IN ('onsite', 'hybrid') THEN list_filter(listed, lambda x: x IN ('portugal', 'switzerland')) ELSE [] END AS best,
  list_filter(listed, lambda x: (work_mode IN ('onsite', 'hybrid') AND x = 'canada')
    OR (work_mode = 'remote' AND (list_contains({_EU}, x) OR x IN ('uk', 'us')))) AS second FROM p)
SELECT c_custkey,
  CASE WHEN region = 'unknown' OR work_mode = 'unknown' THEN 'unknown' WHEN len(best) > 0 THEN 'priority'
       WHEN len(second) > 0 THEN 'acceptable' ELSE 'excluded' END AS fit,
  CASE WHEN region = 'unknown' OR work_mode = 'unknown' THEN NULL WHEN len(best) > 0 THEN best[1]
       WHEN len(second) > 0 THEN second[1] END AS place
FROM m""")
def location_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = location_match(
        F.col("region"), F.col("regions"), F.col("work_mode"), PROFILE.priority, PROFILE.acceptable)
    return _located(spark, sf_dir).select("c_custkey", match.alias("m")).select("c_custkey", "m.fit", "m.place")


@query("""
SELECT DISTINCT c_nationkey, member.n_name AS region FROM customer JOIN nation own ON c_nationkey = own.n_nationkey
JOIN region ON own.n_regionkey = r_regionkey JOIN nation member ON member.n_regionkey = r_regionkey""")
def region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A world region stands for its nations."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    groups = named.select(F.col("r_name").alias("group"), F.col("n_name").alias("country"))
    customer = table(spark, sf_dir, "customer")
    tokens = customer.join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", F.col("r_name").alias("region"))
    return expand_regions(tokens, "region", groups)


# --- selections and checks -------------------------------------------------------------------

@query("""
SELECT d.doc_id FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND l.toxic = 0)""")
def unjudged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for scores: quality is the version, toxic ones judged another text."""
    postings = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("doc_id").cast("string").alias("source_job_id"), F.lit("0").alias("content_hash"))
    scores = table(spark, sf_dir, "labels").join(
        postings.select("doc_id", "source", "source_job_id"), "doc_id").select(
        "source", "source_job_id", F.col("toxic").cast("string").alias("content_hash"), F.col("quality").alias("prompt_version"))
    return unjudged_postings(postings, scores, 1).select("doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.check_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderstatus AS value, count(*) AS rows FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1")
def check_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.check_vocabulary(table(spark, sf_dir, "orders"), "o_orderstatus", ["O", "F"])


@query("""
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'F')""")
def check_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return Q.check_reference(table(spark, sf_dir, "lineitem"), parents, {"l_orderkey": "o_orderkey"}).select(
        "l_orderkey", "l_partkey", "l_linenumber")


@query("""
WITH b AS (SELECT p_brand AS name, (min(p_size) - 1) * 2 AS low, max(p_size) * 2 AS high FROM part GROUP BY p_brand)
SELECT name, low, high, 'no band ends just below' AS problem FROM b WHERE low <> 0 AND NOT EXISTS (SELECT 1 FROM b x WHERE x.high + 1 = b.low)
UNION ALL SELECT name, low, high, 'no band starts just above' FROM b WHERE high <> 100 AND NOT EXISTS (SELECT 1 FROM b x WHERE x.low - 1 = b.high)
UNION ALL SELECT name, low, high, 'bounds reversed' FROM b WHERE low > high
UNION ALL SELECT min(name), low, max(high), 'low shared by several bands' FROM b GROUP BY low HAVING count(*) > 1""")
def band_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(
        ((F.min("p_size") - 1) * 2).alias("low"), (F.max("p_size") * 2).alias("high"))
    return Q.band_gaps(bands)



"""The event fold and the figures over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ranking as K, tracking as T
from ..session import cut, working_folder
from ..streaming.incremental import fold_event_stream
from .scoring import _SQL_BEST, _orders_state
from .shared import stamp, table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _as_log(events: DataFrame) -> DataFrame:
    """Each user and week is a job; the event type says what was done to it."""
    kind, value = F.col("event_type"), F.col("value")
    action = (
        F.when(kind == "signup", F.lit("apply")).when(kind == "purchase", F.lit("dismiss"))
        .when(kind == "error", F.lit("undismiss")).when(kind == "view", F.lit("technical"))
        .when(value > 120, F.lit("offer")).when(value > 60, F.lit("rejected")).when(value < 15, F.lit("note"))
        .when(value < 20, F.lit("gossip")).otherwise(F.lit("recruiter_screen"))
    )
    at = F.col("ts").cast("timestamp")
    week = F.date_format(F.date_trunc("week", at), "yyyy-MM-dd")
    return events.select(
        F.concat_ws("|", F.col("user_id").cast("string"), week).alias("job_key"), action.alias("action"),
        at.alias("occurred_at"), F.col("event_id").cast("bigint").alias("seq"), F.lit("x").alias("notes"))


_SQL_FOLD = """
l AS (SELECT user_id, user_id || '|' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS job, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'apply' WHEN 'purchase' THEN 'dismiss' WHEN 'error' THEN 'undismiss' WHEN 'view' THEN 'technical'
    ELSE CASE WHEN value > 120 THEN 'offer' WHEN value > 60 THEN 'rejected' WHEN value < 15 THEN 'note' WHEN value < 20 THEN 'gossip'
         ELSE 'recruiter_screen' END END AS action FROM events),
s AS (SELECT *, coalesce(min(seq) FILTER (WHERE action = 'apply') OVER (PARTITION BY job) < seq, FALSE) AS sent,
  coalesce(last_value(CASE WHEN action IN ('dismiss', 'undismiss') THEN action END IGNORE NULLS)
    OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'dismiss', FALSE) AS dismissed FROM l),
a AS (SELECT *, action IN ('technical', 'recruiter_screen', 'offer', 'rejected', 'note') AS step,
  CASE WHEN action = 'apply' AND NOT sent THEN 'applied'
       WHEN action IN ('technical', 'recruiter_screen', 'offer', 'rejected', 'note') AND sent THEN action END AS adds FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY job, adds, CASE WHEN adds IN ('technical', 'recruiter_screen') THEN ts::DATE END ORDER BY seq) AS rn FROM a),
f AS (SELECT *, adds IS NOT NULL AND (adds = 'note' OR rn = 1) AS accepted FROM n),
o AS (SELECT *, CASE WHEN adds = 'applied' THEN 'applied' WHEN action = 'apply' THEN 'unchanged: already applied'
  WHEN action IN ('dismiss', 'undismiss') AND sent THEN 'refused: already applied'
  WHEN action = 'dismiss' AND dismissed THEN 'unchanged: already dismissed' WHEN action = 'dismiss' THEN 'dismissed'
  WHEN action = 'undismiss' AND dismissed THEN 'undismissed' WHEN action = 'undismiss' THEN 'refused: not dismissed'
  WHEN NOT step THEN 'refused: unknown step' WHEN adds IS NULL THEN 'refused: no application'
  WHEN accepted THEN 'recorded' ELSE 'refused: already recorded' END AS reason FROM f),
c AS (SELECT job, arg_max(CASE reason WHEN 'applied' THEN 'applied' WHEN 'dismissed' THEN 'dismissed' WHEN 'undismissed' THEN 'gone'
    ELSE CASE adds WHEN 'technical' THEN 'in_process' WHEN 'recruiter_screen' THEN 'in_process' ELSE adds END END, seq)
    FILTER (WHERE reason <> 'recorded' OR adds <> 'note') AS status,
  min(ts) FILTER (WHERE reason = 'applied') AS applied_at
  FROM o WHERE reason IN ('applied', 'dismissed', 'undismissed', 'recorded') GROUP BY job),
apps AS (SELECT * FROM c WHERE status <> 'gone'),
ev AS (SELECT job, user_id, adds AS event, ts, seq FROM o WHERE accepted)"""

_SQL_OUTCOMES = f"""WITH {_SQL_FOLD}
SELECT job AS job_key, seq, action, reason IN ('applied', 'dismissed', 'undismissed', 'recorded') AS changed, reason FROM o"""


@query(_SQL_OUTCOMES)
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fold_events(_as_log(table(spark, sf_dir, "events"))).outcomes


_SQL_APPLICATIONS = f"""WITH {_SQL_FOLD}
SELECT job AS job_key, status, strftime(applied_at, '%Y-%m-%d %H:%M:%S') AS applied_at FROM apps"""


@query(_SQL_APPLICATIONS)
def event_fold_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = T.fold_events(_as_log(table(spark, sf_dir, "events")))
    return fold.applications.select("job_key", "status", stamp("applied_at").alias("applied_at"))


FILE_ROWS = 50_000


def _files(rows: list[int], workers: int) -> int:
    """In how many files pieces of these numbers of rows are landed: all in as many, none of them empty."""
    return max(1, min(workers, min(rows) // FILE_ROWS))


def _streamed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same log in six pieces, a piece at a time on stored state; the stream stops after three and goes on from its checkpoint.

    A large piece is landed in several files, so that all workers write and read it.
    """
    log = cut(_as_log(table(spark, sf_dir, "events")))
    landed, root = working_folder(spark, "log"), working_folder(spark, "fold")
    first, last = log.agg(F.min("seq"), F.max("seq")).first()
    piece = F.floor((F.col("seq") - F.lit(first)) * 6 / F.lit((last or 0) - (first or 0) + 1))
    rows = dict(log.where(piece.isNotNull()).groupBy(piece.cast("int")).count().collect())
    result = {}
    for run in (range(3), range(3, 6)):
        files = _files([rows.get(number, 0) for number in run], spark.sparkContext.defaultParallelism)
        for number in run:
            # One piece a batch, in the order of the log: the files of a piece are all landed before those of the next.
            part = log.where(piece == number)
            (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(landed)
        result = fold_event_stream(stream, root, compact_every=4)
    return result


@query(_SQL_OUTCOMES)
def stream_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir)["outcomes"]


@query(_SQL_APPLICATIONS)
def stream_fold_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that the stream leaves: one row per application, changes of all batches laid over each other."""
    return _streamed(spark, sf_dir)["applications"].select("job_key", "status", stamp("applied_at").alias("applied_at"))


def _facts(spark: SparkSession, sf_dir: str) -> tuple[T.Fold, DataFrame]:
    fold = T.fold_events(_as_log(table(spark, sf_dir, "events")))
    return fold, T.application_facts(fold.applications, fold.events)


@query(f"""WITH {_SQL_FOLD} SELECT status, count(*) AS applications FROM apps WHERE status <> 'dismissed' GROUP BY status""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold, _ = _facts(spark, sf_dir)
    return T.pipeline(fold.applications).select("status", "applications")


_SQL_STAGES = f"""WITH {_SQL_FOLD},
live AS (SELECT * FROM apps WHERE status <> 'dismissed'),
sent AS (SELECT count(*) AS n FROM live WHERE applied_at IS NOT NULL OR job IN (SELECT job FROM ev WHERE event = 'applied')),
st AS (SELECT unnest({{stages}}) AS stage),
r AS (SELECT stage, count(DISTINCT live.job) AS reached FROM st LEFT JOIN ev ON ev.event = stage LEFT JOIN live ON live.job = ev.job GROUP BY stage)
SELECT stage, reached, CASE WHEN n > 0 THEN reached / n ELSE 0.0 END AS share_of_sent FROM r, sent"""


@query(_SQL_STAGES.format(stages="['recruiter_screen', 'technical', 'onsite', 'offer']"))
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, facts = _facts(spark, sf_dir)
    return T.funnel(facts).drop("ordinal")


@query(_SQL_STAGES.format(stages="['rejected', 'ghosted', 'withdrawn']"))
def endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, facts = _facts(spark, sf_dir)
    return T.funnel(facts, T.FUNNEL_ENDINGS).drop("ordinal")


@query(f"""WITH {_SQL_FOLD},
x AS (SELECT a.job, any_value(c_mktsegment) AS source, any_value(n_name) AS tier,
        bool_or(ev.event IN ('recruiter_screen', 'technical', 'offer', 'rejected')) AS responded
      FROM apps a JOIN ev ON a.job = ev.job JOIN customer ON c_custkey = ev.user_id JOIN nation ON c_nationkey = n_nationkey
      WHERE a.status <> 'dismissed' AND a.applied_at IS NOT NULL GROUP BY a.job),
g AS (SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(tier) = 0 THEN 'tier' ELSE 'all' END AS slice,
  coalesce(source, tier) AS label, count(*) AS applied, count(*) FILTER (WHERE responded) AS responded
  FROM x GROUP BY GROUPING SETS ((source), (tier), ()))
SELECT *, responded / applied AS rate FROM g""")
def response_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, facts = _facts(spark, sf_dir)
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("c_mktsegment").alias("source"), F.col("n_name").alias("tier"))
    user = F.substring_index("job_key", "|", 1).cast("bigint")
    sliced = facts.withColumn("c_custkey", user).join(named, "c_custkey")
    return T.response_rates(sliced, ["source", "tier"])


@query(f"""WITH {_SQL_FOLD}
SELECT job AS job_key, event, replace(event, '_', ' ') AS label, seq, CASE WHEN event <> 'applied' THEN 'x' END AS notes FROM ev""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold, _ = _facts(spark, sf_dir)
    return T.timeline(fold.events).drop("occurred_at")


@query(f"""WITH {_SQL_FOLD}
SELECT job AS job_key, arg_max(event, (ts, seq)) AS last_event, count(*) AS events FROM ev GROUP BY job""")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold, _ = _facts(spark, sf_dir)
    return T.last_events(fold.events).withColumn("last_event", F.col("last_event.event"))


@query("""
WITH p AS (SELECT o_custkey AS job, o_orderpriority AS source, o_orderkey AS k, o_orderdate AS d, o_totalprice FROM orders),
prim AS (SELECT job, arg_max(k, (o_totalprice, k)) AS k, max(o_totalprice) AS top FROM p GROUP BY job),
first AS (SELECT job, arg_min(source, (d, source, lpad(k::VARCHAR, 12, '0'))) AS source FROM p GROUP BY job)
SELECT c_custkey::VARCHAR AS job_key, CASE WHEN first.job IS NULL THEN 'unknown' WHEN top > 450000 THEN p.source ELSE first.source END AS source
FROM customer LEFT JOIN first ON first.job = c_custkey LEFT JOIN prim ON prim.job = c_custkey LEFT JOIN p ON p.k = prim.k""")
def primary_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers shown from their dearest order when it is dear, else from their first."""
    postings = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("job_key"), F.col("o_orderpriority").alias("source"),
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("source_job_id"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen"), "o_totalprice")
    dear = postings.where("o_totalprice > 450000").groupBy("job_key").agg(
        F.max(F.struct("o_totalprice", "source_job_id", "source")).alias("p")).select(
        "job_key", F.col("p.source").alias("primary_source"), F.col("p.source_job_id").alias("primary_source_job_id"))
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("job_key")).join(dear, "job_key", "left")
    return T.primary_sources(jobs, postings)


@query(f"""WITH {_SQL_BEST}
SELECT o_orderkey::VARCHAR AS job_key, 'Order ' || o_orderpriority AS title, c_name AS company, 'not stated' AS location,
  CASE WHEN best.k IS NULL THEN 'job/' || o_orderkey ELSE 'u/' || id END AS apply_url, score,
  CASE WHEN best.k IS NULL THEN '' ELSE 'on ' || st END AS summary,
  CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'P' THEN 'interested' END AS status, o_orderstatus = 'F' AS settled
FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN best ON best.k = o_orderkey""")
def job_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _orders_state(spark, sf_dir)
    best = K.best_scores(state.scores, state.postings, 2)
    return T.job_cards(state.jobs, state.companies, state.applications, best).drop("work_mode", "applied_at")


@query("""
SELECT o_orderkey::VARCHAR AS job_key, coalesce(o_orderstatus IN ('O', 'P'), TRUE) AS can_apply, o_orderstatus = 'D' AS can_undismiss FROM orders""")
def can_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", F.lit("offer")).when(F.col("o_orderstatus") == "P", F.lit("interested"))
    cards = orders.select(F.col("o_orderkey").cast("string").alias("job_key"), status.alias("status"))
    cards = T.can_act(cards, "apply").withColumnRenamed("allowed", "can_apply")
    return T.can_act(cards, "undismiss").withColumnRenamed("allowed", "can_undismiss").drop("status")

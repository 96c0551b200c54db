"""Prefilter, scoring, evaluation, ranking and the digest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import content_hash
from ..operators import inference as I, prefilter as P, ranking as K
from ..operators.evaluate import evaluate
from ..operators.places import LocationRule
from ..plans import digest as D
from ..plans.profile import RepeatRules, SearchProfile
from ..schemas import TABLES, VERDICT, struct_of
from ..session import cut, working_folder
from ..sources.dimensions import load_labelled
from ..sources.store import State, empty_state
from .shared import PROFILE, RULES, moment, sql_content_hash, sql_first_term, sql_words, table, texts

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def as_table(df: DataFrame, table_name: str, /, **columns) -> DataFrame:
    """`df` projected onto a declared table; what is not given is null."""
    return df.select(*[
        (columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in struct_of(TABLES[table_name]).fields
    ])


# --- prefilter over documents ----------------------------------------------------------------

def _title():
    return F.substring_index("text", "\n", 1)


def _decided(spark: SparkSession, sf_dir: str, judged: bool = True) -> tuple[DataFrame, DataFrame]:
    """(dispositions, texts) of documents as open postings of the jobs (source, language).

    Toxic ones were stored with another text (stale); a low quality label counts as a score.
    """
    docs = texts(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    hash_now = content_hash(F.col("source"), _title(), F.lit(None).cast("string"), F.col("text"))
    # The stored table, hashes included, is written before the run that reads it.
    postings = cut(docs.select(
        F.concat_ws("|", "source", "lang").alias("job_key"), F.lit("docs").alias("source"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("source_job_id"),
        F.when(F.col("toxic") == 1, F.lit("stale")).otherwise(hash_now).alias("content_hash"),
        F.timestamp_seconds("doc_id").alias("first_seen"), (F.col("n_chars") > 20).alias("is_open"),
        _title().alias("title"), F.lit(None).cast("string").alias("location_raw"), F.col("text").alias("description"),
        (F.col("quality") == 0).alias("low"),
    ))
    scores = postings.where("low").select("source", "source_job_id", "content_hash", F.lit(1).alias("prompt_version"))
    distinct_jobs = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    place = F.when(F.col("lang") == "en", F.lit("portugal")).when(F.col("lang") == "fr", F.lit("canada")).when(
        F.col("lang") == "es", F.lit("germany")).otherwise(F.lit("unknown"))
    jobs = distinct_jobs.select(
        F.concat_ws("|", "source", "lang").alias("job_key"), F.col("source").alias("company_slug"),
        F.when(F.col("source") == "src3", F.lit("thble")).otherwise(F.col("source")).alias("title"),
        place.alias("region"), F.array(place).alias("regions"), F.lit("onsite").alias("work_mode"))
    companies = distinct_jobs.select(F.col("source").alias("slug"), F.col("source").alias("name")).distinct()
    decided = P.disposition(postings, postings, jobs, companies, scores if judged else scores.limit(0), PROFILE)
    return decided, postings


def _sql_decided(judged: bool = True) -> str:
    title = "split_part(text, chr(10), 1)"
    return f"""
j AS (SELECT d.*, coalesce(toxic, 0) AS toxic, quality, {title} AS title, {sql_words(title)} AS t, {sql_words('text')} AS b,
      {sql_content_hash('source', title, "''", 'text')} AS h
      FROM documents d LEFT JOIN labels USING (doc_id) WHERE n_chars > 20),
m AS (SELECT *, coalesce({sql_first_term('t', PROFILE.title_include)},
        {sql_first_term("(t || ' ' || b)", [*PROFILE.strong, *PROFILE.supporting])}) AS term,
      CASE WHEN toxic = 1 THEN 'stale' ELSE h END AS stored FROM j),
x AS (SELECT *, CASE WHEN {'quality = 0' if judged else 'FALSE'} THEN 'already_judged' WHEN source = 'src3' THEN 'title'
  WHEN lang = 'es' THEN 'location' WHEN toxic = 1 THEN 'stale' WHEN term IS NULL THEN 'unmatched' ELSE 'candidate' END AS disposition FROM m)"""


@query(f"""WITH {_sql_decided()}
SELECT doc_id::VARCHAR AS doc_id, disposition, CASE WHEN disposition IN ('candidate', 'stale') THEN term END AS matched_on FROM x""")
def prefilter_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided, _ = _decided(spark, sf_dir)
    return decided.select(
        F.col("source_job_id").cast("bigint").cast("string").alias("doc_id"), "disposition", "matched_on")


@query(f"""WITH {_sql_decided()}
SELECT count(*) AS open_postings, count(*) FILTER (WHERE disposition <> 'already_judged') AS unjudged_postings,
  count(*) FILTER (WHERE disposition = 'already_judged') AS already_judged,
  count(*) FILTER (WHERE disposition = 'title') AS eliminated_title,
  count(*) FILTER (WHERE disposition = 'location') AS eliminated_location,
  count(*) FILTER (WHERE disposition = 'stale') AS stale, count(*) FILTER (WHERE disposition = 'unmatched') AS unmatched,
  count(*) FILTER (WHERE disposition = 'candidate') AS candidates,
  count(DISTINCT stored) FILTER (WHERE disposition = 'candidate') AS distinct_texts,
  0 AS carried_over FROM x""")
def prefilter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided, _ = _decided(spark, sf_dir)
    return P.disposition_counts(decided, None)


@query(f"""WITH {_sql_decided(False)}
SELECT stored AS content_hash, min(doc_id) AS lead_doc, count(*) AS postings FROM x WHERE disposition = 'candidate'
GROUP BY stored""")
def capped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct texts that a run scores."""
    decided, _ = _decided(spark, sf_dir, judged=False)
    candidates = decided.where("disposition = 'candidate'")
    return I.capped_groups(candidates, None).select(
        "content_hash", F.col("lead.source_job_id").cast("bigint").alias("lead_doc"), "postings")


def arithmetic_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model: the score is the length of the text modulo 103."""
    score = batch["description"].str.len() % 103
    return pd.DataFrame({
        "score": score,
        "band": pd.cut(score, [-1, 39, 79, 200], labels=["far.", "Near", "near"]).astype(str),
        "work_authorization": ["eligible"] * len(batch),
        "input_tokens": score,
    })


_SQL_SCORED = f"""
{_sql_decided(False)},
c AS (SELECT * FROM x WHERE disposition = 'candidate'),
lead AS (SELECT stored, arg_min(length(text), doc_id) % 103 AS score FROM c GROUP BY stored)"""


@query(f"""WITH {_SQL_SCORED}
SELECT doc_id::VARCHAR AS doc_id, c.stored AS content_hash, score FROM c JOIN lead ON c.stored = lead.stored WHERE score <= 100""")
def score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As a run does it: the prefilter's result is written once and read by every later step.
    decided, records = _decided(spark, sf_dir, judged=False)
    candidates = cut(decided.where("disposition = 'candidate'"))
    scores, _ = I.score_texts(candidates, records, arithmetic_scorer, PROFILE, "arithmetic", F.lit("2024-01-01"))
    return scores.select(F.col("source_job_id").cast("bigint").cast("string").alias("doc_id"), "content_hash", "score")


@query(f"""WITH {_SQL_SCORED}
SELECT (SELECT count(*) FROM x) AS open_postings, (SELECT count(*) FROM c) AS candidates,
  count(*) AS distinct_texts, count(*) FILTER (WHERE score <= 100) AS judged, count(*) FILTER (WHERE score > 100) AS failed,
  count(*) FILTER (WHERE score BETWEEN 80 AND 100) AS band_mismatches, 0 AS carried_over,
  sum(score) AS input_tokens, (SELECT count(*) FROM c JOIN lead USING (stored) WHERE score <= 100) AS scored FROM lead""")
def scoring_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided, records = _decided(spark, sf_dir, judged=False)
    decided = cut(decided)
    candidates = decided.where("disposition = 'candidate'")
    scores, verdicts = I.score_texts(candidates, records, arithmetic_scorer, PROFILE, "arithmetic", F.lit("2024-01-01"))
    cap = PROFILE.max_scores_per_run
    return I.scoring_report(P.disposition_counts(decided, cap), verdicts, scores, cap).select(
        "open_postings", "candidates", "distinct_texts", "judged", "failed", "band_mismatches", "carried_over",
        "input_tokens", "scored")


def rejected_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A model whose key runs out: texts of some lengths end all further calls."""
    if (batch["description"].str.len() % 5 == 0).any():
        raise I.FatalInferenceError("key rejected")
    return arithmetic_scorer(batch)


@query(f"""WITH {_SQL_SCORED}
SELECT stored AS content_hash, score, 1 AS answers FROM lead WHERE score <= 100""")
def stored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that ends on a rejected key and the run after it: the verdicts, and how many answers each text was given."""
    decided, records = _decided(spark, sf_dir, judged=False)
    candidates = cut(decided.where("disposition = 'candidate'"))
    store = working_folder(spark, "answers")
    try:
        I.score_texts(candidates, records, rejected_scorer, PROFILE, "arithmetic", F.lit("2024-01-01"), store=store)
    except I.FatalInferenceError:
        pass
    _, verdicts = I.score_texts(candidates, records, arithmetic_scorer, PROFILE, "arithmetic", F.lit("2024-01-02"), store=store)
    schema = struct_of(f"content_hash STRING, {VERDICT}")
    kept = I.stored_answers(spark, store, f"arithmetic-{PROFILE.prompt_version}", schema).where("error IS NULL")
    given = kept.groupBy("content_hash").agg(F.count(F.lit(1)).alias("answers"))
    return verdicts.where("error IS NULL").join(given, "content_hash").select("content_hash", "score", "answers")


@query(f"""WITH {_SQL_SCORED}
SELECT count(*) AS attempted, count(*) FILTER (WHERE score > 100) AS failed FROM lead""")
def failed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the failure policy of a run reads."""
    decided, records = _decided(spark, sf_dir, judged=False)
    candidates = cut(decided.where("disposition = 'candidate'"))
    _, verdicts = I.score_texts(candidates, records, arithmetic_scorer, PROFILE, "arithmetic", F.lit("2024-01-01"))
    return I.failure_counts(verdicts)


_SQL_EVALUATED = f"""
WITH l AS (SELECT d.doc_id, quality = 1 AS relevant, n_chars, {sql_words("split_part(text, chr(10), 1)")} AS t, {sql_words('text')} AS b, text
           FROM documents d JOIN labels USING (doc_id)),
e AS (SELECT *, coalesce({sql_first_term('t', PROFILE.title_exclude)}, {sql_first_term('t', PROFILE.seniority_exclude, True)}) IS NULL
  AND coalesce({sql_first_term('t', PROFILE.title_include)}, {sql_first_term("(t || ' ' || b)", [*PROFILE.strong, *PROFILE.supporting])}) IS NOT NULL AS reached FROM l),
s AS (SELECT *, {{shown}} AS shown FROM e),
k AS (SELECT count(*) FILTER (WHERE relevant AND shown) AS hit, count(*) FILTER (WHERE relevant AND NOT shown) AS miss,
  count(*) FILTER (WHERE NOT relevant AND shown) AS false_alarm, count(*) FILTER (WHERE NOT relevant AND NOT shown) AS ok,
  count(*) FILTER (WHERE relevant) AS relevant, count(*) FILTER (WHERE relevant AND reached) AS kept FROM s)
SELECT hit, miss, false_alarm, ok, relevant, coalesce(hit / nullif(hit + false_alarm, 0), 0.0) AS precision,
  coalesce(hit / nullif(hit + miss, 0), 0.0) AS recall,
  coalesce(2.0 * hit / nullif(2 * hit + miss + false_alarm, 0), 0.0) AS f1, coalesce(kept / nullif(relevant, 0), 0.0) AS prefilter_recall FROM k"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("company"), _title().alias("title"),
        F.lit("Lisbon").alias("location"), F.lit("hybrid").alias("work_mode"), (F.col("quality") == 1).alias("relevant"),
        F.col("text").alias("description"))


@query(_SQL_EVALUATED.format(shown="reached"))
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics = evaluate(_labelled(spark, sf_dir), PROFILE)
    return metrics


@query(_SQL_EVALUATED.format(shown="reached AND length(text) % 103 BETWEEN 70 AND 100"))
def evaluation_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    def capped(batch: pd.DataFrame) -> pd.DataFrame:
        answers = arithmetic_scorer(batch)
        answers["error"] = answers["score"].gt(100).map({True: "too long", False: None})
        return answers

    _, metrics = evaluate(_labelled(spark, sf_dir), PROFILE, capped)
    return metrics


# --- ranking over lineitem, orders, customer -------------------------------------------------

def _line_key():
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], cents)


def _line_scores(lineitem: DataFrame) -> DataFrame:
    """Every line is a posting with one score out of 0..100; the return flag is the version."""
    version = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    return as_table(
        lineitem, "scores", source=F.lit("lines"), source_job_id=_line_key(), content_hash=F.lit("text"),
        prompt_version=version, score=F.floor(F.col("l_extendedprice") / 1050), summary=F.concat(F.lit(" on "), "l_linestatus"),
        concerns=F.array().cast("array<string>"),
        work_authorization=F.when(F.col("l_tax") > 0.06, F.lit("unclear")).otherwise(F.lit("eligible")),
        scored_at=moment("l_shipdate"))


def _line_postings(lineitem: DataFrame) -> DataFrame:
    """A line sent before 2000 is open; a tenth of them were reworded since they were scored."""
    return as_table(
        lineitem, "postings", job_key=F.col("l_orderkey").cast("string"), source=F.lit("lines"), source_job_id=_line_key(),
        company_slug=F.lit("any"), url=F.concat(F.lit("u/"), _line_key()),
        content_hash=F.when(F.col("l_discount") == 0.1, F.lit("reworded")).otherwise(F.lit("text")),
        first_seen=moment("l_shipdate"), is_open=F.col("l_shipdate") < "2000-01-01")


_SQL_BEST = """
s AS (SELECT l_orderkey AS k, floor(l_extendedprice / 1050)::INT AS score, CASE WHEN l_tax > 0.06 THEN 'unclear' ELSE 'eligible' END AS wa,
        l_shipdate AS shipped, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * 100)::BIGINT) AS id, l_linestatus AS st
      FROM lineitem WHERE l_returnflag = 'N' AND l_discount <> 0.1 AND l_shipdate < '2000-01-01'),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, shipped, id) = 1)"""


@query(f"WITH {_SQL_BEST} SELECT k::VARCHAR AS job_key, score, wa AS work_authorization, id AS source_job_id FROM best")
def best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return K.best_scores(_line_scores(lines), _line_postings(lines), 2).select(
        "job_key", "score", "work_authorization", "source_job_id")


_ORDERS_PROFILE = SearchProfile(
    title_include=["order"], strong=["order"], threshold=70, prompt_version=2,
    priority=[LocationRule(("onsite", "hybrid"), ("portugal", "switzerland"))],
    acceptable=[LocationRule(("onsite", "hybrid"), ("canada",)), LocationRule(("remote",), ("eu", "us"))],
)
_PLACE = {"MACHINERY": "portugal", "BUILDING": "canada", "FURNITURE": "us", "AUTOMOBILE": "unknown", "HOUSEHOLD": "germany"}
_DAY, _INSTANT = "2000-06-15", "2000-06-15 06:00:00"


def _orders_state(spark: SparkSession, sf_dir: str) -> State:
    """Orders as jobs of customers, lines as their postings and scores, earlier years as showings.

    Fulfilled orders count as applied to. Every order was shown on as many days as its
    priority says, at a score that may have moved since.
    """
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customer = table(spark, sf_dir, "customer")
    region = F.coalesce(*[F.when(F.col("c_mktsegment") == s, F.lit(p)) for s, p in _PLACE.items()])
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    key, slug = F.col("o_orderkey").cast("string"), F.col("c_custkey").cast("string")
    mode = F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("remote")).otherwise(F.lit("onsite"))
    jobs = as_table(
        placed, "jobs", job_key=key, canonical_key=key, company_slug=slug, title=F.concat(F.lit("Order "), "o_orderpriority"),
        region=region, regions=F.when(region == "unknown", F.array().cast("array<string>")).otherwise(F.array(region)),
        work_mode=mode, apply_url=F.concat(F.lit("job/"), key), content_hash=F.col("o_orderpriority"),
        primary_source=F.lit("lines"), first_seen=moment("o_orderdate"))
    first_order = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("since"))
    companies = as_table(
        customer.join(first_order, F.col("c_custkey") == F.col("o_custkey")), "companies", slug=slug, name=F.col("c_name"),
        ats_type=F.lit("lever"), tier=F.col("c_mktsegment"), active=F.lit(True), created_at=moment("since"))
    status = F.when(F.col("o_orderstatus") == "F", F.lit("applied")).otherwise(F.lit("interested"))
    applications = as_table(
        orders.where("o_orderstatus <> 'O'"), "applications", job_key=key, status=status, created_at=moment("o_orderdate"))
    shown = F.left("o_orderpriority", F.lit(1)).cast("int")
    days = orders.select(key.alias("job_key"), "o_orderpriority", "o_totalprice", F.explode(F.sequence(F.lit(1), shown + 1)).alias("n"))
    appearances = as_table(
        days, "digest_appearances", job_key=F.col("job_key"), digest_date=F.date_sub(F.lit(_DAY).cast("date"), F.col("n") - 1),
        section=F.lit("priority"), position=F.lit(1),
        score_at_appearance=F.when(F.col("n") <= 3, F.lit(None)).otherwise(F.floor(F.col("o_totalprice") / 5000)),
        content_hash_at_appearance=F.col("o_orderpriority"))
    waiting = as_table(customer.where("c_acctbal < 0"), "candidate_companies", name=F.col("c_name"), name_key=F.col("c_name"),
                       status=F.when(F.col("c_mktsegment") == "BUILDING", F.lit("rejected")).otherwise(F.lit("pending")))
    return empty_state(spark).with_(
        jobs=jobs, companies=companies, applications=applications, digest_appearances=appearances,
        postings=_line_postings(lines), scores=_line_scores(lines), candidate_companies=waiting)


def _sql_shown(history: str) -> str:
    """Shortlisted orders with section and appearance; `history` limits the showings by n."""
    return f"""
{_SQL_BEST},
o AS (SELECT o_orderkey AS k, o_orderpriority AS pr, o_totalprice AS price, c_name AS company, c_mktsegment AS seg, score, wa, id,
        'Order ' || o_orderpriority AS title
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN best ON best.k = o_orderkey
      WHERE o_orderstatus <> 'F' AND score >= 70),
f AS (SELECT *, CASE seg WHEN 'MACHINERY' THEN 'priority' WHEN 'BUILDING' THEN 'acceptable' WHEN 'FURNITURE' THEN 'acceptable'
        WHEN 'AUTOMOBILE' THEN 'unknown' ELSE 'excluded' END AS fit FROM o),
h AS (SELECT k, n, CASE WHEN n > 3 AND abs(score - floor(price / 5000)) > 10 THEN 1 ELSE 0 END AS changed
      FROM f, unnest(range(1, left(pr, 1)::INT + 2)) AS u(n) WHERE {history}),
run AS (SELECT k, sum(changed) OVER (PARTITION BY k ORDER BY n) AS breaks FROM h),
cnt AS (SELECT k, count(*) AS shown FROM run WHERE breaks = 0 GROUP BY k),
a AS (SELECT f.*, coalesce(shown, 0) + 1 AS appearance,
  CASE WHEN fit = 'excluded' THEN NULL WHEN wa <> 'eligible' OR fit = 'unknown' THEN 'worth_checking' ELSE fit END AS section
  FROM f LEFT JOIN cnt ON f.k = cnt.k)"""


_LOW = RepeatRules(demote_after=2, suppress_after=4, reset_on_score_delta=10)


@query(f"""WITH {_sql_shown('n >= 2')},
e AS (SELECT *, appearance > 2 AS demoted FROM a WHERE section IS NOT NULL AND appearance <= 4)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY demoted, score DESC, lower(company), lower(title), k::VARCHAR) AS position,
  k::VARCHAR AS job_key, score, appearance, demoted, 'u/' || id AS apply_url FROM e""")
def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole daily digest over orders."""
    entries = D.digest_entries(_orders_state(spark, sf_dir), _ORDERS_PROFILE, _LOW, F.lit(_DAY))
    return entries.select("section", "position", "job_key", "score", "appearance", "demoted", "apply_url")


_SQL_NEWS = f"""
c0 AS (SELECT c_custkey, c_name, c_mktsegment, min(o_orderdate) AS since FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL),
news AS (SELECT * FROM c0 WHERE since >= TIMESTAMP '1995-03-01' - INTERVAL 7 DAY AND since > (SELECT min(since) FROM c0) + INTERVAL 60 SECOND)"""


@query(f"""WITH {_sql_shown('n >= 2')}, w AS (SELECT count(*) AS n FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'),
c0 AS (SELECT c_custkey, min(o_orderdate) AS since FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT count(*) FILTER (WHERE appearance <= 4) AS total, count(*) FILTER (WHERE appearance <= 4 AND section = 'priority') AS priority,
  count(*) FILTER (WHERE appearance <= 4 AND section = 'acceptable') AS acceptable,
  count(*) FILTER (WHERE appearance <= 4 AND section = 'worth_checking') AS worth_checking,
  count(*) FILTER (WHERE appearance > 4) AS still_open, (SELECT n FROM w) AS pending_candidates,
  (SELECT count(*) FROM c0 WHERE since >= TIMESTAMP '{_INSTANT}' - INTERVAL 7 DAY AND since > (SELECT min(since) FROM c0) + INTERVAL 60 SECOND) AS new_companies
FROM a WHERE section IS NOT NULL""")
def digest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = D.digest_counts(
        _orders_state(spark, sf_dir), _ORDERS_PROFILE, _LOW, F.lit(_DAY), F.lit(_INSTANT), "Europe/Lisbon")
    return summary.drop("digest_date", "is_empty")


@query(f"""WITH {_sql_shown('TRUE')}
SELECT k::VARCHAR AS job_key, company, title, score, appearance - 1 AS appearances, appearance > 4 AS suppressed, 'u/' || id AS apply_url,
  row_number() OVER (ORDER BY score DESC, lower(company), lower(title), k::VARCHAR) AS position FROM a""")
def open_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles, _ = D.open_roles(_orders_state(spark, sf_dir), _ORDERS_PROFILE, _LOW)
    return roles.select("job_key", "company", "title", "score", "appearances", "suppressed", "apply_url", "position")


@query(f"""WITH {_SQL_NEWS}, p AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey::VARCHAR AS slug, c_name AS name, c_mktsegment AS tier, coalesce(n, 0) AS open_postings,
  strftime(since, '%Y-%m-%d') AS added, row_number() OVER (ORDER BY since DESC, c_custkey::VARCHAR DESC) AS position
FROM news LEFT JOIN p ON c_custkey = o_custkey""")
def new_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _orders_state(spark, sf_dir)
    postings = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("company_slug"), (F.col("o_orderstatus") == "O").alias("is_open"))
    return D.new_companies(state.companies, postings, F.lit("1995-03-01"), "Europe/Lisbon").select(
        "slug", "name", "tier", "open_postings", F.date_format("added", "yyyy-MM-dd").alias("added"), "position")


# --- repeat suppression over events ----------------------------------------------------------

def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One showing per user and day."""
    return table(spark, sf_dir, "events").groupBy(
        F.col("user_id").cast("string").alias("job_key"), F.col("ts").cast("date").alias("digest_date")
    ).agg(
        F.lit("priority").alias("section"), F.lit(1).cast("bigint").alias("position"),
        F.when(F.count(F.lit(1)) > 1, F.floor(F.max("value"))).cast("int").alias("score_at_appearance"),
        F.when(F.max("value") < 120, F.lit("same")).alias("content_hash_at_appearance"),
    )


_SQL_DAILY = """
d AS (SELECT user_id, ts::DATE AS day, CASE WHEN count(*) > 1 THEN floor(max(value))::INT END AS score,
        CASE WHEN max(value) < 120 THEN 'same' END AS h FROM events GROUP BY ALL)"""


@query(f"""WITH {_SQL_DAILY},
j AS (SELECT user_id, floor(avg(value))::INT AS now_score FROM events GROUP BY 1),
b AS (SELECT d.*, now_score, (h IS DISTINCT FROM 'same') OR coalesce(abs(now_score - score) > 60, FALSE) AS changed
      FROM d JOIN j USING (user_id) WHERE day < DATE '2024-01-25'),
r AS (SELECT user_id, sum(changed::INT) OVER (PARTITION BY user_id ORDER BY day DESC) AS breaks FROM b),
c AS (SELECT user_id, count(*) FILTER (WHERE breaks = 0) AS shown FROM r GROUP BY 1)
SELECT user_id::VARCHAR AS job_key, coalesce(shown, 0) + 1 AS appearance, coalesce(shown, 0) + 1 > 5 AS suppressed, coalesce(shown, 0) + 1 > 3 AS demoted
FROM j LEFT JOIN c USING (user_id)""")
def repeat_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("job_key")).agg(
        F.floor(F.avg("value")).cast("int").alias("score"), F.lit("same").alias("content_hash"))
    rules = RepeatRules(RULES.demote_after, RULES.suppress_after, 60)
    return K.repeat_state(jobs, _daily(spark, sf_dir), rules, before="2024-01-25").select(
        "job_key", "appearance", "suppressed", "demoted")


@query(f"""WITH {_SQL_DAILY},
e AS (SELECT DISTINCT user_id, DATE '2024-01-15' AS day FROM events WHERE value > 150)
SELECT user_id::VARCHAR AS job_key, strftime(day, '%Y-%m-%d') AS digest_date, 'priority' AS section, 1 AS position, score AS score_at_appearance
FROM d WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = d.user_id AND e.day = d.day)
UNION ALL SELECT user_id::VARCHAR, strftime(day, '%Y-%m-%d'), 'acceptable', 2, 99 FROM e""")
def appearance_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "events").where("value > 150").select(
        F.col("user_id").cast("string").alias("job_key"), F.lit("acceptable").alias("section"), F.lit(2).alias("position"),
        F.lit(99).alias("score"), F.lit("h").alias("content_hash")).distinct()
    return K.record_appearances(_daily(spark, sf_dir), entries, "2024-01-15").select(
        "job_key", F.date_format("digest_date", "yyyy-MM-dd").alias("digest_date"), "section", "position", "score_at_appearance")


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS position,
  o_orderpriority FROM orders""")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions within groups that may hold any share of the rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return K.positions(orders, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")]).select(
        "o_orderkey", "position", "o_orderpriority")


@query("""
WITH a AS (SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS n FROM customer)
SELECT c_custkey, CASE WHEN seg = 'AUTOMOBILE' THEN 'Location could not be settled.'
  WHEN seg = 'BUILDING' THEN 'The location qualifies' || CASE WHEN n < 10 THEN ' (via canada)' ELSE '' END || ', but the work authorization is blocked.'
  WHEN n < 10 THEN 'priority via canada' ELSE '' END AS section_note,
  CASE WHEN n > 3 THEN n || CASE WHEN n IN (11, 12, 13) THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END
    || ' time — dismiss?' ELSE '' END AS repeat_note FROM a""")
def digest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    segment, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    fit = F.when(segment == "AUTOMOBILE", F.lit("unknown")).otherwise(F.lit("priority"))
    rights = F.when(segment == "BUILDING", F.lit("blocked")).otherwise(F.lit("eligible"))
    place = F.when(nation < 10, F.lit("canada")).otherwise(F.lit("uk"))
    return customer.select(
        "c_custkey", K.section_note(fit, rights, place, F.lit("uk")).alias("section_note"),
        K.repeat_note(nation, nation > 3).alias("repeat_note"))




@query("""
SELECT l_orderkey::VARCHAR AS source_job_id, l_partkey::VARCHAR AS content_hash, min(l_linenumber) * 10 + 1 AS score
FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL
UNION ALL
SELECT l_orderkey::VARCHAR, l_partkey::VARCHAR, min(l_linenumber) * 10 + 2 FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_linenumber <= 2 AND s.l_orderkey = l.l_orderkey AND s.l_partkey = l.l_partkey)
GROUP BY ALL""")
def score_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scores: the first two lines of an order are stored, and all of them arrive again."""
    def scores(rows: DataFrame, run: int) -> DataFrame:
        keyed = rows.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("line"))
        return keyed.select(
            F.lit("orders").alias("source"), F.col("l_orderkey").cast("string").alias("source_job_id"),
            F.col("l_partkey").cast("string").alias("content_hash"), F.lit(1).alias("prompt_version"),
            (F.col("line") * 10 + run).alias("score"))

    items = table(spark, sf_dir, "lineitem")
    after = I.append_scores(scores(items.where("l_linenumber <= 2"), 1), scores(items, 2))
    return after.select("source_job_id", "content_hash", "score")


@query("""
SELECT d.doc_id::VARCHAR AS id, d.source AS company, d.lang AS title, quality = 1 AS relevant, length(d.text) AS n_chars
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def labelled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled set as it is loaded, checked."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("company"), F.col("lang").alias("title"),
        F.lit(None).cast("string").alias("location"), F.lit("remote").alias("work_mode"),
        (F.col("quality") == 1).alias("relevant"), F.lit(None).cast("string").alias("note"), F.col("text").alias("description"))
    return load_labelled(rows).select("id", "company", "title", "relevant", F.length("description").alias("n_chars"))


def first_words(batch: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model: the first word is the company, and some texts cannot be read."""
    # Plain strings: most batches are one row, retried, where a column function costs more than the work.
    texts = batch["text"].tolist()
    if any(t is not None and len(t) % 7 == 0 for t in texts):
        raise ValueError("unreadable")
    words = [t and t.split() for t in texts]
    return pd.DataFrame({
        "company": [w[0] if w else None for w in words], "roles": [list(w and w[1:3]) for w in words],
        "careers_url": [None] * len(batch)})


@query("""
WITH w AS (SELECT doc_id, length(text) % 7 = 0 AS bad, list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id::VARCHAR AS source_job_id, CASE WHEN NOT bad THEN w[1] END AS company,
  CASE WHEN NOT bad THEN array_to_string(w[2:3], '|') END AS roles, CASE WHEN bad THEN 'ValueError: unreadable' END AS error FROM w""")
def extracted_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction over every document; a text that fails stays as a row with its reason."""
    prose = texts(spark, sf_dir, "documents").select(
        F.lit("docs").alias("source"), F.col("doc_id").cast("string").alias("source_job_id"), "text")
    answers = I.extract_companies(prose, first_words, None, [F.col("source_job_id")])
    return answers.select("source_job_id", "company", F.array_join("roles", "|").alias("roles"), "error")


def by_length(batch: pd.DataFrame) -> pd.DataFrame:
    """Stands in for a model: a label per length, one of them outside the vocabulary."""
    size = batch["n_chars"] % 4
    if (size == 3).any():
        raise ValueError("no answer")
    return pd.DataFrame({"tier": size.map({0: "lab", 1: "startup", 2: "elsewhere"}), "because": ["length"] * len(batch)})


@query("""
SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN 'lab' WHEN 1 THEN 'startup' WHEN 2 THEN 'discovered' END AS tier FROM documents""")
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label per document: the default for answers outside the vocabulary, null where the call failed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return I.classify(docs, by_length, ["doc_id"], ["lab", "startup"], "discovered").select("doc_id", "tier")

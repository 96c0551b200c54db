"""How well the prefilter and a scorer agree with a labelled set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import render_posting
from ..schemas import VERDICT
from ..session import cut
from .inference import BatchFunction, infer
from .places import location_match, parse_location
from .prefilter import matched_term, title_exclusion


def outcome(relevant: Column, shown: Column) -> Column:
    """hit, miss, false alarm or ok."""
    return (
        F.when(relevant & shown, F.lit("hit")).when(relevant, F.lit("miss"))
        .when(shown, F.lit("false alarm")).otherwise(F.lit("ok"))
    )


def metrics(rows: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall, F1 and prefilter recall of evaluated rows, as one row.

    `rows` has relevant, outcome and reached_scorer. A share without a denominator is zero.
    """
    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    hit, miss, alarm = F.col("hit"), F.col("miss"), F.col("false_alarm")
    counted = rows.agg(
        F.count_if(F.col("outcome") == "hit").alias("hit"),
        F.count_if(F.col("outcome") == "miss").alias("miss"),
        F.count_if(F.col("outcome") == "false alarm").alias("false_alarm"),
        F.count_if(F.col("outcome") == "ok").alias("ok"),
        F.count_if("relevant").alias("relevant"),
        F.count_if(F.col("relevant") & F.col("reached_scorer")).alias("kept"),
    )
    return (
        counted.withColumn("precision", share(hit, hit + alarm))
        .withColumn("recall", share(hit, hit + miss))
        .withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .withColumn("prefilter_recall", share(F.col("kept"), F.col("relevant")))
        .drop("kept")
    )


def evaluate(labelled: DataFrame, profile, scorer: BatchFunction | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, metrics) of a labelled set: id, company, title, location, work_mode, description, relevant.

    The location fit is reported and not applied. Without a scorer everything the prefilter
    keeps counts as shown.
    """
    where = parse_location(F.col("location"), workplace_type=F.col("work_mode"))
    fit = location_match(F.col("place.region"), F.col("place.regions"), F.col("place.work_mode"),
                         profile.priority, profile.acceptable)
    rows = (
        labelled.withColumn("place", where)
        .withColumn("location_fit", fit["fit"])
        .withColumn("excluded_by", title_exclusion(F.col("title"), profile))
        .withColumn("matched_on", matched_term(F.col("title"), F.col("description"), profile))
        .withColumn("reached_scorer", F.col("excluded_by").isNull() & F.col("matched_on").isNotNull())
    )
    if scorer is None:
        rows = rows.withColumn("score", F.lit(None).cast("int")).withColumn("error", F.lit(None).cast("string"))
        shown = F.col("reached_scorer")
    else:
        text = render_posting(F.col("company"), F.col("title"), F.col("location"), F.col("place.region"),
                              F.col("place.work_mode"), F.col("description"))
        rows = cut(rows)
        asked = rows.where("reached_scorer").select("id", "title", "description", text.alias("text"))
        answers = infer(asked, scorer, VERDICT, ["id"]).select("id", "score", "error")
        rows = rows.join(answers, "id", "left")
        shown = F.coalesce(F.col("reached_scorer") & F.col("error").isNull() & (F.col("score") >= profile.threshold), F.lit(False))
    rows = rows.withColumn("outcome", outcome(F.col("relevant"), shown)).drop("place")
    return rows, metrics(rows)

"""Readers of landed board responses.

A landed row is one response of one board: (source, company_slug, fetched_at,
http_status, body). Reading is a pure projection in two steps: the envelope yields the
raw JSON of each posting, and one select-list per source turns raw JSON into the common
posting record. Replay applies the second step alone to the stored `raw` column.

A response that cannot be read fails its whole board, with a reason, and yields no
postings. A board that answered with nothing is a success with zero items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import html_array_to_text, html_to_text, strip
from ..functions.times import parse_iso_datetime
from ..schemas import POSTING, struct_of

# How the hiring thread is named, linked, and how long its titles may be.
THREAD_TITLE = "Ask HN: Who is hiring?"
COMMENT_URL = "https://news.ycombinator.com/item?id="


def _truthy(col: Column) -> Column:
    """The text, or null when it is empty: how sources write an absent value."""
    return F.nullif(col, F.lit(""))


@dataclass(frozen=True)
class Source:
    """One format: where the items sit, what an item must carry, and its select-list.

    `columns` maps the item struct to posting columns; what it leaves out is null.
    """

    name: str
    label: str
    envelope: str | None
    item: str
    required: tuple[str, ...]
    columns: Callable[[Column], dict[str, Column]]
    keep: Callable[[Column, Column], Column] = lambda raw, item: F.lit(True)
    stored: Callable[[Column], Column] = lambda raw: raw

    @property
    def schema(self) -> T.StructType:
        return struct_of(self.item)

    def items(self, body: Column) -> Column:
        """The raw JSON of every item, null when the body has another shape."""
        if self.envelope is None:
            return F.from_json(body, "ARRAY<STRING>")
        return F.from_json(body, f"{self.envelope} ARRAY<STRING>")[self.envelope]


def _greenhouse(job: Column) -> dict[str, Column]:
    offices = F.transform(F.coalesce(job["offices"], F.array()), lambda office: office["name"])
    return {
        "source_job_id": job["id"],
        "title": job["title"],
        "url": job["absolute_url"],
        "location_raw": job["location"]["name"],
        "description": html_to_text(job["content"], escaped=True),
        "location_hints": F.filter(offices, lambda name: name != ""),
        "posted_at": parse_iso_datetime(F.coalesce(_truthy(job["first_published"]), job["updated_at"])),
    }


def _lever(job: Column) -> dict[str, Column]:
    place = job["categories"]["location"]
    lists = F.coalesce(job["lists"], F.array())
    headings = F.transform(lists, lambda section: F.coalesce(section["text"], F.lit("")))
    bodies = html_array_to_text(F.transform(lists, lambda s: F.coalesce(s["content"], F.lit(""))))
    sections = F.zip_with(
        headings, F.slice(bodies, F.lit(1), F.size(lists)),
        lambda heading, body: strip(F.concat(heading, F.lit("\n"), body)),
    )
    parts = F.concat(F.array(job["descriptionPlain"]), sections, F.array(job["additionalPlain"]))
    return {
        "source_job_id": job["id"],
        "title": job["text"],
        "url": job["hostedUrl"],
        "location_raw": place,
        "description": strip(F.array_join(F.filter(parts, lambda part: part != ""), "\n\n")),
        "country_code": job["country"],
        "workplace_type": job["workplaceType"],
        "location_hints": F.filter(
            F.coalesce(job["categories"]["allLocations"], F.array()), lambda p: ~p.eqNullSafe(place)
        ),
        "posted_at": F.timestamp_millis(job["createdAt"].cast("bigint")),
    }


def _ashby(job: Column) -> dict[str, Column]:
    elsewhere = F.transform(F.coalesce(job["secondaryLocations"], F.array()), lambda s: s["location"])
    country = job["address"]["postalAddress"]["addressCountry"]
    return {
        "source_job_id": job["id"],
        "title": job["title"],
        "url": F.coalesce(_truthy(job["jobUrl"]), job["applyUrl"]),
        "location_raw": job["location"],
        "description": strip(F.coalesce(job["descriptionPlain"], F.lit(""))),
        "workplace_type": job["workplaceType"],
        "is_remote": job["isRemote"],
        "location_hints": F.filter(F.concat(elsewhere, F.array(country)), lambda p: p != ""),
        "posted_at": parse_iso_datetime(job["publishedAt"]),
    }


def _hn(comment: Column) -> dict[str, Column]:
    text = html_to_text(comment["text"])
    first_line = strip(F.substring_index(text, "\n", 1))
    return {
        "source_job_id": comment["id"],
        "title": first_line,
        "url": F.concat(F.lit(COMMENT_URL), comment["id"]),
        "description": text,
        "posted_at": parse_iso_datetime(comment["created_at"]),
    }


def _named(job: Column, field: str) -> Column:
    return _truthy(strip(job[field]))


def _remoteok(job: Column) -> dict[str, Column]:
    return {
        "source_job_id": job["id"],
        "title": job["position"],
        "url": F.coalesce(_truthy(job["url"]), job["apply_url"]),
        "location_raw": _truthy(job["location"]),
        "description": html_to_text(job["description"], escaped=True),
        "is_remote": F.lit(True),
        "posted_at": parse_iso_datetime(job["date"]),
        "company_name": _named(job, "company"),
    }


def _arbeitnow(job: Column) -> dict[str, Column]:
    return {
        "source_job_id": job["slug"],
        "title": job["title"],
        "url": job["url"],
        "location_raw": _truthy(job["location"]),
        "description": html_to_text(job["description"], escaped=True),
        "is_remote": job["remote"],
        "posted_at": F.timestamp_seconds(job["created_at"]),
        "company_name": _named(job, "company_name"),
    }


def _remotive(job: Column) -> dict[str, Column]:
    return {
        "source_job_id": job["id"],
        "title": job["title"],
        "url": job["url"],
        "location_raw": _truthy(job["candidate_required_location"]),
        "description": html_to_text(job["description"]),
        "is_remote": F.lit(True),
        "posted_at": parse_iso_datetime(job["publication_date"]),
        "company_name": _named(job, "company_name"),
    }


BOARD_SOURCES: dict[str, Source] = {
    "greenhouse": Source(
        "greenhouse", "Greenhouse", "jobs",
        "id STRING, title STRING, absolute_url STRING, location STRUCT<name: STRING>, "
        "offices ARRAY<STRUCT<name: STRING>>, content STRING, first_published STRING, updated_at STRING",
        ("id", "title"), _greenhouse,
    ),
    "lever": Source(
        "lever", "Lever", None,
        "id STRING, text STRING, hostedUrl STRING, categories STRUCT<location: STRING, "
        "allLocations: ARRAY<STRING>>, descriptionPlain STRING, lists ARRAY<STRUCT<text: STRING, "
        "content: STRING>>, additionalPlain STRING, country STRING, workplaceType STRING, createdAt DOUBLE",
        ("id", "text"), _lever,
    ),
    "ashby": Source(
        "ashby", "Ashby", "jobs",
        "id STRING, title STRING, jobUrl STRING, applyUrl STRING, location STRING, "
        "secondaryLocations ARRAY<STRUCT<location: STRING>>, address STRUCT<postalAddress: "
        "STRUCT<addressCountry: STRING>>, descriptionPlain STRING, workplaceType STRING, "
        "isRemote BOOLEAN, isListed BOOLEAN, publishedAt STRING",
        ("id", "title"), _ashby,
        # A missing flag means listed; an explicit null does not.
        keep=lambda raw, job: F.coalesce(
            job["isListed"], ~F.map_contains_key(F.from_json(raw, "MAP<STRING, STRING>"), "isListed")),
    ),
}

DISCOVERY_SOURCES: dict[str, Source] = {
    "hn": Source(
        "hn", "Hacker News", "children",
        "id STRING, text STRING, created_at STRING", ("id",), _hn,
        keep=lambda raw, comment: F.coalesce(comment["text"] != "", F.lit(False)),
        # Replies can outweigh a posting, so the stored payload leaves them out.
        stored=lambda raw: F.to_json(F.map_filter(
            F.from_json(raw, "MAP<STRING, STRING>"), lambda key, value: key != "children")),
    ),
    "remoteok": Source(
        "remoteok", "RemoteOK", None,
        "id STRING, position STRING, company STRING, url STRING, apply_url STRING, location STRING, "
        "description STRING, date STRING", ("id", "position"), _remoteok,
        # The legal notice at the head of the list is no posting.
        keep=lambda raw, job: F.coalesce(
            (job["id"] != "") & (job["id"] != "0") & (job["position"] != ""), F.lit(False)),
    ),
    "arbeitnow": Source(
        "arbeitnow", "Arbeitnow", "data",
        "slug STRING, title STRING, company_name STRING, location STRING, remote BOOLEAN, url STRING, "
        "description STRING, created_at DOUBLE", ("slug", "title"), _arbeitnow,
    ),
    "remotive": Source(
        "remotive", "Remotive", "jobs",
        "id STRING, title STRING, company_name STRING, url STRING, candidate_required_location STRING, "
        "publication_date STRING, description STRING", ("id", "title"), _remotive,
    ),
}

ALL_SOURCES: dict[str, Source] = {**BOARD_SOURCES, **DISCOVERY_SOURCES}


def parse_boards(landed: DataFrame, source: str) -> DataFrame:
    """One row per landed response of `source`: the kept raw items, or why it failed."""
    kind = ALL_SOURCES[source]
    body = F.col("body")
    items = kind.items(body)
    parsed = F.transform(items, lambda raw: F.struct(raw.alias("raw"), F.from_json(raw, kind.schema).alias("item")))
    kept = F.filter(parsed, lambda row: kind.keep(row["raw"], row["item"]))

    def lacks(row: Column) -> Column:
        return reduce(lambda a, b: a | b, [row["item"][field].isNull() for field in kind.required])

    boards = landed.where(F.col("source") == source).withColumn("kept", kept)
    error = (
        F.when(F.col("http_status").isNull(), F.lit("No response"))
        .when(~F.col("http_status").between(200, 299), F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))
        .when(F.try_parse_json(body).isNull(), F.lit("Non-JSON response"))
        .when(F.col("kept").isNull(), F.lit(f"Unexpected {kind.label} payload: no item list"))
        .when(F.exists("kept", lacks), F.lit(f"Unexpected {kind.label} payload: an item lacks "
                                             f"{' or '.join(kind.required)}"))
    )
    return boards.select(
        "source", "company_slug", "fetched_at",
        error.alias("error"),
        F.transform("kept", lambda row: row["raw"]).alias("items"),
    )


def project_raw(stored: DataFrame, source: str) -> DataFrame:
    """Replay: the posting record of every row of `stored`, from its `raw` column.

    Columns of `stored` that are not part of the record are carried along.
    """
    kind = ALL_SOURCES[source]
    record_type = struct_of(POSTING)
    carried = [c for c in stored.columns if c not in record_type.fieldNames() or c == "raw"]
    item = stored.select(*carried, F.from_json("raw", kind.schema).alias("_item"))
    columns = kind.columns(F.col("_item"))
    record = [
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in record_type.fields
        if f.name not in ("raw", "source", "location_hints")
    ]
    hints = columns.get("location_hints", F.array().cast("array<string>"))
    return item.select(
        F.lit(source).alias("source"), *carried, *record, hints.alias("location_hints")
    )


def replay(stored: DataFrame, sources: Iterable[str] = tuple(ALL_SOURCES)) -> DataFrame:
    """`project_raw` over a table holding several sources; rows of other sources are left out."""
    return reduce(
        DataFrame.unionByName,
        [project_raw(stored.where(F.col("source") == name), name) for name in sources],
    )


def board_postings(boards: DataFrame, source: str) -> DataFrame:
    """The posting records of every board that did not fail."""
    raw = (
        boards.where("error IS NULL")
        .select("company_slug", "fetched_at", F.posexplode("items").alias("position", "raw"))
        .withColumn("raw", ALL_SOURCES[source].stored(F.col("raw")))
    )
    return project_raw(raw, source)


def board_runs(boards: DataFrame) -> DataFrame:
    """One fetch-run row per landed response."""
    ok = F.col("error").isNull()
    return boards.select(
        "company_slug", "source",
        F.col("fetched_at").alias("started_at"), F.col("fetched_at").alias("finished_at"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.when(ok, F.size("items").cast("bigint")).alias("item_count"),
        "error",
    )


def append_runs(stored: DataFrame, runs: DataFrame) -> DataFrame:
    """The stored fetch runs and those of a poll; nothing stored is read again or changed."""
    return stored.unionByName(runs.select(*[F.col(f.name).cast(f.dataType) for f in stored.schema.fields]))


def current_thread(search: DataFrame) -> DataFrame:
    """The newest hiring thread of each landed search response: (fetched_at, thread_id)."""
    hits = F.from_json("body", "hits ARRAY<STRUCT<objectID: STRING, title: STRING>>")["hits"]
    matching = F.filter(hits, lambda hit: F.startswith(hit["title"], F.lit(THREAD_TITLE)))
    return search.select("fetched_at", F.try_element_at(matching, F.lit(1))["objectID"].alias("thread_id"))


def thread_boards(search: DataFrame, threads: DataFrame) -> DataFrame:
    """Landed thread responses limited to the thread each search named.

    A search that names no thread, or whose thread never landed, stays as a row with no
    body, which reads as a failed board.
    """
    wanted = current_thread(search)
    found = threads.withColumn("thread_id", F.get_json_object("body", "$.id")).select(
        "thread_id", "http_status", "body"
    )
    return wanted.join(found, "thread_id", "left").select(
        F.lit("hn").alias("source"), F.lit(None).cast("string").alias("company_slug"), "fetched_at",
        F.when(F.col("body").isNotNull(), F.col("http_status")).alias("http_status"), "body",
    )


def read_source(landed: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(postings, fetch_runs) of one source."""
    boards = parse_boards(landed, source)
    return board_postings(boards, source), board_runs(boards)


def read_sources(landed: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, fetch_runs) of every source; one nobody can read becomes a failed run."""
    names = [name for name in ALL_SOURCES if only is None or name in only]
    read = [read_source(landed, name) for name in names]
    postings = reduce(DataFrame.unionByName, [p for p, _ in read])
    unknown = landed.where(~F.col("source").isin(list(ALL_SOURCES))).select(
        "company_slug", "source",
        F.col("fetched_at").alias("started_at"), F.col("fetched_at").alias("finished_at"),
        F.lit("failed").alias("status"), F.lit(None).cast("bigint").alias("item_count"),
        F.concat(F.lit("No reader for source "), F.col("source")).alias("error"),
    )
    runs = reduce(DataFrame.unionByName, [r for _, r in read] + [unknown])
    return postings, runs


__all__ = [
    "ALL_SOURCES", "BOARD_SOURCES", "DISCOVERY_SOURCES", "append_runs", "board_postings", "board_runs",
    "current_thread", "parse_boards", "project_raw", "read_source",
    "read_sources", "replay", "thread_boards",
]

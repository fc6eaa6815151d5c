"""Profile table: defaults of a new profile, and filling in what an older row lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYWORDS = "array<struct<keyword:string,weight:double>>"
SCHEMA = f"""profile_id bigint, resume string, description string, feedback_summary string,
  search struct<terms:array<string>,locations:array<string>,hours_old:int,results_per_site:int,
                require_language:string,allowed_regions:array<string>>,
  scoring struct<boost:{KEYWORDS},penalize:{KEYWORDS}>,
  notification struct<score_threshold:int,max_jobs_per_email:int,max_job_age_days:int,rerank_candidates:int,
                      rerank_min_score:double,timezone:string,email_subject:string,telegram_message:string>"""

# A new profile's settings. None for require_language and
# allowed_regions means that the filter is off, which an empty list is not.
DEFAULTS = {
    "resume": "", "description": "", "feedback_summary": "",
    "search": {"terms": [], "locations": ["Toronto, ON"], "hours_old": 24, "results_per_site": 25,
               "require_language": None, "allowed_regions": None},
    "scoring": {"boost": [], "penalize": []},
    "notification": {"score_threshold": 60, "max_jobs_per_email": 10, "max_job_age_days": 7, "rerank_candidates": 30,
                     "rerank_min_score": 0.3, "timezone": "America/Toronto",
                     "email_subject": "{count} new jobs today",
                     "telegram_message": "Found {count} jobs (top: {top_score})"},
}


def new_profiles(ids: DataFrame) -> DataFrame:
    """A default profile for each ``profile_id`` of ``ids``."""
    row = ids.sparkSession.createDataFrame([{"profile_id": None, **DEFAULTS}], SCHEMA).drop("profile_id")
    values = {f.name: F.lit(row.select(F.to_json(F.col(f.name)) if f.dataType.typeName() == "struct" else F.col(f.name)).first()[0])
              for f in row.schema.fields}
    return ids.select("profile_id", *[
        (F.from_json(values[f.name], f.dataType) if f.dataType.typeName() == "struct" else values[f.name]).alias(f.name)
        for f in row.schema.fields])


def with_defaults(profiles: DataFrame) -> DataFrame:
    """Every null setting takes its default; a null section takes all of its
    defaults. Lists that are empty stay empty, and null stays null where null
    itself is the default."""
    def filled(name, default):
        if isinstance(default, dict):
            kinds = dict(zip(profiles.schema[name].dataType.names, profiles.schema[name].dataType.fields))
            return F.struct(*[_or(F.col(f"{name}.{k}"), v, kinds[k].dataType).alias(k) for k, v in default.items()])
        return _or(F.col(name), default, profiles.schema[name].dataType)
    return profiles.select("profile_id", *[filled(k, v).alias(k) for k, v in DEFAULTS.items()])


def _or(value, default, kind):
    if default is None:
        return value
    items = F.array(*[F.lit(x) for x in default]) if isinstance(default, list) else F.lit(default)
    return F.coalesce(value, items.cast(kind))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.schema(SCHEMA).parquet(path))


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Parquet keeps null and empty lists apart."""
    profiles.write.mode("overwrite").parquet(path)

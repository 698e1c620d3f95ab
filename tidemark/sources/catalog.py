"""Landed JSON of source catalogs: tracks, chapters and configurations as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.languages import normalize

CATALOG = "struct<manual:array<struct<lang:string,tracks:array<struct<ext:string,url:string>>>>,auto:array<struct<lang:string,tracks:array<struct<ext:string,url:string>>>>,chapters:array<struct<title:string,start_time:double,end_time:double>>>"


def catalog(json: Column) -> Column:
    """The parts of a catalog that are used; entries are arrays because their order counts. No JSON gives nulls."""
    return F.from_json(json, CATALOG)


def track_languages(entries: Column) -> Column:
    """Languages of entries in order, in normal form, each once."""
    return F.array_distinct(F.transform(F.coalesce(entries, F.array().cast("array<struct<lang:string,tracks:array<struct<ext:string,url:string>>>>")), lambda e: normalize(e["lang"])))


def chapters(found: Column) -> Column:
    """Chapters with defaults: a title where none is given, 0 for the start."""
    return F.transform(found, lambda c: F.struct(F.coalesce(c["title"], F.lit("Untitled")).alias("title"), F.coalesce(c["start_time"], F.lit(0.0)).alias("start_s"), (c["end_time"] - c["start_time"]).alias("duration_s")))


def configured_targets(json: Column) -> Column:
    """Target languages of a configuration: the field's new name, else its old one, else Chinese; in normal form."""
    read = lambda name: F.from_json(F.get_json_object(json, f"$.{name}"), "array<string>")
    return F.transform(F.coalesce(read("subtitle_target_languages"), read("target_languages"), F.array(F.lit("zh-CN"))), normalize)

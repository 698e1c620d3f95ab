"""Configurations and provider profiles: JSON documents as columns, with their defaults and old field names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.languages import normalize
from tidemark.sources.catalog import configured_targets

#: Parts of an address that mean this machine (fixed values).
LOCAL = ("localhost", "127.0.0.1", "0.0.0.0", "[::1]")
#: Defaults of a language configuration and of a provider's (fixed values).
LANGUAGE_DEFAULTS = {"bilingual_mode": "none", "translation_strategy": "OFFICIAL_AUTO_THEN_AI", "subtitle_format": "srt"}
PROVIDER_DEFAULTS = {"enabled": True, "provider": "openai", "model": "gpt-4o-mini", "timeout_seconds": 30, "max_retries": 2, "max_concurrency": 5}


def is_local(base_url: Column) -> Column:
    """Whether an address means this machine; none does not."""
    low = F.lower(F.coalesce(base_url, F.lit("")))
    found = F.lit(False)
    for part in LOCAL:
        found = found | low.contains(part)
    return found


def language_config(json: Column) -> Column:
    """A language configuration with defaults: codes in normal form, targets under their new name before their old one."""
    field = lambda name: F.get_json_object(json, f"$.{name}")
    code = lambda name: normalize(F.coalesce(field(name), F.lit("zh-CN"))).alias(name)
    others = [F.coalesce(field(k), F.lit(v)).alias(k) for k, v in LANGUAGE_DEFAULTS.items()]
    return F.struct(code("ui_language"), configured_targets(json).alias("subtitle_target_languages"), code("summary_language"), *others, normalize(field("source_language")).alias("source_language"))


def config_json(config: Column) -> Column:
    """A configuration as JSON; of its fields only a missing source language is left out."""
    return F.to_json(config)


def provider_config(json: Column) -> Column:
    """A provider's configuration with defaults; an empty address is none, and one old variable stands for the keys of both providers."""
    field = lambda name: F.get_json_object(json, f"$.{name}")
    typed = lambda name, value: F.coalesce(field(name).try_cast("boolean" if isinstance(value, bool) else "int" if isinstance(value, int) else "string"), F.lit(value)).alias(name)
    keys, old = F.from_json(field("api_keys"), "map<string,string>"), F.concat(F.lit("env:"), field("api_key_env"))
    keys = F.when(keys.isNotNull() & (F.size(keys) > 0), keys).when(old.isNotNull(), F.create_map(F.lit("openai"), old, F.lit("anthropic"), old))
    return F.struct(*[typed(k, v) for k, v in PROVIDER_DEFAULTS.items()], F.nullif(field("base_url"), F.lit("")).alias("base_url"), keys.alias("api_keys"))


def profiles(documents: DataFrame, json: str = "json") -> DataFrame:
    """Profiles of documents (`json`, and other columns): name, enabled, config of each. A broken document has none."""
    others = [c for c in documents.columns if c != json]
    entries = F.from_json(F.get_json_object(json, "$.profiles"), "map<string,string>")
    rows = documents.select(*others, F.explode(entries).alias("name", "_config"))
    return rows.select(*others, "name", F.coalesce(F.get_json_object("_config", "$.enabled").try_cast("boolean"), F.lit(True)).alias("enabled"), provider_config(F.col("_config")).alias("config"))


def task_profiles(documents: DataFrame, json: str = "json") -> DataFrame:
    """task, name: which profile each task of a document takes."""
    others = [c for c in documents.columns if c != json]
    return documents.select(*others, F.explode(F.from_json(F.get_json_object(json, "$.task_mapping"), "map<string,string>")).alias("task", "name"))


def resolve(tasks: DataFrame, mapping: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """`tasks` (`keys`, task, fallback) with the model of their enabled profile, else their fallback (null where there is none)."""
    named = tasks.join(mapping, [*keys, "task"], "left")
    found = named.join(known.where("enabled").select(*keys, "name", F.col("config.model").alias("_model")), [*keys, "name"], "left")
    return found.select(*keys, "task", F.coalesce("_model", "fallback").alias("model"))


def formatted(template: Column, values: dict[str, Column]) -> Column:
    """A message with its {names} filled in; one that names anything else, or a value that is missing, comes back as it is."""
    if not values:
        return template
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    names = F.regexp_extract_all(template, F.lit(r"\{([^{}]*)\}"), F.lit(1))
    known = F.forall(names, lambda n: n.isin(*values))
    stray = F.regexp_replace(template, r"\{[^{}]*\}", "").rlike(r"[{}]")
    return F.when(known & ~stray & out.isNotNull(), out).otherwise(template)

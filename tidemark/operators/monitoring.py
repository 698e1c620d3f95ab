"""Proxies, queues, logs, health and records: predicates and counts for those who run a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels by severity, schemes of proxies, required fields of a failure record (fixed values).
LEVELS = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
SCHEMES = ("http", "https", "socks4", "socks5", "socks5h")
REQUIRED = ("video_id", "url", "stage", "error_type", "timestamp")
#: Classes of errors that records may carry, and the class of each provider error (fixed values).
ERROR_TYPES = ("network", "timeout", "rate_limit", "auth", "cookie_expired", "content", "file_io", "parse", "invalid_input", "cancelled", "external_service", "unknown")
PROVIDER_ERRORS = ("network", "auth", "rate_limit", "content")


def at_least(level: Column, least: str) -> Column:
    """Whether a level reaches a threshold; unknown levels do not."""
    rank = F.lit(0)
    for name, value in LEVELS.items():
        rank = F.when(F.upper(level) == name, value).otherwise(rank)
    return rank >= LEVELS[least]


def of_class(level: Column, wanted: str) -> Column:
    """Whether a level is the one asked for: WARN is WARNING, CRITICAL shows with ERROR. No threshold."""
    same = {"WARNING": ("WARN", "WARNING"), "WARN": ("WARN", "WARNING"), "ERROR": ("ERROR", "CRITICAL")}
    return F.lit(True) if wanted == "ALL" else F.upper(level).isin(*same.get(wanted, (wanted,)))


def valid_proxy(proxy: Column) -> Column:
    """A known scheme, a host, and a port from 1 to 65535 or none."""
    pattern = r"^([a-zA-Z0-9+.-]+)://(?:[^@/]*@)?([^:/@]+)(?::(\d+))?/?$"
    port = F.regexp_extract(proxy, pattern, 3)
    return proxy.rlike(pattern) & F.lower(F.regexp_extract(proxy, pattern, 1)).isin(*SCHEMES) & ((port == "") | port.try_cast("long").between(1, 65535))


def next_proxy(proxies: DataFrame, key: Sequence[str], now: Column, tries: DataFrame | None = None, cooldown_minutes: int = 10) -> DataFrame:
    """The proxy to use next per `key`: healthy ones first, then those whose cooldown is over, then healthy ones tried before, then the one
    that fails least. `proxies`: proxy, pos, unhealthy, failed_at, failures, requests; `tries`: a table of those tried before (proxy)."""
    tried = F.lit(False)
    if tries is not None:
        proxies = proxies.join(tries.select("proxy").distinct().withColumn("_tried", F.lit(True)), "proxy", "left")
        tried = F.col("_tried").isNotNull()
    over = F.col("unhealthy") & (F.col("failed_at") + F.make_dt_interval(mins=F.lit(cooldown_minutes)) <= now)
    tier = F.when(~F.col("unhealthy") & ~tried, 1).when(over & ~tried, 2).when(~F.col("unhealthy"), 3).otherwise(4)
    rate = F.when(F.col("requests") > 0, F.col("failures") / F.col("requests")).otherwise(-1.0)
    ranked = proxies.withColumn("tier", tier).withColumn("_rate", F.when(tier == 4, rate).otherwise(F.when(tier == 3, F.col("failures").cast("double")).otherwise(0.0)))
    return ranked.groupBy(*key).agg(F.min_by(F.struct("proxy", "tier"), F.struct("tier", "_rate", "pos")).alias("_b")).select(*key, "_b.proxy", "_b.tier")


def queue_stats(items: DataFrame, key: str) -> DataFrame:
    """processed, failed, total, pending, processing of each queue from items (`key`, state)."""
    n = lambda s: F.count_if(F.col("state") == s)
    by = items.groupBy(key).agg(n("processed").alias("processed"), n("failed").alias("failed"), F.count("*").alias("total"), n("pending").alias("pending"))
    return by.withColumn("processing", F.greatest(F.lit(0), F.col("total") - F.col("processed") - F.col("failed") - F.col("pending")))


def record_problems(line: Column) -> Column:
    """Required fields that a JSON line lacks or that are empty; one problem, `json`, where it is no object."""
    missing = F.filter(F.array(*[F.when(F.coalesce(F.get_json_object(line, f"$.{f}"), F.lit("")) == "", f) for f in REQUIRED]), lambda x: x.isNotNull())
    return F.when(F.try_parse_json(line).isNull() | ~F.trim(line).startswith("{"), F.array(F.lit("json"))).otherwise(missing)


def provider_error(kind: Column) -> Column:
    return F.when(kind.isin(*PROVIDER_ERRORS), kind).otherwise("unknown")


def compare_sources(a: DataFrame, b: DataFrame, key: str = "error_type") -> DataFrame:
    """Counts per class in two sources side by side, and whether the class is a known one."""
    left, right = a.groupBy(key).agg(F.count("*").alias("n_a")), b.groupBy(key).agg(F.count("*").alias("n_b"))
    both = left.join(right, key, "full")
    return both.select(key, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), F.col(key).isin(*ERROR_TYPES).alias("known"))


def log_line(level: Column, run: Column, task: Column, video: Column, message: Column) -> Column:
    """The line of a log event without its time: fields without a value are left out."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{name}:"), c, F.lit("]")))
    return F.concat_ws(" ", F.concat(F.lit("["), F.rpad(level, 5, " "), F.lit("]")), part("run", run), part("task", task), part("video", video), message)


def translated(keys: DataFrame, wanted: DataFrame, fallback: DataFrame) -> DataFrame:
    """Texts of keys: of the wanted language, else of the fallback, else the key itself. Tables are key, text."""
    a, b = wanted.select("key", F.col("text").alias("_a")), fallback.select("key", F.col("text").alias("_b"))
    return keys.join(a, "key", "left").join(b, "key", "left").withColumn("text", F.coalesce("_a", "_b", "key")).drop("_a", "_b")


def plural(singular: Column, several: Column, n: Column) -> Column:
    return F.when(n == 1, singular).otherwise(several)


def track_info(manual: Column, auto: Column) -> Column:
    """Both lists of languages in one line; an empty list is left out."""
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", ")))
    return F.concat_ws(" | ", part("manual", manual), part("auto", auto))


def best_proxy(requests: DataFrame, proxy: str, failed: Column) -> DataFrame:
    """best: the proxy with the least share of failed requests, the first on a tie."""
    rates = requests.groupBy(F.col(proxy).alias("_p")).agg((F.count_if(failed).cast("double") / F.count("*")).alias("_rate"))
    return rates.agg(F.min_by("_p", F.struct("_rate", "_p")).alias("best"))


#: States that a provider's health check finds (fixed values).
HEALTH = ("healthy", "slow", "unhealthy", "unconfigured")


def health(statuses: DataFrame, status: str = "status") -> DataFrame:
    """How many are in each state, zero included, and whether any is unhealthy, which ends a check with an error."""
    return statuses.agg(*[F.count_if(F.col(status) == s).alias(s) for s in HEALTH], F.bool_or(F.col(status) == "unhealthy").alias("any_unhealthy"))


def token_usage(calls: DataFrame, key: str) -> DataFrame:
    """Calls and tokens of each provider from calls (`key`, usage: prompt, completion)."""
    prompt, completion = F.col("usage.prompt"), F.col("usage.completion")
    return calls.groupBy(key).agg(F.count("*").alias("calls"), F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"), F.sum(prompt + completion).alias("total_tokens"))


def detection_counts(items: DataFrame, key: str, has: Column, long: Column) -> DataFrame:
    """How many items of each `key` have tracks and have none, and whether any is long."""
    has = F.coalesce(has, F.lit(False))
    return items.groupBy(key).agg(F.count_if(has).alias("has_tracks"), F.count_if(~has).alias("none"), F.bool_or(long).alias("any_long"))


def cookie_pairs(cookie: Column) -> Column:
    """Names and values of a cookie string as an array, in order; parts without a = have an empty value."""
    return F.transform(F.split(cookie, ";"), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_extract(p, "=(.*)$", 1)).alias("v")))


def cookie_value(pairs: Column, name: str) -> Column:
    """The value of a name; the last of equal ones counts."""
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"]


def cookie_region(pairs: Column) -> Column:
    """The region of a cookie: gl inside PREF, else GL or LOCALE, else the suffix of HL; in upper case."""
    named = lambda *names: F.try_element_at(F.filter(pairs, lambda p: F.upper(p["k"]).isin(*names) & (F.length(p["v"]) >= 2)), F.lit(1))["v"]
    pref = F.nullif(F.regexp_extract(F.coalesce(cookie_value(pairs, "PREF"), F.lit("")), r"(?:^|&)gl=([^&]+)", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract(F.coalesce(named("HL"), F.lit("")), r"[-_]([A-Za-z]{2})$", 1), F.lit(""))
    return F.upper(F.coalesce(pref, named("GL", "LOCALE"), suffix))

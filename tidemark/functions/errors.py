"""Errors: classes from messages, and what follows from a class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which words in a message mean which class, in the order they are tried (fixed values).
NETWORK = (
    "network", "connection", "dns", "timeout", "unreachable", "refused", "reset", "failed to connect", "connection error", "connection refused", "connection timeout", "connection reset",
    "unable to connect", "cannot connect", "connect failed", "failed to download", "unable to download", "download failed", "download error", "cannot download", "unable to fetch",
    "without a successful webpage download", "webpage download failed", "unable to download webpage", "failed to download webpage",
)
COOKIE_EXPIRED = ("sign in to confirm", "you're not a bot", "not a bot", "use --cookies", "cookies for the authentication", "login required")
AUTH = ("403", "401", "unauthorized", "authentication required")
CONTENT = ("404", "not found", "unavailable", "private", "deleted", "removed", "blocked", "region", "copyright")
#: Classes that a retry may help.
RETRYABLE = ("network", "timeout", "rate_limit", "external_service", "unknown")
#: Classes, by their upper-case names, after which a failed item is not taken up again.
FINAL = ("AUTH", "CONTENT", "INVALID_INPUT")


def message_of(stderr: Column) -> Column:
    """Lines that are neither blank nor warnings; the whole if none is left."""
    kept = F.array_join(F.filter(F.split(stderr, "\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith("WARNING:")), "\n")
    return F.when(kept == "", stderr).otherwise(kept)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    """One pattern for all words; none of them has a character that patterns treat specially."""
    return text.rlike("|".join(words))


def classify(stderr: Column, timed_out: Column) -> Column:
    """The class of a failed fetch; the first rule that holds decides."""

    def rules(low: Column) -> Column:
        rule = F.when(timed_out, "timeout").when(_any(low, NETWORK), "network")
        rule = rule.when(low.contains("authentication") & _any(low, ("webpage", "without a successful")), "network")
        rule = rule.when(stderr.contains("429") | _any(low, ("rate limit", "too many requests")), "rate_limit")
        rule = rule.when(_any(low, COOKIE_EXPIRED), "cookie_expired").when(_any(low, AUTH), "auth").when(_any(low, CONTENT), "content")
        return rule.when(low.contains("does not look like a netscape format") | (low.contains("cookie") & low.contains("format")), "auth").otherwise("external_service")

    return F.get(F.transform(F.array(F.lower(message_of(stderr))), rules), F.lit(0))  # the message is computed once


def should_retry(error_type: Column) -> Column:
    return error_type.isin(*RETRYABLE)


def is_resumable(stage: Column, error_type: Column, case_sensitive: bool = True) -> Column:
    """Not finished, and not failed for a reason that stays. With `case_sensitive`, a lower-case class counts as one that may pass."""
    kind = error_type if case_sensitive else F.upper(error_type)
    return ~stage.isin("done", "skipped") & ((stage != "failed") | kind.isNull() | ~kind.isin(*FINAL))

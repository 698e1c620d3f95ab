"""Source URLs: kind, ids and validity, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the sites' URLs (fixed values); the first two take an id, the third a name.
VIDEO_ID = r"(?:youtube\.com/watch\?v=|youtu\.be/)([a-zA-Z0-9_-]{11})"
PLAYLIST_ID = r"youtube\.com/playlist\?list=([a-zA-Z0-9_-]+)"
CHANNEL_ID = r"youtube\.com/(?:c/|user/|channel/|@)([^/?]+)"
DOMAIN = r"(?i)youtube\.com|youtu\.be"


def _first(url: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def url_type(url: Column) -> Column:
    """video, playlist, channel or unknown; the first that matches."""
    u = F.lower(url)
    channel = u.contains("/c/") | u.contains("/user/") | u.contains("/channel/") | u.contains("/@")
    return F.when(u.contains("watch?v=") | u.contains("youtu.be/"), "video").when(u.contains("playlist?list="), "playlist").when(channel, "channel").otherwise("unknown")


def video_id(url: Column) -> Column:
    return _first(url, VIDEO_ID)


def playlist_id(url: Column) -> Column:
    return _first(url, PLAYLIST_ID)


def channel_id(url: Column) -> Column:
    return _first(url, CHANNEL_ID)


def is_site_domain(url: Column) -> Column:
    """An unanchored search for the site's names, not a comparison of hosts."""
    return url.rlike(DOMAIN)


def validation_code(url: Column) -> Column:
    """blank, invalid_domain, invalid_format or ok. Blank is valid."""
    u = F.trim(url)
    known = u.rlike(VIDEO_ID) | u.rlike(PLAYLIST_ID) | u.rlike(CHANNEL_ID)
    return F.when(u == "", "blank").when(~is_site_domain(u), "invalid_domain").when(~known, "invalid_format").otherwise("ok")


def bad_lines(text: Column) -> Column:
    """Numbers, from 1, of the lines of a text that are no valid URL; blank lines are skipped."""
    checked = F.transform(F.split(text, "\n"), lambda x, i: F.when(~validation_code(x).isin("blank", "ok"), i + 1))
    return F.filter(checked, lambda n: n.isNotNull())


def archive_key(url: Column, first_channel_id: Column) -> Column:
    """Which archive a scan of this URL reads: a channel's, a playlist's, or none for one video."""
    kind = url_type(url)
    return F.when(kind == "channel", F.concat(first_channel_id, F.lit(".txt"))).when((kind == "playlist") & playlist_id(url).isNotNull(), F.concat(F.lit("playlist_"), playlist_id(url), F.lit(".txt")))

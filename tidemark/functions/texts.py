"""Times, names, masks, versions, prompts and messages as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.languages import display_name, name_to_code


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm"""
    ms = ms.cast("long")
    part = lambda by, wrap: (F.floor(ms / by) % wrap if wrap else F.floor(ms / by)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", part(3600000, 0), part(60000, 60), part(1000, 60), ms % 1000)


def srt_time_of_seconds(seconds: Column) -> Column:
    """HH:MM:SS,mmm of seconds with a fraction: cut to whole milliseconds, from decimals, so 2.3 gives 300 of them."""
    return srt_time(F.floor(seconds.cast("decimal(18,6)") * 1000))


def time_ms(text: Column) -> Column:
    """Milliseconds of HH:MM:SS,mmm or HH:MM:SS.mmm."""
    g = lambda i: F.regexp_extract(text, r"^(\d+):(\d+):(\d+)[,.](\d{3})$", i).try_cast("long")
    return g(1) * 3600000 + g(2) * 60000 + g(3) * 1000 + g(4)


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.floor(seconds).cast("long")
    m, h = F.floor(s / 60) % 60, F.floor(s / 3600)
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))


def duration(seconds: Column) -> Column:
    """45s, 3m 5s or 2h 10m."""
    s = F.floor(seconds).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def safe_filename(name: Column) -> Column:
    """Without characters that file systems refuse, blanks and dots around it, or more than 200 characters."""
    return F.left(F.btrim(F.translate(name, '<>:"/\\|?*', "_________"), F.lit(" .")), F.lit(200))


def output_dir(channel_name: Column, channel_id: Column, video_id: Column, title: Column) -> Column:
    """`<channel> [<id>]/<video>  <title>`; the channel's level only where both its fields are given."""
    video = F.concat(video_id, F.lit("  "), safe_filename(title))
    given = (F.coalesce(channel_name, F.lit("")) != "") & (F.coalesce(channel_id, F.lit("")) != "")
    return F.when(given, F.concat(safe_filename(channel_name), F.lit(" ["), channel_id, F.lit("]/"), video)).otherwise(video)


#: URL parameters whose values are masked (fixed values).
SECRET_PARAMETERS = ("token", "key", "secret", "apikey", "api_key", "access_token", "auth", "password", "pwd")


#: What is masked, in this order, and what stands in its place (fixed rules). Conditions on lengths are bands of the patterns; a run of
#: a class is taken whole because its pattern is greedy.
MASKS = (
    (r"(sk-[a-zA-Z0-9])[a-zA-Z0-9]{15,}([a-zA-Z0-9]{4})", "$1***$2"),
    (r"\b([a-zA-Z0-9]{4})[a-zA-Z0-9]{24,}([a-zA-Z0-9]{4})\b", "$1***$2"),
    # the first value of a cookie header: nine characters or more keep four at both ends, fewer keep none
    (r"(?i)(Cookie:\s*[^;\n=]*=[^;\n]{4})[^;\n]+([^;\n]{3}[^;\s])[^\S\n]*", "$1***$2"),
    (r"(?i)(Cookie:\s*[^;\n=]*=)[^;\n]{0,7}[^;\s][^\S\n]*(;|\n|$)", "$1***REDACTED***$2"),
    (r"(?i)(cookie\s*=\s*[^;\s&]{4})[^;\s&]+([^;\s&]{4})", "$1***$2"),
    (r"(?i)(Authorization:\s*[^\s]{4})[^\s]+([^\s]{4})", "$1***$2"),
    (r"(?i)Bearer\s+([a-zA-Z0-9\-_.])", "Bearer $1"),
    (r"(Bearer [a-zA-Z0-9\-_.]{4})[a-zA-Z0-9\-_.]+([a-zA-Z0-9\-_.]{4})", "$1***$2"),
    (r"(?i)Basic\s+([A-Za-z0-9+/=]{4})[A-Za-z0-9+/=]{12,}([A-Za-z0-9+/=]{4})", "Basic $1***$2"),
    (rf"(?i)([?&](?:{'|'.join(SECRET_PARAMETERS)})=[^&\s]{{2}})[^&\s]{{5,}}([^&\s]{{2}})", "$1***$2"),
    (r"(?i)(password|pwd)\s*=\s*[^\s&]+", "$1=***REDACTED***"),
    (r"://([^:]+):([^@]+)@", "://$1:***REDACTED***@"),
)


#: What every text has that a rule of `MASKS` matches: a word one of them begins with, an equals sign, an address with an at sign, or a long run.
MASKED = r"(?i)sk-|cookie|authorization|bearer|basic|=|://[^@]*@|[a-z0-9]{32}"


def mask_secrets(message: Column, longest: int = 500) -> Column:
    """Masks keys, headers, parameters and passwords by `MASKS`, and cuts what is longer than `longest`. A masked message is computed once.

    Messages that no rule can match (`MASKED`) are not searched rule by rule.
    """
    m = message
    for pattern, by in MASKS:
        m = F.regexp_replace(m, pattern, by)
    m = F.when(message.rlike(MASKED), m).otherwise(message)
    cut = lambda x: F.when(F.length(x) > longest, F.concat(F.left(x, F.lit(longest)), F.lit("... [truncated]"))).otherwise(x)
    return F.get(F.transform(F.array(m), cut), F.lit(0))


def version(text: Column) -> Column:
    """The numbers of v1.2.3, or 0, 0, 0 for anything else. Arrays compare part by part, and a shorter one is smaller."""
    numbers = F.transform(F.split(F.regexp_replace(text, "^v+", ""), r"\."), lambda x: x.try_cast("int"))
    return F.when(F.exists(numbers, lambda x: x.isNull()), F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(numbers)


def suggested_length(content_length: Column) -> Column:
    """The least and most words of a summary."""
    pair = lambda a, b: F.struct(F.lit(a).alias("min_words"), F.lit(b).alias("max_words"))
    return F.when(content_length >= 30000, pair(2000, 5000)).when(content_length >= 5001, pair(1500, 4000)).when(content_length == 5000, pair(800, 1500)).when(content_length >= 3000, pair(500, 1000)).otherwise(pair(300, 800))


def summary_route(length: Column) -> Column:
    """direct up to 15000 characters, map_reduce beyond."""
    return F.when(length > 15000, "map_reduce").otherwise("direct")


#: The line behind which a prompt holds what it is about.
MARKER = "Subtitles:\n"


def translation_prompt(source: Column, target: Column, text: Column) -> Column:
    """A prompt that names both languages, tells the two Chinese scripts apart, and holds the cues behind a marker."""
    low = F.lower(target)
    name = F.when(low.isin("zh-cn", "zh_cn", "zh"), "简体中文").when(low.isin("zh-tw", "zh_tw", "zh-hant"), "繁体中文").otherwise(display_name(target))
    return F.concat(F.lit("Translate the subtitles from "), display_name(source), F.lit(" to "), name, F.lit(". Keep numbers and times.\n" + MARKER), text)


def _titled(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("Title: "), title, F.lit("\n"))).otherwise("")


def _words(length: Column) -> Column:
    return F.concat(suggested_length(length)["min_words"].cast("string"), F.lit("-"), suggested_length(length)["max_words"].cast("string"))


def summary_prompt(language: Column, text: Column, title: Column) -> Column:
    """A prompt for a summary of as many words as the text's length suggests."""
    return F.concat(F.lit("Summarise the subtitles in "), display_name(language), F.lit(", in "), _words(F.length(text)), F.lit(" words, as Markdown, complete first of all.\n"), _titled(title), F.lit(MARKER), text)


def part_prompt(language: Column, text: Column, number: Column, total: Column) -> Column:
    """A prompt for the summary of part `number` (from 1) of `total`."""
    return F.concat(F.lit("Summarise part "), number.cast("string"), F.lit("/"), total.cast("string"), F.lit(" of the subtitles in "), display_name(language), F.lit(", in 200-500 words, without a heading.\n" + MARKER), text)


def merge_prompt(language: Column, summaries: Column, title: Column, length: Column) -> Column:
    """A prompt that makes one summary of the parts' summaries, of as many words as the whole text's length suggests."""
    return F.concat(F.lit("Merge the summaries of all parts in "), display_name(language), F.lit(", in "), _words(length), F.lit(" words, as Markdown, complete first of all.\n"), _titled(title), F.lit(MARKER), summaries)


def prompt_text(prompt: Column) -> Column:
    """What stands behind a prompt's marker, or null without one."""
    return F.when(prompt.contains(MARKER), F.trim(F.substring_index(prompt, MARKER, -1)))


def prompt_languages(prompt: Column) -> Column:
    """The codes of the languages that a translation prompt names."""
    found = lambda i: name_to_code(F.nullif(F.regexp_extract(prompt, r"from ([^ ]+) to ([^ .]+)", i), F.lit("")))
    return F.struct(found(1).alias("source"), found(2).alias("target"))

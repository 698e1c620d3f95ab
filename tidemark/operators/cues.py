"""Timed text: formats, parsers and renderers over a column that holds a whole file.

A cue array has elements (index, start, end, text). Three parsers exist because their users differ on what counts as a cue:
`parse_for_merge` takes comma or point before the milliseconds and drops empty texts, `parse_for_output` takes commas only and
keeps them, `parse_for_chunks` cleans web cues of tags and entities.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.texts import srt_time

_TIME = r"\d{2}:\d{2}:\d{2}"
_CUE = "array<struct<index:int,start:string,end:string,text:string>>"


def detect_format(content: Column) -> Column:
    """vtt, json3, srv3, srt or null."""
    c = F.btrim(content, F.lit(" \t\n\r"))
    lines = F.split(c, "\n")
    srt = F.trim(F.get(lines, F.lit(0))).rlike(r"^\d+$") & F.coalesce(F.get(lines, F.lit(1)), F.lit("")).contains(" --> ")
    json3 = c.startswith("{") & F.get_json_object(c, "$.events").isNotNull()
    return F.when(c.startswith("WEBVTT"), "vtt").when(json3, "json3").when(c.startswith("<?xml") | c.contains("<transcript>") | c.contains("<p t="), "srv3").when(srt, "srt")


def _blocks(content: Column) -> Column:
    """Parts between blank lines."""
    return F.split(content, r"\n[ \t\r]*\n+")


def _from_block(block: Column, mark: str) -> Column:
    """The cue of a block: a number, a line with times, and text; null if it has no such lines."""
    pattern = rf"(?s)^\s*(\d+)\s*\n({_TIME}{mark}\d{{3}})\s*-->\s*({_TIME}{mark}\d{{3}})\s*(?:\n(.*))?$"
    g = lambda i: F.regexp_extract(block, pattern, i)
    cue = F.struct(g(1).try_cast("int").alias("index"), g(2).alias("start"), g(3).alias("end"), F.btrim(g(4), F.lit(" \t\n\r")).alias("text"))
    return F.when(block.rlike(pattern), cue)


def parse_for_merge(content: Column) -> Column:
    """Cues with text, as an array in the file's order."""
    found = F.transform(_blocks(content), lambda b: _from_block(b, "[,.]"))
    return F.filter(found, lambda c: c.isNotNull() & (c["text"] != "")).cast(_CUE)


def parse_for_output(content: Column) -> Column:
    """Cues with comma milliseconds; empty texts stay."""
    return F.filter(F.transform(_blocks(content), lambda b: _from_block(b, ",")), lambda c: c.isNotNull()).cast(_CUE)


def parse_for_chunks(content: Column) -> Column:
    """Cues of a web file with tags removed and four entities decoded; times stay as they are. Numbered anew."""
    block = F.filter(_blocks(F.regexp_replace(content, r"^\s*WEBVTT[^\n]*\n", "\n")), lambda b: b.contains("-->"))

    def cue(b: Column, i: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(b, r"(?s)^.*?-->[^\n]*\n?", ""), "<[^>]+>", "")
        for entity, char in (("&gt;", ">"), ("&lt;", "<"), ("&nbsp;", " "), ("&amp;", "&")):
            clean = F.replace(clean, F.lit(entity), F.lit(char))
        times = lambda k: F.regexp_extract(b, rf"({_TIME}[,.]\d{{3}})\s*-->\s*({_TIME}[,.]\d{{3}})", k)
        return F.struct((i + 1).cast("int").alias("index"), times(1).alias("start"), times(2).alias("end"), F.btrim(clean, F.lit(" \t\n\r")).alias("text"))

    return F.filter(F.transform(block, cue), lambda c: c["text"] != "").cast(_CUE)


def entry(index: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(index.cast("string"), F.lit("\n"), start, F.lit(" --> "), end, F.lit("\n"), text, F.lit("\n"))


def render(cues: Column) -> Column:
    """Cues as a file, with the numbers they have."""
    return F.array_join(F.transform(cues, lambda c: entry(c["index"], c["start"], c["end"], c["text"])), "\n")


def render_blocks(blocks: Column) -> Column:
    """Blocks (start_ms, end_ms, text), in order, as a file numbered from 1, with their own times."""
    return F.array_join(F.transform(blocks, lambda b, i: entry(i + 1, srt_time(b["start_ms"]), srt_time(b["end_ms"]), b["text"])), "\n")


def is_complete(original: Column, translated: Column) -> Column:
    """Whether a translation has as many cues as its original."""
    return F.regexp_count(original, F.lit("-->")) == F.regexp_count(translated, F.lit("-->"))


def renumbered(cues: Column) -> Column:
    return F.transform(cues, lambda c, i: F.struct((i + 1).cast("int").alias("index"), c["start"].alias("start"), c["end"].alias("end"), c["text"].alias("text")))


def to_text(cues: Column) -> Column:
    """Texts apart by blank lines; empty ones left out."""
    return F.array_join(F.filter(F.transform(cues, lambda c: F.btrim(c["text"], F.lit(" \t\n\r"))), lambda t: t != ""), "\n\n")


def plain_text(content: Column) -> Column:
    """A file's text lines joined by spaces: no numbers, no times."""
    lines = F.transform(F.split(content, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~x.contains("-->")), " ")


def vtt_to_srt(content: Column) -> Column:
    """Without header, notes and settings, with comma milliseconds and new numbers."""
    block = F.filter(_blocks(F.btrim(content, F.lit(" \t\n\r"))), lambda b: b.contains(" --> ") & ~F.ltrim(b).startswith("NOTE"))

    def cue(b: Column, i: Column) -> Column:
        line = F.regexp_replace(F.regexp_extract(b, r"([^\n]* --> [^\n]*)", 1), rf"({_TIME})\.(\d{{3}})", "$1,$2")
        times = F.trim(F.regexp_replace(line, r" (align|position|line|size):[^\s]+", ""))
        text = F.array_join(F.filter(F.transform(F.split(F.regexp_replace(b, r"(?s)^.*?-->[^\n]*\n?", ""), "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
        return F.concat((i + 1).cast("string"), F.lit("\n"), times, F.lit("\n"), F.when(text != "", F.concat(text, F.lit("\n"))).otherwise(""))

    return F.array_join(F.transform(block, cue), "\n")


def _numbered(parts: Column) -> Column:
    """Parts (s, e, t) with text as a file."""
    kept = F.filter(F.transform(parts, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.btrim(p["t"], F.lit(" \t\n\r")).alias("t"))), lambda p: p["t"] != "")
    return F.array_join(F.transform(kept, lambda p, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(p["s"]), F.lit(" --> "), srt_time(p["e"]), F.lit("\n"), p["t"], F.lit("\n"))), "\n")


def json3_to_srt(content: Column) -> Column:
    """Events with segments; events without text take no number. What is no such JSON comes back as it is."""
    schema = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"
    events = F.from_json(content, schema)["events"]
    parts = F.transform(F.filter(events, lambda e: e["segs"].isNotNull()), lambda e: F.struct(
        F.coalesce(e["tStartMs"], F.lit(0).cast("long")).alias("s"),
        (F.coalesce(e["tStartMs"], F.lit(0).cast("long")) + F.coalesce(e["dDurationMs"], F.lit(0).cast("long"))).alias("e"),
        F.array_join(F.transform(e["segs"], lambda g: F.coalesce(g["utf8"], F.lit(""))), "").alias("t"),
    ))
    return F.when(F.get_json_object(content, "$.events").isNull(), content).otherwise(_numbered(parts))


def srv3_to_srt(content: Column) -> Column:
    """Paragraphs with t before d and no tags inside; five named entities and #39 are decoded. Without any, the input."""
    pattern = r'<p[^>]*t="(\d+)"[^>]*d="(\d+)"[^>]*>([^<]*)</p>'
    g = lambda i: F.regexp_extract_all(content, F.lit(pattern), F.lit(i))

    def decoded(t: Column) -> Column:
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    parts = F.transform(F.arrays_zip(g(1).alias("s"), g(2).alias("d"), g(3).alias("t")), lambda p: F.struct(p["s"].cast("long").alias("s"), (p["s"].cast("long") + p["d"].cast("long")).alias("e"), decoded(p["t"]).alias("t")))
    out = _numbered(parts)
    return F.when(out == "", content).otherwise(out)


def to_srt(content: Column) -> Column:
    """Whatever format is found, as SRT; unknown formats come back as they are."""
    kind = detect_format(content)
    return F.when(kind == "vtt", vtt_to_srt(content)).when(kind == "json3", json3_to_srt(content)).when(kind == "srv3", srv3_to_srt(content)).otherwise(content)


def is_valid(content: Column) -> Column:
    """Not blank, with at least one numbered line of times."""
    return (F.trim(content) != "") & content.rlike(rf"\d+\s*\n{_TIME}[,.]\d{{3}}\s*-->")

"""Language codes as columns: normal forms, names, and the matching rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of languages in their own writing, in the order they are tried (fixed values).
NAMES = {
    "zh-CN": "中文", "zh-TW": "繁體中文", "en-US": "English", "en-GB": "English", "ja-JP": "日本語", "ko-KR": "한국어", "es-ES": "Español", "fr-FR": "Français",
    "de-DE": "Deutsch", "ru-RU": "Русский", "ar": "العربية", "ar-SA": "العربية", "pt-PT": "Português", "pt-BR": "Português", "it-IT": "Italiano", "hi-IN": "हिन्दी",
}


def primary(code: Column) -> Column:
    """The part before - or _, in lower case."""
    return F.lower(F.substring_index(F.substring_index(code, "-", 1), "_", 1))


def normalize(code: Column) -> Column:
    """zh-CN and zh-TW in that spelling, everything else as its primary part."""
    low = F.lower(code)
    return F.when(low.isin("zh-cn", "zh_cn"), "zh-CN").when(low.isin("zh-tw", "zh_tw"), "zh-TW").otherwise(primary(code))


def matches(a: Column, b: Column) -> Column:
    """Equal, or of one primary language, but mainland and Taiwan Chinese do not match. Not transitive."""
    x, y = F.replace(F.lower(a), F.lit("_"), F.lit("-")), F.replace(F.lower(b), F.lit("_"), F.lit("-"))
    apart = ((x == "zh-cn") & (y == "zh-tw")) | ((x == "zh-tw") & (y == "zh-cn"))
    return (a == b) | (~apart & (primary(a) == primary(b)))


def first_match(target: Column, available: Column) -> Column:
    """The first code of an array that matches, or null."""
    return F.get(F.filter(available, lambda x: matches(x, target)), F.lit(0))


def is_chinese(code: Column) -> Column:
    low = F.lower(code)
    return low.startswith("zh") | low.isin("cmn", "yue")


def display_name(code: Column) -> Column:
    """The name of a code, else that of the first listed code that starts with the part before its hyphen, else the code."""
    main = F.substring_index(code, "-", 1)
    exact, prefix = None, None
    for key, name in NAMES.items():
        exact = F.when(code == key, name) if exact is None else exact.when(code == key, name)
        prefix = F.when(F.lit(key).startswith(main), name) if prefix is None else prefix.when(F.lit(key).startswith(main), name)
    return F.coalesce(exact, prefix, code)


#: Codes of languages by the names that prompts call them (fixed values).
CODES = {
    "中文": "zh-CN", "简体中文": "zh-CN", "繁體中文": "zh-TW", "繁体中文": "zh-TW", "English": "en-US", "英语": "en", "英文": "en", "日本語": "ja-JP", "日语": "ja", "日文": "ja",
    "한국어": "ko-KR", "韩语": "ko", "韩文": "ko", "Español": "es-ES", "西班牙语": "es", "Français": "fr-FR", "法语": "fr", "Deutsch": "de-DE", "德语": "de", "Русский": "ru-RU",
    "俄语": "ru", "Português": "pt-PT", "葡萄牙语": "pt", "Italiano": "it-IT", "意大利语": "it", "العربية": "ar", "阿拉伯语": "ar", "हिन्दी": "hi-IN", "印地语": "hi",
}


def name_to_code(name: Column) -> Column:
    """The code of a language's name; what is no known name, as a code is, comes back as it is."""
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.get(F.transform(F.array(name), lambda n: F.coalesce(F.try_element_at(codes, n), n)), F.lit(0))


def normalize_chinese(code: Column, content: Column) -> Column:
    """zh-Hans and zh-Hant by name, zh by the content's script (mainland if that is unclear); other codes stay."""
    low, variant = F.lower(code), chinese_variant(F.coalesce(content, F.lit("")))
    return F.when(low == "zh-hans", "zh-CN").when(low == "zh-hant", "zh-TW").when(low == "zh", F.when(variant == "zh", "zh-CN").otherwise(variant)).otherwise(code)


def provider_code(code: Column) -> Column:
    """The code a machine translator takes: one of two for Chinese, else the part before the hyphen in lower case."""
    low = F.lower(code)
    main = F.substring_index(low, "-", 1)
    return F.when(main == "zh", F.when(low.isin("zh-tw", "zh_tw", "zh-hant"), "zh-TW").otherwise("zh-CN")).otherwise(main)


def from_filename(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)\.([a-z]{2}(?:-[A-Z]{2})?)\.(?:srt|md)$", 1), F.lit(""))


#: Characters that only simplified, or only traditional, Chinese writes (fixed values).
SIMPLIFIED = "这个国为对时会着没来过样还说让给动东头长马乐业开门后进问选风云电话语车书买卖读写处办认识虽声听视观级织纸终线练经显现导层届发单双亲专转"
TRADITIONAL = "這個國為對時會著沒來過樣還說讓給動東頭長馬樂業開門後進問選風雲電話語車書買賣讀寫處辦認識雖聲聽視觀級織紙終線練經顯現導層屆發單雙親專轉"


def chinese_variant(text: Column, least: int = 10) -> Column:
    """zh-CN or zh-TW by the share of characters of one script, zh where too few of them occur."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    s, t = count(SIMPLIFIED), count(TRADITIONAL)
    share = s.cast("double") / (s + t)
    return F.when(s + t < least, "zh").when(share > 0.7, "zh-CN").when(share < 0.3, "zh-TW").otherwise("zh")


def count_range(text: Column, first: str, last: str) -> Column:
    """How many characters lie between two."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{first}-{last}]", ""))


def has_arabic(text: Column) -> Column:
    """Whether one of the first five text lines, of the first 51 lines, has an Arabic letter."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 51), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^\d+$") & ~x.contains("-->"))
    return F.exists(F.slice(lines, 1, 5), lambda x: x.rlike("[؀-ۿ]"))

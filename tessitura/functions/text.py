"""Text as column expressions: folding, keys, widths, markup, identifiers.

Unicode compatibility forms have no SQL function; `nfkc` and `nfkd` are Arrow-batched pandas UDFs, and `words`
skips them for plain ASCII.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Punctuation that keys drop. Deduplication and matching keep different sets.
DEDUPE_PUNCTUATION = r"""[\s\-_·,，.。'’"“”!！?？()（）\[\]【】~～/／]"""
MATCH_PUNCTUATION = r"""[\s\-_·,，.。'’"“”!！?？()（）\[\]【】]"""
#: Han ranges of search, and characters two columns wide.
SEARCH_HAN = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}]"
WIDE = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}]"
_EDGE = r"^[\s\x{3000}\x{00a0}]+|[\s\x{3000}\x{00a0}]+$"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def casefolded(s: pd.Series) -> pd.Series:
    """Full case folding; distinct values of a batch are folded once."""
    return s.map({v: v.casefold() for v in s.dropna().unique()}).astype(object).where(s.notna(), None)


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def fold(value: str) -> str:
    """Compatibility form in lower case without marks; sharp and final s as plain ones."""
    text = unicodedata.normalize("NFKC", value).lower().replace("ß", "ss").replace("ς", "σ")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c)[0] != "M")


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else fold(v))


def words(value: Column, table: Mapping[str, str] | None = None) -> Column:
    """Letters and numbers of a folded text, runs of all else as one blank.

    Compatibility forms, case, sharp and final s, marks and, with `table`, single characters fold. Null is empty.
    """
    text = F.coalesce(value, F.lit(""))
    folded = F.when(is_ascii(text), F.lower(text)).otherwise(_folded(text))
    folded = translated(folded, table)
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def translated(text: Column, table: Mapping[str, str] | None) -> Column:
    """A dictionary join for each character; the table is two literals."""
    if not table:
        return text
    return F.translate(text, "".join(table), "".join(table.values()))


def normalize(value: Column, table: Mapping[str, str] | None = None) -> Column:
    return F.replace(words(value, table), F.lit(" "), F.lit(""))


def dedupe_key(value: Column, table: Mapping[str, str] | None = None) -> Column:
    """Trimmed, lower case, simplified, without listed punctuation; what brackets hold stays."""
    return F.regexp_replace(translated(F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), _EDGE, "")), table), DEDUPE_PUNCTUATION, "")


def match_key(value: Column, table: Mapping[str, str] | None = None) -> Column:
    """As dedupe_key, with the smaller punctuation set of lyric matching."""
    return F.lower(F.regexp_replace(translated(F.regexp_replace(F.coalesce(value, F.lit("")), _EDGE, ""), table), MATCH_PUNCTUATION, ""))


def artist_key(value: Column, table: Mapping[str, str] | None = None) -> Column:
    """Compatibility form, lower case, single blanks; punctuation and accents stay."""
    return F.trim(F.regexp_replace(translated(F.lower(nfkc(F.coalesce(value, F.lit("")))), table), r"\s+", " "))


def is_han(char: Column) -> Column:
    return char.rlike(f"^{SEARCH_HAN}$")


def query_terms(value: Column, table: Mapping[str, str] | None = None) -> Column:
    """Struct of the folded query without blanks and its distinct terms; a change between Han and Latin parts terms."""
    text = words(value, table)
    broken = F.regexp_replace(text, rf"({SEARCH_HAN})(?=[a-z0-9])|([a-z0-9])(?={SEARCH_HAN})", "$1$2 ")
    terms = F.array_distinct(F.array_remove(F.split(broken, " "), ""))
    return F.struct(F.replace(text, F.lit(" "), F.lit("")).alias("text"), terms.alias("terms"))


def parse_query(value: str | None, table: Mapping[str, str] | None = None) -> tuple[str, list[str]]:
    """As `query_terms`, for one query on the driver."""
    text = "".join((table or {}).get(c, c) for c in fold(value or ""))
    words_ = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text).split()
    han = "\u3400-\u9fff\uf900-\ufaff\U00020000-\U000323af"
    broken = re.sub(f"(?<=[{han}])(?=[a-z0-9])|(?<=[a-z0-9])(?=[{han}])", " ", " ".join(words_))
    return "".join(words_), list(dict.fromkeys(broken.split()))


def display_width(text: Column) -> Column:
    """Columns on screen: wide characters take two."""
    text = F.coalesce(text, F.lit(""))
    return F.length(text) + F.regexp_count(text, F.lit(WIDE))


def clean_cue(text: Column) -> Column:
    """A subtitle cue without tags, entities and runs of white space."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", ""), r"&[a-z]+;", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_title(html: Column) -> Column:
    """Text of the title element, empty if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def detect_language(text: Column) -> Column:
    """By script: Japanese, Korean, Chinese, else English."""
    return F.when(text.rlike(r"[\x{3040}-\x{30ff}]"), "ja").when(text.rlike(r"[\x{ac00}-\x{d7a3}]"), "ko").when(text.rlike(r"[\x{4e00}-\x{9fff}]"), "zh").otherwise("en")


def tokens(text: Column) -> Column:
    """Words of spaced ASCII, else single characters without white space."""
    text = F.trim(F.coalesce(text, F.lit("")))
    core = F.replace(text, F.lit(" "), F.lit(""))
    spaced = text.contains(" ") & (F.length(core) == F.octet_length(core))
    each = F.filter(F.split(text, ""), lambda c: ~c.rlike(r"^\s?$"))
    return F.when(spaced, F.array_remove(F.split(text, r"\s+"), "")).otherwise(each)


def video_id(url: Column) -> Column:
    """The video id of a URL: the eleven characters after one of the forms that name one, null if there is none."""
    return _found(url, r"(?:v=|/shorts/|youtu\.be/|/embed/|/v/|/live/)([0-9A-Za-z_-]{11})")


def playlist_id(url: Column) -> Column:
    return _found(url, r"[?&]list=([A-Za-z0-9_-]+)")


def name_id(path: Column) -> Column:
    """A video id in brackets before the extension of a file name."""
    return _found(path, r"\[([A-Za-z0-9_-]{11})\]\.[A-Za-z0-9]+$")


def archived_id(path: Column) -> Column:
    """The id in brackets, of six characters or more, that ends a file's name before its extension; null if there is none."""
    name = F.substring_index(F.coalesce(path, F.lit("")), "/", -1)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
    return _found(stem, r"(?U)\s*\[([A-Za-z0-9_-]{6,})\]\s*$")


def url_path_id(url: Column) -> Column:
    """The number that ends a URL's path."""
    return _found(url, r"/(\d+)(?:[?#]|$)")


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit(""))


def is_dynamic_playlist(ident: Column) -> Column:
    """Mixes and personal lists change with each visitor."""
    return F.coalesce(ident.rlike("^(RD|UL|LL|WL)"), F.lit(False))


def video_url(ident: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), ident)


def playlist_url(ident: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/playlist?list="), ident)


def safe_name(text: Column, limit: int = 120) -> Column:
    """A file name without reserved or control characters, of at most `limit` characters; empty if nothing is left."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r'[/\\:*?"<>|\x00-\x1f]', " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")
    return F.left(bare, F.lit(limit))


def trimmed(text: Column) -> Column:
    """Without white space of any script at the ends; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def canonical_name(artist: Column, track: Column, ident: Column, suffix: Column | None = None) -> Column:
    """`artist - track [id]` and the suffix, artist and id only if they are there; null without a track."""
    artist, track = trimmed(artist), trimmed(track)
    base = F.when(artist == "", track).otherwise(F.concat(artist, F.lit(" - "), track))
    tail = F.when(F.coalesce(ident, F.lit("")) == "", "").otherwise(F.concat(F.lit(" ["), ident, F.lit("]")))
    return F.when(track != "", F.concat(safe_name(base), tail, F.coalesce(suffix, F.lit("")) if suffix is not None else F.lit("")))


#: Signs of a crash that may pass when tried again: exits by a signal, the C++ runtime, no output.
TRANSIENT = r"(?iU)退出码 -\d+|libc\+\+abi|std::__1::system_error|recursive_mutex|Segmentation fault|produced no output files|Bus error|Resource temporarily unavailable"
#: Words in a listing's error and its kind, the first that fits.
LISTING_ERRORS = [
    (("does not exist", "not found", "404"), "not found"),
    (("private",), "private"),
    (("sign in", "login", "cookies", "bot"), "login required"),
    (("unavailable",), "unavailable"),
]


def is_transient(message: Column) -> Column:
    return F.coalesce(message.rlike(TRANSIENT), F.lit(False))


def friendly_error(message: Column) -> Column:
    """Kind of a listing's error, else `failed: ` and the first 200 letters of the message."""
    raw = F.coalesce(message, F.lit(""))
    case = F.when(F.lit(False), F.lit(""))
    for signs, kind in LISTING_ERRORS:
        case = case.when(F.lower(raw).rlike("|".join(signs)), kind)
    return case.otherwise(F.concat(F.lit("failed: "), F.left(raw, F.lit(200))))


def origin(url: Column) -> Column:
    """Scheme, host and port of an http(s) origin in lower case without the default port; null if it is none."""
    low = F.lower(F.trim(url))
    ok = low.rlike(r"^https?://[^/?#@\s]+/?$")
    bare = F.regexp_replace(low, r"/$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^(http://[^:]+):80$", "$1"), r"^(https://[^:]+):443$", "$1")
    return F.when(ok, bare)


def glob_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[\]*?])", "[$1]")


def label(text: Column, limit: int = 60) -> Column:
    """A trimmed label of 1 to `limit` characters without control characters, else null."""
    bare = F.trim(text)
    return F.when((F.length(bare) >= 1) & (F.length(bare) <= limit) & ~bare.rlike(r"[\x00-\x1f\x7f]"), bare)


def hidden_path(path: Column) -> Column:
    """Inside a folder whose name begins with _ or a dot."""
    return path.rlike(r"(^|/)[_.][^/]*/")


def suggestion(title: Column, limit: int = 28) -> Column:
    """A search text from a title: without what brackets and quotes hold, but with the name in book marks; cut to `limit` characters."""
    title = F.coalesce(title, F.lit(""))
    name = F.regexp_extract(title, r"(?U)《\s*([^《》]+?)\s*》", 1)
    bare = trimmed(F.regexp_replace(F.regexp_replace(title, r"[\(（\[【『「][^)）\]】』」]*[\)）\]】』」]", " "), r"(?U)\s+", " "))
    return F.left(F.when((name != "") & ~bare.contains(name), trimmed(F.concat_ws(" ", bare, name))).otherwise(bare), F.lit(limit))

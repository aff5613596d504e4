"""Text functions as Spark columns: tokens, words, sentences, identities, URLs.

Word characters are Unicode letters, digits and underscore on both sides of a
token, written as look-arounds so that no JDK's idea of a word boundary counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
KEYWORD_PATTERN = rf"(?<!{_W})[a-zA-Z][a-zA-Z0-9_\-]{{2,}}{_EDGE}"
SEARCH_PATTERN = rf"(?<!{_W})[a-zA-Z0-9][a-zA-Z0-9_\-]*{_EDGE}"
#: Everything that ends a word: ASCII and Unicode white space.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: English function words that are never keywords, in alphabetical order.
STOPWORDS = tuple(
    sorted(
        set(
            "a about above across after again against all also am an and any are as at be because been before being below"
            " between both but by can could did do does down during each else etc few for from had has have he her here him his how i if"
            " in into is it its may me might mine more most must my no not of off on only or other our ours out over own per same shall she"
            " should so some such than that the their them then there these they this those to too under up us use used using very via was"
            " we were what when where which who whom whose why will with within would you your yours".split()
        )
    )
)


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    return F.regexp_replace(c(text), rf"^{SPACE}+|{SPACE}+$", "")


def words(text: Column | str) -> Column:
    """Words between white space."""
    return F.filter(F.split(c(text), f"{SPACE}+"), lambda w: w != "")


def keyword_tokens(text: Column | str) -> Column:
    """Lower-cased tokens of three characters or more that aren't stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(all_word_tokens(text), lambda t: ~F.array_contains(stop, t))


def all_word_tokens(text: Column | str) -> Column:
    """The same tokens with the stopwords."""
    found = F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(KEYWORD_PATTERN), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def search_tokens(text: Column | str) -> Column:
    """Lower-cased tokens as search and embedding see them."""
    found = F.regexp_extract_all(F.coalesce(c(text), F.lit("")), F.lit(SEARCH_PATTERN), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def with_bigrams(tokens: Column | str) -> Column:
    """Tokens followed by all pairs of neighbours joined by an underscore."""
    t = c(tokens)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.when(F.size(t) > 1, F.concat(t, pairs)).otherwise(t)


def token_bucket(token: Column | str, dim: int) -> Column:
    """Bucket of a feature: the first four bytes of its MD5, little-endian, modulo dim."""
    h = F.md5(c(token))
    swapped = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return (F.conv(swapped, 16, 10).cast("bigint") % dim).cast("int")


def token_sign(token: Column | str) -> Column:
    """1 or -1 by the lowest bit of the fifth byte of the MD5."""
    return F.when(F.conv(F.substring(F.md5(c(token)), 10, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def tokens_of_words(n: Column | str) -> Column:
    """Estimated model tokens of n words: three words make four tokens."""
    return F.greatest(F.lit(1), F.floor(c(n) / F.lit(0.75))).cast("bigint")


def token_count(text: Column | str) -> Column:
    return tokens_of_words(F.size(words(text)))


def sentences(text: Column | str) -> Column:
    """Stripped sentences: text after ., ! or ? and white space begins a new one."""
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def printable_share(text: Column | str) -> Column:
    """Share of printable characters among the first 2000; null where there are none."""
    head = F.substring(c(text), 1, 2000)
    shown = F.length(F.regexp_replace(head, r"[^\p{L}\p{M}\p{N}\p{P}\p{S} \t\r\n]", ""))
    return F.when(F.length(head) > 0, shown / F.length(head))


# -- identities ---------------------------------------------------------------


def document_id(source: Column | str, uri: Column | str) -> Column:
    return F.sha2(F.concat(c(source), F.lit("::"), c(uri)), 256)


def version_id(data: Column | str, etag: Column | None = None) -> Column:
    """Identity of an edition: of its etag where there is one, else its bytes."""
    own = F.sha2(c(data), 256)
    return own if etag is None else F.when(F.coalesce(etag, F.lit("")) != "", F.sha2(etag, 256)).otherwise(own)


def chunk_id(doc: Column | str, version: Column | str, index: Column | str) -> Column:
    return F.concat(F.lit("chunk_"), F.sha2(F.concat(c(doc), F.lit("::"), c(version)), 256), F.lit("_"), F.format_string("%04d", c(index)))


def stable_key(value: Column | str) -> Column:
    return F.sha2(c(value), 256)


# -- names and places -----------------------------------------------------------


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(c(path), "/"), -1)


def extension(name: Column | str) -> Column:
    """Lower-cased extension; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(base_name(name), r"[^.].*\.([^.]*)$", 1))


def url_authority(url: Column | str) -> Column:
    return F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def normalize_url(url: Column | str) -> Column:
    """Lower-cased scheme and host; no query, fragment or closing slash."""
    scheme = F.lower(F.regexp_extract(c(url), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    path = F.regexp_replace(F.when(url_path(url) == "", F.lit("/")).otherwise(url_path(url)), "(.)/$", "$1")
    return F.concat(F.when(scheme == "", F.lit("https")).otherwise(scheme), F.lit("://"), F.lower(url_authority(url)), path)


def site_of(authority: Column | str) -> Column:
    """Host without user, port and a leading www."""
    host = F.lower(F.regexp_replace(F.regexp_replace(c(authority), "^.*@", ""), ":[0-9]*$", ""))
    return F.regexp_replace(host, r"^www\.", "")


def in_site(authority: Column | str, site: Column | str) -> Column:
    """Whether a host is the site or lies beneath it."""
    own = site_of(authority)
    return (own != "") & (c(site) != "") & ((own == c(site)) | F.endswith(own, F.concat(F.lit("."), c(site))))


def folder_of(locator: Column | str) -> Column:
    """Parent folder of a path or URL; '/' where there is none."""
    x = c(locator)
    web = F.startswith(x, F.lit("http://")) | F.startswith(x, F.lit("https://"))
    parts = F.filter(F.split(url_path(x), "/"), lambda p: p != "")
    parent = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    site = F.regexp_replace(F.concat(url_authority(x), F.lit("/"), parent), "/+$", "")
    plain = F.regexp_replace(F.regexp_replace(x, "file://", ""), "text://", "")
    head = F.regexp_extract(plain, "^(.*/)[^/]*$", 1)
    directory = F.when(F.regexp_replace(head, "/", "") == "", head).otherwise(F.regexp_replace(head, "/+$", ""))
    return F.when(web, site).otherwise(F.when(directory == "", F.lit("/")).otherwise(directory))


def ancestors(folder: Column | str) -> Column:
    """Folders above one, nearest first, without the root."""
    parts = F.filter(F.split(c(folder), "/"), lambda p: p != "")
    return F.when(
        (F.size(parts) > 1) & ~c(folder).isin(".", "/", ""),
        F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")),
    ).otherwise(F.array().cast("array<string>"))


# -- composed texts -------------------------------------------------------------


def _placed(folder: Column) -> Column:
    return F.when(~folder.isin("", ".", "/"), F.concat(F.lit("Location: "), folder))


def context_header(title: Column, folder: Column, about: Column, summary: Column, heading: Column) -> Column:
    """One line that says where a chunk comes from; absent parts are left out."""

    def given(x: Column) -> Column:
        return F.coalesce(x, F.lit("")) != ""

    return F.concat_ws(
        " | ",
        F.when(given(title), F.concat(F.lit("Document: "), title)),
        _placed(folder),
        F.when(given(heading), F.concat(F.lit("Section: "), heading)),
        F.when(given(about), F.concat(F.lit("About: "), F.substring(about, 1, 240))).when(given(summary), F.concat(F.lit("About: "), F.substring(summary, 1, 240))),
    )


def with_header(header: Column, text: Column) -> Column:
    return F.when(header == "", text).otherwise(F.concat(F.lit("["), header, F.lit("]\n"), text))


def summary_record(title: Column, folder: Column, about: Column, summary: Column, keywords: Column) -> Column:
    """The searchable text of a document's summary record."""
    return strip(
        F.concat_ws(
            "\n",
            F.when(title != "", F.concat(F.lit("Title: "), title)),
            _placed(folder),
            F.when(about != "", about),
            F.when(summary != "", summary),
            F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", "))),
        )
    )


def citation(title: Column, uri: Column, doc: Column, location: Column) -> Column:
    name = F.coalesce(*[F.when(x != "", x) for x in (title, uri, doc)], F.lit(""))
    return F.when(F.coalesce(location, F.lit("")) != "", F.concat(name, F.lit(" ("), location, F.lit(")"))).otherwise(name)

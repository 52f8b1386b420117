"""Text and identity expressions on columns, all of them built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visits, besides those that begin with utm_.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref_src")
#: The ideographs that count as words and letters.
CJK = r"\x{3400}-\x{9fff}"
WORD = r"[A-Za-z0-9]+(?:['’-][A-Za-z0-9]+)*|[" + CJK + "]"
CJK_SHARE = 0.08
TOPIC_SEPARATORS, TOPIC_CHARS, TOPICS = r"[,;，、|]+", 40, 20
MEDIA = 50

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(x: C) -> Column:
    """White space of any script to single spaces, none at the ends; null to the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"(?U)\s+", " "))


def _encoded(x: Column) -> Column:
    """Form encoding with the unreserved characters of RFC 3986."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def normalize_url(x: C) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameters, parameters sorted, an empty path as /."""
    url = F.trim(_c(x))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pair = lambda p: F.struct(_decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"))
    wanted = lambda p: ~F.startswith(F.lower(p["k"]), F.lit("utm_")) & ~F.lower(p["k"]).isin(*TRACKING)
    pairs = F.array_sort(F.filter(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair), wanted))
    kept = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    where = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)))
    return F.concat(where, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def host_key(x: C) -> Column:
    """The host without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(_c(x), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1)), r"^www\.", "")


def identity_key(external_id: C, canonical_url: C, title: C, published: C) -> Column:
    """The digest of the best identity there is: an external id, else the canonical URL, else title and date."""
    given = lambda x: F.nullif(_c(x), F.lit(""))
    basis = F.coalesce(
        F.concat(F.lit("guid:"), F.trim(given(external_id))),
        F.concat(F.lit("url:"), given(canonical_url)),
        F.concat(F.lit("fallback:"), F.trim(_c(title)), F.lit("|"), F.trim(F.coalesce(_c(published), F.lit("")))),
    )
    return F.sha2(basis, 256)


def normalize_topics(values: C) -> Column:
    """array<string> -> topics split at separators, without URLs, of 1 to 40 characters, distinct whatever the case, at most 20."""
    names = F.filter(F.coalesce(_c(values), F.array().cast("array<string>")), lambda x: x.isNotNull() & ~F.lower(F.trim(x)).rlike("^https?://"))
    parts = F.flatten(F.transform(names, lambda x: F.split(F.trim(x), TOPIC_SEPARATORS)))
    clean = F.filter(F.transform(parts, lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" #"))), lambda x: (x != "") & (F.length(x) <= TOPIC_CHARS))
    first = F.aggregate(clean, F.array().cast("array<string>"), lambda held, x: F.when(F.exists(held, lambda y: F.lower(y) == F.lower(x)), held).otherwise(F.array_append(held, x)))
    return F.slice(first, 1, TOPICS)


def normalize_media(values: C) -> Column:
    """array<struct<type,url,alt>> -> http(s) entries, distinct by URL, the type's main part, at most 50."""
    row = lambda m: F.struct(F.substring_index(F.coalesce(F.nullif(m["type"], F.lit("")), F.lit("image")), "/", 1).alias("type"), F.trim(m["url"]).alias("url"), F.nullif(F.trim(m["alt"]), F.lit("")).alias("alt"))
    held = F.filter(F.transform(_c(values), row), lambda m: m["url"].rlike("^https?:"))
    urls = F.transform(held, lambda m: m["url"])
    return F.slice(F.filter(held, lambda m, k: F.array_position(urls, m["url"]) == k + 1), 1, MEDIA)


def content_hash(title: C, body: C, excerpt: C, topics: C) -> Column:
    """The digest of the compact JSON of the collapsed fields, its keys in order."""
    fields = F.struct(collapse(body).alias("body_text"), collapse(excerpt).alias("excerpt"), collapse(title).alias("title"), normalize_topics(topics).alias("topics"))
    return F.sha2(F.to_json(fields), 256)


def count_words(x: C) -> Column:
    """Latin words and numbers, and each ideograph."""
    return F.regexp_count(_c(x), F.lit(WORD)).cast("bigint")


def detect_language(x: C, default: C) -> Column:
    """zh-CN where ideographs make up 8 % of the letters, else en where there is a Latin letter, else the default."""
    letters, ideographs = F.regexp_count(_c(x), F.lit(f"[A-Za-z{CJK}]")), F.regexp_count(_c(x), F.lit(f"[{CJK}]"))
    return F.when((letters > 0) & (ideographs / F.greatest(letters, F.lit(1)) >= CJK_SHARE), "zh-CN").when(_c(x).rlike("[A-Za-z]"), "en").otherwise(_c(default))


def url_date(x: C) -> Column:
    """The date in a URL path: /20YY/M/D, or eight digits."""
    parts = lambda n: F.regexp_extract(_c(x), r"(20\d{2})[/-](\d{1,2})[/-](\d{1,2})", n)
    plain = F.regexp_extract(_c(x), r"(?<!\d)(20\d{2}[01]\d[0-3]\d)(?!\d)", 1)
    spelled = F.when(parts(1) != "", F.expr("NULL")).otherwise(F.lit(None))
    dashed = F.when(parts(1) != "", F.try_to_date(F.concat_ws("-", parts(1), F.lpad(parts(2), 2, "0"), F.lpad(parts(3), 2, "0")), "yyyy-MM-dd"))
    return F.coalesce(dashed, F.when(plain != "", F.try_to_date(plain, "yyyyMMdd")), spelled.cast("date"))


def letters(x: C) -> Column:
    """Letters and digits in lower case; null to the empty string."""
    return F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^\p{L}\p{N}]", "")


def grams(clean: C, n: int) -> Column:
    """The set of character n-grams of a text as `letters` gives it; a shorter text is its own only gram, an empty one has none."""
    size = F.length(_c(clean))
    every = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda k: F.substr(_c(clean), k, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def char_ngrams(x: C, n: int) -> Column:
    """The set of character n-grams of letters and digits in lower case; a shorter text is its own only gram, an empty one has none."""
    return grams(letters(x), n)


def jaccard(a: Column, b: Column) -> Column:
    """Common to all members of two arrays without repeats; null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def bounded(x: C, keyword: str) -> Column:
    """Does a text hold a keyword? A Latin one must stand alone; anything else may be part of a longer word."""
    keyword = keyword.strip().lower()
    if keyword.isascii() and any(c.isalnum() for c in keyword):
        return F.lower(_c(x)).rlike(rf"(?<![a-z0-9])\Q{keyword}\E(?![a-z0-9])")
    return F.contains(F.lower(_c(x)), F.lit(keyword))


def summary(x: C, limit: int = 260) -> Column:
    """Collapsed text, cut with an ellipsis where it is longer than the limit."""
    flat = collapse(x)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1), F.lit("，。；;,. ")), F.lit("…")))


def half_up(x: Column, digits: int) -> Column:
    """Rounding half up in binary arithmetic, the same in any engine."""
    return F.floor(x * 10**digits + 0.5) / 10**digits

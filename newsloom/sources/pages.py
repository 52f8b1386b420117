"""Saved web pages: one parse per page into a struct of facts; discovery, extraction and probing are expressions on it."""

from __future__ import annotations

import json
import ipaddress
import re
from html.parser import HTMLParser
from urllib import robotparser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.functions.slices import sliced

FACTS = (
    "title string, h1 string, canonical string, lang string, meta map<string,string>, links array<struct<href:string,text:string,area:string>>, json_ld array<string>, "
    "times array<string>, dated array<string>, article string, main string, body string, has_password boolean, feeds array<string>"
    ", tag_meta array<string>, tag_links array<string>"
)
#: Path parts that lead to no article, and files that are none.
IGNORED = ("account", "author", "category", "contact", "login", "privacy", "search", "tag", "terms")
FILES = r"(?i)\.(jpg|jpeg|png|gif|svg|pdf|zip)$"
LINK_CHARS, ARTICLES, MOST_ARTICLES, BODY_CHARS = 8, 10, 50, 120
#: Elements whose text is no body, and names of metadata that hold a date, in the order in which they count.
NOISE = {"script", "style", "noscript", "nav", "footer", "aside", "form", "template", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "li", "blockquote", "div", "section", "article", "main", "td", "br"}
DATE_META = (
    "article:published_time", "og:published_time", "article:published", "datepublished", "pubdate", "publishdate", "publish-date", "originalpublicationdate",
    "sailthru.date", "parsely-pub-date", "dc.date.issued", "dcterms.created", "date_published",
)
_DATED = re.compile(r"date|time|publish", re.I)


class _Reader(HTMLParser):
    """Gathers the facts of one page; the text of noise elements is left out of bodies."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.facts: dict = {k.split()[0]: None for k in ("title", "h1", "canonical", "lang")} | {"meta": {}, "links": [], "json_ld": [], "times": [], "dated": [], "has_password": False, "feeds": [], "tag_meta": [], "tag_links": []}
        self.texts: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.link: list | None = None
        self.held: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        f = self.facts
        if tag == "html":
            f["lang"] = a.get("lang")
        elif tag == "meta" and (key := (a.get("name") or a.get("property") or a.get("itemprop") or "").strip().lower()):
            f["meta"].setdefault(key, a.get("content", ""))
            if a.get("property") == "article:tag":
                f["tag_meta"].append(a.get("content", ""))
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if "canonical" in rel:
                f["canonical"] = f["canonical"] or a.get("href")
            if "alternate" in rel and re.search(r"rss|atom", a.get("type", "")):
                f["feeds"].append(a.get("href", ""))
        elif tag == "input" and a.get("type", "").lower() == "password":
            f["has_password"] = True
        elif tag == "time" and a.get("datetime"):
            f["times"].append(a["datetime"])
        elif tag == "a" and a.get("href"):
            area = next((t for t, _ in reversed(self.open) if t in ("article", "main", "nav")), "")
            self.link = [a["href"], [], area]
        if tag == "a" and "tag" in a.get("rel", "").split():
            self.held["tag_links"] = []
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.held["json_ld"] = []
        if tag in ("title", "h1") and f[tag] is None:
            self.held[tag] = []
        dated = bool(_DATED.search(f"{a.get('class', '')} {a.get('id', '')}")) or tag == "time"
        if tag in BLOCKS:
            self._say("\n")
        if tag not in VOID:
            self.open.append((tag, dated))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.link:
            self.facts["links"].append((self.link[0], " ".join("".join(self.link[1]).split()), self.link[2]))
            self.link = None
        if tag == "a" and "tag_links" in self.held:
            self.facts["tag_links"].append(" ".join("".join(self.held.pop("tag_links")).split()))
        if tag == "script" and "json_ld" in self.held:
            self.facts["json_ld"].append("".join(self.held.pop("json_ld")))
        if tag in ("title", "h1") and tag in self.held:
            self.facts[tag] = " ".join("".join(self.held.pop(tag)).split()) or None
        if tag in BLOCKS:
            self._say("\n")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        for parts in self.held.values():
            parts.append(data)
        if self.link:
            self.link[1].append(data)
        if any(d for _, d in self.open) and data.strip():
            self.facts["dated"].append(" ".join(data.split()))
        self._say(data)

    def _say(self, data: str) -> None:
        tags = {t for t, _ in self.open}
        if not tags & NOISE and "head" not in tags and "title" not in tags:
            for area, parts in self.texts.items():
                if area == "body" or area in tags:
                    parts.append(data)

    def result(self) -> dict:
        lines = {k: [" ".join(x.split()) for x in "".join(v).split("\n")] for k, v in self.texts.items()}
        return self.facts | {k: "\n\n".join(x for x in v if x) for k, v in lines.items()}


def facts_of(html: str | None) -> dict:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.result()


def page_facts(html: Column) -> Column:
    """The facts of every page, in Arrow batches."""

    @sliced(f"struct<{FACTS}>")
    def parsed(pages: list) -> list[dict]:
        found = [facts_of(x) for x in pages]
        return [x | {"meta": list(x["meta"].items())} for x in found]

    return parsed(html)


def url_join(base: Column, href: Column) -> Column:
    """The absolute form of a link on a page."""
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(href.rlike(r"^[?#]"), F.concat(bare, href))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), F.regexp_replace(href, r"^(\./)+", "")))
    )


def discover_articles(pages: DataFrame, pattern: str | None = None, limit: int = ARTICLES) -> DataFrame:
    """(page_id, url, facts) -> page_id, position, article_url: links to articles of the page's own host, in page order.

    Without a pattern, links that lead to sections, or whose text is short, are left out. At most 50 a page.
    """
    links = pages.select("page_id", "url", F.posexplode("facts.links").alias("at", "l")).where("l.area IN ('article', 'main')")
    links = links.select("page_id", "at", F.col("url").alias("start"), text.normalize_url(url_join(F.col("url"), F.trim("l.href"))).alias("article_url"), F.col("l.text").alias("said"))
    host = lambda c: F.regexp_extract(c, r"^[a-z]+://([^/:?#]*)", 1)
    path = F.regexp_extract("article_url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    own = (host("article_url") == F.lower(host(F.lower("start")))) & (F.col("article_url") != text.normalize_url("start"))
    rows = links.where(own & ~path.rlike(FILES))
    if pattern is None:
        parts = F.array_remove(F.split(F.lower(path), "/"), "")
        rows = rows.where(~F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED))) & (F.length("said") >= LINK_CHARS))
    else:
        rows = rows.where(F.col("article_url").rlike(pattern))
    first = rows.groupBy("page_id", "article_url").agg(F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("at"))
    return first.withColumn("position", place).where(F.col("position") <= max(1, min(limit, MOST_ARTICLES))).select("page_id", "position", "article_url")


def parse_date(x: Column, zone: str = "UTC") -> Column:
    """A free-form date as UTC; one without a zone is local to `zone`. Years before 1990 or far ahead are no dates."""
    clean = F.trim(F.regexp_replace(x, r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?", "$1-$2-$3"))
    clean = F.regexp_replace(clean, r"^[A-Za-z]{3,9},\s+", "")  # parsers take no week days
    zoned = clean.rlike(r"(Z|[+-]\d{2}:?\d{2}|GMT|UTC)$")
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX][X]", "yyyy-MM-dd HH:mm[:ss]", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMM yyyy HH:mm[:ss][ Z][ z]")
    found = F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in forms])
    return F.when(F.year(found).between(1990, 2100), F.when(zoned, found).otherwise(F.to_utc_timestamp(found, zone)))


def extract_articles(pages: DataFrame, zone: str = "UTC", least_chars: int = BODY_CHARS) -> DataFrame:
    """(page_id, url, facts) -> the article of each page, or none if its body is too short.

    Structured data first, then page metadata, then the page; the body is the longest of article, main and page; the
    date comes from the first of seven signals that gives one, and its origin is told.
    """
    f = lambda name: F.col(f"facts.{name}")
    ld = F.filter(f("json_ld"), lambda x: x.rlike(r'"@type"\s*:\s*\[?\s*"(News)?Article"|"BlogPosting"'))
    one = F.try_element_at(ld, F.lit(1))
    get = lambda key: F.coalesce(F.get_json_object(one, f"$.{key}"), F.get_json_object(one, f"$['@graph'][0].{key}"))
    meta = lambda key: F.nullif(F.trim(F.try_element_at(f("meta"), F.lit(key))), F.lit(""))
    body = F.array_max(F.array(*[F.struct(F.length(f(k)).alias("n"), F.lit(-i).alias("i"), f(k).alias("b")) for i, k in enumerate(("article", "main", "body"))]))["b"]
    url_text = F.date_format(text.url_date(F.col("url")), "yyyy-MM-dd")
    seen = F.try_element_at(F.filter(f("dated"), lambda x: x.rlike(r"20\d{2}")), F.lit(1))
    signals = [("json_ld", get("datePublished")), ("open_graph", meta("article:published_time")), ("open_graph", meta("og:published_time")), *[("meta", meta(k)) for k in DATE_META], ("time", F.try_element_at(f("times"), F.lit(1))), ("url", url_text), ("visible_text", F.regexp_extract(seen, r"20\d{2}[-/.年]\s*\d{1,2}[-/.月]\s*\d{1,2}|[A-Z][a-z]+ \d{1,2}, 20\d{2}|\d{1,2} [A-Z][a-z]+ 20\d{2}", 0))]
    # One parser over the signals that there are, rather than one parser for each.
    given = F.filter(F.array(*[F.struct(v.alias("said"), F.lit(k).alias("origin")) for k, v in signals]), lambda x: F.coalesce(x["said"], F.lit("")) != "")
    read = F.filter(F.transform(given, lambda x: F.struct(parse_date(x["said"], zone).alias("at"), x["origin"].alias("origin"))), lambda x: x["at"].isNotNull())
    dated = F.try_element_at(read, F.lit(1))
    author = F.coalesce(get("author.name"), get("author[0].name"), meta("author"))
    rows = pages.select(
        "page_id", "url", F.coalesce(F.nullif(f("canonical"), F.lit("")), F.col("url")).alias("canonical"), F.coalesce(get("headline"), meta("og:title"), f("h1"), f("title")).alias("title"),
        author.alias("author"), F.coalesce(get("description"), meta("og:description"), meta("description")).alias("description"), body.alias("body"), dated.alias("d"), f("lang").alias("lang"),
    )
    rows = rows.withColumn("canonical_url", text.normalize_url(url_join(F.col("url"), F.col("canonical")))).where((F.length("body") >= least_chars) & F.col("title").isNotNull())
    return rows.select("page_id", "url", "canonical_url", "title", "author", "description", "body", F.col("d.at").alias("published_at"), F.col("d.origin").alias("date_origin"), "lang")


#: Types of JSON-LD objects that are articles, and the members that name topics, in their order.
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting")
TOPIC_MEMBERS = ("keywords", "articleSection", "about")
#: Members of an object that name it, the first that says something.
NAME_MEMBERS = ("name", "term", "keyword", "@id")


def _named(value: object) -> list[str]:
    """The topics that a JSON value names: itself, the names of an object, those of a list's members."""
    if isinstance(value, list):
        return [x for item in value for x in _named(item)]
    if isinstance(value, dict):
        return _named(next((value[k] for k in NAME_MEMBERS if value.get(k)), None))
    return [] if value is None else [str(value)]


def structured_topics(scripts: list[str]) -> list[str]:
    """Topics of the first article among a page's JSON-LD scripts; members of lists and graphs come after those of their level."""
    for script in scripts:
        try:
            whole = json.loads(script)
        except ValueError:
            continue
        level = whole if isinstance(whole, list) else [whole]
        while level:
            deeper = []
            for item in (x for x in level if isinstance(x, dict)):
                kind = item.get("@type")
                if any(k in ARTICLE_TYPES for k in (kind if isinstance(kind, list) else [kind])):
                    return [x for member in TOPIC_MEMBERS for x in _named(item.get(member))]
                graph = item.get("@graph")
                deeper += graph if isinstance(graph, list) else []
            level = deeper
    return []


def page_topics(facts: Column) -> Column:
    """facts -> topics of a page: structured data, article tags, keywords of the page, links marked as tags; normalized.

    Scripts that aren't JSON are passed over; a page without any topic has an empty list.
    """

    @sliced("array<string>")
    def structured(scripts: list) -> list[list[str]]:
        return [structured_topics(x or []) for x in scripts]

    meta = lambda key: F.array_compact(F.array(F.nullif(F.trim(F.try_element_at(facts["meta"], F.lit(key))), F.lit(""))))
    return text.normalize_topics(F.concat(structured(facts["json_ld"]), facts["tag_meta"], meta("news_keywords"), meta("keywords"), facts["tag_links"]))


#: How deep lists are looked for, how many members tell what a list holds, and how many paths are given.
LIST_DEPTH, LIST_MEMBERS, LIST_PATHS = 3, 10, 10


def list_paths(value: object, path: str = "$", depth: int = 0) -> list[str]:
    """Paths of the lists of objects in a JSON value, in the order of the document, the first ten."""
    if depth > LIST_DEPTH:
        return []
    if isinstance(value, list):
        return [path] if value and all(isinstance(x, dict) for x in value[:LIST_MEMBERS]) else []
    found: list[str] = []
    for key, item in value.items() if isinstance(value, dict) else ():
        found += list_paths(item, key if path == "$" else f"{path}.{key}", depth + 1)
        if len(found) >= LIST_PATHS:
            break
    return found[:LIST_PATHS]


def json_list_paths(document: Column) -> Column:
    """list_paths of JSON texts, in Arrow batches; null for a text that isn't JSON, or none."""

    @sliced("array<string>")
    def walked(documents: list) -> list[list[str] | None]:
        out = []
        for x in documents:
            try:
                out.append(None if x is None else list_paths(json.loads(x)))
            except (ValueError, RecursionError):
                out.append(None)
        return out

    return walked(document)


def probe(documents: DataFrame) -> DataFrame:
    """(url, status, content_type, body, facts) -> detected format, subtype, block reason and confidence."""
    head = F.lower(F.ltrim(F.substring("body", 1, 2000)))
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    challenge = F.coalesce(F.lower("facts.title").rlike(r"just a moment|attention required|captcha|verify you are human|access denied|安全验证"), F.lit(False))
    blocked = (
        F.when(F.col("status") == 429, "rate_limited").when(F.col("status").isin(401, 407), "authentication_required").when(F.col("status") == 451, "legal_restriction").when(F.col("status") == 410, "gone")
        .when(F.col("status") == 403, "forbidden").when(challenge, "challenge_page").when(F.coalesce("facts.has_password", F.lit(False)), "login_required").when(F.col("status") == 503, "unavailable")
    )
    shape = (
        F.when(head == "", "empty").when(head.rlike(r"^(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<rss|<rdf:rdf"), "rss").when(head.rlike(r"^(<\?xml[^>]*>\s*)?<feed"), "atom")
        .when(head.rlike("<urlset"), "sitemap_urlset").when(head.rlike("<sitemapindex"), "sitemap_index").when(head.rlike(r"^[\[{]") & F.expr("try_parse_json(body)").isNotNull(), "json")
        .when(head.rlike("^<!doctype html|<html") | kind.rlike("html"), "html").otherwise("unknown")
    )
    sure = {"rss": 0.98, "atom": 0.98, "sitemap_urlset": 0.98, "sitemap_index": 0.98, "json": 0.9, "html": 0.8, "empty": 1.0}
    found = F.when(blocked.isNotNull(), "blocked").otherwise(shape)
    confidence = F.coalesce(*[F.when(found == k, v) for k, v in sure.items()], F.when(found == "blocked", 1.0), F.lit(0.0))
    pipeline = F.when(found.isin("rss", "atom"), "feed_direct").when(found == "sitemap_urlset", "sitemap_http").when(found == "json", "json_api").when((found == "html") & (F.size("facts.feeds") > 0), "advertised_feed").when(found == "html", "static_http")
    return documents.select("url", found.alias("detected_format"), blocked.alias("block_reason"), confidence.alias("confidence"), pipeline.alias("recommended_pipeline"))


def url_error(url: str | None) -> str | None:
    """Why a URL may not be fetched, or None; names are not resolved."""
    try:
        parts = urlsplit((url or "").strip())
        port = parts.port
    except ValueError:
        return "invalid_url"
    host = (parts.hostname or "").rstrip(".").lower()
    if parts.scheme not in ("http", "https"):
        return "unsupported_scheme"
    if not host:
        return "missing_host"
    if parts.username or parts.password:
        return "userinfo_not_allowed"
    if port not in (None, 80, 443):
        return "port_not_allowed"
    if host == "localhost" or host.endswith((".localhost", ".local", ".internal", ".lan", ".home")):
        return "private_host"
    try:
        return None if ipaddress.ip_address(host).is_global else "private_address"
    except ValueError:
        return None


def url_errors(url: Column) -> Column:
    @F.pandas_udf("string")
    def checked(urls: pd.Series) -> pd.Series:
        return urls.map(url_error)

    return checked(url)


def robots_allow(robots: Column, url: Column, agent: str = "*") -> Column:
    """May a page be fetched under its host's robots.txt? A missing file allows all."""

    @F.pandas_udf("boolean")
    def allowed(files: pd.Series, urls: pd.Series) -> pd.Series:
        out, known = [], {}
        for rules, u in zip(files, urls):
            if rules not in known:
                known[rules] = robotparser.RobotFileParser()
                known[rules].parse((rules or "").splitlines())
            out.append(known[rules].can_fetch(agent, u or ""))
        return pd.Series(out, dtype=bool)

    return allowed(robots, url)


def snapshots(pages: DataFrame) -> DataFrame:
    """Immutable page facts: body digest and size with the page."""
    body = F.coalesce("html", F.lit(""))
    return pages.select("page_id", text.normalize_url("url").alias("url"), F.sha2(body, 256).alias("body_sha256"), F.octet_length(body).cast("bigint").alias("body_bytes"))

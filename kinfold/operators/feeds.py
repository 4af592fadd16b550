"""Feed normalisation: listings and children of providers to rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import text as T
from kinfold.operators.windows import first_few, first_row

C = F.col


def series_from_feed(items: DataFrame, lang: str) -> DataFrame:
    """Available items (id, langs, titles: map, relations: array of (type, name)) as listing rows."""
    return items.filter(F.array_contains("langs", lang)).select("id", T.localized(C("titles"), lang).alias("title"), F.array_join(T.relationship_names(C("relations"), "author"), ", ").alias("authors"), T.relationship(C("relations"), "cover")["name"].alias("cover"))


def chapters_from_feed(items: DataFrame) -> DataFrame:
    """Children (array of number, title, official, verified, pages, at) as rows."""
    rows = items.select("id", F.posexplode("children").alias("position", "c"))
    return rows.select("id", "position", T.canonical_number(C("c.number")).alias("number"), F.trim(F.coalesce("c.title", F.lit(""))).alias("title"), T.quality_rank(C("c.official"), C("c.verified"), C("c.pages")).alias("quality"), T.parse_iso_or_epoch(C("c.at")).alias("published_at"))


def best_release_per_number(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The best row of each number by (quality, published_at, id), and the ids of the others, best first."""
    each = F.sort_array(F.collect_list(F.struct("quality", "published_at", "id")), asc=False)
    return rows.groupBy(*keys).agg(each.alias("x")).select(*keys, F.get("x", 0)["id"].alias("id"), F.array_join(F.transform(F.slice("x", 2, F.size("x")), lambda s: s["id"]), ",").alias("others"))


def dedupe_first(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """N4."""
    return first_row(rows, keys, [C(position)])


def dedupe_by_quality(rows: DataFrame, keys: list[str], quality: str, position: str) -> DataFrame:
    """The best row of each key (ties to the first), at the first place that the key had."""
    place = rows.groupBy(*keys).agg(F.min(position).alias("__p"))
    return first_row(rows, keys, [F.desc(quality), C(position)]).join(place, keys).withColumn(position, C("__p")).drop("__p")


def merge_observations(rows: DataFrame, key: str = "id", most: int = 6) -> DataFrame:
    """Repeated sightings (position, title, popularity, recent: array of numbers) as one row each: the first recent
    numbers, the first title that isn't empty, the greatest popularity."""
    titled = F.when(C("title") != "", C("position"))
    out = rows.groupBy(key).agg(F.coalesce(F.min_by("title", titled), F.lit("")).alias("title"), F.max("popularity").alias("popularity"))
    numbers = rows.select(key, "position", F.posexplode("recent").alias("i", "number")).groupBy(key, "number").agg(F.min(F.struct("position", "i")).alias("at"))
    return out.join(first_few(numbers, [key], "at", "number", most).withColumnRenamed("few", "recent"), key, "left").withColumn("recent", F.coalesce("recent", F.lit("")))


def overlay_detail(listing: DataFrame, detail: DataFrame, key: str = "id") -> DataFrame:
    """What a detail row says, where it says something, over the listing row."""
    values = [c for c in listing.columns if c != key]
    out = listing.join(detail.select(key, *(C(c).alias(f"__{c}") for c in values)), key, "left")
    return out.select(key, *(F.coalesce(F.nullif(C(f"__{c}").cast("string"), F.lit("")), C(c).cast("string")).alias(c) for c in values))


def observation_version(latest: Column, recent: Column) -> Column:
    """The given latest number, else the greatest recent one."""
    keyed = F.array_max(F.transform(recent, lambda n: F.struct(T.number_key(n).alias("k"), n.alias("n"))))
    return F.coalesce(F.nullif(latest, F.lit("")), keyed["n"], F.lit(""))


#: Attributes of an image in the order in which they count, elements whose text isn't shown, and what may
#: end an address within a script but isn't part of it.
IMAGE_ATTRIBUTES = ("data-src", "data-lazy-src", "data-original", "data-url", "srcset", "src")
HIDDEN = ("script", "style")
AFTER_ADDRESS = "),];"

_ADDRESS = re.compile(r"""https?://[^'"<>\s]+|(?<=")/?[^"\s<>:{}\[\]]+\.(?:%s)(?=")""" % "|".join(T.IMAGE_SUFFIXES), re.IGNORECASE)


class _Links(HTMLParser):
    """Links with their text, images (elements, then addresses and quoted image paths anywhere in the source), and the
    visible text of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[list[str]] = []
        self.images: list[str] = []
        self.text: list[str] = []
        self.hidden = 0
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        self.hidden += tag in HIDDEN
        if tag == "a" and a.get("href"):
            self.links.append([a["href"], ""])
            self.inside = True
        elif tag == "img":
            name = next((n for n in IMAGE_ATTRIBUTES if a.get(n)), "src")
            found = a.get(name, "")
            if found:
                self.images.append(found.split(",")[0].strip().split(" ")[0] if name == "srcset" else found)

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in HIDDEN and self.hidden > 0
        self.inside &= tag != "a"

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.inside:
                self.links[-1][1] += data


#: Labels of links that lead to no item of their own.
HELPERS = ("first chapter", "latest chapter", "first", "latest", "manhwa", "text mode")


def script_addresses(html: str) -> list[str]:
    """Addresses, and quoted paths of images, in the source of a page: scripts, data attributes and JSON among it."""
    text = unescape(html).replace("\\/", "/")
    return [x.rstrip(AFTER_ADDRESS) for x in _ADDRESS.findall(text)]


def resolved(base: str, address: str) -> str:
    try:
        return urljoin(base, address)
    except ValueError:
        return address


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, visible text, links (array of href, text) and images of saved pages (page_id, html, and url, against
    which images are resolved). Pages come to Python a hundred at a time, not by Arrow's batches of ten thousand, and are parsed
    once, whatever is read of them."""
    if "url" not in pages.columns:
        pages = pages.withColumn("url", F.lit(""))

    @F.udf("text string, links array<struct<href:string,text:string>>, images array<string>", useArrow=False)
    def parse(base: str | None, html: str | None) -> tuple:
        p = _Links()
        p.feed(html or "")
        p.close()
        return " ".join(" ".join(p.text).split()), [(h, " ".join(t.split())) for h, t in p.links], [resolved(base or "", x) for x in [*p.images, *script_addresses(html or "")]]

    return pages.select("page_id", parse.asNondeterministic()("url", "html").alias("x")).select("page_id", "x.*")


def extract_links(pages: DataFrame) -> DataFrame:
    """Links of pages in order, without helper labels."""
    return parse_pages(pages).select("page_id", F.posexplode("links").alias("position", "x")).select("page_id", "position", "x.href", "x.text").filter(~F.lower("text").isin(*HELPERS))


def page_flags(pages: DataFrame, words: tuple[str, ...] = ("premium", "early access", "locked")) -> DataFrame:
    """Whether a page's visible text names a lock or holds a template placeholder, and its links to no item."""
    text = F.lower("text")
    helpers = F.size(F.filter("links", lambda x: F.lower(x["text"]).isin(*HELPERS))).cast("long")
    return parse_pages(pages).select("page_id", text.rlike("|".join(words)).alias("locked"), text.rlike(r"\{\{\s*(number|date)\s*\}\}").alias("template"), helpers.alias("n_helpers"))


def page_count_hint(pages: DataFrame) -> DataFrame:
    """Whether a page links to the one after it (query parameter page; without one a page is the first)."""
    own = F.coalesce(F.try_parse_url(C("url"), F.lit("QUERY"), F.lit("page")).try_cast("int"), F.lit(1))
    linked = F.exists("links", lambda x: F.regexp_extract(x["href"], r"[?&]page=(\d+)", 1) == C("__next"))
    return pages.select("page_id", (own + 1).cast("string").alias("__next")).join(parse_pages(pages), "page_id").select("page_id", linked.alias("has_next"))


def extract_image_urls(pages: DataFrame) -> DataFrame:
    """Page images of pages (page_id, html) in order, first of equal ones."""
    rows = parse_pages(pages).select("page_id", F.posexplode("images").alias("position", "url")).filter(T.is_page_image(C("url")))
    return dedupe_first(rows, ["page_id", "url"], "position")


@F.udtf(returnType="position int, href string, text string")
class HtmlLinks:
    """The links of one page in order, for LATERAL html_links(html); none for a null page."""

    def eval(self, html: str) -> Iterator[tuple]:
        p = _Links()
        p.feed(html or "")
        p.close()
        for i, (href, text) in enumerate(p.links):
            yield i, href, " ".join(text.split())


@F.udtf(returnType="position int, url string")
class HtmlImages:
    """The images of one page, resolved against its address, for LATERAL html_images(html, url)."""

    def eval(self, html: str, url: str) -> Iterator[tuple]:
        p = _Links()
        p.feed(html or "")
        p.close()
        for i, x in enumerate([*p.images, *script_addresses(html or "")]):
            yield i, resolved(url or "", x)


def register_page_functions(spark: SparkSession) -> None:
    """html_links(html) and html_images(html, url) for SQL."""
    spark.udtf.register("html_links", HtmlLinks)
    spark.udtf.register("html_images", HtmlImages)

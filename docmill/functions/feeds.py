"""Feed entries from XML text, by ``from_xml``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import _col, clean_content, squeeze
from docmill.functions.times import lenient_timestamp

ITEM = (
    "title STRING, link STRING, guid STRING, description STRING, `content:encoded` STRING, pubDate STRING, author STRING, `dc:creator` STRING, category ARRAY<STRING>, "
    "enclosure STRUCT<_url: STRING, _type: STRING, _length: STRING>"
)
ENTRY = (
    "id STRING, title STRUCT<_VALUE: STRING, _type: STRING>, link ARRAY<STRUCT<_href: STRING, _rel: STRING, _type: STRING>>, summary STRUCT<_VALUE: STRING, _type: STRING>, "
    "content STRUCT<_VALUE: STRING, _type: STRING>, updated STRING, published STRING, author ARRAY<STRUCT<name: STRING>>, category ARRAY<STRUCT<_term: STRING>>"
)
#: RSS has its items in a channel, Atom its entries at the top.
FEED = f"channel STRUCT<title: STRING, link: STRING, item: ARRAY<STRUCT<{ITEM}>>>, entry ARRAY<STRUCT<{ENTRY}>>"


def entries(df: DataFrame, xml_col: str) -> DataFrame:
    """One row for each entry of each feed, RSS or Atom: id, title, link, content, is_html, published, author, tags, media_url. Feeds that can't be read give none."""
    feed = df.select(F.from_xml(_col(xml_col), FEED).alias("f"))
    return rss_items(feed.select(F.explode("f.channel.item").alias("e"))).unionByName(atom_entries(feed.select(F.explode("f.entry").alias("e"))))


def some(*values: Column) -> Column:
    """The first that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def standard_entry(id: Column, title: Column, link: Column, body: Column, published: Column, author: Column, tags: Column, media: Column) -> list[Column]:
    text = squeeze(F.regexp_replace(body, "<[^>]+>", " "))
    time = F.coalesce(F.date_format(lenient_timestamp(published), "yyyy-MM-dd HH:mm:ss"), published)
    return [
        id.alias("id"), title.alias("title"), link.alias("link"), text.alias("content"), F.coalesce(F.contains(body, F.lit("<")), F.lit(False)).alias("is_html"),
        time.alias("published"), author.alias("author"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), media.alias("media_url"),
    ]


def rss_items(items: DataFrame) -> DataFrame:
    e = F.col("e")
    return items.select(*standard_entry(
        some(e["guid"], e["link"], e["title"]), some(e["title"]), some(e["link"]), some(e["content:encoded"], e["description"]), e["pubDate"],
        some(e["author"], e["dc:creator"]), e["category"], e["enclosure"]["_url"],
    ))


def atom_entries(entries: DataFrame) -> DataFrame:
    e = F.col("e")
    of = lambda *kinds: F.get(F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")).isin(*kinds)), F.lit(0))["_href"]
    link, title = some(of("alternate"), F.get(e["link"], F.lit(0))["_href"]), some(e["title"]["_VALUE"])
    return entries.select(*standard_entry(
        some(e["id"], link, title), title, link, some(e["content"]["_VALUE"], e["summary"]["_VALUE"]), F.coalesce(e["published"], e["updated"]),
        some(F.get(e["author"], F.lit(0))["name"]), F.transform(e["category"], lambda c: c["_term"]), of("enclosure"),
    ))


def standard_item(items: DataFrame, source: dict[str, object], least: int = 100, most: int = 100_000) -> DataFrame:
    """Items of any reader under the common names, with their source; contents are cleaned, and items whose content is too short or too long go.

    content falls back on description, pub_date on published and date; columns that are missing count as empty.
    """
    has = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in items.columns), F.lit(""))
    out = items.select(
        F.lit(source.get("name", "unknown")).alias("source_name"), F.lit(source.get("type", "unknown")).alias("source_type"), F.lit(source.get("url", "")).alias("source_url"),
        has("title").alias("title"), clean_content(has("content", "description")).alias("content"), has("link").alias("link"), has("pub_date", "published", "date").alias("pub_date"),
        F.array(*map(F.lit, source.get("tags", ()))).cast("array<string>").alias("tags"), F.lit(source.get("category", "")).alias("category"),
    )
    return out.where(F.length("content").between(least, most))


def valid_entry(title: str = "title", link: str = "link") -> F.Column:
    """A title or link of five characters or more; a link is http(s)."""
    text = F.trim(F.coalesce(F.nullif(F.col(title), F.lit("")), F.col(link), F.lit("")))
    address = F.coalesce(F.col(link), F.lit(""))
    return (F.length(text) >= 5) & ((address == "") | address.rlike("^https?://"))

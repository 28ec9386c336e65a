"""Parsed articles, the article map and capture times as four tables; extraction of raw pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.functions import arrays, html
from tidings.operators.joins import attach_capture_times, drop_matching
from tidings.operators.predicates import articles_with_release_link, is_release_link
from tidings.plans.shape import hold


def extract_articles(
    raw: DataFrame, fetched: DataFrame | None = None, key: str = "article_url", page: str = "html",
    blocked_domains: Sequence[str] = (),
) -> DataFrame:
    """Raw pages to text and marked links, skipping what was extracted before."""
    todo = drop_matching(raw, fetched, [key]) if fetched is not None else raw
    # held: a filter on the links must not parse the pages again
    parsed = hold(todo, _d=html.links_with_offsets(page)).withColumns(
        {
            "article_text": F.col("_d.article_text"),
            "links": F.transform(
                "_d.links",
                lambda x: x.withField("is_press_release", is_release_link(x["href"], x["text"], blocked_domains)),
            ),
        }
    )
    return parsed.drop("_d", page)


def release_articles(parsed: DataFrame, blocked_domains: Sequence[str] = ()) -> DataFrame:
    """The extracted articles that link to a press release."""
    return articles_with_release_link(parsed, "links", blocked_domains)


def combined_tables(
    articles: DataFrame,
    captures: DataFrame,
    article_map: DataFrame,
    sites: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """The four tables: article map, article data, entities and links, one row each."""
    timed = attach_capture_times(articles, captures, article_map, "article_url", sites)
    data = timed.withColumnRenamed("article_url", "common_crawl_url")
    if "article_authors" in data.columns:
        data = data.withColumn("article_authors", arrays.join_authors(F.col("article_authors")))
    source = ["source"] if "source" in articles.columns else []
    ents = articles.select(F.col("article_url").alias("common_crawl_url"), F.explode("ents").alias("ents"), *source)
    links = articles.select("article_url", F.explode("links").alias("_l"), *source)
    return {
        "article_map": article_map,
        "article_data": data.drop("ents", "links", "article_video"),
        "article_ents": ents.where(F.col("ents").isNotNull()),
        "article_to_href": links.select("article_url", "_l.*", *source),
    }


def explode_links(articles: DataFrame, key: str = "article_url", links: str = "links") -> DataFrame:
    """One row per link of each article, articles made distinct first."""
    return articles.dropDuplicates([key]).select(key, F.inline(links))


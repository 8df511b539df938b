"""From pages to links: extraction, filters, de-duplication on the page and over the crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions import urls
from crawlweave.functions.html import LINK, anchor_batches

NO_PAGE = r"^(tel|skype|fb|javascript):"


def hrefs(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(page_id, url, pos, href) of the anchors, by regular expression in the JVM: the cheap path when only addresses count."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""))
    return pages.where(F.col(html).isNotNull()).select(F.col(page_id), F.col(url), F.posexplode(found).alias("pos", "href"))


def extract(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(page_id, page_url, base, pos, href, attrs, inside_text): every anchor with an href, in document order.

    Null and empty pages have none. The page's `<base href>` counts when it stands in its first 4096 characters.
    """
    src = pages.where(F.col(html).isNotNull()).select(F.col(page_id).alias("page_id"), F.col(url).alias("page_url"), urls.base_url(F.col(html), F.col(url)).alias("base"), F.col(html).alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    found = src.mapInArrow(anchor_batches, f"{kinds}, links array<{LINK}>")
    return found.select("page_id", "page_url", "base", F.explode("links").alias("l")).select("page_id", "page_url", "base", "l.*")


def usable(links: DataFrame, exact: bool = False) -> DataFrame:
    """Resolve and filter extracted links; adds `url` and `js`, drops `href` and `base`.

    No mailto anywhere in the href; script links give the address in them, other `tel: skype: fb: javascript:` links
    and addresses of ignored file types are dropped. `exact`: RFC 3986 resolution for every link.
    """
    target = urls.js_target(F.col("href"))
    named = links.where(~F.col("href").contains("mailto:")).withColumn("js", F.when(target.isNotNull(), True)).withColumn("href", F.coalesce(target, F.col("href")))
    kept = named.where(~F.col("href").rlike(NO_PAGE))
    to = urls.resolve_exact(F.col("base"), F.col("href")) if exact else urls.resolve(F.col("base"), F.col("href"))
    return kept.withColumn("url", to).where(~urls.ignored_extension(F.col("url"))).drop("href", "base")


def page_links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", domain: str | None = None, same_domain: bool = False) -> DataFrame:
    """Links of pages with `domain_from` and `domain_to`; with `same_domain` only those that stay on the domain."""
    out = usable(extract(pages, page_id, url, html))
    out = out.withColumn("domain_from", urls.registered_domain(F.col("page_url"))).withColumn("domain_to", urls.registered_domain(F.col("url")))
    return out.where(F.col("domain_to") == F.col("domain_from")) if same_domain else out


def first_on_page(links: DataFrame, key: Column, page: str, pos: str) -> DataFrame:
    """The first link of every address on its page (an experience's choices). Null keys are dropped."""
    w = Window.partitionBy(page, "__key").orderBy(pos)
    return links.withColumn("__key", key).where("__key is not null").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__key", "__rn")


def first_in_crawl(links: DataFrame, key: Column, order: str) -> DataFrame:
    """The first link of every address in the crawl (the requests). The smallest row is merged map-side, so a
    frequent address is no hot task. Null keys are dropped."""
    keyed = links.withColumn("__key", key).where("__key is not null")
    row = F.struct(*[F.col(c) for c in links.columns if not c.startswith("__")])
    return keyed.groupBy("__key").agg(F.min_by(row, F.col(order)).alias("r")).select("r.*")


def unseen(links: DataFrame, key: Column, seen: DataFrame, seen_key: str) -> DataFrame:
    """Links whose key is not among those of earlier batches."""
    return links.withColumn("__key", key).join(seen.select(F.col(seen_key).alias("__key")).distinct(), "__key", "left_anti").drop("__key")


def fingerprint(method: Column, url: Column, body: Column | None = None) -> Column:
    """A request's identity: method, canonical address and body."""
    return F.sha1(F.concat_ws("\n", method, urls.canonical(url), body if body is not None else F.lit("")))


def new_requests(requests: DataFrame, done: DataFrame, run: str | None = None) -> DataFrame:
    """Requests that were not made before, unless marked `dont_filter`; with `run`, each run has a history of its own."""
    keys = [run, "fingerprint"] if run else ["fingerprint"]
    fresh = requests.where(~F.col("dont_filter")).join(done.select(*keys).distinct(), keys, "left_anti")
    return requests.where(F.col("dont_filter")).select(*requests.columns).unionByName(fresh.select(*requests.columns))


def mark_members(links: DataFrame, key: Column, members: DataFrame, member_key: str, flag: str) -> DataFrame:
    """A boolean column: whether the key is among the members (pagination links and the like)."""
    m = members.select(F.col(member_key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    return links.withColumn("__key", key).join(m, "__key", "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def to_requests(links: DataFrame, score: Column, slot: Column, run: Column | None = None) -> DataFrame:
    """Links as requests: slot, address, fixed-point priority, depth and flags."""
    from crawlweave.functions.numeric import score_to_priority

    return links.select("url", slot.alias("slot"), score_to_priority(score).alias("priority"), F.lit(False).alias("is_seed"), F.lit(False).alias("removed"), (run if run is not None else F.lit("run-0")).alias("run_id"))

"""URL filters (7, native): block decisions shared by redirect-equivalent urls.

A url's own rule comes first.  Urls joined by redirects (meta refresh, or a
table of observed redirects) and by canonical links are one class: connected
components over 63-bit url hashes, in a few joins a round.  A url without a rule
takes the class's verdict; an explicit allow in the class beats every block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, apart, ascii_lower, components

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does.

    The list is a parameter of a filter, so it becomes one expression.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def url_key(url: Column) -> Column:
    """Hash of a url without its fragment, host in lower case."""
    bare = F.regexp_extract(url, r"^[^#]*", 0)
    at = F.locate("://", bare)
    return F.shiftrightunsigned(F.xxhash64(F.when(at > 0, F.concat(
        ascii_lower(F.substring(bare, F.lit(1), at + 2)), host_of(bare), F.regexp_extract(_rest(bare), r"(?s)^[^/?#]*(.*)", 1))).otherwise(bare)), 1)


def _absolute(base: Column, link: Column) -> Column:
    """A link of the page ``base`` as a full url; links relative to a folder are resolved in it."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    top = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    return (F.when(link == "", None).when(F.contains(link, F.lit("://")), link)
            .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(top, link))
            .otherwise(F.concat(top, F.when(folder == "", "/").otherwise(folder), link)))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) for canonical links and meta refreshes in ``html``."""
    maybe = pages.where("url is not null and html is not null").where(F.col("html").rlike("(?i)canonical|http-equiv"))
    def tags(pattern: str, inner: str) -> Column:
        found = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
        return F.transform(found, lambda t: F.replace(F.regexp_extract(t, inner, 1), F.lit("&amp;"), F.lit("&")))
    links = maybe.select("url", F.explode(F.concat(tags(_CANONICAL, _HREF), tags(_REFRESH, _URL))).alias("link"))
    return links.select("url", _absolute(F.col("url"), F.col("link")).alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, url, host, path, rule, verdict, aliased.

    Needs ``page_id``, ``url``, ``html``; ``redirects`` may add (url, target)
    rows.  Null urls and urls without ``://`` have an empty host and path, fit no
    rule, belong to no class and take ``default``.  Repeated rows are judged
    alike.  ``aliased`` says that the verdict came from the class.  A link's
    target takes part with its own rule, also if it is no page.  Other columns
    are ignored.  An empty table gives an empty table.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = page_links(base)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target").where("url is not null and target is not null"))
    links = scratch.table(links)
    comps = components(links.select(url_key(F.col("url")).alias("a"), url_key(F.col("target")).alias("b")), scratch)
    def judged(df: DataFrame, url: str) -> DataFrame:
        return df.select(url_key(F.col(url)).alias("node"), rule_of(host_of(F.col(url)), path_of(F.col(url)), rules)[1].alias("v"))
    # both ends of every link carry their rule into the class
    ends = judged(links, "url").unionByName(judged(links, "target")).where("v is not null").distinct()
    verdicts = (ends.join(comps, "node").groupBy("component")
                .agg(F.min("v").alias("class_verdict")))  # 'allow' sorts before 'block'
    named = comps.join(apart(verdicts), "component").select(F.col("node").alias("_llm_key"), "class_verdict")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = base.select("page_id", "url", host.alias("host"), path.alias("path"), url_key(F.col("url")).alias("k")).select(
        "*", rule.alias("rule"), verdict.alias("own_verdict"))
    out = own.join(apart(named), F.col("k") == F.col("_llm_key"), "left")
    return out.select("page_id", "url", "host", "path", "rule",
                      F.coalesce("own_verdict", "class_verdict", F.lit(default)).alias("verdict"),
                      (F.col("own_verdict").isNull() & F.col("class_verdict").isNotNull()).alias("aliased"))

"""URL filter with redirect equivalence (operator 7).  DataFrame functions only.

Every page's URL, and every URL that a page names as its canonical address or
redirects to, is a node; canonical links and redirects are edges.  A URL's own
rule decides it (the longest rule that fits).  A URL without a rule takes part
in its connected component: if a rule blocks any URL of it, the block reaches
the URL; an explicit allow stands against that for the URL it fits.  Any other
URL is allowed.

Nodes are URLs without scheme and fragment, host in lower case.  Rules are a
short list, tried in order inside one expression; components are found by
distributed star rounds (``graph``), and without edges no round runs.

Edge cases: a null URL, or one without ``://``, has empty host and path and is
no node; null or empty html has no edges; a link to the page itself is no edge;
repeated rows are judged row by row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import ascii_lower, with_columns_of, written
from .graph import connected_components

_ATTR = r"\s*=\s*[\"']?\s*"
# href of <link rel=canonical>, in either order of the attributes
CANONICAL = r"(?is)<link\b(?=[^>]*\brel" + _ATTR + r"canonical\b)[^>]*?\bhref" + _ATTR + r"([^\"'\s>]+)"
REFRESH = (r"(?is)<meta\b(?=[^>]*\bhttp-equiv" + _ATTR + r"refresh\b)[^>]*?\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*['\"]?\s*"
           r"([^\"'\s>]+)")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The URL without scheme and fragment; null where it is no node."""
    tail = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1), "^(?!/)", "/")
    return F.when(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1) != "", F.concat(host_of(url), tail))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct with rule and verdict of the longest fitting rule, else null.  ``rules``
    are (verdict, host, path); of equally long ones the longer host wins, then
    allow."""
    first = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "allow"))
    table = F.array(*[F.struct(F.lit(h).alias("h"), F.lit("." + h).alias("sub"), F.lit(p).alias("p"),
                               F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in first])
    return F.get(F.filter(table, lambda r: ((host == r["h"]) | F.endswith(host, r["sub"])) &
                          F.startswith(path, r["p"])), 0)


def _target(base: Column, link: Column) -> Column:
    """A link's URL: absolute, scheme-relative, or from the root or folder."""
    link = F.regexp_replace(link, "(?i)&amp;", "&")
    host, folder = host_of(base), F.regexp_extract(path_of(base), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (F.when(link.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), link)
            .when(F.startswith(link, F.lit("//")), F.concat(F.lit("http:"), link))
            .when(F.startswith(link, F.lit("/")), F.concat(F.lit("http://"), host, link))
            .when(link.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("http://"), host, folder, link)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): nodes joined by a canonical link or a redirect."""
    html = F.regexp_replace(F.col("html"), r"(?s)<!--.*?-->|(?i)<script\b.*?</script\s*>", "")
    near = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", html.alias("html"))
    links = near.select("url", F.explode(F.array(
        F.regexp_extract("html", CANONICAL, 1), F.regexp_extract("html", REFRESH, 1))).alias("link")).filter("link <> ''")
    links = written(links, "url-links")
    return links.select(node_of(F.col("url")).alias("u"), node_of(_target(F.col("url"), F.col("link"))).alias("v")).filter(
        "u is not null and v is not null and u <> v")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.  ``edges`` adds (u, v)
    URL pairs known from elsewhere, such as a crawl's redirect log."""
    rows = with_columns_of(pages, ["page_id", "url", "html"]).select(
        "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = alias_edges(rows)
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("u")).alias("u"), node_of(F.col("v")).alias("v")))
    comps = connected_components(links)
    # components with a blocked URL (a node's own host and path decide it)
    url = F.concat(F.lit("http://"), F.col("node"))
    blocked = comps.filter(rule_of(host_of(url), path_of(url), rules)["verdict"] == "block").select("component").distinct()
    reached = written(comps.join(blocked, "component").select("node").distinct(), "url-blocked")
    judged = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    columns = ["page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
               F.col("own.rule").alias("rule")]
    if reached.isEmpty():
        return judged.select(*columns, F.coalesce("own.verdict", F.lit("allow")).alias("verdict"))
    judged = judged.join(reached.withColumn("alias_blocked", F.lit(True)), node_of(F.col("url")) == F.col("node"), "left")
    return judged.select(*columns, F.coalesce(
        "own.verdict", F.when(F.col("alias_blocked"), "block").otherwise("allow")).alias("verdict"))

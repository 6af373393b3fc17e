"""Operator 2: URL filters with redirect equivalence (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.llm.common import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical["'\s/>])[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh["'\s/>])[^>]*\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``pattern`` is host and path, like ``example.net/en/``; it covers subdomains and longer paths."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].translate(str.maketrans(_UPPER, _LOWER))

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """A url's name in the graph: scheme and host in lower case, no fragment, a bare host gets ``/``; null where there is no host."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host_of(url), rest))


def resolved(base: Column, href: Column) -> Column:
    """A link's target against its page: absolute, ``//host``, ``/path``, ``?query`` and path-relative links."""
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    scheme, origin = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = path_of(base)
    folder = F.regexp_extract(F.when(path == "", F.lit("/")).otherwise(path), r"(?s)^(.*/)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .otherwise(F.concat(origin, folder, href))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The redirect (meta refresh) and canonical-link edges of a page table, as (src, dst) nodes."""
    found = pages.select(F.col(url).alias("u"), F.regexp_extract(html, CANONICAL, 1).alias("c"), F.regexp_extract(html, REFRESH, 1).alias("r"))
    found = found.where("c <> '' or r <> ''").select("u", F.explode(F.array("c", "r")).alias("to")).where("to <> ''")
    return found.select(node_of(F.col("u")).alias("src"), node_of(resolved(F.col("u"), F.col("to"))).alias("dst")).where("src is not null and dst is not null")


def own_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, allow before block at equal length; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Judge every page by rules, and pages without a rule by their aliases.

    ``edges`` are further redirects as (src, dst) urls; the links in the pages' own html are always used.
    Urls joined by such edges, pages or not, form a group. A page with a rule keeps its verdict (so an
    explicit allow is never overruled). A page without one is blocked if its group holds a blocked url
    and no explicitly allowed one, else allowed.

    Returns the key, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``. Defined cases: a null
    url or one without ``://`` has empty host and path, no rule and no aliases, and is allowed; null html has
    no links; repeated rows are judged each; an empty table gives an empty result; other columns are not read.

    The group table has one row a url in an edge, and verdicts combine before their shuffle; the page
    side of the last join is the one that may be skewed, which adaptive execution can split.
    """
    edge = links(pages, url, html)
    if edges is not None:
        edge = edge.unionAll(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    groups = components(edge, "src", "dst", native=True)
    ruled = groups.withColumn("own", own_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    verdicts = ruled.groupBy("component").agg(F.max(F.coalesce(F.col("own") == "block", F.lit(False))).alias("bad"), F.max(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("good"))
    blocked = groups.join(verdicts.where("bad and not good"), "component", "left_semi").select("node")
    u = F.col(url)
    rows = pages.select(F.col(key), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node")).withColumn("own", own_rule(F.col("host"), F.col("path"), rules))
    return rows.join(blocked.withColumn("alias", F.lit("block")), "node", "left").select(
        key, "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias", F.lit("allow")).alias("verdict")
    )

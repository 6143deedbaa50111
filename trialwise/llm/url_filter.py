"""Operator 9, URL filters. DataFrame functions only.

Host and path rules judge each url; redirects and canonical links join urls to aliases, and the components of
that graph carry block decisions to aliases that no rule judges. An explicit allow rule of a url always stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags that may declare where a page lives, and an url's scheme.
TAG, SCHEME = r"(?is)<(?:link|meta)\b[^<>]*>", r"[A-Za-z][A-Za-z0-9+.\-]*"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first :// up to / ? # or end, A-Z lower-cased; then up to ? # or end. Without ://, both empty."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(u, locate('://', u) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in either quotes or none; empty if there is none."""
    value = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.regexp_replace(F.concat(*[F.regexp_extract(tag, value, i) for i in (1, 2, 3)]), r"&(amp|#38|#[xX]26);", "&"))


def declared_links(html: Column) -> Column:
    """Array of the targets that a page declares as its own place, as written: canonical links, refreshes and og:url, every one."""

    def target(tag):
        link = F.rlike(tag, F.lit(r"(?i)^<link"))
        canonical = link & F.rlike(_attribute(tag, "rel"), F.lit(r"(?i)(^|\s)canonical(\s|$)"))
        refresh = ~link & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
        og = ~link & (F.lower(_attribute(tag, "property")) == "og:url")
        later = F.trim(F.regexp_extract(_attribute(tag, "content"), r"""(?i)url\s*=\s*['"]?([^'"]*)""", 1))
        return F.when(canonical, _attribute(tag, "href")).when(refresh, later).when(og, _attribute(tag, "content")).otherwise(F.lit(""))

    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(TAG), 0), target), lambda x: x != "")


def resolve(target: Column, url: Column) -> Column:
    """The whole url that a target means on a page: absolute, //host, /path, ?query and relative ones (dot segments stay). Fragments, other schemes and
    pages without scheme: null."""
    scheme, origin = F.regexp_extract(url, f"^({SCHEME})://", 1), F.regexp_extract(url, f"^({SCHEME}://[^/?#]*)", 1)
    page, folder = F.regexp_extract(url, "^([^?#]*)", 1), F.regexp_extract(url, f"^({SCHEME}://[^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    whole = (
        F.when(F.rlike(target, F.lit(f"^{SCHEME}://")), target)
        .when(F.rlike(target, F.lit(f"^(#|$|{SCHEME}:)")) | (scheme == ""), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .when(F.startswith(target, F.lit("?")), F.concat(page, target))
        .otherwise(F.concat(folder, target))
    )
    return node(whole)


def node(url: Column) -> Column:
    """What stands for an url among aliases: the url without its fragment."""
    return F.regexp_extract(url, "^([^#]*)", 1)


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES, key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """(key, host, path, rule, verdict, component, inherited): one row per row of pages.

    Edges are redirects (from_url, to_url) and the links that pages declare: canonical, refresh, og:url. Nothing else joins urls. verdict is the rule's;
    without a rule, block if a url of its component is blocked by rule (inherited), else allow: an allow rule always stands. component is
    the least url of those joined, null for an url that nothing joins. Null urls, and urls without
    ://, have empty host and path, fit no rule and are alone: allow. Equal urls get equal verdicts, whatever keys repeat. A
    redirect's urls need not be pages; they carry decisions of their own rules. Null html declares nothing. Empty table: no rows. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    base = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), *([F.col(html).alias("h")] if html and html in pages.columns else [F.lit("").alias("h")]))
    seen = base.where(F.locate("://", F.col("u")) > 0).select("u", F.explode(declared_links(F.coalesce("h", F.lit("")))).alias("to"))
    pairs = seen.select(node(F.col("u")).alias("a"), resolve(F.col("to"), F.col("u")).alias("b"))
    if redirects is not None:
        pairs = pairs.union(redirects.select(node(F.col("from_url")), node(F.col("to_url"))))
    edges = scratch.write(pairs.where("a is not null and b is not null and a <> b").distinct())
    # urls themselves are the nodes: no hash that two might share
    component = scratch.write(connected_components(edges, scratch))
    host, path = split_url(F.col("u"))
    rule, verdict = judge(host, path, rules)
    ruled = component.withColumn("u", F.col("node")).withColumn("ruled", verdict)
    blocked = ruled.groupBy("component").agg(F.max(F.coalesce(F.col("ruled") == "block", F.lit(False))).alias("blocked"))
    # one row per url that something joins
    known = scratch.write(component.join(blocked, "component").select(F.col("node").alias("at"), "component", "blocked"))
    out = base.select("k", F.coalesce("u", F.lit("")).alias("u"), F.when(F.locate("://", F.col("u")) > 0, node(F.col("u"))).alias("own"))
    out = out.join(known, F.col("own") == F.col("at"), "left").withColumn("rule", rule).withColumn("ruled", verdict)
    inherited = F.col("ruled").isNull() & F.coalesce("blocked", F.lit(False))
    return out.select(F.col("k").alias(key), host.alias("host"), path.alias("path"), "rule", F.coalesce("ruled", F.when(inherited, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "component", inherited.alias("inherited"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "inherited")

"""7. URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, then full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 8  # of the hexadecimal SHA-256, 4 bytes


def canonical(url: Column) -> Column:
    """Lower-case host without credentials, port and surrounding dots; path with single slashes; query; no fragment."""
    plain = F.regexp_replace(F.trim(url), r"[\t\r\n]", "")
    bare = F.regexp_replace(F.regexp_replace(plain, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(bare, r"^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")), r"\.{2,}", "."), r"^\.+|\.+$", "")
    rest = F.substring(bare, F.length(authority) + 1, F.length(bare))
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/{2,}", "/")
    return F.struct(host.alias("host"), F.when(path == "", F.lit("/")).otherwise(path).alias("path"), F.regexp_extract(rest, r"^[^?]*(\?.*)$", 1).alias("query"))


def expressions(u: Column) -> Column:
    """All (expression, host labels, path length) of a canonical URL: each suffix of two labels or more of the host
    (of an address, all its labels numbers, only the whole), with the path and query, the path, and each of its directories."""
    labels = F.split(u["host"], r"\.")
    n = F.size(labels)
    address = u["host"].rlike(r"^(\d+(\.\d+)*|\[.*\])$")
    hosts = F.when(address | (n < 2), F.array(u["host"])).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    )
    pieces = F.split(u["path"], "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(pieces, F.lit(1), i), "/"), F.lit("/")))
    paths = F.array_distinct(F.concat(F.array(F.concat(u["path"], u["query"]), u["path"]), folders))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(F.concat(h, p).alias("expr"), F.size(F.split(h, r"\.")).alias("labels"), F.length(p).alias("depth")))))


def digests(rules: DataFrame) -> DataFrame:
    """Rules (expr, action) as (prefix, digest, rule, action), in the canonical form of URLs: "Example.com" is
    "example.com/". Null and hostless rules say nothing; of one that is there twice 'allow' holds. Percent-encoded
    characters are compared as they are written, on both sides."""
    told = rules.filter("expr is not null and action is not null").select(canonical(F.col("expr")).alias("u"), "action").filter("u.host <> ''")
    known = told.groupBy(F.concat("u.host", "u.path", "u.query").alias("expr")).agg(F.min("action").alias("action"))
    digest = F.sha2("expr", 256)
    return known.select(F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"), digest.alias("digest"), F.col("expr").alias("rule"), "action")


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row a page: (page_id, url, action, rule), action 'allow' or 'block'.

    Of the matching rules the one with most host labels holds, then the one with the longest path, then 'allow' before
    'block'; without a match the page is allowed and ``rule`` is null. Expressions meet rules by equality of the first
    32 bits of their SHA-256, which keeps the join narrow; whole digests then confirm. All suffixes and directories
    are tried, without a limit on their number.

    Null, blank and hostless URLs match nothing. Rows that repeat are one row each. A null page_id stays null. Extra
    columns are ignored. Without rules everything is allowed.
    """
    rows = pages.select("page_id", "url")
    urls = rows.select("url").filter("url is not null").distinct().withColumn("u", canonical(F.col("url"))).filter("u.host <> ''")
    asked = urls.select("url", F.explode(F.array_distinct(expressions(F.col("u")))).alias("e")).select("url", F.sha2("e.expr", 256).alias("asked"), "e.labels", "e.depth")
    found = asked.withColumn("prefix", F.substring("asked", 1, PREFIX_DIGITS)).join(digests(rules), "prefix").filter("asked = digest")
    best = found.groupBy("url").agg(F.max_by(F.struct("action", "rule"), F.struct("labels", "depth", (F.col("action") == "allow").alias("allow"))).alias("best"))
    return rows.join(best.select("url", "best.*"), "url", "left").select("page_id", "url", F.coalesce("action", F.lit("allow")).alias("action"), "rule")


def rules_from(pages: DataFrame) -> DataFrame:
    """A rule list for tables that come without one, from their hosts and directories by a hash: about an eighth of the
    sites are blocked, and directories under sites are allowed or blocked again."""
    u = pages.filter("url is not null").select(canonical(F.col("url")).alias("u")).filter("u.host <> ''").select(F.col("u.host").alias("host"), F.split(F.col("u.path"), "/").alias("p")).distinct()
    site = F.concat(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1), F.lit("/"))
    folder = F.when(F.size("p") > 2, F.concat(F.col("host"), F.lit("/"), F.element_at("p", 2), F.lit("/")))
    exprs = u.select(F.explode(F.array(F.struct(site.alias("expr"), F.lit(1).alias("kind")), F.struct(folder.alias("expr"), F.lit(2).alias("kind")))).alias("x")).select("x.*").filter("expr is not null and expr <> '/'").distinct()
    digit = F.substring(F.md5("expr"), 1, 1)
    return exprs.select("expr", F.when(digit.isin("0", "1"), F.lit("block")).when((F.col("kind") == 2) & digit.isin("2", "3", "4"), F.lit("allow")).alias("action")).filter("action is not null")

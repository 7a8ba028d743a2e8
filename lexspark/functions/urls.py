"""URL functions as column expressions: parts, canonical form, deny list, scope."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import tables

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
EMPTY = "array<struct<key:string,value:string>>"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, AUTHORITY, 1)


def host(url: Column) -> Column:
    """Host name in lower case, without user and port; null if there is none."""
    name = F.lower(F.regexp_extract(F.regexp_replace(authority(url), "^.*@", ""), r"^\[?([^\]:]*)", 1))
    return F.when(name != "", name)


def domain(url: Column) -> Column:
    """Host, else the whole authority, else ``unknown``."""
    return F.lower(F.coalesce(host(url), F.when(authority(url) != "", authority(url)), F.lit("unknown")))


def domain_with_port(url: Column) -> Column:
    """What stands between :// and the next slash: port and user stay."""
    return F.substring_index(F.substring_index(url, "://", -1), "/", 1)


def path(url: Column) -> Column:
    """Path without the last segment's ;parameters."""
    whole = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(whole, r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def _decoded(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), F.translate(part, "+", " "))


def query_pairs(url: Column) -> Column:
    """Query as an array of (key, value), decoded, in order; a key without = has an empty value."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("key"), _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value")))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def is_tracking(key: Column) -> Column:
    return F.startswith(F.lower(key), F.lit("utm_")) | F.lower(key).isin(*tables.TRACKING_PARAMS)


def normalize_url(url: Column) -> Column:
    """Canonical form, or null if the URL is not http(s) or has no host.

    Lower-case host, no default port, user, fragment or ;parameters; tracking parameters go, the
    others keep their order and are encoded anew; an empty path is /; the path's case stays.
    """
    u = F.trim(url)
    kind = scheme(u)
    bare = F.regexp_replace(authority(u), "^.*@", "")
    name = F.lower(F.regexp_extract(bare, r"^(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(bare, r":([0-9]+)$", 1)
    default = (port == "") | ((kind == "http") & (port.try_cast("int") == 80)) | ((kind == "https") & (port.try_cast("int") == 443))
    place = F.when(default, name).otherwise(F.concat(name, F.lit(":"), F.regexp_replace(port, "^0+(?=[0-9])", "")))
    kept = F.filter(query_pairs(u), lambda p: ~is_tracking(p["key"]))
    text = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")
    where = F.when(path(u) == "", "/").otherwise(path(u))
    out = F.concat(kind, F.lit("://"), place, where, F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))
    return F.when(kind.isin("http", "https") & (name != ""), out)


def canonical_url(url: Column) -> Column:
    """For admission: the query's parameters sorted, no fragment."""
    parts = F.array_join(F.array_sort(F.filter(F.split(query(url), "&"), lambda p: p != "")), "&")
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(parts == "", base).otherwise(F.concat(base, F.lit("?"), parts))


def namespace_patterns() -> list[str]:
    """Wiki namespaces as they stand in lower-case paths, plain and percent-encoded; longest first."""
    plain = [n + ":" for n in tables.NAMESPACES]
    coded = [quote(n, safe="_") + "%3A" for n in tables.NAMESPACES]
    return sorted({*(x.lower() for x in plain + coded), *tables.MORE_NAMESPACES}, key=lambda x: (-len(x), x))


def denied(url: Column) -> Column:
    """Why a URL is never fetched, or null: extension, query, namespace, junk path, in this order."""
    low = F.lower(path(url))
    low = F.when(low == "", "/").otherwise(low)
    last = F.substring_index(low, "/", -1)
    extension = F.when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1))
    reason = F.when(extension.isin(*tables.DENIED_EXTENSIONS), F.concat(F.lit("extension:."), extension))
    bad = F.filter(query_pairs(url), lambda p: F.lower(p["key"]).isin(*tables.DENIED_QUERY_KEYS) | ((F.lower(p["key"]) == "title") & F.startswith(F.lower(p["value"]), F.lit("special"))))
    first = F.lower(F.get(bad, F.lit(0))["key"])
    reason = reason.when(F.size(bad) > 0, F.when(first == "title", "query:title=Special").otherwise(F.concat(F.lit("query:"), first)))
    for pattern in namespace_patterns():
        reason = reason.when(F.contains(low, F.lit(pattern)), "namespace:" + pattern.rstrip(":"))
    for junk in tables.JUNK_PATHS:
        hit = F.startswith(low, F.lit(junk)) | (low == junk.rstrip("/")) if junk.endswith("/") else F.startswith(low, F.lit(junk + "/")) | (low == junk)
        reason = reason.when(hit, f"junk_path:{junk}")
    return reason


def keyword_hit(url: Column, anchor: Column, keywords: list[str] | None = None) -> Column:
    """Whether a keyword is part of the URL or the anchor, hyphens and underscores read as spaces too."""
    text = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(anchor, F.lit(""))))
    spaced = F.translate(text, "_-", "  ")
    hit = F.lit(False)
    for word in keywords if keywords is not None else tables.TOPIC_WORDS:
        low = word.lower()
        hit = hit | F.contains(text, F.lit(low)) | F.contains(spaced, F.lit(low.replace("_", " ").replace("-", " ")))
    return hit


MODES = {"domain": 3, "prefix": 2, "topical": 1}


def host_rules(seeds: DataFrame) -> DataFrame:
    """(host, mode, prefixes) from seeds (url, scope_mode): the most permissive mode wins; prefixes unite and are sorted."""
    mode = F.lower(F.trim(F.coalesce("scope_mode", F.lit("topical"))))
    mode = F.when(mode.isin(*MODES), mode).otherwise("topical")
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv)), F.col("mode"))
    where = path(F.trim("url"))
    rows = seeds.select(host(F.trim("url")).alias("host"), mode.alias("mode"), F.when(where == "", "/").otherwise(where).alias("path")).where("host IS NOT NULL").withColumn("rank", rank)
    merged = rows.groupBy("host").agg(F.max_by("mode", "rank").alias("mode"), F.array_sort(F.collect_set(F.when(F.col("mode") == "prefix", F.col("path")))).alias("prefixes"))
    return merged.withColumn("prefixes", F.when(F.col("mode") == "prefix", F.col("prefixes")).otherwise(F.array().cast("array<string>")))


def in_scope(links: DataFrame, rules: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Links (url, anchor, parent_topical, ...) with ``ok`` and ``reason`` under the host rules."""
    joined = links.withColumn("_host", host(F.col("url"))).join(rules.select(F.col("host").alias("_host"), F.col("mode").alias("_mode"), F.col("prefixes").alias("_prefixes")), "_host", "left")
    where = path(F.col("url"))
    where = F.when(where == "", "/").otherwise(where)
    inside = F.exists("_prefixes", lambda p: F.startswith(where, p))
    why = denied(F.col("url"))
    reason = (
        F.when(F.col("_mode").isNull(), "host_not_allowed")
        .when(why.isNotNull(), F.concat(F.lit("denied:"), why))
        .when(F.col("_mode") == "domain", "domain")
        .when((F.col("_mode") == "prefix") & inside, "prefix")
        .when(F.col("_mode") == "prefix", "prefix_miss")
        .when(F.coalesce("parent_topical", F.lit(False)), "topical_parent")
        .when(keyword_hit(F.col("url"), F.col("anchor"), keywords), "keyword")
        .otherwise("no_keyword")
    )
    return joined.withColumn("reason", reason).withColumn("ok", F.col("reason").isin("domain", "prefix", "topical_parent", "keyword")).drop("_host", "_mode", "_prefixes")


def redirect_rules(rules: DataFrame, redirects: DataFrame) -> DataFrame:
    """Rules with those that hosts inherit when a seed (depth 0) redirects to them (url, final_url)."""
    pairs = redirects.where("depth = 0").select(host(F.col("url")).alias("host"), host(F.col("final_url")).alias("target")).where("host <> target").distinct()
    derived = rules.join(pairs, "host").select(F.col("target").alias("host"), "mode", "prefixes")
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv)), F.col("mode"))
    every = rules.unionByName(derived).withColumn("_rank", rank)
    merged = every.groupBy("host").agg(F.max_by("mode", "_rank").alias("mode"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("prefixes")))).alias("prefixes"))
    return merged.withColumn("prefixes", F.when(F.col("mode") == "prefix", F.col("prefixes")).otherwise(F.array().cast("array<string>")))


def text_path(source: Column, domain_: Column, content_hash: Column) -> Column:
    """Where a page's text would be kept: source/domain/first two of the hash/first sixteen.txt."""
    safe = F.regexp_replace(domain_, r"[^A-Za-z0-9._\-]", "_")
    return F.concat_ws("/", source, safe, F.substring(content_hash, 1, 2), F.concat(F.substring(content_hash, 1, 16), F.lit(".txt")))

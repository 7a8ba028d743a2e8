"""URL filters: prefix rules, and link-graph propagation where no rule fits.

Rules give a page its verdict; a host's share of allowed or blocked pages makes it a
trusted or a distrusted seed. Personalised PageRank carries trust along links from trusted
hosts; distrust goes from blocked hosts against the direction of links, to hosts that link
to them. A host whose distrust exceeds its trust by ``threshold`` (a fully blocked host
without links has 1) is blocked.

Scale. Pages reduce to distinct host edges by partial aggregation; ranks are a table of
hosts, never collected, written each round to the shared folder; rounds stop when all that
is still to come adds at most ``tolerance``, after a number of rounds that grows with the
logarithm of the hosts. Pages meet their host's verdict in a plain join that adaptive
execution splits for a hot host. Rules are a short list kept by hand.

Defined results: a url that is null or has no ``://`` has empty host and path, fits no rule
and is allowed; a null html has no links; links inside a host do not count; repeated rows
give repeated results; other columns are not read; an empty table gives an empty result; pages
of any length are read whole, in time linear in their length; of rules of equal length the first
in alphabetical order wins.
"""

from __future__ import annotations

import itertools
import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.layout import spread
from lexspark.llm.markup import links as hrefs
from lexspark.storage import drop, kept

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Rule = tuple[str, str]
#: (verdict, host and path) as the query of the contract wants them.
RULES: list[Rule] = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
HOST = re.compile(r"^[^/?#]*?://([^/?#]*)")
LOWER = str.maketrans(UPPER, UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return host, F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    choice = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        of_host, _, of_path = rule.partition("/")
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit("/" + of_path))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, value) if choice is None else choice.when(fits, value)
    return choice if choice is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): how many pages of a host link to another host."""

    def run(batches):
        for part in batches:
            src, dst = [], []
            for url, host, page in zip(*(part.column(c).to_pylist() for c in ("url", "host", "html")), strict=True):
                found = set()
                for target in hrefs(page or ""):
                    if "//" not in target:
                        continue  # stays on its host
                    if target.startswith("//"):
                        try:
                            target = urljoin(url or "", target)
                        except ValueError:
                            continue
                    at = HOST.match(target)
                    if at and at[1]:
                        found.add(at[1].translate(LOWER))
                found.discard(host)
                src += [host] * len(found)
                dst += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], ["src", "dst"])

    edges = spread(pages.where("host <> ''").select("url", "host", "html")).mapInArrow(run, "src string, dst string")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("pages"))


def personalised_rank(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, most_rounds: int | None = None) -> DataFrame:
    """(host, rank) of seeds (host, seed) spread along edges (src, dst, pages); a seed of 1 without links keeps rank 1.

    Each round adds what the last one's change sends on, however little a host gets of it. What all
    later rounds can add, to all hosts together, is at most damping / (1 - damping) of the mass still
    moving; rounds stop when that is within ``tolerance``, or after ``most_rounds`` where given.
    """
    out_weight = edges.groupBy("src").agg(F.sum("pages").alias("total"))
    steps = kept(edges.join(out_weight, "src").select("src", "dst", (F.col("pages") / F.col("total") * damping).alias("share")), "steps")
    moving = kept(seeds.where("seed > 0").select("host", F.col("seed").alias("rank")), "moving")
    ranks = moving
    for _ in itertools.count() if most_rounds is None else range(most_rounds):
        sent = moving.join(steps, F.col("host") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("rank"))
        sent = kept(sent.where("rank > 0").select(F.col("dst").alias("host"), "rank"), "moving")
        mass = sent.agg(F.sum("rank").alias("mass")).first()["mass"]
        if not mass:
            break
        before, ranks = ranks, kept(ranks.unionByName(sent).groupBy("host").agg(F.sum("rank").alias("rank")), "ranks")
        for old in {id(before): before, id(moving): moving}.values():
            drop(old)
        moving = sent
        if mass * damping / (1 - damping) <= tolerance:
            break
    return ranks


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """Per row of pages (page_id, url, html): host, path, rule and verdict."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"), path.alias("path"))
    ruled = rows.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    share = lambda v: (F.count(F.when(F.col("r.verdict") == v, 1)) / F.count("*"))
    seeds = kept(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")), "seeds")
    edges = kept(host_links(rows), "links")
    trust = personalised_rank(seeds.select("host", F.col("trusted").alias("seed")), edges)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "pages")
    distrust = personalised_rank(seeds.select("host", F.col("blocked").alias("seed")), back)
    ranks = trust.select("host", "rank", F.lit(0.0).alias("bad")).unionByName(distrust.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("bad")))
    ranks = ranks.groupBy("host").agg(F.sum("rank").alias("trust"), F.sum("bad").alias("distrust"))
    hosts = kept(ranks.where(F.col("distrust") - F.col("trust") > threshold).select("host", F.lit("block").alias("by_graph")), "hosts")
    verdict = F.coalesce(F.col("r.verdict"), F.col("by_graph"), F.lit("allow"))
    return ruled.join(hosts, "host", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))

"""URL verdicts by rules, and by trust that flows along links where no rule fits; DataFrame functions only.

Hosts are the nodes. A link from a page to another host is an edge, links within a host are an edge to itself. Trust is a
personalised PageRank from the hosts of allowed pages along the links; distrust is one from the hosts of blocked pages against
them. A host is blocked if its distrust is greater than its trust times a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import discard, stored

DAMPING, THRESHOLD = 0.85, 1.0
#: Ranks, which sum to 1, are settled when a stride changes them by less than this in all; ranks that differ by less than this
#: part of themselves are ties.
TOLERANCE = 1e-9
#: Rounds between two written tables.
STRIDE = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)<a[ \t\n\r\f][^>]*?href[ \t\n\r\f]*=[ \t\n\r\f]*["']?([^"' \t\n\r\f>]+)"""


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; empty for null and for urls without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to the next ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def link_host(link: Column, own: Column) -> Column:
    """Host that a link leads to: its own for relative links, null for other schemes such as mailto."""
    rooted = F.when(link.startswith("//"), F.concat(F.lit("x:"), link)).otherwise(link)
    host = F.when(rooted.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(rooted)).when(rooted.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).otherwise(own)
    return F.nullif(host, F.lit(""))


def judged(places: DataFrame, rules: DataFrame) -> DataFrame:
    """places (host, path) that a rule (host, path, verdict) fits, with the longest: (host, path, rule, verdict).

    A rule fits its host and all subdomains if the path starts with its own. Equal rules of both verdicts block.
    """
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.concat("host", "path").alias("rule"), "verdict")
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = places.where("host <> ''").select("host", "path", F.explode(ends).alias("suffix")).join(rules, "suffix").where(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) from pages (host, html): how many links lead from one host to another."""
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("link"))
    return links.select(F.col("host").alias("src"), link_host(F.col("link"), F.col("host")).alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def most_rounds(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Rounds after which any ranks are settled: each round shrinks what is left by the damping, and a stride adds up to its own."""
    return math.ceil(math.log(tolerance / 2) / math.log(damping)) + STRIDE


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank from seeds (host, trust, distrust), each summing to 1.

    Both ranks advance in one join: trust along the edges, distrust against them. A host passes its rank on in proportion to its
    links; what hosts without links would pass on is given up. Every `STRIDE` rounds the ranks are written, until the sum of all
    changes since they were last written is below the tolerance: the ranks are then within 1.1 times it of where they settle.
    """
    each = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionAll(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n"))
    out = each.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    flow = stored(each.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "flow")
    start = stored(seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")).where("seed > 0"), "seeds")
    rank = stored(start.select("kind", "host", F.col("seed").alias("rank")), "rank")
    last, k = rank, 0
    while True:
        k += 1
        moved = flow.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (damping * F.col("share") * F.col("rank")).alias("part"))
        both = moved.unionAll(start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("part")))
        rank = both.groupBy("kind", "host").agg(F.sum("part").alias("rank"))
        if k % STRIDE == 0:
            rank = stored(rank, "rank")
            # What a host has more or less than before, summed over all hosts of both kinds.
            moved = rank.unionAll(last.select("kind", "host", -F.col("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("d")).agg(F.sum(F.abs("d"))).first()[0]
            discard(last)
            last = rank
            if (moved or 0.0) < tolerance:
                break
    return rank.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind) for kind in ("trust", "distrust")])


def filter_urls(pages: DataFrame, rules: DataFrame, threshold: float = THRESHOLD, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) for every page.

    The longest rule that fits decides; rule is null where none does, and the verdict is then that of the host by its links, once
    ranks have settled; where trust and distrust agree to the tolerance it is allow. The
    seeds of trust and distrust are the hosts of allowed and of blocked pages, weighted by their number. Null urls and urls
    without :// have no host; they and hosts that no rank reaches are allowed. Null html has no links. Repeated pages count each
    time. An empty table gives an empty result. Other columns are ignored.
    """
    pages = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    # Urls without a host need no join: no rule fits them and no rank reaches them.
    bare = pages.where("host = ''").select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    pages = pages.where("host <> ''")
    places = pages.groupBy("host", "path").agg(F.count("*").alias("pages"))
    ruled = stored(places.join(judged(places, rules), ["host", "path"], "left"), "places")
    counts = ruled.where("verdict is not null").groupBy("host").agg(*[F.sum(F.when(F.col("verdict") == v, F.col("pages")).otherwise(0)).alias(n) for v, n in (("allow", "a"), ("block", "b"))])
    total = ruled.agg(*[F.sum(F.when(F.col("verdict") == v, F.col("pages"))).alias(n) for v, n in (("allow", "a"), ("block", "b"))]).first()
    seeds = counts.select("host", (F.col("a") / float(total.a or 1)).alias("trust"), (F.col("b") / float(total.b or 1)).alias("distrust"))
    ranks = propagate(host_edges(pages), seeds)
    blocked = ranks.where(F.col("distrust") > threshold * (1 + TOLERANCE) * F.col("trust")).select("host", F.lit(True).alias("bad"))
    verdicts = ruled.join(blocked, "host", "left").select("host", "path", "rule", F.coalesce("verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
    return pages.select(key, "host", "path").join(verdicts, ["host", "path"]).select(key, "host", "path", "rule", "verdict").unionAll(bare)

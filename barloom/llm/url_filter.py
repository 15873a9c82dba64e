"""Operator 10: URL filters by rules, and by propagation over the link graph of hosts.

Rules (host, path, verdict) fit a host and its subdomains if the path starts with the rule's;
the longest rule wins. Hosts of allowed pages are trusted seeds and hosts of blocked pages
blocked seeds, weighted by their pages. Personalised PageRank from the trusted seeds along host
edges gives trust; the same from the blocked seeds along reversed edges gives distrust (hosts that
link to bad hosts are bad). A page that no rule fits is blocked if its host's distrust exceeds
MARGIN times its trust.

Edges come from the href and src attributes of the tags in the pages: an absolute link or one that
starts with // goes to its host if its scheme is http or https; a link without a scheme stays on its
host; others (mail, scripts, data, anchors alone) are no edges. A page's host edges count once each.
Both ranks move along one table of directed shares, in DataFrame joins and sums written to the
shared folder every STEP rounds, until they have settled; it raises if they don't within ROUNDS.

Edge cases: a url that is null or lacks :// has an empty host and path and is judged by the
method for the empty host; null html has no links; of rules of one length the last by host, path
and verdict wins; equal trust and distrust allow; hosts with neither are allowed; repeated rows are
judged alike and count as pages; html of any length is searched whole; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed rules of the registered query: host, path, verdict.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DAMPING, ROUNDS, MARGIN = 0.85, 200, 1.0
#: Ranks have settled if STEP rounds change them by TOLERANCE at most, summed over all hosts: no more than that is left to come.
STEP, TOLERANCE = 5, 1e-9
#: The value of a link attribute of a tag, with its quotes if it has any.
LINK = r"""(?is)<[a-z][^<>]*?\s(?:href|src)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first :// up to the next of / ? #, ASCII lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def link_host(link: Column, own: Column) -> Column:
    """The host that a link of a page on host own leads to; null if to none."""
    bare = F.trim(link, F.lit("\"' \t\r\n"))
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    away = F.when(bare.startswith("//"), host_of(F.concat(F.lit("x:"), bare))).when(scheme.isin("http", "https"), host_of(bare))
    return F.nullif(F.when((scheme == "") & ~bare.startswith("//") & ~bare.startswith("#") & (bare != ""), own).otherwise(away), F.lit(""))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: pages of src that link to dst."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), 1)
    targets = F.array_distinct(F.transform(links, lambda link: link_host(link, F.col("host"))))
    return pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("dst is not null and src <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def directed_shares(edges: DataFrame) -> DataFrame:
    """kind, src, dst, share: the links of each host as shares of its own (trust), and reversed (distrust)."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    total = both.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    return both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("share"))


def propagate(seeds: DataFrame, shares: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """kind, host, rank: personalised PageRank from seeds (kind, host, seed: each kind sums to 1) along shares.

    Dead ends give up their rank.
    """
    shares, seeds = common.write_shared(shares, "shares"), common.write_shared(seeds, "seeds")
    rank = before = seeds.select("kind", "host", F.col("seed").alias("rank"))
    moves = shares.withColumnRenamed("src", "host")
    for k in range(rounds):
        sent = rank.join(moves, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        rank = sent.unionByName(seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("rank"))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % STEP == STEP - 1:
            rank = common.write_shared(rank, "rank")
            both = rank.unionByName(before.select("kind", "host", (-F.col("rank")).alias("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("change"))
            if (both.agg(F.sum("change")).first()[0] or 0) <= TOLERANCE:
                return rank
            before = rank
    raise RuntimeError(f"ranks did not settle in {rounds} rounds")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    read = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    placed = read.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    kind = F.when(F.col("r.verdict") == "allow", "trust").otherwise("distrust")
    votes = common.write_shared(placed.where("r is not null").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("votes")), "votes")
    seeds = votes.join(votes.groupBy("kind").agg(F.sum("votes").alias("total")), "kind").select("kind", "host", (F.col("votes") / F.col("total")).alias("seed"))
    ranks = propagate(seeds, directed_shares(common.write_shared(host_edges(read), "host-edges")))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k)
    hosts = common.write_shared(ranks.groupBy("host").agg(of("trust"), of("distrust")), "host-ranks")
    out = placed.drop("html").join(hosts, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when(distrust > margin * trust, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page, and its host's ranks to six decimals (they settle to nine)."""
    judged = judge(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})

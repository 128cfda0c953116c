"""URL filters by rules and link-graph propagation, with DataFrame functions only.

Rules decide the urls they fit. The others get the verdict of their host: personalised PageRank carries trust from
hosts with allowed urls along links, and distrust from hosts with blocked urls against them; a host whose distrust
outweighs its trust by the threshold is blocked.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import spent, written

#: The rules of the contract, (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Damping of the walks; the change of all scores below which they are taken as they are, and the rounds between two
#: looks at it; distrust against trust from which a host is blocked.
DAMPING, TOLERANCE, ROUNDS, THRESHOLD = 0.85, 1e-6, 4, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links that name a host: absolute or without a scheme. Others stay on their page's host and carry nothing.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/"'?#>\s\\]+)"""


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")

    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    named = F.coalesce(*[F.when(fits(r), F.lit(r)) for _, r in order], F.lit(None).cast("string"))
    told = F.coalesce(*[F.when(fits(r), F.lit(v)) for v, r in order], F.lit(None).cast("string"))
    return named, told


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: (node, score) from seeds (node, share) over edges (src, dst, w).

    What a node without an edge holds returns to the seeds. A round is a join and a partial sum by node. Every ROUNDS
    rounds the scores are written to the shared folder and the former ones removed, until all scores together change by
    less than tolerance; damping bounds the rounds, since it halves the change in about four.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    flow = written(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")), "flow")
    start = written(seeds, "seeds")
    held, before = None, start.select("node", F.col("share").alias("score"))
    while True:
        rank = before
        for _ in range(ROUNDS):
            moved = flow.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg((damping * F.sum(F.col("p") * F.col("score"))).alias("got"))
            sent = moved.agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("sent"))
            back = start.join(F.broadcast(sent)).select(F.col("node").alias("dst"), (F.col("share") * (1 - F.col("sent"))).alias("got"))
            rank = moved.union(back).groupBy("dst").agg(F.sum("got").alias("score")).withColumnRenamed("dst", "node")
        both = rank.join(before.withColumnRenamed("score", "was"), "node", "full_outer")
        both = written(both.select("node", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("was", F.lit(0.0)).alias("was")), "rank")
        change = both.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        if held is not None:
            spent(held)
        held, before = both, both.select("node", "score")
        if change <= tolerance:
            spent(flow, start)
            return before


def host_verdicts(pages: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust, blocked) for every host that trust or distrust reaches; pages: host, told, html."""
    seen = pages.where("host <> ''").groupBy("host").agg(F.sum(F.when(F.col("told") == "allow", 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("told") == "block", 1).otherwise(0)).alias("bad"))
    seen = written(seen.where("good + bad > 0"), "seeds")
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).where("src <> dst")
    edges = written(links.groupBy("src", "dst").agg(F.count("*").alias("w")), "edges")
    sides = []
    for name, graph in (("good", edges), ("bad", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))):
        total = F.broadcast(seen.agg(F.sum(name).alias("total")))
        seeds = seen.where(f"{name} > 0").join(total).select(F.col("host").alias("node"), (F.col(name) / F.col("total")).alias("share"))
        sides.append(propagate(graph, seeds))
    trust, distrust = (s.select(F.col("node").alias("host"), F.col("score").alias(n)) for s, n in zip(sides, ("trust", "distrust")))
    both = trust.join(distrust, "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return both.withColumn("blocked", F.col("distrust") > threshold * F.col("trust"))


def judge_urls(pages: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html).

    Null urls and urls without `://` have an empty host and path, fit no rule and are allowed: the method knows
    nothing of them. So is a host that neither trust nor distrust reaches, and one where they are equal. Null html
    has no links; null and repeated page_ids stay as rows; other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, told = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), told.alias("told"), "html")
    blocked = host_verdicts(rows, rules, threshold).where("blocked").select("host", "blocked")
    open_rows = rows.select("page_id", "host", "path", "rule", "told").join(blocked, "host", "left")
    verdict = F.coalesce("told", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return open_rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))

"""URL filter: fixed host and path rules, and link-graph propagation for the rest.

Hosts with pages that a rule allows are trusted seeds, hosts with pages that a rule blocks
are distrusted seeds, each by the number of such pages.  Trust walks along host edges and
distrust against them (personalised PageRank with restart at the seeds); a page that no rule
fits is judged by what reaches its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm.store import stored, table

#: Fixed values of the contract: host, start of the path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""
ABSOLUTE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
DAMPING, CUT = 0.85, 0.5
#: Most that any host's share may still change when propagation ends; rounds after which it
#: is an error (mass falls to 0.85 of itself a round).
TOLERANCE, MOST_ROUNDS = 1e-9, 1000
#: Rounds that the SQL unrolls, which stops there.
ROUNDS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits.

    A rule fits its host and all subdomains where the path starts with the rule's.  Of two
    rules equally long, the one with the longer host wins.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    rule = verdict = None
    for name, start, says in ranked:
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule = (F if rule is None else rule).when(fits, F.lit(name + start))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(says))
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``source, target, weight``: links between hosts, and between a host and its parent.

    Links are ``href`` values that begin with a scheme and ``://`` or with ``//``; all others
    are relative and stay on the host.  A host
    and the domain directly above it, if that has pages too, belong together: an edge of
    weight 1 each way.  Counts are combined before the shuffle, so a page or host with very
    many links costs one row per target.
    """
    link = F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("link")
    links = pages.where("host <> ''").select("host", link).where(F.col("link").rlike(ABSOLUTE))
    target, _ = host_and_path(F.regexp_replace("link", ABSOLUTE, "://"))
    linked = links.select(F.col("host").alias("source"), target.alias("target"))
    hosts = pages.where("host <> ''").select("host").distinct()
    parent = hosts.select(
        F.col("host").alias("child"), F.regexp_extract("host", r"^[^.]*\.(.*)$", 1).alias("parent")
    )
    above = parent.join(hosts, F.col("parent") == F.col("host")).select("child", "parent")
    both = above.select(F.col("child").alias("source"), F.col("parent").alias("target")).unionByName(
        above.select(F.col("parent").alias("source"), F.col("child").alias("target"))
    )
    return (
        linked.where("source <> target and target <> ''")
        .unionByName(both)
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def propagate(
    seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """``host, pages, trust, distrust`` of the fixed point.

    ``seeds`` has ``host, pages, allowed, blocked`` (numbers of pages); every host of the
    graph that has pages is in it.  Mass that reaches a host without further links, or
    without pages, ends there.  A round sends on what the last one brought; no more than
    ``damping`` of it arrives, so the sum of all that is still to come is known.  Rounds go on
    until that is less than ``tolerance`` of the share of a host of one page.  One row per
    host and distinct edge; each round is written to the shared folder, so the plan stays
    small and a lost executor costs one round.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("out"))
    back = edges.groupBy("target").agg(F.sum("weight").alias("into"))
    steps = edges.join(out, "source").join(back, "target")
    zero = F.lit(0.0)
    forward = steps.select(
        F.col("source").alias("from"),
        F.col("target").alias("to"),
        (damping * F.col("weight") / F.col("out")).alias("forward"),
        zero.alias("backward"),
    )
    backward = steps.select(
        F.col("target").alias("from"),
        F.col("source").alias("to"),
        zero.alias("forward"),
        (damping * F.col("weight") / F.col("into")).alias("backward"),
    )
    known = seeds.select(F.col("host").alias("to"))
    steps = stored(
        forward.unionByName(backward)
        .groupBy("from", "to")
        .agg(F.sum("forward").alias("forward"), F.sum("backward").alias("backward"))
        .join(known, "to", "left_semi")
    )
    rest = 1 - damping
    trust, distrust = F.col("allowed") * rest, F.col("blocked") * rest
    # what has arrived, and what of it came with the last round
    state = stored(
        seeds.select(
            "host",
            trust.alias("trust"),
            distrust.alias("distrust"),
            trust.alias("new_trust"),
            distrust.alias("new_distrust"),
        )
    )
    for n in range(MOST_ROUNDS + 1):
        new = state.agg(F.greatest(F.sum("new_trust"), F.sum("new_distrust"))).first()[0] or 0.0
        if new * damping / rest < tolerance * rest:
            break
        if n == MOST_ROUNDS:
            raise RuntimeError(f"trust did not settle in {MOST_ROUNDS} rounds")
        moving = state.where("new_trust > 0 or new_distrust > 0")
        got = steps.join(moving, steps["from"] == moving["host"]).select(
            F.col("to").alias("host"),
            (F.col("new_trust") * F.col("forward")).alias("t"),
            (F.col("new_distrust") * F.col("backward")).alias("d"),
        )
        kept = state.select("host", "trust", "distrust", zero.alias("t"), zero.alias("d"))
        state = stored(
            kept.unionByName(got.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"), "t", "d"))
            .groupBy("host")
            .agg(
                F.sum("trust").alias("trust"),
                F.sum("distrust").alias("distrust"),
                F.sum("t").alias("new_trust"),
                F.sum("d").alias("new_distrust"),
            )
        )
    return seeds.select("host", "pages").join(state.select("host", "trust", "distrust"), "host")


def judge(pages: DataFrame, rules=RULES, cut: float = CUT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    Where no rule fits, a page is blocked if its host's distrust is at least ``cut`` of what
    the host would have if all its pages were blocked seeds, and above its trust; else it is
    allowed.  A URL that is null or has no ``://`` has no host and is allowed.  A null html
    has no links.  Repeated rows count as pages of their own; other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    narrow = named.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    seeds = (
        narrow.where("host <> ''")
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(F.col("says") == "allow").alias("allowed"),
            F.count_if(F.col("says") == "block").alias("blocked"),
        )
    )
    reached = propagate(seeds, stored(host_edges(named)))
    full = (1 - DAMPING) * F.col("pages")
    # rounded, so that the order of a sum decides nothing
    share = F.round(F.col("distrust") / full, 9)
    bad = (share >= cut) & (share > F.round(F.col("trust") / full, 9))
    hosts = reached.where(bad).select(F.col("host").alias("bad_host"))
    method = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return narrow.join(hosts, F.col("host") == F.col("bad_host"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("says", method).alias("verdict")
    )


def op9_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judge(table(spark, sf_dir, "pages"))


_ROUND = """
r{n} AS (
  SELECT s.host, s.pages, s.seed_trust, s.seed_distrust,
         s.seed_trust + 0.85::DOUBLE * coalesce(f.t, 0) AS trust,
         s.seed_distrust + 0.85::DOUBLE * coalesce(b.d, 0) AS distrust
  FROM r{m} s
  LEFT JOIN (SELECT target AS host, sum(trust * forward) AS t FROM steps JOIN r{m} ON source = host GROUP BY 1) f USING (host)
  LEFT JOIN (SELECT source AS host, sum(distrust * backward) AS d FROM steps JOIN r{m} ON target = host GROUP BY 1) b USING (host)),"""

OP9_SQL = (
    r"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
named AS (
  SELECT page_id, html,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
rules(rule_host, rule_path, says) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
judged AS (
  SELECT n.page_id, n.host, n.path, n.html,
         arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(says, length(rule_host || rule_path)) AS says
  FROM named n LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL),
seeds AS (
  SELECT host, count(*) AS pages, count(*) FILTER (says = 'allow') AS allowed,
         count(*) FILTER (says = 'block') AS blocked
  FROM judged WHERE host <> '' GROUP BY host),
links AS (
  SELECT host, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)) AS link
  FROM named WHERE host <> ''),
linked AS (
  SELECT host AS source,
         translate(regexp_extract(substr(link, strpos(link, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target
  FROM links WHERE strpos(link, '://') > 0),
above AS (
  SELECT c.host AS child, p.host AS parent FROM seeds c JOIN seeds p
    ON regexp_extract(c.host, '^[^.]*\.(.*)$', 1) = p.host),
edges AS (
  SELECT source, target, count(*)::DOUBLE AS weight FROM (
    SELECT * FROM linked WHERE source <> target AND target <> ''
    UNION ALL SELECT child, parent FROM above UNION ALL SELECT parent, child FROM above)
  GROUP BY ALL),
steps AS (
  SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS forward,
         weight / sum(weight) OVER (PARTITION BY target) AS backward FROM edges),
r0 AS (
  SELECT host, pages, allowed * (1 - 0.85::DOUBLE) AS seed_trust, blocked * (1 - 0.85::DOUBLE) AS seed_distrust,
         allowed * (1 - 0.85::DOUBLE) AS trust, blocked * (1 - 0.85::DOUBLE) AS distrust FROM seeds),"""
    + "".join(_ROUND.format(n=n + 1, m=n) for n in range(ROUNDS))
    + f"""
bad AS (
  SELECT host FROM r{ROUNDS}
  WHERE round(distrust / ((1 - 0.85::DOUBLE) * pages), 9) >= 0.5
    AND round(distrust / ((1 - 0.85::DOUBLE) * pages), 9) > round(trust / ((1 - 0.85::DOUBLE) * pages), 9))
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""
)

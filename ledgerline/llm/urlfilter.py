"""URL filters: rules by host and path, and for pages without a rule trust and distrust propagated over links of hosts.

DataFrame functions only. The pages that rules allow are seeds of trust, one unit a page at its host; those that rules block
are seeds of distrust. Trust flows along the links of hosts (personalised PageRank), distrust against them, from what is
linked to those who link. Links are the absolute ones in attributes of the pages, counted by pairs of hosts, and a link both
ways between a host and its parent domain of two labels or more, so that a site shares its reputation with its subdomains.
A page without a rule is blocked where its host has gathered more distrust than ``threshold`` times its trust; a host that
neither reaches is allowed.

Mass is counted in whole millionths of a page and divided with whole numbers, so sums do not depend on the order of tasks. A
round moves ``damping`` percent of the mass that the last one brought; what is left after the last round is less than damping
to the power of the rounds (0.7 ** 10 = 0.03) of all seeds. Each round is a table in the shared folder, and rounds end
early when nothing moves. Links are aggregated before they are shuffled by host, and a host with very many links or pages is
the larger side of joins that adaptive execution can split.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, is no seed, has no links and is
allowed; null html has no links; rows that repeat count and are judged as often as they occur; rules that fit at equal length
go by the longer host, then the order given; an empty table gives no rows; texts of any length are read whole; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerline.llm.common import LOWER, dropped, lower_ascii, written

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UNIT = 1_000_000
DAMPING = 70
ROUNDS = 10
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def url_parts(url: Column | str) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    part = lambda i: F.coalesce(F.regexp_extract(url, _URL, i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null without one. Rules are a configured list, compiled into the plan."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _domains(hosts: DataFrame) -> DataFrame:
    """(child, parent) from each host up to its domain of two labels; numeric addresses have no parents."""
    labels = F.split("host", r"\.")
    up = hosts.select(labels.alias("l")).filter(F.size("l") > 2).filter(~F.element_at("l", -1).rlike("^[0-9]"))
    steps = up.select("l", F.explode(F.sequence(F.lit(1), F.size("l") - 2)).alias("i"))
    tail = lambda i: F.array_join(F.slice("l", i, F.size("l")), ".")
    return steps.select(tail(F.col("i")).alias("child"), tail(F.col("i") + 1).alias("parent")).distinct()


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst and w: links between different hosts, and between hosts and their parent domains."""
    links = pages.select(url_parts(pages[url])[0].alias("src"), F.explode(F.regexp_extract_all(html, F.lit(_LINK), 1)).alias("dst"))
    links = links.select("src", lower_ascii("dst").alias("dst")).filter("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    links = written(links, "links")
    hosts = pages.select(url_parts(pages[url])[0].alias("host")).distinct().unionByName(links.select(F.col("dst").alias("host"))).distinct()
    family = _domains(hosts)
    both = family.select(F.col("child").alias("src"), F.col("parent").alias("dst")).unionByName(family.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    return links.unionByName(both.withColumn("w", F.lit(1).cast("long"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: int = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust and distrust, of ``seeds`` (host, trust, distrust in whole units) over ``edges`` (src, dst, w)."""
    ahead = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    ways = ahead.unionByName(back)
    ways = written(ways.join(ways.groupBy("kind", "src").agg(F.sum("w").alias("total")), ["kind", "src"]), "ways")
    mass = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "mass"))
    tables = [written(mass.filter("mass > 0"), "mass")]
    whole = "decimal(20,0)"
    for _ in range(rounds):
        seen = Observation()
        moved = F.expr(f"CAST(mass * {damping} AS {whole}) * CAST(w AS decimal(18,0)) div CAST(total * 100 AS {whole})")
        now = tables[-1].withColumnRenamed("host", "src").join(ways, ["kind", "src"]).select(F.col("dst").alias("host"), "kind", moved.alias("mass"))
        now = now.groupBy("host", "kind").agg(F.sum("mass").alias("mass")).filter("mass > 0")
        tables.append(written(now.observe(seen, F.count(F.lit(1)).alias("n")), "mass"))
        if seen.get["n"] == 0:
            break
    total = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0)).alias(k)
    out = written(reduce(DataFrame.unionByName, tables).groupBy("host").agg(total("trust"), total("distrust")), "hosts")
    for t in (*tables, ways):
        dropped(t)
    return out


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 1.0, damping: int = DAMPING, rounds: int = ROUNDS, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, and the trust and distrust of the host in millionths of a page."""
    host, path = url_parts(pages[url])
    parts = pages.select(pages[page_id].alias("__id"), host.alias("host"), path.alias("path")).withColumn("__r", rule_for(F.col("host"), F.col("path"), rules))
    units = lambda v, n: (F.count_if(F.col("__r.verdict") == v) * UNIT).alias(n)
    seeds = parts.filter("host <> '' AND __r IS NOT NULL").groupBy("host").agg(units("allow", "trust"), units("block", "distrust"))
    found = propagate(host_edges(pages, url, html), seeds, damping, rounds)
    judged = parts.join(found, "host", "left").fillna(0, ["trust", "distrust"])
    verdict = F.coalesce(F.col("__r.verdict"), F.when(F.col("distrust") > F.col("trust") * threshold, "block").otherwise("allow"))
    return judged.select(F.col("__id").alias(page_id), "host", "path", F.col("__r.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


#: The same rules and the same rounds in whole numbers, in SQL.
URL_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{LOWER[0]}', '{LOWER[1]}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), r AS (
  SELECT *, 'x.' || host AS h FROM p
), j AS (
  SELECT page_id, host, path, html, CASE
    WHEN h LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN h LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN h LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN h LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN h LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM r
), v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM j
), links AS (
  SELECT src, dst, count(*)::BIGINT AS w FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_LINK.replace("'", "''")}', 1)), '{LOWER[0]}', '{LOWER[1]}') AS dst FROM v) WHERE src <> '' AND src <> dst GROUP BY 1, 2
), hosts AS (SELECT host, string_split(host, '.') AS l FROM (SELECT host FROM v UNION SELECT dst FROM links)
), family AS (
  SELECT DISTINCT array_to_string(l[i:], '.') AS child, array_to_string(l[i+1:], '.') AS parent
  FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM hosts WHERE len(l) > 2 AND NOT regexp_matches(l[-1], '^[0-9]'))
), edges AS (
  SELECT src, dst, sum(w)::BIGINT AS w FROM (SELECT * FROM links UNION ALL SELECT child, parent, 1 FROM family UNION ALL SELECT parent, child, 1 FROM family) GROUP BY 1, 2
), ways AS (
  SELECT *, sum(w) OVER (PARTITION BY kind, src)::HUGEINT AS total FROM (SELECT 'allow' AS kind, src, dst, w FROM edges UNION ALL SELECT 'block', dst, src, w FROM edges)
), steps AS (
  SELECT 0 AS k, host, ruled AS kind, (count(*) * {UNIT})::BIGINT AS mass FROM v WHERE host <> '' AND ruled IS NOT NULL GROUP BY 2, 3
  UNION ALL
  SELECT k + 1, ways.dst, steps.kind, sum(((mass * {DAMPING})::HUGEINT * w // (total * 100))::BIGINT)::BIGINT FROM steps JOIN ways ON steps.host = ways.src AND steps.kind = ways.kind WHERE k < {ROUNDS} GROUP BY 1, 2, 3
), found AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'allow'), 0)::BIGINT AS trust, coalesce(sum(mass) FILTER (kind = 'block'), 0)::BIGINT AS distrust FROM steps GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM v LEFT JOIN found USING (host)
"""

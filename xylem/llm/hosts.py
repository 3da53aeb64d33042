"""URL filter: ordered host and path rules, and trust propagated over the host graph where no rule fits.

Rules decide their urls; the longest fitting one wins. For the rest, each host is judged by the link
graph: trust spreads by personalised PageRank along host edges from hosts whose pages the rules
allow, distrust along reversed edges from hosts whose pages the rules block. A seed weighs the share
of the host's pages that such rules decide. A host is blocked if its distrust exceeds its trust by
more than THRESHOLD; scores are stated in units of a full seed without edges.

Edges: links with a host in the page's html (relative links stay on their host and are no edge), and
for a host the host named by dropping its first label (www., m., blog.), both ways, if pages of both
exist: one party runs both names, so what rules say of one is evidence on the other. Parallel links are
one weighted edge before any join.

Rounds go on until what is still to be handed on is less than TOLERANCE of all seeds. Scores only grow,
so the change of a round is the growth of one sum. Mass that reaches a host without edges would go back
to the seeds in their proportions, which multiplies all scores of a kind by one factor; that factor
cancels in units of a seed, so it isn't carried along.

The edges are laid out once by (kind, source, slot) and kept on disk in that layout (they are written to
the shared folder first, so lost ones are read again); a source with more than HUB edges is split over
slots, to which its score is copied. Scores are written to the shared folder every BLOCK rounds. Blocked
hosts are broadcast up to BROADCAST_ROWS and joined by a shuffle beyond. Only DataFrame functions are used.

Defined cases: null urls and urls without :// have empty host and path, no rule, verdict allow; null
html has no links; repeated rows count as pages and links each and get a row each; of rules that tie in
length the later name wins; very long urls and html are read whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import LOWER, OWN, UPPER, materialise

#: verdict, host, path
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, THRESHOLD, TOLERANCE = 0.85, 0.5, 1e-6
#: Rounds between two writes; edges of one source in one slot; rows (a host each, 300 bytes at most) that may be broadcast.
BLOCK, HUB, BROADCAST_ROWS = 6, 100_000, 100_000
LINK = r"(?i)<a\b[^<>]*?\bhref\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^\"'\s<>/?#]+)"


def located(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest fitting rule, or null; equal lengths: the later name."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and rule verdict under OWN names."""
    host, path = located(F.col("url").cast("string"))
    rows = pages.withColumns({f"{OWN}host": host, f"{OWN}path": path})
    return rows.withColumn(f"{OWN}m", matched(F.col(f"{OWN}host"), F.col(f"{OWN}path"), rules))


def host_seeds(ruled: DataFrame) -> DataFrame:
    """host, trust, distrust: shares of the host's pages that rules allow and block."""
    share = lambda v: F.count_if(F.col(f"{OWN}m.verdict") == v) / F.count(F.lit(1))
    return ruled.where(F.col(f"{OWN}host") != "").groupBy(F.col(f"{OWN}host").alias("host")).agg(share("allow").alias("trust"), share("block").alias("distrust"))


def host_edges(ruled: DataFrame, hosts: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, and edges between a host and its shorter name, both among the pages' hosts."""
    links = ruled.select(F.col(f"{OWN}host").alias("src"), F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))
    named = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst"))
    named = named.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    both = named.unionByName(named.selectExpr("dst AS src", "src AS dst")).withColumn("n", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagated(seeds: DataFrame, edges: DataFrame, hub: int = HUB) -> DataFrame:
    """kind ('trust', 'distrust'), host, score in units of a full seed."""
    kinds = materialise(edges.selectExpr("explode(array(struct('trust' AS kind, src AS a, dst AS b, n), struct('distrust' AS kind, dst AS a, src AS b, n))) AS e").select("e.*"), "edges")
    totals = kinds.groupBy("kind", "a").agg(F.sum("n").alias("all"), F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("slots"))
    totals = materialise(totals, "sources")
    shares = kinds.join(totals, ["kind", "a"]).select("kind", "a", F.pmod(F.xxhash64("b"), "slots").cast("int").alias("slot"), "b", (F.col("n") / F.col("all")).alias("p"))
    moves = materialise(shares, "moves").repartition("kind", "a", "slot").persist(StorageLevel.DISK_ONLY)
    split = totals.where("slots > 1").select("kind", "a", "slots")
    any_split = not split.isEmpty()
    start = seeds.selectExpr("stack(2, 'trust', host, trust, 'distrust', host, distrust) AS (kind, host, score)").where("score > 0")
    scores = start = materialise(start, "seeds")
    amount = lambda df: df.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
    whole = before = amount(start)
    while whole > 0:
        for _ in range(BLOCK):
            sent = scores.withColumnRenamed("host", "a")
            sent = sent.join(split, ["kind", "a"], "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots") if any_split else sent.withColumn("slot", F.lit(0))
            carried = moves.join(sent, ["kind", "a", "slot"]).select("kind", F.col("b").alias("host"), (F.col("p") * F.col("score") * DAMPING).alias("score"))
            scores = start.unionByName(carried).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        scores = materialise(scores, "scores")
        now = amount(scores)
        left = (now - before) * DAMPING**BLOCK / (1 - DAMPING**BLOCK)
        if left <= TOLERANCE * whole:
            break
        before = now
    moves.unpersist()
    return scores


def blocked_hosts(scores: DataFrame) -> DataFrame:
    sign = F.when(F.col("kind") == "trust", -F.col("score")).otherwise(F.col("score"))
    return scores.groupBy("host").agg(F.round(F.sum(sign), 4).alias("net")).where(F.col("net") > THRESHOLD).select("host")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages."""
    ruled = with_rules(pages, rules)
    seeds = materialise(host_seeds(ruled), "hosts")
    blocked = materialise(blocked_hosts(propagated(seeds, host_edges(ruled, seeds.select("host")))), "blocked")
    blocked = F.broadcast(blocked) if blocked.count() <= BROADCAST_ROWS else blocked
    blocked = blocked.select(F.col("host").alias(f"{OWN}host"), F.lit("block").alias(f"{OWN}graph"))
    rows = ruled.select("page_id", f"{OWN}host", f"{OWN}path", f"{OWN}m").join(blocked, f"{OWN}host", "left")
    return rows.select(
        "page_id", F.col(f"{OWN}host").alias("host"), F.col(f"{OWN}path").alias("path"), F.col(f"{OWN}m.rule").alias("rule"),
        F.coalesce(f"{OWN}m.verdict", f"{OWN}graph", F.lit("allow")).alias("verdict"),
    )


def oracle() -> str:
    """The same in SQL; rounds hand on what the round before added, until nothing of weight is left."""
    fits = " ".join(f"UNION ALL SELECT {len(h + p)}, '{h + p}', '{v}', '{h}', '{p}'" for v, h, p in RULES)[len("UNION ALL ") :]
    link = LINK.replace("'", "''")
    return f"""
WITH RECURSIVE r(size, rule, verdict, h, p) AS ({fits}),
u AS (SELECT row_number() OVER () AS rid, page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT rid, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT rid, arg_max(r.rule, r.size) AS rule, arg_max(r.verdict, r.size) AS verdict FROM v JOIN r ON (v.host = r.h OR ends_with(v.host, '.' || r.h)) AND starts_with(v.path, r.p) GROUP BY rid),
w AS (SELECT v.*, f.rule, f.verdict FROM v LEFT JOIN f USING (rid)),
h AS (SELECT host, avg((coalesce(verdict, '') = 'allow')::INT) AS trust, avg((coalesce(verdict, '') = 'block')::INT) AS distrust FROM w WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM w),
n AS (SELECT a.host AS src, b.host AS dst FROM h a JOIN h b ON b.host = regexp_extract(a.host, '^[^.]+\\.(.+)$', 1)),
e AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, 1.0::DOUBLE AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst UNION ALL SELECT src, dst, 1.0 FROM n UNION ALL SELECT dst, src, 1.0 FROM n) GROUP BY ALL),
k AS (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
m AS MATERIALIZED (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS p FROM k),
d(step, kind, host, score) AS (
  SELECT 0, kind, host, score FROM (SELECT 'trust' AS kind, host, trust AS score FROM h UNION ALL SELECT 'distrust', host, distrust FROM h) WHERE score > 0
  UNION ALL SELECT step + 1, m.kind, m.b, sum(m.p * d.score * {DAMPING}::DOUBLE) FROM d JOIN m ON d.kind = m.kind AND d.host = m.a WHERE step < 100 GROUP BY step, m.kind, m.b),
b AS (SELECT host FROM d GROUP BY host HAVING round(sum(CASE WHEN kind = 'trust' THEN -score ELSE score END), 4) > {THRESHOLD})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM b) THEN 'block' END, 'allow') AS verdict FROM w
"""

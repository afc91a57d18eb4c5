"""URL filters from a path-template tree, with DataFrame operations only.

Explicit rules come first: a rule fits its host and all subdomains where the path starts with the rule's,
and the longest fitting rule wins.  Its verdicts are also the labels from which the tree learns.

The tree: below each host the path's segments are levels, as many as the deepest path has (what lies below DEPTH levels is one
segment, so that no path makes the plan endless).  Where a node has many children, those that hold little of its pages are
one wildcard (``*``).  Siblings are then put in order of their labelled share of blocks, and neighbours whose shares do not
differ significantly become one branch, named by its members (``a|b``), whose subtrees go on as one.  A template's purity is
the share of blocks among the labels of its branch, smoothed towards its parent's purity, up to a prior at the root; a
template is rejected from a threshold on.

All statistics are taken over all pages by hash aggregation with partial sums on the map side, on distinct paths, so a
host with a third of all pages meets a reducer only as sums.  The joins by node or path keep hot keys, of which there are few by
definition, out of the shuffle (``join_spread``).  Only one join carries page rows, on the whole path.

Null urls and urls without ``://`` have empty host and path and are judged by the template of the empty
host.  Repeated rows are judged alike and kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm.common import fresh, join_spread, quoted, stash, table

#: (verdict, host and path); the host ends before the first slash.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MAX_CHILDREN = 8
RARE_SHARE = 0.1
SMOOTHING = 8.0
PRIOR = 0.1
Z_SIMILAR = 2.0
REJECT_FROM = 0.8
#: Levels of the tree; deeper paths end in one segment that is the rest of them.
DEPTH = 64
#: Levels that the SQL oracle spells out; deeper paths exceed it.
ORACLE_DEPTH = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path; columns of these names are replaced."""
    u, rest = quoted(url), fresh(pages, "rest")
    after = F.expr(f"CASE WHEN instr({u}, '://') > 0 THEN substring({u}, instr({u}, '://') + 3) ELSE '' END")
    return (
        pages.withColumn(rest, F.coalesce(after, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER))
        .withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))
        .drop(rest)
    )


def longest_rule(rules=RULES):
    """The longest fitting rule of a row with host and path, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rules=RULES):
    known = F.lit(None).cast("string")
    for verdict, rule in rules:
        known = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(known)
    return known


def _smoothed(labels, blocks, purity, smoothing: float):
    return (blocks + smoothing * purity) / (labels + smoothing)


def _branches(rows: DataFrame, total: int, max_children: int, rare_share: float, z_similar: float) -> DataFrame:
    """(node, s, n, branch, labels, blocks): for every child segment of every node of rows (one per path) its branch and that branch's sums."""
    sums = [F.sum(c).alias(c) for c in ("n", "labels", "blocks")]
    children = stash(rows.groupBy("node", "s").agg(*sums, F.count("*").alias("paths")))
    parents = children.groupBy("node").agg(F.count("*").alias("n_children"), F.sum("n").alias("n_parent"))
    rare = (F.col("n_children") > max_children) & (F.col("n") < F.col("n_parent") * rare_share)
    named = join_spread(children, parents.withColumn("many", F.col("n_children")), ["node"], "many", total)
    named = stash(named.withColumn("t", F.when(rare, F.lit("*")).otherwise(F.col("s"))))
    # A node has now at most max_children children, or those with at least rare_share of it, besides its wildcard.
    kinds = named.groupBy("node", "t").agg(F.sum("labels").alias("labels"), F.sum("blocks").alias("blocks"))
    told = kinds.where("labels > 0").withColumn("rate", F.col("blocks") / F.col("labels"))
    w = Window.partitionBy("node").orderBy("rate", "t")
    told = told.withColumn("labels_", F.lag("labels").over(w)).withColumn("blocks_", F.lag("blocks").over(w)).withColumn("rate_", F.lag("rate").over(w))
    mean = (F.col("blocks") + F.col("blocks_")) / (F.col("labels") + F.col("labels_"))
    z = (F.col("rate") - F.col("rate_")) / F.sqrt(mean * (1 - mean) * (1 / F.col("labels") + 1 / F.col("labels_")) + 1e-9)
    told = told.withColumn("group", F.sum(F.when(z >= z_similar, 1).otherwise(0)).over(w))
    branch = told.groupBy("node", "group").agg(F.array_join(F.sort_array(F.collect_list("t")), "|").alias("branch"), F.collect_list("t").alias("ts"), F.sum("labels").alias("labels"), F.sum("blocks").alias("blocks"))
    # Branches without labels stay by themselves.
    branch = branch.select("node", F.explode("ts").alias("t"), "branch", "labels", "blocks").unionByName(kinds.where("labels = 0").withColumn("branch", F.col("t")))
    kept = named.groupBy("node", "t").agg(F.count("*").alias("many")).join(branch, ["node", "t"])
    return join_spread(named.select("node", "s", "t", F.col("paths").alias("n")), kept, ["node", "t"], "many", total).drop("t")


def templates(labelled: DataFrame, max_children: int = MAX_CHILDREN, rare_share: float = RARE_SHARE, smoothing: float = SMOOTHING, prior: float = PRIOR, z_similar: float = Z_SIMILAR) -> DataFrame:
    """(host, path, n, template, purity) of every distinct path of rows (host, path, is_block null or 0/1), level by level from the root."""
    paths = labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("is_block").alias("labels"), F.coalesce(F.sum("is_block"), F.lit(0)).alias("blocks"))
    paths = stash(paths.withColumn("parts", F.split("path", "/", DEPTH + 1)))
    found = paths.agg(F.count("*").alias("n"), F.max(F.size("parts")).alias("depth")).first()
    hosts = paths.groupBy("host").agg(F.count("*").alias("many"), _smoothed(F.sum("labels"), F.sum("blocks"), prior, smoothing).alias("purity"))
    rows = stash(join_spread(paths, hosts, ["host"], "many", found["n"]).withColumn("node", F.col("host")))
    ended = rows.where(F.size("parts") <= 1)
    for level in range(1, found["depth"] or 1):
        # Every level reads the one before several times: a written table keeps the plan short.
        open_ = rows.where(F.size("parts") > level).withColumn("s", F.get("parts", F.lit(level)))
        names = _branches(open_, found["n"], max_children, rare_share, z_similar).withColumnsRenamed({"labels": "l", "blocks": "b"})
        met = join_spread(open_.withColumnRenamed("n", "pages"), stash(names), ["node", "s"], "n", found["n"]).withColumnRenamed("pages", "n")
        met = met.withColumn("purity", _smoothed(F.col("l"), F.col("b"), F.col("purity"), smoothing)).withColumn("node", F.concat("node", F.lit("/"), "branch"))
        rows = stash(met.select(*ended.columns))
        ended = ended.unionByName(rows.where(F.size("parts") == level + 1))
    return ended.select("host", "path", "n", F.col("node").alias("template"), "purity")


def judge(pages: DataFrame, rules=RULES, id_column: str = "page_id", url: str = "url", reject_from: float = REJECT_FROM) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every page."""
    rows = with_host_path(pages.select(id_column, url), url).withColumn("rule", longest_rule(rules)).withColumn("known", rule_verdict(rules)).drop(url)
    judged = stash(templates(rows.withColumn("is_block", F.when(F.col("known") == "block", 1).when(F.col("known") == "allow", 0))))
    verdict = F.coalesce("known", F.when(F.col("purity") >= reject_from, F.lit("block")).otherwise(F.lit("allow")))
    return join_spread(rows, judged, ["host", "path"], "n", pages.count()).select(id_column, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("purity")


def _oracle() -> str:
    rule = "NULL"
    for _, r in sorted(RULES, key=lambda r: (len(r[1]), r[1])):
        host, _, path = r.partition("/")
        rule = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{r}' ELSE {rule} END"
    known = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES)
    sql = f"""WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {rule} AS rule FROM b), rows_ AS MATERIALIZED (SELECT *, CASE rule {known} END AS known FROM c),
g AS MATERIALIZED (SELECT host, path, count(*) AS n, count(known) AS labels, count(*) FILTER (WHERE known = 'block') AS blocks, string_split(path, '/') AS parts FROM rows_ GROUP BY host, path),
h AS (SELECT host, (sum(blocks) + {SMOOTHING * PRIOR}) / (sum(labels) + {SMOOTHING})::DOUBLE AS purity FROM g GROUP BY host),
l0 AS MATERIALIZED (SELECT g.*, host AS node, purity FROM g JOIN h USING (host)),
"""
    for i in range(1, ORACLE_DEPTH + 1):
        sql += f"""a{i} AS MATERIALIZED (SELECT *, parts[{i + 1}] AS s FROM l{i - 1} WHERE len(parts) > {i}),
c{i} AS (SELECT node, s, sum(n) AS nc, sum(labels)::DOUBLE AS lc, sum(blocks)::DOUBLE AS bc FROM a{i} GROUP BY node, s),
p{i} AS (SELECT node, count(*) AS d, sum(nc) AS np FROM c{i} GROUP BY node),
t{i} AS MATERIALIZED (SELECT node, s, lc, bc, CASE WHEN d > {MAX_CHILDREN} AND nc < np * {RARE_SHARE} THEN '*' ELSE s END AS t FROM c{i} JOIN p{i} USING (node)),
x{i} AS MATERIALIZED (SELECT node, t, sum(lc) AS lt, sum(bc) AS bt FROM t{i} GROUP BY node, t),
y{i} AS (SELECT *, bt / lt AS r, lag(lt) OVER w AS l_, lag(bt) OVER w AS b_, lag(bt / lt) OVER w AS r_ FROM x{i} WHERE lt > 0 WINDOW w AS (PARTITION BY node ORDER BY bt / lt, t)),
z{i} AS (SELECT *, CASE WHEN (r - r_) / sqrt(((bt + b_) / (lt + l_)) * (1 - (bt + b_) / (lt + l_)) * (1 / lt + 1 / l_) + 1e-9) >= {Z_SIMILAR} THEN 1 ELSE 0 END AS cut_ FROM y{i}),
g{i} AS MATERIALIZED (SELECT *, sum(cut_) OVER (PARTITION BY node ORDER BY r, t) AS grp FROM z{i}),
m{i} AS (SELECT node, grp, string_agg(t, '|' ORDER BY t) AS branch, sum(lt) AS l, sum(bt) AS b FROM g{i} GROUP BY node, grp),
k{i} AS (SELECT node, t, branch, l, b FROM g{i} JOIN m{i} USING (node, grp) UNION ALL SELECT node, t, t, lt, bt FROM x{i} WHERE lt = 0),
l{i} AS MATERIALIZED (SELECT host, path, n, labels, blocks, parts, node || '/' || branch AS node, (b + {SMOOTHING} * purity) / (l + {SMOOTHING}) AS purity FROM a{i} JOIN t{i} USING (node, s) JOIN k{i} USING (node, t)),
"""
    ended = " UNION ALL ".join(f"SELECT host, path, node AS template, purity FROM l{i} WHERE len(parts) {'<=' if i == 0 else '='} {i + 1}" for i in range(ORACLE_DEPTH + 1))
    return sql + f"""j AS ({ended})
SELECT page_id, host, path, rule, coalesce(known, CASE WHEN purity >= {REJECT_FROM} THEN 'block' ELSE 'allow' END) AS verdict, template FROM rows_ JOIN j USING (host, path)"""


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": _oracle()}

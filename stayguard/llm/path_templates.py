"""URL verdicts by rules, else by a tree of path templates per host (operator 12).

A url's host and path are judged by the longest fitting rule. Where none fits, the path's
template decides. Paths are first summed by host and shape (digits and long hexadecimal runs
become ``*``), so a hot host costs its shapes, not its pages. The tree is then built level by
level over all hosts at once: a branch of a wide node that few pages take becomes the
wildcard ``*``, and branches of one node that agree in the class of their label purity and
in how they mostly go on, and whose continuations are distributed like those of all such
branches (chi-square against their pool), merge into one wildcard. What the rules say of the pages is their label. A template's purity is its
labelled share of blocked pages, smoothed towards the purity of the node above it, up to the
host and the table. Templates whose purity reaches ``REJECT`` are blocked.

Templates spell out the first ``LEVELS`` segments; what lies deeper is one wildcard segment ``**``
(it is part of the template, no page is left out).

Defined results: a NULL url, or one without ``://``, has an empty host and path and takes the verdict of that
node; each page row has a row, repeated or not. An empty table has none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import saved

#: Fixed rules: verdict, host (with its subdomains), start of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
VARIABLE = "[0-9A-Fa-f]{8,}|[0-9]+"
LEVELS = 12
#: A node with so many branches is wide; a branch is variable there below one part in so many of the pages.
WIDE = 16
#: Pages that the node above counts for in a purity, and the purity that rejects.
PRIOR, REJECT = 5.0, 0.8
#: A branch is like its pool up to so many standard deviations of the chi-square value.
DEVIATIONS = 3.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lowered) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; NULL where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def shape_of(path: Column) -> Column:
    """Segments of a path with their variable runs as ``*``, what lies below LEVELS as ``**``."""
    shape = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(F.substring(path, 2, 2147483647), VARIABLE, "*"), "/"))
    return F.when(F.size(shape) > LEVELS, F.concat(F.slice(shape, 1, LEVELS), F.array(F.lit("**")))).otherwise(shape)


def smoothed(blocked: Column, labelled: Column, above: Column) -> Column:
    return (blocked + F.lit(PRIOR) * above) / (labelled + F.lit(PRIOR))


def kind(segment: Column) -> Column:
    """What a segment looks like, coarsely."""
    return (F.when(segment.isNull(), "end").when(segment == "", "empty").when(segment.contains("*"), "wild")
            .when(segment.contains("."), "file").otherwise("word"))


def level(paths: DataFrame, d: int) -> DataFrame:
    """Nodes of the paths one level down: (host, shape, ..., node, purity) with the d-th segment taken in."""
    at = ["host", "node"]
    here = paths.withColumns({"child": F.get("shape", F.lit(d - 1)), "follow": kind(F.get("shape", F.lit(d)))})
    deeper = here.where(F.size("shape") >= d)
    cells = deeper.groupBy(*at, "child", "follow").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.max("purity").alias("purity"))
    cells = saved(cells, "cells")
    nodes = cells.groupBy(*at, "child").agg(F.sum("n").alias("n")).groupBy(*at).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("pages"))
    branches = cells.groupBy(*at, "child").agg(F.sum("n").alias("branch"), smoothed(F.sum("blocked"), F.sum("labelled"), F.max("purity")).alias("own"),
                                               F.max_by("follow", F.struct("n", "follow")).alias("main"))
    says = F.when(F.col("own") >= REJECT, "block").when(F.col("own") <= 1 - REJECT, "allow").otherwise("mixed")
    branches = branches.join(nodes, at).withColumn("family", F.when((F.col("children") >= WIDE) & (F.col("branch") * WIDE < F.col("pages")), "*")
                                                   .otherwise(F.concat(F.lit("*:"), says, F.lit(":"), F.col("main"))))
    branches = saved(branches.select(*at, "child", "branch", "family"), "branches")
    group = [*at, "family"]
    pool = cells.join(branches, [*at, "child"]).groupBy(*group, "follow").agg(F.sum("n").alias("pooled"))
    whole = pool.groupBy(*group).agg(F.sum("pooled").alias("all"), F.count(F.lit(1)).alias("kinds"))
    members = branches.groupBy(*group).agg(F.count(F.lit(1)).alias("members"))
    value = F.sum(F.col("n").cast("double") * F.col("n") * F.col("all") / (F.col("branch").cast("double") * F.col("pooled"))) - F.max("branch")
    tested = (cells.select(*at, "child", "follow", "n").join(branches, [*at, "child"]).join(pool, [*group, "follow"]).join(whole, group)
              .groupBy(*at, "child", "family").agg(value.alias("value"), (F.max("kinds") - 1).alias("free")).join(members, group))
    same = F.col("value") <= F.col("free") + F.lit(DEVIATIONS) * F.sqrt(2.0 * F.col("free")) + 1e-9
    name = F.when((F.col("family") == "*") | ((F.col("members") > 1) & same), F.col("family")).otherwise(F.col("child"))
    named = saved(tested.select(*at, "child", name.alias("name")), "named")
    moved = here.drop("follow").join(named, [*at, "child"], "left")
    moved = moved.withColumns({"node": F.when(F.col("name").isNotNull(), F.concat("node", F.lit("/"), "name")).otherwise(F.col("node")),
                               "moved": F.col("name").isNotNull()}).drop("child", "name")
    return with_purity(moved).drop("moved")


def with_purity(paths: DataFrame) -> DataFrame:
    """Purity of the nodes just reached, smoothed towards that of the nodes above them."""
    sums = paths.where("moved").groupBy("host", "node").agg(F.sum("blocked").alias("_b"), F.sum("labelled").alias("_l"))
    return saved(paths.join(sums, ["host", "node"], "left").withColumn(
        "purity", F.when(F.col("moved"), smoothed(F.col("_b"), F.col("_l"), F.col("purity"))).otherwise(F.col("purity"))).drop("_b", "_l"), "nodes")


def templates(pages: DataFrame) -> DataFrame:
    """The template and purity of each (host, shape) of pages with (host, shape, verdict or NULL)."""
    labelled = F.count("verdict").alias("labelled")
    paths = saved(pages.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), labelled, F.count_if(F.col("verdict") == "block").alias("blocked")), "shapes")
    table = paths.agg(F.coalesce(smoothed(F.sum("blocked"), F.sum("labelled"), F.lit(0.5)), F.lit(0.5)).alias("purity"))  # one row
    deepest = paths.agg(F.max(F.size("shape"))).first()[0] or 0
    paths = with_purity(paths.crossJoin(F.broadcast(table)).withColumns({"node": F.lit(""), "moved": F.lit(True)})).drop("moved")
    for d in range(1, deepest + 1):
        paths = level(paths, d)
    return paths.select("host", "shape", F.col("node").alias("template"), "purity")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "verdict": verdict, "shape": shape_of(F.col("path"))})
    tree = templates(urls.select("host", "shape", "verdict"))
    by_tree = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return urls.join(tree, ["host", "shape"]).select("page_id", "host", "path", "rule", F.coalesce("verdict", by_tree).alias("verdict"), "template", "purity")


def _rules_sql(what: int) -> str:
    tried = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[what]}'" for v, h, p in tried) + " END"


def _smooth_sql(blocked: str, labelled: str, above: str) -> str:
    return f"(({blocked} + {PRIOR} * {above}) / ({labelled} + {PRIOR}))"


def _levels_sql() -> str:
    ctes = []
    for d in range(1, LEVELS + 2):
        at = f"p{d - 1}"
        ctes.append(f"""h{d} AS (SELECT *, shape[{d}] AS child, CASE WHEN shape[{d + 1}] IS NULL THEN 'end' WHEN shape[{d + 1}] = '' THEN 'empty'
            WHEN contains(shape[{d + 1}], '*') THEN 'wild' WHEN contains(shape[{d + 1}], '.') THEN 'file' ELSE 'word' END AS follow FROM {at} WHERE len(shape) >= {d}),
          k{d} AS (SELECT host, node, child, follow, SUM(n) AS n, SUM(blocked) AS blocked, SUM(labelled) AS labelled, MAX(purity) AS purity FROM h{d} GROUP BY ALL),
          b{d} AS (SELECT *, CASE WHEN children >= {WIDE} AND branch * {WIDE} < pages THEN '*'
              ELSE '*:' || CASE WHEN own >= {REJECT} THEN 'block' WHEN own <= 1 - {REJECT} THEN 'allow' ELSE 'mixed' END || ':' || main END AS family
            FROM (SELECT host, node, child, SUM(n) AS branch, {_smooth_sql('SUM(blocked)', 'SUM(labelled)', 'MAX(purity)')} AS own, arg_max(follow, row(n, follow)) AS main,
              COUNT(*) OVER (PARTITION BY host, node) AS children, SUM(SUM(n)) OVER (PARTITION BY host, node) AS pages FROM k{d} GROUP BY host, node, child)),
          c{d} AS (SELECT host, node, family, child, follow, branch, SUM(n) AS n FROM h{d} JOIN b{d} USING (host, node, child) GROUP BY ALL),
          q{d} AS (SELECT *, SUM(n) OVER (PARTITION BY host, node, family, follow) AS pooled, SUM(n) OVER (PARTITION BY host, node, family) AS whole FROM c{d}),
          t{d} AS (SELECT host, node, family, child, SUM(n::DOUBLE * n * whole / (branch::DOUBLE * pooled)) - MAX(branch) AS value FROM q{d} GROUP BY ALL),
          f{d} AS (SELECT host, node, family, COUNT(DISTINCT follow) - 1 AS free, COUNT(DISTINCT child) AS members FROM c{d} GROUP BY ALL),
          m{d} AS (SELECT host, node, child, CASE WHEN family = '*' OR (members > 1 AND value <= free + {DEVIATIONS} * sqrt(2.0 * free) + 1e-9) THEN family ELSE child END AS name
            FROM t{d} JOIN f{d} USING (host, node, family)),
          g{d} AS (SELECT host, shape, n, labelled, blocked, node || '/' || name AS node, purity FROM h{d} JOIN m{d} USING (host, node, child)),
          p{d} AS (SELECT host, shape, n, labelled, blocked, node, {_smooth_sql('SUM(blocked) OVER w', 'SUM(labelled) OVER w', 'purity')} AS purity
            FROM g{d} WINDOW w AS (PARTITION BY host, node) UNION ALL SELECT host, shape, n, labelled, blocked, node, purity FROM {at} WHERE len(shape) < {d})""")
    return ",\n".join(ctes)


SQL = f"""
WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
), shapes AS (
  SELECT *, {_rules_sql(0)} AS rule, {_rules_sql(1)} AS said,
    CASE WHEN path = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace(substr(path, 2), '{VARIABLE}', '*', 'g'), '/') END AS whole_shape FROM urls
), cut AS (SELECT *, CASE WHEN len(whole_shape) > {LEVELS} THEN list_append(whole_shape[1:{LEVELS}], '**') ELSE whole_shape END AS shape FROM shapes
), sums AS (SELECT host, shape, COUNT(*) AS n, COUNT(said) AS labelled, COUNT(CASE WHEN said = 'block' THEN 1 END) AS blocked FROM cut GROUP BY host, shape
), one AS (SELECT {_smooth_sql('SUM(blocked)', 'SUM(labelled)', '0.5')} AS purity FROM sums
), p0 AS (SELECT host, shape, n, labelled, blocked, '' AS node, {_smooth_sql('SUM(blocked) OVER (PARTITION BY host)', 'SUM(labelled) OVER (PARTITION BY host)', 'purity')} AS purity
  FROM sums, one
), {_levels_sql()}
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, node AS template, purity
FROM cut JOIN p{LEVELS + 1} USING (host, shape)
"""

"""Merkle manifest of a table with stored levels only every few steps (operator 13).

Each row is a leaf; per source the leaves ascend by id, runs of three become the digest of
their joined digests until one is left, and the sources' last digests are joined alike into
the root. Stored are the leaves and every ``KEPT``-th level above them. An aligned subtree
between two stored levels has at most 3 ** KEPT stored descendants: one group hashes them
up to the next stored level, and extracting proofs goes down the stored levels again, group
by group: the missing interior nodes are made anew from the stored descendants, the siblings
of each descendant are put before those of its ancestors, and the interior is forgotten.

A hot source is many aligned subtrees, so no group grows with it; leaves are numbered by a
distributed order. The number of steps is the height of the largest tree divided by KEPT.

Defined results: NULL columns hash as ``-``; rows without an id come first in their source
and are never tampered with; rows that share an id are ordered by their digest (equal
rows have equal digests, so their order does not show). A source of one row is its own
subroot and has no siblings there. An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import global_order
from .scratch import saved

ARITY = 3
#: Levels from one stored level to the next: an aligned subtree has 3 ** 6 = 729 stored descendants.
KEPT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODE = "tree string, pos long, size long, digest string"
PROOF = "tree string, pos long, lefts array<string>, rights array<string>"
CHECKED = "tree string, doc_id long, leaf string, proof_sha256 string, folded string"


def leaf_digest(**changed: Column) -> Column:
    """Digest of the fields of a row, some of them replaced."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def tree_name(source: Column) -> Column:
    """A source as a name that is never NULL and keeps the order: NULL, then bytes."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), source))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def steps(size: int) -> int:
    """Levels until one node is left, at most KEPT."""
    n = 0
    while size > 1 and n < KEPT:
        size, n = -(-size // ARITY), n + 1
    return n


def interior(digests: list[str], levels: int) -> list[list[str]]:
    """The levels of an aligned subtree, its stored descendants first."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([sha("".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
    return out


def siblings(rows: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of a descendant's ancestors in their runs, by level."""
    lefts, rights = [], []
    for row in rows[:-1]:
        first = at // ARITY * ARITY
        lefts.append("".join(row[first:at]))
        rights.append("".join(row[at + 1:first + ARITY]))
        at //= ARITY
    return lefts, rights


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        digest = sha(left + digest + right)
    return digest


def aligned(nodes: DataFrame) -> DataFrame:
    """Nodes with the aligned subtree that they stand in."""
    return nodes.withColumn("part", F.floor(F.col("pos") / F.lit(ARITY ** KEPT)).cast("long"))


def grow(nodes: DataFrame) -> list[DataFrame]:
    """The stored levels of all trees of (tree, pos, size, digest), the last with one node to a tree."""
    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        size = int(rows["size"].iloc[0])
        top = interior(rows["digest"].tolist(), steps(size))[-1]
        return pd.DataFrame({"tree": key[0], "pos": [key[1]], "size": [-(-size // ARITY ** KEPT)], "digest": top})

    kept = [nodes]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        kept.append(saved(aligned(kept[-1].select("tree", "pos", "size", "digest")).groupBy("tree", "part").applyInPandas(up, NODE), "merkle"))
        largest = -(-largest // ARITY ** KEPT)
    return kept


def descend(nodes: DataFrame, above: DataFrame, emit, schema: str) -> DataFrame:
    """For each stored node what ``emit`` makes of its siblings up to the root; ``above`` has those of the next stored level."""
    def down(key: tuple, rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        up_left, up_right = list(upper["lefts"].iloc[0]), list(upper["rights"].iloc[0])
        levels = interior(rows["digest"].tolist(), steps(int(rows["size"].iloc[0])))
        out = []
        for at, row in enumerate(rows.itertuples(index=False)):
            lefts, rights = siblings(levels, at)
            out.append(emit(row, lefts + up_left, rights + up_right))
        return pd.DataFrame(out, columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    return aligned(nodes).groupBy("tree", "part").cogroup(
        above.withColumnRenamed("pos", "part").groupBy("tree", "part")).applyInPandas(down, schema)


def proofs(kept: list[DataFrame], above: DataFrame) -> DataFrame:
    """Siblings up to the root of the nodes of the lowest stored level but the leaves; ``above`` has those of the trees."""
    for nodes in reversed(kept):
        above = saved(descend(nodes, above, lambda r, lefts, rights: (r.tree, r.pos, lefts, rights), PROOF), "merkle")
    return above


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: its leaf, the subroot of its source, the root, the digest of its siblings, and the root that
    its (where ``tampered`` is not NULL, changed) text gives with them."""
    spark = docs.sparkSession
    rows = docs.select(*FIELDS, *([tampered.alias("_tampered")] if tampered is not None else []))
    leaves = rows.select("doc_id", tree_name(F.col("source")).alias("tree"), leaf_digest().alias("digest"), *(
        [F.when(F.col("_tampered").isNotNull(), leaf_digest(text=F.col("_tampered"))).alias("changed")] if tampered is not None
        else [F.lit(None).cast("string").alias("changed")]))
    leaves = global_order(leaves, [F.asc_nulls_first("doc_id"), F.asc("digest")], "_nth", partition_by=["tree"], size_col="size")
    leaves = saved(leaves.select("doc_id", "tree", (F.col("_nth") - 1).alias("pos"), "size", "digest", "changed"), "leaves")

    kept = grow(leaves)
    tops = kept[-1].select(F.col("tree").alias("name"), "digest")  # one row to a source
    subroots = saved(global_order(tops, [F.asc("name")], "_nth", size_col="size").select(
        "name", F.lit("").alias("tree"), (F.col("_nth") - 1).alias("pos"), "size", "digest"), "subroots")
    across = grow(subroots)
    root = across[-1].select(F.col("digest").alias("root"))  # one row

    nothing = spark.createDataFrame([("", 0, [], [])], PROOF)
    of_sources = proofs([subroots.drop("name"), *across[1:-1]], nothing) if len(across) > 1 else nothing
    above = of_sources.join(subroots.select("name", "pos"), "pos").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights")
    above = proofs(kept[1:-1], above)
    checked = descend(leaves, above, lambda r, lefts, rights: (
        r.tree, r.doc_id, r.digest, sha("".join(a + b for a, b in zip(lefts, rights))), fold(r.changed or r.digest, lefts, rights)), CHECKED)
    ids = F.col("doc_id")
    out = checked.join(subroots.select(F.col("name").alias("tree"), F.col("digest").alias("subroot")), "tree").crossJoin(F.broadcast(root))
    return out.select(ids, "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def newlines_cut(docs: DataFrame) -> Column:
    """The text without its line ends for every other id (by checksum), else NULL."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))


def _tree_sql(name: str, leaves: str, walkers: str, levels: int) -> str:
    """Levels of the trees of ``leaves`` (tree, pos, height, h) and the way up of ``walkers`` (row_no, tree, pos, height, folded, proof)."""
    ctes = [f"{name}n0 AS ({leaves})", f"{name}d0 AS ({walkers})"]
    for k in range(levels):
        ctes += [
            f"""{name}w{k} AS (SELECT tree, height, pos // 3 AS run, coalesce(max(CASE WHEN pos % 3 = 0 THEN h END), '') AS a,
              coalesce(max(CASE WHEN pos % 3 = 1 THEN h END), '') AS b, coalesce(max(CASE WHEN pos % 3 = 2 THEN h END), '') AS c
              FROM {name}n{k} WHERE height > {k} GROUP BY tree, height, pos // 3)""",
            f"{name}n{k + 1} AS (SELECT tree, run AS pos, height, sha256(a || b || c) AS h FROM {name}w{k})",
            f"""{name}s{k} AS (SELECT d.*, coalesce(CASE pos % 3 WHEN 0 THEN '' WHEN 1 THEN a ELSE a || b END, '') AS lefts,
              coalesce(CASE pos % 3 WHEN 0 THEN b || c WHEN 1 THEN c ELSE '' END, '') AS rights
              FROM {name}d{k} d LEFT JOIN {name}w{k} w ON d.tree = w.tree AND d.pos // 3 = w.run)""",
            f"""{name}d{k + 1} AS (SELECT row_no, tree, pos // 3 AS pos, height, CASE WHEN height > {k} THEN sha256(lefts || folded || rights) ELSE folded END AS folded,
              proof || lefts || rights AS proof FROM {name}s{k})"""]
    tops = " UNION ALL ".join(f"SELECT tree, h FROM {name}n{k} WHERE height = {k}" for k in range(levels + 1))
    return ", ".join([*ctes, f"{name}tops AS ({tops})"])


def _height_sql(size: str, levels: int) -> str:
    return " + ".join(f"({size} > {ARITY ** k})::INT" for k in range(levels))


#: Levels of the trees that the SQL spells out: 4.8 million rows a source, 2,187 sources.
LEVELS, SOURCE_LEVELS = 14, 7
_FIELD = " || ".join(f"(CASE WHEN {{{c}}} IS NULL THEN '-' ELSE strlen({{{c}}}) || ':' || {{{c}}} END)" for c in FIELDS)
_TEXTS = {c: f"CAST({c} AS VARCHAR)" for c in FIELDS}
_SHIFT = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"

SQL = f"""
WITH hashed AS (
  SELECT row_number() OVER () AS row_no, doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree,
    sha256({_FIELD.format(**_TEXTS)}) AS leaf, sha256({_FIELD.format(**(_TEXTS | {"text": "replace(text, chr(10), '')"}))}) AS changed,
    xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda s, byte: list_reduce([xor(s, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: {_SHIFT})), 4294967295) % 2 = 0 AS tampered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, COUNT(*) OVER (PARTITION BY tree) AS size FROM hashed
), {_tree_sql("doc_", f"SELECT tree, pos, {_height_sql('size', LEVELS)} AS height, leaf AS h FROM leaves",
              f"SELECT row_no, tree, pos, {_height_sql('size', LEVELS)} AS height, CASE WHEN tampered THEN changed ELSE leaf END AS folded, '' AS proof FROM leaves", LEVELS)},
subroots AS (
  SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, COUNT(*) OVER () AS size FROM doc_tops
), {_tree_sql("src_", f"SELECT '' AS tree, pos, {_height_sql('size', SOURCE_LEVELS)} AS height, subroot AS h FROM subroots",
              f"SELECT row_no, '' AS tree, s.pos, {_height_sql('size', SOURCE_LEVELS)} AS height, folded, proof FROM doc_d{LEVELS} d JOIN subroots s ON d.tree = s.name",
              SOURCE_LEVELS)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM leaves JOIN src_d{SOURCE_LEVELS} USING (row_no) JOIN subroots ON leaves.tree = name, src_tops
"""

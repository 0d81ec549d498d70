"""Secret scans: corpus-wide ownership frequency. Column expressions and joins only.

Base kinds are found leftmost and without overlap in every whole text:

* ``assign``: a keyword, ``:`` or ``=``, and a value of 12 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 18 or more characters;
* ``hex``: 16 or more of ``0-9a-f``.

The method adds ``owned`` spans: long tokens of letters and digits that no base span
touches, that look live, and that few owners hold in few repositories. For that the hash of each candidate
value is counted over distinct repositories and owners of the whole corpus: a value that many owners hold is a widely
copied example, one that few owners hold in many repositories is copied within them (a template), and one that few hold in
few and that looks random is a credential of its owner (``n_example``, ``n_shared`` and ``n_live`` count them among a
text's spans).

The work is about linear in a text's matches but for sorting them: running values are made chunk by chunk, tokens meet
base spans in one sweep each way over all spans by position, and a masked text is cut at every ``CHUNK``-th span first.

Counts go (hash, owner, repository) -> (hash, owner) -> hash, each with partial sums, so a
value with a third of all rows is small after the first step; the join back reads one row
per distinct text. Rows: null text is empty; a null owner or repository is a value of its
own; equal texts have equal spans, so repeated rows need no row key; offsets are code
points; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import saved

KINDS = ("assign", "access", "hex", "owned")
#: Fixed patterns of the base kinds; group 1 of ASSIGN is the value. Letters of the keywords stand in either case.
ASSIGN = (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"
OWNED = r"((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,})"
LEAST = {"assign": 12, "access": 18, "hex": 16, "owned": 20}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "owned": OWNED}
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234"
#: A value held by more owners is a widely copied example.
MAX_OWNERS = 2
#: A value that few owners hold in more repositories is copied within them.
MAX_REPOSITORIES = 4
#: Elements of a chunk of a running value.
CHUNK = 128
#: Fewest different characters of a value that looks random.
MIN_DISTINCT = 8

SPAN = "array<struct<start:int,kind:int,end:int,hash:string,live:boolean>>"


def looks_live(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT) & value.rlike("[0-9]") & ~value.rlike(PLACEHOLDER)


def _spans(text: Column, kind: str) -> Column:
    """All matches of a kind that are long enough, by position.

    The scan is anchored where the last match ended and takes the shortest gap, so it
    makes the same matches as a plain search, and also yields the gaps before them.
    """
    scan = F.lit(r"\G([\s\S]*?)(" + PATTERNS[kind] + ")")
    found = F.arrays_zip(*(F.regexp_extract_all(text, scan, F.lit(g)).alias(n) for g, n in ((1, "gap"), (2, "whole"), (3, "value"))))

    def placed(m: Column, at: Column) -> Column:
        start, value = at + F.length(m["gap"]), m["value"]
        good = F.length(value) >= LEAST[kind]
        if kind == "owned":
            good = good & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        return F.struct(start.alias("start"), (start + F.length(m["whole"])).alias("end"), value.alias("value"), good.alias("good"))

    def spans(items: Column) -> Column:
        before = _before(F.transform(items, lambda m: F.length(m["gap"]) + F.length(m["whole"])), 0, lambda a, b: a + b)
        return F.transform(F.filter(F.zip_with(items, before, placed), lambda s: s["good"]), lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"),
            F.sha2(s["value"], 256).alias("hash"), looks_live(s["value"]).alias("live")))

    return F.when(text.rlike(PATTERNS[kind]), _named_once(found, spans)).otherwise(F.array().cast(SPAN))


def _named_once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(F.struct(value.alias("v"))), lambda x: use(x["v"])), F.lit(0))


def _before(values: Column, zero: int, fold) -> Column:
    """For each element of an array of numbers the fold of those before it.

    An accumulator that is an array would be copied at each step; here chunks are folded first, then each element's part of its chunk."""
    def chunked(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda i: F.slice(all_, i * CHUNK + 1, CHUNK))

    def run(chunks: Column) -> Column:
        whole = F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), fold))
        starts = _named_once(whole, lambda w: F.transform(w, lambda _, i: F.aggregate(F.slice(w, 1, i), F.lit(zero), fold)))
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: F.transform(c, lambda _, k: F.aggregate(F.slice(c, 1, k), at, fold))))

    return _named_once(values, lambda v: F.when(F.size(v) > 0, _named_once(chunked(v), run)).otherwise(F.array().cast("array<int>")))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, unordered."""
    return F.concat(*(_spans(text, k) for k in KINDS[:3]))


def untouched(spans: Column) -> Column:
    """Of spans by start, then kind: the base ones, and the owned ones that overlap none of them.

    Two sweeps: one knows how far the base spans so far reach, the other, from the end, where the next one starts."""
    far = 2 ** 31 - 1

    def kept(all_: Column) -> Column:
        reach = _before(F.transform(all_, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(-1)), -1, lambda a, b: F.greatest(a, b))
        first = F.reverse(_before(F.transform(F.reverse(all_), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(far)), far, lambda a, b: F.least(a, b)))
        marked = F.zip_with(F.zip_with(all_, reach, lambda s, r: F.struct(s.alias("s"), (s["start"] >= r).alias("clear"))), first,
                            lambda m, f: F.struct(m["s"].alias("s"), ((m["s"]["kind"] < 3) | (m["clear"] & (m["s"]["end"] <= f))).alias("keep")))
        return F.transform(F.filter(marked, lambda m: m["keep"]), lambda m: m["s"])

    return _named_once(spans, kept)


def with_candidates(rows: DataFrame, text: Column) -> DataFrame:
    """Rows with ``cands``: base spans and the candidates for ``owned`` (those that touch no base span), unordered.

    The scans are named once, so that each is made once a text."""
    more = F.when(text.rlike(OWNED), _spans(text, "owned")).otherwise(F.array().cast(SPAN))
    both = F.transform(F.array(F.struct(base_spans(text).alias("base"), more.alias("more"))), lambda m: F.when(
        (F.size(m["base"]) == 0) | (F.size(m["more"]) == 0), F.concat(m["base"], m["more"])).otherwise(untouched(F.array_sort(F.concat(m["base"], m["more"])))))
    return rows.withColumn("cands", F.get(both, F.lit(0)))


def _named(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None,
            max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """id, counts, base_sha256, spans, n_live, n_shared, n_example, and ``found``: the spans with their kind and whether they are live.

    By default the owner is ``source`` and the repository is source and language.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.to_json(F.struct("source", "lang")) if repository is None else repository
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), owner.cast("string").alias("owner"), repository.cast("string").alias("repo"), text.alias("_text"))
    rows = with_candidates(rows, F.col("_text")).withColumn("digest", F.sha2("_text", 256))
    table = saved(rows.drop("_text"), "candidates")
    some = table.filter(F.size("cands") > 0)
    held = some.select("owner", "repo", F.explode(F.col("cands.hash")).alias("hash")).distinct()
    held = held.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    held = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    texts = some.groupBy("digest").agg(F.first("cands").alias("cands"))
    spans = texts.select("digest", F.inline("cands")).join(held, "hash")
    few, here = F.col("owners") <= max_owners, F.col("repos") <= max_repositories
    judged = spans.withColumn("mine", F.col("live") & few & here) \
        .filter((F.col("kind") < 3) | F.col("mine")).groupBy("digest").agg(
            F.collect_list(F.struct("start", "kind", "end", F.col("mine").alias("live"))).alias("found"),
            F.count(F.when(F.col("mine"), 1)).alias("n_live"), F.count(F.when(few & ~here, 1)).alias("n_shared"), F.count(F.when(~few, 1)).alias("n_example"))
    base = F.filter("cands", lambda s: s["kind"] < 3)
    rows = table.join(judged, "digest", "left")
    count = lambda k: F.size(F.filter("cands", lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return rows.select(
        id_col, *(count(k) for k in KINDS[:3]), F.sha2(_named(base), 256).alias("base_sha256"),
        F.when(F.col("found").isNull(), "").otherwise(_named(F.col("found"))).alias("spans"),
        *(F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n_live", "n_shared", "n_example")),
        "digest", "found")


def masked(text: Column, found: Column, mask: str = "<SECRET>") -> Column:
    """The text with its live spans replaced; touching or overlapping ones become one mask each."""
    kind = "array<struct<start:int,kind:int,end:int,live:boolean>>"
    live = F.array_sort(F.filter(F.coalesce(found, F.array().cast(kind)), lambda s: s["live"]))

    def cut(all_: Column) -> Column:
        """Where the kept text before a span begins, and the span; spans that start inside another add nothing."""
        reach = _before(F.transform(all_, lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))
        return F.filter(F.zip_with(all_, reach, lambda s, at: F.struct(at.alias("gap"), s["start"].alias("start"), s["end"].alias("end"))), lambda c: c["start"] >= c["gap"])

    cuts = _named_once(live, cut)
    last = F.aggregate(live, F.lit(0), lambda at, s: F.greatest(at, s["end"]))

    def chunk(part: Column) -> Column:
        # a piece of text from the first gap to the last span's start, cut in turn: places in a whole text are found by reading it
        piece = F.substring(text, F.get(part, F.lit(0))["gap"] + 1, F.element_at(part, -1)["start"] - F.get(part, F.lit(0))["gap"])
        one = F.transform(F.array(F.struct(piece.alias("t"), F.get(part, F.lit(0))["gap"].alias("from"), part.alias("part"))), lambda p: F.array_join(
            F.transform(p["part"], lambda c: F.concat(F.substring(p["t"], c["gap"] - p["from"] + 1, c["start"] - c["gap"]), F.lit(mask))), ""))
        return F.get(one, F.lit(0))

    whole = F.transform(F.array(F.struct(cuts.alias("cuts"), last.alias("last"))), lambda m: F.concat(
        F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(m["cuts"]) - 1) / CHUNK).cast("int")),
                                 lambda i: chunk(F.slice(m["cuts"], i * CHUNK + 1, CHUNK))), ""),
        F.substring(text, m["last"] + 1, F.length(text))))
    return F.when(F.size(live) == 0, text).otherwise(F.get(whole, F.lit(0)))


def _matches(kind: int, pattern: str, group: int) -> str:
    """SQL for all matches of a kind: what lies between them gives their places."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT row, {kind} AS kind, length(v[i + 1]) AS size, v[i + 1] AS value,
    CAST(list_sum(list_transform(g[1:(i + 1)], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i + 1]) AS w
  FROM (SELECT *, UNNEST(range(len(m))) AS i FROM (SELECT row, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS v,
    string_split_regex(t, '{quoted}') AS g FROM docs))"""


_LIKE_LIVE = (f"len(list_distinct(string_split(value, ''))) >= {MIN_DISTINCT} AND regexp_matches(value, '[0-9]') "
              f"AND NOT regexp_matches(value, '{PLACEHOLDER}')")
#: The query's result in SQL; DuckDB has no look-behind, but runs of the class are maximal without it.
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, source, lang FROM documents),
base AS (
  SELECT row, kind, value, a, a + w AS z FROM ({_matches(0, ASSIGN, 1)} UNION ALL {_matches(1, ACCESS, 1)} UNION ALL {_matches(2, HEX, 1)})
  WHERE size >= CASE kind WHEN 0 THEN {LEAST["assign"]} WHEN 1 THEN {LEAST["access"]} ELSE {LEAST["hex"]} END
), tokens AS (
  SELECT row, kind, value, a, a + w AS z FROM ({_matches(3, "([A-Za-z0-9+/_=-]{20,})", 1)})
  WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
), spans AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = t.row AND t.a < b.z AND b.a < t.z)
), held AS (
  SELECT value, COUNT(DISTINCT coalesce(source, chr(1))) AS owners, COUNT(DISTINCT (coalesce(source, chr(1)), coalesce(lang, chr(1)))) AS repos
  FROM spans JOIN docs USING (row) GROUP BY value
), judged AS (
  SELECT *, owners <= {MAX_OWNERS} AS few, repos <= {MAX_REPOSITORIES} AS here, owners <= {MAX_OWNERS} AND repos <= {MAX_REPOSITORIES} AND {_LIKE_LIVE} AS mine
  FROM spans JOIN held USING (value)
), kept AS (
  SELECT *, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owned' END || ':' || a || ':' || z AS name
  FROM judged WHERE kind < 3 OR mine
), sums AS (
  SELECT row, COUNT(*) FILTER (WHERE kind = 0) AS n_assign, COUNT(*) FILTER (WHERE kind = 1) AS n_access, COUNT(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(name, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base_names, string_agg(name, ',' ORDER BY a, kind) AS names,
    COUNT(*) FILTER (WHERE mine) AS n_live, COUNT(*) FILTER (WHERE few AND NOT here) AS n_shared,
    COUNT(*) FILTER (WHERE NOT few) AS n_example
  FROM kept GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_names, '')) AS base_sha256,
  coalesce(names, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN sums USING (row)
"""

"""Merkle manifest of a dataset: a tree of digests per group, and one over the groups' roots.

A node is labelled with the interval [lo, hi) of leaf ranks it covers. Ancestors are attached by containment:
a leaf of rank r lies below the nodes of its tree whose interval holds r. The join is bucketed by levels:
BAND levels form a band, the nodes of a band meet the band's own leaves in buckets of 2**BAND ranks of them, so
a bucket is bounded whatever the size of a tree, and a tree of n leaves takes log2(n) / BAND joins. Inside a
parent, what its interval covers beyond the child's names the siblings; their digests make the child's proof.

A leaf is the digest of the chosen columns of a row. Leaves of a group ascend by the order column (null
first), then by digest; rows equal in both are interchangeable. Runs of two consecutive nodes
become one; the last run may be a single node. The group is a string column, null is a group
of its own and comes first. Null in another column counts as ``-``. An empty table has no nodes and no proofs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tables import stored

#: Levels of a band; a bucket holds at most 2**BAND of the nodes that the band starts from.
BAND = 12

NODES = "tree string, size long, level int, lo long, hi long, digest string"
_PATH = "sides string, siblings string, subroot string, root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns' values, each behind its length in bytes, ``-`` for a null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def height(size: Column) -> Column:
    """Levels above the leaves of a tree of so many: the runs of two halve them, rounding up."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """The leaves with their rank (at) in their tree and the tree's size, by a range partitioning.

    No task gets a tree: leaves are dealt by range of (tree, order, digest, row), numbered within a part, and the
    parts before are added. ``row`` parts leaves that are equal otherwise.
    """
    keys = ["tree", *order, "digest", "row"]
    dealt = stored(leaves.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("size"))
    own = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*keys[1:])) - 1
    placed = dealt.withColumn("own", own).join(counts, ["tree", "part"])
    return stored(placed.withColumn("at", F.col("own") + F.col("base")).drop("own", "base", "part", "row"), "ranked")


def _fold(level: int):
    """The nodes that a bucket's nodes of a level make on the next BAND levels."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        size, tree = table.column("size")[0].as_py(), table.column("tree")[0].as_py()
        lo, hi, digests = table.column("lo").to_numpy(), table.column("hi").to_numpy(), table.column("digest").to_pylist()
        out: list[tuple] = []
        for up in range(level + 1, min(level + BAND, (size - 1).bit_length()) + 1):
            digests = [digest(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
            lo, hi = lo[::2], np.append(hi[1::2], hi[-1:] if len(hi) % 2 else hi[:0])
            out.extend(zip([up] * len(digests), lo.tolist(), hi.tolist(), digests, strict=True))
        columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 4
        types = (pa.int32(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array([tree] * len(out), pa.string()), pa.array([size] * len(out), pa.int64())]
        return pa.Table.from_arrays([*arrays, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["tree", "size", "level", "lo", "hi", "digest"])

    return fold


def grown(leaves: DataFrame) -> list[DataFrame]:
    """The nodes above ranked leaves, one table for each band of levels."""
    top = leaves.agg(F.max(height(F.col("size")))).first()[0] or 0
    base = leaves.select("tree", "size", F.lit(0).alias("level"), F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), "digest")
    bands = []
    for level in range(0, top, BAND):
        inner = base.where(height(F.col("size")) > level).withColumn("bucket", F.shiftright("lo", level + BAND))
        bands.append(stored(inner.groupBy("tree", "bucket").applyInArrow(_fold(level), NODES), "nodes"))
        base = bands[-1].where(F.col("level") == level + BAND)
    return bands


def nodes(leaves: DataFrame) -> DataFrame:
    """All nodes of ranked leaves: tree, size, level, lo, hi, digest, the leaves as level 0."""
    out = leaves.select("tree", "size", F.lit(0).cast("int").alias("level"), F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), "digest")
    for band in grown(leaves):
        out = out.unionByName(band)
    return out


def roots(leaves: DataFrame, bands: list[DataFrame]) -> DataFrame:
    """tree, subroot: the top of each tree; the leaf itself where it is alone."""
    tops = leaves.where(F.col("size") == 1).select("tree", F.col("digest").alias("subroot"))
    for band in bands:
        tops = tops.union(band.where(F.col("level") == height(F.col("size"))).select("tree", "digest"))
    return tops


def _attach(level: int):
    """The path from each base node of a bucket to the bucket's top, and on by the path given for the top."""

    def attach(base: pa.Table, rest: pa.Table) -> tuple[pa.Table, list[str], list[list[str]]]:
        base = base.sort_by("lo")
        lo, hi = base.column("lo").to_numpy(), base.column("hi").to_numpy()
        above = rest.filter(pc.is_valid(rest.column("level"))).sort_by([("level", "ascending"), ("lo", "ascending")])
        levels, edges = np.unique(above.column("level").to_numpy(), return_index=True)
        edges = [*edges.tolist(), above.num_rows]
        los, his, texts = above.column("lo").to_numpy(), above.column("hi").to_numpy(), above.column("digest").to_pylist()
        sides: list[list[str]] = [[] for _ in range(len(lo))]
        siblings: list[list[str]] = [[] for _ in range(len(lo))]
        own_lo, own_hi, level_lo, level_hi, level_digests = lo, hi, lo, hi, base.column("digest").to_pylist()
        for k in range(len(levels)):
            up_lo, up_hi, up_digests = los[edges[k] : edges[k + 1]], his[edges[k] : edges[k + 1]], texts[edges[k] : edges[k + 1]]
            parent = np.searchsorted(up_lo, lo, side="right") - 1
            if (parent < 0).any() or (up_hi[parent] <= lo).any():
                raise ValueError(f"a node of level {level} lies in no interval of level {levels[k]}")
            # the parent's interval without the child's: the part before it, or the part after it, or nothing
            left, right = up_lo[parent] < own_lo, up_hi[parent] > own_hi
            sibling = np.where(left, np.searchsorted(level_lo, up_lo[parent]), np.searchsorted(level_lo, own_hi)).tolist()
            for i, (is_left, is_right, j) in enumerate(zip(left.tolist(), right.tolist(), sibling, strict=True)):
                sides[i].append("L" if is_left else "R" if is_right else "-")
                if is_left or is_right:
                    siblings[i].append(level_digests[j])
            own_lo, own_hi = up_lo[parent], up_hi[parent]
            level_lo, level_hi, level_digests = up_lo, up_hi, up_digests
        upper = rest.filter(pc.is_null(rest.column("level"))).select(["sides", "siblings", "subroot", "root"]).to_pylist()
        if len(upper) != 1:
            raise ValueError(f"{len(upper)} paths lead on from a bucket of level {level}")
        up = upper[0]
        more = [up["siblings"][i : i + 64] for i in range(0, len(up["siblings"]), 64)]
        return base, ["".join(s) + up["sides"] for s in sides], [s + more for s in siblings], up["subroot"], up["root"]

    return attach


def _path(level: int):
    attach = _attach(level)

    def path(base: pa.Table, rest: pa.Table) -> pa.Table:
        if not base.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("tree", pa.string()), ("at", pa.int64()), *((c, pa.string()) for c in ("sides", "siblings", "subroot", "root")))})
        base, sides, siblings, subroot, root = attach(base, rest)
        n = base.num_rows
        at = pa.array((base.column("lo").to_numpy() >> level).tolist(), pa.int64())
        columns = [base.column("tree").cast(pa.string()), at, pa.array(sides), pa.array(["".join(s) for s in siblings]), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string())]
        return pa.Table.from_arrays(columns, names=["tree", "at", "sides", "siblings", "subroot", "root"])

    return path


def folded(leaf: str, sides: str, siblings: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    rest = iter(siblings)
    for side in sides:
        leaf = digest(next(rest), leaf) if side == "L" else digest(leaf, next(rest)) if side == "R" else digest(leaf)
    return leaf


def _proof(payload: list[tuple[str, pa.DataType]]):
    attach = _attach(0)

    def prove(base: pa.Table, rest: pa.Table) -> pa.Table:
        names = [*(n for n, _ in payload), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        types = [*(t for _, t in payload), *[pa.string()] * 5, pa.bool_()]
        if not base.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})
        base, sides, siblings, subroot, root = attach(base, rest)
        leaf, now = base.column("digest").to_pylist(), base.column("current").to_pylist()
        ends = [folded(x, s, p) for x, s, p in zip(now, sides, siblings, strict=True)]
        columns = [*(base.column(n).to_pylist() for n, _ in payload), leaf, [subroot] * len(leaf), [root] * len(leaf), [digest(*p) for p in siblings], ends, [e == root for e in ends]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return prove


def _rest(band: DataFrame | None, paths: DataFrame, level: int) -> DataFrame:
    """What the base nodes of a level are joined with: the nodes above them in the band, and the paths from the buckets' tops."""
    tops = paths.select("tree", F.col("at").alias("bucket"), *(F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("lo", "long"), ("hi", "long"), ("digest", "string"))), "sides", "siblings", "subroot", "root")
    if band is None:
        return tops
    inner = band.select("tree", F.shiftright("lo", level + BAND).alias("bucket"), "level", "lo", "hi", "digest", *(F.lit(None).cast("string").alias(c) for c in ("sides", "siblings", "subroot", "root")))
    return inner.union(tops)


def _climb(leaves: DataFrame, bands: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths that lead on from the buckets of the leaves' band; tops has tree, sides, siblings, subroot, root of whole trees."""
    sizes = leaves.where(F.col("at") == 0).select("tree", F.greatest(F.lit(0), F.floor((height(F.col("size")) - 1) / BAND)).cast("int").alias("last"))
    tops = stored(tops.join(sizes, "tree"), "tops") if len(bands) > 1 else tops.withColumn("last", F.lit(0))
    start = lambda band: tops.where(F.col("last") == band).select("tree", F.lit(0).cast("long").alias("at"), "sides", "siblings", "subroot", "root")
    paths = start(max(0, len(bands) - 1))
    for k in range(len(bands) - 1, 0, -1):
        level = k * BAND
        base = bands[k - 1].where((F.col("level") == level) & (height(F.col("size")) > level)).withColumn("bucket", F.shiftright("lo", level + BAND))
        joined = base.groupBy("tree", "bucket").cogroup(_rest(bands[k], paths, level).groupBy("tree", "bucket"))
        paths = stored(joined.applyInArrow(_path(level), f"tree string, at long, {_PATH}"), "paths").union(start(k - 1))
    return paths


def proofs(docs: DataFrame, columns: list[str], group: str, order: str, current: DataFrame | None = None, changed: dict[str, Column] | None = None) -> DataFrame:
    """order column, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``columns`` make the leaf. ``changed`` gives columns as they are found now, where they may differ from the
    manifest's; ``folded_root`` starts from the digest of these, ``verified`` tells whether it is the root.
    """
    now = row_digest([(changed or {}).get(c, F.col(c)) for c in columns])
    leaf = row_digest([F.col(c) for c in columns])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stored(docs.select(tree.alias("tree"), F.col(order).alias("key"), leaf.alias("digest"), now.alias("current"), F.monotonically_increasing_id().alias("row")), "leaves")
    placed = ranked(leaves, ["key"])
    bands = grown(placed)

    subroots = roots(placed, bands).withColumnRenamed("tree", "key").withColumnRenamed("subroot", "digest")
    upper = ranked(subroots.select(F.lit("").alias("tree"), "key", "digest", F.lit(0).alias("row")), ["key"])
    upper_bands = grown(upper)
    whole = roots(upper, upper_bands).select("tree", F.lit("").alias("sides"), F.lit("").alias("siblings"), F.lit("").alias("subroot"), F.col("subroot").alias("root"))
    tops = _below(upper, upper_bands, _climb(upper, upper_bands, whole))

    paths = _climb(placed, bands, tops)
    base = placed.select("tree", "key", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), "digest", "current", F.shiftright("at", BAND).alias("bucket"))
    joined = base.groupBy("tree", "bucket").cogroup(_rest(bands[0] if bands else None, paths, 0).groupBy("tree", "bucket"))
    kind = docs.schema[order].dataType
    fields = ", ".join(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
    out = joined.applyInArrow(_proof([("key", to_arrow_type(kind))]), f"key {kind.simpleString()}, {fields}, verified boolean")
    return out.withColumnRenamed("key", order)


def _below(leaves: DataFrame, bands: list[DataFrame], paths: DataFrame) -> DataFrame:
    """tree, sides, siblings, subroot, root of each leaf of the upper tree, which is itself a tree's subroot."""
    base = leaves.select("tree", "key", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"), "digest", F.shiftright("at", BAND).alias("bucket"))
    joined = base.groupBy("tree", "bucket").cogroup(_rest(bands[0] if bands else None, paths, 0).groupBy("tree", "bucket"))
    found = stored(joined.applyInArrow(_path(0), f"tree string, at long, {_PATH}"), "tops")
    return found.select("at", "sides", "siblings", "root").join(leaves.select("at", F.col("key").alias("tree"), F.col("digest").alias("subroot")), "at").select("tree", "sides", "siblings", "subroot", "root")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered(docs: DataFrame) -> dict[str, Column]:
    """What the query checks the manifest against: one character more wherever 7 divides the id's CRC."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return {"n_chars": F.when(F.coalesce(hit, F.lit(False)), F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def oracle() -> str:
    """The query's rows in DuckDB: nodes level by level, siblings by rank, and each leaf folded along them."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda n: f"sha256({' || '.join(field(n if c == 'n_chars' else c) for c in COLUMNS)})"
    return f"""
WITH RECURSIVE rows AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: list_transform(range(8), lambda k: ((ascii(c) >> k::INT) & 1)::BIGINT)))),
      lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf, {leaf("(CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS now
  FROM rows
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS size FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, rank AS i, size AS n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n
), subroots AS (
  SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS size FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, rank AS i, size AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 2, n
), steps AS (
  SELECT s.lang, s.subroot, s.height, s.rank, (SELECT max(level) FROM upper) AS top, (SELECT h FROM upper WHERE n = 1) AS root FROM subroots s
), fold AS (
  SELECT p.doc_id, p.leaf, s.subroot, s.root, p.lang, p.rank AS i, s.rank AS j, s.height, s.top, 0 AS level, p.now AS h, '' AS proof
  FROM placed p JOIN steps s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT f.doc_id, f.leaf, f.subroot, f.root, f.lang, f.i, f.j, f.height, f.top, f.level + 1,
    sha256(CASE WHEN (CASE WHEN f.level < f.height THEN f.i >> f.level ELSE f.j >> (f.level - f.height) END) % 2 = 1
      THEN coalesce(a.h, b.h, '') || f.h ELSE f.h || coalesce(a.h, b.h, '') END),
    f.proof || coalesce(a.h, b.h, '')
  FROM fold f
  LEFT JOIN nodes a ON f.level < f.height AND a.lang IS NOT DISTINCT FROM f.lang AND a.level = f.level AND a.i = xor(f.i >> f.level, 1)
  LEFT JOIN upper b ON f.level >= f.height AND b.level = f.level - f.height AND b.i = xor(f.j >> greatest(f.level - f.height, 0), 1)
  WHERE f.level < f.height + f.top
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM fold WHERE level = height + top
"""

"""Merkle manifest of a table of documents, in DataFrame functions only.

Each row is a leaf: the digest of its encoded fields.  Per tree key (language) the
leaves are numbered in order; every ``fan`` consecutive nodes become one parent
until one is left, the subroot; the subroots, in the order of their keys, form one
more tree, whose top is the root.

Slot pivot: a node's number modulo ``fan`` is its slot below its parent.
Conditional aggregates over the parent spread the children's digests into ``fan``
columns; the digest of their concatenation is the parent, and concatenating the
columns but the own one gives a child its siblings.  ``STEP`` levels are climbed
after one shuffle: nodes are dealt by the block of ``fan ** STEP`` that they belong
to and sorted once, and every level's window is a prefix of that sort order.  One
node a block goes on to the next round; the blocks' paths come back by a join.

Leaves are numbered without a window over a whole tree: a range shuffle by (tree,
order, leaf, input position), each range's sorted rows counted per tree, and the
counts summed over the ranges before.  Equal rows differ in their input position,
so that a large group of copies is split as well.

Defined results: null fields read ``-``; a null id comes first, equal ids are
ordered by leaf digest, equal rows are leaves of their own; a null language is a
tree of its own, before the others; an empty table has no rows; other columns,
whatever their names, are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, stage

FAN, STEP = 2, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    return digest(*[field(c) for c in fields.values()])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (tree, ...) with ``pos``, the place within the tree by ``order``, and
    ``size``, the tree's number of rows."""
    keys = ["tree", *order]
    ranged = (rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys, "salt")
              .sortWithinPartitions(*keys).drop("salt"))
    ranged = stage(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), f"{name}-ranges")
    runs = ranged.groupBy(F.col("part").alias("run_part"), F.col("tree").alias("run_tree")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    every = Window.partitionBy("run_tree")
    before = every.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stage(runs.select("run_part", "run_tree", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                             F.sum("n").over(every).alias("size"), F.octet_length(F.col("run_tree").cast("string")).alias("bytes")), f"{name}-runs")
    widest = runs.agg(F.max("bytes")).first()[0] or 0
    return (ranged.join(small_side(runs.drop("bytes"), 64 + widest), (F.col("part") == F.col("run_part")) & F.col("tree").eqNullSafe(F.col("run_tree")))
            .withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "run_part", "run_tree", "first", "before"))


def proofs(nodes: DataFrame, name: str, fan: int = FAN, step: int = STEP, biggest: int | None = None, level: int = 0) -> DataFrame:
    """(nodes' columns, top, path): for ``nodes`` (tree, pos, size, digest, ...) the
    tree's top and the siblings by level, bottom up: structs of the texts left and
    right of the own slot."""
    if biggest is None:
        biggest = nodes.agg(F.max("size")).first()[0] or 0
    none = F.array().cast("array<struct<l:string,r:string>>")
    if biggest <= 1:
        return nodes.withColumns({"top": F.col("digest"), "path": none})
    own = nodes.columns
    up = nodes.withColumn("p0", F.col("pos"))
    for k in range(1, step + 1):
        up = up.withColumn(f"p{k}", F.floor(F.col("pos") / F.lit(fan ** k)) if fan ** k & (fan ** k - 1) else F.shiftright("pos", (fan ** k).bit_length() - 1))
    up = up.repartition("tree", f"p{step}").withColumn("top", F.col("digest"))
    for k in range(1, step + 1):
        parent = Window.partitionBy("tree", *[f"p{j}" for j in range(step, k - 1, -1)])
        slot = F.col(f"p{k - 1}") % fan
        up = up.withColumns({f"s{j}": F.max(F.when(slot == j, F.col("top"))).over(parent) for j in range(fan)})
        columns = [F.coalesce(F.col(f"s{j}"), F.lit("")) for j in range(fan)]
        left = F.concat(*[F.when(slot > j, c).otherwise("") for j, c in enumerate(columns)])
        right = F.concat(*[F.when(slot < j, c).otherwise("") for j, c in enumerate(columns)])
        more = F.col("size") > fan ** (k - 1)  # several nodes are left at this level
        up = up.withColumns({f"step{k}": F.when(more, F.struct(left.alias("l"), right.alias("r"))),
                             "top": F.when(more, digest(*columns)).otherwise(F.col("top"))})
    path = F.filter(F.array(*[F.col(f"step{k}") for k in range(1, step + 1)]), lambda s: s.isNotNull())
    block = stage(up.select(*own, F.col("top").alias("block_top"), F.col(f"p{step}").alias("block"), path.alias("steps")), f"{name}-{level}")
    width = fan ** step
    upper = block.where(F.col("pos") % width == 0).select(
        "tree", F.col("block").alias("pos"), F.ceil(F.col("size") / width).alias("size"), F.col("block_top").alias("digest"))
    upper = proofs(upper, name, fan, step, -(-biggest // width), level + 1)
    upper = stage(upper.select(F.col("tree").alias("up_tree"), F.col("pos").alias("up_pos"), "top", "path"), f"{name}-{level}-paths")
    levels, bytes_ = 1, 256
    while fan ** levels < biggest:
        levels += 1
    widest = upper.agg(F.max(F.octet_length(F.col("up_tree").cast("string")))).first()[0] or 0
    bytes_ += widest + levels * (fan * 64 + 64)
    return (block.join(small_side(upper, bytes_), (F.col("block") == F.col("up_pos")) & F.col("tree").eqNullSafe(F.col("up_tree")))
            .select(*own, "top", F.concat("steps", "path").alias("path")))


def proof_of(path: Column) -> Column:
    """Digest of all siblings, bottom up and left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["l"], s["r"]))).cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The top that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["l"], node, s["r"]))


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS,
             id_col: str = "doc_id", tree_col: str = "lang", fan: int = FAN, step: int = STEP) -> DataFrame:
    """(id, leaf, subroot, root, path, seen): a row per document.  ``seen`` is the leaf
    after the changes of ``tampered`` (column expressions by field), if any."""
    plain = {c: F.col(c) for c in fields}
    leaves = docs.select(F.col(id_col).alias("id"), F.col(tree_col).alias("tree"), leaf_of(plain).alias("digest"),
                         leaf_of({**plain, **(tampered or {})}).alias("seen") if tampered else F.lit(None).cast("string").alias("seen"))
    leaves = leaves.withColumn("seen", F.when(F.col("seen") != F.col("digest"), F.col("seen")))
    leaves = numbered(stage(leaves, "merkle-leaves"), ["id", "digest"], "merkle")
    found = stage(proofs(leaves, "merkle-tree", fan, step).select("id", "tree", "pos", "digest", "seen", "top", "path"), "merkle-proofs")
    subroots = found.where("pos = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("key"), F.col("top").alias("digest"))
    roots = proofs(numbered(subroots, ["key", "digest"], "merkle-roots"), "merkle-top", fan, step)
    roots = stage(roots.select("key", F.col("top").alias("root"), F.col("path").alias("above")), "merkle-roots-paths")
    widest, above = roots.agg(F.max(F.octet_length(F.col("key").cast("string"))), F.max(F.size("above"))).first()
    return (found.join(small_side(roots, 256 + (widest or 0) + (above or 0) * (fan * 64 + 64)), F.col("tree").eqNullSafe(F.col("key")))
            .select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root",
                    F.concat("path", "above").alias("path"), F.coalesce("seen", "digest").alias("seen")))


def verify(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of a manifest: digest of the siblings, and the root that
    each seen leaf leads to."""
    out = found.select(id_col, "leaf", "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"),
                       folded(F.col("seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """DuckDB twin: levels as lists, siblings by index, folding level by level."""
    def enc(expr):
        return f"coalesce(CAST(strlen(CAST({expr} AS VARCHAR)) AS VARCHAR) || ':' || CAST({expr} AS VARCHAR), '-')"

    def leaf(chars):
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", chars, "text")) + ")"

    def crc(text):  # bitwise crc32 of a short ASCII text
        return (f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({text}) + 1), "
                f"lambda i: CAST(ord(substr({text}, i, 1)) AS BIGINT))), lambda acc, b: "
                "list_reduce(list_prepend(xor(acc, b), range(0, 8)), lambda c, z: "
                "CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END))")

    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf, {leaf("(CAST(n_chars AS HUGEINT) + 1)")} AS changed,
         xor({crc("CAST(doc_id AS VARCHAR)")}, CAST(4294967295 AS BIGINT)) AS crc FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t(lang, lvl, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM n GROUP BY lang
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM t WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE len(nodes) = 1),
u(lvl, nodes) AS (
  SELECT 0, list(subroot ORDER BY place) FROM s
  UNION ALL
  SELECT lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
  FROM u WHERE len(nodes) > 1),
r AS (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1),
step AS (
  SELECT n.pos, n.lang, t.lvl AS lvl, t.nodes[xor(n.pos >> t.lvl, 1) + 1] AS sib, (n.pos >> t.lvl) & 1 AS slot
  FROM n JOIN t ON n.lang IS NOT DISTINCT FROM t.lang WHERE len(t.nodes) > 1
  UNION ALL
  SELECT n.pos, n.lang, 1000 + u.lvl, u.nodes[xor(s.place >> u.lvl, 1) + 1], (s.place >> u.lvl) & 1
  FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang, u WHERE len(u.nodes) > 1),
p AS (
  SELECT pos, lang, list(struct_pack(sib := coalesce(sib, ''), slot := slot) ORDER BY lvl) AS path FROM step GROUP BY pos, lang),
f(pos, lang, i, node) AS (
  SELECT pos, lang, 0, CASE WHEN crc % 7 = 0 AND n_chars_known THEN changed ELSE leaf END
  FROM (SELECT n.*, EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = n.doc_id AND x.n_chars IS NOT NULL) AS n_chars_known FROM n)
  UNION ALL
  SELECT f.pos, f.lang, f.i + 1, CASE WHEN p.path[f.i + 1].slot = 1 THEN sha256(p.path[f.i + 1].sib || f.node) ELSE sha256(f.node || p.path[f.i + 1].sib) END
  FROM f JOIN p ON p.pos = f.pos AND p.lang IS NOT DISTINCT FROM f.lang WHERE f.i < len(p.path))
SELECT n.doc_id, n.leaf, s.subroot, r.root,
       sha256(coalesce(array_to_string(list_transform(p.path, lambda x: x.sib), ''), '')) AS proof_sha256,
       f.node AS folded_root, f.node = r.root AS verified
FROM n JOIN s ON n.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r
LEFT JOIN p ON p.pos = n.pos AND p.lang IS NOT DISTINCT FROM n.lang
JOIN f ON f.pos = n.pos AND f.lang IS NOT DISTINCT FROM n.lang AND f.i = coalesce(len(p.path), 0)"""

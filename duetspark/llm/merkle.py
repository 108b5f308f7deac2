"""Merkle manifest of a table: one root for all rows, a subroot for each group, a proof for each row.

A row is a leaf, its digest the SHA-256 of its fields. A group's leaves stand in order of id; eight
nodes in a row have one parent, until one node is left, the subroot. Subroots, in order of the
group's name, are the leaves of the tree above.

The tree is built as combineByKey would, but by events. A task combines what it holds: a partial
parent gathers its children's digests by their place, and as soon as it has as many as the group's
size says (eight, fewer in the last run) its own digest is an event for the parent above. What stays
open at a task's end, the frontier, is dealt anew by an ancestor a few levels up and combined
there. Leaves come in order, so a task leaves open only what crosses its two ends. Every parent row
holds its children, and so links back: proofs are made from the root down.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import cut, table

ARITY = 8
#: Levels that a round on the frontier can climb.
STRIDE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "g string, level int, idx bigint, digest string, kids array<string>, top boolean, n bigint"
_PATH = "array<struct<l:string,r:string>>"


@dataclass(frozen=True)
class Manifest:
    """leaves (g, doc_id, leaf, changed, idx, n), the groups' nodes and the nodes above the subroots.

    Nodes are (g, level, idx, digest, kids, top, n): parents from level 1, the children's digests
    in ``kids``, ``top`` on the last one of a group. A group of one row has a node of level 0.
    """

    leaves: DataFrame
    nodes: DataFrame
    above: DataFrame


def digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256)


def group_key(c: Column) -> Column:
    """A text for each group that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, which must be cut, with their place ``idx`` in their group ``g`` and its size ``n``.

    Rows are dealt by ranges of (g, order), so one large group is spread over tasks; each task's
    counts, one row a task and group, give where it starts. Equal rows take any order among them.
    """
    own = rows.withColumn("__u", F.monotonically_increasing_id())
    by = [F.asc("g"), *[F.asc_nulls_first(c) for c in order], F.asc("__u")]
    dealt = cut(own.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy("g", "__part").agg(F.count("*").alias("__c"))
    before, whole = Window.partitionBy("g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("g")
    parts = parts.select("g", "__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"), F.sum("__c").over(whole).alias("n"))
    place = F.row_number().over(Window.partitionBy("g", "__part").orderBy(*by[1:])) - 1
    return dealt.join(parts, ["g", "__part"]).withColumn("idx", F.col("__start") + place).drop("__u", "__part", "__start")


def _climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Combine nodes (g, level, idx, digest, n) into parents; what stays open comes last, without kids."""
    names = [f.split()[0] for f in _NODES.split(", ")]
    waiting: dict[tuple[str, int, int], dict[int, str]] = {}
    sizes: dict[str, int] = {}
    for pdf in batches:
        out = []
        for g, level, idx, d, n in zip(*(pdf[c].tolist() for c in ("g", "level", "idx", "digest", "n")), strict=True):
            sizes[g] = n
            width = -(-n // ARITY**level)  # nodes of this level
            if n == 1:
                out.append((g, 0, 0, d, [], True, n))
            while width > 1:
                parent = idx // ARITY
                need = min(ARITY, width - ARITY * parent)
                kids = waiting.setdefault((g, level, parent), {})
                kids[idx % ARITY] = d
                if len(kids) < need:
                    break
                ordered = [kids[k] for k in range(need)]
                del waiting[g, level, parent]
                d, level, idx, width = hashlib.sha256("".join(ordered).encode()).hexdigest(), level + 1, parent, -(-width // ARITY)
                out.append((g, level, idx, d, ordered, width == 1, n))
        yield pd.DataFrame(out, columns=names)
    rest = [(g, level, ARITY * parent + k, d, None, False, sizes[g]) for (g, level, parent), kids in waiting.items() for k, d in kids.items()]
    yield pd.DataFrame(rest, columns=names)


def _tree(leaves: DataFrame) -> DataFrame:
    """All parents over numbered leaves (g, idx, digest, n)."""
    start = leaves.select("g", F.lit(0).alias("level"), "idx", "digest", "n")
    state = cut(start.mapInPandas(_climb, _NODES))
    nodes = state.where("kids is not null")
    while (low := state.where("kids is null").agg(F.min("level").alias("low")).first()["low"]) is not None:
        # the lowest nodes have all their siblings here, so each round climbs at least once
        up = F.greatest(F.lit(low + STRIDE) - F.col("level"), F.lit(1))
        ancestor = F.floor(F.col("idx") / F.pow(F.lit(float(ARITY)), up)).cast("bigint")
        front = state.where("kids is null").select("g", "level", "idx", "digest", "n")
        state = cut(front.repartition("g", (F.col("level") + up).cast("int"), ancestor).mapInPandas(_climb, _NODES))
        nodes = nodes.unionByName(state.where("kids is not null"))
    return nodes


def build(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, changed: Column | None = None) -> Manifest:
    """The manifest of ``docs``.

    ``changed`` is a column with the digest of a row as found later, null where it is as it was.
    Null ids stand first, rows with one id in order of their digests; rows that repeat are leaves
    each. Null fields count as ``-``, apart from empty ones. A null group is one of its own, before
    the others. Other columns are not read. An empty table has no leaves, nodes or root. A row's
    text is read once; what travels on are digests.
    """
    leaf = digest([F.col(c) for c in fields])
    read = cut(docs.select(group_key(F.col(group_col)).alias("g"), F.col(id_col).alias("doc_id"), leaf.alias("digest"),
                           (F.lit(None).cast("string") if changed is None else changed).alias("changed")))
    leaves = cut(numbered(read, ["doc_id", "digest"]))
    nodes = _tree(leaves)
    tops = cut(nodes.where("top").select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"))
    subroots = cut(numbered(tops, ["name"]))
    return Manifest(leaves.withColumnRenamed("digest", "leaf"), nodes, _tree(subroots).unionByName(_members(subroots)))


def _members(subroots: DataFrame) -> DataFrame:
    """The subroots as nodes of level -1, their group's name as the only child."""
    return subroots.select("g", F.lit(-1).alias("level"), "idx", "digest", F.array("name").alias("kids"), F.lit(False).alias("top"), "n")


def _siblings(kids: str, idx: Column) -> Column:
    place = (idx % ARITY).cast("int")
    left, right = F.slice(kids, F.lit(1), place), F.slice(kids, place + 2, F.lit(ARITY))
    return F.array(F.struct(F.array_join(left, "").alias("l"), F.array_join(right, "").alias("r")))


def _descend(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(g, idx, kids, path, subroot, root) of the parents of leaves; ``path`` holds the siblings from
    them up to and through ``roots`` (g, path, subroot, root)."""
    found, said = None, ["path", "subroot", "root"]
    for level in range(nodes.agg(F.max("level")).first()[0] or 0, 0, -1):
        own = nodes.where(F.col("level") == level)
        here = own.where("top").join(roots, "g").select("g", "idx", "kids", *said)
        if found is not None:
            up = found.select("g", F.col("idx").alias("__up"), F.col("kids").alias("__kids"), *said)
            low = own.where("not top").withColumn("__up", F.floor(F.col("idx") / ARITY)).join(up, ["g", "__up"])
            here = here.unionByName(low.withColumn("path", F.concat(_siblings("__kids", F.col("idx")), "path")).select("g", "idx", "kids", *said))
        found = here
    return roots.select("g", F.lit(0).cast("bigint").alias("idx"), F.array().cast("array<string>").alias("kids"), *said).limit(0) if found is None else found


def _paths(leaves: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``leaves`` (g, idx, n, ...) with ``path``, each level's siblings left and right from the leaf up,
    and subroot and root, which come down with it: leaves only ever meet their parents."""
    many = leaves.where("n > 1").withColumn("__up", F.floor(F.col("idx") / ARITY))
    up = _descend(nodes, roots).select("g", F.col("idx").alias("__up"), F.col("kids").alias("__kids"), "path", "subroot", "root")
    joined = many.join(up, ["g", "__up"]).withColumn("path", F.concat(_siblings("__kids", F.col("idx")), "path")).drop("__up", "__kids")
    return joined.unionByName(leaves.where("n = 1").join(roots, "g"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["l"], d, s["r"]), 256))


def proofs(m: Manifest) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, path): the row's siblings, level by level to the root."""
    members = m.above.where("level = -1").select("g", "idx", "n", F.col("kids")[0].alias("name"), "digest")
    tree = m.above.where("level >= 0")
    start = tree.where("top").select("g", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    groups = cut(_paths(members, tree, start).select(F.col("name").alias("g"), "path", F.col("digest").alias("subroot"), "root"))
    return _paths(m.leaves, m.nodes, groups).select("doc_id", "leaf", "changed", "subroot", "root", "path")


def root(m: Manifest) -> str | None:
    """The root of the whole table; None if it is empty."""
    row = m.above.where("top").select("digest").first()
    return row["digest"] if row else None


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = digest([F.translate(c, upper, lower) if c == "text" else F.col(c) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    p = proofs(build(docs, changed=F.when(hit, tampered))).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
    said = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    return p.select("doc_id", "leaf", "subroot", "root", F.sha2(said, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of a decimal number's characters, a bit at a time.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ord(substr(CAST(doc_id AS VARCHAR), CAST(k AS INTEGER), 1)) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
OP13_SQL = f"""
WITH RECURSIVE h AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256({' || '.join(map(_FIELD, FIELDS))}) AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN sha256({' || '.join(map(_FIELD, FIELDS[:-1]))} || coalesce(strlen({_LOWER}) || ':' || {_LOWER}, '-')) END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h),
n AS (SELECT g, 0 AS level, i, leaf AS d FROM l
  UNION ALL SELECT g, level + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM n) WHERE c > 1 GROUP BY g, level, i // 8),
t AS (SELECT g, max(level) AS top, arg_max(d, level) AS d FROM n GROUP BY g),
f AS (SELECT doc_id, leaf, g, 0 AS level, i, coalesce(changed, leaf) AS d, '' AS proof FROM l
  UNION ALL SELECT f.doc_id, leaf, f.g, f.level + 1, f.i // 8, sha256(string_agg(CASE WHEN n.i = f.i THEN f.d ELSE n.d END, '' ORDER BY n.i)), proof || coalesce(string_agg(n.d, '' ORDER BY n.i) FILTER (n.i <> f.i), '')
    FROM f JOIN t ON t.g = f.g AND f.level < t.top JOIN n ON n.g = f.g AND n.level = f.level AND n.i // 8 = f.i // 8 GROUP BY f.doc_id, leaf, f.g, f.level, f.i, f.d, proof),
u AS (SELECT f.* FROM f JOIN t ON t.g = f.g AND f.level = t.top),
m AS (SELECT 0 AS level, row_number() OVER (ORDER BY g) - 1 AS i, d FROM t
  UNION ALL SELECT level + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS c FROM m) WHERE c > 1 GROUP BY level, i // 8),
r AS (SELECT max(level) AS top, arg_max(d, level) AS root FROM m),
w AS (SELECT u.doc_id, leaf, t.d AS subroot, 0 AS level, k.i, u.d, proof FROM u JOIN t USING (g) JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM t) k USING (g)
  UNION ALL SELECT w.doc_id, leaf, subroot, w.level + 1, w.i // 8, sha256(string_agg(CASE WHEN m.i = w.i THEN w.d ELSE m.d END, '' ORDER BY m.i)), proof || coalesce(string_agg(m.d, '' ORDER BY m.i) FILTER (m.i <> w.i), '')
    FROM w JOIN r ON w.level < r.top JOIN m ON m.level = w.level AND m.i // 8 = w.i // 8 GROUP BY w.doc_id, leaf, subroot, w.level, w.i, w.d, proof)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified FROM w JOIN r ON w.level = r.top
"""

"""A Merkle manifest of a dataset: a hash tree for each group of rows, a tree over their roots, and proofs.

Leaves are ordered by a range partitioning, so that a large group spreads over many partitions, and cut into
blocks of consecutive leaves. A block knows where it lies in its tree: how many leaves of the tree come before
it and how many there are in all. Its leaves go onto a mountain range: as soon as a run of `fanout` nodes is
complete, it is carried to the next level as their hash, and a record of the run is left. What remains at the edges of
a block, at most two incomplete runs for each level, are its peaks. Neighbouring blocks join their peaks in rounds
until each tree is one node. The last run of a level may be short: it is hashed as it is, without padding.

For proofs a block needs the records of the runs that cross its edges, two for each level at most; all other siblings
it has itself. A proof is the path from a leaf to the root: for each level the nodes of the run, and the place of one's own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import releasing_cogroup, stored, table

#: Bits of a leaf's place within its block, and of a block's within its partition; neighbours whose peaks meet in one group.
BLOCK_BITS, PLACE_BITS, NEIGHBOURS = 14, 33, 64

PATH = "array<struct<place:int,nodes:array<binary>>>"
_PEAKS = "block long, tree long, total long, kind string, level int, node long, digest binary, nodes array<binary>"


def digest(*parts: bytes) -> bytes:
    """SHA-256 of the concatenation of digests as hexadecimal text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def field(value: Column) -> Column:
    """`-` for a null, else the value's UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row of values, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def _hashed(nodes: Column) -> Column:
    return F.unhex(F.sha2(F.lower(F.array_join(F.transform(nodes, lambda n: F.hex(n)), "")), 256))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to: level by level, the hash of the run with one's own node at its place."""
    put = lambda step, node: F.transform(step["nodes"], lambda n, i: F.when(i == step["place"], node).otherwise(n))
    return F.aggregate(path, leaf, lambda node, step: _hashed(put(step, node)))


def siblings(path: Column) -> Column:
    """The other nodes of the runs of a path, level by level, left to right, as hexadecimal text."""
    others = F.flatten(F.transform(path, lambda step: F.filter(step["nodes"], lambda n, i: i != step["place"])))
    return F.lower(F.array_join(F.transform(others, lambda n: F.hex(n)), ""))


class Range:
    """The mountain range over some nodes of one tree of `total` leaves."""

    def __init__(self, total: int, fanout: int):
        self.fanout, self.sizes = fanout, [total]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fanout))
        self.levels: list[dict[int, bytes]] = [{} for _ in self.sizes]
        self.made: list[tuple[int, int, list[bytes]]] = []

    def push(self, level: int, node: int, value: bytes) -> None:
        """Adds a node; a run that is complete with it becomes a node of the level above and a record in `made`."""
        while self.sizes[level] > 1:
            run, here = node // self.fanout, self.levels[level]
            here[node] = value
            places = range(run * self.fanout, min((run + 1) * self.fanout, self.sizes[level]))
            if any(p not in here for p in places):
                return
            nodes = [here.pop(p) for p in places]
            self.made.append((level + 1, run, nodes))
            level, node, value = level + 1, run, digest(*nodes)
        self.levels[level][node] = value

    def peaks(self) -> list[tuple[str, int, int, bytes]]:
        """What is not carried: (kind, level, node, digest). The one node of the last level is the root."""
        top = len(self.sizes) - 1
        return [("root" if level == top else "peak", level, node, value) for level, nodes in enumerate(self.levels) for node, value in sorted(nodes.items())]


def _table(names: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    columns = list(zip(*rows)) if rows else [[] for _ in names.split(", ")]
    return pa.table({n: pa.array(list(c), kinds[t]) for (n, t), c in zip((x.split(" ") for x in names.split(", ")), columns)})


@dataclass(frozen=True)
class Manifest:
    """leaves (group, order, digest, more, block, at), pieces (block, group, tree, first, n, total): what of a tree lies in a
    block, roots (group, tree, total, digest), and records (tree, level, run, nodes) of the runs that cross blocks."""

    group: str
    fanout: int
    leaves: DataFrame
    pieces: DataFrame
    roots: DataFrame
    records: DataFrame


def _indexed(leaves: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    spark = leaves.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves.count() >> (BLOCK_BITS + 2))
    # rows that agree in all keys suit any order; by where they are stored they spread over partitions
    keys = [group, *order, "digest", "_tie"]
    sorted_ = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    place = sorted_.drop("_tie").withColumn("_place", F.monotonically_increasing_id())
    block, at = F.shiftright("_place", BLOCK_BITS).alias("block"), F.col("_place").bitwiseAND((1 << BLOCK_BITS) - 1).alias("at")
    rows = stored(place.select(*[c for c in place.columns if c != "_place"], block, at), "leaves")
    pieces = rows.groupBy("block", group).agg(F.count("*").alias("n"), F.min("at").alias("start"))
    # one row for each block of a tree, so a window over a tree is small beside it; a tree is named by the place of its first leaf
    tree = Window.partitionBy(group)
    pieces = pieces.withColumns({
        "tree": F.min(F.shiftleft("block", BLOCK_BITS) + F.col("start")).over(tree), "total": F.sum("n").over(tree),
        "first": F.coalesce(F.sum("n").over(tree.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    return rows, stored(pieces.select("block", group, "tree", "first", "n", "total"), "pieces")


def _in_order(pieces: pa.Table) -> list[tuple[int, dict]]:
    """(place of its first leaf in the block, piece) of each tree in a block. Trees follow each other as their groups do."""
    out, at = [], 0
    for p in sorted(pieces.to_pylist(), key=lambda p: p["tree"]):
        out.append((at, p))
        at += p["n"]
    return out


def manifest(leaves: DataFrame, group: str, order: list[str], fanout: int = 3) -> Manifest:
    """The trees of stored leaves (group, order, digest, more): one for each group, null being one, its leaves in the order of these
    columns, nulls first, equal ones by digest. A tree of one leaf is that leaf. An empty table has no trees."""
    rows, pieces = _indexed(leaves, group, order)

    def fold(key, mine, trees):
        values, out = mine.sort_by("at")["digest"].to_pylist(), []
        for at, p in _in_order(trees):
            r = Range(p["total"], fanout)
            for i in range(p["n"]):
                r.push(0, p["first"] + i, values[at + i])
            out += [(key[0].as_py(), p["tree"], p["total"], *peak, None) for peak in r.peaks()]
        return _table(_PEAKS, out)

    def join(key, t):
        of, out, block = {}, [], key[0].as_py()
        for p in sorted(t.to_pylist(), key=lambda p: (p["tree"], p["level"], p["node"])):
            of.setdefault((p["tree"], p["total"]), []).append(p)
        for (tree, total), peaks in of.items():
            r = Range(total, fanout)
            for p in peaks:
                r.push(p["level"], p["node"], p["digest"])
            out += [(block, tree, total, "run", level, run, None, nodes) for level, run, nodes in r.made]
            out += [(block, tree, total, *peak, None) for peak in r.peaks()]
        return _table(_PEAKS, out)

    small = pieces.select("block", "tree", "first", "n", "total")
    found = stored(rows.select("block", "at", "digest").groupBy("block").cogroup(small.groupBy("block")).applyInArrow(releasing_cogroup(fold), _PEAKS), "peaks")
    rounds = [found]
    up = F.shiftright("block", PLACE_BITS - BLOCK_BITS)  # first the blocks of one partition
    while not found.where("kind = 'peak'").isEmpty():
        found = stored(found.where("kind = 'peak'").withColumn("block", up).groupBy("block").applyInArrow(join, _PEAKS), "peaks")
        rounds.append(found)
        up = F.floor(F.col("block") / NEIGHBOURS)
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionByName(r)
    roots = every.where("kind = 'root'").select("tree", "total", "digest").join(pieces.where("first = 0").select("tree", group), "tree")
    return Manifest(group, fanout, rows, pieces, roots.select(group, "tree", "total", "digest"), every.where("kind = 'run'").select("tree", "level", F.col("node").alias("run"), "nodes"))


def proofs(m: Manifest, above: DataFrame) -> DataFrame:
    """The leaves, each with `tree_root`, the root of its tree, and `path`, which leads to it and on by the path of above (tree, path)."""
    width = lambda level: F.pow(F.lit(float(m.fanout)), level)  # noqa: E731  leaves under a node
    level = m.pieces.select("block", "tree", "first", "n", "total", F.explode(F.filter(F.sequence(F.lit(1), F.lit(60)), lambda x: width(x - 1) < F.col("total"))).alias("level"))
    ends = F.array_distinct(F.transform(F.array(F.col("first"), F.col("first") + F.col("n") - 1), lambda i: F.floor(i / width(F.col("level"))).cast("long")))
    runs = level.select("*", F.explode(ends).alias("run")).withColumns({"low": F.col("run") * width(F.col("level")), "high": F.least((F.col("run") + 1) * width(F.col("level")), F.col("total"))})
    crossing = runs.where("low < first or high > first + n").select("block", "tree", "level", "run")
    records = crossing.join(m.records, ["tree", "level", "run"]).select("block", "tree", "level", "run", "nodes")
    tops = m.roots.select("tree", F.col("digest").alias("tree_root")).join(above, "tree")
    heads = m.pieces.select("block", "tree", "first", "n", "total").join(tops, "tree")
    help_ = heads.unionByName(records, allowMissingColumns=True)
    fanout, leaf_columns = m.fanout, m.leaves.columns

    def prove(key, mine, help_):
        mine = mine.sort_by("at")
        values, known, heads = mine["digest"].to_pylist(), {}, help_.filter(pa.compute.is_null(help_["level"]))
        for r in help_.filter(pa.compute.is_valid(help_["level"])).to_pylist():
            known[r["tree"], r["level"], r["run"]] = r["nodes"]
        roots, paths = [], []
        for at, p in _in_order(heads):
            # level by level the nodes that stand above this block's leaves, and the runs they came from
            low, nodes, size, levels = p["first"], values[at : at + p["n"]], p["total"], []
            while size > 1:
                runs = []
                for run in range(low // fanout, (low + len(nodes) - 1) // fanout + 1):
                    a, b = run * fanout, min((run + 1) * fanout, size)
                    runs.append(nodes[a - low : b - low] if a >= low and b <= low + len(nodes) else known[p["tree"], len(levels) + 1, run])
                levels.append((low, runs))
                low, nodes, size = low // fanout, [digest(*r) for r in runs], -(-size // fanout)
            for i in range(p["first"], p["first"] + p["n"]):
                path = []
                for low, runs in levels:
                    path.append({"place": i % fanout, "nodes": runs[i // fanout - low // fanout]})
                    i //= fanout
                paths.append(path + p["path"])
                roots.append(p["tree_root"])
        kind = pa.list_(pa.struct([("place", pa.int32()), ("nodes", pa.list_(pa.binary()))]))
        return mine.append_column("tree_root", pa.array(roots, pa.binary())).append_column("path", pa.array(paths, kind)).select([*leaf_columns, "tree_root", "path"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.leaves.schema) + f", tree_root binary, path {PATH}"
    return m.leaves.groupBy("block").cogroup(help_.groupBy("block")).applyInArrow(releasing_cogroup(prove), schema)


def dataset_proofs(leaves: DataFrame, group: str, order: list[str], fanout: int = 3) -> tuple[DataFrame, bytes | None]:
    """The leaves with the root of their group (tree_root) and the path through it to the root of all; and that root, null for no leaves."""
    m = manifest(leaves, group, order, fanout)
    # the roots are the leaves of one more tree
    over = stored(m.roots.select(F.lit(0).alias("all"), group, "tree", "digest").withColumnRenamed("tree", "of"), "roots")
    top = manifest(over, "all", [group], fanout)
    last = top.roots.first()
    none = top.roots.select("tree", F.array().cast(PATH).alias("path"))
    above = proofs(top, none).select(F.col("of").alias("tree"), "path")
    return proofs(m, stored(above, "above")), last and bytes(last["digest"])


def merkle_manifest(docs: DataFrame, fanout: int = 3) -> DataFrame:
    """Each row of docs (doc_id, source, lang, n_chars, text) as a leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A null in any column has a mark of its own; a null source is a group, the first. Rows of one source that share a doc_id (or
    have none, which come first) are ordered by their leaves, so equal rows have proofs of unlike places. Rows whose doc_id has
    an even CRC-32 are folded without their line ends; rows without a doc_id as they are. Other columns are
    ignored; an empty table gives no rows. Very long texts are hashed whole.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    values = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    changed = F.when(tampered & F.contains("text", F.lit("\n")), values(F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = stored(docs.select("doc_id", "source", values(F.col("text")).alias("digest"), changed.alias("changed")), "digests")
    proven, root = dataset_proofs(leaves, "source", ["doc_id"], fanout)
    text = lambda c: F.lower(F.hex(c))
    out = proven.select("doc_id", text("digest").alias("leaf"), text("tree_root").alias("subroot"), F.lit(root and root.hex()).cast("string").alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), text(folded(F.coalesce("changed", "digest"), F.col("path"))).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merkle_manifest of the table documents: see there for nulls, ties and empty tables."""
    return merkle_manifest(table(spark, sf_dir, "documents"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"


#: Trees level by level, then a walk from each leaf to its subroot and on to the root. DuckDB has no CRC-32, so it is folded bit by bit.
_SQL = f"""WITH RECURSIVE crc AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda r, k: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))) % 2 = 1 AS even FROM (SELECT DISTINCT doc_id FROM documents)),
f AS (SELECT doc_id, source, coalesce(even, false) AS even, {_sql_field('doc_id')} || {_sql_field('source')} || {_sql_field('lang')} || {_sql_field('n_chars')} AS head, text, replace(text, chr(10), '') AS cut FROM documents LEFT JOIN crc USING (doc_id)),
leaves AS (SELECT doc_id, source, sha256(head || {_sql_field('text')}) AS leaf, CASE WHEN even THEN sha256(head || {_sql_field('cut')}) ELSE sha256(head || {_sql_field('text')}) END AS now FROM f),
row AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
node AS (SELECT source, 0 AS level, i, n, leaf AS h FROM row
  UNION ALL SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY source, level, i // 3, n),
root AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
over AS (SELECT 0 AS level, i, n, h FROM root
  UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM over WHERE n > 1 GROUP BY level, i // 3, n),
walk AS (SELECT doc_id, leaf, source, i AS row, 0 AS level, i, n, now AS x, '' AS proof FROM row
  UNION ALL SELECT w.doc_id, w.leaf, w.source, w.row, w.level + 1, w.i // 3, (w.n + 2) // 3, sha256(string_agg(CASE WHEN o.i = w.i THEN w.x ELSE o.h END, '' ORDER BY o.i)), w.proof || coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i <> w.i), '')
  FROM walk w JOIN node o ON o.source IS NOT DISTINCT FROM w.source AND o.level = w.level AND o.i // 3 = w.i // 3 WHERE w.n > 1 GROUP BY w.doc_id, w.leaf, w.source, w.row, w.level, w.i, w.n, w.x, w.proof),
up AS (SELECT w.doc_id, w.leaf, r.h AS subroot, w.row, 0 AS level, r.i, r.n, w.x, w.proof FROM walk w JOIN root r ON r.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
  UNION ALL SELECT w.doc_id, w.leaf, w.subroot, w.row, w.level + 1, w.i // 3, (w.n + 2) // 3, sha256(string_agg(CASE WHEN o.i = w.i THEN w.x ELSE o.h END, '' ORDER BY o.i)), w.proof || coalesce(string_agg(o.h, '' ORDER BY o.i) FILTER (o.i <> w.i), '')
  FROM up w JOIN over o ON o.level = w.level AND o.i // 3 = w.i // 3 WHERE w.n > 1 GROUP BY w.doc_id, w.leaf, w.subroot, w.row, w.level, w.i, w.n, w.x, w.proof)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.h AS verified FROM up, (SELECT h FROM over WHERE n = 1) r WHERE up.n = 1"""

ORACLES = {"op13_merkle_manifest": _SQL}

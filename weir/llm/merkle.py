"""A Merkle manifest of a table: a hash tree per source, one over the sources, and a proof per row.

The levels are built bottom up and stored as rows that hold the digests of their children and the
key of their own parent.  A recursive query then climbs from every leaf: each round joins the rows
with the parents they point to, appends the siblings found there and folds them with the digests
brought along, so a leaf's folded digest at the root is recomputed from its own content and its
proof alone.  The leaves of one parent climb in one row, with a digest each: above that parent they
have the same siblings, which so are carried once for sixteen.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from weir.llm.common import pinned
from weir.llm.ranks import numbered

FAN = 16                        # children of a node
SHARE = 1 << 14                 # climbing rows that meet one copy of a node
_TOP = -1                       # the tree of the sources
_BYTES = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS_SETTING = "spark.sql.cteRecursionRowLimit"


def _hash(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def _hash_digests(joined: Column) -> Column:
    """The hash of digests written as lowercase hex."""
    return _hash(F.lower(F.hex(joined)))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """The hash of some values: ``-`` for NULL, else byte count, colon and value."""
    return _hash(F.concat(*[_field(c) for c in columns]))


def _runs(leaves: DataFrame) -> DataFrame:
    """Leaves (tree, idx, n, id, digest, started) by the parent they have or would have: ``run``, their
    digests in one piece (``children``), their ids and the digests they start to climb with."""
    kids = F.sort_array(F.collect_list(F.struct("idx", "digest", "started", "id")))
    runs = leaves.groupBy("tree", F.expr(f"idx div {FAN}").alias("run"), "n").agg(kids.alias("kids"))
    return pinned(runs.select(
        "tree", "run", "n", _joined("kids").alias("children"), F.col("kids.started").alias("started"), F.col("kids.id").alias("ids")), "runs")


def _joined(kids: str) -> Column:
    return F.aggregate(kids, F.lit(b""), lambda all_, kid: F.concat(all_, kid["digest"]))


def _first_level(runs: DataFrame) -> DataFrame:
    return runs.filter("n > 1").select(
        "tree", F.col("run").alias("idx"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), "children",
        F.lit(1).cast("long").alias("below")).withColumn("digest", _hash_digests(F.col("children")))


def _levels(nodes: DataFrame, widest: int) -> list[DataFrame]:
    """The stored levels above ``nodes`` (tree, idx, n, digest, below), lowest first.  ``n`` counts the
    nodes of a tree's level, ``widest`` the most of any tree, ``below`` the climbing rows beneath a node."""
    out, current = [], nodes
    while widest > 1:
        widest = math.ceil(widest / FAN)
        kids = F.sort_array(F.collect_list(F.struct("idx", "digest")))
        parents = current.filter("n > 1").groupBy("tree", F.expr(f"idx div {FAN}").alias("up"), "n").agg(
            kids.alias("kids"), F.sum("below").alias("below"))
        current = pinned(parents.select(
            "tree", F.col("up").alias("idx"), F.ceil(F.col("n") / FAN).cast("long").alias("n"),
            _joined("kids").alias("children"), "below").withColumn("digest", _hash_digests(F.col("children"))), "level")
        out.append(current)
    return out


def _stacked(levels: list[DataFrame], first: int, empty: DataFrame) -> DataFrame:
    rows = empty
    for level, nodes in enumerate(levels, first):
        rows = rows.unionByName(nodes.withColumn("level", F.lit(level)))
    return rows


def manifest(rows: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "source",
             text_col: str = "text", share: int = SHARE) -> DataFrame:
    """Per row: its id, ``leaf``, ``subroot`` of its group, ``root``, ``proof_sha256`` (hash of its proof),
    ``folded_root`` (the root that its row, tampered with where crc32 of the id divides by 5, folds to)
    and ``verified`` (that it equals the root).  Digests are lowercase hexadecimal sha256.

    A leaf hashes the ``columns``, NULL as ``-``.  Leaves stand by id, NULL first, rows of one id by
    their digest; every 16 neighbours of a level have one parent until one is left, the group's
    subroot.  Subroots, ordered by group (NULL first, by UTF-8 bytes), have the root above them in the
    same way.  A lone row is its own subroot, a lone subroot the root, with the hash of nothing as
    proof.  Tampering lower-cases A-Z of the text; a NULL text or id stays as it is.  Empty texts are
    texts of no bytes, repeated rows are leaves each, other columns are left out, so names cannot
    clash.  An empty table gives no rows.

    Nodes over many rows are entered in copies of ``share`` climbing rows each, so no key of the climb
    is hot.  Texts are hashed where they are read.
    """
    spark = rows.sparkSession
    crc = F.crc32(F.col(id_col).cast("string"))
    tampered = [F.translate(F.col(c), _UPPER, _LOWER) if c == text_col else F.col(c) for c in columns]
    hashed = pinned(rows.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf_digest([F.col(c) for c in columns]).alias("digest"),
        F.when((crc % 5) == 0, leaf_digest(tampered)).alias("changed")), "leaves")
    placed = numbered(hashed, ["grp"], ["id", "digest"])
    groups = pinned(numbered(hashed.select("grp").distinct(), [], ["grp"], "tree", "trees"), "groups")
    leaves = placed.join(groups, placed["grp"].eqNullSafe(groups["grp"])).select(
        "tree", "idx", "n", "id", "digest", F.coalesce("changed", "digest").alias("started"))
    runs = _runs(leaves)
    sizes = runs.agg(F.max("n"), F.max("tree")).first()
    if sizes[0] is None:
        return spark.createDataFrame([], _described(rows.schema, id_col))
    deepest, trees = sizes[0], sizes[1] + 1

    lower = []
    if deepest > 1:
        lower = [pinned(_first_level(runs), "level")]
        lower += _levels(lower[0], math.ceil(deepest / FAN))
    empty = spark.createDataFrame([], "tree long, idx long, n long, children binary, below long, digest binary, level int")
    alone = runs.filter("n = 1").select(
        "tree", F.col("run").alias("idx"), "n", F.lit(b"").alias("children"), F.lit(1).cast("long").alias("below"),
        F.col("children").alias("digest"), F.lit(0).alias("level"))
    subroots = pinned(_stacked(lower, 1, alone).filter("n = 1"), "subroots")
    top = subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"),
                          "digest", "below")
    upper = _levels(top, trees)
    root = F.lit(bytes((upper[-1] if upper else top).first()["digest"]))

    last = len(lower)
    nodes = _stacked(upper, last + 1, _stacked(lower, 1, empty))
    linked = pinned(_linked(nodes.unionByName(alone) if trees > 1 else nodes, last, trees, share), "nodes")
    entered = pinned(linked.filter("level > 0").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)"))), "entered")
    climbed = _climb(spark, _start(runs, linked), entered)
    found = runs.join(climbed, ["tree", "run"]).join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    leaf = found.select("children", "above", "subroot", "folded", F.posexplode("ids").alias("pos", "id"))
    at = F.col("pos") * _BYTES
    own, folded = F.substring("children", at + 1, F.lit(_BYTES)), F.get("folded", F.col("pos"))
    proof = F.concat(F.substring("children", F.lit(1), at), F.substring("children", at + _BYTES + 1, F.lit(FAN * _BYTES)), F.col("above"))
    return leaf.select(
        F.col("id").alias(id_col), _hex(own).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(root).alias("root"),
        F.sha2(_hex(proof), 256).alias("proof_sha256"), _hex(folded).alias("folded_root"), (folded == root).alias("verified"))


def _described(schema: StructType, id_col: str) -> StructType:
    rest = StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return StructType([schema[id_col], *rest.fields])


def _linked(nodes: DataFrame, last: int, trees: int, share: int) -> DataFrame:
    """Nodes with the key of their parent, their place there and both numbers of copies."""
    own, ends = F.col("n") > 1, (F.col("tree") == _TOP) | F.lit(trees == 1)
    number = F.when(own, F.col("idx")).otherwise(F.col("tree"))

    def up(value: Column) -> Column:
        return F.when(own | ~ends, value)

    rows = nodes.withColumns({
        "copies": F.ceil(F.col("below") / share).cast("int"),
        "up_tree": up(F.when(own, F.col("tree")).otherwise(F.lit(_TOP).cast("long"))),
        "up_level": up(F.when(own, F.col("level") + 1).otherwise(F.lit(last + 1))),
        "up_idx": up(F.floor(number / FAN)), "up_pos": up((number % FAN).cast("int"))})
    above = rows.filter("level > 0").select(
        F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("copies").alias("up_copies"))
    return rows.join(above, ["up_tree", "up_level", "up_idx"], "left")


def _start(runs: DataFrame, linked: DataFrame) -> DataFrame:
    """The runs with their parents' keys.  A group's only leaf points past its tree.  Without ``up_pos`` a
    run's leaves have the places in their parent that they have in the run."""
    ups = ["up_tree", "up_level", "up_idx", "up_pos", "up_copies"]
    base = ["tree", "run", "started"]
    none = F.lit(None).cast("int").alias("up_pos")
    within = runs.filter("n > 1").select(
        *base, F.col("tree").alias("up_tree"), F.lit(1).alias("up_level"), F.col("run").alias("up_idx"), none, F.lit(1).alias("up_copies"))
    singles = linked.filter("level = 0").select(F.col("tree").alias("_of"), *ups)
    alone = runs.filter("n = 1").select(*base)
    return within.unionByName(alone.join(singles, alone["tree"] == singles["_of"], "left").drop("_of"))


_CLIMB = f"""
WITH RECURSIVE climb(tree, run, step, up_tree, up_level, up_idx, up_pos, up_copies, folded, found) AS (
    SELECT tree, run, 0, up_tree, up_level, up_idx, up_pos, up_copies, started, CAST('' AS BINARY) FROM {{start}}
    UNION ALL
    SELECT c.tree, c.run, c.step + 1, n.up_tree, n.up_level, n.up_idx, n.up_pos, n.up_copies,
           transform(c.folded, (digest, i) -> unhex(sha2(lower(hex(concat(
               substring(n.children, 1, {_BYTES} * coalesce(c.up_pos, i)), digest,
               substring(n.children, {_BYTES} * coalesce(c.up_pos, i) + {_BYTES + 1})))), 256))),
           CASE WHEN c.up_pos IS NULL THEN CAST('' AS BINARY)     -- places of their own: the run holds these siblings
                ELSE concat(substring(n.children, 1, {_BYTES} * c.up_pos), substring(n.children, {_BYTES} * c.up_pos + {_BYTES + 1})) END
    FROM climb c JOIN {{nodes}} n
      ON n.tree = c.up_tree AND n.level = c.up_level AND n.idx = c.up_idx AND n.copy = pmod(c.run, c.up_copies))
SELECT tree, run, step, found, CASE WHEN up_tree IS NULL THEN folded END AS folded FROM climb
"""


def _climb(spark: SparkSession, start: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per run the siblings above its leaves' parent, lowest level first (``above``), and the digests
    folded at the root, stored."""
    names = {k: f"weir_{k}_{uuid.uuid4().hex}" for k in ("start", "nodes")}
    start.createOrReplaceTempView(names["start"])
    nodes.createOrReplaceTempView(names["nodes"])
    limit = spark.conf.get(_ROWS_SETTING, None)
    spark.conf.set(_ROWS_SETTING, "-1")        # a row per run and level; the tree's height ends the climb
    try:
        steps = spark.sql(_CLIMB.format(**names))
        path = steps.groupBy("tree", "run").agg(
            F.sort_array(F.collect_list(F.struct("step", "found", "folded"))).alias("steps"))
        above = F.aggregate("steps", F.lit(b""), lambda all_, s: F.concat(all_, s["found"]))
        return pinned(path.select("tree", "run", above.alias("above"), F.element_at("steps", -1)["folded"].alias("folded")), "climbed")
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
        if limit is None:
            spark.conf.unset(_ROWS_SETTING)
        else:
            spark.conf.set(_ROWS_SETTING, limit)

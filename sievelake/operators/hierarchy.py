"""Parent-child links to full hierarchies: root, depth, path, descendants and cycles.

Level-wise frontier joins start at the roots; each step joins what lies below the last
frontier and writes it to one folder of the shared space, so no plan grows with the depth. As
long as most links wait, a step is one level. Once few are left, these are expanded to pairs
with their ancestors up to D steps above, by doubling, and a step takes D levels at once; D
grows as links get fewer, and there are never more pairs than a constant times the rows. Nodes
that no level reaches hang on a loop: pointer doubling inside that rest finds each loop's
smallest id. Children of a hot parent (more than 1/HOT of all links) are spread over SALTS parts,
their parent's frontier row is repeated for each part; at most HOT parents can be hot.

Null ids are ignored, repeated rows of an id count once (smallest parent), a null or empty
parent, or one that is not in the table, makes a root; a node that names itself is a loop.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.session import cut, materialize, shared_dir

HOT, SALTS = 500, 32
#: Pairs of waiting nodes and ancestors: at most JUMP_SHARE times the rows, or JUMP_ROWS; at most JUMP_MOST levels in a step.
JUMP_SHARE, JUMP_ROWS, JUMP_MOST = 2, 200_000, 256
#: The links still to be placed are rewritten when they have shrunk by this factor.
SHRINK = 6


def links(df: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent), each id once; parent is null at the roots."""
    d = df.select(F.col(id_col).alias("id"), F.nullif(F.col(parent_col), F.lit("")).alias("parent")).filter("id IS NOT NULL")
    d = d.groupBy("id").agg(F.min("parent").alias("parent"))
    known = d.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    return d.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))


def jump(left: int, total: int) -> int:
    """Levels that a step may take while ``left`` of ``total`` links wait: a power of two."""
    most = max(1, min(JUMP_MOST, left, max(JUMP_SHARE * total, JUMP_ROWS) // max(1, left)))
    return 1 << max(0, most.bit_length() - 1)


def ancestors_within(waiting: DataFrame, steps: int, sep: str | None = None) -> DataFrame:
    """(id, parent, dist[, seg]): each node with its ancestors up to ``steps`` (a power of two) links above, by doubling; seg is the way down, joined by ``sep``."""
    p = waiting.select("id", "parent", F.lit(1).alias("dist"), *[F.col("id").alias("seg")] * (sep is not None))
    d = 1
    while d < steps:
        p = materialize(p, "pairs")
        far = p.filter(F.col("dist") == d).drop("dist")
        near = p.select(F.col("id").alias("parent"), F.col("parent").alias("up"), F.col("dist").alias("more"), *[F.col("seg").alias("head")] * (sep is not None))
        far = far.join(near, "parent").select("id", F.col("up").alias("parent"), (F.col("more") + d).alias("dist"), *[F.concat_ws(sep, "head", "seg").alias("seg")] * (sep is not None))
        p, d = p.unionByName(far), 2 * d
    return materialize(p, "pairs")


def levels(link: DataFrame, with_path: bool = False, sep: str = "/", carry: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(reached, rest): reached (id, root_id, depth[, path][, carried]); rest the links (id, parent) no root leads to.

    ``link`` has to be a table already written: every level reads it. ``carry`` has (name, value at a
    root, value below) of further columns handed down one level at a time; the values below see the
    link's own columns and what its parent carries, with the parent's depth.
    """
    spark, single = link.sparkSession, bool(carry)
    if with_path:
        carry = (("path", F.col("id"), F.concat_ws(sep, "path", "seg")), *carry)
    total = link.count()
    edges = link.filter("parent IS NOT NULL")
    hot = [r["parent"] for r in edges.groupBy("parent").count().filter(F.col("count") > max(1000, total // HOT)).select("parent").collect()]  # at most HOT rows
    salt = lambda key: F.when(F.col(key).isin(hot), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0) if hot else F.lit(0)
    salts = F.when(F.col("id").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    folder, step = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}", 0

    def put(df: DataFrame) -> DataFrame:
        path = f"{folder}/step={step}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def reached(schema) -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)

    frontier = put(link.filter("parent IS NULL").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), *[top.alias(c) for c, top, _ in carry]))
    shape, below = frontier.schema, lambda: waiting.join(reached(frontier.schema).select("id"), "id", "left_anti")
    one = lambda df: df.withColumn("dist", F.lit(1)).withColumn("seg", F.col("id"))
    waiting, held, reach, depth = edges, total, 1, 0
    pairs = one(edges)
    n = frontier.count()
    left = total - n
    while n and left:
        wide = 1 if single else jump(left, total)
        if wide >= 4 * reach or left * SHRINK < held:
            waiting, held = materialize(below(), "waiting"), left
            reach = max(reach, wide)
            pairs = ancestors_within(waiting, reach, sep if with_path else None) if reach > 1 else one(waiting)
        up = frontier.withColumn("part", F.explode(salts)).withColumnRenamed("id", "parent")
        down = pairs.withColumn("part", salt("parent").cast("int")).join(up, ["parent", "part"])
        step += 1
        got = put(down.select("id", "root_id", (F.col("depth") + F.col("dist")).alias("depth"), *[value.alias(c) for c, _, value in carry]))
        n = got.count()
        left, depth = left - n, depth + reach
        frontier = got.filter(F.col("depth") == depth)
    return reached(shape), below() if left else edges.limit(0)


def loops(rest: DataFrame) -> DataFrame:
    """(id, loop_id) for links of which none leads to a root: the smallest id of the loop above.

    After 2**r steps up, r >= log2(rows), every node stands on its loop; doubling from there
    takes the minimum over the whole loop.
    """
    jump = cut(rest.select("id", F.col("parent").alias("to"), F.col("parent").alias("low")))
    n = jump.count()
    steps = max(1, n).bit_length()
    for _ in range(steps):  # low: smallest id among the nodes passed, the start excepted
        nxt = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        jump = cut(jump.join(nxt, "to").select("id", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
    # "to" lies on the loop and its own "low" has gone around the loop at least once
    on = jump.select(F.col("id").alias("to"), F.col("low").alias("loop_id"))
    return jump.select("id", "to").join(on, "to").select("id", "loop_id")


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", with_path: bool = False) -> DataFrame:
    """(id, root_id, depth[, path]) of every node; depth -1 and the loop's smallest id as root_id where the way up enters a loop.

    path joins the ids from the root down by "/"; it is null on loops.
    """
    link = materialize(links(df, id_col, parent_col), "links")
    reached, rest = levels(link, with_path)
    rest = rest.select("id", "parent")
    lost = loops(rest).select("id", F.col("loop_id").alias("root_id"), F.lit(-1).alias("depth"), *[F.lit(None).cast("string").alias("path")] * with_path)
    return reached.unionByName(lost)


def descendants(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(ancestor, id, distance): one row for each node and each of its ancestors, loops left out."""
    link = materialize(links(df, id_col, parent_col), "links")
    reached, _ = levels(link, with_path=True, sep="\u0001")
    up = F.split("path", "\u0001")
    return reached.filter("depth > 0").select("id", "depth", F.posexplode(F.slice(up, 1, F.col("depth"))).alias("at", "ancestor")).select("ancestor", "id", (F.col("depth") - F.col("at")).alias("distance"))


def descendant_counts(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, descendants) of every node not on or under a loop; summed before and after the shuffle, never collected."""
    link = materialize(links(df, id_col, parent_col), "links")
    reached, _ = levels(link, with_path=True, sep="\u0001")
    one = reached.select(F.explode(F.split("path", "\u0001")).alias("id"))
    return one.groupBy("id").agg((F.count("*") - 1).alias("descendants"))


def check_paths(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", path_col: str = "hierarchy_path", level_col: str = "hierarchy_level") -> DataFrame:
    """(id, path_state, level_state): the stored path and level against the parent links.

    A stored path is 'missing' (null or empty), 'ok' if its parent's stored path is its
    beginning, 'stale' if not, 'unchecked' where the parent stores none or there is no
    parent. A level is 'ok' if it counts the path's slashes, 'missing' or 'wrong'.
    """
    d = df.select(F.col(id_col).alias("id"), F.nullif(F.col(parent_col), F.lit("")).alias("parent"), F.nullif(F.col(path_col), F.lit("")).alias("path"), F.col(level_col).alias("level"))
    d = d.filter("id IS NOT NULL").groupBy("id").agg(*[F.min(c).alias(c) for c in ("parent", "path", "level")])
    up = d.select(F.col("id").alias("parent"), F.col("path").alias("up_path"))
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/")))
    return d.join(up, "parent", "left").select(
        "id",
        F.when(F.col("path").isNull(), "missing").when(F.col("up_path").isNull(), "unchecked")
        .when(F.startswith("path", F.concat("up_path", F.lit("/"))) | (F.col("path") == F.col("up_path")), "ok").otherwise("stale").alias("path_state"),
        F.when(F.col("level").isNull() | F.col("path").isNull(), "missing").when(F.col("level") == slashes, "ok").otherwise("wrong").alias("level_state"),
    )


def check_hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", path_col: str = "hierarchy_path", level_col: str = "hierarchy_level") -> DataFrame:
    """(id, depth, expected_level, path_state, level_state): the stored path and level against the way up.

    Each step down adds one segment to the path. The nearest ancestor with a sound stored path is
    handed down level by level: a stored path is 'ok' (and sound) if it is that path and as many further
    segments as there are steps, else 'stale', with all paths below that go on from it. The
    first stored path on a way down has nothing above it to be compared with: it is 'unchecked', and
    taken as sound. A level is 'ok' if it is the sound path's segments and the steps from there, 'wrong'
    if not, 'unchecked' where the way up stores no path at all. Null or empty: 'missing'. On and under
    loops, where there is no depth, both are 'loop'.
    """
    d = df.select(F.col(id_col).alias("id"), F.nullif(F.col(path_col), F.lit("")).alias("own"), F.col(level_col).alias("level")).filter("id IS NOT NULL")
    d = d.groupBy("id").agg(F.rtrim(F.min("own"), F.lit("/")).alias("own"), F.min("level").alias("level"))
    link = materialize(links(df, id_col, parent_col).join(d, "id"), "links")
    slashes = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/")))
    own, sound, at = F.col("own"), F.col("sound"), F.col("at")
    steps = F.col("depth") + 1 - at
    fits = F.coalesce(F.when(sound.isNull(), own.isNotNull()).otherwise(F.startswith(own, F.concat(sound, F.lit("/"))) & (slashes(own) == slashes(sound) + steps)), F.lit(False))
    carry = (
        ("sound", own, F.when(fits, own).otherwise(sound)),
        ("at", F.when(own.isNotNull(), 0), F.when(fits, F.col("depth") + 1).otherwise(at)),
        ("above", F.lit(False), sound.isNotNull()),
    )
    reached, _ = levels(link.select("id", "parent", "own"), carry=carry)
    expected = slashes(sound) + F.col("depth") - at
    on_loop = F.col("depth").isNull()
    return link.select("id", "own", "level").join(reached, "id", "left").select(
        "id", F.coalesce("depth", F.lit(-1)).alias("depth"), expected.alias("expected_level"),
        F.when(on_loop, "loop").when(own.isNull(), "missing").when(at != F.col("depth"), "stale").when(F.col("above"), "ok").otherwise("unchecked").alias("path_state"),
        F.when(on_loop, "loop").when(F.col("level").isNull(), "missing").when(expected.isNull(), "unchecked").when(F.col("level") == expected, "ok").otherwise("wrong").alias("level_state"),
    )

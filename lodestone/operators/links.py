"""Symbolic links of many trees as a table: where they lead, and which paths stand on one.

A link is a row (repo, path, target); its path is relative to the root of its tree.
What a link leads to is kept as the components walked so far and those that are
left.  In each round every link walks on to the first link on its way and takes
over how far that one has come by then, so what is walked doubles: a chain of n
links takes about log2(n) rounds of joins, in all trees at once.  A link that has
passed more links than its tree can hold twice is in a loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import parts
from lodestone.functions.text import let

#: More components than a path may have.
MOST_PARTS = 4096
#: Passes through links that any tree allows.
LEAST_PASSES = 40
#: Tables of links are joined by shuffles: as files they are far smaller than as rows, which a broadcast sends through the driver.
SHUFFLED = "merge"
_EMPTY = "array<string>"


def _places(done: Column, left: Column) -> Column:
    """For each component that is left: whether it names an entry, and the path after it; null where it leads out of the tree."""
    start = F.struct(done.alias("at"), F.lit(False).alias("out"), F.array().cast("array<struct<named:boolean,at:string>>").alias("seen"))

    def step(walk: Column, part: Column) -> Column:
        stays = part.isin("", ".")
        up = part == ".."
        out = walk["out"] | (up & (F.size(walk["at"]) == 0))
        moved = F.when(stays, walk["at"]).when(up, F.slice(walk["at"], 1, F.greatest(F.size(walk["at"]) - 1, F.lit(0)))).otherwise(F.array_append(walk["at"], part))
        seen = lambda at: F.struct((~(stays | up)).alias("named"), F.when(~out, F.array_join(at, "/")).alias("at"))
        return let(moved, lambda at: F.struct(at.alias("at"), out.alias("out"), F.array_append(walk["seen"], seen(at)).alias("seen")))

    return F.aggregate(left, start, step, lambda walk: walk["seen"])


def _first_links(walks: DataFrame, links: DataFrame, key: list[str]) -> DataFrame:
    """(key, i, path): the first place i on the way of each walk (key, repo, done, left) that is a link."""
    each = walks.select(*key, "repo", F.posexplode(_places(F.col("done"), F.col("left"))).alias("i", "p"))
    # A way out of the tree is the end of it: from there on no place has a path.
    on = each.where("p.named and p.at is not null").select(*key, "repo", "i", F.col("p.at").alias("path"))
    met = on.join(links.select("repo", "path").hint(SHUFFLED), ["repo", "path"])
    return met.groupBy(*key).agg(F.min(F.struct("i", "path")).alias("m")).select(*key, "m.i", "m.path")


def stands_on(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(repo, path, link): the first link that a walk along each of ``paths`` (repo, path) stands on, also one that ``..`` leaves again; null if none.

    Paths are relative to the root of their tree.
    """
    own = paths.select("repo", "path").distinct()
    walks = own.select("repo", F.col("path").alias("asked"), F.array().cast(_EMPTY).alias("done"), parts(F.col("path")).alias("left"))
    found = _first_links(walks, links, ["repo", "asked"])
    return own.join(found.select("repo", F.col("asked").alias("path"), F.col("path").alias("link")).hint(SHUFFLED), ["repo", "path"], "left")


def resolved(links: DataFrame, materialize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(repo, path, status, final) of each link (repo, path, target, and root, the absolute path of its tree or null); repo is not null.

    status: ``inside`` with the final path, ``.`` being the root itself; ``outside`` or
    ``loop`` without one.  ``materialize`` writes a DataFrame and reads it back, which
    ends each round.
    """
    root = F.col("root") if "root" in links.columns else F.lit(None).cast("string")
    rows = links.select("repo", "path", "target", root.alias("root")).dropDuplicates(["repo", "path"])
    absolute = F.col("target").startswith("/")
    below = F.concat("target", F.lit("/")).startswith(F.concat(F.rtrim("root", F.lit("/")), F.lit("/")))
    inner = F.substr("target", F.length(F.rtrim("root", F.lit("/"))) + 2)
    above = F.slice(parts(F.col("path")), F.lit(1), F.size(parts(F.col("path"))) - 1)
    sizes = materialize(rows.groupBy("repo").agg((F.count("*") * 2 + LEAST_PASSES).alias("most")))
    state = rows.join(sizes, "repo").select(
        "repo", "path", "most", F.when(absolute, F.array().cast(_EMPTY)).otherwise(above).alias("done"),
        F.when(absolute, parts(inner)).otherwise(parts(F.col("target"))).alias("left"),
        F.when(absolute & ~F.coalesce(below, F.lit(False)), "outside").otherwise("open").alias("status"), F.lit(1).cast("long").alias("passes"),
    )
    state = materialize(state)
    while True:
        open_ = state.where("status = 'open'")
        if open_.isEmpty():
            break
        # What is done holds no link, so the walk goes on from there.
        met = _first_links(open_.select("repo", "path", "done", "left").withColumnRenamed("path", "own"), state, ["repo", "own"])
        there = state.select("repo", F.col("path").alias("met"), F.col("done").alias("there"), F.col("left").alias("ahead"), F.col("status").alias("their_status"), F.col("passes").alias("their_passes"))
        # Rows that met no link take no part in the search for it: they all have the same key, null.
        walked = met.select("repo", F.col("own").alias("path"), "i", F.col("path").alias("met")).join(there.hint(SHUFFLED), ["repo", "met"])
        joined = state.join(walked.hint(SHUFFLED), ["repo", "path"], "left")
        rest = F.slice("left", F.col("i") + 2, F.greatest(F.size("left") - F.col("i") - 1, F.lit(0)))
        last = F.element_at(_places(F.col("done"), F.col("left")), -1)["at"]
        ended = F.when(F.size("left") == 0, F.array_join("done", "/")).otherwise(last)
        passes = F.col("passes") + F.col("their_passes")
        longer = F.concat("ahead", rest)
        stays = F.col("status") != "open"
        status = (
            F.when(stays, F.col("status"))
            .when(F.col("met").isNull(), F.when(ended.isNull(), "outside").otherwise("inside"))
            .when(F.col("their_status").isin("outside", "loop"), F.col("their_status"))
            .when((passes > F.col("most")) | (F.size(longer) > MOST_PARTS), "loop")
            .otherwise("open")
        )
        done = F.when(stays, F.col("done")).when(F.col("met").isNull(), F.when(ended == "", F.array().cast(_EMPTY)).otherwise(parts(ended))).otherwise(F.col("there"))
        left = F.when(stays, F.col("left")).when(F.col("met").isNull(), F.array().cast(_EMPTY)).otherwise(longer)
        state = materialize(joined.select("repo", "path", "most", done.alias("done"), left.alias("left"), status.alias("status"), F.when(stays | F.col("met").isNull(), F.col("passes")).otherwise(passes).alias("passes")))
    final = F.when(F.col("status") == "inside", F.when(F.size("done") == 0, ".").otherwise(F.array_join("done", "/")))
    return state.select("repo", "path", "status", final.alias("final"))

"""Constants and branch paths as of their line (C3a, C3b), by rounds over tables.

C3a  A line without a known constant is in the bucket of none.  There it joins the best
     cluster of its token count (an equal template at once, else most equal tokens, then
     most parameters, then the oldest) or opens one.  A join that changes the template, or
     the ``population``-th line of an unchanged one, promotes the template's first token
     without a wildcard: later lines with that token are in its bucket, and all clusters
     of none that hold it move there.
     In each round those lines are decided that share no token with an earlier undecided
     line, nor have a candidate that does: an undecided line can only change what shares
     a token with it.  A message is looked at at its first line and, where it has so many,
     at its ``population``-th; lines with a known constant need no look.
C3b  A cluster holds at most ``br_thresh`` paths.  A line that no path covers is added, or
     merged with the closest path where the list is full; the merge writes ``<*>`` between
     shared delimiters into all paths.  In each round every cluster takes its first line
     that its paths do not cover; each merge makes a position general, so there are at most
     as many rounds as a cluster's positions and paths.

Results are those of a pass in line order, for any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.tokens import WILDCARD, first_constant, merge_token_keep_delims
from logweave.operators.greedy import END, joined, needed, union_all
from logweave.session import written

NO_CONSTANT = "None"  # FIXED VALUE: a line that holds this token is never in a constant's bucket


def parameter(token: Column) -> Column:
    """A template token that stands for a value: a wildcard without letters or digits beside it."""
    return token.contains(WILDCARD) & ~token.rlike(r"[\p{L}\p{N}]")


def looked_at(lines: DataFrame, population: int) -> DataFrame:
    """(line, tokens, full): each message's first line, and its ``population``-th (full)."""
    order = Window.partitionBy("tokens").orderBy("at")
    many = lines.withColumn("r", F.row_number().over(order)).where(F.col("r") <= population)
    late = many.where(F.col("r") == population).select(F.col("at").alias("line"), "tokens", F.lit(True).alias("full"))
    first = lines.groupBy("tokens").agg(F.min("at").alias("line")).select("line", "tokens", F.lit(False).alias("full"))
    if population == 1:
        return late
    return first.unionByName(late)


def constants_in_order(lines: DataFrame, threshold: Callable[[Column], Column], population: int = 385) -> DataFrame:
    """(at, tokens) → (constant, line_id of its discovery).  Lines without tokens take no part."""
    spark = lines.sparkSession
    n = F.size("tokens")
    rows = looked_at(lines.where(n > 0), population)
    undecided = written(rows.select("line", "tokens", "full", n.alias("n"), needed(n, threshold(n)).alias("need")))
    none = [spark.createDataFrame([], "cluster long, since long, template array<string>")]
    moved = spark.createDataFrame([], "constant string, line_id long")
    while True:
        tokens = undecided.select("line", F.explode(F.array_distinct("tokens")).alias("token"))
        known = tokens.join(moved, F.col("token") == F.col("constant")).where("line_id < line").select("line")
        kept = undecided.join(known.distinct(), "line", "left_anti")
        held = undecided.where(F.array_contains("tokens", NO_CONSTANT))
        undecided = written(kept.unionByName(held.join(kept.select("line"), "line", "left_anti")))
        if undecided.limit(1).count() == 0:
            return moved
        tokens = undecided.select("line", F.explode(F.array_distinct("tokens")).alias("token"))
        least = written(tokens.groupBy("token").agg(F.min("line").alias("least")))
        waits = tokens.join(least, "token").where("least < line").select("line").distinct()
        asks = written(undecided.join(waits, "line", "left_anti"))
        found = candidates(asks, union_all(none), moved)
        touched = found.select("line", "template", F.explode("template").alias("token")).join(least, "token").where("least < line")
        now = asks.join(touched.select("line").distinct(), "line", "left_anti")
        best = found.groupBy("line").agg(F.max_by(F.struct("cluster", "template", "same"), F.struct(F.col("same"), F.col("equal"), F.col("wild"), -F.col("cluster"))).alias("best"))
        now = now.join(best, "line", "left").select("line", "tokens", "full", "best.*")
        now = written(now.withColumn("new", F.when(F.col("cluster").isNull(), F.col("tokens")).when(F.col("same"), F.col("template"))
                                     .otherwise(joined(F.col("template"), F.col("tokens")))))
        changed = F.col("cluster").isNotNull() & ((F.col("new") != F.col("template")) | (F.col("same") & F.col("full")))
        first = first_constant(F.col("new"))
        promoted = now.where(changed & first.isNotNull() & (first != NO_CONSTANT)).select(first.alias("constant"), F.col("line").alias("line_id"))
        stay = now.where((F.col("cluster").isNull() & ~F.col("full")) | (changed & first.isNull() & (F.col("new") != F.col("template"))))
        none.append(written(stay.select(F.coalesce("cluster", "line").alias("cluster"), F.col("line").alias("since"), F.col("new").alias("template"))))
        none = none if len(none) < 8 else [written(union_all(none))]
        moved = written(moved.unionByName(promoted))
        undecided = undecided.join(now.select("line"), "line", "left_anti")


def candidates(rows: DataFrame, none: DataFrame, moved: DataFrame) -> DataFrame:
    """(line, cluster, template, same, equal, wild): clusters of none that each row may join as of its line."""
    gone = none.select("cluster", "since", F.explode(F.array_distinct("template")).alias("constant")).join(moved, "constant") \
               .where("line_id > since").groupBy("cluster", "since").agg(F.min("line_id").alias("gone"))
    until = F.lead("since", 1, END).over(Window.partitionBy("cluster").orderBy("since"))
    alive = none.withColumn("until", until).join(gone, ["cluster", "since"], "left") \
                .select("cluster", "since", "template", F.least("until", F.coalesce("gone", F.lit(END))).alias("until"), F.size("template").alias("n"))
    alive = written(alive)
    items = alive.select("cluster", "since", "until", "n", F.posexplode("template").alias("pos", "token")).where(~parameter(F.col("token")))
    mine = rows.select("line", "n", "need", F.posexplode("tokens").alias("pos", "token"))
    met = mine.join(items, ["n", "pos", "token"]).where((F.col("since") < F.col("line")) & (F.col("line") <= F.col("until")))
    met = met.groupBy("line", "cluster", "since").agg(F.count(F.lit(1)).alias("equal"), F.first("need").alias("need"))
    near = met.where("equal >= need").select("line", "cluster", "since", "equal")
    text = F.md5(F.to_json("tokens")).alias("id")
    same = rows.select("line", text).join(alive.select("cluster", "since", "until", F.col("template").alias("tokens")).select("cluster", "since", "until", text), "id")
    same = same.where((F.col("since") < F.col("line")) & (F.col("line") <= F.col("until"))).select("line", "cluster", "since", F.lit(0).cast("long").alias("equal"))
    both = near.unionByName(same).groupBy("line", "cluster", "since").agg(F.max("equal").alias("equal"))
    both = both.join(alive.select("cluster", "since", "template"), ["cluster", "since"]).join(rows.select("line", "tokens"), "line")
    wild = F.size(F.filter("template", parameter))
    return both.select("line", "cluster", "template", (F.col("template") == F.col("tokens")).alias("same"), "equal", wild.alias("wild"))


def route_in_order(lines: DataFrame, constants: DataFrame) -> DataFrame:
    """P5 as of the line: (at, tokens, bucket), the first-discovered constant that the line holds, of those
    discovered before it; NULL where there is none, or where the line holds the token ``None``."""
    msgs = lines.select("tokens").distinct()
    held = msgs.select(F.md5(F.to_json("tokens")).alias("id"), F.explode(F.array_distinct("tokens")).alias("constant")).join(constants, "constant")
    held = held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_id", "constant"))).alias("held"),
                                  F.lit(True).alias("any"))  # at most as many as a line has tokens
    out = lines.withColumn("id", F.md5(F.to_json("tokens"))).join(held, "id", "left")
    bucket = F.get(F.filter("held", lambda x: x["line_id"] < F.col("at")), 0)["constant"]
    return out.select("at", "tokens", F.when(~F.array_contains("tokens", NO_CONSTANT), bucket).alias("bucket"))


# ---------------------------------------------------------------- C3b

def path_covers(paths: Column, tokens: Column) -> Column:
    """Whether a path has all tokens, or the first path a wildcard in their place."""
    def one(path: Column) -> Column:
        with_first = F.zip_with(path, F.get(paths, 0), lambda t, f: F.struct(t.alias("t"), f.contains(WILDCARD).alias("free")))
        return F.forall(F.zip_with(with_first, tokens, lambda x, t: x["free"] | (x["t"] == t)), lambda ok: ok)

    return F.exists(paths, one)


def covered_positions(a: Column, b: Column) -> Column:
    """Positions where ``a`` equals ``b`` or holds a wildcard."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) | x.contains(WILDCARD)), lambda ok: ok))


def with_line(paths: Column, tokens: Column, br_thresh: int) -> Column:
    """The paths after a line that they do not cover, ascending and distinct."""
    start = F.struct(F.lit(0).alias("most"), F.get(paths, 0).alias("path"))
    closest = F.aggregate(paths, start, lambda best, p: F.when(
        covered_positions(tokens, p) > best["most"], F.struct(covered_positions(p, tokens).alias("most"), p.alias("path"))).otherwise(best))["path"]
    merged = F.zip_with(closest, tokens, lambda a, b: F.when(a != b, merge_token_keep_delims(a, b)))
    general = F.transform(paths, lambda p: F.zip_with(p, merged, lambda t, m: F.coalesce(m, t)))
    return F.array_sort(F.array_distinct(F.when(F.size(paths) < br_thresh, F.concat(paths, F.array(tokens))).otherwise(general)))


def paths_in_order(members: DataFrame, lines: DataFrame, br_thresh: int = 2) -> DataFrame:
    """(cluster, tokens, line, last), the first and last line of each message in its cluster, and all
    lines (at, tokens) → (cluster, paths array<array<string>>).  Messages of a cluster have one length."""
    members = written(members)
    state = members.groupBy("cluster").agg(F.min("line").alias("since"), F.array(F.min_by("tokens", "line")).alias("paths"))
    state, done = written(state), []
    while True:
        open_ = members.join(state, "cluster").where((F.col("last") > F.col("since")) & ~path_covers(F.col("paths"), F.col("tokens")))
        open_ = written(open_.select("cluster", "since", "tokens", "line"))
        again = open_.where("line <= since").join(lines.withColumnRenamed("tokens", "_t"), F.col("tokens") == F.col("_t")).where("at > since")
        due = open_.where("line > since").select("cluster", "tokens", F.col("line").alias("at")).unionByName(again.select("cluster", "tokens", "at"))
        due = written(due.groupBy("cluster").agg(F.min("at").alias("at"), F.min_by("tokens", "at").alias("tokens")))
        if due.limit(1).count() == 0:
            return union_all([*done, state]).select("cluster", "paths")
        done.append(written(state.join(due.select("cluster"), "cluster", "left_anti")))
        done = done if len(done) < 8 else [written(union_all(done))]
        state = written(state.join(due, "cluster").select("cluster", F.col("at").alias("since"), with_line(F.col("paths"), F.col("tokens"), br_thresh).alias("paths")))
        members = members.join(state.select("cluster"), "cluster", "left_semi")

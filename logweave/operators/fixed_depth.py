"""Fixed-depth mining (C1, C2) and rotation voting (C4).

1. mask → whitespace tokens; equal token lists collapse into *messages* (hash
   aggregate, partial on the map side).
2. Routing key: token count and the leading ``depth - 3`` tokens; a token with a
   digit or a wildcard routes as ``<*>``, and so do all but the first
   ``max_child - 1`` different tokens of a level (by first line, then text).
   Messages shorter than the routing depth are templates of their own (C1q).
3. Within a key, messages are clustered by position splitting at similarity ``st``
   (``operators.position_split``): independent of line order, row count and partitioning.
4. Lines get their template by an equi-join on the message tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.masks import mask_user
from logweave.functions.tokens import WILDCARD, pad_for_rotation, rotate, tokenize, unrotate_template
from logweave.operators.greedy import mine_batch
from logweave.operators.matching import dense_index
from logweave.operators.position_split import SEP, cluster_groups
from logweave.session import cut_lineage, written


def message_id():
    """128 bits that stand for a token list."""
    return F.md5(F.concat_ws(SEP, F.size("tokens").cast("string"), F.array_join("tokens", SEP)))


def route_messages(msgs: DataFrame, depth: int, max_child: int) -> DataFrame:
    """Adds ``grp``, the routing key, to (msg_id, tokens, first_line_id)."""
    m = msgs.withColumn("grp", F.size("tokens").cast("string"))
    for level in range(depth - 3):
        tok = F.coalesce(F.get("tokens", level), F.lit(""))
        own = ~tok.rlike(r"\d") & ~tok.contains(WILDCARD)
        m = m.withColumn("_tok", F.when(own, tok))
        seen = m.where("_tok IS NOT NULL").groupBy("grp", "_tok").agg(F.min("first_line_id").alias("_first"))
        first = Window.partitionBy("grp").orderBy("_first", "_tok")
        child = seen.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") < max_child) \
                    .select("grp", "_tok", F.col("_tok").alias("_child"))
        m = m.join(child, ["grp", "_tok"], "left") \
             .withColumn("grp", F.concat_ws(SEP, "grp", F.coalesce("_child", F.lit(WILDCARD)))).drop("_tok", "_child")
    literal = F.size("tokens") < depth - 2
    return m.withColumn("grp", F.when(literal, F.concat(F.lit("literal" + SEP), F.col("msg_id"))).otherwise(F.md5("grp")))


def cluster_messages(msgs: DataFrame, depth: int = 4, st: float = 0.4, max_child: int = 100) -> DataFrame:
    """(tokens, first_line_id) → (msg_id, tokens, cluster, event_template)."""
    m = written(msgs.select(message_id().alias("msg_id"), "tokens", "first_line_id"), release=True)
    found = cluster_groups(route_messages(m, depth, max_child), F.lit(float(st)))
    return m.select("msg_id", "tokens").join(found, "msg_id").select(
        "msg_id", "tokens", "cluster", F.array_join("template", " ").alias("event_template"))


def mine_fixed(df: DataFrame, content: str = "content", masks=(), depth: int = 4, st: float = 0.4,
               max_child: int = 100, key: str = "line_id", tokens_col=None) -> DataFrame:
    """(key, event_template) for every line."""
    tok = tokens_col if tokens_col is not None else tokenize(mask_user(F.col(content), masks))
    # read by the messages and by the join back to lines: the regex chain runs once
    lines = written(df.select(key, tok.alias("tokens")), release=True)
    msgs = lines.groupBy("tokens").agg(F.min(key).alias("first_line_id"))
    # lines meet their template by the message's id; the token lists stay where they are
    found = written(cluster_messages(msgs, depth, st, max_child).select("msg_id", "event_template"), release=True)
    return lines.where("tokens IS NOT NULL").select(key, message_id().alias("msg_id")).join(found, "msg_id").select(key, "event_template")


def vote(votes: DataFrame, key: str = "line_id") -> DataFrame:
    """Per line the template of most rotations, then of more wildcards, then of the lowest rotation."""
    counted = votes.groupBy(key, "event_template").agg(F.count(F.lit(1)).alias("votes"),
                                                       F.min("rotation").alias("first_rotation"))
    wildcards = F.size(F.split("event_template", r"<\*>")) - 1
    rank = F.struct(F.col("votes"), wildcards, -F.col("first_rotation"))
    return counted.groupBy(key).agg(F.max_by("event_template", rank).alias("event_template"))


def mine_rotated(df: DataFrame, content: str = "content", masks=(), rotations=(0, 1, 2), depth: int = 4,
                 st: float = 0.4, max_child: int = 100, key: str = "line_id", tokens_col=None) -> DataFrame:
    """C4: cluster the tokens rotated by each k, un-rotate, majority vote per line.

    Rotations are mined independently; padding tokens ``_`` (short messages) are cut
    off again after un-rotating.
    """
    tok = tokens_col if tokens_col is not None else tokenize(mask_user(F.col(content), masks))
    base = cut_lineage(df.select(key, tok.alias("tok")))
    votes = None
    for k in rotations:
        rot = rotate(pad_for_rotation(F.col("tok"), len(rotations)), k)
        mined = mine_fixed(base.withColumn("rt", rot), key=key, depth=depth, st=st, max_child=max_child, tokens_col=F.col("rt"))
        back = F.split(unrotate_template(F.col("event_template"), k), " ")
        t = mined.join(base, key).select(key, F.lit(k).alias("rotation"),
                                         F.array_join(F.slice(back, 1, F.greatest(F.size("tok"), F.lit(1))), " ").alias("event_template"))
        votes = t if votes is None else votes.unionByName(t)
    return vote(votes, key)


def first_of_two(templates):
    """Of a line's templates in order of rotation: the most frequent one; if the second is as frequent
    (of more, the earliest two count), the one with more wildcards, then the earlier."""
    kinds = F.array_distinct(templates)
    counted = F.transform(kinds, lambda t, i: F.struct((-F.size(F.filter(templates, lambda x: x == t))).alias("less"), i.alias("i"), t.alias("t")))
    two = F.slice(F.array_sort(counted), 1, 2)
    wild = lambda x: F.size(F.split(x["t"], r"<\*>"))
    a, b = F.get(two, 0), F.get(two, 1)
    return F.when((F.size(two) > 1) & (a["less"] == b["less"]) & (wild(b) > wild(a)), b["t"]).otherwise(a["t"])


def mine_rotated_in_order(df: DataFrame, content: str = "content", masks=(), rotations: int = 3, batch_size: int = 2000,
                          depth: int = 4, st: float = 0.4, max_child: int = 100, key: str = "line_id") -> DataFrame:
    """C4 as a pass finds it: (key, event_template).

    Rotation by rotation and batch by batch of ``batch_size`` lines, the distinct messages of a batch in
    an order seeded by the rotation (here of a hash) join one set of clusters, which is carried on over all
    batches and rotations.  A line's template in a rotation is that, at its end, of the youngest cluster
    that the line has joined so far, rotated back; padding tokens stay.  Of the rotations' templates
    ``first_of_two`` is taken.  All of it is one ordered clustering of (rotation, batch, message) rows.
    """
    lines = written(dense_index(df.select(F.col(key), tokenize(mask_user(F.col(content), masks)).alias("tok")), [F.col(key)], "nth"))
    rows = None
    for k in range(rotations):
        r = lines.select(key, F.floor((F.col("nth") - 1) / batch_size).alias("batch"), F.lit(k).alias("rotation"),
                         rotate(pad_for_rotation(F.col("tok"), rotations), k).alias("tokens"))
        rows = r if rows is None else rows.unionByName(r)
    msgs = rows.select("rotation", "batch", "tokens").distinct()
    seeded = Window.partitionBy("rotation", "batch").orderBy(F.md5(F.concat_ws(" ", F.col("rotation").cast("string"), F.array_join("tokens", " "))))
    at = F.shiftleft(F.col("rotation").cast("long"), 54) + F.col("batch") * F.lit(2 * batch_size) + F.row_number().over(seeded)  # at most a batch's messages
    msgs = written(msgs.withColumn("at", at).withColumn("id", F.md5(F.to_json("tokens"))))
    found, after = mine_batch(msgs, F.col("tokens"), "at", depth, st, max_child)
    joined = rows.withColumn("id", F.md5(F.to_json("tokens"))).drop("tokens").join(msgs.select("rotation", "batch", "id", "at"), ["rotation", "batch", "id"]) \
                 .join(found.select("at", "cluster"), "at").select(key, "rotation", "cluster")
    picks = written(joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rotation", "cluster"))).alias("j")))  # one per rotation
    picks = picks.select(key, F.posexplode(F.transform("j", lambda x, i: F.array_max(F.transform(F.slice("j", 1, i + 1), lambda y: y["cluster"])))).alias("rotation", "cluster"))
    ends = after["versions"].withColumn("rotation", F.explode(F.sequence(F.shiftright("since", 54).cast("int"), F.lit(rotations - 1))))
    ends = ends.groupBy("cluster", "rotation").agg(F.max_by("template", "since").alias("template"))
    t = picks.join(ends, ["cluster", "rotation"])
    last = F.slice("template", F.size("template") - F.col("rotation") + 1, F.col("rotation"))
    back = F.concat(last, F.slice("template", 1, F.size("template") - F.col("rotation")))
    t = t.select(key, "rotation", F.array_join(F.when(F.col("rotation") == 0, F.col("template")).otherwise(back), " ").alias("t"))
    listed = t.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rotation", "t"))), lambda x: x["t"]).alias("ts"))
    return listed.select(key, first_of_two(F.col("ts")).alias("event_template"))

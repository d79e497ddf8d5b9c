"""Template matching joins (M3, M4), line restriction (J3, J4) and dense ids.

M3 — line × template regex match, first template in priority order wins.
A regex theta join is never run as a cross product.  Every template is routed by one
equi-key that any matching line must carry, and a line is listed by its keys:
  * its first token, when it is literal → the line's first token;
  * else its first fully literal token (blank-delimited, so a match must contain it as a
    whole token) → the line's distinct tokens; ``key=<*>`` and the like count as literal
    up to their first delimiter, on both sides;
  * else, of its literal pieces between wildcards and blanks, the gram (three characters,
    or the whole piece if shorter) that the fewest templates hold → the line's grams,
    of which only those that some template is routed by leave the scan's task;
  * else, for templates without any literal, their number of blank runs → the numbers up
    to the line's blanks.
The session's byte limit decides whether templates are broadcast; otherwise the join
shuffles and AQE splits hot keys.  Kinds of keys that no template has cost nothing.

M4 — best same-length template (fixed-depth "fast match"): messages and templates meet in
an inverted index of (token count, position, token); shared entries counted per pair are
the similarity, ``max_by`` over (sim, params, -order) the best.  A message that shares no
entry with any template has the template with the most parameters of its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import cut_lineage
from logweave.functions.tokens import WILDCARD, dynamic_threshold, is_param, template_regex, tokenize

KEY_HEAD = r"^[^=:(\[/<]+[=:(\[/]"     # literal head of a token up to its first delimiter
GRAM = 3


def key_head(token: Column) -> Column:
    """``id=`` of ``id=<*>`` and of ``id=7``; empty where a token has no such head."""
    return F.regexp_extract(token, KEY_HEAD, 0)


def literal_length(t: Column) -> Column:
    return F.length(F.replace(F.replace(t, F.lit(WILDCARD), F.lit("")), F.lit(" "), F.lit("")))


def wildcard_occurrences(t: Column) -> Column:
    return F.size(F.split(t, r"<\*>")) - 1


def match_pattern(template: Column, kind: str = "param") -> Column:
    """Regex a line must fully match: T5 form (blanks flexible, lazy groups) or the
    miner's DOTALL form (escaped literal, wildcard → ``.*?``)."""
    if kind == "param":
        return template_regex(template)
    body = F.replace(F.replace(template, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(WILDCARD), F.lit(r"\E.*?\Q"))
    return F.concat(F.lit(r"(?s)^\Q"), body, F.lit(r"\E\z"))


def grams(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))


def prepare_templates(templates: DataFrame, template: str = "event_template", event_id: str = "event_id",
                      kind: str = "param") -> DataFrame:
    """Template table with pattern, priority and routing key (``via`` and ``route``)."""
    norm = F.regexp_replace(F.col(template), r"<.{1,5}>", WILDCARD)
    t = cut_lineage(templates.select(F.col(event_id).alias("event_id"), F.col(template).alias("event_template"), F.split(norm, " ").alias("toks")))
    literal = F.get(F.filter("toks", lambda x: (x != "") & ~x.contains(WILDCARD)), 0)
    head = F.get(F.filter(F.transform("toks", key_head), lambda x: x != ""), 0)
    first = F.get("toks", 0)
    pieces = F.filter(F.flatten(F.transform("toks", lambda x: F.split(x, r"<\*>|\s+"))), lambda x: x != "")
    t = t.select("event_id", "event_template", literal.alias("literal"), head.alias("head"), pieces.alias("pieces"),
                 (F.size(F.split(F.array_join("toks", " "), " +")) - 1).alias("gaps"),
                 F.when((first != "") & ~first.contains(WILDCARD), first).alias("first"))
    rare = t.where("first IS NULL AND literal IS NULL AND head IS NULL AND size(pieces) > 0")
    gram = F.explode(F.array_distinct(F.flatten(F.transform("pieces", lambda p: F.when(F.length(p) < GRAM, F.array(p)).otherwise(grams(p, GRAM))))))
    rare = rare.select("event_id", "event_template", gram.alias("gram"))
    counts = rare.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    rare = rare.join(counts, "gram").groupBy("event_id", "event_template").agg(F.min_by("gram", F.struct("held", -F.length("gram"), "gram")).alias("gram"))
    t = t.join(rare, ["event_id", "event_template"], "left")
    via = F.when(F.col("first").isNotNull(), "first").when(F.col("literal").isNotNull(), "token").when(F.col("head").isNotNull(), "head") \
           .when(F.col("gram").isNotNull(), "gram").otherwise("gaps")
    return cut_lineage(t.select(
        "event_id", "event_template", match_pattern(F.col("event_template"), kind).alias("pattern"), via.alias("via"),
        F.coalesce("first", "literal", "head", "gram", F.col("gaps").cast("string")).alias("route"),
        F.struct((-literal_length(F.col("event_template"))).alias("a"), wildcard_occurrences(F.col("event_template")).alias("b"),
                 F.col("event_id").alias("c")).alias("priority")))


def line_keys(content: Column, via: str) -> Column:
    """The routing keys of one kind that a line carries."""
    if via == "first":
        return F.transform(F.array(content), lambda c: F.coalesce(F.get(tokenize(c), 0), F.lit("")))
    if via == "token":
        return F.array_distinct(tokenize(content))
    if via == "head":
        return F.array_distinct(F.filter(F.transform(tokenize(content), key_head), lambda x: x != ""))
    if via == "gram":
        return F.array_distinct(F.concat(*[grams(content, k) for k in range(1, GRAM + 1)]))
    blanks = F.length(content) - F.length(F.regexp_replace(content, r"\s", ""))
    return F.transform(F.sequence(F.lit(0), blanks), lambda k: k.cast("string"))


def match_prepared(lines: DataFrame, prepared: DataFrame, kinds: list[str], content: str = "content", key: str = "line_id",
                   template: str = "event_template", event_id: str = "event_id") -> DataFrame:
    """M3 with templates from ``prepare_templates`` and the kinds of keys among them (``key_kinds``)."""
    ln = lines.select(key, F.col(content).alias("__c"))
    found = None
    for via in kinds:
        listed = ln.select(key, "__c", F.explode(line_keys(F.col("__c"), via)).alias("route"))
        met = listed.join(prepared.where(F.col("via") == via).drop("via"), "route").where(F.regexp_like(F.col("__c"), F.col("pattern")))
        met = met.select(key, "event_id", "event_template", "priority")
        found = met if found is None else found.unionByName(met)
    if found is None:
        return lines.select(key, F.lit(None).cast("string").alias(event_id), F.lit(None).cast("string").alias(template))
    best = found.groupBy(key).agg(F.min_by(F.struct("event_id", "event_template"), "priority").alias("m"))
    return lines.select(key).join(best, key, "left").select(key, F.col("m.event_id").alias(event_id), F.col("m.event_template").alias(template))


def key_kinds(prepared: DataFrame) -> list[str]:
    """The kinds of keys that templates are routed by (at most five)."""
    return sorted(r["via"] for r in prepared.select("via").distinct().collect())


def match_templates(lines: DataFrame, templates: DataFrame, content: str = "content", key: str = "line_id",
                    template: str = "event_template", event_id: str = "event_id", kind: str = "param") -> DataFrame:
    """M3: (key, event_id, event_template) for every line; NULL when no template matches."""
    prepared = prepare_templates(templates, template, event_id, kind)
    return match_prepared(lines, prepared, key_kinds(prepared), content, key, template, event_id)


def best_template(messages: DataFrame, templates: DataFrame, tokens: str = "tokens", key: str = "msg_key",
                  template_tokens: str = "template_tokens", template_id: str = "cluster_id",
                  variant: str = "fixed", threshold: float | None = None) -> DataFrame:
    """M4: per message the same-length template with max (similarity, params, -id);
    kept only if similarity ≥ threshold (constant, or the dynamic table when None)."""
    m = messages.select(key, F.col(tokens).alias("__t")).withColumn("n_tokens", F.size("__t"))
    t = templates.select(F.col(template_id).alias("tid"), F.col(template_tokens).alias("__tt")).withColumn("n_tokens", F.size("__tt"))
    t = t.withColumn("params", F.size(F.filter("__tt", lambda x: is_param(x, variant))))
    entries = t.select("tid", "params", "n_tokens", F.posexplode("__tt").alias("pos", "token")).where(~is_param(F.col("token"), variant))
    met = m.select(key, "n_tokens", F.posexplode("__t").alias("pos", "token")).join(entries, ["n_tokens", "pos", "token"])
    met = met.groupBy(key, "tid", "params").agg(F.count(F.lit(1)).alias("equal"))
    met = met.groupBy(key).agg(F.max_by(F.struct("tid", "equal"), F.struct(F.col("equal"), F.col("params"), -F.col("tid"))).alias("b"))
    other = t.groupBy("n_tokens").agg(F.max_by("tid", F.struct(F.col("params"), -F.col("tid"))).alias("other"))
    out = m.select(key, "n_tokens").join(other, "n_tokens").join(met, key, "left")
    sim = F.when(F.col("n_tokens") > 0, F.coalesce("b.equal", F.lit(0)) / F.col("n_tokens"))
    st = dynamic_threshold(F.col("n_tokens"), threshold)
    # -1 = no template reaches the threshold (keeps the id column non-nullable)
    return out.select(key, F.when(sim >= st, F.coalesce("b.tid", "other")).otherwise(F.lit(-1)).cast("long").alias(template_id),
                      F.round(sim, 6).alias("similarity"))


def restrict_lines(raw: DataFrame, kept: DataFrame, key: str = "line_id") -> DataFrame:
    """Rows of ``raw`` whose key appears in ``kept`` (left-semi join)."""
    return raw.join(kept.select(key), key, "left_semi")


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows up to and including each row in ``order``, without a
    single-partition window: range-partition, sum inside each partition, add the partitions before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__k", F.struct(*order)).withColumn("__v", value)
    # materialised once: rows and sums must see the same partitions (two range exchanges may sample different bounds)
    ranged = cut_lineage(keyed.repartitionByRange(n, "__k").withColumn("__pid", F.spark_partition_id()))
    upto = Window.partitionBy("__pid").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("__pid").agg(F.sum("__v").alias("__s"))  # a row per partition
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__pid", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"))
    local = ranged.withColumn("__in", F.sum("__v").over(upto))
    return local.join(sums, "__pid").withColumn(out, F.col("__in") + F.col("__off")).drop("__k", "__v", "__pid", "__in", "__off")


def dense_index(df: DataFrame, order: list[Column], out: str = "idx") -> DataFrame:
    """1-based dense position in ``order``."""
    return running_total(df, order, F.lit(1), out)

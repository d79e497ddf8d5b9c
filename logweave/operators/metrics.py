"""Parse-quality metrics (A1-A10) against labelled ground truth.

Everything is derived from one *contingency table*
``(group..., truth, parsed, n)`` = ``groupBy(group, truth, parsed).count()``:
a hash aggregate with map-side partial counts, whose size is the number of
distinct (truth, parsed) pairs, not the number of lines.  Window totals and
per-template aggregates then run on that small table, and every metric of
every dataset comes out of one ``groupBy(group)`` pass.

Semantics kept from the reference:
* GA/FGA and the template-level metrics drop lines whose truth is NULL; PA
  keeps them in the denominator (a NULL truth is never right).
* A truth group is right iff all its lines carry one parsed template and that
  parsed template has no other line (``n == n_truth == n_parsed``).
* A parsed template is right (PTA/RTA) iff its set of truth templates is
  exactly ``{itself}``.
* Slices restrict the truth templates; denominators become the slice and the
  parsed templates that touch it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.tokens import is_abstract, wildcard_equal
from logweave.operators.matching import dense_index
from logweave.session import written

R = 6  # decimals of the reported metrics


def align(parsed: DataFrame, truth: DataFrame, key: str = "line_id", parsed_col: str = "event_template",
          truth_col: str = "event_template") -> DataFrame:
    """Parsed ⨝ truth on the line id → (key, truth, parsed); parsed NULL → ''."""
    p = parsed.select(key, F.coalesce(F.col(parsed_col), F.lit("")).alias("parsed"))
    t = truth.select(key, F.col(truth_col).alias("truth"))
    return t.join(p, key)


def contingency(df: DataFrame, groups: Sequence[str] = (), truth: str = "truth", parsed: str = "parsed") -> DataFrame:
    return df.groupBy(*groups, F.col(truth).alias("truth"), F.col(parsed).alias("parsed")) \
             .agg(F.count(F.lit(1)).alias("n"))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(a / b, R)


def quality(cont: DataFrame, groups: Sequence[str] = (), filter_templates: DataFrame | None = None) -> DataFrame:
    """GA, PGA, RGA, FGA, PA, PTA, RTA, FTA (+ template counts) per group.

    ``filter_templates``: optional (group..., truth) slice of truth templates (A8/A9).
    """
    g = list(groups)
    valid = cont.where(F.col("truth").isNotNull())
    w_t = Window.partitionBy(*g, "truth")
    w_p = Window.partitionBy(*g, "parsed")
    c = valid.withColumn("n_truth", F.sum("n").over(w_t)).withColumn("n_parsed", F.sum("n").over(w_p))
    right = (F.col("n") == F.col("n_truth")) & (F.col("n") == F.col("n_parsed"))
    # per parsed template: its truth set
    per_parsed = valid.groupBy(*g, "parsed").agg(F.count(F.lit(1)).alias("k"), F.max("truth").alias("t"))
    sm = (F.col("k") == 1) & (F.col("t") == F.col("parsed"))
    if filter_templates is None:
        lines = c.groupBy(*g).agg(F.sum("n").alias("lines"), F.sum(F.when(right, F.col("n"))).alias("right_lines"),
                                  F.count_if(right).alias("right_groups"),
                                  F.count_distinct("truth").alias("ground_templates"))
        parsed_side = per_parsed.groupBy(*g).agg(F.count(F.lit(1)).alias("identified_templates"),
                                                 F.count_if(sm).alias("right_templates"))
        pa = cont.groupBy(*g).agg(F.sum("n").alias("pa_lines"),
                                  F.sum(F.when(F.col("truth") == F.col("parsed"), F.col("n"))).alias("pa_right"))
        grouping_parsed = c.groupBy(*g).agg(F.count_distinct("parsed").alias("grouping_parsed"))
    else:
        f = filter_templates.select(*g, F.col("truth").alias("truth")).distinct().withColumn("in_slice", F.lit(True))
        cf = c.join(f, [*g, "truth"], "left").withColumn("in_slice", F.coalesce("in_slice", F.lit(False)))
        lines = cf.groupBy(*g).agg(F.sum(F.when(F.col("in_slice"), F.col("n"))).alias("lines"),
                                   F.sum(F.when(right & F.col("in_slice"), F.col("n"))).alias("right_lines"),
                                   F.count_if(right & F.col("in_slice")).alias("right_groups"))
        ground = f.groupBy(*g).agg(F.count(F.lit(1)).alias("ground_templates"))
        lines = lines.join(ground, g) if g else lines.crossJoin(ground)  # one row each side when ungrouped
        touched = cf.where("in_slice").select(*g, "parsed").distinct()
        grouping_parsed = touched.groupBy(*g).agg(F.count(F.lit(1)).alias("grouping_parsed"))
        pp = per_parsed.join(touched.withColumn("touch", F.lit(True)), [*g, "parsed"], "left") \
            .join(f.withColumnRenamed("truth", "parsed").withColumnRenamed("in_slice", "p_in"), [*g, "parsed"], "left")
        parsed_side = pp.groupBy(*g).agg(F.count_if(F.col("touch").isNotNull()).alias("identified_templates"),
                                         F.count_if(sm & F.col("p_in").isNotNull()).alias("right_templates"))
        pa = cont.join(f, [*g, "truth"], "inner").groupBy(*g).agg(
            F.sum("n").alias("pa_lines"),
            F.sum(F.when(F.col("truth") == F.col("parsed"), F.col("n"))).alias("pa_right"))
    out = lines
    for other in (parsed_side, pa, grouping_parsed):
        out = out.join(other, g) if g else out.crossJoin(other)
    rl = F.coalesce(F.col("right_lines"), F.lit(0))
    pga = F.col("right_groups") / F.col("grouping_parsed")
    rga = F.col("right_groups") / F.col("ground_templates")
    pta = F.col("right_templates") / F.col("identified_templates")
    rta = F.col("right_templates") / F.col("ground_templates")
    return out.select(
        *g, F.col("identified_templates").cast("long").alias("identified_templates"),
        F.col("ground_templates").cast("long").alias("ground_templates"),
        _ratio(rl, F.col("lines")).alias("ga"),
        F.round(F.coalesce(F.col("pa_right"), F.lit(0)) / F.col("pa_lines"), R).alias("pa"),
        F.round(pga, R).alias("pga"), F.round(rga, R).alias("rga"), F.round(_f1(pga, rga), R).alias("fga"),
        F.round(pta, R).alias("pta"), F.round(rta, R).alias("rta"), F.round(_f1(pta, rta), R).alias("fta"))


def evaluate_miners(lines: DataFrame, miners: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame | None] | None]],
                    key: str = "line_id", truth: str = "truth_template") -> DataFrame:
    """A10: a row of ``quality`` per miner, NULLs for a miner without output.

    A miner takes the lines without their truth and gives (lines with ``key`` and
    ``event_template``, templates), or None.  A line that it leaves out counts as parsed to
    the empty template; a miner that gives no line at all has no output.
    """
    known = lines.select(key, F.col(truth).alias("truth"))
    parsed = None
    for name, miner in miners.items():
        found = miner(lines.drop(truth))
        if found is None:
            continue
        out = written(found[0].select(key, F.coalesce("event_template", F.lit("")).alias("parsed")))
        if out.limit(1).count() == 0:
            continue
        rows = known.join(out, key, "left").select(F.lit(name).alias("dataset"), key, "truth", F.coalesce("parsed", F.lit("")).alias("parsed"))
        parsed = rows if parsed is None else parsed.unionByName(rows)
    names = lines.sparkSession.createDataFrame([(m,) for m in miners], "dataset string")
    if parsed is None:
        return names
    return names.join(quality(contingency(parsed, ["dataset"]), ["dataset"]), "dataset", "left")


def wildcard_quality(cont: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """PA and FTA where wildcard-holding tokens count as ``<*>``."""
    g = list(groups)
    pa = cont.groupBy(*g).agg(
        F.sum("n").alias("lines"),
        F.sum(F.when(wildcard_equal(F.col("truth"), F.col("parsed")), F.col("n"))).alias("ok"))
    valid = cont.where(F.col("truth").isNotNull())
    per = valid.groupBy(*g, "parsed").agg(F.count(F.lit(1)).alias("k"), F.max("truth").alias("t"))
    ok = (F.col("k") == 1) & wildcard_equal(F.col("parsed"), F.col("t"))
    tl = per.groupBy(*g).agg(F.count(F.lit(1)).alias("identified"), F.count_if(ok).alias("right"))
    gt = valid.groupBy(*g).agg(F.count_distinct("truth").alias("ground"))
    out = pa
    for other in (tl, gt):
        out = out.join(other, g) if g else out.crossJoin(other)
    p, r = F.col("right") / F.col("identified"), F.col("right") / F.col("ground")
    return out.select(*g, F.round(F.coalesce("ok", F.lit(0)) / F.col("lines"), R).alias("pa_wildcard"),
                      F.round(p, R).alias("pta_wildcard"), F.round(r, R).alias("rta_wildcard"),
                      F.round(_f1(p, r), R).alias("fta_wildcard"))


def error_types(cont: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per parsed template SM / OG / UG / MX (same, over-, under-general, mixed)."""
    g = list(groups)
    pairs = cont.where(F.col("truth").isNotNull()).select(*g, "parsed", "truth").distinct()
    pair_type = (F.when(is_abstract(F.col("parsed"), F.col("truth")), F.lit("OG"))
                 .when(is_abstract(F.col("truth"), F.col("parsed")), F.lit("UG")).otherwise(F.lit("MX")))
    per = pairs.withColumn("ptype", pair_type).groupBy(*g, "parsed").agg(
        F.count(F.lit(1)).alias("k"), F.max("truth").alias("t"), F.collect_set("ptype").alias("types"))
    kind = (F.when((F.col("k") == 1) & (F.col("t") == F.col("parsed")), F.lit("SM"))
            .when(F.size("types") == 1, F.get("types", 0)).otherwise(F.lit("MX")))
    return per.select(*g, "parsed", kind.alias("error_type"))


def error_type_ratios(types: DataFrame, cont: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    g = list(groups)
    gt = cont.where(F.col("truth").isNotNull()).groupBy(*g).agg(F.count_distinct("truth").alias("ground"))
    agg = types.groupBy(*g).agg(F.count(F.lit(1)).alias("total"),
                                *[F.count_if(F.col("error_type") == t).alias(t.lower()) for t in
                                  ("SM", "OG", "UG", "MX")])
    out = agg.join(gt, g) if g else agg.crossJoin(gt)
    p, r = F.col("sm") / F.col("total"), F.col("sm") / F.col("ground")
    return out.select(*g, F.round(p, R).alias("pta"), F.round(r, R).alias("rta"), F.round(_f1(p, r), R).alias("f1"),
                      *[F.round(F.col(t) / F.col("total"), R).alias(f"{t}_ratio") for t in ("og", "ug", "mx")])


def gt_markers(template: Column) -> Column:
    """The reference counts wildcards with the *regex* ``<*>``, i.e. ``>`` characters."""
    return F.length(template) - F.length(F.replace(template, F.lit(">"), F.lit("")))


def complexity_slice(templates: DataFrame, level: int, groups: Sequence[str] = (),
                     template: str = "truth") -> DataFrame:
    """Truth templates with 0 (level 1), 1-4 (level 2) or ≥5 (level 3) wildcards."""
    k = gt_markers(F.col(template))
    cond = {1: k == 0, 2: (k >= 1) & (k <= 4), 3: k >= 5}[level]
    return templates.where(cond).select(*groups, F.col(template).alias("truth"))


def frequency_slice(templates: DataFrame, percent: int, groups: Sequence[str] = (),
                    template: str = "truth", occurrences: str = "occurrences") -> DataFrame:
    """The ``percent``% rarest (positive) or most frequent (negative) templates.

    Order: occurrences, then template (ties are unordered in the reference)."""
    g = list(groups)
    if g:
        w_all = Window.partitionBy(*g)
        t = templates.withColumn("__rk", F.row_number().over(w_all.orderBy(occurrences, template))) \
                     .withColumn("__n", F.count(F.lit(1)).over(w_all))
    else:  # ranks of the whole table come from range partitions, not from one task
        t = dense_index(templates, [F.col(occurrences), F.col(template)], "__rk").withColumn("__n", F.lit(templates.count()))
    if percent > 0:
        keep = F.col("__rk") <= F.floor(F.col("__n") / 100.0 * percent)
    else:
        keep = F.col("__rk") > F.col("__n") - F.floor(F.col("__n") / 100.0 * (-percent))
    return t.where(keep).select(*g, F.col(template).alias("truth"))


def truth_template_table(cont: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(group..., truth, occurrences) from the contingency table."""
    return cont.where(F.col("truth").isNotNull()).groupBy(*groups, "truth").agg(F.sum("n").alias("occurrences"))

"""n-gram frequency template mining (C5-C9), fully native Spark.

Plan (batch, C6):
  1. lines → tokens; identical token lists are deduplicated into *messages*
     with a multiplicity (hash aggregate, partial on the map side: a message
     that holds a third of all lines costs one row per map task).
  2. ``posexplode`` the messages, each token with its two predecessors (NULL before
     the start); one ``sum(mult)`` aggregate keyed by the three token columns (no
     string join, so no key collisions) holds all counts: bigrams and unigrams are
     sums of it.  Over a large table steps 2 and 3 run slice by slice of the middle token.
  3. Both ratios are computed per distinct triple from that small table, and the
     token table is joined with it once, on equi-keys.  AQE picks broadcast or
     shuffle from the runtime sizes and splits skewed gram keys.
  4. Per message, the ratios are folded left-to-right with ``aggregate``:
     position i is dynamic iff its ratio ≤ threshold, where the ratio is the
     trigram one unless position i-2 was dynamic (then the bigram one).
  5. Templates go back to lines by an equi-join on the message key.

Online (C7): a gram's count "as of" a line is a running count over the gram's
occurrences in line order.  Hot grams are split: running counts inside
(gram, line-id bucket) plus the prefix of the bucket totals, so no window
partition ever holds one gram's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.masks import mask_general
from logweave.functions.tokens import WILDCARD, strip_quotes, tokenize
from logweave.session import Parts, cut_lineage, drop_written, slices_of, written

DEFAULT_THRESHOLD = 0.2


def ngram_tokens(df: DataFrame, content: str = "Content", user_masks=(), out: str = "tokens",
                 masker=None) -> DataFrame:
    """S4 + M2c + T1: ' ' + content, user masks, general masks, whitespace tokens.

    ``masker`` (Column → Column) replaces the general masks, e.g. the typed chain.
    """
    masked = mask_general(F.col(content), user_masks) if masker is None else masker(F.col(content))
    return df.withColumn(out, tokenize(masked))


def message_key(tokens: Column) -> Column:
    """Two independent 64-bit hashes of the token list: collision-free in practice
    at any table size, and a cheap shuffle/join key compared with the array."""
    return F.struct(F.xxhash64(tokens).alias("h1"), F.xxhash64(F.lit("msg"), tokens).alias("h2"))


def messages(df: DataFrame, tokens: str = "tokens", order_col: str = "line_id",
             dictionary_filter: Column | None = None) -> DataFrame:
    """Distinct token lists: (msg_key, tokens, mult, dict_mult, first_line_id).

    ``dict_mult`` counts only lines that feed the dictionaries (all by default).
    """
    in_dict = F.lit(1) if dictionary_filter is None else F.when(dictionary_filter, 1).otherwise(0)
    return (df.withColumn("msg_key", message_key(F.col(tokens)))
              .groupBy("msg_key")
              .agg(F.first(tokens).alias("tokens"), F.count(F.lit(1)).alias("mult"),
                   F.sum(in_dict).alias("dict_mult"), F.min(order_col).alias("first_line_id")))


def with_predecessors(tokens: Column) -> Column:
    """array<struct(w3 token, w2 previous, w1 previous-but-one)> — explode this instead
    of carrying the whole token array on every exploded row (linear, not quadratic)."""
    n = F.size(tokens)
    null = F.lit(None).cast("string")
    prev1 = F.slice(F.concat(F.array(null), tokens), 1, n)
    prev2 = F.slice(F.concat(F.array(null, null), tokens), 1, n)
    return F.arrays_zip(tokens.alias("w3"), prev1.alias("w2"), prev2.alias("w1"))


def slice_of(s: int, slices: int, *keys: str) -> Column:
    """The rows of slice ``s``, by a hash of the keys."""
    return F.lit(True) if slices == 1 else F.pmod(F.xxhash64(*keys), F.lit(slices)) == s


def id_slice(s: int, slices: int) -> Column:
    """The messages of slice ``s``."""
    return F.lit(True) if slices == 1 else F.pmod(F.col("msg_id"), F.lit(slices)) == s


def numbered_messages(msgs: DataFrame) -> DataFrame:
    """The messages as a table, with ``msg_id``: a long of its own, which costs a row per token less than the key."""
    return written(msgs.withColumn("msg_id", F.monotonically_increasing_id()), "messages", release=True)


def exploded_grams(msgs: DataFrame, key: str = "msg_key", ends: bool = False) -> DataFrame:
    """One row per token occurrence of a message, with its two predecessors.

    ``ends``: also one row after the last token, of which ``w3`` is NULL, so that every token is ``w2`` of one row.
    """
    tokens = F.concat("tokens", F.array(F.lit(None).cast("string"))) if ends else F.col("tokens")
    e = msgs.select(key, "mult", "dict_mult", F.posexplode(with_predecessors(tokens)).alias("pos", "g"))
    return e.select(key, "mult", "dict_mult", "pos", "g.w3", "g.w2", "g.w1")


def triple_counts(exploded: DataFrame) -> DataFrame:
    """(w1, w2, w3, c): dictionary occurrences of each token with its predecessors (c may be 0)."""
    return written(exploded.groupBy("w1", "w2", "w3").agg(F.sum("dict_mult").alias("c")), "triples", release=True)


def counts_of(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uni(w, c1), bi(w1, w2, c2), tri(w1, w2, w3, c3)) as sums of the triple counts."""
    t = triples.where("c > 0")
    uni = t.groupBy(F.col("w3").alias("w")).agg(F.sum("c").alias("c1"))
    bi = t.where("w2 IS NOT NULL").groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.sum("c").alias("c2"))
    tri = t.where("w1 IS NOT NULL").select("w1", "w2", "w3", F.col("c").alias("c3"))
    return uni, bi, tri


def gram_counts(exploded: DataFrame, slices: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Uni-, bi- and trigram counts over the dictionary lines.

    Counted in slices of the last token, which all three have in common.
    """
    if slices == 1:
        return counts_of(triple_counts(exploded))
    uni, bi, tri = outs = [Parts(exploded.sparkSession, x) for x in ("unigrams", "bigrams", "trigrams")]
    for s in range(slices):
        t = triple_counts(exploded.where(slice_of(s, slices, "w3")))
        for out, counts in zip(outs, counts_of(t), strict=True):
            out.add(counts)
        drop_written(t)
    return uni.table(), bi.table(), tri.table()


def triple_ratios(triples: DataFrame) -> DataFrame:
    """(w1, w2, w3, f_bi, f_tri) of every triple with a predecessor; 0 where a count is missing.

    The triples are those of rows with ``ends``, whole for each ``w2`` they hold: the occurrences of ``w2``
    and of the grams that begin or end with it are sums of theirs.
    """
    uni = triples.groupBy("w2").agg(F.sum("c").alias("c1"))
    # at most a row per word is in one group of these, whatever the number of occurrences
    t = triples.withColumn("c2", F.sum("c").over(Window.partitionBy("w2", "w3"))).join(uni, "w2")
    # the share of a bigram among its first word's occurrences
    t = t.select("w1", "w2", "w3", "c", F.when(F.col("c2") > 0, F.col("c2") / F.col("c1")).otherwise(0.0).alias("f_bi"))
    t = t.withColumn("cb", F.sum("c").over(Window.partitionBy("w1", "w2"))).where("w3 IS NOT NULL")
    f_tri = F.when(F.col("w1").isNotNull() & (F.col("c") > 0), F.col("c") / F.col("cb")).otherwise(0.0)
    return written(t.select("w1", "w2", "w3", "f_bi", f_tri.alias("f_tri")), "ratios", release=True)


def score_triples(exploded: DataFrame, ratios: DataFrame) -> DataFrame:
    """Token table with both candidate ratios, in one join."""
    e = exploded.where((F.col("pos") >= 1) & F.col("w3").isNotNull())
    r = ratios.select(F.col("w1").alias("r1"), F.col("w2").alias("r2"), F.col("w3").alias("r3"), "f_bi", "f_tri")
    return e.join(r, e["w1"].eqNullSafe(r["r1"]) & (e["w2"] == r["r2"]) & (e["w3"] == r["r3"])).drop("r1", "r2", "r3")


def scored_positions(msgs: DataFrame, slices: int, ratio=F.col) -> DataFrame:
    """(msg_id, pos, f_bi, f_tri) of every position but the first, as a table.

    The rows of one slice of the middle words ``w2`` hold all counts that their ratios need, so slices are
    counted and scored one after the other.  ``ratio``: what to keep of a ratio, by the name of its column.
    """
    out = Parts(msgs.sparkSession, "scored")
    ex = exploded_grams(msgs, "msg_id", ends=True).where("pos >= 1").select("msg_id", "pos", "w1", "w2", "w3", "dict_mult")
    for s in range(slices):
        part = written(ex.where(slice_of(s, slices, "w2")), "grams") if slices > 1 else ex
        triples = triple_counts(part)
        ratios = triple_ratios(triples)
        drop_written(triples)
        out.add(score_triples(part, ratios).select("msg_id", "pos", ratio("f_bi").alias("f_bi"), ratio("f_tri").alias("f_tri")))
        drop_written(ratios, *([part] if slices > 1 else []))
    return out.table()


def gram_ratios(uni: DataFrame, bi: DataFrame, tri: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per distinct gram: f_bi(w1, w2) = c2/c1(w1); f_tri(w1, w2, w3) = c3/c2(w1, w2)."""
    fbi = bi.join(uni.withColumnRenamed("w", "w1"), "w1").select(
        "w1", "w2", (F.col("c2") / F.col("c1")).alias("f_bi"))
    ftri = tri.join(bi, ["w1", "w2"]).select("w1", "w2", "w3", (F.col("c3") / F.col("c2")).alias("f_tri"))
    return fbi, ftri


def score_positions(exploded: DataFrame, fbi: DataFrame, ftri: DataFrame) -> DataFrame:
    """Token table with both candidate ratios (missing gram → 0)."""
    e = exploded.where(F.col("pos") >= 1)
    b = fbi.withColumnRenamed("w1", "b1").withColumnRenamed("w2", "b2")
    e = e.join(b, (e["w2"] == b["b1"]) & (e["w3"] == b["b2"]), "left").drop("b1", "b2")
    t = ftri.withColumnRenamed("w1", "t1").withColumnRenamed("w2", "t2").withColumnRenamed("w3", "t3")
    e = e.join(t, (e["w1"] == t["t1"]) & (e["w2"] == t["t2"]) & (e["w3"] == t["t3"]), "left") \
         .drop("t1", "t2", "t3")
    return e.withColumn("f_bi", F.coalesce("f_bi", F.lit(0.0))).withColumn("f_tri", F.coalesce("f_tri", F.lit(0.0)))


def dynamic_flags(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, key: str = "msg_key") -> DataFrame:
    """Per (message, position ≥ 1): ``dyn`` flag and the ratio actually used ``f``.

    Position i's flag is a function of the flag at i-2: a constant (i = 1, or
    both ratios on the same side of the threshold), the identity (bigram ratio
    dynamic, trigram static) or a negation.  So flag[i] = the last constant of
    its parity chain XOR the parity of the negations since — running window
    aggregates over ONE window partition per message (both parity chains are
    kept apart by the expressions), linear in the line length; the per-message
    aggregate that follows reuses that partitioning (no extra shuffle).
    """
    thr = F.lit(float(threshold))
    bd, td = F.col("f_bi") <= thr, F.col("f_tri") <= thr
    g = scored.select(key, "pos", "f_bi", "f_tri", (F.col("pos") % 2).alias("par"),
                      ((F.col("pos") == 1) | (bd == td)).alias("is_const"), bd.alias("cval"),
                      ((F.col("pos") > 1) & ~bd & td).cast("int").alias("is_not"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for p in (0, 1):
        mine = F.col("par") == p
        g = g.withColumn(f"cn{p}", F.sum(F.when(mine, F.col("is_not")).otherwise(0)).over(w))
    for p in (0, 1):
        mine = (F.col("par") == p) & F.col("is_const")
        # position 0 (static) heads the even chain: an empty even prefix means base False
        g = g.withColumn(f"b{p}", F.coalesce(F.last(F.when(mine, F.col("cval")), ignorenulls=True).over(w),
                                             F.lit(False))) \
             .withColumn(f"bn{p}", F.coalesce(F.last(F.when(mine, F.col(f"cn{p}")), ignorenulls=True).over(w),
                                              F.lit(0)))
    dyn = F.when(F.col("par") == 0, F.col("b0") != (((F.col("cn0") - F.col("bn0")) % 2) == 1)) \
           .otherwise(F.col("b1") != (((F.col("cn1") - F.col("bn1")) % 2) == 1))
    g = g.withColumn("dyn", dyn)
    prev = F.coalesce(F.lag("dyn", 2).over(Window.partitionBy(key).orderBy("pos")), F.lit(False))
    used = F.when(F.col("pos") == 1, F.col("f_bi")).when(prev, F.col("f_bi")).otherwise(F.col("f_tri"))
    return g.select(key, "pos", "dyn", used.alias("f"))


def fold_dynamic(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD, key: str = "msg_key") -> DataFrame:
    """Per message: ``dyn`` array<boolean>, one flag per position (position 0 static)."""
    d = dynamic_flags(scored, threshold, key)
    per = d.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "dyn"))).alias("fs"))
    flags = F.concat(F.array(F.lit(False)), F.transform("fs", lambda x: x["dyn"]))
    return per.select(key, flags.alias("dyn"))


def apply_flags(tokens: Column, dyn: Column) -> Column:
    """Template: dynamic tokens → ``<*>``, blank-joined, quotes and commas removed."""
    dyn = F.coalesce(dyn, F.array().cast("array<boolean>"))  # one-token messages: nothing scored
    t = F.zip_with(tokens, dyn, lambda w, d: F.when(F.coalesce(d, F.lit(False)), F.lit(WILDCARD)).otherwise(w))
    return strip_quotes(F.array_join(t, " "))


def first_lines(df: DataFrame, order_col: str, n: int) -> tuple[DataFrame, Column]:
    """(``df``, which of its rows are the first ``n`` in line order).

    The order column alone is ranked; only where the last of the first has equals or is NULL are whole rows ranked.
    """
    from logweave.operators.matching import dense_index
    last = dense_index(df.select(order_col), [F.col(order_col)], out="__dict_idx").where(F.col("__dict_idx") == n).select(order_col).first()
    if last is None:  # there are no more than these
        return df, F.lit(True)
    upto = F.col(order_col).isNull() | (F.col(order_col) <= F.lit(last[0]))
    if last[0] is not None and df.where(upto).count() == n:
        return df, upto
    return dense_index(df, [F.col(order_col)], out="__dict_idx"), F.col("__dict_idx") <= n


def parsed_messages(m: DataFrame) -> DataFrame:
    """Messages with their flags ``dyn`` → template and counts instead of tokens and flags."""
    # one-token messages have no scored position: all static
    m = m.withColumn("event_template", apply_flags(F.col("tokens"), F.col("dyn"))) \
         .withColumn("n_dynamic", F.size(F.filter(F.coalesce("dyn", F.array().cast("array<boolean>")),
                                                  lambda x: x)).cast("long")) \
         .withColumn("n_static", (F.size("tokens") - F.col("n_dynamic")).cast("long"))
    return m.drop("msg_id", "tokens", "dyn")


def ngram_parse(df: DataFrame, content: str = "Content", threshold: float = DEFAULT_THRESHOLD,
                user_masks=(), order_col: str = "line_id", dictionary_filter: Column | None = None,
                keep: tuple[str, ...] = (), masker=None, tokens_col: str | None = None,
                ratio: float | None = None, total_lines: int | None = None,
                slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (lines(line_id, keep..., tokens, event_template, n_dynamic, n_static),
    messages(msg_key, mult, dict_mult, first_line_id, event_template, n_dynamic, n_static))."""
    if ratio is not None:
        # dictionaries from the first int(N·ratio)+1 lines in line order (N = all lines of the
        # file when given, else the lines here)
        df, dictionary_filter = first_lines(df, order_col, int((total_lines if total_lines is not None else df.count()) * ratio) + 1)
    # ``tokens_col``: the caller already tokenised (e.g. shared with another parse)
    tok = df.withColumnRenamed(tokens_col, "tokens") if tokens_col else \
        ngram_tokens(df, content, user_masks, masker=masker)
    # read by the messages and by the join back to lines: the regex chain runs once
    extra = [] if dictionary_filter is None else [dictionary_filter.alias("__in_dict")]
    tok = written(tok.select(order_col, *keep, "tokens", *extra), "tokens", release=True)
    n = slices or slices_of(tok)
    msgs = numbered_messages(messages(tok, "tokens", order_col, F.col("__in_dict") if extra else None))
    # the flags depend on the sides of the threshold alone: two values compress to a bit
    side = lambda f: F.when(F.col(f) <= float(threshold), float(threshold)).otherwise(float(threshold) + 1)
    scored = scored_positions(msgs, n, side)
    parsed = Parts(df.sparkSession, "parsed")
    for s in range(n):
        flags = fold_dynamic(scored.where(id_slice(s, n)), threshold, "msg_id")
        parsed.add(parsed_messages(msgs.where(id_slice(s, n)).join(flags, "msg_id", "left")))
    m = parsed.table()
    drop_written(msgs, scored)
    lines = tok.select(order_col, *keep, "tokens", message_key(F.col("tokens")).alias("msg_key")).join(
        m.select("msg_key", "event_template", "n_dynamic", "n_static"), "msg_key").drop("msg_key")
    return lines, m


def scored_messages(df: DataFrame, content: str = "Content", user_masks=(), masker=None,
                    slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, scored positions) with ``msg_id`` — the inputs of the entropy histogram."""
    msgs = numbered_messages(messages(ngram_tokens(df, content, user_masks, masker=masker)))
    return msgs, scored_positions(msgs, slices or slices_of(msgs))


def event_table_from_messages(m: DataFrame) -> DataFrame:
    """C10 straight from the deduplicated messages (multiplicity, first line):
    no second pass over the lines."""
    from logweave.functions.tokens import event_id
    return (m.groupBy("event_template").agg(F.sum("mult").alias("occurrences"),
                                             F.min("first_line_id").alias("first_line_id"))
             .select(event_id(F.col("event_template")).alias("event_id"), "event_template", "occurrences",
                     "first_line_id"))


def entropy_histogram(scored: DataFrame, msgs: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                      slices: int | None = None) -> DataFrame:
    """How often each ratio value was used (per line, so weighted by multiplicity)."""
    n, out = slices or slices_of(msgs), Parts(msgs.sparkSession, "histogram")
    for s in range(n):
        d = dynamic_flags(scored.where(id_slice(s, n)), threshold, "msg_id")
        d = d.join(msgs.where(id_slice(s, n)).select("msg_id", "mult"), "msg_id")
        out.add(d.groupBy(F.round("f", 6).alias("f")).agg(F.sum("mult").alias("count")))
    return out.table().groupBy("f").agg(F.sum("count").alias("count"))


def count_of_counts(counts: DataFrame, count_col: str) -> DataFrame:
    """Dictionary summary — how many grams have each count."""
    return counts.groupBy(F.col(count_col).alias("gram_count")).agg(F.count(F.lit(1)).alias("n_grams"))


# --- online form (C7) ----------------------------------------------------------
def running_counts(occ: DataFrame, keys: list[str], order_col: str = "line_id", bucket: int = 1 << 16,
                   out: str = "c") -> DataFrame:
    """Per occurrence, the number of occurrences of its gram in lines ≤ its line.

    Two-level prefix sum so a hot gram is split across (gram, bucket) windows.
    """
    b = F.floor(F.col(order_col) / bucket)
    occ = occ.withColumn("__b", b)
    w_in = Window.partitionBy(*keys, "__b").orderBy(order_col).rangeBetween(Window.unboundedPreceding, 0)
    local = occ.withColumn("__local", F.count(F.lit(1)).over(w_in))
    totals = occ.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w_b = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__n").over(w_b), F.lit(0))).drop("__n")
    return local.join(offsets, [*keys, "__b"]).withColumn(out, F.col("__local") + F.col("__off")) \
                .drop("__b", "__local", "__off")


def running_line_counts(occ: DataFrame, keys: list[str], order_col: str = "line_id", bucket: int = 1 << 16,
                        out: str = "c", slices: int = 1) -> DataFrame:
    """W1 with one row per line and gram: (order_col, keys, out), the gram's occurrences in lines ≤ its line.

    ``slices``: the grams are counted in that many slices, one after the other.  All occurrences move once, by (gram, bucket): counts per line, their running sums and the
    bucket totals are of that partitioning; only the totals move again for the prefix.
    """
    if slices > 1:
        parts = Parts(occ.sparkSession, "running")
        for s in range(slices):
            parts.add(running_line_counts(occ.where(slice_of(s, slices, *keys)), keys, order_col, bucket, out))
        return parts.table()
    occ = occ.select(order_col, *keys, F.floor(F.col(order_col) / bucket).alias("__b")).repartition(*keys, "__b")
    per = occ.groupBy(*keys, "__b", order_col).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys, "__b").orderBy(order_col)
    local = per.withColumn("__local", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))) \
               .withColumn("__more", F.lead(order_col).over(w)).drop("__n")
    totals = local.where("__more IS NULL").select(*keys, "__b", F.col("__local").alias("__n"))
    w_b = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__b", F.coalesce(F.sum("__n").over(w_b), F.lit(0)).alias("__off"))
    return local.join(offsets, [*keys, "__b"]).select(order_col, *keys, (F.col("__local") + F.col("__off")).alias(out))


def ngram_parse_online(df: DataFrame, content: str = "Content", threshold: float = DEFAULT_THRESHOLD,
                       user_masks=(), order_col: str = "line_id", masker=None) -> DataFrame:
    """Dictionaries as of each line (the line itself included), then the C6 fold.

    Every count the scorer needs belongs to a gram that occurs in the line
    itself, at position i (bigram / trigram ending at i) or i-1 (unigram /
    bigram ending at i-1).  So the three running-count tables are aligned by
    (line, position): one union, one repartition by line, ``lag`` for i-1 —
    and the flag windows reuse that partitioning.
    """
    L = order_col
    # read by three running counts and the final join: tokenise (regex chain) once
    tok = cut_lineage(ngram_tokens(df, content, user_masks, masker=masker).select(L, "tokens"))
    e = tok.select(L, F.posexplode(with_predecessors(F.col("tokens"))).alias("pos", "g")) \
           .select(L, "pos", "g.w3", "g.w2", "g.w1")
    grams = [(1, e, ["w3"]), (2, e.where("pos >= 1"), ["w2", "w3"]), (3, e.where("pos >= 2"), ["w1", "w2", "w3"])]
    parts = []
    for kind, src, cols in grams:
        occ = src.select(L, "pos", *[F.col(c).alias(f"g{i}") for i, c in enumerate(cols)])
        rc = running_counts(occ, [f"g{i}" for i in range(len(cols))], L, out="c")
        parts.append(rc.select(L, "pos", F.lit(kind).alias("kind"), "c"))
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(L)
    per = u.groupBy(L, "pos").agg(*[F.max(F.when(F.col("kind") == k, F.col("c"))).alias(f"c{k}") for k in (1, 2, 3)])
    w = Window.partitionBy(L).orderBy("pos")
    s = per.select(L, "pos", "c2", "c3", F.lag("c1", 1).over(w).alias("c1p"), F.lag("c2", 1).over(w).alias("c2p")) \
           .where("pos >= 1")
    s = s.select(F.col(L).alias("msg_key"), "pos", (F.col("c2") / F.col("c1p")).alias("f_bi"),
                 F.coalesce(F.col("c3") / F.col("c2p"), F.lit(0.0)).alias("f_tri"))
    flags = fold_dynamic(s, threshold).withColumnRenamed("msg_key", L)
    out = tok.join(flags, L, "left")
    return out.select(L, apply_flags(F.col("tokens"), F.col("dyn")).alias("event_template"))

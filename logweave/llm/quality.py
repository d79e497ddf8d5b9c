"""Line-first quality rules (operator 3), as DataFrame expressions.

Every line is judged on its own: too little or too much punctuation, navigation
(runs of separators and other symbols between the words) or boilerplate phrases.
Failing lines are removed; a document that thereby loses more than ``MAX_LOST``
percent of its word characters, or that fails the base counts, is rejected.

Base counts of a text: words (runs without ASCII white space), their characters,
symbols, repeated lines, and words that stand in an 8-word window found twice or
more.  Windows are compared by 64-bit hashes of their words within one document.

Defined cases: a null text has no words; a text without words fails the base
counts and is rejected; lines without words are never judged or removed; equal
rows are judged alike; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import GAP, WORD, free_name, let

MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words
MAX_LOST = 50  # percent of word characters
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Separators and marks of menus, tables and markup; a run counts once.
SEPARATOR_RUN = r"[#*$%&|<>»›•→]+"
SHOUT = r"[!?]{2,}"
MARK = r"[.,;:!?…。！？]"
DENSE = 30  # percent: runs of symbols or of exclamation marks against words
BARE_WORDS = 40  # a line of so many words must hold a mark
#: Phrases of page furniture and licence notes, in lines of at most PHRASE_WORDS words.
PHRASES = (r"(?i)(?:accept (?:all )?cookies|use of cookies|cookie policy|enable javascript|javascript is disabled|lorem ipsum"
           r"|terms of (?:use|service)|privacy policy|all rights reserved|sign (?:in|up) (?:to|for)|subscribe to our"
           r"|click here|share this|skip to (?:main )?content|powered by|back to top|(?:licensed|released) under (?:the|cc)|copyright (?:\(c\)|©))")
PHRASE_WORDS = 30


def line_fails(line: Column, n_words: Column) -> Column:
    """Whether a line with words breaks a rule."""
    marked, shouts = F.regexp_count(line, F.lit(SEPARATOR_RUN)), F.regexp_count(line, F.lit(SHOUT))
    dense = lambda runs: (runs >= 3) & (runs * 100 >= n_words * DENSE)
    navigation = let(marked, dense)
    punctuation = let(shouts, dense) | ((n_words >= BARE_WORDS) & ~line.rlike(MARK))
    boilerplate = (n_words <= PHRASE_WORDS) & line.rlike(PHRASES)
    return (n_words > 0) & (navigation | punctuation | boilerplate)


def chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.regexp_replace(text, GAP, ""))


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur at least twice in ``words``."""
    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        alike = lambda s, a, b: F.get(s, a)["k"] == F.get(s, b)["k"]  # noqa: E731  null beyond the ends
        starts = let(placed, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: F.coalesce(alike(s, j, j - 1), F.lit(False)) | F.coalesce(alike(s, j, j + 1), F.lit(False))),
            lambda x: x["i"])))
        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(starts, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n")),
                           lambda a: a["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    keys = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    unless = lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0))
    return let(hashes, lambda h: F.when(F.size(h) > WINDOW, let(keys(h), unless)).otherwise(F.lit(0)))


def judged(text: Column) -> Column:
    """A struct of all counts, the verdicts and the cleaned text of a text column."""
    text = F.coalesce(text, F.lit(""))
    lines = F.transform(F.split(text, "\n", -1), lambda s: F.struct(s.alias("s"), F.regexp_extract_all(s, F.lit(WORD), F.lit(0)).alias("w")))
    ruled = F.transform(lines, lambda x: F.struct(x["s"].alias("s"), x["w"].alias("w"), line_fails(x["s"], F.size(x["w"])).alias("bad")))

    def counts(d: Column) -> Column:
        text, rows = d["text"], d["rows"]
        filled = F.transform(F.filter(rows, lambda x: F.size(x["w"]) > 0), lambda x: x["s"])
        words = F.flatten(F.transform(rows, lambda x: x["w"]))
        lost = F.aggregate(F.filter(rows, lambda x: x["bad"]), F.lit(0), lambda n, x: n + chars(x["s"]))
        kept_lines = F.filter(rows, lambda x: ~x["bad"])
        return F.struct(
            F.aggregate(rows, F.lit(0), lambda n, x: n + F.size(x["w"])).cast("long").alias("n_words"),
            chars(text).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            let(filled, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            lost.cast("long").alias("lost_chars"),
            (F.size(rows) - F.size(kept_lines)).cast("long").alias("n_removed_lines"),
            F.array_join(F.transform(kept_lines, lambda x: x["s"]), "\n").alias("clean_text"))

    def verdicts(c: Column) -> Column:
        base = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEATED)
        kept = ~base & (c["lost_chars"] * 100 <= c["word_chars"] * MAX_LOST)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return F.struct(*[c[n].alias(n) for n in names], base.alias("base_failed"), kept.alias("kept"),
                        c["lost_chars"].alias("lost_chars"), c["n_removed_lines"].alias("n_removed_lines"), c["clean_text"].alias("clean_text"))

    return let(let(F.struct(text.alias("text"), ruled.alias("rows")), counts), verdicts)


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, lost_chars, n_removed_lines, clean_text) of every document."""
    return df.select(F.col(id_col).alias("id"), judged(F.col(text_col).cast("string")).alias("j")).select(F.col("id").alias(id_col), "j.*")


def keep_clean(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows that pass, failing lines removed from their text; columns as in ``df``.

    ``length_col`` (if the table has it) follows a changed text.
    """
    j = free_name(df.columns, "_judged")
    # a generated column is not pushed into the filter, so texts are judged once
    d = df.select("*", F.explode(F.array(judged(F.col(text_col)))).alias(j)).where(F.col(j)["kept"])
    return with_text(d, df.columns, text_col, F.col(j)["clean_text"], length_col)


def with_text(d: DataFrame, columns: list[str], text_col: str, new: Column, length_col: str | None) -> DataFrame:
    """``columns`` of ``d`` with the text replaced where it changed, and its length with it."""
    changed = ~F.col(text_col).eqNullSafe(new)
    out = []
    for c in columns:
        if c == text_col:
            out.append(F.when(changed, new).otherwise(F.col(c)).alias(c))
        elif c == length_col:
            out.append(F.when(changed, F.length(new).cast("long")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return d.select(*out)

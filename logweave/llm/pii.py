"""Format-preserving pseudonyms for personal data (operator 7), as DataFrame expressions.

Candidates are found by one regular expression and validated: card numbers by their
Luhn digit, addresses by their octets, dates by the calendar, telephone numbers,
electronic mail addresses and quoted hexadecimal secrets by their form.  What fails
validation stays as it is.  A valid value goes through a keyed Feistel network over
its own domain, so it stays of its format and validity, different values stay
different, and equal values get equal pseudonyms in every document:

* card: all digits but the last are permuted, the Luhn digit is computed anew; in a run
  of digit groups the usual layouts are tried from the left, then the run as a whole, and
  the permutation is repeated (so the pseudonym is then another one) where the new digits
  and those beside them would be read as other cards;
* telephone: the ten national digits; the country code stays;
* address: the 32-bit number, two halves of 16 bits;
* date: the day within its hundred years from a year ending in 50, a domain of
  75 x 487 or 92 x 397 days, the two factors being the halves;
* mail: letters and digits of the local part, and of the domain before its last label;
* secret: digits among digits, letters a to f among these.

Separators and layout stay in place, so a number links across its layouts.  Rounds
alternate: one half is shifted by a keyed SHA-512 of the other.  ``reveal`` with the
same key turns pseudonyms back.

Defined cases: a null text stays null; empty texts and texts without candidates are
unchanged; very long texts are scanned whole; equal rows get equal results; all
columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import free_name, let
from logweave.llm.quality import with_text

ROUNDS = 8
DEMO_KEY = "set a key of your own"

MAIL = r"[\p{L}\p{N}._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
ADDRESS = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!(?!T\d)[\w/-]|\.\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
CARD = r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w)"
SECRET = r"(?<=[=:] ?[\"'])[0-9A-Fa-f]{32,64}(?=[\"'])"
#: Groups of digits up to where a value of another kind starts; all cards within are looked for.
RUN = rf"(?<![\w+])(?=\d(?:[ -]?\d){{12}})\d{{1,19}}+(?!\w)(?:[ -](?!{MAIL}|{ADDRESS}|{DATE}|{PHONE})\d{{1,19}}+(?!\w))*+"
#: Groups of usual cards, which are told from the numbers next to them.
LAYOUTS = [r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{4,5}", r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}", r"\d{8}[ -]\d{8}"]
LAYOUT_GROUPS = 5
WALKS = 64
ANY = "|".join([MAIL, SECRET, ADDRESS, DATE, PHONE, RUN])
#: Every candidate holds a digit or an at sign.
HINT = r"[0-9@]"


def keyed(key: str, kind: str, rnd: Column, half: Column) -> Column:
    """Hexadecimal round value of the other half."""
    return F.sha2(F.concat(F.lit(f"{key}\x1f{kind}\x1f"), rnd.cast("string"), F.lit("\x1f"), half), 512)


def hex_number(h: Column, at, size: int) -> Column:
    return F.conv(F.substring(h, at, size), 16, 10).cast("long")


def rounds(back: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))


def permuted_number(x: Column, a: int | Column, b: int | Column, key: str, kind: str, back: bool) -> Column:
    """Feistel over 0 to a*b - 1, the halves being quotient and remainder by b."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (a, b))
    sign = -1 if back else 1

    def turn(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        shift = hex_number(keyed(key, kind, r, F.when(odd, s["r"]).otherwise(s["q"]).cast("string")), F.lit(1), 12)
        return F.struct(F.when(odd, F.pmod(s["q"] + sign * shift, a)).otherwise(s["q"]).alias("q"),
                        F.when(odd, s["r"]).otherwise(F.pmod(s["r"] + sign * shift, b)).alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("q"), F.pmod(x, b).cast("long").alias("r"))
    return F.aggregate(rounds(back), start, turn, lambda s: s["q"] * b + s["r"])


def shifted(c: Column, by: Column, hexadecimal: bool) -> Column:
    """A digit or ASCII letter moved within its kind; any other character stays."""
    code = F.ascii(c)
    letters = 6 if hexadecimal else 26
    move = lambda low, n: F.char((F.pmod(code - low + by, F.lit(n)) + low).cast("int"))
    return (F.when(code.between(48, 57), move(48, 10)).when(code.between(97, 96 + letters), move(97, letters))
            .when(code.between(65, 64 + letters), move(65, letters)).otherwise(c))


def permuted_text(text: Column, key: str, kind: str, back: bool, hexadecimal: bool = False) -> Column:
    """Feistel over strings of one layout: each digit and letter stays of its kind, in place."""
    sign = -1 if back else 1

    def moved(chars: Column, h: Column) -> Column:
        return F.transform(chars, lambda c, j: shifted(c, sign * hex_number(h, j % 32 * 4 + 1, 4), hexadecimal))

    def turn(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        h = keyed(key, kind, r, F.array_join(F.when(odd, s["b"]).otherwise(s["a"]), ""))
        return let(h, lambda v: F.struct(F.when(odd, moved(s["a"], v)).otherwise(s["a"]).alias("a"),
                                         F.when(odd, s["b"]).otherwise(moved(s["b"], v)).alias("b")))

    chars = F.filter(F.split(text, "", -1), lambda c: c != "")
    start = let(chars, lambda c: let(F.floor(F.size(c) / 2).cast("int"), lambda n: F.struct(
        F.slice(c, F.lit(1), n).alias("a"), F.slice(c, n + 1, F.size(c)).alias("b"))))
    return F.aggregate(rounds(back), start, turn, lambda s: F.concat(F.array_join(s["a"], ""), F.array_join(s["b"], "")))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def laid_out(layout: Column, numbers: Column, skip: Column | int = 0) -> Column:
    """``layout`` with its digits after the first ``skip`` replaced by ``numbers`` in order."""
    def place(c: Column, i: Column) -> Column:
        nth = F.length(digits(F.substring(layout, F.lit(1), i + 1))) - skip
        return F.when(c.between("0", "9") & (nth > 0), F.substring(numbers, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(layout, "", -1), lambda c: c != ""), place), "")


def luhn_sum(d: Column, first_doubled: bool) -> Column:
    """Luhn sum of a digit string from its right end."""
    values = F.transform(F.filter(F.split(F.reverse(d), "", -1), lambda c: c != ""), lambda c, j: let(
        c.cast("int") * F.when(j % 2 == (0 if first_doubled else 1), 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda n, v: n + v)


def is_card(c: Column) -> Column:
    return luhn_sum(digits(c), False) % 10 == 0


def card_parts(run: Column) -> Column:
    """The run in parts (s, card): cards of a usual layout from the left, else what CARD finds."""
    def part(s: Column, card) -> Column:
        return F.struct(s.alias("s"), (card if isinstance(card, Column) else F.lit(card)).alias("card"))

    def usual(groups: Column) -> Column:
        def at(i: Column) -> Column:
            rest = F.array_join(F.slice(groups, i + 1, F.lit(LAYOUT_GROUPS)), "")
            found = [F.regexp_extract(rest, rf"^[ -]?({p})(?!\w)", 1) for p in LAYOUTS]
            return F.coalesce(*[let(c, lambda v: F.when((v != "") & is_card(v), v)) for c in found])

        def step(s: Column, i: Column) -> Column:
            group = F.element_at(groups, i + 1)
            plain = F.struct(F.concat(s["parts"], F.array(part(group, False))).alias("parts"), F.lit(0).alias("skip"))
            card = lambda c: F.struct(
                F.concat(s["parts"], F.array(part(F.regexp_extract(group, "^[ -]?", 0), False), part(c, True))).alias("parts"),
                (F.size(F.split(c, "[ -]")) - 1).alias("skip"))
            return F.when(s["skip"] > 0, F.struct(s["parts"].alias("parts"), (s["skip"] - 1).alias("skip"))).otherwise(
                let(at(i), lambda c: F.when(c.isNull(), plain).otherwise(card(c))))

        none = F.array().cast("array<struct<s:string,card:boolean>>")
        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), F.struct(none.alias("parts"), F.lit(0).alias("skip")), step, lambda s: s["parts"])

    def other(found: Column) -> Column:
        return F.flatten(F.zip_with(F.split(run, CARD, -1), found, lambda p, c: F.array(
            part(p, False), part(F.coalesce(c, F.lit("")), F.coalesce(is_card(c), F.lit(False))))))

    return let(let(F.split(run, "(?=[ -])", -1), usual), lambda parts: F.when(F.exists(parts, lambda p: p["card"]), parts).otherwise(
        let(F.regexp_extract_all(run, F.lit(CARD), F.lit(0)), other)))


def new_card(run: Column, key: str, back: bool) -> Column:
    """The run with its cards renumbered; again where the new digits would be read in other parts."""
    def renumber(m: Column) -> Column:
        def full(d: Column) -> Column:
            body = permuted_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", back)
            return let(body, lambda p: F.concat(p, F.pmod(F.lit(10) - luhn_sum(p, True) % 10, F.lit(10)).cast("string")))

        return laid_out(m, let(digits(m), full))

    def shape(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(F.length(p["s"]), p["card"]))

    def walk(parts: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            new = F.transform(s["parts"], lambda p: F.struct(F.when(p["card"], renumber(p["s"])).otherwise(p["s"]).alias("s"), p["card"].alias("card")))
            return F.when(s["done"], s).otherwise(let(new, lambda n: F.struct(
                n.alias("parts"), (shape(card_parts(F.array_join(n["s"], ""))) == shape(parts)).alias("done"))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.struct(parts.alias("parts"), F.lit(False).alias("done")), step,
                           lambda s: F.array_join(s["parts"]["s"], ""))

    return let(card_parts(run), lambda parts: F.when(F.exists(parts, lambda p: p["card"]), walk(parts)).otherwise(run))


def new_phone(m: Column, key: str, back: bool) -> Column:
    return let(digits(m), lambda d: laid_out(m, permuted_text(F.substring(d, F.length(d) - 9, F.lit(10)), key, "phone", back), F.length(d) - 10))


def new_address(m: Column, key: str, back: bool) -> Column:
    def renumber(octets: Column) -> Column:
        valid = F.forall(octets, lambda o: (o <= 255))
        x = F.aggregate(octets, F.lit(0).cast("long"), lambda n, o: n * 256 + o)
        new = let(permuted_number(x, 1 << 16, 1 << 16, key, "address", back), lambda y: F.concat_ws(
            ".", *[F.shiftright(y, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]))
        return F.when(valid, new).otherwise(m)

    return let(F.transform(F.split(m, r"\."), lambda o: o.cast("long")), renumber)


def new_date(m: Column, key: str, back: bool) -> Column:
    layouts = [(r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "dd/MM/yyyy")]
    def moved(day: Column, pattern: str) -> Column:
        low = (F.floor((F.year(day) - 50) / 100) * 100 + 50).cast("int")
        first, after = F.make_date(low, F.lit(1), F.lit(1)), F.make_date(low + 100, F.lit(1), F.lit(1))
        leap = F.date_diff(after, first) == 36525  # the century year within has a 29 February
        a, b = F.when(leap, 75).otherwise(92).cast("long"), F.when(leap, 487).otherwise(397).cast("long")
        new = permuted_number(F.date_diff(day, first).cast("long"), a, b, key, "date", back)
        return F.date_format(F.date_add(first, new.cast("int")), pattern)

    def in_layout(pattern: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(pattern)).cast("date")
        return let(day, lambda d: F.when(F.year(d).between(1050, 2949), moved(d, pattern)).otherwise(m))

    out = m
    for form, pattern in layouts:
        out = F.when(m.rlike(form), in_layout(pattern)).otherwise(out)
    return out


def new_mail(m: Column, key: str, back: bool) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    last = F.substring_index(domain, ".", -1)
    site = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    return F.concat(permuted_text(local, key, "mail", back), F.lit("@"), permuted_text(site, key, "site", back), F.lit("."), last)


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one candidate; the candidate itself if it is not valid."""
    full = lambda p: m.rlike(f"^(?:{p})$")
    return (F.when(m.contains("@"), new_mail(m, key, back))
            .when(full("[0-9A-Fa-f]{32,64}"), permuted_text(m, key, "secret", back, hexadecimal=True))
            .when(full(ADDRESS), new_address(m, key, back)).when(full(DATE), new_date(m, key, back))
            .when(full(PHONE), new_phone(m, key, back)).otherwise(new_card(m, key, back)))


def replaced(text: Column, key: str, back: bool = False) -> Column:
    """Struct of the text with pseudonyms and the number of values that changed."""
    def join(found: Column) -> Column:
        new = F.transform(found, lambda m: pseudonym(m, key, back))
        return let(new, lambda n: F.struct(
            F.array_join(F.zip_with(F.split(text, ANY, -1), n, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "").alias("text"),
            F.size(F.filter(F.zip_with(found, n, lambda x, y: x != y), lambda c: c)).cast("long").alias("n")))

    plain = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    return F.when(text.rlike(HINT), let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)),
                                        lambda f: F.when(F.size(f) > 0, join(f)).otherwise(plain))).otherwise(plain)


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``df``, valid personal data in the text replaced by pseudonyms."""
    r = free_name(df.columns, "_replaced")
    return with_text(df.withColumn(r, replaced(F.col(text_col), key)), df.columns, text_col, F.col(r)["text"], length_col)


def reveal(df: DataFrame, key: str, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Turns the pseudonyms that ``pseudonymise`` made with this key back."""
    r = free_name(df.columns, "_replaced")
    return with_text(df.withColumn(r, replaced(F.col(text_col), key, back=True)), df.columns, text_col, F.col(r)["text"], length_col)


def pseudonym_report(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text with pseudonyms, n_replaced) of every document."""
    d = df.select(F.col(id_col).alias("id"), replaced(F.col(text_col).cast("string"), key).alias("r"))
    return d.select(F.col("id").alias(id_col), F.col("r")["text"].alias("text"), F.col("r")["n"].alias("n_replaced"))

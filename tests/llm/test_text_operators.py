"""Fingerprints, quality, shards, joins, chat, pseudonyms and lines against brute force."""

import hashlib
import re
import uuid
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from reference import base_counts, components, edited, luhn, shingles, without_frequent_lines

from conftest import SF_SMALL
from rows import edge_docs, edge_rows, no_docs, small_rows  # noqa: F401
from logweave.llm import ngramjoin
from logweave.llm.chat import TEMPLATE, final_state, format_conversations, read_loss, read_turns
from logweave.llm.fingerprint import digest, fingerprint_likeness, fingerprints, likeness, with_edits
from logweave.llm.linedup import drop_frequent_lines, line_shares, url_host
from logweave.llm.ngramjoin import jaccard_components, one_of_each
from logweave.llm.pii import permuted_number, permuted_text, pseudonym_report, pseudonymise, reveal
from logweave.llm.quality import assess, keep_clean
from logweave.llm.queries import LLM_QUERIES
from logweave.llm.sharding import curve_shards, hilbert_index, quantised, write_shards

KEY = "test key"


# ---------------------------------------------------------------- 1

def test_digest_properties():
    text = " ".join(f"token{i * i % 1013}" for i in range(3000))
    assert digest(text) == digest(text) and likeness(digest(text), digest(text)) == 1.0
    near = text.replace("token4 ", "other ")
    far = " ".join(f"{i * 7919 % 10007:x}" for i in range(3000))
    assert 1 > likeness(digest(text), digest(near)) > 0.8 > likeness(digest(text), digest(far)) >= 0
    assert digest(None) == digest("") and likeness(digest(""), digest("ab")) > 0.9


def test_edits_edge_rows(spark, edge_docs, edge_rows, no_docs):
    got = with_edits(edge_docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edited([r[:2] for r in edge_rows])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert with_edits(no_docs).collect() == []
    marks = fingerprints(edge_docs)
    assert Counter((r.doc_id, r.fingerprint) for r in marks.collect()) == Counter((i, digest(t)) for i, t, _ in edge_rows)
    same = fingerprint_likeness(marks.withColumn("again", F.col("fingerprint")), "fingerprint", "again")
    assert {r.likeness for r in same.collect()} == {1.0}


def test_op1_query(spark, small_rows):
    got = LLM_QUERIES["op1_fingerprints"](spark, SF_SMALL).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edited([r[:2] for r in small_rows])
    text = dict(r[:2] for r in small_rows)
    assert all(r.fingerprint == digest(text[r.doc_id]) for r in got)
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)


# ---------------------------------------------------------------- 3

def test_quality_edge_rows(edge_docs, edge_rows, no_docs):
    got = Counter(tuple(r)[:7] for r in assess(edge_docs).collect())
    assert got == Counter((i, *base_counts(t)) for i, t, _ in edge_rows)
    kept = keep_clean(edge_docs)
    assert kept.columns == edge_docs.columns and assess(no_docs).collect() == [] and keep_clean(no_docs).collect() == []
    assert all(r.n_chars == len(r.text) for r in kept.collect())


def test_repeated_windows(spark):
    a, b = " ".join(f"a{i}" for i in range(8)), " ".join(f"b{i}" for i in range(30))
    texts = [f"{a} {b} {a}", f"{a} {a}", "x " * 40, f"{a} {b}", "y " * 8, "y " * 9, f"{a} z {a} a1 {a}", b + " " + b[3:]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in assess(d).collect()} == {i: base_counts(t)[4] for i, t in enumerate(texts)}


def test_lines_are_removed_first(spark):
    good = "\n".join(" ".join(f"word{i * i + k}of{k}" for i in range(12)) + "." for k in range(5))
    menu, note = "Home | About | News | Contact | Imprint | Login", "All rights reserved."
    d = spark.createDataFrame([(1, f"{menu}\n{good}\n{note}"), (2, "\n".join([" | ".join(f"item{i}x{k}" for k in range(6)) for i in range(9)] + ["One more sentence here."])),
                               (3, good), (4, " ".join("LOUD%d!!" % i for i in range(40)))], "doc_id long, text string")
    got = {r.doc_id: r for r in assess(d).collect()}
    assert got[1].kept and got[1].clean_text == good and got[1].n_removed_lines == 2
    assert not got[2].kept and not got[2].base_failed and got[3].kept and got[3].clean_text == good
    assert not got[4].kept and not got[4].base_failed
    assert {r.doc_id for r in keep_clean(d).collect()} == {1, 3}


# ---------------------------------------------------------------- 4

@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    n = 1 << dims * bits
    cells = [F.shiftright("id", k * bits).bitwiseAND((1 << bits) - 1).cast("int").alias(f"c{k}") for k in range(dims)]
    rows = spark.range(n).select(*cells).select("*", hilbert_index([F.col(f"c{k}") for k in range(dims)], bits).alias("h")).collect()
    rows.sort(key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(n))
    assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def check_shards(rows, shards):
    held = defaultdict(list)
    for r in rows:
        held[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    sizes = [len(held.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in order)


def test_shards_edge_rows(spark, edge_docs, no_docs, tmp_path):
    rows = curve_shards(edge_docs.drop("shard"), ["lang", "source", "n_chars"], 5, ["doc_id", "text"]).collect()
    check_shards(rows, 5)
    assert len(rows) == edge_docs.count() and curve_shards(no_docs.drop("shard"), ["source", "n_chars"], 5, ["doc_id"]).collect() == []
    few = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, source string")
    check_shards(curve_shards(few, ["source"], 5, ["doc_id"]).collect(), 5)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    write_shards(docs, str(tmp_path / "s"), ["lang", "n_chars"], 4, "doc_id")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4
    spans = back.groupBy("shard").agg((F.max("n_chars") - F.min("n_chars")).alias("w"), F.count_distinct("lang").alias("k")).collect()
    assert min(r.k for r in spans) < docs.select("lang").distinct().count()  # a reader by language prunes files


def test_text_cells_follow_whole_values(spark):
    """Values with a long common start, one of them a third of all rows, nulls: cells keep the order of strings."""
    rows = [(f"https://site{k:02d}.example/a",) for k in range(50) for _ in range(4)] + [("https://site07.example/a",)] * 100 + [(None,)] * 5
    d = spark.createDataFrame(rows, "source string").repartition(3)
    got = {r.source: r.c for r in d.select("source", quantised(d, ["source"], 4)[0].alias("c")).distinct().collect()}
    total, below, exp = 300, 0, {}
    for v, n in sorted(Counter(r[0] for r in rows if r[0]).items()):
        exp[v] = below * 16 // total
        below += n
    assert got == {**exp, None: 0} and len(set(exp.values())) >= 8
    assert quantised(d.limit(0), ["source"], 4) is not None and d.limit(0).select(quantised(d.limit(0), ["source"], 4)[0]).collect() == []


def test_op4_query(spark, small_rows):
    rows = LLM_QUERIES["op4_hilbert_shards"](spark, SF_SMALL).collect()
    check_shards(rows, 16)
    text = {i: (t or "").encode() for i, t, _ in small_rows}
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "rows", None) for r in rows)
    assert len(rows) == len(text)


# ---------------------------------------------------------------- 5

@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (2, 40)])
def test_components_edge_rows(edge_docs, edge_rows, no_docs, n, percent):
    got = Counter(tuple(r) for r in jaccard_components(edge_docs, n, percent).collect())
    assert got == components([r[:2] for r in edge_rows], n, percent)


def test_components_of_nothing(no_docs):
    assert jaccard_components(no_docs, 3, 90).collect() == []
    assert one_of_each(no_docs, 3, 90).collect() == []


def test_chains_and_hot_lists(spark):
    """A chain of near copies, and a passage that many unlinked documents share."""
    chain = [(k, " ".join([f"u{i}" for i in range(k * 2)] + [f"w{i}" for i in range(k * 2, 200)])) for k in range(12)]
    passage = " ".join(f"p{i}" for i in range(30))
    shared = [(100 + k, f"{passage} " + " ".join(f"q{k}x{i}" for i in range(5 + k % 7))) for k in range(60)]
    rows = chain + shared
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (60, 80, 90, 97):
        assert Counter(tuple(r) for r in jaccard_components(d, 3, percent).collect()) == components(rows, 3, percent)


def test_sets_are_let_go(spark, edge_docs, edge_rows, tmp_path, monkeypatch):
    """The tables of prefixes and sets are gone when the components are there, and these can still be read."""
    monkeypatch.setattr(ngramjoin, "shared_folder", lambda _, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    made, features = [], ngramjoin.features
    monkeypatch.setattr(ngramjoin, "features", lambda *a, **k: made.append(1) or features(*a, **k))
    out = jaccard_components(edge_docs, 3, 90)
    assert made and list(tmp_path.iterdir()) == []
    assert Counter(tuple(r) for r in out.collect()) == components([r[:2] for r in edge_rows], 3, 90)


def test_words_are_hashed_alike_across_blocks(monkeypatch):
    text = "The QUICK brown\tfox \x1c jumps over é " * 300 + "x" * 5000 + " end"
    whole = ngramjoin.Hasher().shingles(text, 3)
    assert len(whole) == len(shingles(text, 3))
    monkeypatch.setattr(ngramjoin, "TEXT_BLOCK", 6000)
    assert (ngramjoin.Hasher().shingles(text, 3) == whole).all()


def test_op5_query(spark, small_rows):
    got = Counter(tuple(r) for r in LLM_QUERIES["op5_ngram_jaccard"](spark, SF_SMALL).collect())
    assert got == components([r[:2] for r in small_rows], 3, 90)


# ---------------------------------------------------------------- 6

def turns_of(rows):
    held = defaultdict(list)
    for c, t, r, x in rows:
        held[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in held.items()}


def test_chat_edge_rows(spark):
    odd = ["\\", "\\\\</turn>", "### User: x", "</turn>\n### Assistant: y", "</tur", "#### ", "", None, "é\n\n", "a: b", "$1 \\n"]
    roles = ["user", "assistant", "system", "tool: x", None, "=x", "User", "</turn>", "\\### "]
    rows = [(c, t, roles[(c + t) % len(roles)], odd[(c * 3 + t) % len(odd)]) for c in range(30) for t in range(5)]
    rows += [(50, 0, "user", "a"), (50, 0, "user", "a"), (None, 1, "user", "n"), (60, None, "user", "z")]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, segments int, id string")
    out = format_conversations(d)
    got = {r.conv_id: r for r in out.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"),
                                            "formatted", "segments").collect()}
    for c, turns in turns_of(rows).items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert got[c].formatted == "".join(s.text for s in got[c].segments)
    assert format_conversations(d.limit(0)).collect() == []


def test_machine(spark):
    cases = {"user assistant": "assistant", "system user assistant user": "user", "assistant": "rejected", "user user": "rejected", "": "start",
             "user assistant system": "rejected"}
    d = spark.createDataFrame([(k,) for k in cases], "s string").withColumn("r", F.filter(F.split("s", " "), lambda x: x != ""))
    assert {r.s: r.f for r in d.select("s", final_state(F.col("r")).alias("f")).collect()} == cases
    assert TEMPLATE["accepting"] == ["assistant"]


def test_op6_query(spark):
    probe = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    got = {r.conv_id: r for r in LLM_QUERIES["op6_chat_format"](spark, SF_SMALL).collect()}
    turns = turns_of(rows)
    assert set(got) == set(turns)
    for c, t in turns.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert got[c].n_turns == len(t) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()


# ---------------------------------------------------------------- 7

def feistel(text, key, kind):
    """The text permutation, written again in plain Python."""
    half = len(text) // 2
    a, b = list(text[:half]), list(text[half:])

    def moved(chars, other, rnd):
        h = hashlib.sha512(f"{key}\x1f{kind}\x1f{rnd}\x1f{''.join(other)}".encode()).hexdigest()
        out = []
        for j, c in enumerate(chars):
            by = int(h[j % 32 * 4:j % 32 * 4 + 4], 16)
            for low, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(low) <= ord(c) < ord(low) + n:
                    c = chr((ord(c) - ord(low) + by) % n + ord(low))
                    break
            out.append(c)
        return out

    for rnd in range(1, 9):
        if rnd % 2:
            a = moved(a, b, rnd)
        else:
            b = moved(b, a, rnd)
    return "".join(a + b)


def test_permutations(spark):
    x = spark.range(92 * 397).select(permuted_number(F.col("id"), 92, 397, KEY, "k", False).alias("y"))
    assert x.agg(F.count_distinct("y"), F.min("y"), F.max("y")).first() == (92 * 397, 0, 92 * 397 - 1)
    words = ["", "a", "Zz9", "jane.doe-77", "ünïcode5", "x" * 90]
    d = spark.createDataFrame([(w,) for w in words], "w string").withColumn("p", permuted_text(F.col("w"), KEY, "mail", False))
    got = d.select("w", "p", permuted_text(F.col("p"), KEY, "mail", True).alias("b")).collect()
    assert all(r.p == feistel(r.w, KEY, "mail") and r.b == r.w for r in got)


def test_pseudonyms(spark):
    text = ("card 4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111; not 4111111111111112 or 41111111111111119999999. "
            "mail jane.doe7@mail.example.org. call +1 (743) 555-3824 or (743) 555-3824 at 10.0.0.255 not 999.1.1.1 nor 1.2.3.4.5; "
            "on 2023-02-28, 28.02.2023, 1899/12/31 but 2023-02-30. key = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\".")
    d = spark.createDataFrame([(1, text, 0), (2, text, 0), (3, None, 0), (4, "", 0), (5, "nothing here", 0)], "doc_id long, text string, n_chars long")
    out = pseudonymise(d, KEY)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == got[2] and got[3] is None and got[4] == "" and got[5] == "nothing here"
    new = got[1]
    cards = re.findall(r"card ([\d ]+), ([\d-]+) and (\d+);", new)[0]
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and luhn(cards[2]) and cards[2] != "4111111111111111"
    assert cards[2][:-1] == feistel("411111111111111", KEY, "card")
    for same in ("4111111111111112", "41111111111111119999999", "999.1.1.1", "1.2.3.4.5", "2023-02-30"):
        assert same in new
    for gone in ("jane.doe7", "555-3824", "10.0.0.255", "2023-02-28", "28.02.2023", "1899/12/31", "04dbebab91"):
        assert gone not in new
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}", new)
    assert len(phones) == 2 and phones[0] == phones[1] and "+1 (" in new
    iso, dotted = re.findall(r"on (\d{4}-\d\d-\d\d), (\d\d\.\d\d\.\d{4}),", new)[0]
    assert iso.split("-") == dotted.split(".")[::-1] and 1950 <= int(iso[:4]) <= 2050
    assert {r.doc_id: r.text for r in reveal(out, KEY).collect()} == {1: text, 2: text, 3: None, 4: "", 5: "nothing here"}
    assert pseudonymise(d, "another").first().text != new


def test_values_next_to_each_other(spark):
    card = "4111 1111 1111 1111"

    def mask(m):
        body = feistel(re.sub(r"\D", "", m)[:-1], KEY, "card")
        left = iter(body + next(c for c in "0123456789" if luhn(body + c)))
        return "".join(next(left) if c.isdigit() else c for c in m)

    around = ["{} 123", "{} 12/27", "{} 2 times", "7 {}", "{}-12-27", "12 {} 345 6", "{} 2027 {}", "1 2 3 4 5 6 7 8 9 {} 10 11 12 13", "{}, {}"]
    texts = [a.replace("{}", c) for a in around for c in (card, card.replace(" ", "-"), "3782 822463 10005", card.replace(" ", ""))]
    beside = [(f"{card} 555-123-4567", "555-123"), (f"{card} 97.51.17.173", "97.51.17.173"), (f"{card} 2023-02-28", "2023-02-28"), (f"{card} 12@b.org", "12@b"),
              (f"at 2023-02-28T10:11:12Z {card}", "2023-02-28"), ("2023-02-28T10:11", "2023-02-28"), (f"(743) 555-3824 {card} 10.0.0.255", "555-3824")]
    exact = [("2024 " * k + f"{card} 123 {k}{k}") for k in range(1, 6)] + [f"{1000 + k} 5500 0055 5555 5559 {100 + k}" for k in range(40)]
    kept = ["4111 1111 1111 1112 123", "2023-02-28Tx", " ".join(["12"] * 3000), "1" * 3000, "1" * 32, "4111111111111111x 12"]
    rows = texts + [t for t, _ in beside] + exact + kept
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8)
    out = pseudonymise(d, KEY, length_col=None).cache()
    got = {r.doc_id: r.text for r in out.collect()}
    assert {r.doc_id: r.text for r in reveal(out, KEY, length_col=None).collect()} == dict(enumerate(rows))
    for k, t in enumerate(rows[:-len(kept)]):
        assert card not in got[k] and "5500 0055 5555 5559" not in got[k] and got[k] != t
    plain = {c: mask(c) for c in (card, card.replace(" ", "-"), "3782 822463 10005", card.replace(" ", ""))}
    same = sum(got[k] == next(t.replace(c, m) for c, m in plain.items() if c in t) for k, t in enumerate(texts))
    assert same >= len(texts) - 4  # beside few numbers the permutation is repeated
    for k, (_, value) in enumerate(beside, len(texts)):
        assert value not in got[k] and (mask(card) in got[k]) == (card in rows[k])
    assert [got[k] for k in range(len(rows) - len(kept), len(rows))] == kept


def test_pseudonyms_edge_rows(edge_docs, no_docs):
    out = pseudonymise(edge_docs, KEY)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count() and pseudonymise(no_docs, KEY).collect() == []
    assert pseudonym_report(no_docs, KEY).collect() == []


def test_op7_query(spark, small_rows):
    got = {r.doc_id: r for r in LLM_QUERIES["op7_pii_pseudonyms"](spark, SF_SMALL).collect()}
    mail = re.compile(r"[A-Za-z0-9.]+@[a-z0-9]+\.example\.com")
    card = re.compile(r"(?<![\w+])\d{16}(?!\w)")
    for i, text, _ in small_rows:
        assert not set(mail.findall(text)) & set(mail.findall(got[i].text))
        old, new = card.findall(text), card.findall(got[i].text)
        assert [luhn(c) for c in old] == [luhn(c) for c in new] and all((a == b) != luhn(a) for a, b in zip(old, new, strict=True))
        if not re.search("[0-9@]", text):
            assert got[i].text == text and got[i].n_replaced == 0


# ---------------------------------------------------------------- 9

def test_lines_edge_rows(edge_docs, edge_rows, no_docs):
    got = Counter(tuple(r) for r in line_shares(edge_docs, F.col("source")).collect())
    assert got == without_frequent_lines([(i, s, t) for i, t, s in edge_rows], 0.1, 5)
    assert sum(n for (_, _, _, dropped), n in got.items() if dropped) == 8
    out = drop_frequent_lines(edge_docs, F.col("source"))
    assert out.columns == edge_docs.columns and out.count() == len(edge_rows)
    assert drop_frequent_lines(no_docs, F.col("source")).collect() == []


def test_copies_are_one_page(spark):
    rows = [(k, "a", "one line\nand another") for k in range(50)] + [(60 + k, "a", f"page {k}\nmenu") for k in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in line_shares(d, F.col("source")).collect()}
    assert got[0] == "one line\nand another" and got[60] == "page 0"


def test_hosts(spark):
    urls = {"http://A.example.com/x?y": "a.example.com", "https://u:p@b.org:80#t": "b.org", "ftp://c": "c", "nothing": None, None: None}
    d = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.h for r in d.select("url", url_host(F.col("url")).alias("h")).collect()} == urls


def test_op9_query(spark, small_rows):
    got = Counter(tuple(r) for r in LLM_QUERIES["op9_line_dedup"](spark, SF_SMALL).collect())
    assert got == without_frequent_lines([(i, s, t) for i, t, s in small_rows], 0.1, 5)

"""Brute-force versions of the operators, written from their descriptions in plain Python."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

SPACE = b" \t\n\r\x0b\x0c"


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def pieces(rows, encode, capacity):
    """Counter of (id, piece, start, length, crc)."""
    out = Counter()
    for i, text in rows:
        ids = encode(text or "") + [0]
        n = -(-len(ids) // capacity)
        at = 0
        for k in range(n):
            size = capacity if k else len(ids) - (n - 1) * capacity
            out[i, k, at, size, crc(ids[at:at + size])] += 1
            at += size
    return out


def check_packing(rows, capacity):
    """rows (length, sequence, offset): gapless and within capacity; returns the number of sequences."""
    held = defaultdict(list)
    for length, sequence, offset in rows:
        held[sequence].append((offset, length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1)))


def components(rows, n, percent):
    """Counter of (id, set size, least id reachable); rows of one id are told apart by place."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for k in s for j in at[k])
        for j, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
        for k in s:
            at[k].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return Counter((d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def edited(rows):
    """(id, n_chars, sha256 of the edited text) in ascending (id, text) order, null ids first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, text) in enumerate(rows):
        x, y = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(x) // 2
        out.append((i, len(x), hashlib.sha256((x[:len(x) - half] + y[:half]).encode()).hexdigest()))
    return Counter(out)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    w = words(text)
    windows = defaultdict(list)
    for k in range(len(w) - 7):
        windows[tuple(w[k:k + 8])].append(k)
    covered = {p for at in windows.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    lines = [s for s in (text or "").split("\n") if words(s)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def without_frequent_lines(rows, ratio, least):
    """rows (id, host, text) → Counter of (id, cleaned text, lines, dropped)."""
    strip = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", s)
    pages, total = defaultdict(set), defaultdict(set)
    for _, host, text in rows:
        if text is not None:
            total[host].add(text)
            for s in text.split("\n"):
                pages[host, strip(s)].add(text)
    bad = {k for k, p in pages.items() if k[1] and len(p) >= least and len(p) >= ratio * len(total[k[0]])}
    out = Counter()
    for i, host, text in rows:
        if text is None:
            out[i, None, 0, 0] += 1
            continue
        lines = text.split("\n")
        kept = [s for s in lines if (host, strip(s)) not in bad]
        out[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def periodic_tail(doc_id, w):
    """The words with the end that the query plants by the hash of the id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def all_runs(w, min_length=6, min_exponent=4):
    """(start, length, period) of every maximal run, by comparing all words q apart for each q."""
    n, out = len(w), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_exponent * q):
                smaller = any(all(w[k] == w[k + r] for k in range(i, i + length - r)) for r in range(1, q))
                if not smaller:
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_report(doc_id, text):
    """The row of the query on periodic runs."""
    from fractions import Fraction

    w = periodic_tail(doc_id, words(text))
    runs = all_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def majority_bits(text, n=3):
    import xxhash

    w = (text or "").encode().lower().split()
    spans = [b" ".join(w[k:k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints, bits=2):
    """prints: (id, fingerprint) → Counter of (id, hex, least id reachable)."""
    known = sorted({f for _, f in prints})
    parent = {f: f for f in known}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in enumerate(known):
        for g in known[i + 1:]:
            if (f ^ g).bit_count() <= bits:
                parent[root(f)] = root(g)
    least = {}
    for d, f in prints:
        r = root(f)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return Counter((d, f"{f:016x}", least[root(f)]) for d, f in prints)

"""Plain Python versions of the operators, one row at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = words(fold(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def similar(a, b, percent=80):
    both = len(a & b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def smallest_reachable(keys, links):
    """key -> smallest key of its component."""
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def near_components(sets, percent=80):
    """id -> smallest reachable id, comparing sets that share a shingle."""
    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    common = Counter()
    for ids in at.values():
        for x, a in enumerate(ids):
            for b in ids[x + 1:]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return smallest_reachable(sets, links)


def tokens(text):
    out = []
    for run in words(text):
        if len(run) <= 16:
            out.append(run)
            continue
        part = ""
        for c in run:
            if c > "~" or c < "!":
                out += [part] * bool(part) + [c]
                part = ""
                continue
            if len(part) == 8:
                out.append(part)
                part = ""
            # a vowel or digit ends a stretch of at most seven others
            if c in "aeiou0123456789":
                out += [part + c] if len(part) < 8 else [part, c]
                part = ""
            else:
                part += c
        out += [part] * bool(part)
    return out


PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 1_664_525_013)


def winnow(text, k=4, window=8):
    """[(hash, position)], rolling the two halves of the hash along and looking at every window."""
    h = []
    for t in tokens(text):
        x = xxhash.xxh64(t.encode(), seed=42).intdigest()
        h.append(x - (1 << 64) if x >> 63 else x)
    if not h:
        return []
    k = min(k, len(h))
    halves = []
    for base, part in zip(BASES, ([x % PRIME for x in h], [(x >> 32) % PRIME for x in h])):
        rolling = 0
        for x in part[:k]:
            rolling = (rolling * base + x) % PRIME
        found, lead = [rolling], pow(base, k - 1, PRIME)
        for gone, new in zip(part, part[k:]):
            rolling = ((rolling - gone * lead) * base + new) % PRIME
            found.append(rolling)
        halves.append(found)
    grams = [(b << 31) + a for a, b in zip(*halves)]
    spots = set()
    for i in range(max(1, len(grams) - window + 1)):
        part = grams[i:i + window]
        spots.add(i + max(j for j, g in enumerate(part) if g == min(part)))
    return [(grams[i], i) for i in sorted(spots)]


def likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def quality_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(lines)


def value_class(v):
    cut = max(len(bin(v)) - 2 - 6, 0)
    return v >> cut << cut


def kept_by_quality(rows):
    """Indices of kept rows of [(text, lang, source)]."""
    counts = [quality_counts(t) for t, _, _ in rows]
    passed = [c[0] >= 20 and 100 * c[4] <= 30 * c[0] for c in counts]
    measures = [(1000 * c[2] // c[0], 100 * c[1] // c[0], 1000 * c[3] // c[5]) if p else None for c, p in zip(counts, passed)]

    def quartiles(pick):
        return [[sorted(value_class(m[j]) for m in pick)[math.ceil(q * len(pick) / 4) - 1] for q in (1, 3)] for j in range(3)]

    kept, cache = [], {}
    for i, (_, lang, source) in enumerate(rows):
        if not passed[i]:
            continue
        if (lang, source) not in cache:
            for level in (lambda r: r[1:] == (lang, source), lambda r: r[1] == lang, lambda r: True):
                pick = [m for m, r in zip(measures, rows) if m and level(r)]
                if len(pick) >= 50:
                    break
            cache[lang, source] = quartiles(pick)
        q = cache[lang, source]
        high = [b + 3 * (b - a) + w for (a, b), w in zip(q, (100, 100, 400))]
        low = q[1][0] - 3 * (q[1][1] - q[1][0]) - 100
        if all(v <= h for v, h in zip(measures[i], high)) and measures[i][1] >= low:
            kept.append(i)
    return kept


def without_boilerplate(rows, ratio=0.05, least=5):
    """Texts of [(text, site)] without boilerplate lines."""
    pages, seen = Counter(s for _, s in rows), Counter()
    for text, site in rows:
        seen.update((site, x) for x in {x.strip(" ") for x in (text or "").split("\n")} if x)
    bad = {k for k, c in seen.items() if c >= least and c > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad) for t, s in rows]


def targets(sizes, weights=(5, 2, 1), percent=150, most=2):
    """source -> target, resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()) * percent / 100, {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def copies(rows, seed=11):
    """Copies of each of [(id, text, source)]."""
    size = [len(words(t)) for _, t, _ in rows]
    total = Counter()
    for n, (_, _, s) in zip(size, rows):
        total[s] += n
    goal, by = targets(total), defaultdict(list)
    for i, (_, _, s) in enumerate(rows):
        by[s].append(i)
    out = [0] * len(rows)
    for s, members in by.items():
        each = goal[s] / total[s] if total[s] else 0.0
        u = int(hashlib.md5(f"{seed}:{chr(0) if s is None else s}".encode()).hexdigest()[:8], 16) / 2 ** 32
        cut = lambda n: max(n.bit_length() - 4, 0)
        spread = lambda i: "" if i is None else hashlib.md5(str(i).encode()).hexdigest()[:2]
        members.sort(key=lambda i: (size[i] >> cut(size[i]) << cut(size[i]), spread(rows[i][0]), size[i], rows[i][0] is not None, rows[i][0] or 0))
        for r, i in enumerate(members, 1):
            out[i] = min(2, math.floor(each * r + u) - math.floor(each * (r - 1) + u))
    return out


def pieces(text, tokenizer, longest=4096, end_id=2):
    """(start, length, crc, doc_tokens) of a text's pieces."""
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
    out, at = [], 0
    while at < len(ids):
        n = min(longest, 1 << (len(ids) - at).bit_length() - 1)
        out.append((at, n, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at:at + n])), len(ids)))
        at += n
    return out

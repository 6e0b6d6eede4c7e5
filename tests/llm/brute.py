"""Plain restatements of the operators' results, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WHITE = " \t\n\x0b\x0c\r"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def line_dedup(rows, least=10):
    lines = [(t or "").split("\n") for _, t in rows]
    keys = [[lower(x.strip(WHITE)) for x in ls] for ls in lines]
    count = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, _), ls, ks in zip(rows, lines, keys):
        kept = [x for x, k in zip(ls, ks) if count[k] < least]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def shards(rows, n=16):
    def key(i, t):
        return hashlib.md5((t or "").encode()).hexdigest()[:16] + hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16]
    order = sorted(rows, key=lambda r: (key(*r), r[0] is not None, r[0] or 0))
    size = [len((t or "").encode()) + 1 for _, t in order]
    total, upto, slots, out = sum(size), 0, Counter(), []
    for (i, t), s in zip(order, size):
        upto += s
        shard = min(n - 1, (2 * upto - s) * n // (2 * total))
        out.append((i, s, zlib.crc32((t or "").encode()), shard, slots[shard]))
        slots[shard] += 1
    return out


def spans(text):
    text, out = text or "", []
    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for at, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            odd = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 9 <= len(d) <= 15
                    or kind == "card" and not (12 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in odd) % 10 == 0)):
                continue
            out.append((m.start(), at, m.end()))
    return sorted(out)


def contamination(rows, items, n=10):
    windows = {}
    for i, t in items:
        w = WORDS.findall(lower(t))
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = WORDS.findall(lower(t)), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def longest_match(doc, items):
    """Words and first place of the longest run of ``doc`` that some item has."""
    best = (0, None)
    for at in range(len(doc)):
        for item in items:
            for k in range(len(item)):
                size = 0
                while at + size < len(doc) and k + size < len(item) and doc[at + size] == item[k + size]:
                    size += 1
                best = (size, at) if size > best[0] else best
    return best


def base_scores(rows):
    tokens = [SPACED.findall(lower(t)) + [None] for _, t in rows]
    out_of = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for ws, held in zip(tokens, out_of) for w in ws if not held)
    n, v = sum(count.values()), len(count)
    return [(i, held, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
            for (i, _), held, ws in zip(rows, out_of, tokens)]


def suffix_tree_scores(rows, depth, least_count, end=256, base=257):
    """log10 probability of each text under the tree of the training texts, symbol by symbol."""
    texts = [[*" ".join(SPACED.findall(lower(t))).encode(), end] for _, t in rows]
    train = [t for t, (i, _) in zip(texts, rows) if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    nexts = {}
    for text in train:
        padded = [end] * depth + text
        for k in range(depth, len(padded)):
            for d in range(depth + 1):
                nexts.setdefault(tuple(padded[k - d : k]), Counter())[padded[k]] += 1
    total = sum(map(len, train))
    states = {()}
    for context, own in nexts.items():
        n, up = sum(own.values()), nexts[context[1:]] if context else None
        if context and n >= least_count(total):
            gain = sum(c * math.log(c / n / (up[s] / sum(up.values()))) for s, c in own.items())
            if gain > (len(own) - 1) * math.log(n) / 2:
                states |= {context[a:b] for a in range(len(context)) for b in range(a + 1, len(context) + 1)}

    def p(context, symbol):
        own = nexts.get(context, Counter())
        n = sum(own.values())
        if not context:
            return (own[symbol] + 1) / (n + base)
        return (own[symbol] + len(own) * p(context[1:], symbol)) / (n + len(own))

    out = []
    for text in texts:
        padded, score = [end] * depth + text, 0.0
        for k in range(depth, len(padded)):
            context = next(c for d in range(depth, -1, -1) if (c := tuple(padded[k - d : k])) in states)
            score += math.log10(p(context, padded[k]))
        out.append(score)
    return out


def fingerprint(text):
    import xxhash

    w = SPACED.findall(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[a : a + 3]).encode(), 42) for a in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    """Least reachable node by ``linked(a, b)``."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def best_fit_bins(lengths, capacity):
    import bisect

    room = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(room, n)
        bisect.insort(room, (room.pop(at) if at < len(room) else capacity) - n)
    return len(room)


def repeated_windows(rows, n=20):
    """(id, n_words, n_removed, kept) with first places by (id, start, text); null ids last; equal rows have equal places."""
    import xxhash

    docs = [((i is None, i or 0), SPACED.findall(t or ""), xxhash.xxh64_intdigest((t or "").encode(), 42)) for i, t in rows]
    signed = [(k, w, h - (1 << 64) if h >> 63 else h) for k, w, h in docs]
    first = {}
    for k, w, h in signed:
        for a in range(len(w) - n + 1):
            place, win = (*k, a, h), tuple(w[a : a + n])
            first[win] = min(first.get(win, place), place)
    out = []
    for (i, _), (k, w, h) in zip(rows, signed):
        gone = set()
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] != (*k, a, h):
                gone |= set(range(a, a + n))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def ranked(rows, items, k=20):
    """(item_id, rank, doc_id, score) for items that are already distinct."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, Counter(term.findall(lower(t)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total, df = len(docs), sum(d[2] for d in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(term.findall(lower(text))), []
        for i, c, length in docs:
            m = 75 + 25 * length * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, q in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def mined(rows, positives=5, negatives=3, low=50, high=95, scale=256):
    """(anchor, positive, rank, negative, scores) for (id, label, vector) rows; anchors are ids divisible by 50."""
    good = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in good if i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good if j != i and len(w) == len(v))
        for p, j, z in [x for x in s if x[2] == y][:positives]:
            found = [(n, m) for n, m, z in s if z != y and low * -p <= 100 * -n <= high * -p][:negatives]
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(found)]
    return out

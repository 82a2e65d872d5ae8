"""Brute-force versions of the corpus operators in plain Python."""

import math
import re
from collections import Counter

import regex

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns whose names the operators use inside.
CLASHING = "node string, digest string, item string, bucket long, label string, score double, words array<string>, h long, part int, _cutoffs string, _drop_lines string, cutoffs string, more string"


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def shingles(text, width=5):
    w = words(text)
    if not w:
        return Counter()
    n = min(width, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def contained(docs, items, pct=80):
    """{(doc_id, item_id): (shared, size)}; rows with one id are one document or item."""
    sets = {}
    for item, text in items:
        n = min(5, len(words(text)))
        if n:
            sets.setdefault(item, set()).update((n, s) for s in shingles(text, n))
    held = {}
    for doc, text in docs:
        w = words(text)
        held.setdefault(doc, set()).update((n, tuple(w[i:i + n])) for n in range(1, 6) for i in range(len(w) - n + 1))
    out = {}
    for doc, have in held.items():
        for item, need in sets.items():
            shared = len(need & have)
            if shared * 100 >= len(need) * pct:
                out[doc, item] = (shared, len(need))
    return out


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def classes(texts, threshold=0.8):
    """Class number of each distinct text (None counts as empty), by linking all similar pairs."""
    distinct = sorted({t or "" for t in texts})
    bags, root = [shingles(t) for t in distinct], list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(distinct)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= threshold:
                root[find(i)] = find(j)
    return {t: find(i) for i, t in enumerate(distinct)}


def without_boilerplate(rows, sites):
    """(doc_id, text, source) rows without lines on ``sites`` or more sources; the lowest id keeps them."""
    seen, first = {}, {}
    for doc, text, source in rows:
        for line in (text or "").split("\n"):
            if re.search(r"\S", line):
                seen.setdefault(line, set()).add(source)
                first.setdefault(line, []).append(doc)
    bad = {k: min((d for d in first[k] if d is not None), default=None) for k, s in seen.items() if len(s - {None}) >= sites}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad or bad[x] == d), s) for d, t, s in rows]


def base_failed(text):
    """Fewer than 20 words, or more than 30 % of them in 8-word windows that stand twice or more."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i:i + 8]), []).append(i)
    repeated = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w) < 20 or 100 * len(repeated) > 30 * len(w)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def luhn_completed(digits):
    return next(digits + str(c) for c in range(10) if luhn((digits + str(c)).replace(" ", "")))


def personal(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            value, digits = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def binomial_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)

    def fits(capacity):
        used, left = 1, capacity
        for s in sizes:
            if s > left:
                used, left = used + 1, capacity
            left -= s
        return used <= shards

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def first_fit_decreasing(lengths, capacity):
    """Number of bins."""
    bins = []
    for x in sorted(lengths, reverse=True):
        for i, used in enumerate(bins):
            if used + x <= capacity:
                bins[i] += x
                break
        else:
            bins.append(x)
    return len(bins)

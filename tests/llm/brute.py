"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = SPACE.findall(lower(text))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent=80):
    """rows of (doc_id, text) -> doc_id: smallest doc_id reachable."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, both = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for own in holders.values():
        for a in range(len(own)):
            for b in range(a):
                both[own[b], own[a]] += 1
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n) and find(a) != find(b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, sets


def removed(rows, length):
    """rows of (doc_id, text) -> list of (doc_id, bytes, removed flags), judged as a whole."""
    low = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            low[s] = min(low.get(s, i), i)
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if low[b[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        out.append((i, b, gone))
    return out


def removal_row(i, b, gone):
    spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
    return i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()


def whole_text(b, gone):
    """What is left as whole characters."""
    out, at = [], 0
    for ch in b.decode():
        n = len(ch.encode())
        if not all(gone[at : at + n]):
            out.append(ch)
        at += n
    return "".join(out)


def quality_counts(text):
    text = text or ""
    w = SPACE.findall(text)
    times = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if times[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def overlapping(doc, item, masks, short_masks, window, equal):
    """Whether an item lies over a document along the diagonal of a seed hit as the operator asks."""
    d, t = ALNUM.findall(lower(doc)), ALNUM.findall(lower(item))
    span, laid = len(masks[0]), set()
    masks = masks + short_masks if len(t) < window else masks
    seed = lambda words, at, m: (m, *(words[at + j] for j, bit in enumerate(m) if bit == "1"))
    places = defaultdict(list)
    for p in range(len(t) - span + 1):
        for m in masks:
            places[seed(t, p, m)].append(p)
    for i in range(len(d) - span + 1 if places else 0):
        for m in masks:
            for p in places.get(seed(d, i, m), ()):
                if i - p not in laid:
                    laid.add(i - p)
                    if agrees(d, t, i - p, window, equal):
                        return True
    return False


def agrees(d, t, diagonal, window, equal):
    """Whether `equal` of some `window` places of t agree with d along the diagonal."""
    agree = [0 <= diagonal + j < len(d) and d[diagonal + j] == t[j] for j in range(len(t))]
    width = min(window, len(t))
    return any(sum(agree[s : s + width]) >= -(-width * equal // window) for s in range(len(t) - width + 1))

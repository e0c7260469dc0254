"""Plain Python answers the Spark operators are held against; quadratic, for small fixtures only."""

import collections
import hashlib
import itertools
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes(rows, threshold=0.8):
    """doc_id -> (smallest doc_id of its group, number of linked documents)."""
    sets = {i: shingles(t) for i, t in rows}
    up, links = {i: i for i in sets}, collections.Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= threshold:
            links[a] += 1
            links[b] += 1
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: (root(i), links[i]) for i in sets}


def contamination(rows, items, size=10):
    """One (doc_id, n_words, n_hit, n_items, sha, contaminated) per row."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        if w:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i:i + n])].add(item)
    widths = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in widths:
            for i in range(len(w) - n + 1):
                own = windows.get(tuple(w[i:i + n]))
                if own is not None:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in own if x is not None}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return out


def repeated_bytes(rows, match=200):
    """One (doc_id, n_bytes, n_removed, n_spans, kept) per row."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[j:j + match] for _, b in raw for j in range(len(b) - match + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - match + 1):
            if seen[b[j:j + match]] > 1:
                gone[j:j + match] = b"\1" * match
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def base_phrases(text, phrases):
    """(n_words, all starts, labels) of phrases whose words stand consecutively."""
    w, starts, labels = words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), sorted(starts), labels

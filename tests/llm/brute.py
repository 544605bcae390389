"""Plain, slow versions of the contracts, on lists of rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

LAST = 2**63 - 1


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def substring_dedup(rows, length):
    """doc_id, n_words, n_removed, kept_sha256."""
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for s in range(len(w) - length + 1):
            k, at = tuple(w[s : s + length]), (LAST if doc_id is None else doc_id, s)
            first[k] = min(first.get(k, at), at)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for s in range(len(w) - length + 1):
            if (LAST if doc_id is None else doc_id, s) > first[tuple(w[s : s + length])]:
                gone.update(range(s, s + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), sha(kept.encode())))
    return out


def suffix_dedup(rows, length):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    seen = Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc_id, len(b), int(gone.sum()), spans, sha(bytes(np.frombuffer(b, np.uint8)[~gone]))))
    return out


def normalised(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def exact_groups(rows):
    """normalised text -> ids, nulls last."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normalised(text)].append(doc_id)
    return {k: sorted(v, key=lambda i: (i is None, i)) for k, v in groups.items()}


def shingles(text, width):
    w = [x.encode() for x in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not w:
        return frozenset()
    if len(w) < width:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def near_components(rows, width, percent):
    """For each row: size of its set and the least doc_id it reaches (null last)."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def top_k(rows, k, every):
    """query_id, rank, vec_id, score of (vec_id, vector) rows."""
    good = [
        (i, [int(np.floor(256 * float(x))) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for n, (q, v) in enumerate(good):
        if q is None or q % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), LAST if i is None else i) for m, (i, w) in enumerate(good) if m != n]
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, None if i == LAST else i, -s))
    return out

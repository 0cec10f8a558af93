"""Brute-force answers of the training-data queries, over plain Python rows."""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict

import regex

TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def terms(text):
    return TERM.findall(text.lower()) if text else []


def near(a, b):
    a, b = set(a), set(b)
    return len(a) >= 3 and len(b) >= 3 and len(a & b) / len(a | b) >= 0.7


def near_lists(sets):
    """Near partners of each set, over sets that share a term (without one there is no similarity)."""
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for t in s:
            holders[t].append(k)
    out = []
    for s in sets:
        shared = Counter()
        for t in s:
            shared.update(holders[t])
        out.append({k for k, c in shared.items() if len(s) >= 3 and len(sets[k]) >= 3 and c / (len(s) + len(sets[k]) - c) >= 0.7})
    return out


def p3(train, test):
    """train: (id, q1, q2); test: (test_id, q1, q2)."""
    distinct = list({frozenset(terms(q)) for rows in (train, test) for r in rows for q in r[1:]})
    number = {s: k for k, s in enumerate(distinct)}
    partners = near_lists(distinct)
    by_first = defaultdict(list)
    for t in test:
        by_first[number[frozenset(terms(t[1]))]].append((t[0], number[frozenset(terms(t[2]))]))
    found = set()
    for i, a, b in train:
        a, b = number[frozenset(terms(a))], number[frozenset(terms(b))]
        for x, y in ((a, b), (b, a)):
            for first in partners[x]:
                found.update((i, t) for t, second in by_first[first] if second in partners[y])
    return found


def p7(questions):
    """questions: {qid: text}."""
    qids = list(questions)
    partners = near_lists([frozenset(terms(questions[q])) for q in qids])
    return {(min(q, qids[k]), max(q, qids[k])) for q, p in zip(qids, partners) for k in p if qids[k] != q}


def groups(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {(root(x), x) for x in parent if root(x) != x}


def canonical(text):
    return "".join(c for c in (text or "").lower() if unicodedata.category(c)[0] in "LMN")


def copies(records):
    """records: (id, q1, q2) -> {(kept, copy)}."""
    by = defaultdict(list)
    for i, a, b in records:
        a, b = canonical(a), canonical(b)
        if a and b:
            by[tuple(sorted((a, b)))].append(i)
    return {(min(v), x) for v in by.values() for x in v if x != min(v)}

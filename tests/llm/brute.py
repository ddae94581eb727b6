"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOOSE = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, k=5):
    w = WORD.findall(fold(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard_classes(rows):
    """(doc_id, text) to {doc_id: component} and {doc_id: set size}."""
    sets = {d: shingles(t) for d, t in rows}
    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = Counter(o for g in s for o in where[g] if o < d)
        for o, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[o]) - k):
                a, b = sorted((root(o), root(d)))
                parent[b] = a
    return {d: root(d) for d in sets}, {d: len(s) for d, s in sets.items()}


def repeated_words(rows, k=20):
    """(doc_id, text) in order of doc_id to (doc_id, words, removed, digest of the rest)."""
    seen, out = set(), []
    for d, text in sorted(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            window = tuple(w[i:i + k])
            if window in seen:
                gone[i:i + k] = [True] * k
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    text = text or ""
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return spans


def contained_items(rows, items):
    """Pairs (doc_id, item_id) where the item's words occur in the document in one piece."""
    out = set()
    for d, text in rows:
        words = "\0".join(["", *LOOSE.findall(fold(text)), ""])
        for i, item in items:
            own = LOOSE.findall(fold(item))
            if own and "\0".join(["", *own, ""]) in words:
                out.add((d, i))
    return out

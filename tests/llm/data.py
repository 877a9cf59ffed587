"""Small documents with every awkward case, and plain re-implementations to compare with."""

from __future__ import annotations

import random
import re
import string
from collections import Counter, defaultdict

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Clashing names on purpose: the operators use some of them inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __a long, k0 string, n int, token string, block long"


def rows(texts, first_id=1):
    """Rows of SCHEMA; texts may be (id, text)."""
    out = []
    for i, t in enumerate(texts):
        ident, text = t if isinstance(t, tuple) else (first_id + i, t)
        out.append((ident, text, "en" if i % 3 else None, f"src{i % 2}", len(text or ""), i, "x", i, None, -i))
    return out


def prose(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


def awkward():
    """Nulls, blanks, copies, near copies, shared passages, ties, a long text, null ids, repeated rows."""
    base, other, passage = prose(150, 1), prose(120, 2), prose(70, 3)
    near = base.split(" ")
    near[10], near[90] = "CHANGED", "two\nlines"
    long = prose(60_000, 4) + " " + passage
    texts = [
        base, base, " ".join(near), other, None, "", " \t\n", "one", "one two three", "one two three", "ONE Two three four",
        prose(40, 5) + "\n" + passage + " " + prose(30, 6), passage + "\t" + prose(50, 7), long, "a " * 120, "b b", "日本 語 " * 30, "x\x00y \x1c z",
    ]
    out = rows(texts)
    out += rows([(None, base), (None, None), (4, other), (4, other), (7, " \t\n")], 100)
    return out


def covered(texts, window):
    """By row: words, flags of the words in runs that start elsewhere too."""
    words = [BLANK_WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((w, gone))
    return out


def shingles(text, size):
    w = BLANK_WORD.findall((text or "").translate(LOWER))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)] if w else [])


def joined(n, linked):
    """Roots of n items under the pairs (i, j)."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard_links(sets, percent):
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    both = Counter((a, b) for rows_ in held.values() for k, a in enumerate(rows_) for b in rows_[k + 1 :])
    return [(a, b) for (a, b), c in both.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]

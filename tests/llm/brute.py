"""Plain Python versions of the operators, row by row, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def op1(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, covered = Counter(win), set()
    for i, x in enumerate(win):
        if c[x] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered)


def op2(texts, n=400):
    raw, c = [(t or "").encode() for t in texts], Counter()
    for b in raw:
        c.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = set()
        for i in range(len(b) - n + 1):
            if c[b[i : i + n]] > 1:
                gone.update(range(i, i + n))
        out.append((len(b), len(gone), sum(i - 1 not in gone for i in gone), sha(bytes(x for i, x in enumerate(b) if i not in gone))))
    return out


def op5(rows, n=13):
    big = float("inf")
    ws, first = [(big if d is None else d, WORD.findall(t or "")) for d, t in rows], {}
    for d, w in ws:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, big), d)
    out = []
    for d, w in ws:
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def op7(text):
    t = text or ""
    o = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    o += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    o += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    c = Counter(x[3] for x in o)
    return c["assign"], c["access"], c["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(o)))


def linked(rows):
    """Each row's set of shingles, and one row for each component."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                up[root(i)] = root(j)
    return sets, [root(i) for i in range(len(sets))]


def op8(rows):
    sets, of = linked(rows)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[of[i]].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        known = [x for x in ids[of[i]] if x is not None]
        c = min(known) if known else None
        out.append((len(sets[i]), c, d == c))
    return out

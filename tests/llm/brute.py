"""Plain single-machine versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 12 <= len(d) <= 19 and luhn(d),
                    "phone": lambda: 9 <= len(d) <= 15}[kind]():
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


def rule_columns(text):
    words = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i:i + 3])].append(i)
    inside = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(inside))


def shingles(text):
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def linked(docs):
    """{id: (set size, component)} by comparing all pairs of different sets."""
    sets = {i: shingles(t or "") for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edit_distance(a, b, most):
    """The edit distance of two texts, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def dropped_lines(docs, least=20, edits=1):
    """{id: [line numbers]}: equal to an earlier line or few edits from one."""
    seen, order = {}, []
    for i, text in sorted(docs):
        for no, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\v\f\r")
            if len(line) >= least:
                seen.setdefault(line, (i, no))
                order.append((i, no, line))
    by_size = defaultdict(list)
    for line, first in seen.items():
        by_size[len(line)].append((first, line, Counter(line)))

    def near(a, first):
        if len(a) < 20:
            return False
        letters = Counter(a)
        for n in range(max(20, len(a) - edits), len(a) + edits + 1):
            most = min(edits, min(n, len(a)) // 10)
            for before, b, other in by_size.get(n, ()):
                if (before < first and sum((letters - other).values()) <= most
                        and edit_distance(a, b, most) <= most):
                    return True
        return False

    gone = {a for a, first in seen.items() if near(a, first)}
    out = defaultdict(list)
    for i, no, line in order:
        if seen[line] < (i, no) or line in gone:
            out[i].append(no)
    return out


def best_fit_fills(lengths, capacity):
    windows = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, w in enumerate(windows) if capacity - w >= n]
        if fits:
            windows[max(fits, key=lambda k: windows[k])] += n
        else:
            windows.append(n)
    return Counter(windows)

"""Plain statements of what the operators compute, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
WORD = r"[^\x20\x09-\x0D]+"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def repeats(docs, width=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def shingle_sets(docs):
    out = {}
    for d, t in docs:
        w = re.findall(WORD, (t or "").translate(FOLD))
        out[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def near_groups(docs):
    sets = shingle_sets(docs)
    g, ids = Groups(sets), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                g.join(a, b)
    return {d: (len(s), g.find(d)) for d, s in sets.items()}


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def removed_lines(docs, percent=80):
    at = defaultdict(list)
    for d, t in docs:
        for k, line in enumerate((t or "").split("\n")):
            if n := re.sub(r"\s+", " ", line.lower()).strip(" "):
                at[n].append((d, k))
    lines = list(at)
    g = Groups(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            m = max(len(lines[i]), len(lines[j]))
            if min(len(lines[i]), len(lines[j])) * 100 >= m * percent and distance(lines[i], lines[j]) <= m * (100 - percent) // 100:
                g.join(i, j)
    groups, gone = defaultdict(list), defaultdict(set)
    for i, n in enumerate(lines):
        groups[g.find(i)] += at[n]
    for where in groups.values():
        for d, k in where:
            if (d, k) != min(where):
                gone[d].add(k)
    return {d: (len((t or "").split("\n")), ",".join(map(str, sorted(gone[d])))) for d, t in docs}


def leaks(docs, items, percent=80):
    out = {}
    for d, t in docs:
        w = re.findall(WORD, (t or "").lower())
        for i, x in items:
            iw = re.findall(WORD, (x or "").lower())
            k, n = min(5, len(iw)), len(iw)
            if not n:
                continue
            ic = Counter(tuple(iw[a : a + k]) for a in range(n - k + 1))
            if not any(tuple(w[a : a + k]) in ic for a in range(len(w) - k + 1)):
                continue
            for s in range(max(0, len(w) - n) + 1):
                ww = w[s : s + n]
                c = Counter(tuple(ww[a : a + k]) for a in range(len(ww) - k + 1))
                o = sum((c & ic).values())
                either = sum(c.values()) + sum(ic.values()) - o
                if o and 100 * o >= percent * either:
                    out[d, i] = max(out.get((d, i), (0, 0)), (o / either, -s))
    return out


def unigrams(docs):
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    tokens = lambda t: [*re.findall(WORD, (t or "").translate(FOLD)), None]
    c = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {d: (held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t in docs}


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(t):
    t = t or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))

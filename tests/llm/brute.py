"""Plain Python versions of the operators, for small inputs."""

import math
import re
from collections import Counter
from hashlib import md5


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts(docs, words=5, threshold=(80, 100)):
    """doc_id -> (n_shingles, component)."""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            inter = len(sets[a] & sets[b])
            if inter and threshold[1] * inter >= threshold[0] * len(sets[a] | sets[b]):
                links.append((a, b))
    comp = components(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def repeated_spans(docs, run=51, least=5):
    """doc_id -> merged spans of repeated lines and of repeated runs of ``run`` words; ids are unique."""
    first, found = {}, {i: [] for i, _ in docs}
    for i, text in sorted((i, t) for i, t in docs if t):
        lines = [(m.start(), m.end(), m[0].encode().lower().split()) for m in re.finditer(r"[^\n]+", text)]
        words = [(m.start(), m.end(), m[0].encode().lower()) for m in re.finditer(r"[^ \t-\r]+", text)]
        for start, end, unit in lines:
            if len(unit) >= least and first.setdefault(("line", *unit), (i, start)) != (i, start):
                found[i].append((start, end))
        for k in range(len(words) - run + 1):
            at = first.setdefault(tuple(w[2] for w in words[k:k + run]), (i, k))
            if at[0] != i or k >= at[1] + run:
                found[i].append((words[k][0], words[k + run - 1][1]))
    out = {}
    for i, spans in found.items():
        out[i] = []
        for start, end in sorted(spans):
            if out[i] and start <= out[i][-1][1]:
                out[i][-1] = (out[i][-1][0], max(end, out[i][-1][1]))
            else:
                out[i].append((start, end))
    return out


RULES = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def secrets(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


def redacted(text, found, mask="[SECRET]"):
    out, at = [], 0
    for start, _, _, end in found:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def url_verdict(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def tree_shard(key, shards):
    def draw(child, weight):
        head = int(md5(f"{key}/{child}".encode()).hexdigest()[:12], 16)
        return -math.log((head + 0.5) / 16**12) / weight

    below = shards
    for level in ("region", "rack", "shard"):
        weights = Counter()
        for s in below:
            weights[getattr(s, level)] += s.weight
        won = min((draw(f"{level}{n}", w), n) for n, w in weights.items() if w > 0)[1]
        below = [s for s in below if getattr(s, level) == won]
    return won

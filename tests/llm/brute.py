"""Plain, slow versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def space_words(s: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(s or ""))


def components(ids, links) -> dict:
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def line_dedup(rows, min_chars=40, min_docs=5) -> list[tuple]:
    def key(line):
        k = lower(line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= min_chars else None

    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if key(line) and d is not None:
                held[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(held[key(x)]) >= min_docs and max(held[key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def embedding(rows, threshold=0.93) -> dict:
    ok = {}
    for i, v, label in rows:
        good = i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ok[i] = np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None
    label = {i: y for i, _, y in rows}
    links = [(a, b) for a in ok for b in ok if a is not None and b is not None and a < b and ok[a] is not None and ok[b] is not None
             and len(ok[a]) == len(ok[b]) and label[a] == label[b] and ok[a] @ ok[b] >= threshold]
    n = Counter(x for pair in links for x in pair)
    root = components([i for i in ok if i is not None], links)
    return {i: (n[i], root[i], root[i] == i) for i in root}


def jaccard(rows, n=3, num=9, den=10) -> dict:
    sets = {}
    for d, t in rows:
        w = space_words(t)
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = [d for d in sets if sets[d]]
    links = [(a, b) for a in ids for b in ids if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = components(list(sets), links)
    return {d: (len(sets[d]), root[d]) for d in sets}


def unigram(rows) -> dict:
    """doc -> held_out, n_tokens, n_known, train_tokens, base_score."""
    tokens = {d: [*space_words(t), None] for d, t in rows}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not out[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        d: (out[d], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        for d, ws in tokens.items()
    }


def ctw(train: list[bytes], text: bytes, depth: int) -> float:
    """log10 probability of the text and its end by the definition, one decision and depth at a time."""
    from math import lgamma

    nodes: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])

    def path(data: bytes):
        data = b"\0" * depth + data + b"\0"
        for i in range(depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield data[i - depth : i], node, bit
                node = node << 1 | bit

    for t in train:
        for context, node, bit in path(t):
            for d in range(depth + 1):
                nodes[context[depth - d :], node][bit] += 1
    children = defaultdict(set)
    for c, node in nodes:
        if c:
            children[c[1:], node].add((c, node))

    def kt(c):
        a, b = nodes[c]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - math.log(math.pi) - lgamma(a + b + 1)

    memo: dict = {}

    def weighted(c):
        if c not in memo:
            below = sum(weighted(x) for x in children[c])
            memo[c] = kt(c) if len(c[0]) == depth else float(np.logaddexp(kt(c), below)) - math.log(2)
        return memo[c]

    seen = set(nodes)
    total = 0.0
    for context, node, bit in path(text):
        p = None
        for d in range(depth, -1, -1):
            c = (context[depth - d :], node)
            if c not in seen:
                continue
            own = (nodes[c][bit] + 0.5) / (sum(nodes[c]) + 1)
            stop = math.exp(kt(c) - math.log(2) - weighted(c)) if d < depth else 1.0
            p = own if p is None else stop * own + (1 - stop) * p
        total += math.log10(0.5 if p is None else p)
    return total


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licence(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def licence_labels(texts: list[str | None], templates, share: float, slack: int, drift: int) -> list[tuple[set[str], float]]:
    """Each text's labels and score: every place of every key phrase, every template word around it."""
    own = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")) for t in texts]
    df = Counter(x for w in own for x in set(w))
    out = []
    for w in own:
        labels, score = set(), 0.0
        for p, label in PHRASES.items():
            if any(w[i : i + len(p.split())] == p.split() for i in range(len(w))):
                labels.add(label)
                score = 1.0
        for label, text, key in templates:
            t, k = (re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x)) for x in (text, key))
            at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            weight = [math.log((len(own) + 1) / (df[x] + 1)) + 1e-3 for x in t]
            for b in (i - at for i in range(len(w)) if w[i : i + len(k)] == k):
                got = 0.0
                for i, x in enumerate(t):
                    far = max(at - i, i - at - len(k) + 1, 0)
                    room = slack + far // drift if far else 0
                    got += weight[i] * (x in w[max(0, b + i - room) : max(0, b + i + room + 1)])
                if got / sum(weight) >= share - 1e-12:
                    labels.add(label)
                    score = max(score, got / sum(weight))
        out.append((labels, min(score, 1.0)))
    return out


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def url(u: str | None) -> tuple:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fits = [r for r in RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, RULES[rule] if rule else None


def warc(rows) -> list[tuple]:
    first: dict = {}
    for i, html in rows:
        k = html or ""
        if i is not None:
            first[k] = min(first.get(k, i), i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        f = first.get(html or "")
        again = f is not None and f != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    return out


def targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def hard_negatives(rows, positives=5, negatives=10, low=30, high=90, scale=256) -> set[tuple]:
    """rows: (id, label, vector, is_anchor)."""
    ok = {}
    for i, y, v, a in rows:
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i, y, tuple(min(max(math.floor(float(np.float64(scale) * x)), -(1 << 63)), (1 << 63) - 1024) if abs(x) < 1e300 else int(math.copysign((1 << 63) - 1024, x)) for x in v)] = a
    chosen: dict = {}
    for (i, y, v), a in ok.items():
        if a and (i not in chosen or (y, v) < chosen[i]):
            chosen[i] = (y, v)
    top = (1 << 63) - 1
    out = set()
    for i, (y, v) in chosen.items():
        scored = sorted({(-min(max(sum(p * q for p, q in zip(v, w, strict=True)), -top), top), j, z == y) for j, z, w in ok if j != i and len(w) == len(v)})
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            inside = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out |= {(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(inside, 1)}
    return out


def repaired(rows) -> dict:
    """rows: (conv, turn, role, text, gone) after damage. conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256), edit by edit."""
    held = defaultdict(list)
    for c, t, r, x, gone in rows:
        held[c].extend([] if gone else [(t, r if r is not None else " ", x if x is not None else " ")])
    out = {}
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    for c, own in held.items():
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        seen, faults = set(), []
        for _, r, x in own:
            sign = x.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not sign else "duplicate" if (r, x) in seen else "truncated" if sign not in ".!?" else None)
            seen.add((r, x))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        ways = {"": (0, "", ())}  # the state: the last initial kept

        def insert(ways):
            for _ in range(4):
                for state, (cost, audit, lines) in list(ways.items()):
                    to = "a" if state == "u" else "u"
                    way = cost + 3, audit + "I", (*lines, f"{'user' if to == 'u' else 'assistant'}:")
                    ways[to] = min(ways.get(to, way), way)
            return ways

        for (_, r, x), fault in zip(own, faults, strict=True):
            after: dict = {}
            for state, (cost, audit, lines) in insert(ways).items():
                options = [(state, (cost + 4, audit + "D", lines))]
                if fault not in ("blank", "duplicate"):
                    cut = 3 * (fault == "truncated")
                    if (state, r[:1]) in legal:
                        options.append((r[:1], (cost + cut, audit + "K", (*lines, f"{r}:{x}"))))
                    to = "a" if state == "u" else "u"
                    options.append((to, (cost + cut + 3, audit + "R", (*lines, f"{'user' if to == 'u' else 'assistant'}:{x}"))))
                for to, way in options:
                    after[to] = min(after.get(to, way), way)
            ways = after
        ways = insert(ways)
        cost, audit, lines = min(ways[s] for s in ("", "a") if s in ways)
        out[c] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damaged(rows) -> list[tuple]:
    """(conv, turn, role, text) -> the rows with ``gone``."""
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
        out += [(c, t, "user" if how == 4 else r, x, how == 0)] * (2 if how == 3 else 1)
    return out

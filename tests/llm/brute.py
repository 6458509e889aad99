"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re

import xxhash


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def groups(keys, linked) -> dict:
    """Key to the smallest key reachable over ``linked(a, b)``."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(root)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def substring_repeats(rows: dict[int, str | None], length: int) -> dict:
    seen, out = set(), {}
    for doc in sorted(rows):
        data = (rows[doc] or "").encode()
        hit = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                hit[i : i + length] = b"\1" * length
            seen.add(data[i : i + length])
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out[doc] = (len(data), sum(hit), spans, sha(bytes(b for b, h in zip(data, hit) if not h)))
    return out


def fingerprint(text: str | None, words: int = 4) -> int:
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def words(text: str | None) -> list[str]:
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(text: str | None, items: dict[int, str], window: int = 10) -> tuple[int, set[int], set[int]]:
    """Number of words, hit word numbers, items."""
    doc, hit, named = words(text), set(), set()
    for item, body in items.items():
        own = words(body)
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(doc) - size + 1):
            if tuple(doc[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                named.add(item)
    return len(doc), hit, named


def codes(rows: dict[int, list[float]], entries: int, rounds: int, parts: int = 4, scale: int = 1024):
    """Codes and errors by comparing every part with every entry, and the books."""
    ints = {k: [math.floor(scale * x) for x in v] for k, v in rows.items()}
    size = len(next(iter(ints.values()))) // parts
    cut = {k: [v[p * size : (p + 1) * size] for p in range(parts)] for k, v in ints.items()}
    books = [[list(cut[k][p]) for k in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members: dict[int, list] = {}
            for k in cut:
                members.setdefault(nearest(cut[k][p], book)[1], []).append(cut[k][p])
            for i, group in members.items():
                book[i] = [sum(x) // len(group) for x in zip(*group)]
    found = {k: [nearest(v[p], books[p]) for p in range(parts)] for k, v in cut.items()}
    return {k: (bytes(i for _, i in f), sum(d for d, _ in f)) for k, f in found.items()}, books


def mix_targets(sizes: dict, weights: tuple, share: float, repeats: int) -> dict:
    """Target of each source by sharing again until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(repeats * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        target = {s: repeats * sizes[s] if s in capped else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if target[s] > repeats * sizes[s]}
        if not above:
            return target
        capped |= above


def hard_negatives(rows: list[tuple], anchors, positives: int, negatives: int, scale: int = 256) -> set[tuple]:
    """Rows ``(id, label, vector)`` compared one by one."""
    ints = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows]
    out = set()
    for a, label, vector in ints:
        if not anchors(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), i, other) for i, other, v in ints if i != a)
        for p_score, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and 50 * -p_score <= 100 * -x[0] <= 95 * -p_score]
            out |= {(a, p, n + 1, i, -p_score, -s) for n, (s, i, _) in enumerate(inside[:negatives])}
    return out


def line_units(line: str) -> list[tuple[str, int, int]]:
    """(normalised unit, start, end) of a line, in its code points."""
    found = list(re.finditer(r"[\x20\x09-\x0D]*((?:[^\x20\x09-\x0D。！？]*[。！？]+|[^\x20\x09-\x0D。！？]+))[\x20\x09-\x0D]*", line))
    size = [len(m[1].encode()) for m in found]
    out, start = [], 0
    for k, m in enumerate(found):
        around = 3 * (size[k - 1] if k else 0) + 5 * size[k] + 7 * (size[k + 1] if k + 1 < len(size) else 0)
        if k + 1 == len(found) or m[1][-1] in "。！？" or around % 8 == 0:
            unit = " ".join(x[1] for x in found[start : k + 1]).encode().lower().decode()
            out.append((unit, found[start].start(), m.end()))
            start = k + 1
    return out


def line_repeats(rows: dict[int, str | None]) -> dict:
    """(text left, cut stretches) of each document."""
    seen, out = set(), {}
    for doc in sorted(rows):
        if rows[doc] is None:
            out[doc] = (None, [])
            continue
        flat, at = [], 0
        for number, line in enumerate(rows[doc].split("\n")):
            for u in line_units(line):
                flat.append([number, *u, u[0] in seen or u[0] in {f[1] for f in flat}])
        seen |= {f[1] for f in flat}
        gone = [False] * len(flat)
        i = 0
        while i < len(flat):
            j = i
            while j < len(flat) and flat[j][4] == flat[i][4]:
                j += 1
            if flat[i][4] and len(" ".join(f[1] for f in flat[i:j]).encode()) >= 60:
                gone[i:j] = [True] * (j - i)
            i = j
        kept, cuts = [], []
        for number, line in enumerate(rows[doc].split("\n")):
            own = [i for i, f in enumerate(flat) if f[0] == number]
            if own and all(flat[i][4] for i in own) and len(" ".join(flat[i][1] for i in own).encode()) >= 30:
                for i in own:
                    gone[i] = True
            for i in own:
                if gone[i]:
                    a, z = at + flat[i][2], at + flat[i][3]
                    if cuts and cuts[-1][0] == number and cuts[-1][2] == a:
                        cuts[-1] = (number, cuts[-1][1], z)
                    else:
                        cuts.append((number, a, z))
            if not own or not all(gone[i] for i in own):
                kept.append("".join(line[flat[i][2] : flat[i][3]] for i in own if not gone[i]) if own else line)
            at += len(line) + 1
        out[doc] = ("\n".join(kept), cuts)
    return out


def shingles(text: str | None, size: int = 5) -> set[bytes]:
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def jaccard(a: set, b: set) -> float:
    """Two empty sets are alike."""
    return len(a & b) / len(a | b) if a or b else 1.0

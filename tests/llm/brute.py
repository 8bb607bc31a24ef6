"""Plain versions to hold the operators against."""

import hashlib
import math
import re

from quarry.llm.mixing import SEED


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def mix(rows, weights=(5, 2, 1), budget=1.5, cap=2.0):
    """rows: (doc_id, source, text) with distinct ids -> doc_id: (size, source_size, target, times)."""
    size = {d: len(words(t)) for d, _, t in rows}
    total = {}
    for d, s, _ in rows:
        total[s] = total.get(s, 0) + size[d]
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(total.values())
    while free:
        w = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / w >= cap * total[s]}
        if not above:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in above:
            target[s] = cap * total[s]
            left -= target[s]
        free -= above
    out = {}
    for s in names:
        mine = []
        for d, src, t in rows:
            if src == s:
                u = (int(hashlib.md5(f"{SEED}:{'' if d is None else d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                letters = sum(c.isalpha() for c in t or "")
                mine.append((-math.log(u) / (max(letters / len(t), 0.1) if t else 0.1), d))
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, upto = target[s] - epochs * total[s], 0
        for _, d in sorted(mine):
            upto += size[d]
            out[d] = (size[d], total[s], target[s], epochs + (rest > 0 and upto - size[d] / 2 <= rest))
    return out

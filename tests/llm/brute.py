"""Plain versions that the operators and stages are held against."""

import hashlib
from collections import Counter, defaultdict

import xxhash

from pagewright.llm.lines import FIELD, MIN_DOCS


def shingles(t, size=4):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()



def passages_by_brute_force(rows):
    seen, want = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            seen.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < i:
                hit[k : k + 50] = b"\1" * 50
        left = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        want[i] = (len(b), sum(hit), sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit)), hashlib.sha256(left).hexdigest())
    return want



def line_templates(texts):
    """(doc, line) -> template, by the rule carried out one sequence at a time: of a leaf's sequences by falling count
    (ties by hash) each follows the first leader it agrees with or becomes one; the first leads the leaf."""
    leaves, occur = defaultdict(Counter), []
    for i, t in texts:
        for k, line in enumerate((t or "").split("\n")):
            w = tuple(FIELD if any(c in "0123456789" for c in x.decode()) else x.decode() for x in line.encode().split())
            if w:
                leaves[len(w), *w[:3]][w] += 1
                occur.append((i, k, (len(w), *w[:3]), w))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    of = {}
    for leaf, seqs in leaves.items():
        leaders = []
        for s in sorted(seqs, key=lambda s: (-seqs[s], -signed(xxhash.xxh64_intdigest(" ".join(s), seed=42)))):
            of[leaf, s] = next((x for x in leaders if sum(a != b for a, b in zip(s, x, strict=True)) <= int(len(s) * 0.3 + 1e-9)), s)
            if of[leaf, s] == s:
                leaders.append(s)
    return {(i, k): (leaf, of[leaf, w]) for i, k, leaf, w in occur}


def recurring(texts):
    """(doc, line) of the lines to drop: all but the first of each template that is in MIN_DOCS documents."""
    places = defaultdict(list)
    for at, template in line_templates(texts).items():
        places[template].append(at)
    return {p for some in places.values() if len({i for i, _ in some}) >= MIN_DOCS for p in some if p != min(some)}


def components(texts, size):
    """The smallest document that each one is linked with, over all pairs."""
    sets = {i: shingles(t, size) for i, t in texts}
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label

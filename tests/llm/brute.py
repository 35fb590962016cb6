"""Plain versions of the operators, for small inputs."""

import hashlib


def byte_repeats(rows, width=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} of (doc_id, text) rows with distinct ids."""
    docs = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in docs:
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, b in docs:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < i:
                gone[s : s + width] = b"\1" * width
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def word_repeats(rows, width=20):
    """{doc_id: (n_words, n_removed, sha)}; rows with distinct ids."""
    docs = [(i, (t or "").encode().split()) for i, t in sorted(rows)]
    seen, out = set(), {}
    for i, ws in docs:
        gone = [False] * len(ws)
        for s in range(len(ws) - width + 1):
            w = tuple(ws[s : s + width])
            if w in seen:
                gone[s : s + width] = [True] * width
            seen.add(w)
        kept = b" ".join(w for w, g in zip(ws, gone) if not g)
        out[i] = (len(ws), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def similar_components(rows, words=5, enough=(4, 5)):
    """{doc_id: (n_shingles, component_id)}; rows with distinct ids."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(ws[k : k + words]) for k in range(len(ws) - words + 1)} or ({tuple(ws)} if ws else set())
    having = {}
    for i, s in sets.items():
        for e in s:
            having.setdefault(e, []).append(i)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        shared = {}
        for e in s:
            for j in having[e]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j < i and enough[1] * n >= enough[0] * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}

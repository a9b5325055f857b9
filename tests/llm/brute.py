"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def without_repeats(sequences: list, length: int) -> list[list[bool]]:
    """For each sequence, which places repeated windows cover."""
    times = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    gone = []
    for s in sequences:
        g = [False] * len(s)
        for i in range(len(s) - length + 1):
            if times[tuple(s[i : i + length])] > 1:
                g[i : i + length] = [True] * length
        gone.append(g)
    return gone


def word_dedup(rows, length):
    """Of (doc_id, text): (doc_id, n_words, n_removed, kept_sha256), sorted."""
    split = [words(t) for _, t in rows]
    gone = without_repeats(split, length)
    return sorted(
        ((i, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y))) for (i, _), w, g in zip(rows, split, gone)),
        key=repr,
    )


def byte_dedup(rows, length):
    data = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), b, g in zip(rows, data, without_repeats(data, length)):
        spans = sum(y and not (k and g[k - 1]) for k, y in enumerate(g))
        out.append((i, len(b), sum(g), spans, sha(bytes(x for x, y in zip(b, g) if not y))))
    return sorted(out, key=repr)


def near_join(rows, threshold=0.8, length=5):
    """(doc_id, class_id, n_copies, n_links, group_id), sorted; ids must be unique."""
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + length]) for k in range(max(1, len(w) - length + 1))) if w else None
    classes = defaultdict(list)
    for i in sorted(sets):
        classes[sets[i] or i].append(i)
    heads = {key: members[0] for key, members in classes.items()}
    parent = {h: h for h in heads.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    keyed = [k for k in heads if isinstance(k, frozenset)]
    for n, a in enumerate(keyed):
        for b in keyed[:n]:
            if len(a & b) / len(a | b) >= threshold:
                links[heads[a]] += 1
                links[heads[b]] += 1
                x, y = root(heads[a]), root(heads[b])
                parent[max(x, y)] = min(x, y)
    rows = [(i, heads[k], len(m), links[heads[k]], root(heads[k])) for k, m in classes.items() for i in m]
    return sorted(rows, key=repr)


_ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def benchmark_words(text):
    return _ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def decontaminate(rows, items, window=10):
    where = defaultdict(set)
    for item, text in items:
        w = benchmark_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            where[tuple(w[i : i + window])].add(item)
    out = []
    for doc, text in rows:
        w = benchmark_words(text)
        hit, found = set(), set()
        for n in {len(k) for k in where}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in where:
                    hit.update(range(i, i + n))
                    found |= where[key]
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len(found - {None}), sha(ids), bool(hit)))
    return sorted(out, key=repr)


def _either_case(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + "|" + _either_case("api") + "_?" + _either_case("key")
_ASSIGN = re.compile(rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(rows):
    """(doc_id, n_assign, n_access, n_hex, base_sha256), sorted."""
    out = []
    for i, t in rows:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        written = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        out.append((i, *[sum(f[1] == k for f in found) for k in range(3)], sha(written)))
    return sorted(out, key=repr)


def token_rows(rows, tokenizer, end_id=2):
    """(doc_id, start, n_tokens, ids_crc32) in order; ids must be unique."""
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def neighbours(rows, k=5, every=50):
    """{query_id: ids of the k nearest}, for usable vectors."""
    rows = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], float)
    norm = np.sqrt((m * m).sum(axis=1))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        near = np.round((m @ m[q]) / (norm * norm[q]), 12)
        near[ids == ids[q]] = -2
        out[int(ids[q])] = ids[np.lexsort((ids, -near))[:k]].tolist()
    return out


def inner_products(rows, k=5, steps=256, every=50):
    """Of (vec_id, vector): (query_id, rank, vec_id, score), sorted; ids must be unique."""
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(steps * x) for x in v]
    out = []
    for q, v in whole.items():
        if q % every == 0:
            others = [(sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q and len(w) == len(v)]
            best = sorted(others, key=lambda o: (-o[0], o[1]))[:k]
            out += [(q, n, i, min(max(s, -(2**63)), 2**63 - 1)) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(rows):
    """Of (doc_id, text): (word, form, root, n, n_near, form_n), sorted."""
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in seen.items() if c >= 2 and len(w) >= 7}
    # Words one edit apart share a word that is one of them, or either less one letter.
    shared = defaultdict(set)
    for w in n:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shared[v].add(w)
    near = defaultdict(set)
    for group in shared.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def token_alignment(rows, a, b):
    """Of (doc_id, text) and two tokenizers: the documents' rows, sorted, by whole texts."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain}
    byte |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def ends(tokens):
        at, found = 0, {}
        for k, t in enumerate(tokens):
            at += len(t)
            found[at] = k
        return found

    aligned, counts = [], Counter()
    for i, t in rows:
        a_ids, b_ids = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        a_said = [bytes(byte[c] for c in a.id_to_token(x)) for x in a_ids]
        pieces = [b.id_to_piece(x) for x in b_ids]
        b_said = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b_ids, pieces)]
        if not t or not b"".join(a_said) == b"".join(b_said) == (" " + t).encode():
            aligned.append((i, [], [], [], ""))
            continue
        a_ends, b_ends = ends(a_said), ends(b_said)
        p = q = 0
        groups, links = [], []
        for cut in sorted(a_ends.keys() & b_ends.keys()):
            x, y = a_ends[cut] + 1, b_ends[cut] + 1
            groups.append(",".join(map(str, a_ids[p:x])) + "|" + ",".join(map(str, b_ids[q:y])))
            links.append((a_ids[x - 1], b_ids[y - 1]))
            p, q = x, y
        counts.update(links)
        aligned.append((i, a_ids, b_ids, links, sha(";".join(groups))))
    top = defaultdict(int)
    for (_, y), c in counts.items():
        top[y] = max(top[y], c)
    out = [
        (i, len(x), len(y), len(l), len(l), sum(counts[p] == top[p[1]] for p in l), sum(counts[p] for p in l), h)
        for i, x, y, l, h in aligned
    ]
    return sorted(out, key=repr)

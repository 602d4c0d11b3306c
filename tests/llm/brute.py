"""Plain versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import base64
import bisect
import collections
import hashlib
import itertools
import math
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def substring_dedup(rows, window=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            if i is not None:
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text, shingle=4):
    w = words((text or "").translate(UPPER))
    grams = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=4):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def simhash(rows, bits=4):
    fps = [fingerprint(t) for _, t in rows]
    group = components(fps, bits)
    low = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return [(i, f"{f:016x}", low.get(g)) for (i, _), f, g in zip(rows, fps, group, strict=True)]


def similar(rows, shingle=5, similarity=0.8):
    """A component number for each row, by the Jaccard similarity of sets of shingles; texts without words are alike."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + shingle]) for k in range(max(len(w) - shingle + 1, 1))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and (a == b or len(a & b) >= similarity * len(a | b)):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def decontaminate(rows, items, window=10):
    own = {}
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(UPPER))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            own.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    sizes = {len(k) for k in own}
    out = []
    for i, t in rows:
        w = ITEM_WORD.findall((t or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (s := tuple(w[k : k + n])) in own:
                    hit.update(range(k, k + n))
                    found |= own[s]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def warc(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        r = first.get(h or "")
        copy = i is not None and r != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if copy else "response", r if copy else None))
    return out


def wav(payload):
    head = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little")
    head += (1).to_bytes(2, "little") * 2 + (8000).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little")
    return head + b"data" + len(payload).to_bytes(4, "little") + payload


def media(rows):
    out = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        m = wav(p)
        out.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest()))
    return out


def base_scores(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [*words((t or "").translate(UPPER)), None]
    c = collections.Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tokens(t)
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return out


def best_fit_decreasing(lengths, size):
    """How many sequences best fit needs, one piece after the other, longest first."""
    gaps, made = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        if k == len(gaps):
            gap, made = size, made + 1
        else:
            gap = gaps.pop(k)
        bisect.insort(gaps, gap - n)
    return made


def _letter_sequences(word, letters=4, most=3, decay=0.6):
    """(code, weight) of all gapped sequences of a word's letters; edges are letters."""
    stands_for = dict(zip("013457@$!", "oieastasi", strict=True))
    symbols = [27]
    for b in word:
        c = ord(stands_for.get(chr(b), chr(b)))
        if chr(c).isascii() and chr(c).isalpha():
            symbols.append((c | 32) - 96)
        elif 0x80 <= b < 0xC0:
            symbols.append(28 + (b & 3))
    symbols.append(27)
    for first in range(len(symbols)):
        for rest in itertools.combinations(range(first + 1, min(first + letters + most, len(symbols))), letters - 1):
            code = 0
            for k in (first, *rest):
                code = code << 5 | symbols[k]
            yield code, decay ** (rest[-1] - first - letters + 1)


def sequence_counts(word):
    out = collections.Counter()
    for code, w in _letter_sequences(word):
        out[code] += w
    return out


def sequence_squares(word):
    return [w * w for _, w in _letter_sequences(word)]


def kernel_score(word, weights, letters=4, most=3, decay=0.6):
    """The normed sum over gapped sequences of letters, a sequence's weight being decay for each letter between its own; edges are letters."""
    stands_for = dict(zip("013457@$!", "oieastasi", strict=True))
    symbols = [27]
    for b in word:
        c = ord(stands_for.get(chr(b), chr(b)))
        if chr(c).isascii() and chr(c).isalpha():
            symbols.append((c | 32) - 96)
        elif 0x80 <= b < 0xC0:
            symbols.append(28 + (b & 3))
    symbols.append(27)
    total = norm = 0.0
    for first in range(len(symbols)):
        for rest in itertools.combinations(range(first + 1, min(first + letters + most, len(symbols))), letters - 1):
            code = 0
            for k in (first, *rest):
                code = code << 5 | symbols[k]
            w = decay ** (rest[-1] - first - letters + 1)
            total += float(weights[code]) * w
            norm += w * w
    return total / math.sqrt(norm) if norm else 0.0


def hard_negatives(rows, positives=5, negatives=10):
    known = [(i, (y + 1) % 10 if i is not None and i % 7 == 0 else y, [math.floor(256 * v) for v in x]) for i, y, x in rows if y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, label, x) in enumerate(known):
        if anchor is None or anchor % 100:
            continue
        scored = sorted([(-sum(p * q for p, q in zip(x, v, strict=True)), last(i), i, y) for k, (i, y, v) in enumerate(known) if k != a])
        for p, _, i, _ in [s for s in scored if s[3] == label][:positives]:
            fits = [s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(anchor, i, k + 1, s[2], -p, -s[0]) for k, s in enumerate(fits)]
    return out


def line_dedup(rows, letters=20, documents=3):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(UPPER) for x in (t or "").split("\n")]
    found = collections.defaultdict(set)
    for i, t in rows:
        for k in keys(t):
            if i is not None and len(k) >= letters:
                found[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if not (i is not None and len(k) >= letters and len(found[k]) >= documents and i < max(found[k]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


LETTER_RUNS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergence(rows, documents=30, terms=50):
    groups = collections.defaultdict(collections.Counter)
    holders = collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        w = LETTER_RUNS.findall((text or "").translate(UPPER))
        groups[lang or "", source or ""].update(w)
        holders[lang or ""].update(set(w))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for w, n in holders[lang].items() if n >= documents]
        counts = {s: {w: c[w] for w in kept} for (la, s), c in groups.items() if la == lang}
        counts[None] = {w: sum(c[w] for s, c in counts.items()) for w in kept}
        share = {s: {w: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for w, n in c.items()} for s, c in counts.items()}
        for s in counts:
            if s is None:
                continue
            pairs = [(t, sum(abs(share[s][w] - share[t][w]) for w in kept)) for t in counts if t not in (s, None)]
            more = [(w, share[s][w] - share[None][w]) for w in kept if counts[s][w] and share[s][w] > share[None][w]]
            for part, items, most in (("pair", pairs, None), ("term", more, terms)):
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(ordered)]
    return out


def co_train(rows, dims, rounds=3, steps=4, confident=0.95, pseudo=0.2, ridge=1e-3):
    """rows: (x, m, y or None, held). Newton steps of two logistic views that label for each other, then three small calibrated ones; sums row by row."""
    import numpy as np

    p = lambda v, b: 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(v, b))))))

    def step(beta, examples, ridge_, prior):
        g, h = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        for v, y, w in examples:
            v, q = np.array(v, dtype=float), p(v, beta)
            g += w * (y - q) * v
            h += w * q * (1 - q) * np.outer(v, v)
        return beta + np.clip(np.linalg.solve(h + ridge_ * np.eye(len(beta)), g - ridge_ * (beta - prior)), -4, 4)

    betas, teachers = [np.zeros(dims[0]), np.zeros(dims[1])], None
    for _ in range(rounds):
        for _ in range(steps):
            new = []
            for k in (0, 1):
                examples = []
                for x, m, y, held in rows:
                    v, other = (x, m) if k == 0 else (m, x)
                    if y is not None and not held:
                        examples.append((v, y, 1.0))
                    elif y is None and teachers is not None:
                        q = p(other, teachers[1 - k])
                        if q >= confident or q <= 1 - confident:
                            examples.append((v, float(q >= 0.5), pseudo))
                new.append(step(betas[k], examples, ridge * max(sum(w for *_, w in examples), 1), 0.0))
            betas = new
        teachers = betas
    priors = [np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.array([0.0, 0.5, 0.5])]
    last = priors
    for _ in range(2 * steps):
        z = [[((1.0, np.dot(x, betas[0])), (1.0, np.dot(m, betas[1])), (1.0, np.dot(x, betas[0]), np.dot(m, betas[1]))), y] for x, m, y, held in rows if y is not None and held]
        last = [step(last[k], [(v[k], y, 1.0) for v, y in z], 1.0, priors[k]) for k in range(3)]
    return [*betas, *last]

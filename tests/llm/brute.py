"""Plain versions of the queries' contracts, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def op1(docs, length=400):
    bodies = [(d, (t or "").encode()) for d, t in docs]
    counts = Counter(b[i : i + length] for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for d, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(x and (i == 0 or not gone[i - 1]) for i, x in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def op2_fingerprint(text, k=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def components(fps, ids, radius):
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= radius
    least = [None] * len(a)
    for i in range(len(a)):
        if least[i] is None:
            seen = frontier = np.arange(len(a)) == i
            while frontier.any():
                reached = near[frontier].any(0) & ~seen
                seen, frontier = seen | reached, reached
            own = [ids[j] for j in np.flatnonzero(seen) if ids[j] is not None]
            for j in np.flatnonzero(seen):
                least[j] = (min(own) if own else None,)
    return [x[0] for x in least]


def op2(docs):
    fps = [op2_fingerprint(t) for _, t in docs]
    least = components(fps, [d for d, _ in docs], 4)
    return [(d, f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, least, strict=True)]


def op3(vectors, queries, k=10):
    """``vectors`` are (id, components); a row skips itself, not its equals."""
    good = [(i, v) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in good]
    out = []
    for a, (i, v) in enumerate(q):
        if queries(i):
            found = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j) for b, (j, w) in enumerate(q) if b != a)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:k])]
    return out


def op4(docs, window=35):
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    counts = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def token_ids(docs, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for d, t in docs]


def op5(docs, capacity=2048):
    out = []
    for d, ids in token_ids(docs, 0):
        first = len(ids) % capacity or min(len(ids), capacity)
        starts = [0, *range(first, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            out.append((d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    return out


def op6(docs):
    at, out = 0, []
    for d, ids in token_ids(sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)), 2):
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def op9(docs):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    rules = [
        ("assign", rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    out = []
    for d, t in docs:
        found, counts = [], []
        for i, (kind, pattern, good) in enumerate(rules):
            own = [(m.start(), i, m.end(), kind) for m in re.finditer(pattern, t or "") if good(m)]
            counts.append(len(own))
            found += own
        out.append((d, *counts, sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found)))))
    return out


def op10(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owners = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            owners[tuple(w[k : k + window])].add(i)
    out = []
    for d, t in docs:
        w, found = words(t), set()
        hit = [False] * len(w)
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                if own := owners.get(tuple(w[k : k + n])):
                    found |= own
                    hit[k : k + n] = [True] * n
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found)))), any(hit)))
    return out


MASK = (1 << 64) - 1


def mixed(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def bucket_of(gram, buckets):
    """A polynomial modulo 2**64 over one random symbol for each byte, mixed."""
    symbols = [mixed((c + 1) * 0x632BE59BD9B4E019 & MASK) for c in gram]
    return mixed(sum(s * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, s in enumerate(symbols)) & MASK) % buckets


def op7_bag(text, buckets):
    """Share of each bucket: a word's 3- to 5-grams, its ends marked, weigh the root of its number."""
    words = Counter(re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower()))
    found = Counter()
    for word, times in words.items():
        line = b"<" + word + b">"
        for n in (3, 4, 5):
            for i in range(len(line) - n + 1):
                found[bucket_of(line[i : i + n], buckets)] += times**0.5
    total = sum(found.values())
    return {b: x / total for b, x in found.items()}


def op7_score(text, gram, bias):
    mean = sum(share * float(gram[b]) for b, share in op7_bag(text, len(gram)).items())
    return 1 / (1 + math.exp(-min(30, max(-30, mean + bias))))


def op7_known(bags, labels, least=3, errors=4.0):
    """Buckets whose share of toxic texts is ``errors`` standard errors off that of all texts."""
    rate = sum(labels) / len(labels)
    known = []
    for b in sorted({b for bag in bags for b in bag}):
        own = [y for bag, y in zip(bags, labels, strict=True) if b in bag]
        spread = math.sqrt(len(own) * rate * (1 - rate))
        if len(own) >= least and spread > 0 and abs(sum(own) - len(own) * rate) >= errors * spread:
            known.append(b)
    return known


def op7_train(bags, labels, known, dim, scale, rate, batch, epochs, least_batches, seed):
    """AdaGrad text by text in double precision: each bucket's part in the log odds, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = dict(zip(known, rng.normal(0, 0.003, (len(known), dim)), strict=True))
    weight, bias = rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    seen, seen_w, seen_b = dict.fromkeys(known, 1e-6), np.full((dim, 2), 1e-6), np.full(2, 1e-6)
    batches = max(1, len(bags) // batch)
    for _ in range(max(epochs, -(-least_batches // batches))):
        for some in np.array_split(rng.permutation(len(bags)), batches):
            grads, grad_w, grad_b = defaultdict(lambda: np.zeros(dim)), np.zeros((dim, 2)), np.zeros(2)
            for t in some:
                own = {b: scale * x for b, x in bags[t].items() if b in vectors}
                hidden = sum((x * vectors[b] for b, x in own.items()), np.zeros(dim))
                z = np.exp(hidden @ weight + bias)
                error = z / z.sum() - np.eye(2)[labels[t]]
                grad_w, grad_b = grad_w + np.outer(hidden, error), grad_b + error
                for b, x in own.items():
                    grads[b] += x * (weight @ error)
            for b, g in grads.items():
                seen[b] += (g**2).mean()
                vectors[b] = vectors[b] - rate * g / math.sqrt(seen[b])
            seen_w, seen_b = seen_w + grad_w**2, seen_b + grad_b**2
            weight, bias = weight - rate * grad_w / np.sqrt(seen_w), bias - rate * grad_b / np.sqrt(seen_b)
    return {b: scale * float(v @ (weight[:, 1] - weight[:, 0])) for b, v in vectors.items()}, float(bias[1] - bias[0])


def op8_grams(body, buckets):
    letters = b" " + re.sub(rb"[^a-z\x80-\xff]+", b" ", body.lower()).strip() + b" "
    return Counter(bucket_of(letters[i : i + 3], buckets) for i in range(len(letters) - 2)) if len(letters) > 3 else Counter()


def op8_fit(docs, buckets):
    """Languages in order, with the log share of each bucket they have, and of one they have not.

    ``docs`` are (doc_id, language, text), all of them learned from: repeats once, by the least text.
    """
    one = {}
    for d, lang, text in docs:
        if lang is not None and text is not None:
            one[d, lang] = min(one.get((d, lang), text.encode()), text.encode())
    counts = defaultdict(Counter)
    for (_, lang), body in one.items():
        counts[lang] += op8_grams(body, buckets)
    model = {}
    for lang, own in sorted(counts.items()):
        total = sum(own.values()) + 0.5 * buckets
        model[lang] = {b: math.log((n + 0.5) / total) for b, n in own.items()}, math.log(0.5 / total)
    return model


def op8_likelihoods(html, model, buckets):
    """Log likelihoods of the text less the highest, and their posterior."""
    body = re.sub(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", b" ", (html or "").encode())
    grams = op8_grams(body, buckets)
    ll = [sum(n * own.get(b, none) for b, n in grams.items()) for own, none in model.values()]
    raised = [math.exp(x - max(ll)) for x in ll]
    return [x - max(ll) for x in ll], [x / sum(raised) for x in raised]


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def op11(rows, k=16):
    """By component: ids with whitened values; n, deviation by row, explained."""
    width = max((len(v) for _, v in rows if finite(v)), default=0)
    kept = [(i, [int(np.floor(64 * float(c))) + 1000000 for c in v] + [1000000] * (width - len(v))) for i, v in rows if finite(v)]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    keep = values > 1e-12 * values[0]
    values, vectors = values[keep], vectors[:, keep]
    own = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for _, x in kept])
    deviation = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in kept]
    return n, [i for i, _ in kept], deviation, own @ vectors / np.sqrt(values), values / (z**2).sum() * n


def op12(turns):
    """Nodes of the trie of rebuilt conversations: the columns of the query, in its order."""
    by = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(rows)] for c, rows in by.items()}
    start = lambda c: c - int(np.fmod(c, 5))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    full = {c: tuple(own.get(start(c), [])[: h[c]] + own[c][h[c] :]) for c in own}
    members = defaultdict(set)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = Counter(), Counter()
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, m in members.items():
        ends = sorted(c for c in m if full[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(children[node]), leaves[node], saved[node], sha(",".join(map(str, ends)))))
    return out


def op13(rows, cosine=0.95):
    width = max((len(v) for _, v in rows if finite(v)), default=0)
    able = [i for i, (_, v) in enumerate(rows) if finite(v) and any(v)]
    u = np.array([np.pad(np.array(rows[i][1], float), (0, width - len(rows[i][1]))) for i in able]).reshape(len(able), width)
    u /= np.abs(u).max(1, keepdims=True, initial=0)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(able))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(able)).min(1, initial=len(able)))
        if np.array_equal(least, label):
            break
        label = least
    ids = defaultdict(list)
    for i, g in zip(able, label, strict=True):
        if rows[i][0] is not None:
            ids[g].append(rows[i][0])
    of = {i: (int(n), min(ids[g], default=None)) for i, n, g in zip(able, near.sum(1), label, strict=True)}
    out = []
    for i, (vec_id, _) in enumerate(rows):
        n, least = of.get(i, (0, vec_id))
        out.append((vec_id, n, least, vec_id is not None and least == vec_id))
    return out

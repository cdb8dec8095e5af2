"""Plain Python versions of the operators, for comparison."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(text, width=3):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    """Least key reachable by `linked` pairs."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def removed_lines(docs, min_words):
    """{id: deleted lines with words}: those of any run of min_words words whose worded lines occur before, in (id, line) order."""
    seqs = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in docs}
    first, gone = {}, {d: set() for d, _ in docs}
    for d in sorted(seqs):
        s = seqs[d]
        for a in range(len(s)):
            words = 0
            for b in range(a, len(s)):
                words += len(WORD.findall(s[b][1]))
                if words < min_words:
                    continue
                run = tuple(x for _, x in s[a : b + 1])
                if first.setdefault(run, (d, a)) != (d, a):
                    gone[d].update(i for i, _ in s[a : b + 1])
    return gone


def rules(text):
    from collections import Counter

    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, cov = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            cov |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(cov) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cov), failed


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and luhn(d)
        return kind != "phone" or 10 <= len(d) <= 15

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(kind, m[0])]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Per source the words to take: `share` of all words split by weight, none above `most` times its size, the excess reshared.

    Sources are ordered by code point, null last, and take the weights in turn. Sources without words get 0.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, rest, open_ = {}, share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
        rest -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return {s: float(out[s]) for s in order}


def statistics(text):
    """The transformed statistics of a text, counted one by one."""
    from collections import Counter
    from math import log, log1p

    raw, words = text.encode(), text.split()
    n, w = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    of = lambda s: sum(chr(b) in s for b in raw)
    letters = max(1, n - sum(b < 65 for b in raw))
    ratios = [of("#*$%&") / w, of("|<>=_~^\\{}[]") / w, of("!?") / w, of(".") / w, of(",;:") / w, of("0123456789") / n]
    ratios += [sum(65 <= b < 91 for b in raw) / letters, sum(b >= 192 for b in raw) / n, 1 - len(set(words)) / w, max(Counter(words).values(), default=0) / w]
    ratios += [(len(words) - 1 - len(set(zip(words, words[1:], strict=False)))) / (w + 50), (len(lines) - len(set(lines))) / (len(lines) + 10)]
    return [log1p(len(words)), log1p(len(text) / w), log1p(w / max(1, len(lines))), *(log(max(0, x) + 0.01) for x in ratios)]


def discriminant(vectors, classes, new, pooled, ridge):
    """Log density times prior of class 1 less that of class 0, from covariances as they are written in books."""
    import numpy as np

    x, y, new = np.array(vectors), np.array(classes), np.array(new)
    cov = {c: np.cov(x[y == c].T, bias=True) for c in (0, 1)}
    common = sum((y == c).mean() * cov[c] for c in (0, 1))
    out = {}
    for c in (0, 1):
        s = (1 - pooled) * cov[c] + pooled * common
        s = (1 - ridge) * s + ridge * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s))
        d = new - x[y == c].mean(0)
        out[c] = np.log((y == c).mean()) - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(s, d.T).T) - 0.5 * np.linalg.slogdet(s)[1]
    return out[1] - out[0]


def gram_buckets(text, buckets):
    """Buckets of a text's words and of its pairs of words, the last word's with the end."""
    import struct

    import xxhash

    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    eight = lambda v: struct.pack("<Q", v)
    pairs = [xxhash.xxh64_intdigest(eight(y), xxhash.xxh64_intdigest(eight(x), 42)) for x, y in zip(h, [*h[1:], 0], strict=False)]
    return [v & (buckets - 1) for v in h + pairs]


def added_spans(base, chosen):
    """What candidates (s, e, k), longest first at one start, add to base spans (s, e), as (s, k, e): no place twice."""
    taken, out = {i for s, e in base for i in range(s, e)}, []
    for s, e, k in sorted(chosen, key=lambda c: (c[0], -c[1], c[2])):
        at = s
        while at < e:
            if at in taken:
                at += 1
                continue
            end = at
            while end < e and end not in taken:
                taken.add(end)
                end += 1
            out.append((at, k, end))
            at = end
    return out

"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations


def blank_words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def shingles(text, k):
    w = blank_words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(docs, k, num, den):
    """docs: [(id, text)]; {id: least id that can be reached}."""
    sets = {i: shingles(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and num * len(x & y) >= den * len(x | y):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def contained(docs, items, k=5, threshold=0.8):
    out = {}
    for q, said in items:
        want = shingles(said, k)
        n = min(k, len(blank_words(said)))
        for i, text in docs:
            have = shingles(text, n) if len(blank_words(text)) >= n else set()
            if want and len(want & have) >= threshold * len(want) - 1e-9:
                out[i, q] = len(want & have)
    return out


def secret_base(text):
    out = []
    text = text or ""
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text):
    """[(kind, start, end)] by kind, then start."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


def quality_base(text):
    text = text or ""
    w = [x.decode() for x in text.encode().split()]
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {j + k for j in range(len(w) - 2) for k in range(3) if runs[w[j], w[j + 1], w[j + 2]] > 1}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def water_fill(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    """{source: target} by repetition: share out by weight, fix what is above its cap, share out again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while open_:
        each = left / sum(w[s] for s in open_)
        full = {s for s in open_ if each * w[s] > epochs * sizes[s]}
        for s in full or open_:
            target[s] = epochs * sizes[s] if full else each * w[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


def language_model(labelled, bits=15, smoothing=0.5):
    """{language: {bucket: log probability}} and the one of unseen buckets, by plain counting of character 1- to 3-grams."""
    from math import log

    counts = {}
    for text, lang in labelled:
        counts.setdefault(lang, Counter()).update(grams(text, bits))
    counts = {lang: c for lang, c in counts.items() if c}
    total = {lang: c.total() + smoothing * 2**bits for lang, c in counts.items()}
    return {lang: ({b: log((n + smoothing) / total[lang]) for b, n in c.items()}, log(smoothing / total[lang])) for lang, c in counts.items()}


def grams(text, bits=15):
    """The hash bucket of every n-gram of up to three characters that starts or ends with a letter; others count as blanks."""
    mult, mask = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), 0xFFFFFFFF
    codes = [ord(c) if c.isalpha() else 0x20 for c in (text or "").lower()]
    for order in (1, 2, 3):
        for i in range(len(codes) - order + 1):
            if codes[i] != 0x20 or codes[i + order - 1] != 0x20:
                h = 0
                for k in range(order):
                    h = ((h ^ codes[i + k]) * mult[k]) & mask
                    h ^= h >> 15
                yield ((h * mult[0]) & mask) >> (32 - bits)


def language(text, model):
    """(label, posterior) under equal priors."""
    from math import exp

    if not any(c.isalpha() for c in text or "") or not model:
        return "und", 0.0
    n = Counter(grams(text))
    ll = {lang: sum(m * seen.get(b, unseen) for b, m in n.items()) for lang, (seen, unseen) in model.items()}
    best = max(sorted(ll), key=ll.get)
    return best, 1 / sum(exp(x - ll[best]) for x in ll.values())

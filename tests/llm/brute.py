"""Plain versions of the operators, written from their definitions, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    m = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    return (*m, m[0] < 10 or 100 * m[4] > 20 * m[0])


def fingerprint(text):
    import xxhash

    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(docs):
    """{row index: component id} of (id, text) rows."""
    fp = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return fp, [least.get(find(i)) for i in range(len(docs))]


def cut(docs, match=100):
    """{id: (kept bytes, removed, spans)} of (id, text) rows with distinct ids."""
    first, out = set(), {}
    for k, t in sorted((k, t or "") for k, t in docs):
        b = t.encode()
        mark = bytearray(len(b))
        for i in range(len(b) - match + 1):
            w = b[i:i + match]
            if w in first:
                mark[i:i + match] = b"\1" * match
            first.add(w)
        out[k] = (bytes(x for x, m in zip(b, mark, strict=True) if not m), sum(mark), len(re.findall(rb"\x01+", bytes(mark))))
    return out


def cut_digest(docs):
    return {k: (len((dict(docs)[k] or "").encode()), n, s, hashlib.sha256(b).hexdigest()) for k, (b, n, s) in cut(docs).items()}


UNITS = set("kg g mg lb lbs oz ton tons km m cm mm mile miles foot feet inch inches yard yards l ml litre litres liter liters "
            "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros "
            "pound pounds cent cents percent degree degrees".split())


SPELT = ("two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|"
         "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion")


def template(text):
    """(template token, slot value or None, number of its first word) of a text."""
    out, at, before, end, last = [], 0, "", -1, ""
    t = text or ""
    for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t):
        w = m[0]
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
        digits, spelt = bool(re.search("[0-9]", w)), re.fullmatch(SPELT, low) is not None
        kind = "d" if digits else "s" if spelt else "u" if before in ("d", "s") and low in UNITS else "n" if w[0] < "\U00010000" and (w[0].isupper() or w[0].istitle()) else ""
        gap = t[end:m.start()] if end >= 0 else ""
        if kind and kind == before and gap in {"d": (",", "."), "s": (" ", "-"), "n": (" ", "-", "'")}.get(kind, ()):
            out[-1] = (out[-1][0], out[-1][1] + gap.lower() + w.lower(), out[-1][2])
        else:
            tag = {"d": "1", "s": "1", "u": "3", "n": "2"}.get(kind)
            out.append((f"<{tag}>", tag + w.lower(), at) if kind else (low, None, at))
        before, end, at = kind, m.end(), at + 1
    return out


def leaks(docs, items, window=6, share=0.3):
    """{(doc id, item id): (windows, found)}"""
    out, known = {}, {}
    for item, it in items:
        q = template(it)
        size = min(window, len(q))
        keep = [i for i in range(len(q) - size + 1) if sum(s is None for _, s, _ in q[i:i + size]) >= (2 if size == window else 1)] if size else []
        for i in keep:
            known.setdefault(tuple(x for x, _, _ in q[i:i + size]), []).append((item, i, [s for _, s, _ in q[i:i + size]], len(keep)))
    for k, t in docs:
        d, hits = template(t), {}
        for size in {len(w) for w in known}:
            for j in range(len(d) - size + 1):
                for item, i, slots, n in known.get(tuple(x for x, _, _ in d[j:j + size]), ()):
                    pairs = [(a, b) for a, (_, b, _) in zip(slots, d[j:j + size], strict=True) if a]
                    hits.setdefault((item, n), []).append((j - i, i, pairs))
        for (item, n), found in hits.items():
            good = set()
            for shift in {h[0] for h in found}:
                pairs = {p for s, _, ps in found if s == shift for p in ps}
                left, right = Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
                good |= {i for s, i, ps in found if s == shift and all(left[a] == 1 and right[b] == 1 for a, b in ps)}
            if good and len(good) >= share * n:
                out[k, item] = (n, len(good))
    return out


def best_tokens(piece, scores):
    """(score, tokens) of the best segmentation; of equal scores the one with the longest last token."""
    best = [(0, 0)]
    for end in range(1, len(piece) + 1):
        options = [(best[s][0] + scores[piece[s:end]], best[s][1] + 1) for s in range(end) if piece[s:end] in scores]
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1]

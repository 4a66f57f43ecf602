"""Small tables with everything that may go wrong, and brute-force versions of the operators."""

import hashlib
import random
import re
import zlib

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, label string, k string"


def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(5)
    words = ["ab" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(300)]
    long_text = " ".join(rng.choice(words) for _ in range(60_000))
    base = [rng.choice(words) for _ in range(120)]
    near = [*base[:118], "zz", "yy"]
    rows = [
        (1, " ".join(base), "en", "s1"), (2, " ".join(near), "en", "s1"), (3, "  ".join(base), "en", "s1"), (4, None, "en", "s2"), (5, "", None, None), (6, " \t\n", "de", "s2"),
        (7, "one two three", "de", "s2"), (8, "ONE two\nthree", "de", "s3"), (9, long_text, "en", "s3"), (10, "12 34 56", "de", "s3"), (None, "no id here at all", "en", "s1"),
        (11, "<|endoftext|> ünï 中文  x", "de", None), (7, "one two three", "de", "s2"), (12, "mail a.b@c.de or +49 (30) 123456-78 now", "de", "s3"),
    ]
    return spark.createDataFrame([(*r, None, 0.5, 3, "x", None) for r in rows], ODD), rows


def no_docs(spark):
    return spark.createDataFrame([], ODD)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute_components(rows, k, percent):
    """Smallest id reachable for each row; rows of one id are one document."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [(d, len(s), None if d is None else find(d)) for d, s in sets]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    text, spans = text or "", []
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for order, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                spans.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text):
    return zlib.crc32((text or "").encode())

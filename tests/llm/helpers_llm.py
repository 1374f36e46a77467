"""Tables and plain-Python versions that the tests of this folder share."""

import re
from itertools import combinations

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, row string, __key string"


def odd_documents(spark):
    """Null and empty texts, a null id, a repeated row, equal texts, a very long text, and columns with clashing names."""
    long = "mot " * 50_000 + "token = \"0123456789abcdef0123456789abcdef\" fin. " + "là-bas\n" * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "un deux trois quatre"), (4, "un deux trois quatre"), (4, "un deux trois quatre"), (5, long), (None, None), (6, "seul")]
    return spark.createDataFrame([(i, t, "fr" if i != 6 else None, None if i == 5 else "s", None, 7, "r", "k") for i, t in rows], DOCS)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow_components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def near_copies_of(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    near = [(a, b) for a, b in combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return slow_components(near, sets)

"""Plain computations that several tests compare with."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    """Words after lowering A-Z alone."""
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(n, links):
    """Smallest member's number of each of n nodes, by repeated lowering."""
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def similar_pairs(sets, percent=80):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def documents(spark, rows, more=True):
    """Rows (doc_id, text, lang, source) as the documents table, with columns whose names clash with internal ones."""
    df = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if more:
        for name in ("id", "label", "size", "rank", "token", "mark", "comp", "target", "taken", "bucket", "payload", "h"):
            df = df.selectExpr("*", f"'x' as {name}")
    return df

"""Documents with the awkward cases every operator must take, and the plain forms operators are tested against."""

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, key string"


def words(text):
    return WORD.findall(text or "")


def awkward():
    """Null and empty texts, ties, repeated rows, near copies in a chain, a long text, columns with clashing names."""
    base = [f"w{i % 83}x{i % 7}" for i in range(300)]
    near = [" ".join(base[:k] + ["zap"] + base[k + 1 :]) for k in (10, 150, 290)]
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "one two", "a"), (5, "one two", "b"), (5, "one two", "b"), (None, "one two", "b"), (6, "One TWO three four five", "a"), (7, "one two three four five", "a")]
    rows += [(10, " ".join(base), "a"), (11, near[0], "b"), (12, near[1], "a"), (13, near[2], None), (14, " ".join(base).upper(), "a")]
    rows += [(20, " ".join(f"q{i}" for i in range(40_000)), "a"), (21, "é ü 中文 x\n" * 30, "c"), (22, "same line here\n" * 40, "c"), (23, "\x85 odd \x1c chars ### $$$ <b> & | % * " * 9, "c")]
    return [(d, t, "en", s, len(t or ""), 0, "k") for d, t, s in rows]


def documents(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """{row index: (n_shingles, component_id)} by comparing all pairs of sets that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    seen = Counter()
    for i, s in enumerate(sets):
        together = Counter(j for x in s for j in at[x] if j > i)
        for j, n in together.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
        seen[i] = len(s)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            ids[root(i)].append(d)
    return [(seen[i], (min(ids[root(i)]) if ids[root(i)] else None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def crc(text):
    return zlib.crc32((text or "").encode())

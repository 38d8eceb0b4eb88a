"""Plain Python version of the pipeline's stages before the last."""

import itertools
import re

from tablebridge.llm import common, langid
from test_corpus import brute_lines

from pyspark.sql import functions as F


def brute(spark, sf):
    docs = common.table(spark, sf, "documents")
    profiles = langid.learn_profiles(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {k: t for k, t in rows.items() if (p := profiles.predict(t))[0] != "und" and p[1] >= 0.15}
    gone = brute_lines(list(rows.items()))
    left = {}
    for k, t in rows.items():
        g = gone.get((k, t), set())
        new = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)
        if not g or new.strip(" "):
            left[k] = new
    sets = {k: set(common.word_shingles(t).tolist()) for k, t in left.items()}
    root = {k: k for k in left}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(left), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    left = {k: t for k, t in left.items() if find(k) == k}
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in common.table(spark, sf, "benchmark").collect()]
    return {k: t for k, t in left.items() if not any(overlap(re.findall(r"[^\W_]+", (t or "").lower()), i) for i in items)}


def overlap(doc, item):
    """A stretch along some diagonal whose equal tokens outweigh the others by enough, and that a seed finds."""
    n = len(item)
    at = {}
    for j, w in enumerate(item):
        at.setdefault(w, []).append(j)
    for diag in {i - j for i, w in enumerate(doc) for j in at.get(w, ())}:
        hit = [0 <= j + diag < len(doc) and doc[j + diag] == item[j] for j in range(n)]
        seed = any(all(hit[j + d] for d in m) for j in range(n - 7) for m in ((0, 1, 2, 4, 5, 7), (0, 2, 3, 4, 6, 7)) if 0 <= j + diag and j + diag + 8 <= len(doc))
        now = best = 0
        for j in range(n):
            if 0 <= j + diag < len(doc):
                now = max(0, now + (1 if hit[j] else -1))
                best = max(best, now)
        if seed and best >= min(12, max(8, -(-6 * n // 10))):
            return True
    return False

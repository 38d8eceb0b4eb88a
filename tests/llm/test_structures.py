"""Prefix trie of conversations, source mix and divergence audit against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablebridge.llm import convtrie, divergence, mixing

CONVS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string"


def brute_trie(rows):
    convs, members = defaultdict(list), defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0), r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), x))
    for v in convs.values():
        v.sort()
    for c in convs:
        h, first = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        seq = [(r, x) for _, r, _, x in [*convs.get(first, [])[:h], *convs[c][h:]]]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq)))
    below, sums, out = defaultdict(list), {}, []
    for s in members:
        if s:
            below[s[:-1]].append(s)
    for s in sorted(members, key=len, reverse=True):
        m, kids = members[s], below[s]
        sums[s] = (sum(sums[k][0] for k in kids) or 1, (len(m) - 1) * (len(s[-1][1]) if s else 0) + sum(sums[k][1] for k in kids))
        ends = ",".join(map(str, sorted(c for c, n in m if n == len(s))))
        out.append((min(m)[0], len(s), min(members[s[:-1]])[0] if s else None, len(m), len(kids), *sums[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(kind):
    rnd = random.Random(3)
    if kind == "odd":
        return [(None, 0, "user", "x"), (0, 1, "user", "a"), (0, None, None, None), (0, 1, "user", "a"), (0, 1, "bot", "é😀"), (5, 0, "user", ""), (-150, 2, "user", "n"), (-101, 2, "user", "n"), (1204, 7, "user", "lone"), (1203, 0, "user", "lone")]
    if kind == "copies":  # most conversations are one, some of these go on
        return [(c, t, "user", f"t{t}") for c in range(400) for t in range(6)] + [(c, 6, "bot", str(c % 3)) for c in range(0, 400, 7)] + [(1000 + c, t, "user", f"u{c * t}") for c in range(30) for t in range(3)]
    if kind == "long":  # one has most of the turns
        return [(200, t, "user", str(t % 5)) for t in range(3000)] + [(c, t, "user", str(t % 5)) for c in range(201, 260) for t in range(rnd.randint(1, 40))]
    return [(rnd.randint(0, 250), t, rnd.choice("ab"), rnd.choice(["", "x", "yy"])) for _ in range(900) for t in [rnd.randint(0, 10**6)]]


@pytest.mark.parametrize("kind", ["odd", "copies", "long", "random"])
def test_trie_like_brute_force(spark, kind):
    rows = talk(kind)
    df = spark.createDataFrame(rows, CONVS).withColumns({"h1": F.lit("clash"), "depth": F.lit(9), "pos": F.lit(1)}).repartition(3)
    got = sorted((tuple(r) for r in convtrie.trie(df, cap=40, levels=2).collect()), key=str)
    assert got == brute_trie(rows)


def test_trie_is_the_same_for_any_cap_and_bursts(spark):
    rows = talk("copies")
    df = spark.createDataFrame(rows, CONVS)
    turns, _ = convtrie.rebuild(convtrie.numbered(df))
    paths = turns.select("conv_id", "depth", F.xxhash64("tid").alias("h1"), F.xxhash64("tid", F.lit(1)).alias("h2"), F.lit(0).alias("p1"), F.lit(0).alias("p2"), "n", (F.col("len") - F.col("depth") + 1).alias("left"))
    few, many = (convtrie.burst(paths, cap, 4).count() for cap in (1000, 10))
    assert 0 < few < many
    whole = sorted(map(str, convtrie.trie(df, cap=10**9).collect()))
    assert whole == sorted(map(str, convtrie.trie(df, cap=1).collect()))


def test_trie_of_nothing(spark):
    assert convtrie.trie(spark.createDataFrame([], CONVS)).collect() == []
    assert convtrie.trie(spark.createDataFrame([(None, 1, "a", "b")], CONVS)).collect() == []


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """sizes by source; filled by weight, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        parts = sum(w[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else w[s] * left / parts for s in names}
        above = {s for s in names if s not in full and out[s] > most * sizes[s]}
        if not above:
            return out
        full |= above


def mixed(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(["wörd"] * rnd.choice([1, 5, 30, 200, 900])), "en", rnd.choice(["a", "B", "é", "z", None])) for i in range(900)]
    rows += [(10_000 + i, "one two\tthree\x0bfour\x1f! ?", "en", "tiny") for i in range(3)] + [(20_000, None, "en", "empty"), (20_001, " \n", "en", "empty"), (None, "null key", None, None), (None, "null key", None, None), (30_000, "w " * 9000, "en", "z")]
    return spark.createDataFrame(rows, DOCS)


def test_mix_meets_targets(spark):
    docs = mixed(spark).withColumn("size", F.lit("clash"))
    rows = mixing.mix(docs, block=16).collect()
    sources = {(r.doc_id, r.text): r.source for r in docs.collect()}
    want = {k: len(re.findall(r"[^\x20\x09-\x0D]+", k[1] or "")) for k in sources}
    assert sorted(((r.doc_id, r["size"]) for r in rows), key=str) == sorted(((k[0], want[k]) for k in [(r.doc_id, r.text) for r in docs.collect()]), key=str)
    by_id = {r.doc_id: r.source for r in docs.collect()}
    sums, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        s = by_id[r.doc_id]
        sums[s] += r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
        assert r.taken <= 3 * r["size"] and (r.taken % r["size"] == 0 if r["size"] else r.taken == 0)
    aims = brute_targets(sums)
    for r in rows:
        s = by_id[r.doc_id]
        assert r.source_size == sums[s] and math.isclose(r.target, aims[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(r.taken - r["size"] * r.target / max(1, sums[s])) < max(1, r["size"]) + 1e-6  # floor or ceiling of its factor
    for s in aims:
        assert abs(taken[s] - aims[s]) <= largest[s] / 2 + 1


def test_mix_is_the_same_again(spark):
    docs = mixed(spark)
    told = lambda df: sorted((tuple(r) for r in mixing.mix(df, block=16).collect()), key=str)
    assert told(docs) == told(docs.repartition(7).orderBy(F.desc("text")))
    assert told(docs.limit(0)) == []


def test_pairs_keep_sums_and_probabilities():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40):
        size = np.sort(rng.integers(1, 400, n))[::-1].astype(float)
        size[0] *= 20
        mean = np.zeros(n)
        for _ in range(1500):
            p, open_ = mixing.round_pairs(np.full(n, 0.3), size, rng.random(n))
            assert abs((p * size).sum() - 0.3 * size.sum()) < 1e-4 and all(x in (0, 1) for i, x in enumerate(p) if i != open_)
            mean += p
        assert np.abs(mean / 1500 - 0.3).max() < 0.06


def brute_audit(rows, min_docs=3, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source in rows]
    have, count = Counter(), Counter()
    for lang, source, terms in docs:
        have.update({(lang, t) for t in terms})
        count.update((lang, source, t) for t in terms)
    kept, groups = defaultdict(list), defaultdict(set)
    for (lang, t), n in have.items():
        if n >= min_docs:
            kept[lang].append(t)
    for lang, source, _ in docs:
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        terms = kept[lang]
        n = {s: {t: count[lang, s, t] for t in terms} for s in sources}
        everywhere = {t: sum(n[s][t] for s in sources) for t in terms}

        def p(counts, terms=terms):
            total = sum(counts.values()) + 5 * len(terms)
            return {t: 1 + 10**9 * (c + 5) // total for t, c in counts.items()}

        q = p(everywhere)
        for s in sources:
            pairs = [(sum(abs(p(n[s])[t] - p(n[o])[t]) for t in terms), o) for o in sources if o != s]
            single = [(p(n[s])[t] - q[t], t) for t in terms if n[s][t] and p(n[s])[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", single, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def audited():
    rnd = random.Random(8)
    words = ["the", "The", "été", "naïve", "x1y", "Ωmega", "öl", "😀", "zz", "a", "b", "c", "dog's"]
    rows = [(i, " ".join(rnd.choices(words, [rnd.random() for _ in words], k=rnd.randint(0, 12))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "", "é", None])) for i in range(150)]
    return rows + [(900, None, "en", "s9"), (901, "rare word", "xx", "only"), (902, "123", "xx", "other"), (903, "the " * 300, "en", "s1"), (903, "the " * 300, "en", "s1")]


@pytest.mark.parametrize("tile", [64, 2])
def test_audit_like_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "CELLS", 10)
    df = spark.createDataFrame(audited(), DOCS).withColumns({"ord": F.lit(1), "term": F.lit("clash")}).repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, min_docs=3, top=4).collect())
    assert got == brute_audit(audited(), 3, 4) and {r[0] for r in got} == {"en", "de", "", "xx"}


def test_audit_in_several_passes(spark):
    df = spark.createDataFrame(audited(), DOCS)
    assert sorted(map(tuple, divergence.audit(df, 3, pass_bytes=1).collect())) == sorted(map(tuple, divergence.audit(df, 3).collect()))
    assert divergence.audit(df.limit(0)).collect() == []


def test_transducer():
    rnd = random.Random(1)
    word = lambda least: bytes(rnd.choice(b"abc\xc3\xa9") for _ in range(rnd.randint(least, 7)))
    for n in (0, 1, 5, 3000):
        terms = sorted({word(1) for _ in range(n)})
        t = divergence.Transducer.load(divergence.Transducer.build(terms).dump())
        other = sorted({word(0) for _ in range(500)} - set(terms))
        assert list(t.terms()) == terms and t.ordinals(terms).tolist() == list(range(len(terms))) and (t.ordinals(other) == -1).all()
        # Minimal: no two states accept the same rests.
        rests = {}

        def rest(state, t=t, rests=rests):
            if state not in rests:
                at = np.flatnonzero(t.arcs // 256 == state)
                rests[state] = (bool(t.final[state]), frozenset((int(t.arcs[a] % 256), rest(int(t.target[a]))) for a in at))
            return rests[state]

        rest(t.root)
        assert len(set(rests.values())) == len(rests) == len(t.final)


def test_terms_of_a_long_text_in_slices():
    text = ("Ab1c é'Ü " * 50 + "x" * 90).encode()
    assert [w for part in divergence.terms(text, 7) for w in part] == re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower())

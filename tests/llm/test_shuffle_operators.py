"""Operators that bring rows together, against plain code; hot groups by small
limits."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from llm.cases import ROWS, clashing, documents
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftspark.llm import components, mixing, repeats, sharding, simhash
from driftspark.llm.registry import QUERIES


def roots_of(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_print(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    hs = [xxh64_intdigest(" ".join(ws[i:i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, ids):
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root, least = roots_of(len(prints), pairs), {}
    for r, i in zip(root, ids):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [least[r] for r in root]


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 301), (301, 302), (302, 300)]
    df = spark.createDataFrame([(max(p), min(p)) for p in pairs] + [(5, 5), (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 200)}, 300: 300, 301: 300, 302: 300}
    assert components.components(df.limit(0)).count() == 0


def test_masks_cover_every_pair():
    import random
    from itertools import combinations
    ms = [m % (1 << 64) for m in simhash.masks()]
    assert len(ms) == 31 and max(m.bit_count() for m in ms) < 40
    rnd = random.Random(1)
    for bits in [*rnd.sample(list(combinations(range(64), 4)), 4000), *combinations(range(64), 2)]:
        d = sum(1 << b for b in bits)
        assert any(not d & m for m in ms)


@pytest.mark.parametrize("bucket", [2048, 3])
def test_simhash_links(spark, monkeypatch, bucket):
    """Fingerprints around a few centres; small buckets take the other way."""
    import random
    from pyspark.sql import types as T
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(2)
    prints = [rnd.getrandbits(64) for _ in range(40)]
    for c in prints[:6]:
        for _ in range(12):
            x = c
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                x ^= 1 << b
            prints.append(x)
    prints += prints[:5]
    ids = [None if i % 17 == 0 else 1000 - i for i in range(len(prints))]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(zip(ids, signed, range(len(ids)))), "doc_id long, __fp long, k int").repartition(5)
    out = {r["k"]: (r["fingerprint"], r["component_id"]) for r in simhash._with_components(df, "doc_id", ["fingerprint", "component_id"]).collect()}
    want = plain_components(prints, ids)
    assert out == {k: (f"{p:016x}", c) for k, (p, c) in enumerate(zip(prints, want))}


def test_simhash_rows(spark):
    out = simhash.near_duplicates(clashing(documents(spark), ["component_id", "fingerprint"])).collect()
    prints, ids = [plain_print(r[1]) for r in ROWS], [r[0] for r in ROWS]
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == Counter(
        (i, f"{p:016x}", c) for i, p, c in zip(ids, prints, plain_components(prints, ids)))
    kept = simhash.keep_one(clashing(documents(spark), ["n"])).collect()
    groups = plain_components(prints, ids)
    assert len(kept) == len(set(groups)) and {r["doc_id"] for r in kept} == set(groups)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0 and simhash.keep_one(documents(spark, [])).count() == 0


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_print(r["text"]) for r in docs]
    want = dict(zip((r["doc_id"] for r in docs), zip((f"{p:016x}" for p in prints), plain_components(prints, [r["doc_id"] for r in docs]))))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash"](spark, sf).collect()} == want


def plain_removed(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                mark[i:i + 200] = b"\1" * 200
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        out.append((len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return out


def noisy_texts():
    import random
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(35)
    out = [text(40) + " " + passage[k:len(passage) - k] + " " + text(30) for k in range(0, 120, 9)]
    out += [other[:199], other[:200], other[:200], "ab" * 400, "x" * 1000, "x" * 205, "y" * 200, text(50) + "é" * 150, "é" * 150, None, "", passage + passage]
    out += [passage[:150] + c + passage[150:] for c in "qrs"]
    return out


@pytest.mark.parametrize("limit", [4096, 2])
def test_repeats(spark, monkeypatch, limit):
    monkeypatch.setattr(repeats, "GROUP", limit)
    monkeypatch.setattr(repeats, "BLOCK", 5000)
    texts = noisy_texts()
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "b", 2)]
    out = repeats.remove_repeats(clashing(documents(spark, rows).repartition(4), ["kept", "n_bytes"])).collect()
    got = sorted((r["n_bytes"], r["n_removed"], len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out)
    assert got == sorted(plain_removed([*texts, texts[0]]))


def test_repeats_in_pieces(monkeypatch):
    """A text longer than CHUNK has the anchors of the whole."""
    import numpy as np
    data = " ".join(t for t in noisy_texts() if t).encode()
    def of_windows(found):
        """(hash, position) for every window."""
        h, pos, lo, hi = found
        return np.repeat(h, hi - lo + 1).tolist(), np.repeat(pos, hi - lo + 1).tolist(), [k for a, b in zip(lo, hi) for k in range(a, b + 1)]

    whole = of_windows(repeats.anchors(data))
    assert whole[2] == list(range(len(data) - 199))
    assert all(k <= p <= k + 152 for k, p in zip(whole[2], whole[1]))
    monkeypatch.setattr(repeats, "CHUNK", 700)
    assert of_windows(repeats.anchors(data)) == whole


def test_maximal_repeats_by_definition():
    """All maximal repeats of aligned contexts, with all occurrences."""
    import random
    rnd = random.Random(4)
    core = bytes(rnd.choice(b"abcd") for _ in range(230))
    contexts = [bytes(rnd.choice(b"xyz") for _ in range(40 - k)) + core[k:230 - j] + bytes(rnd.choice(b"xyz") for _ in range(30))
                for k, j in ((0, 0), (0, 5), (10, 0), (10, 5), (20, 9), (0, 0))]
    # core[60] stands 60 - k bytes after the 40 - k bytes before core[k:]
    lefts = [40 - k + 60 - k for k in (0, 0, 10, 10, 20, 0)]
    found = {(n, tuple(sorted(w))) for n, w in repeats.maximal_repeats(contexts, lefts, [0] * 6)}
    want = set()
    for a in range(6):
        for b in range(a):
            # extend the aligned pair to both sides of the anchor
            i, j = lefts[a], lefts[b]
            if contexts[a][i] != contexts[b][j]:
                continue
            lo = 0
            while lo < min(i, j) and contexts[a][i - lo - 1] == contexts[b][j - lo - 1]:
                lo += 1
            hi = 0
            while i + hi < len(contexts[a]) and j + hi < len(contexts[b]) and contexts[a][i + hi] == contexts[b][j + hi]:
                hi += 1
            if lo + hi >= 200:
                s = contexts[a][i - lo:i + hi]
                places = tuple((k, lefts[k] - lo) for k in range(6) if lefts[k] >= lo and contexts[k][lefts[k] - lo:lefts[k] + hi] == s)
                want.add((lo + hi, places))
    assert found == want and want


def test_repeats_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in docs), plain_removed([r["text"] for r in docs])))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op7_repeats"](spark, sf).collect()}
    assert got == want
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def fill(sizes, weights, budget, epochs):
    """Targets by sharing the excess again and again."""
    left, target = dict(weights), {}
    while left:
        level = (budget - sum(target.values())) / sum(left.values())
        over = {s for s, w in left.items() if level * w >= epochs * sizes[s]}
        if not over:
            return target | {s: level * w for s, w in left.items()}
        for s in over:
            target[s] = float(epochs * sizes[s])
            del left[s]
    return target


@pytest.mark.parametrize("whole", [False, True])
def test_mixing(spark, whole):
    import random
    rnd = random.Random(5)
    rows = [(i % 180, "w " * rnd.choice([0, 1, 5, 40, 300]), "en", rnd.choice(["a", "a", "a", "b", "é", None, "", "tiny"]) if i else "tiny", 1)
            for i in range(400)] + ROWS
    df = documents(spark, rows).withColumns({"size": mixing.n_words(F.col("text")), "quality": F.when(F.col("doc_id") % 3 == 0, F.lit(None))
                                             .when(F.col("doc_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.lit(0.8))})
    out = mixing.mix(clashing(df, ["taken", "TARGET"]), whole=whole).collect()
    assert len(out) == len(rows) and Counter(r["size"] for r in out) == Counter(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    sizes, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (not whole or r["size"] == 0 or r["taken"] % r["size"] == 0)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= (most[s] if whole else len(rows))
    again = mixing.mix(df.repartition(7), whole=whole).select("doc_id", "size", "source", "taken").collect()
    assert Counter((r["doc_id"], r["size"], r["source"], r["taken"]) for r in out) == Counter(tuple(r) for r in again)
    assert mixing.mix(df.limit(0)).count() == 0


def test_better_documents_are_drawn_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("size"),
                                  F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.1).alias("quality"))
    n = mixing.mix(df, share=0.25).where("taken > 0").groupBy(F.col("doc_id") % 2).count().orderBy(1).collect()
    assert n[0][1] > 3 * n[1][1]


def check_shards(out, rows, n):
    assert len(out) == len(rows)
    per, slots = defaultdict(int), defaultdict(list)
    for r in out:
        per[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(per) <= set(range(n))
    return per


def test_sharding(spark):
    rows = [(i, f"text number {i} " * (1 + i % 50), "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 7}", 1) for i in range(1500)]
    rows += [(5000 + i, "copy of one text " * 20, "en", f"s{i % 5}", 1) for i in range(700)]
    out = sharding.shard_documents(clashing(documents(spark, rows), ["shard", "slot"]), n_shards=16).collect()
    per = check_shards(out, rows, 16)
    assert len(per) == 16 and max(per.values()) < 1.04 * min(per.values())
    texts = {r[0]: r[1] for r in rows}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]]) + 1 for r in out)


def test_sharding_odd_rows(spark):
    check_shards(sharding.shard_documents(documents(spark), n_shards=16).collect(), ROWS, 16)
    check_shards(sharding.shard_documents(documents(spark), target_bytes=20_000).collect(), ROWS, 10_000)
    assert sharding.shard_documents(documents(spark, []), n_shards=16).count() == 0
    same = [(1, "same", "en", "a", 4)] * 50
    check_shards(sharding.shard_documents(documents(spark, same), n_shards=4).collect(), same, 4)


def test_sharding_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op8_sharding"](spark, sf).collect()
    per, places = check_shards(out, docs, 16), defaultdict(set)
    for r in out:
        places[docs[r["doc_id"]]].add(r["shard"])
    biggest = max(len(t.encode()) for t in docs.values())
    assert max(per.values()) - min(per.values()) <= 2 * biggest
    assert sum(len(p) > 1 for p in places.values()) <= 15

"""Resampling, tokenizer alignment and the Jaccard join against plain versions."""

import math
import random
from collections import Counter
from hashlib import sha256
from itertools import accumulate
from zlib import crc32

import pytest
from cases import DOCS, ROWS, clashing, documents
from pyspark.sql import functions as F

from driftspark.llm import alignment, jaccard, resampling

WORDS = [f"w{i}" for i in range(40)]


def some_docs(n=300, seed=3):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice((5, 19, 20, 21, 80)))), "en", "a", 1) for i in range(n)]
    return rows + [(i, t, x, y, z) for (_, t, x, y, z), i in zip(rows[:n // 3], [7] * (n // 3))] + list(ROWS)


# -- resampling ------------------------------------------------------------

def plain_resample(rows, target, percent=25, n_buckets=10_000):
    def features(t):
        ws = resampling.WORD.findall((t or "").encode().lower())
        return len(ws), [crc32(g) % n_buckets for g in ws + [b" ".join(p) for p in zip(ws, ws[1:])]]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for x in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + n_buckets) / ((s[b] + 1) * (T + n_buckets)))) for b in range(n_buckets)]
    out = []
    for r in rows:
        n, f = features(r[1])
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((n, r[0], len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))))
    enough = sorted((x for x in out if x[0] >= 20), key=lambda x: (-x[4], x[1] is None, x[1] or 0))
    return out, enough[:len(enough) * percent // 100]


@pytest.mark.parametrize("pivots", [16, 1])
def test_resampling_equals_plain(spark, monkeypatch, pivots):
    monkeypatch.setattr(resampling, "PIVOTS", pivots)
    rows, target = some_docs(60 if pivots == 1 else 300), ["w1 w2 w3 w4 " * 9, None, "", "W5 w6!"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resampling.resample(clashing(documents(spark, rows), ["rank", "Score"]), bench).select(
        "n_words", "doc_id", "n_features", "weight", "score", "rank", "odd. name`s".join("``").replace("name`s", "name``s")).collect()]
    want, drawn = plain_resample(rows, target)
    assert sorted(map(repr, (r[:5] for r in got))) == sorted(map(repr, want))
    won = sorted((r for r in got if r[5] is not None), key=lambda r: r[5])
    assert [r[5] for r in won] == list(range(1, len(drawn) + 1))
    assert [r[:5] for r in won] == drawn
    assert {r[6] for r in got} == {7}


def test_resampling_of_nothing(spark):
    bench = spark.createDataFrame([], "text string")
    assert resampling.resample(documents(spark, []), bench).collect() == []
    got = resampling.resample(documents(spark, [(1, None, "en", "a", 0), (2, "few words", "en", "a", 0)]), bench).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 0, None), (2, 3, None)]


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000])
def test_kth_key_of_equal_scores(spark, k):
    keys = spark.range(1000).select(F.struct((F.col("id") % 3).alias("score"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("ident"), "id").alias("key"))
    rows = sorted(((i % 3, i if i % 2 == 0 else None, i) for i in range(1000)), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    assert tuple(resampling.kth_key(keys, k)) == rows[k - 1]


# -- alignment -------------------------------------------------------------

@pytest.fixture(scope="module")
def cutter():
    files = []
    for name in (alignment.FILE_A, alignment.FILE_B):
        path = f"{alignment.FOLDER}/{name}"
        try:
            with open(path, "rb") as f:
                files.append(f.read())
        except FileNotFoundError:
            pytest.skip(f"no {path}")
    return alignment.Cutter(*files)


ODD = ["  a  b\n\n\tc ", "'s don't I'LL", "x" * 3000, "漢字 テスト \U0001f600", "a▁b", "<|endoftext|> hi </s> <s> <unk> <0x0A>", "\x00\x01 nul",
       " ", "\n", "é́ ß", "12345 678,9", "\r\n\r\n x"]


def plain_groups(x, y, ends_a, ends_b):
    out, i, j = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        a, b = [], []
        while i < len(x) and ends_a[i] <= e:
            a.append(x[i])
            i += 1
        while j < len(y) and ends_b[j] <= e:
            b.append(y[j])
            j += 1
        out.append((a, b))
    return out


def plain_align(cutter, texts):
    each = []
    for t in texts:
        x = cutter.a.encode(f" {t}", add_special_tokens=False).ids if t else []
        y = cutter.b.encode(t) if t else []
        if t and not b"".join(cutter.bytes_a[i] for i in x) == f" {t}".encode() == b"".join(cutter.bytes_b[i] for i in y):
            x, y = [], []
        ea, eb = list(accumulate(len(cutter.bytes_a[i]) for i in x)), list(accumulate(len(cutter.bytes_b[i]) for i in y))
        links = Counter()
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                if max(ea[i] - len(cutter.bytes_a[a]), eb[j] - len(cutter.bytes_b[b])) < min(ea[i], eb[j]):
                    links[a, b] += 1
        each.append((x, y, plain_groups(x, y, ea, eb), links))
    count = Counter(p for e in each for p in e[3])
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for x, y, groups, links in each:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((len(x), len(y), len(groups), sum(links.values()), sum(n for (a, b), n in links.items() if count[a, b] == best[a]),
                    sum(n * count[p] for p, n in links.items()), sha256(text.encode()).hexdigest() if x else ""))
    return out


def test_alignment_equals_plain(spark, cutter):
    texts = [t for t in [r[1] for r in ROWS] + ODD + ["the cat, the hat and unbelievableness"] * 3 if t is None or len(t) < 4000]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    want = {i: w for i, w in enumerate(plain_align(cutter, texts))}
    df = clashing(documents(spark, rows), ["n_a", "Best", "count_sum"]).repartition(5)
    for sent in (10 ** 6, 0):  # arrays in every task, join
        got = alignment.align(df, sent=sent)
        assert got.columns[-7:] == ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and "text" in got.columns
        assert {r.doc_id: tuple(r)[-7:] for r in got.collect()} == want
    assert alignment.align(documents(spark, [])).collect() == []


def test_quick_encoder_equals_tokenizers(cutter):
    assert cutter.quick is not None
    for t in ODD + [r[1] for r in ROWS if r[1]]:
        assert cutter.cut_a([t]) == [cutter.a.encode(t, add_special_tokens=False).ids], t[:40]


def test_runs_skip_along_the_diagonal():
    rnd = random.Random(5)
    for _ in range(300):
        size = rnd.randrange(1, 200)
        p, q = rnd.random(), rnd.random()
        a = [i for i in range(1, size) if rnd.random() < p] + [size]
        b = [i for i in range(1, size) if rnd.random() < (q if rnd.random() < 0.5 else p)] + [size]
        got = alignment.groups(a, b)
        both = sorted(set(a) & set(b))
        assert [a[i] for i in got[0]] == both == [b[j] for j in got[1]]
    same = list(range(1, 100_000))
    assert alignment.groups(same, same) == (list(range(99_999)),) * 2


# -- Jaccard join ----------------------------------------------------------

def plain_components(rows):
    def words(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [words(r[1]) for r in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                top[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(repr((r[0], len(s), least.get(root(i)) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets)))


def near_copies(seed, groups=12, copies=25):
    rnd = random.Random(seed)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(None if i % 9 == 4 else 1000 - i, t, "en", "a", 1) for i, (_, t, *_) in enumerate(ROWS)]
    for g in range(groups):
        base = [f"g{g}x{rnd.randrange(400)}" for _ in range(rnd.choice((3, 5, 6, 12, 60, 200)))]
        if g % 3 == 0:
            base = shared.split() + base
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 5))):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(10 ** 6)}"
            rows.append((len(rows) + 2000, " ".join(words).title() if rnd.random() < 0.2 else " ".join(words), "en", "b", 1))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("bucket", "block"), [(128, 1 << 18), (4, 300), (1, 50)])
def test_jaccard_equals_plain(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(bucket)
    got = jaccard.near_duplicates(clashing(documents(spark, rows), ["component_id", "N_shingles", "node"]).repartition(6))
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got.collect()) == plain_components(rows)
    assert "node" in got.columns and "text" in got.columns


def test_jaccard_prefixes_share_the_matches():
    rnd = random.Random(9)
    import numpy as np

    for _ in range(200):
        universe = np.array(rnd.sample(range(10 ** 6), 900), np.int64)
        n = rnd.randrange(1, 300)
        base = rnd.sample(range(900), n)
        sets = []
        for _ in range(2):
            s = set(base)
            for _ in range(rnd.randrange(0, n // 8 + 2)):
                s.discard(rnd.choice(base))
                s.add(rnd.randrange(900))
            sets.append(np.sort(universe[sorted(s)]))
        both = len(np.intersect1d(*sets))
        if 100 * both < 80 * (len(sets[0]) + len(sets[1]) - both):
            continue
        freq = {int(t): rnd.randrange(2, 50) for t in universe}
        found = []
        for s in sets:
            looked = s[:len(s) - jaccard.share(65, len(s)) + 1]
            # some that the other lacks are of one node only, the others of more
            kept = looked[np.isin(looked, sets[0]) & np.isin(looked, sets[1]) | (looked % 3 > 0)]
            found.append(jaccard.prefix(len(s), kept, np.array([freq[int(t)] for t in kept])))
        assert len(np.intersect1d(found[0][0], found[1][0])) >= min(found[0][1], found[1][1])


def test_jaccard_of_nothing(spark):
    assert jaccard.near_duplicates(documents(spark, [])).collect() == []
    assert jaccard.near_duplicates(documents(spark, []).limit(0)).columns == [*DOCS.names, "n_shingles", "component_id"]

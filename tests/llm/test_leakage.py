import random

from weftline.llm import leakage as L

from ..conftest import rows


def brute(doc, item, m):
    d, i = L.words(doc), L.words(item)
    grams = {tuple(i[k : k + m]) for k in range(len(i) - m + 1)}
    return any(tuple(d[k : k + m]) in grams for k in range(len(d) - m + 1))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    items = [(n, " ".join(r.choice(vocab) for _ in range(r.choice([3, 12, 25])))) for n in range(8)]
    docs = []
    for n in range(60):
        t = [r.choice(vocab + ["x", "y", "z"]) for _ in range(30)]
        if n % 2:
            w = r.choice(items)[1].split()
            a = r.randrange(0, 4)
            t[10:10] = [x.upper() for x in w[a : a + r.randrange(1, 24)]]
        docs.append((n, r.choice([" ", ", ", "-", "\n"]).join(t)))
    return docs, items


def test_against_brute_force(spark):
    for seed, m in ((1, 12), (2, 5)):
        docs, items = corpus(seed)
        d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
        i = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, doc_id string")
        want = sorted((a, b) for a, t in docs for b, u in items if brute(t, u, m))
        for hot in (10_000, 1):  # every window may be hot
            assert rows(L.tile_matches(d, i, least=m, least_hot=hot), "doc_id", "item_id") == want
        assert want


def slow_tiles(doc, item, m):
    """Tiling by definition: all free matches, the longest and earliest marked."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for p in range(len(item)):
                k = 0
                while d + k < len(doc) and p + k < len(item) and doc[d + k] == item[p + k] and d + k not in used_d and p + k not in used_i:
                    k += 1
                best = min(best, (-k, d, p))
        k, d, p = -best[0], best[1], best[2]
        if k < m:
            return out
        out.append((d, p, k))
        used_d |= set(range(d, d + k))
        used_i |= set(range(p, p + k))


def test_tiles_against_definition():
    r = random.Random(3)
    for n in range(120):
        vocab = "abcdefgh"[: r.randrange(1, 9)]
        doc, item = [[r.choice(vocab + "xyz") for _ in range(r.randrange(0, 30))] for _ in "12"]
        item = [w for w in item if w in vocab]
        m = r.randrange(1, 5)
        assert L.tile(doc, item, m) == slow_tiles(doc, item, m), (doc, item, m)


def test_reordered_passages_are_covered():
    a = [f"a{i}" for i in range(20)]
    assert sorted(t[2] for t in L.tile(a[10:] + ["zzz"] + a[:10], a, 5)) == [10, 10]
    # tiles never overlap, and the longest is taken first
    t = L.tile(a[:8] + a[5:18], a, 5)
    assert max(x[2] for x in t) == 13 and sum(x[2] for x in t) <= 20


def test_one_word_over_and_over():
    import time

    t = time.time()
    assert L.tile(["x"] * 100_000, ["x"] * 300, 12) == [(0, 0, 300)]
    assert time.time() - t < 5


def test_windows():
    texts = ["a b c d e", None, "", "b c d", "x a b c", "A-b;C"]
    got = [(int(i), int(h)) for at, hs in L.windows(texts, 3) for i, h in zip(at, hs)]
    by = {}
    for i, h in got:
        by.setdefault(h, []).append(i)
    assert sorted(map(sorted, by.values())) == [[0], [0, 3], [0, 4, 5], [4]]
    old, L._CHUNK = L._CHUNK, 2
    try:
        assert [(int(i), int(h)) for at, hs in L.windows(texts, 3) for i, h in zip(at, hs)] == got
    finally:
        L._CHUNK = old
    assert L._BASE * L._INVERSE % (1 << 64) == 1


def test_odd_texts(spark):
    text = " ".join(f"t{i}" for i in range(12))
    docs = [(1, None), (2, ""), (3, text.replace(" ", " . ")), (4, "ü".join(text.split())), (None, text), (5, ("x " * 200_000) + text), (6, " ".join(text.split()[:11])), (3, text)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([("i", text), ("i", text), ("n", None), (None, text), ("e", ""), ("i", "other words here")], "item_id string, text string")
    got = L.tile_matches(d, items)
    assert rows(got.select("doc_id", "item_id").distinct()) == [(3, "i"), (4, "i"), (5, "i")]
    assert L.tile_matches(d, items.where("item_id = 'e'")).collect() == []
    assert L.tile_matches(d, items.limit(0)).collect() == []
    assert L.tile_matches(d.limit(0), items).collect() == []

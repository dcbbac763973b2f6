"""Passages, near duplicates and leaks against plain Python."""

from __future__ import annotations

import hashlib
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from readloom.llm import decontaminate, neardup, substring
from readloom.llm.vecwords import blocks, words
from readloom.storage import Steps


def passages(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        own = (text or "").encode().split()
        gone = bytearray(len(own))
        for k in range(len(own) - 19):
            key = tuple(own[k : k + 20])
            if key in seen:
                gone[k : k + 20] = b"\1" * 20
            seen.add(key)
        kept = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out[i] = (len(own), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_passages(docs, corpus, batches):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(docs, batches).collect()}
    assert got == passages([(r[0], r[1]) for r in corpus])


def test_index_compacts_and_still_finds(spark, corpus):
    """Five batches pass FAN_IN, so the later ones meet a merged run."""
    index = substring.FingerprintIndex(spark)
    docs = spark.createDataFrame([(r[0], r[1]) for r in corpus], "doc_id long, text string")
    step, runs = len(corpus) // 5 + 1, []
    for k in range(5):
        index.ingest(docs.where(f"doc_id >= {k * step} and doc_id < {(k + 1) * step}"), docs.where(f"doc_id < {(k + 1) * step}"))
        runs.append(len(index.runs))
    assert runs == [1, 2, 3, 1, 2]
    index.close()


def test_passages_of_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.dedup(odd).collect()), key=str)
    want = [(None, 50, 0), (None, 0, 0), (1, 50, 0), (1, 50, 0), (2, 0, 0), (3, 0, 0), (4, 51, 50)]
    assert got == sorted(want, key=str)
    assert substring.dedup(none).count() == 0


def twins():
    """Two different words of 1024 letters on which a polynomial hash modulo 2**64 agrees, whatever its odd base."""
    signs = [bin(k).count("1") % 2 for k in range(1024)]
    return "".join("ab"[k] for k in signs), "".join("ba"[k] for k in signs)


def test_words_are_told_apart(spark):
    """Windows and shingles that differ in one long word are different."""
    one, two = twins()
    rest = [f"r{k}" for k in range(20)]
    rows = [(1, " ".join([*rest[:10], one, *rest[10:]])), (2, " ".join([*rest[:10], two, *rest[10:]])), (3, one), (4, two), (5, f"{one} x"), (6, f"{one} x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(df).collect()} == passages(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()} == components(rows)


def test_passages_of_rows_that_share_an_id(spark):
    """What is kept of each is its own."""
    shared = " ".join(f"s{k}" for k in range(30))
    rows = [(1, shared + " end"), (2, "a b c " + shared), (2, "d e f " + shared), (2, "a b c " + shared)]
    got = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kept = [hashlib.sha256(t.encode()).hexdigest() for t in (shared + " end", "a b c", "a b c", "d e f")]
    assert got == sorted(zip((31, 33, 33, 33), (0, 30, 30, 30), kept, strict=True))


def components(rows):
    sets = {}
    for i, text in rows:
        own = (text or "").encode().lower().split()
        sets[i] = {tuple(own[k : k + 5]) for k in range(len(own) - 4)} or ({tuple(own)} if own else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(docs, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == components([(r[0], r[1]) for r in corpus])


def chain(n, size=120, change=24, seed=3):
    """Copies of copies, each changed in a window: neighbours are linked, the ends are not alike; and copies about
    a centre that is far from the smallest id."""
    rng = random.Random(seed)
    words = [f"c{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for i in range(n):
        out.append((i, " ".join(words)))
        at = (i * change // 3) % size
        words = [f"d{rng.randrange(10**6)}" if at <= k < at + change // 3 else w for k, w in enumerate(words)]
    return out


def test_chains_and_hot_groups(spark):
    rng = random.Random(8)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    rows = chain(40)
    for i in range(1000, 1200):  # a large group, many of them just below the threshold to one another
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def test_blocks_settle_all_links(spark):
    """Every link between members of one bucket is found, whatever the block size."""
    rng = random.Random(2)
    rows = [(i, f"{' '.join(f'p{k}' for k in range(78))} {' '.join(f'q{rng.randrange(30)}' for _ in range(rng.randint(4, 24)))}") for i in range(60)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    members = spark.createDataFrame([(1, i, i) for i, _ in rows], "band long, id long, root long")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert 0 < len(want) < 60 * 59 // 2
    for block in (7, 64):
        assert {(r.a, r.b) for r in neardup.settled(members, texts, block).collect()} == want


def test_rows_that_share_an_id(spark):
    """Each keeps its own set, and the links of all are the document's, whatever their order."""
    rng = random.Random(31)
    prose = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, other = prose(60), prose(60), prose(60), prose(60)
    for rows in (
        [(1, a), (2, a + " more"), (2, other)], [(2, other), (2, a + " more"), (1, a)], [(1, other), (1, a), (2, a + " more")],
        [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (3, c), (4, c + " more"), (5, other)], [(7, a), (7, a), (7, other), (9, other + " x"), (8, a + " x"), (8, a + " x")],
    ):
        sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, (_, t) in enumerate(rows)}
        root = {i: i for i, _ in rows}
        for _ in rows:
            for x, y in combinations(range(len(rows)), 2):
                if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                    i, j = rows[x][0], rows[y][0]
                    low = min(root[i], root[j])
                    root = {k: low if r in (root[i], root[j]) else r for k, r in root.items()}
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == sorted((i, len(sets[k]), root[i]) for k, (i, _) in enumerate(rows))


def test_bands_meet_at_the_threshold():
    """Sets whose similarity is exactly 0.75 share a bucket, small or large."""
    rng = np.random.default_rng(7)
    for n in (3, 9, 60, 600):
        met = 0
        for _ in range(200):
            pool = rng.integers(0, 2**64 - 1, 4 * n, dtype=np.uint64)
            x, y = np.sort(pool[: 3 * n]), np.sort(pool)
            one, two = neardup.bands(neardup.signatures([x, y]))
            met += bool((one == two).any())
        assert met >= 199


def test_a_hot_centre(spark):
    """Every copy is linked with the smallest id; the groups' other links go through it alone."""
    rng = random.Random(5)
    base = [f"h{k}" for k in range(80)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1500):
        copy = list(base)
        copy[rng.randrange(80)] = f"t{i}"
        rows.append((i, " ".join(copy)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert {r.component_id for r in got.collect()} == {0}


def test_steps_go(spark, docs):
    """Nothing but the result stays in the shared folder."""
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    neardup.near_duplicates(docs)
    substring.dedup(docs)
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["near-duplicates", "passages"]


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 400 + k) for k in range(50)] + [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(60)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long"), Steps(spark)).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {i: got.get(i, i) for i in root} == root


def test_near_duplicates_of_odd_rows(odd, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(odd).collect()), key=str)
    want = [(None, 46, None), (None, 0, None), (1, 46, 1), (1, 46, 1), (2, 0, 2), (3, 0, 3), (4, 47, 1)]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(none).count() == 0


def test_keep_one_keeps_columns(spark, odd):
    out = neardup.keep_one(spark, odd, "")
    assert out.columns == odd.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([None, None, 1, 1, 2, 3], key=str)


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 2000):
        pool = rng.integers(0, 2**64 - 1, 2 * n, dtype=np.uint64)
        both = []
        for k in range(40):
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[: n - n // 3], pool[n : n + n // 3]]))
            both.append((neardup.signatures([a, b]), len(np.intersect1d(a, b)) / len(np.union1d(a, b))))
            pool = rng.permutation(pool * np.uint64(2 * k + 3))
        error = np.mean([(s[0] == s[1]).mean() - j for s, j in both])
        assert abs(error) < 0.08
        assert all((s != neardup._EMPTY).all() for s, _ in both)


def test_words_of_blocks():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abé \t\n\x0b\x0c\r ", k=rng.randint(0, 60))) for _ in range(200)] + [None, "", "z" * 3_000_000, "a b"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "t": texts})
    hashes, seen = {}, []
    for block in blocks([batch, batch.slice(3, 9)], 1, limit=500):
        found = words(block)
        for k in range(block.batch.num_rows):
            part = slice(found.first[k], found.first[k + 1])
            own = [block.data[a:b].tobytes() for a, b in zip(found.starts[part], found.ends[part], strict=True)]
            seen.append(own)
            for w, h in zip(own, found.hash[part].tolist(), strict=True):
                assert hashes.setdefault(w, h) == h
    assert seen == [(t or "").encode().split() for t in [*texts, *texts[3:12]]]
    assert len(set(hashes.values())) == len(hashes)


ITEMS = [
    (1, "A train leaves Boston at 60 km per hour while Anna walks home across the old bridge with 12 apples"),
    (2, "short item of words"),
    (3, "three words only"),
    (4, None),
    (5, "In the valley, Peter sold 40 sheep for 40 dollars and kept the remaining sheep behind the tall wooden fence"),
]
LEAKS = {
    10: ("Intro text. A train leaves Boston at 60 km per hour while Anna walks home across the old bridge with 12 apples. More text", {1}),
    11: ("so a train leaves Denver at 75 miles per hour while Maria walks home across the old bridge with 31 apples", {1}),
    12: ("A TRAIN LEAVES BOSTON AT 60 KM PER HOUR WHILE ANNA WALKS HOME ACROSS THE OLD BRIDGE WITH 12 APPLES", {1}),
    13: ("we saw a short item of words here", {2}),
    14: ("three words only", set()),
    15: ("In the valley, Peter sold 55 sheep for 55 dollars and kept the remaining sheep behind the tall wooden fence", {5}),
    16: ("In the valley, Peter sold 55 sheep for 70 dollars and kept some other animals near his house all winter", set()),
    17: ("An old bridge carries a train; nobody walks home with apples in Boston at this hour.", set()),
    18: (None, set()),
    19: ("", set()),
}


@pytest.mark.parametrize("limit", [500_000, 5])
def test_leaks(spark, limit):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in LEAKS.items()], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {}
    for r in decontaminate.leaks(docs, items, limit).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    want = {i: found for i, (_, found) in LEAKS.items() if found}
    assert got == want


def test_leaks_against_brute_force(spark):
    """Without placeholders: the share of an item's windows that a text holds on one diagonal, or a run of words."""
    rng = random.Random(14)
    vocabulary = ["w" + "".join(rng.choices("aeimnost", k=5)) for _ in range(40)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 12, 30, 60]))] for _ in range(30)]
    items += [items[0] + items[1], items[2][:4] * 6]  # shared windows, and one that repeats itself
    texts = []
    for _ in range(150):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        part = rng.choice(items)
        at = rng.randrange(len(part))
        own += part[at : at + rng.randint(1, 40)] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] + part[: rng.randint(0, 20)]
        texts.append(own)
    want = set()
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            n = min(8, len(item))
            total = len(item) - n + 1
            for shift in range(-len(item), len(text) + 1):
                hits = [p for p in range(len(text) - n + 1) if 0 <= p - shift < total and text[p : p + n] == item[p - shift : p - shift + n]]
                covered = sorted({p + j for p in hits for j in range(n)})
                run = longest = 0
                for x, y in zip([None, *covered], covered, strict=False):
                    run = run + 1 if x is not None and y == x + 1 else 1
                    longest = max(longest, run)
                if hits and (len(hits) >= 0.5 * total or longest >= 13):
                    want.add((d, k))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    assert 20 < len(want) < len(texts) * len(items) // 4
    for limit in (500_000, 200):
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, limit).collect()} == want


def test_hits_join_in_any_portions(monkeypatch):
    """Portions of documents change nothing, also where one document has more hits than a portion."""
    rows = pa.RecordBatch.from_pydict({"i": list(LEAKS), "t": [t for t, _ in LEAKS.values()]})
    index = decontaminate.Index()
    for k in range(30):
        index.add(k, ITEMS[0][1] + f" copy {k}")
    index.ready()
    whole = [index.leaks(b) for b in blocks([rows], 1)]
    monkeypatch.setattr(decontaminate, "JOINED", 3)
    assert [index.leaks(b) for b in blocks([rows], 1)] == whole and whole[0]


def test_whole_items_are_found(spark, docs, corpus):
    """Any item of enough words put into any text is found, and nothing else is."""
    rng = random.Random(12)
    items = [(k, " ".join("u" + "".join(rng.choices("aeimnost", k=7)) if rng.random() < 0.8 else "and" for _ in range(20))) for k in range(20)]
    rows = [(r[0], f"{(r[1] or '')} {items[r[0] % 20][1]} end" if r[0] % 4 == 0 else r[1]) for r in corpus]
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i % 20) for i, _ in rows if i % 4 == 0}


def test_leaks_of_odd_rows(spark, odd, none, tmp_path):
    items = spark.createDataFrame([(None, " ".join(f"w{i}x" for i in range(9))), (1, "")], "item_id long, text string")
    assert decontaminate.leaks(odd, items).count() == 0
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(odd, items.limit(0)).count() == 0
    items.withColumn("item_id", items.item_id).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = decontaminate.drop_leaks(spark, odd, str(tmp_path))
    assert out.columns == odd.columns and out.count() == odd.count()


def leaked(spark, item, text):
    docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(2, item)], "item_id long, text string")
    return decontaminate.leaks(docs, items).count() == 1


def test_leaks_with_names_that_begin_sentences(spark):
    item = "Tom has 3 apples. Tom buys 4 more apples. Tom gives 2 apples to Ann. How many apples does Tom have?"
    assert leaked(spark, item, "Jim has 5 apples. Jim buys 7 more apples. Jim gives 6 apples to Sue. How many apples does Jim have?")
    assert not leaked(spark, item, "Jim has 5 pears. Sue eats 7 green plums. Jim sells 6 carts to Sue. How many carts did Bob see?")


def test_leaks_of_verbatim_copies(spark):
    assert leaked(spark, ITEMS[0][1], LEAKS[12][0])
    assert leaked(spark, ITEMS[0][1], ITEMS[0][1].lower())
    assert leaked(spark, "What is 12 + 7 * 3?", "Q: what is 12 + 7 * 3? A: 33")
    assert not leaked(spark, "What is 12 + 7 * 3?", "Q: what is 13 + 7 * 3? A: 34")
    assert leaked(spark, "小明有三个苹果他又买了四个苹果现在有几个", "题目:小明有三个苹果他又买了四个苹果现在有几个。答案")
    assert not leaked(spark, "小明有三个苹果他又买了四个苹果现在有几个", "今天天气很好我们去公园看花吧")
    assert leaked(spark, "В Москве Иван купил три яблока и отдал два яблока Анне", "В МОСКВЕ ИВАН КУПИЛ ТРИ ЯБЛОКА И ОТДАЛ ДВА ЯБЛОКА АННЕ")


def test_leaks_with_a_slot_out_of_line(spark):
    words = " ".join("u" + "".join(random.Random(k).choices("aeimnost", k=6)) for k in range(60)).split()
    item = " ".join([*words[:25], "sold 40 sheep", *words[25:50], "kept 40 sheep", *words[50:]])
    assert leaked(spark, item, item.replace("kept 40", "kept 41"))
    two = "a farmer sells 3 apples and 5 pears to people at the market and then walks home"
    assert leaked(spark, two, two.replace("3", "4").replace("5", "4"))

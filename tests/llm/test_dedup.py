"""Exact, near and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from quire.llm import exact_dedup, near_dedup, substring_dedup

DOCS = "doc_id long, text string"
SPACE = re.compile(r"[\x20\x09-\x0D]")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)) if not texts or not isinstance(texts[0], tuple) else texts, DOCS)


def long_text(seed, n=30000):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefgh \n") for _ in range(n))


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        norm = SPACE.sub("", t or "")
        g = groups[norm]
        out.append((i, min(g)[1], len(g), i == min(g)[1], hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out)


EXACT = [(0, None), (1, ""), (2, " \n"), (3, "ab c"), (4, "a bc "), (5, "abc"), (6, " abc"), (7, long_text(1)), (8, long_text(1) + " "), (9, long_text(1)[:-50] + "zz"), (10, "abc"), (11, "é x"), (12, "éx")]


def test_exact_dedup_matches_brute_force(spark):
    rows = EXACT + [(100 + i, "same text") for i in range(300)]
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect())
    assert got == exact_brute(rows)


def weak(chunk):
    return bytes([len(chunk) % 2])


def test_exact_dedup_survives_colliding_fingerprints(spark):
    rows = EXACT + [(50 + i, f"text {i % 7}") for i in range(40)]
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, rows), weak).collect())
    assert got == exact_brute(rows)


def test_exact_keep_documents(spark):
    rows = EXACT + [(3, "ab c"), (3, "ab c")]
    docs = docs_of(spark, rows).selectExpr("*", "doc_id * 2 AS recipe", "'x' AS kept")
    out = exact_dedup.keep_documents(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({k for _, k, *_ in exact_brute(rows)})
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, "q"), (1, "q")], DOCS)
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(null_id).collect()} == {None}


def test_cuts_cover_the_text_and_follow_its_content():
    a = long_text(3).encode()
    ends = exact_dedup.cuts(a)
    assert ends[-1] == len(a) and ends == sorted(set(ends))
    shifted = exact_dedup.chunks_of(b"x" * 100 + a)
    assert len(set(shifted) & set(exact_dedup.chunks_of(a))) >= len(ends) - 3
    assert max(len(c) for c in exact_dedup.chunks_of(b"z" * 300_000)) <= exact_dedup.MOST


def near_brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        n = len(words)
        sets[i] = set() if not n else {tuple(words)} if n < 5 else {tuple(words[k : k + 5]) for k in range(n - 4)}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i in sets)


def family(seed, size, n=200, edits=(0, 12)):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.randrange(*edits)):
            words[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_dedup_matches_brute_force(spark):
    texts = family(1, 40) + family(2, 25, 60, (0, 4)) + family(3, 30, 400, (5, 20)) + [None, "", "a", "A", "a b c d", "A b C d", "a b c d e"]
    rng = random.Random(9)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in near_dedup.near_dedup(docs_of(spark, rows)).collect())
    assert got == near_brute(rows)


def test_near_dedup_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (3, None)], DOCS)
    docs = docs.selectExpr("*", "1 AS node", "2 AS a")
    out = near_dedup.near_dedup(docs).collect()
    assert len(out) == 5 and {(r["doc_id"], r["component_id"]) for r in out} == {(None, None), (1, 1), (2, 1), (3, 3)}
    kept = near_dedup.keep_documents(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 3]
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_block_product_equals_set_arithmetic():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 280, replace=False), rng.integers(0, 1 << 40, rng.integers(0, 30), dtype=np.uint64)])) for _ in range(50)]
    label = near_dedup.joined_rows(sets, 85)
    n = len(sets)
    want = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    want[a] = want[b] = min(want[a], want[b])
        if want == label.tolist():
            break
    assert want == label.tolist()


def test_tensored_banding_misses_few_pairs():
    m = near_dedup.tables(0.85)
    assert 2 * (1 - 0.85**2) ** m <= near_dedup.MISS
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(300):
        shared = rng.integers(0, 1 << 63, 170, dtype=np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, 15, dtype=np.uint64)]) for _ in range(2))
        x, y = (near_dedup.minhashes(s, 4 * m).reshape(-1, 2) for s in (a, b))
        hit = (x == y).all(1)
        missed += not (hit[:m].any() and hit[m:].any())
    assert missed == 0


def substring_brute(rows, window=20):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", rows[k][1] or "") for k in order}
    first = {}
    for k in order:
        for s in range(len(words[k]) - window + 1):
            at = (rows[k][0] is not None, rows[k][0] or 0, s)
            w = tuple(words[k][s : s + window])
            first[w] = min(first.get(w, at), at)
    out = []
    for k in order:
        gone = set()
        for s in range(len(words[k]) - window + 1):
            if first[tuple(words[k][s : s + window])] < (rows[k][0] is not None, rows[k][0] or 0, s):
                gone |= set(range(s, s + window))
        kept = " ".join(w for i, w in enumerate(words[k]) if i not in gone)
        out.append((rows[k][0], len(words[k]), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n_docs, shared):
    rng = random.Random(seed)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**7)}" for _ in range(n))
    return [fresh(rng.randrange(0, 40)) + " " + rng.choice(shared) + "\n" + fresh(rng.randrange(0, 40)) for _ in range(n_docs)]


def test_substring_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    shared = [" ".join(f"p{rng.randrange(300)}" for _ in range(n)) for n in (19, 20, 21, 60, 150)]
    texts = passages(1, 80, shared) + ["x y " * 60, "z " * 100, None, "", "a b c", " ".join(f"p{i}" for i in range(30))] + [" ".join(rng.choice("ab") for _ in range(200)) for _ in range(5)]
    rows = list(enumerate(texts))
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(docs_of(spark, rows)).collect()), key=str)
    assert got == substring_brute(rows)


def test_substring_dedup_with_a_passage_beyond_one_shard(spark):
    rng = random.Random(6)
    shared = [" ".join(f"p{rng.randrange(300)}" for _ in range(60))]
    texts = passages(2, substring_dedup.HEAVY + 90, shared) + [shared[0]] * 30
    rows = list(enumerate(texts))
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(docs_of(spark, rows)).collect()), key=str)
    assert got == substring_brute(rows)


def test_substring_dedup_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text + " more")], DOCS).selectExpr("*", "0 AS start", "'q' AS row")
    out = sorted((tuple(r)[:3] for r in substring_dedup.substring_dedup(docs).collect()), key=str)
    assert out == [(1, 30, 30), (1, 30, 30), (2, 31, 30), (None, 30, 0)]
    both = spark.createDataFrame([(1, text), (1, text)], DOCS)
    assert [r["n_removed"] for r in substring_dedup.substring_dedup(both).collect()] == [0, 0]
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0
    kept = substring_dedup.substring_dedup(docs, with_text=True).where("doc_id = 2").collect()[0]
    assert kept["kept_text"] == "more"


@pytest.mark.parametrize("seed", range(5))
def test_suffix_automaton_matches_naive_statistics(seed):
    rng = random.Random(seed)
    known = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(4)]
    probe = [rng.choice("abcd") for _ in range(40)]
    automaton = substring_dedup.SuffixAutomaton()
    for k in known:
        automaton.add(k)
    substrings = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
    want = [max((n for n in range(i + 2) if n == 0 or tuple(probe[i + 1 - n : i + 1]) in substrings)) for i in range(len(probe))]
    assert list(automaton.matching(probe)) == want


def test_exact_keep_documents_settles_repeated_ids_by_length(spark):
    rows = [(1, "a b"), (1, "a    b"), (1, "ab"), (2, "ab"), (None, "q"), (None, "q "), (None, "q "), (5, "zz"), (5, "yy"), (6, None), (6, "")]
    for some in (rows, rows[::-1]):
        out = exact_dedup.keep_documents(docs_of(spark, some)).collect()
        assert sorted(((r["doc_id"], r["text"] or "") for r in out), key=str) == sorted([(1, "a    b"), (None, "q "), (5, "zz"), (5, "yy"), (6, "")], key=str)


def test_exact_keep_documents_drops_copies(spark):
    rows = [(i, f"text number {i}") for i in range(200)] + [(1000 + i, "copy") for i in range(50)]
    out = exact_dedup.keep_documents(docs_of(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(200), 1000]


def test_near_dedup_joins_all_texts_of_a_doc_id(spark):
    a, b = family(11, 3, 80, (0, 2)), family(12, 3, 80, (0, 2))
    rows = [(1, a[0]), (2, a[1]), (5, a[2]), (5, b[0]), (7, b[1]), (8, b[2]), (5, None), (9, "x y z")]
    for some in (rows, rows[::-1]):
        out = near_dedup.near_dedup(docs_of(spark, some)).collect()
        assert sorted({(r["doc_id"], r["component_id"]) for r in out}) == [(1, 1), (2, 1), (5, 1), (7, 1), (8, 1), (9, 9)]
    with pytest.raises(TypeError):
        near_dedup.near_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize(("block", "large", "rounds"), [(7, 1, 2), (1000, 10**9, 0), (10, 5, 0)])
def test_near_dedup_does_not_depend_on_block_sizes(spark, monkeypatch, block, large, rounds):
    for name, value in (("BLOCK", block), ("LARGE", large), ("ROUNDS", rounds)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(100)]
    chain = []  # each is linked with the next only, so that one lead doesn't join all
    for i in range(40):
        base[i] = f"e{rng.randrange(10**6)}"
        chain.append(" ".join(base))
    rows = list(enumerate(chain + family(5, 30, 90, (0, 3))))
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in near_dedup.near_dedup(docs_of(spark, rows)).collect())
    assert got == near_brute(rows)


@pytest.mark.parametrize(("window", "heavy"), [(2, 512), (6, 1), (6, 10**9), (50, 512), (60, 2)])
def test_substring_dedup_of_any_window_and_shard_bound(spark, monkeypatch, window, heavy):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    rng = random.Random(window)
    shared = [" ".join(f"p{rng.randrange(300)}" for _ in range(n)) for n in (window - 1, window, window + 1, 150)]
    texts = passages(1, 25, shared) + ["x y " * 60, "z " * 100, None] + [" ".join(rng.choice("ab") for _ in range(200)) for _ in range(3)]
    rows = list(enumerate(texts))
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(docs_of(spark, rows), window).collect()), key=str)
    assert got == substring_brute(rows, window)


@pytest.mark.parametrize("window", [1, 61])
def test_substring_dedup_refuses_other_windows(spark, window):
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs_of(spark, [(1, "a")]), window)

"""Quality rules, toxicity and the language model against plain Python on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import ngram_lm, quality_rules, toxicity
from quire.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dups, "n_repeat_words": len(covered), "n_echoes": sum(a == b for a, b in zip(words, words[1:]))}


ODD = [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 40, "é ü ß y # * <b>", "l1 a\nl1 a\n\n\n l1 a\nl1 a", "\x0b\x0cw\r\nw\r\nw", "w" * 5000, " ".join(map(str, range(3000)))]


def random_texts(seed, n, words=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_rule_counts_match_brute_force(spark):
    texts = ODD + random_texts(1, 150, 6)
    got = {r["doc_id"]: r for r in quality_rules.rule_statistics(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_counts(t)
        assert {k: got[i][k] for k in want} == want, t


def test_quality_rules_reject_junk_and_keep_clean_rows(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    out = quality_rules.quality_rules(docs, labels)
    assert out.count() == docs.count()
    for r in out.collect():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    verdict = {q: [r["kept"] for r in out.collect() if marked.get(r["doc_id"]) == q and not r["base_failed"]] for q in (0, 1)}
    assert np.mean(verdict[1]) > 0.97 and np.mean(verdict[0]) < 0.1 and len(verdict[0]) > 0


def test_forest_equals_a_walk_of_its_trees_and_unseen_scores_leave_own_trees_out():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(60, 4))
    forest = quality_rules.Forest(rows, trees=12, size=16)

    def walk(x, tree):
        feature, cut, left, right, path = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if x[feature[at]] < cut[at] else right[at]
        return path[at]

    expected = 2 * (math.log(15) + 0.5772156649) - 2 * 15 / 16
    got, unseen = forest.score(rows), forest.score_unseen(rows)
    for i, x in enumerate(rows):
        assert got[i] == pytest.approx(2 ** (-np.mean([walk(x, t) for t in forest.trees]) / expected))
        own = [walk(x, t) for t, grown in zip(forest.trees, forest.grown_on, strict=True) if i not in grown]
        assert unseen[i] == pytest.approx(2 ** (-np.mean(own) / expected))
    assert forest.score(rows.max(0, keepdims=True) + 50)[0] > got.max()


def test_threshold_uses_both_classes():
    clean, bad = np.zeros(102), np.zeros(102)
    clean[10:40] = 100
    bad[60:90] = 5
    at = quality_rules.threshold_of(clean, bad, 0.001)
    assert 40 <= at <= 60 and abs(at - 50) <= 1
    assert quality_rules.threshold_of(clean, bad * 0, 0.001) == 40
    clean[70] = 1
    assert quality_rules.threshold_of(clean, bad, 0.001) <= 60


def test_quality_rules_edges(spark):
    texts = ODD
    docs = docs_of(spark, texts).selectExpr("*", "doc_id * 0 AS anomaly", "'k' AS kept")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_rules.quality_rules(docs, labels).collect()
    assert len(out) == len(texts) and all(r["kept"] == (not r["base_failed"]) for r in out)
    kept = quality_rules.keep_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in out)
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    null_id = spark.createDataFrame([(None, "a " * 3, None, None, None)], DOCS)
    assert quality_rules.quality_rules(null_id, labels).collect()[0]["base_failed"]


def test_toxicity_held_out_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs, labels)
    held = docs.join(labels.where("toxic IS NOT NULL").where(toxicity.held_out()), "doc_id")
    marks = {r["doc_id"]: r["toxic"] for r in held.collect()}
    out = {r["doc_id"]: r for r in toxicity.score_documents(held.drop("toxic"), model).collect()}
    assert all(r["held_out"] and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    caught = sum(out[i]["predicted"] for i, t in marks.items() if t)
    alarms = sum(out[i]["predicted"] for i, t in marks.items() if not t)
    assert caught / sum(marks.values()) > 0.85 and caught / (caught + alarms) > 0.85
    top = sorted({w for r in held.where("toxic = 1").collect() for w in toxicity.words_of(r["text"].encode())}, key=model.word)[-20:]
    common = float(np.median([model.word(w) for r in held.where("toxic = 0").limit(50).collect() for w in toxicity.words_of(r["text"].encode())]))
    for w in (w for w in top if len(w) > 6):
        for unseen in (w + b"s", w[:3] + w[4:], w[:2] + b"x" + w[2:]):
            assert model.word(unseen) > common


def test_toxicity_scores_equal_the_definition():
    rng = np.random.default_rng(4)
    for passage in (1, 2, 3, None):
        model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), -0.7, passage)
        for text in ("", "one", "Two words", "a bb ccc dddd eeeee!", "x" * 100 + " y"):
            words = [float(np.mean([model.gram_score[g] for g in toxicity.grams(w)])) for w in toxicity.words_of(text.encode())]
            n = min(passage or len(words), len(words))
            best = max((sum(words[i : i + n]) / n for i in range(len(words) - n + 1)), default=0.0) if n else 0.0
            assert model.score(text.encode()) == pytest.approx(1 / (1 + math.exp(-(best - 0.7))))


def test_toxicity_training_separates_marked_words_and_bounds_its_sample(spark):
    rng = random.Random(3)
    words = [f"plain{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + (" vilewort" if i % 4 == 0 else "") for i in range(160)]
    marks = np.array([int(i % 4 == 0) for i in range(160)])
    for passage in (2, None):
        model = toxicity.train([t.encode() for t in texts], marks, epochs=20, passage=passage)
        assert model.word(b"vilewort") > max(map(model.word, map(str.encode, words)))
        assert model.word(b"vilewortt") > model.word(b"plain7")
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(m)) for i, m in enumerate(marks)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels, sample_bytes=0).bias == -500.0
    again = [toxicity.fit(docs.repartition(n), labels, sample=20).gram_score for n in (1, 5)]
    assert (again[0] == again[1]).all()


def test_toxicity_edges(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(ODD) and all(r["score"] < 1e-9 and r["predicted"] == 0 for r in out)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    repeated = docs_of(spark, ["a b", "a b"]).selectExpr("*", "doc_id AS score")
    assert len({r["score"] for r in toxicity.toxicity(repeated, labels).collect()}) == 1


def test_toxicity_sees_every_part_of_a_long_word():
    bad = "\u574f\u8bdd\u8fde\u7bc7\u554a\u5440"
    score = np.zeros(toxicity.BUCKETS)
    score[toxicity.grams(b" " + bad.encode() + b" ")] = 100.0
    model = toxicity.Model(score, -1.0)
    clean = model.score(("\u597d" * 5000).encode())
    for at in (0, 63, 64, 70, 77, 1000, 4999):
        for filler in ("\u597d", "ab_"):
            run = (filler * 5000)[:at] + bad + (filler * 5000)[at:5000]
            assert model.score(run.encode()) > 0.5 > clean, at
    rng = random.Random(3)
    for n in (1, 64, 65, 72, 73, 500):
        word = "".join(rng.choice("abcd\u00e9\u4e2d") for _ in range(n))
        s = f"<{word}>"
        want = {zlib.crc32(s[i : i + k].encode()) % toxicity.BUCKETS for k in range(3, 7) for i in range(len(s) - k + 1)}
        parts = toxicity.words_of(word.encode())
        got = {g for p in parts for g in toxicity.grams(p)}
        wholes = {zlib.crc32(b"=" + p) % toxicity.BUCKETS for p in parts}
        assert want <= got <= want | wholes
        assert all(len(p.decode()) <= toxicity.LONGEST for p in parts) and (n > 64 or parts == [word.encode()])


def brute_model(texts, order=ngram_lm.ORDER):
    """Interpolated modified Kneser-Ney by dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        padded = b"\0" * (order - 1) + t
        counts[order].update(padded[i : i + order] for i in range(len(padded) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, c in counts.items():
        n = Counter(c.values())
        if not n[1] or not n[2]:
            cuts[k] = [0.5, 0.75, 0.75]
            continue
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2 - 3 * y * n[3] / n[2]]
        cuts[k] = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            after[k][g[:-1]].append(n)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        seen = after[k].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        cut = lambda n: cuts[k][min(n, 3) - 1]
        n = counts[k].get(gram, 0)
        return (max(n - cut(n), 0) if n else 0) / sum(seen) + sum(map(cut, seen)) / sum(seen) * p(gram[1:])

    return p


def test_language_model_matches_brute_force(spark):
    texts = [t for t in random_texts(5, 60, 12)] + ["the cat sat on the mat " * 5]
    folder = ngram_lm.train(docs_of(spark, texts))
    p = brute_model([t.encode() for t in texts if t])
    probes = texts[:20] + ["zebra 123 é", "w1 w2 zz", ""]
    got = {r["doc_id"]: r["perplexity"] for r in ngram_lm.score(docs_of(spark, probes), folder).collect()}
    for i, t in enumerate(probes):
        padded = b"\0" * 5 + t.encode()
        if not t:
            assert got[i] is None
            continue
        want = math.exp(-sum(math.log(p(padded[j : j + 6])) for j in range(len(t.encode()))) / len(t.encode()))
        assert got[i] == pytest.approx(want, rel=1e-4)
    assert sum(p(b"\0\0\0\0w" + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_language_model_edges(spark):
    docs = docs_of(spark, [None, "", "abc", "abc"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["kept"] for r in ngram_lm.quality_by_perplexity(docs, none).orderBy("doc_id").collect()] == [False, False, True, True]
    all_good = spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in ngram_lm.quality_by_perplexity(docs.selectExpr("*", "doc_id AS perplexity"), all_good).collect()}
    assert len(out) == 4 and not out[0]["kept"] and out[2]["perplexity"] == out[3]["perplexity"]
    assert ngram_lm.quality_by_perplexity(docs.limit(0), all_good).count() == 0


def test_long_text_is_scored_in_pieces_with_context():
    text = bytes(random.Random(2).randrange(97, 101) for _ in range(5000))
    whole = np.concatenate([k for _, _, k in ngram_lm.pieces_of([text])])
    old = ngram_lm.PIECE
    try:
        ngram_lm.PIECE = 700
        parts = [k for _, _, k in ngram_lm.pieces_of([text])]
    finally:
        ngram_lm.PIECE = old
    assert len(parts) > 5 and (np.concatenate(parts) == whole).all()


def test_language_model_does_not_depend_on_what_workers_hold(spark, monkeypatch):
    texts = random_texts(6, 40, 9)
    docs = docs_of(spark, texts)
    seen = set()
    for shard, held, run in ((50, 0, 1), (50, 120, 200), (10**6, 10**9, 1 << 30)):
        for name, value in (("SHARD", shard), ("HELD", held), ("RUN", run)):
            monkeypatch.setattr(ngram_lm, name, value)
        folder = ngram_lm.train(docs.where("doc_id < 25"))
        rows = ngram_lm.score(docs, folder).orderBy("doc_id").collect()
        seen.add(tuple(r["perplexity"] and round(r["perplexity"], 5) for r in rows))
    assert len(seen) == 1


def test_language_thresholds_are_quantiles_of_each_language(spark):
    rng = random.Random(9)
    words = {"en": ["the", "cat", "sat"], "de": ["der", "hund", "lag"], None: ["x1", "y2", "z3"]}
    rows = []
    for lang, known in words.items():
        for _ in range(60):
            rows.append((len(rows), " ".join(rng.choice(known) for _ in range(rng.randrange(20, 40))), lang, "s", 0))
    rows.append((len(rows), "qqq \u00df\u00df zzz kkk " * 5, "en", "s", 0))
    rows.append((len(rows), "the cat sat the cat", "fr", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(180)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in ngram_lm.quality_by_perplexity(docs, labels, 0.9).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    by_lang = {lang: sorted(out[i]["perplexity"] for i, r in enumerate(rows[:180]) if r[2] == lang and held(i)) for lang in words}
    for lang, found in by_lang.items():
        want = found[max(0, math.ceil(0.9 * len(found)) - 1)]
        got = {r["threshold"] for r in out.values() if r["lang"] == lang}
        assert len(got) == 1 and got.pop() == pytest.approx(want)
    everyone = sorted(x for found in by_lang.values() for x in found)
    assert out[181]["threshold"] == pytest.approx(everyone[math.ceil(0.9 * len(everyone)) - 1])
    assert not out[180]["kept"] and all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in out.values())

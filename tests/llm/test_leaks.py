import random

import numpy as np

from palaver.llm.leaks import Lists, Rule, best_passage, index, leak, leaked_passages, term_id, words

RNG = random.Random(3)
WORDS = [f"w{a}{b}" for a in "abcdefghijkl" for b in "mnopqrstuv"]
ITEM = " ".join(RNG.choice(WORDS) for _ in range(60))


def found(spark, texts, item=ITEM):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, equal string")
    items = spark.createDataFrame([(7, item, None), (8, None, "too short"), (9, "", "")], "item_id bigint, prompt string, reference string")
    return {r.doc_id: r for r in leaked_passages(docs, items).collect()}


def places(doc):
    where = {}
    for p, t in enumerate(doc):
        where.setdefault(t, []).append(p)
    return where


def segments(spark, texts, tokens):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    return [Lists.of(*[np.array(x) for x in r]) for r in index(docs, "doc_id", "text", tokens).collect()]


def test_the_index_holds_every_word_of_every_document(spark):
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randint(0, 30)}" for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    held = {}
    for s in segments(spark, texts, 500):
        size = np.diff(s.firsts)
        assert (size > 0).all()
        for k, d in enumerate(s.ids):
            where = s.where(k, s.terms.tolist())
            held[int(d)] = [t for _, t in sorted((p, t) for t, ps in where.items() for p in ps)]
    assert held == {i: [term_id(w) for w in words(t)] for i, t in enumerate(texts) if words(t)}


def test_phrases_equal_a_scan(spark):
    rng = random.Random(8)
    docs = [[f"v{rng.randint(0, 4)}" for _ in range(rng.randint(1, 40))] for _ in range(60)]
    (s,) = segments(spark, [" ".join(d) for d in docs], 1 << 18)
    runs = np.array([[term_id(f"v{rng.randint(0, 5)}") for _ in range(3)] for _ in range(150)], np.int64)
    ids = [[term_id(w) for w in d] for d in docs]
    want = {(k, int(s.firsts[i]) + p) for k, r in enumerate(runs.tolist()) for i, d in enumerate(ids) for p in range(len(d) - 2) if d[p : p + 3] == r}
    for most in (7, 1 << 22):
        got = [(int(k), int(p)) for row, start in s.phrases(runs, most) for k, p in zip(row, start, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_pair_is_dropped_too_early():
    rng, rule = random.Random(2), Rule(6, 6, 12, 4)
    seen = set()
    for _ in range(400):
        item = [rng.randint(1, 12) for _ in range(30)]
        keep = rng.choice((0.3, 0.8))
        doc = [x if rng.random() < keep else rng.randint(1, 40) for x in item]
        runs = []
        for d in range(-29, 30):
            k = 0
            for i in range(31):
                if i < 30 and 0 <= i + d < 30 and item[i] == doc[i + d]:
                    k += 1
                else:
                    runs += [k] if k >= rule.clean else []
                    k = 0
        found = leak(places(doc), item, rule)
        possible = bool(runs) and rule.possible(runs)
        assert possible or found is None
        seen.add((possible, found is not None))
    assert {(True, True), (False, False)} <= seen


def test_many_blocks_of_tests_and_small_segments(spark):
    rng = random.Random(12)
    items = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(40)]
    texts = [" ".join([*(rng.choice(WORDS) for _ in range(9)), *items[rng.randrange(40)].split()[4:22]]) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tests = spark.createDataFrame([(k, t, t[:5]) for k, t in enumerate(items)], "item_id bigint, prompt string, reference string")
    one = sorted(tuple(r) for r in leaked_passages(docs, tests).collect())
    many = sorted(tuple(r) for r in leaked_passages(docs, tests, block=200).collect())
    assert one == many and {r[0] for r in one} == set(range(50))


def test_words():
    assert words("<b>Soot-Stained</b> Ｃａｆé\\nthe spe-\nckled &amp; ok") == ["soot", "stained", "cafe", "the", "speckled", "ok"]
    assert words(None) == [] and words("") == []


def test_planted_passages(spark):
    w = ITEM.split()
    filler = lambda n: " ".join(f"z{RNG.randint(0, 999)}" for _ in range(n))
    altered = w[:30]
    altered[10], altered[20] = "x1", "x2"
    inserted = [*w[5:20], "quite", *w[20:30]]
    texts = [
        f"{filler(20)} {' '.join(w[3:15])} {filler(5)}",  # 12 words
        f"{filler(20)} {' '.join(w[3:14])} {filler(5)}",  # 11 words
        " ".join(altered),
        " ".join(inserted).upper().replace(" ", ",\n"),
        " ".join(reversed(w)),
        " ".join(x if k % 2 else "y" for k, x in enumerate(w)),
        None,
        "",
        f"{filler(60_000)} {ITEM}",
        ITEM,
        ITEM,
    ]
    assert set(found(spark, texts)) == {0, 2, 3, 8, 9, 10}


def test_no_documents(spark):
    assert not found(spark, [])


def test_best_passage_is_the_longest_common_run_without_alterations():
    rng = random.Random(9)
    for _ in range(60):
        a, b = ([rng.randint(1, 4) for _ in range(25)] for _ in range(2))
        longest = 0
        for i in range(25):
            for j in range(25):
                k = 0
                while i + k < 25 and j + k < 25 and a[i + k] == b[j + k]:
                    k += 1
                longest = max(longest, k)
        equal, altered, dp, ip = best_passage(places(a), b)
        assert equal - 2 * altered >= longest or equal >= longest
        assert a[dp] == b[ip]
    assert term_id("a") != term_id("b")


def test_a_clean_passage_counts_beside_a_longer_altered_one(spark):
    w = ITEM.split()
    grown = [*w[:12], "x1", *w[13:17], "x2", *w[18:22]]  # 20 equal, 2 altered: too many for the whole run
    near = [*w[30:39], "x3", *w[40:44], "x4", *w[45:49]]  # 17 equal, 2 altered, and a clean run elsewhere
    texts = [" ".join(grown), " ".join([*near, "y1", "y2", "y3", *w[3:15]]), " ".join(near)]
    got = found(spark, texts)
    assert set(got) == {0, 1} and (got[0].equal, got[0].altered) == (16, 1) and (got[1].equal, got[1].altered) == (12, 0)


def test_leak_equals_all_runs():
    """Against all runs of small texts, enumerated."""
    rng = random.Random(6)
    seen = set()
    for _ in range(300):
        item = [rng.randint(1, 9) for _ in range(12)]
        doc = [x if rng.random() < 0.75 else rng.randint(1, 9) for x in item for _ in range(rng.choice((1, 1, 1, 1, 2)))]
        rule = Rule(4, 5, 8, 3)

        def runs(i, p, equal, altered):
            yield equal, altered
            for di, dp, cost in ((1, 1, 0), (2, 2, 1), (1, 2, 1), (2, 1, 1)):
                if i + di < len(item) and p + dp < len(doc) and item[i + di] == doc[p + dp]:
                    yield from runs(i + di, p + dp, equal + 1, altered + cost)

        want = any(e >= 4 and a * (5 if e < 8 else 3) <= e for i in range(len(item)) for p in range(len(doc)) if item[i] == doc[p] for e, a in runs(i, p, 1, 0))
        assert (leak(places(doc), item, rule) is not None) == want
        seen.add(want)
    assert seen == {True, False}

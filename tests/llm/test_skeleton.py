import itertools
import random

from palaver.llm.skeleton import equal_looking_pairs, look_classes, look_groups, skeleton, with_skeleton

SAME = [("café", "café"), ("ｗｉｄｅ １２", "wide 12"), ("a​b⁠c﻿", "abc"), ("x y z", "x y z"), ("ﬁt oﬀ", "fit off"), ("раyра1", "paypa1"), ("ΑΒΕ", "ABE"), ("co‑op", "co-op"), ("K", "K"), ("a\r\nb", "a\nb"), ("soft­hyphen", "softhyphen")]
DIFFERENT = [("abc", "Abc"), ("l1", "ll"), ("0", "O"), ("cafe", "café"), ("a b", "a\nb"), ("x2", "x²"), ("word", "word too"), ("ja", "да")]


def test_same_look():
    for a, b in SAME:
        assert skeleton(a) == skeleton(b), (a, b)


def test_visible_differences_stay():
    for a, b in DIFFERENT:
        assert skeleton(a) != skeleton(b), (a, b)


def test_idempotent_on_many_characters():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x370, 0x52F), rng.randint(0x2000, 0x206F), rng.randint(0xFF00, 0xFFEF), rng.randint(0x4E00, 0x4E40)])) for _ in range(20))
        assert skeleton(skeleton(t)) == skeleton(t)
    assert skeleton(None) is None and skeleton("") == ""


def test_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["first text", "second text", "café", ""]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        rows.append((i, rng.choice([t, t, t.replace("e", "е"), t.replace(" ", " "), t + "​"]), "x"))
    rows += [(100, None, "x"), (101, None, "x"), (102, "long " * 50_000, "x"), (103, "long " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, skeleton_note string")
    want = sorted((a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] is not None and b[1] is not None and a[1] != b[1] and skeleton(a[1]) == skeleton(b[1]))
    assert sorted(tuple(r) for r in equal_looking_pairs(df).collect()) == want and want
    assert with_skeleton(df).count() == len(rows) and look_groups(df).where("look is null").count() == 2
    assert equal_looking_pairs(df.limit(0)).count() == 0


def test_classes_and_pairs_agree(spark):
    rng = random.Random(5)
    looks = ["one text", "two text", "three", "four"]
    disguise = lambda t: "".join({"e": "\u0435", "o": "\u043e"}.get(c, c) if rng.random() < 0.3 else c for c in t) + "\u200b" * rng.randint(0, 1)
    rows = [(k, disguise(rng.choice(looks)) if k % 3 else "one text") for k in range(150)] + [(200, None), (201, None), (202, ""), (203, "\u200b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, look string")
    want = {(a, b) for a, s in rows for b, t in rows if a < b and s is not None and t is not None and s != t and skeleton(s) == skeleton(t)}
    for portion in (4096, 7):
        got = [tuple(r) for r in equal_looking_pairs(df, portion=portion).collect()]
        assert set(got) == want and len(got) == len(want)
    classes = {r.doc_id: r for r in look_classes(df).collect()}
    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    assert {d: r.links for d, r in classes.items()} == links
    text = dict(rows)
    assert all(skeleton(text[r.class_id]) == skeleton(text[d]) and text[r.form_id] == text[d] for d, r in classes.items())
    assert look_classes(df.limit(0)).count() == 0

import random

from pyspark.sql import functions as F

from palaver.llm.languages import LATIN, Automaton, build, fit, label_code, normal, parse, read_conversations, sentences_of

EN = ["the cat sat on the mat and looked at the dog", "what would you do with more time in the morning", "there is no single right answer to this question", "keep a written record of every step you take", "please tell me how the weather will be tomorrow", "some people think that this is only a matter of talent"]
DE = ["die katze saß auf der matte und sah den hund an", "was würdest du mit mehr zeit am morgen tun", "es gibt nicht nur eine richtige antwort auf diese frage", "man sollte jeden schritt genau aufschreiben und behalten", "bitte sag mir wie das wetter morgen werden wird", "manche leute glauben das sei nur eine frage des talents"]
JA = ["猫がマットの上に座っていました。", "正しい答えは一つではありません。", "毎日少しずつ続けることが大切です。", "明日の天気を教えてください。"]


def brute(sample, text):
    """Greedy longest-match phrases by substring search."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_automaton_and_dense_table_equal_brute_force():
    rng = random.Random(1)
    sample = "".join(rng.choice("abc ") for _ in range(300))
    auto = Automaton(sample)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 60))) for _ in range(50)]
    want = [brute(sample, t) for t in texts]
    got = [auto.phrases(t) for t in texts]
    # a letter that never occurs is a phrase of its own in the search and the end of one in the parse
    known = [k for k, t in enumerate(texts) if "d" not in t]
    assert [got[k] for k in known] == [want[k] for k in known]
    assert LATIN.phrases(texts, [LATIN.table(auto)])[:, 0].tolist() == got


def test_labels(spark):
    rows = [("English", "en"), (" en-US ", "en"), ("GERMAN", "de"), ("zh_CN", "zh"), ("", None), ("n/a", None), ("und", None), ("Unknown", None), (None, None), ("Klingon", "klingon"), ("Scots", "sco")]
    got = spark.createDataFrame([r[:1] for r in rows], "l string").select(label_code("l").alias("c")).collect()
    assert [r.c for r in got] == [r[1] for r in rows]


def test_switch_needs_evidence():
    assert parse([(3, 9), (5, 4), (3, 9)], [True, False, False]) == [0, 0, 0]
    assert parse([(3, 9), (20, 4), (3, 9)], [True, False, False]) == [0, 1, 0]
    assert parse([], []) == []


def test_sentences():
    assert sentences_of("One. Two!\n```py\nx = 1\n```\nThree? 四。五。") == ["One.", "Two!", "Three?", "四。", "五。"]
    assert sentences_of(None) == [] and normal("Ärger, 12 Œufs!") == "arger oeufs"


def labelled(spark):
    rng = random.Random(2)
    rows = [(t, "English") for t in EN * 4] + [(t, "de-DE") for t in DE * 4] + [(t, "Japanese") for t in JA * 4]
    rows += [(rng.choice(EN), "Danish") for _ in range(8)] + [(rng.choice(EN), "German") for _ in range(3)]  # wrong labels
    rows = [(f"{t}. {k % 7} {'x' * 0}", lab) for k, (t, lab) in enumerate(rows)]
    return spark.createDataFrame(rows, "text string, language string")


def test_wrong_labels_do_not_make_languages(spark):
    model = fit(labelled(spark), "text", "language")
    assert {x.code for x in model.languages} == {"en", "de", "ja"}


def test_conversations(spark):
    model = build({"en": [normal(t) for t in EN], "de": [normal(t) for t in DE], "ja": [normal(t) for t in JA]}, 20_000)
    user, bot = "user", "assistant"
    convs = [
        [(user, EN[0] + "."), (bot, EN[2] + ".")],
        [(user, DE[1] + "?"), (bot, EN[3] + ". " + DE[2] + ".")],
        [(user, "They call it Weltschmerz over there, but there is no single right answer to this question."), (bot, None)],
        [(user, JA[0]), (bot, "")],
        [(user, "```\nx = 1\n```"), (bot, "12 34")],
        None,
        [],
        [(user, (EN[1] + ". ") * 3000)],
    ]
    df = spark.createDataFrame([(k, c, "x") for k, c in enumerate(convs)], "id int, c array<struct<role:string,content:string>>, first_language_note string")
    rows = {r.id: r for r in read_conversations(df, "c", model, ["id", "first_language_note"]).collect()}
    assert [rows[k].first_language for k in range(8)] == ["en", "de", "en", "ja", "und", "und", "und", "en"]
    assert [sorted(rows[k].languages) for k in range(8)] == [["en"], ["de", "en"], ["en"], ["ja"], [], [], [], ["en"]]
    assert [(s.message_no, s.language) for s in rows[1].segments] == [(0, "de"), (1, "en"), (1, "de")]
    assert 0 < rows[0].first_confidence <= 1
    assert read_conversations(df.limit(0), "c", model, ["id"]).count() == 0


def test_fit_without_labels(spark):
    empty = spark.createDataFrame([("x", None)], "text string, language string")
    model = fit(empty, "text", "language")
    df = spark.createDataFrame([(1, [("user", "hello there my friend")])], "id int, c array<struct<role:string,content:string>>")
    assert read_conversations(df, "c", model, ["id"]).first().first_language == "und"
    assert labelled(spark).where(F.col("language").isNull()).count() == 0

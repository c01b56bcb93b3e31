import random

from palaver.llm import answers as A
from palaver.llm.languages import build, normal

from .test_languages import DE, EN


def test_endings():
    whole = ["A sentence.", "Yes", "18", "Two points:\n- one thing\n- two things.", "```\nx = 1\n```", "It works.\n\nGood luck 😀", "Hope this helps :)", "这里没有答案。", "", "  ", "He said \"no.\""]
    broken = ["This is the first part of a", "It is done. And then we", "```python\ndef f(x):\n    retu", "Things:\n- one\n- ", "He said \"we must go.", "最简单的办法是每天进步一点不要着急另外"]
    for t in whole:
        assert A.ending(t)[0] == "whole", t
    for t in broken:
        assert A.ending(t)[0] == "broken", t


def test_empty_refusal_copy():
    for t in (None, "", "  ​", "**", "...", "<p></p>", "```\n```", "$ERROR$", "-"):
        assert A.is_empty(t), t
    assert not A.is_empty("0")
    for t in ("Sorry, no can do.", "Hmm. I cannot assist with this topic.\n", "I'm sorry, but I can't help with that request.", "Je dois refuser cette requête.", "Ich muss diese Anfrage ablehnen.", "很抱歉，我无法回答这个问题。", "**Note:** Request declined. Have a nice day!"):
        assert A.is_refusal(t), t
    for t in ("You should refuse offers that sound too good. Keep a record of every step.", "I can't give you one number, but here is how to think about it.", "No", "To decline politely, say: \"Sorry, I cannot help with that this week.\" Then go on."):
        assert not A.is_refusal(t), t
    p = "Which part of that is the most careful?"
    for t in (p, p.upper(), f"User: {p}", f'"{p}"\n\nAnswer:', p[:-1], f"{p} {p}", "Which part that is the most careful?"):
        assert A.is_copy(p, t), t
    assert not A.is_copy(p, f"{p}\n\nThe first part needs the most care, since it is easy to miss.")
    assert not A.is_copy("Correct the mistake in this sentence: Many teachers underestimate underestimate the work.", "Many teachers underestimate the work.")


def test_long_and_listed_refusals():
    wordy = "I'm sorry, but I cannot help with that request. " + "I understand why you ask this question. I am not able to discuss the topic here. " * 6 + "Thank you for your patience. Have a nice day!"
    assert len(wordy) > 400 and A.is_refusal(wordy)
    for t in ("I have to decline this request.\n\n- I cannot answer the question.\n- I am not allowed to discuss the topic.", "Sorry.\n1. I can't help with this request.\n2. I won't discuss the topic."):
        assert A.is_refusal(t), t
    assert not A.is_refusal(wordy + " The capital of France is Paris.")
    assert not A.is_refusal("I can't answer all of it. Here is what I know:\n- Paris is large.\n- Lyon is smaller.")


def test_parse_tells_what_is_open():
    closed = ["(a [b] “c” «d» „e“) \"f\"", "1) one\n2) two", "a :) b :-(", "it's 5\" wide", "```\n( [\n```\ndone.", "`(` is a bracket", "»so« und »so«", "a ) b", "Use the <div> tag here.", "<p>one<br>two</p>", "- a (b)\n  - c [d]\n\nend.", "<ul><li>a</li></ul>"]
    for t in closed:
        assert A.parse(t)[1] == [], t
    for t, want in (("He said (and\n\nmeant it.", [")"]), ("“First.\n\nSecond.", ["”"]), ("<ul>\n<li>One.</li>\n<li>Two.", ["<ul"]), ("~~~\nx", ["fence"]), ("- a\n  - (b", [")"]), ("| a [b", ["]"]), ("<!-- note", ["<!--"]), ("[{\"a\": 1}, {", ["]", "}"])):
        assert A.parse(t)[1] == want, t
    assert A.ending("<ul>\n<li>One.</li>\n<li>Two.")[0] == "broken" and A.ending("He said: \"we go.\n\nThen we left.")[0] == "broken"
    table = "\n".join(f"| {k} | (x{k}) |" for k in range(20_000))
    assert A.parse(table)[1] == [] and A.parse(table + "\n| a | (b")[1] == [")"]
    nested = "\n".join("  " * k + f"- level {k} (" + ")" for k in range(200))
    assert A.parse(nested)[1] == []


def test_refusals_need_the_first_person_and_something_declined():
    long = "I'm sorry. " + "I cannot discuss this topic here. My guidelines do not allow it. Please consult someone else. " * 25
    assert len(long) > 2000 and A.is_refusal(long) and not A.is_refusal(long + "Sourdough needs a warm place to rise.")
    for t in ("Ik kan deze vraag helaas niet beantwoorden.", "Wij kunnen u daar niet bij helpen.", "Nie mogę odpowiedzieć na to pytanie.", "I'd rather not.", "We pass on that.", "This question falls outside my scope.", "We don't write texts of that sort.", "We have been instructed to avoid it.", "No puedo ayudarle con eso.", "Non posso rispondere a questa domanda.", "Não posso responder a essa pergunta.", "Мне не разрешено отвечать на этот вопрос.", "この質問にはお答えできません。"):
        assert A.is_refusal(t), t
    for t in ("They declined the request.", "We must pass the request to the server.", "She cannot answer the question.", "I cannot find my keys.", "The committee refused to discuss the topic.", "The server cannot answer requests while it restarts.", "We do not provide breakfast on Sundays.", "Il n'existe pas de réponse unique à cette question.", "Man kann die Frage nicht eindeutig beantworten.", "Sorry."):
        assert not A.is_refusal(t), t


def test_a_prompt_given_back_any_number_of_times():
    p = "Which part of that is the most careful?"
    for n in (4, 10, 300):
        assert A.is_copy(p, " ".join([p] * n)), n
    assert A.is_copy("Why so?", "why so") and not A.is_copy("Why so?", "so why") and not A.is_copy("Hello", "Hello, how can I help?")
    long = " ".join(f"word{k}" for k in range(3000))
    assert A.is_copy(long, long + " word1") and not A.is_copy(long, " ".join(f"other{k}" for k in range(3000)))


def test_tiles_are_common_and_disjoint():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(12)] for _ in range(2))
        ts = A.tiles(a, b)
        for i, j, k in ts:
            assert a[i : i + k] == b[j : j + k] and k >= 2
        for at in (0, 1):
            used = [x for t in ts for x in range(t[at], t[at] + t[2])]
            assert len(used) == len(set(used))
        longest = max((k for i in range(12) for j in range(12) for k in range(1, 13 - max(i, j)) if a[i : i + k] == b[j : j + k]), default=0)
        assert max((k for *_, k in ts), default=0) == (longest if longest > 1 else 0)


def turns(spark, rows):
    return spark.createDataFrame(rows, "answer_id string, question_id bigint, model_id string, choice_index int, turn_index int, text string")


def test_hidden_limits(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé\n\"") for _ in range(n))
    rows = []
    for k in range(200):
        t = text(rng.randint(40, 600))
        rows.append((f"a{k}", 1, "chars", 0, 0, t[:300]))
        while len(t.encode()) > 250:
            t = t[:-1]
        rows.append((f"b{k}", 1, "bytes", 0, 0, t))
        rows.append((f"c{k}", 1, "free", 0, 0, text(rng.randint(40, 600))))
    rows.append(("n", 1, "chars", 0, 0, None))
    found = {(r.source, r.measure, r["size"]) for r in A.hidden_limits(turns(spark, rows)).collect()}
    assert ("chars", "characters", 300) in found and ("bytes", "utf8", 250) in found
    assert not [x for x in found if x[0] == "free"]


def test_limits_in_bytes_allow_for_cut_characters(spark):
    """A limit of 200 bytes that splits characters of three bytes: sizes 198 to 200 pile up together."""
    rng, rows = random.Random(6), []
    for k in range(300):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 2))) + "語" * rng.randint(20, 120)
        rows.append((f"a{k}", 1, "bytes", 0, 0, t.encode()[:200].decode(errors="ignore")))
    found = {r["size"]: r.texts for r in A.hidden_limits(turns(spark, rows)).where("measure = 'utf8'").collect()}
    assert set(found) == {200} and found[200] > 100


def test_usage_counts_each_turn_once(spark):
    from pyspark.sql import functions as F

    q = spark.createDataFrame([(1, ["one?", "two?"])], "question_id bigint, turns array<string>")
    rows = [("a", 1, "m", [(0, ["red fox.\nblue fox", "x", "beyond the prompts"])], 1.0)]
    df = spark.createDataFrame(rows * 3, "answer_id string, question_id bigint, model_id string, choices array<struct<index:int,turns:array<string>>>, tstamp double")
    looked = A.inspect(A.answer_slots(df, q), None)
    used = {r.words: tuple(r)[1:] for r in looked.where("what = 'use'").groupBy("words").agg(*[F.sum(c) for c in ("goes_on", "ends", "closes")]).collect()}
    assert used["p red fox"] == (0, 1, 0) and used["p blue fox"] == (0, 0, 1) and used["p1 fox"] == (0, 1, 1)
    assert looked.where("what = 'turn'").count() == 3 and looked.where("what = 'turn' and judged").count() == 2


def test_lengths_under_encodings(spark):
    t = 'é"\n<&😀'
    from pyspark.sql import functions as F

    for x in (t, "", "plain", "a\\b\t'c'\r\n&<>", "ß\n" * 50, "😀é" * 9):
        one = spark.createDataFrame([(x,)], "t string").select(*[m.alias(n) for n, m in A.measures(F.col("t")).items()]).first()
        assert tuple(int(v) for v in one) == A.sizes_of(x), x
    row = spark.createDataFrame([(t,)], "t string").select(*[m.alias(n) for n, m in A.measures(F.col("t")).items()]).first()
    import html
    import json

    assert row.characters == len(t) and row.utf8 == len(t.encode()) and row.utf16 == len(t.encode("utf-16-le")) // 2
    assert row.json == len(json.dumps(t, ensure_ascii=False)) - 2 and row.json_ascii == len(json.dumps(t)) - 2
    assert row.html == len(html.escape(t).replace("&#x27;", "&#39;")) and row.crlf == len(t) + 1


def test_defects(spark):
    model = build({"en": [normal(t) for t in EN], "de": [normal(t) for t in DE]}, 20_000)
    q = spark.createDataFrame([(1, [EN[1] + "?", EN[4] + "."], "x"), (2, [EN[3] + "."], "x")], "question_id bigint, turns array<string>, text string")
    full = EN[2].capitalize() + ". " + EN[0].capitalize() + "."
    rows = [
        ("a", 1, "m", [(0, [full, None])], 1.0),
        ("b", 1, "m", [(0, [full])], 1.0),
        ("c", 1, "m", [(0, [EN[1] + "?", "Sorry, no can do."])], 1.0),
        ("d", 2, "m", [(0, [DE[2].capitalize() + ". " + DE[0] + "."])], 1.0),
        ("e", 2, "m", [(0, [full + " There is no single right"])], 1.0),
        ("f", 2, "m", None, 1.0),
        ("g", 9, "m", [(0, [full])], 1.0),
        ("h", 2, "m", [(0, [full * 2000])], 1.0),
    ]
    df = spark.createDataFrame(rows, "answer_id string, question_id bigint, model_id string, choices array<struct<index:int,turns:array<string>>>, tstamp double")
    df = df.union(df)
    out = A.defects(df, q, model)
    got = {(r.answer_id, r.turn_index): r.defect_type for r in out.collect()}
    assert out.count() == len(got)
    assert got == {("a", 0): None, ("a", 1): "empty", ("b", 0): None, ("b", 1): "empty", ("c", 0): "copy", ("c", 1): "refusal", ("d", 0): "wrong_language", ("e", 0): "truncated", ("g", 0): None, ("h", 0): None}
    assert A.defects(df.limit(0), q, model).count() == 0
    cut = A.defects(df, q, None, only_cut=True).where("defect_type = 'truncated'").collect()
    assert {(r.answer_id, r.turn_index) for r in cut} == {k for k, v in got.items() if v == "truncated"}

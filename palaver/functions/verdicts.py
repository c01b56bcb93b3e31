"""Parsing and mapping of judge verdicts, labels and rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.functions.text import col, words

TIE_DELTA = 0.1
_NUMBER = r"(-?\d+(?:\.\d+)?)"


def one_score(text: Column | str) -> Column:
    """``[[r]]``, else ``[r]``, else -1."""
    t = col(text)
    double, single = F.regexp_extract(t, rf"\[\[{_NUMBER}\]\]", 1), F.regexp_extract(t, rf"\[{_NUMBER}\]", 1)
    return F.coalesce(F.when(double != "", double.try_cast("double")), F.when(single != "", single.try_cast("double")), F.lit(-1.0))


def two_scores(text: Column | str) -> Column:
    """``[[a,b]]`` or ``[a,b]`` as (score_1, score_2); -1 where there is none."""
    t = col(text)
    pick = lambda k: F.coalesce(*[F.when(F.regexp_extract(t, p, k) != "", F.regexp_extract(t, p, k).cast("double")) for p in (rf"\[\[{_NUMBER},\s?{_NUMBER}\]\]", rf"\[{_NUMBER},\s?{_NUMBER}\]")], F.lit(-1.0))
    return F.struct(pick(1).alias("score_1"), pick(2).alias("score_2"))


def score_winner(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.when((a < 0) | (b < 0), "error").when(F.abs(a - b) <= TIE_DELTA, "tie").when(a > b, "A").otherwise("B")


def verdict(text: Column | str) -> Column:
    """``[[A]]``, ``[[B]]``, ``[[C]]`` (tie), tested in this order; else error."""
    t = col(text)
    return F.when(F.contains(t, F.lit("[[A]]")), "A").when(F.contains(t, F.lit("[[B]]")), "B").when(F.contains(t, F.lit("[[C]]")), "tie").otherwise("error")


def game_winner(mark: Column | str, game: int) -> Column:
    """Seat mark to model; game 2 is played with sides swapped."""
    first, second = ("model_1", "model_2") if game == 1 else ("model_2", "model_1")
    m = col(mark)
    return F.when(m == "A", first).when(m == "B", second).when(m == "tie", "tie").otherwise("error")


def consistent(g1: Column | str, g2: Column | str) -> Column:
    return F.when(col(g1) == col(g2), col(g1)).otherwise("inconsistent")


def flip(winner: Column | str) -> Column:
    w = col(winner)
    return F.when(w == "model_1", "model_2").when(w == "model_2", "model_1").otherwise(w)


def is_tie(vote: Column | str) -> Column:
    return F.contains(col(vote), F.lit("tie"))


def same_vote(a: Column | str, b: Column | str) -> Column:
    """Equal votes; two ties of any kind are equal."""
    return (is_tie(a) & is_tie(b)) | (col(a) == col(b))


def judge_family(judge: Column | str) -> Column:
    j = col(judge)
    return F.when(F.contains(j, F.lit("judge")) | F.contains(j, F.lit("gpt-4")), "gpt4-pair").when(j.startswith("expert"), "human").when(j.startswith("author"), "author")


def agrees(text: Column | str) -> Column:
    return F.rlike(col(text), F.lit("same|not contradicted|Same"))


def fused_label(rule: Column | str, model: Column | str) -> Column:
    """The rule's label where it decided (0 or 1), else the model's."""
    return F.when(col(rule) == -1, col(model).cast("int")).otherwise(col(rule).cast("int"))


def level_of(text: Column | str) -> Column:
    """First integer of the text if it stands in ``Level n`` and is 0 to 4, else -1."""
    n = F.regexp_extract(col(text), r"(\d+)", 1)
    ok = (n != "") & F.contains(F.lower(col(text)), F.concat(F.lit("level "), n)) & n.try_cast("int").between(0, 4)
    return F.when(ok, n.try_cast("int")).otherwise(-1)


def kind_state(reply: Column | str) -> Column:
    """What a verifier's reply says of the kind of an answer: 0 unexpected, 1 expected or valid, -1 neither."""
    t = F.lower(col(reply))
    return F.when(F.contains(t, F.lit("unexpected answer type")), 0).when(F.contains(t, F.lit("expected answer type")) | F.contains(t, F.lit("valid")), 1).otherwise(-1)


def right_state(reply: Column | str) -> Column:
    """What a verifier's reply says of an answer: 0 incorrect, 2 completely correct, 1 correct, -1 nothing."""
    t = F.lower(col(reply))
    return F.when(F.contains(t, F.lit("incorrect")), 0).when(F.contains(t, F.lit("completely correct")), 2).when(F.contains(t, F.lit("correct")), 1).otherwise(-1)


# Reward level by (state of the kind, state of the correctness).
LEVELS = {(0, -1): 0, (0, 0): 0, (0, 1): 0, (0, 2): 1, (1, -1): -1, (1, 0): 1, (1, 1): 3, (1, 2): 4, (-1, -1): -1, (-1, 0): 0, (-1, 1): 1, (-1, 2): 2}


def reward(gold: Column | str, answer: Column | str, kind_reply: Column | str, right_reply: Column | str) -> Column:
    """Reward level, -1 to 6. Equal texts (without case and outer blanks) are 6. Where one contains
    the other: 5 if their lengths differ by less than 50 and the gold has two letters or more,
    else -1. Otherwise by the replies of two verifiers, see ``LEVELS``. Null texts are empty."""
    g, a = (F.coalesce(col(c), F.lit("")) for c in (gold, answer))
    lg, la = F.lower(g), F.lower(a)
    table = F.create_map(*[F.lit(x) for (k, r), level in LEVELS.items() for x in (f"{k} {r}", level)])
    near = (F.abs(F.char_length(a) - F.char_length(g)) < 50) & (F.char_length(g) > 1)
    said = F.concat_ws(" ", *[F.coalesce(c, F.lit(-1)).cast("string") for c in (kind_state(kind_reply), right_state(right_reply))])
    return F.when(F.trim(lg) == F.trim(la), 6).when(F.contains(la, lg) | F.contains(lg, la), F.when(near, 5).otherwise(-1)).otherwise(table[said])


def scaled_reward(level: Column | str) -> Column:
    """max(1, level / 4), as the trainer uses it."""
    return F.greatest(F.lit(1.0), col(level) / 4)


def coarse_reward(text: Column | str) -> Column:
    """unexpected 0, expected or valid 2, else 1; unexpected is tested first."""
    t = F.lower(col(text))
    return F.when(F.contains(t, F.lit("unexpected")), 0).when(F.contains(t, F.lit("expected")) | F.contains(t, F.lit("valid")), 2).otherwise(1)


def prompt_size(question: Column | str, answer: Column | str) -> Column:
    """Which consistency prompt fits: full, short (over 420 words), bare (over 768)."""
    n = words(question) + words(answer)
    return F.when(n > 768, "bare").when(n > 420, "short").otherwise("full")


OPTIONS = ("(A)", "(B)", "(C)", "(D)", "(E)", "(F)")


def _bare(c: Column, marks: str = "") -> Column:
    """Without outer blanks, then without outer ``marks``."""
    c = F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "") if marks else c


def _figures(c: Column) -> Column:
    """The numbers of a text, with one comma or one point inside, whichever gives fewer."""
    comma, point = (F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in (r"\d+,?\d*", r"\d+\.?\d*"))
    return F.when(F.size(point) < F.size(comma), point).otherwise(comma)


def _said(answer: Column) -> Column:
    """What the first line says the answer is, up to the first full stop; else the whole text."""
    long, short = r"(?d)\A(.*?) answer (.*?) is (.*)", r"(?d)\A(.*?) answer is (.*)"
    return F.when(F.rlike(answer, F.lit(long)), F.split_part(F.regexp_extract(answer, long, 3), F.lit("."), F.lit(1))).when(F.rlike(answer, F.lit(short)), F.split_part(F.regexp_extract(answer, short, 2), F.lit("."), F.lit(1))).otherwise(answer)


def _number_said(answer: Column) -> Column:
    """The one number of a text; else what is boxed after ``Answer:``; else the number that a
    conclusion (Therefore, else So) holds alone, or its last one if it has an equals sign; else
    the conclusion, or the text."""
    a = F.regexp_replace(answer, "[\n\r]", " ")
    boxed = r"(?d)(.*?) Answer: \\boxed\{(.*?)\}"
    ends = {w: rf"(?d)(.*){w}(.*\.)" for w in ("Therefore", "So")}
    end = F.when(F.rlike(a, F.lit(ends["Therefore"])), F.regexp_extract(a, ends["Therefore"], 2)).when(F.rlike(a, F.lit(ends["So"])), F.regexp_extract(a, ends["So"], 2))
    whole = lambda n: F.replace(n, F.lit(","), F.lit(""))
    concluded = F.when(F.size(_figures(end)) == 1, whole(F.get(_figures(end), F.lit(0)))).when((F.size(_figures(end)) > 0) & F.contains(end, F.lit("=")), whole(F.try_element_at(_figures(end), F.lit(-1)))).otherwise(end)
    return F.when(F.size(_figures(a)) == 1, whole(F.get(_figures(a), F.lit(0)))).when(F.rlike(a, F.lit(boxed)), F.split_part(F.regexp_extract(a, boxed, 2), F.lit("."), F.lit(1))).otherwise(F.coalesce(concluded, a))


def _opposites(question: Column, golds: Column) -> Column:
    """The texts of the other options of a question that has options A, B and C: of each line the
    first option's text, up to the same mark again, unless it is a gold."""
    text = lambda line: F.coalesce(*[F.when(F.contains(line, F.lit(o)), F.split_part(line, F.lit(o), F.lit(2))) for o in OPTIONS])
    tidy = lambda t: _bare(_bare(_bare(_bare(_bare(t), "."), "?"), "!"))
    lines = F.filter(F.transform(F.split(question, "\n"), lambda x: tidy(text(x))), lambda t: t.isNotNull())
    has = F.contains(question, F.lit("(A)")) & F.contains(question, F.lit("(B)")) & F.contains(question, F.lit("(C)"))
    others = F.filter(lines, lambda t: ~F.exists(golds, lambda g: F.lower(g) == F.lower(t)))
    return F.when(has, others).otherwise(F.array().cast("array<string>"))


def rule_label(golds: Column | str, answer: Column | str, question: Column | str, integer: Column | bool = False) -> Column:
    """1 right, 0 wrong, -1 undecided, by rules. ``golds`` is an array of accepted answers.

    The answer is what the first line says it is, for ``integer`` questions the number said. It
    is right if it equals a gold (without case, outer blanks and full stops) or, unless
    ``integer``, contains one and is hardly longer: by less than 5 letters, or by less
    than 15 and half of the gold. Wrong if an integer gold and answer are different numbers, or
    if another option of the question fits by the same rule. Null texts are undecided.
    """
    golds, question = col(golds), F.coalesce(col(question), F.lit(""))
    whole = F.lit(integer) if isinstance(integer, bool) else integer
    said = F.when(whole, _number_said(_said(col(answer)))).otherwise(_said(col(answer)))

    def fits(gold: Column) -> Column:
        g, a = F.lower(_bare(gold, ".")), F.lower(_bare(said, "."))
        more = F.char_length(a) - F.char_length(g)
        return (a == g) | (~whole & F.contains(a, g) & ((more < 5) | ((F.char_length(a) < 1.5 * F.char_length(g)) & (more < 15))))

    known = F.filter(golds, lambda g: g.isNotNull())
    numbers = F.get(known, F.lit(0)).try_cast("double"), said.try_cast("double")
    label = F.when(F.exists(known, fits), 1).when(whole & (F.size(known) == 1) & (numbers[0] != numbers[1]), 0).when(F.exists(_opposites(question, known), fits), 0).otherwise(-1)
    return F.coalesce(F.when(said.isNotNull() & (F.size(known) > 0), label), F.lit(-1))

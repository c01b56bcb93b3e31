"""Prompt rendering: conversations as text in twelve formats, driven by a table of parts.

Each format says what stands between the pieces: a text before the messages, before each
round, between role and message, after a message (alternating), after a round, and what
follows the role where the message is still open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Style:
    system_end: str = ""
    #: whether an empty system text is left out with its end
    skip_empty_system: bool = False
    joint: str = ": "
    open_joint: str = ":"
    ends: tuple[str, str] = ("\n", "\n")
    round_begin: str = ""
    #: {n} in round_begin counts rounds from here
    round_from: int = 0
    tidy: bool = False


def styles(sep: str = "\n", sep2: str = "</s>") -> dict[str, Style]:
    """The twelve formats for given separators."""
    return {
        "add_colon_single": Style(sep, ends=(sep, sep)),
        "add_colon_two": Style(sep, ends=(sep, sep2)),
        "add_colon_space_single": Style(sep, open_joint=": ", ends=(sep, sep)),
        "no_colon_single": Style(joint="", open_joint="", ends=(sep, sep)),
        "add_new_line_single": Style(sep, True, "\n", "\n", (sep, sep)),
        "chatglm": Style(sep, True, "：", "：", (sep, sep), f"[Round {{n}}]{sep}"),
        "chatml": Style(sep + "\n", True, "\n", "\n", (sep + "\n", sep + "\n")),
        "chatintern": Style(joint=":", open_joint=":", ends=(sep + "\n", sep2 + "\n"), round_begin="<s>"),
        "dolly": Style(joint=":\n", open_joint=":\n", ends=(sep, sep2 + "\n\n")),
        "rwkv": Style(ends=("\n\n", "\n\n"), tidy=True),
        "phoenix": Style(joint=": <s>", open_joint=": <s>", ends=("</s>", "</s>")),
        "robin": Style(sep, joint=":\n", open_joint=":\n", ends=(sep, sep)),
    }


def render(messages: Column, system: str, roles: tuple[str, str], style: Style) -> Column:
    """One text per conversation; messages are structs (role by place, ``content``)."""

    def part(m: Column, i: Column) -> Column:
        even = i % 2 == 0
        role = F.when(even, F.lit(roles[0])).otherwise(F.lit(roles[1]))
        begin = F.lit("")
        if style.round_begin:
            n = F.floor(i / 2 + style.round_from).cast("string")
            a, _, b = style.round_begin.partition("{n}")
            begin = F.when(even, F.concat(F.lit(a), n, F.lit(b)) if "{n}" in style.round_begin else F.lit(style.round_begin)).otherwise(F.lit(""))
        text = m["content"]
        if style.tidy:
            text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n"))
        closed = F.concat(role, F.lit(style.joint), text, F.when(even, F.lit(style.ends[0])).otherwise(F.lit(style.ends[1])))
        return F.concat(begin, F.when(F.coalesce(m["content"], F.lit("")) != "", closed).otherwise(F.concat(role, F.lit(style.open_joint))))

    head = "" if style.skip_empty_system and not system else system + style.system_end
    return F.concat(F.lit(head), F.array_join(F.transform(messages, part), ""))


def chat_pairs(messages: Column) -> Column:
    """(said, replied) for each round; a missing reply is null."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(messages) / 2) - 1, F.lit(0))), lambda i: F.struct(F.get(messages, (2 * i).cast("int"))["content"].alias("said"), F.get(messages, (2 * i + 1).cast("int"))["content"].alias("replied")))


def moderation_text(messages: Column) -> Column:
    """All that the user said, joined by line breaks."""
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"]), "\n")


def decorated(messages: Column, begin: str = "### ", end: str = "\n") -> Column:
    """Messages with speaker and signal, and the speaker who comes next."""
    return F.transform(messages, lambda m, i: F.struct(F.concat(F.lit(begin), m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")), F.lit(end)).alias("text"), F.get(messages, (i + 1).cast("int"))["role"].alias("next")))


def answer_pairs(messages: Column, words: int) -> Column:
    """(context, answer) for each assistant message: the last ``words`` words said before it and
    the first ``words`` words of it with an end mark."""
    tokens = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    before = lambda i: F.flatten(F.transform(F.slice(messages, 1, F.greatest(i.cast("int"), F.lit(0))), lambda m: tokens(m["content"])))
    pick = lambda i: F.struct(F.array_join(F.slice(before(i), F.greatest(F.size(before(i)) - words + 1, F.lit(1)), words), " ").alias("context"), F.concat(F.array_join(F.slice(tokens(F.get(messages, i.cast("int"))["content"]), 1, words), " "), F.lit("</s>")).alias("answer"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(messages) - 1, F.lit(0))), lambda i: F.get(messages, i.cast("int"))["role"] == "assistant")
    return F.transform(places, pick)


def label_mask(messages: Column) -> Column:
    """One flag per word of the rendered words: 1 for the assistant's words, 0 else."""
    return F.flatten(F.transform(messages, lambda m: F.array_repeat(F.when(m["role"] == "assistant", 1).otherwise(0), F.size(F.split(F.coalesce(m["content"], F.lit("")), " ")))))


def checked_mask(mask: Column, words: Column) -> Column:
    """The mask if it has a flag for each of the prompt's ``words``, else as many zeros."""
    return F.when(F.size(mask) == words, mask).otherwise(F.array_repeat(F.lit(0), words.cast("int")))

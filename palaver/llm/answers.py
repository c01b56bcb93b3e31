"""Answer turns: truncated texts and broken prompt and response pairs.

Truncation: the length of every text is recomputed under several encodings and escapings;
grouped by source, a length at which many texts pile up and beyond which none lies is a
hidden storage limit. Endings are inspected by a pushdown parse of the whole text (fences,
brackets, quotations, lists, mark-up) and by how the corpus itself goes on after the last
words of a text: lines that are followed by another line are complete, so they tell which
words may end a line.

All that is asked of a text is asked in one pass over Arrow batches (``inspect``), which
returns no text; what follows joins and counts small columns only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm.languages import NAMES, UNDETERMINED, Model, Reader, sentences_of
from palaver.llm.skeleton import prototype, skeleton
from palaver.session import join_side, materialise

#: Ways in which a store may count the size of a text.
MEASURES = ("characters", "utf8", "utf16", "json", "json_ascii", "html", "crlf", "crlf_utf8")
#: Those that may cut a character in two.
IN_BYTES = ("utf8", "crlf_utf8")


SLOT = ["answer_id", "question_id", "model_id", "choice_index", "turn_index"]


def answer_slots(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """``SLOT``, ``judged``, ``prompt``, ``text``: one row for each prompt of the question and each
    turn of a choice, whichever are more, rows repeated whole taken once. ``judged`` is false
    for a turn beyond the prompts. Absent turns and null elements have null texts; an
    unknown question gives its turns without prompts; repeated question ids take the first
    row by their turns. A null or absent ``choices`` gives no rows.

    Prompts are broadcast if their questions are few, else the join is left to the optimiser;
    then the texts move once more, to meet their repetitions.
    """
    one = questions.where("question_id is not null").groupBy("question_id").agg(F.min("turns").alias("prompts"))
    tstamp = F.col("tstamp") if "tstamp" in answers.columns else F.lit(None)
    choices = answers.select("answer_id", F.col("question_id").cast("bigint"), "model_id", tstamp.cast("double").alias("tstamp"), F.posexplode("choices").alias("at", "c"))
    held = choices.select("answer_id", "question_id", "model_id", "tstamp", F.coalesce("c.index", "at").cast("int").alias("choice_index"), F.col("c.turns").alias("turns")).join(join_side(one, one.count()), "question_id", "left")
    n = F.greatest(F.coalesce(F.size("prompts"), F.lit(0)), F.coalesce(F.size("turns"), F.lit(0)))
    slots = held.where(n > 0).withColumn("turn_index", F.explode(F.sequence(F.lit(0), n - 1)))
    judged = F.col("prompts").isNull() | (F.col("turn_index") < F.size("prompts"))
    return slots.select(*SLOT, "tstamp", judged.alias("judged"), F.get("prompts", F.col("turn_index")).alias("prompt"), F.get("turns", F.col("turn_index")).alias("text")).dropDuplicates().drop("tstamp")


def answer_turns(answers: DataFrame) -> DataFrame:
    """``SLOT`` and ``text`` of every turn, rows repeated whole taken once."""
    none = answers.sparkSession.createDataFrame([], "question_id bigint, turns array<string>")
    return answer_slots(answers, none).drop("judged", "prompt")


def measures(text: Column) -> dict[str, Column]:
    """The length of a text under each way of storing it, all by built-in expressions."""
    points, utf8 = F.char_length(text), F.octet_length(text)
    without = lambda marks: points - F.char_length(F.translate(text, marks, ""))
    lines, quoted = without("\n"), without('"\\\n\t\r')
    utf16 = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    # most texts are ASCII, which their two lengths tell
    beyond = F.when(utf8 == points, 0).otherwise(utf16 - points)
    wide = F.when(utf8 == points, 0).otherwise(F.char_length(F.regexp_replace(text, r"[\x{0}-\x{7f}]", "")))
    html = points + 4 * without("&'") + 5 * without('"') + 3 * without("<>")
    return {
        "characters": points,
        "utf8": utf8,
        "utf16": points + beyond,
        "json": points + quoted,
        "json_ascii": points + quoted + 5 * wide + 6 * beyond,
        "html": html,
        "crlf": points + lines,
        "crlf_utf8": utf8 + lines,
    }


def sizes_of(text: str) -> tuple[int, ...]:
    """The same lengths of one text, in the order of ``MEASURES``."""
    points, utf8, beyond, wide = len(text), len(text), 0, 0
    if not text.isascii():
        utf8 = len(text.encode("utf-8", "surrogatepass"))
        beyond = len(text.encode("utf-16-le", "surrogatepass")) // 2 - points
        wide = points - len(text.encode("ascii", "ignore"))
    n = text.count
    lines, marks = n("\n"), n('"')
    quoted = lines + marks + n("\\") + n("\t") + n("\r")
    html = points + 4 * (n("&") + n("'")) + 5 * marks + 3 * (n("<") + n(">"))
    return points, utf8, points + beyond, points + quoted, points + quoted + 5 * wide + 6 * beyond, html, points + lines, utf8 + lines


def hidden_limits(turns: DataFrame, source: str = "model_id", text: str = "text", least: int = 4, share: float = 0.01, excess: float = 6.0, slack: int = 3) -> DataFrame:
    """(source, measure, size, texts, longer): sizes that look like storage limits of a source.

    A size is one if at least ``least`` texts and ``share`` of the source's texts of 32 or
    more characters have exactly it, ``excess`` times as many as have a size up to ten
    below it on average, and hardly any text (2 %) of the source is longer. Byte counts may
    fall short by up to ``slack`` where the limit splits a character; these are added to the size.
    """
    sized = turns.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), *[m.alias(n) for n, m in measures(F.col(text)).items()])
    return limits_of(sized, least, share, excess, slack)


def limits_of(sized: DataFrame, least: int = 4, share: float = 0.01, excess: float = 6.0, slack: int = 3) -> DataFrame:
    """``hidden_limits`` of rows that hold the source and the sizes already."""
    long = sized.where("characters >= 32").select("source", F.explode(F.create_map(*[x for n in MEASURES for x in (F.lit(n), F.col(n))])).alias("measure", "size"))
    counts = long.groupBy("source", "measure", "size").agg(F.count(F.lit(1)).alias("k"))
    # windows over the distinct sizes of one source and measure: as many rows as there are sizes, whatever the number of texts
    w = W.partitionBy("source", "measure").orderBy("size")
    some = lambda begin, end: F.coalesce(F.sum("k").over(w.rangeBetween(begin, end)), F.lit(0))
    split = F.col("measure").isin(*IN_BYTES)
    near = counts.withColumn("texts", F.when(split, some(-slack, 0)).otherwise(F.col("k"))).withColumn("below", F.when(split, some(-10 - slack, -1 - slack)).otherwise(some(-10, -1)) / 10.0).withColumn("up_to", F.sum("k").over(w.rangeBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("k").over(W.partitionBy("source", "measure")))
    return near.where((F.col("k") >= least) & (F.col("texts") >= share * F.col("all")) & (F.col("texts") >= excess * F.greatest(F.col("below"), F.lit(0.3))) & (F.col("all") - F.col("up_to") <= 0.02 * F.col("all"))).select("source", "measure", "size", "texts", (F.col("all") - F.col("up_to")).alias("longer"))


# --- endings ---------------------------------------------------------------------------

_STOP = ".!?。！？…｡"
_CLOSERS = "\"'”’»)）」』】]*_"
_BULLET = re.compile(r"^\s*(?:[-*•–+]|\d{1,3}[.)])(?:\s+|$)")
_WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_FENCE = re.compile(r"^\s*(?:```|~~~)", re.M)
_TAGS = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--.*?-->", re.S)
# Closing formulas of letters and messages.
CLOSINGS = re.compile(r"^(?:best(?: wishes| regards)?|kind regards|warm regards|regards|sincerely|yours|cheers|thanks|thank you|hope this helps|good luck|cordialement|mit freundlichen grüßen|viele grüße|saludos|un saludo|atenciosamente|cordiali saluti|с уважением)\b", re.I)
# Words that a short answer does not end with.
OPEN_WORDS = frozenset("a an the of to in on at for with and or but if when as by from that which who is are was were be been do does did not so than then this these those it its how why what there while because although about into over under your our their his her my el la los las un una de del en con por para que y o le les des du et ou à au aux dans pour qui der die das ein eine und oder mit von zu im il lo gli di da per che e o os as um uma em no na и в на с к по за о что как не".split())


def last_words(text: str, n: int = 2) -> str:
    found = _WORDS.findall(text.casefold())
    return " ".join("0" if w.isdigit() else w for w in (["^"] * n + found)[-n:])


_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»", "（": "）", "「": "」", "『": "』", "《": "》"}
_MARK = re.compile(r"`[^`\n]*`|<!--|-->|</?[A-Za-z][^<>\n]*>|[:;]-?[()]|(?<![^\s(])\d{1,3}\)|[()\[\]{}“”„«»（）「」『』《》\"]")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
# Elements that end without an end tag.
_VOID = frozenset("br hr img input meta link area base col embed source track wbr p li dt dd tr td th option thead tbody".split())


def parse(text: str) -> tuple[list[str], list[str]]:
    """(lines outside fences, what is open at the end): a pushdown parse of the whole text.

    On the stack are fences, list items by their depth, elements of mark-up, brackets and
    quotations. A closing mark takes what was opened inside with it; one that closes nothing
    is ignored, as are code between back-ticks, smileys, numbering such as ``1)`` and inches.
    A fence leaves the line ``` behind. Elements count only in a text of mark-up
    (one that begins with a tag) or, for lists and tables, once they hold an item; list
    items are never left open, since nothing closes them.
    """
    stack: list[tuple[str, int]] = []
    lines: list[str] = []
    fence, markup = "", text.lstrip()[:1] == "<"
    turned = text.find("»") < text.find("«") if "»" in text and "«" in text else False
    held: set[str] = set()
    for raw in text.split("\n"):
        start = raw.lstrip()
        if fence:
            if start.startswith(fence):
                fence = ""
                stack.pop()
            continue
        if start.startswith(("```", "~~~")):
            lines.append("```")
            if not (start.rstrip().endswith(start[:3]) and len(start.rstrip()) > 6):
                fence = start[:3]
                stack.append(("fence", 0))
            continue
        lines.append(raw)
        if not start:
            continue
        bullet, depth = _BULLET.match(raw), len(raw) - len(start)
        if bullet or depth == 0:
            stack = [x for x in stack if x[0] != "item" or x[1] < depth]
        if bullet:
            stack.append(("item", depth))
        for m in _MARK.finditer(raw, bullet.end() if bullet else 0):
            mark = m.group()
            if mark[0] == "<" or mark == "-->":
                if mark in ("<!--", "-->"):
                    stack = [*stack, ("<!--", 0)] if mark == "<!--" else [x for x in stack if x[0] != "<!--"]
                    continue
                name = "<" + _NAME.match(mark).group(1).lower()
                if name[1:] in ("li", "tr", "dt"):
                    held.add(name)
                if mark[1] == "/":
                    _close(stack, lambda x, name=name: x == name)
                elif name[1:] not in _VOID and mark[-2] != "/":
                    stack.append((name, 0))
            elif len(mark) > 1:
                continue
            elif mark == '"':
                before = raw[m.start() - 1] if m.start() else " "
                if not _close(stack, lambda x: x == '"') and not before.isdigit():
                    stack.append(('"', 0))
            elif turned and mark in "«»":
                if mark == "»":
                    stack.append(("«", 0))
                else:
                    _close(stack, lambda x: x == "«")
            elif _close(stack, lambda x, mark=mark: mark in x):
                continue
            elif mark in _PAIRS:
                stack.append((_PAIRS[mark], 0))
    # an element counts in a text of mark-up, or with its items
    items = {"<ul": "<li", "<ol": "<li", "<table": "<tr", "<dl": "<dt"}
    return lines, [x for x, _ in stack if x != "item" and (x[0] != "<" or x == "<!--" or markup or items.get(x) in held)]


def _close(stack: list[tuple[str, int]], fits: Callable[[str], bool]) -> bool:
    """Take the last open mark that fits, with all that was opened inside but list items and fences."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] not in ("item", "fence") and fits(stack[k][0]):
            stack[k:] = [x for x in stack[k + 1 :] if x[0] in ("item", "fence")]
            return True
    return False


def ending(text: str, parsed: tuple[list[str], list[str]] | None = None) -> tuple[str, str, str]:
    """(verdict, kind of the last line, last words): the verdict is ``whole``, ``broken``, or
    ``ask`` where only the use of the last words in the corpus can tell. ``parsed`` as by ``parse``."""
    tail = text.rstrip("\u200b\u200c\u200d\u2060\ufeff\u200e\u200f").rstrip()
    if not tail:
        return "whole", "empty", ""
    lines, left_open = parsed or parse(tail)
    lines = lines[: max((k + 1 for k, x in enumerate(lines) if x.strip()), default=0)]
    if "fence" in left_open:
        return "broken", "code", ""
    if not lines or lines[-1] == "```":
        return "whole", "code", ""
    line = lines[-1]
    bare = _TAGS.sub("", line).rstrip() or line.rstrip()
    if len(lines) == 1 and line.lstrip()[:1] in ("[", "{") and line.rstrip()[-1:] in "]}":
        return ("broken" if left_open else "whole"), "data", ""
    bullet = _BULLET.match(bare)
    content = bare[bullet.end() :] if bullet else bare
    if bullet and not content.strip():
        return ("whole", "marks", "") if len(lines) == 1 else ("broken", "item", "")
    core = content.rstrip(_CLOSERS + " ")
    if not core:
        return "whole", "marks", ""
    if core.endswith(("...", "…")):
        before = core.rstrip(".… ")
        if not before:
            return "whole", "marks", ""
        return "ask", "ellipsis", last_words(before)
    words = len(_WORDS.findall(content))
    if core[-1] in _STOP:
        if any(x[0] == "<" for x in left_open):
            return "broken", "mark-up", ""
        return ("broken", "quotation", "") if left_open else ("whole", "sentence", "")
    if core[-1] in ",;:([{/–—、，；：（「『&=+" and not (core[-1] == ":" and CLOSINGS.match(core)):
        return "broken", "prose", last_words(core)
    if not (core[-1].isalnum() or core[-1] in "%°€$£"):
        # emoji, smileys, marks
        return "whole", "mark", ""
    if content.rstrip()[-1:] == ")" and re.search(r"[:;]-?\)$", content.rstrip()):
        return "whole", "mark", ""
    if bullet:
        return "ask", "item", last_words(core)
    paragraph: list[str] = []
    for x in reversed(lines[:-1]):
        if not x.strip():
            break
        paragraph.append(x.strip())
    if CLOSINGS.match(core) and words <= 4 or paragraph and CLOSINGS.match(paragraph[0]) and words <= 5:
        return "ask", "closing", last_words(core)
    if paragraph and all(x[-1] not in _STOP + ",;:" for x in paragraph) and not any(_BULLET.match(x) for x in paragraph):
        return "ask", "verse", last_words(core)
    if len(lines) == 1 and words <= 3:
        if any("\u3040" <= c <= "\u9fff" for c in core):
            return ("broken" if len(core) > 8 else "ask"), "short", last_words(core)
        final = _WORDS.findall(core.casefold())
        if len(final) == 1 and (final[0].isdigit() or final[0] in ("yes", "no", "ja", "nein", "oui", "non", "sí", "si", "sim", "não", "да", "нет")):
            return "whole", "short", ""
        return ("broken" if len(final) > 1 and final[-1] in OPEN_WORDS else "ask"), "short", last_words(core)
    return "broken", "prose", last_words(core)


_UNIT = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[.!?。！？…]")


def word_uses(lines: list[str]) -> Iterator[tuple[str, str, str, int]]:
    """(kind of line, word before, word, what comes next: 0 a word, 1 the end of a complete line or
    sentence, 2 the end of the text) of each word of a text, given by its lines outside fences.
    The kinds are i item, v verse, p prose; numbers are all 0; ^ stands for no word before."""
    verse = False
    for k, line in enumerate(lines):
        last = k == len(lines) - 1
        if line == "```":
            continue
        line = line.casefold()
        if not line.strip():
            verse = False
            continue
        bullet = _BULLET.match(line)
        stop = line.rstrip(_CLOSERS + " ")[-1:]
        verse = not bullet and not CLOSINGS.match(line) and (verse if last else stop not in _STOP + ",;:")
        kind = "i" if bullet else "v" if verse else "p"
        before, word = "^", ""
        for u in _UNIT.findall(line[bullet.end() :] if bullet else line):
            if u in _STOP:
                if word:
                    yield kind, before, word, 1
                before, word = "^", ""
                continue
            if word:
                yield kind, before, word, 0
                before = word
            word = "0" if u.isdigit() else u
        if word:
            yield kind, before, word, 2 if last else 1


def count_usage(uses: Iterable[tuple[str, str, str, int]]) -> dict[str, list[int]]:
    """How often words go on, end a line or sentence, and close a text. Keys are the kind of line
    with the last two words, or with 1 and the last word only."""
    count: dict[str, list[int]] = {}
    for (kind, before, word, at), n in Counter(uses).items():
        count.setdefault(f"{kind} {before} {word}", [0, 0, 0])[at] += n
        count.setdefault(f"{kind}1 {word}", [0, 0, 0])[at] += n
    return count


def broken_off(looked: DataFrame) -> DataFrame:
    """The turns of ``inspect`` with ``broken`` (boolean) and ``at_limit``: the measure under which
    their length is a hidden limit of their source, if any. Rows without a text are left out.

    ``ask`` endings are decided by the corpus: the last words must end complete lines at
    least as often as they go on (or close texts repeatedly without ever going on); under a
    hidden limit only the former counts, and an ellipsis there is the store's own.
    Empty texts, marks and code with closed fences are whole.
    """
    turns = looked.where("what = 'turn' and verdict is not null")
    limits = limits_of(turns.select(F.col("model_id").alias("source"), *MEASURES))
    by_source = limits.groupBy(F.col("source").alias("limit_source")).agg(F.collect_list(F.struct("measure", "size")).alias("limits"))  # at most one row for each measure and limit
    sized = turns.withColumn("sizes", F.create_map(*[x for n in MEASURES for x in (F.lit(n), F.col(n))])).drop(*MEASURES, "goes_on", "ends", "closes")
    held = sized.join(by_source, sized["model_id"].eqNullSafe(F.col("limit_source")), "left")
    reached = F.filter("limits", lambda x: (F.col("sizes")[x["measure"]] <= x["size"]) & (F.col("sizes")[x["measure"]] >= x["size"] - F.when(x["measure"].isin(*IN_BYTES), 3).otherwise(0)))
    held = held.withColumn("at_limit", F.get(F.transform(reached, lambda x: x["measure"]), F.lit(0))).drop("sizes", "limits", "limit_source")
    used = looked.where("what = 'use'").groupBy("words").agg(*[F.sum(c).alias(c) for c in ("goes_on", "ends", "closes")])
    pair, single = [used.select(F.col("words").alias(key), *[F.col(c).alias(f"{c}_{n}") for c in ("goes_on", "ends", "closes")]) for key, n in (("words", 2), ("final", 1))]
    known = held.where("verdict = 'ask'").join(pair, "words", "left").join(single, "final", "left").withColumns({f"{c}_{n}": F.coalesce(f"{c}_{n}", F.lit(0)) for c in ("goes_on", "ends", "closes") for n in (1, 2)})
    on, ends, closes = F.col("goes_on_2"), F.col("ends_2"), F.col("closes_2")
    seen = on + ends > 0
    # the last two words where the corpus knows them in such lines, else the last word
    ends_lines = F.when(seen, (ends > 0) & (ends >= on)).otherwise((F.col("ends_1") > 0) & (F.col("ends_1") >= F.col("goes_on_1")))
    closes_texts = (on == 0) & (closes + ends >= 2)
    limit = F.col("at_limit").isNotNull()
    whole = (
        F.when(F.col("kind") == "ellipsis", ~limit & (closes_texts | ends_lines))
        .when(F.col("kind") == "short", ~limit & ((ends > 0) & (ends >= 0.02 * on) | (closes >= 2) & (closes >= 0.02 * on)))
        .when(F.col("kind") == "closing", closes_texts | (closes > on))
        .when(limit, ends_lines)
        .otherwise(ends_lines | closes_texts)
    )
    columns = [*SLOT, "judged", "found", "other_language", "kind", "at_limit"]
    asked = held.where("verdict <> 'ask'").select(*columns, (F.col("verdict") == "broken").alias("broken"))
    return asked.unionByName(known.select(*columns, (~whole).alias("broken")))


# --- defects ---------------------------------------------------------------------------

# Marks that stand for a missing answer.
SENTINELS = ("$ERROR$", "null", "None", "N/A", "n/a", "[ERROR]", "<no answer>", "undefined")
_ENTITY = re.compile(r"&(?:nbsp|amp|lt|gt|quot|zwnj|zwj|shy|#\d+|#x[0-9a-f]+);", re.I)


def is_empty(text: str | None) -> bool:
    """Absent, or nothing but blanks, invisible characters, marks, mark-up or a sentinel."""
    if text is None:
        return True
    s = text.strip()
    if s in SENTINELS:
        return True
    s = _ENTITY.sub("", _TAGS.sub("", re.sub(r"```\w*", "", s)))
    return not any(c.isalnum() and prototype(c) for c in s)


# A grammar of refusals: who declines (the first person, or the rules that bind it), the negation or the act of declining, and what
# is declined. Each language has rules of the form (declining, what is declined); a sentence declines if one part of each is in it, in
# this order or as the rule says, or if it is the declining alone. Third persons who decline, and first persons who decline something
# else, are no refusal.
_WE = r"(?:i|we|this assistant|as an? (?:\w+ )?(?:ai|assistant|model|bot)\b[^.!?]{0,30}?)"
_NOT = r"(?:can(?:no|['’])?t|can ?not|(?:wo|would|could|must|may|might|should|are|shall)n['’]?t|(?:will|would|could|must|may|should|am|are|['’]m|shall) not|(?:do not|don['’]?t)(?= (?:feel|have (?:the )?permission|wish|want|intend|think (?:i|it|that)|(?:answer|discuss|comment on|respond to|reply to|talk about|speak about|help with|assist with|handle|cover) (?:this|that|it|such|these|those|questions|requests|topics)|(?:give|provide|offer|share|write|produce|answer|discuss|do)\b[^.!?]{0,40}?(?:such|(?:of|like) (?:this|that|these|those)|(?:this|that) (?:kind|sort|type)|on (?:this|that)))\b)|(?:am|are|['’]m|['’]re) (?:afraid|sorry)[^.!?]{0,30}?not|(?:am |are |['’]m |['’]re )?unable|['’](?:m|re) not|have no|lack|(?:would |['’]d )?(?:rather|prefer)(?: to)? (?:not|avoid|decline|refuse)|(?:was|were|am|are|have been|['’]ve been) (?:told|asked|instructed|trained) not|(?<!do )not)"
_REFUSE = r"(?:(?:respectfully |politely |hereby |must |should |will |['’]ll |shall |need to |have to |has to |want to |choose to |going to |['’]m going to |must respectfully )*(?:decline|refuse|abstain|say no|turn (?:this|that|it) down|stay away|steer clear|keep away|stop here|pass(?= on (?:this|that|it)\b|\W*$))|(?:am|are|['’]m) (?:declining|refusing))"
_ACT = r"(?:help\w*|assist\w*|answer\w*|provid\w*|discuss\w*|compl[yi]\w*|respond\w*|repl[yi]\w*|talk\w*|writ\w*|offer\w*|shar\w*|support\w*|comment\w*|speak\w*|engag\w*|giv\w*|say|produc\w*|creat\w*|fulfil\w*|complet\w*|address\w*|advi[sc]e|opinions?|comfortable|allowed|permitted|position|permission|willing|appropriate|request\w*|questions?|topics?|subjects?|tasks?|matters?|(?:do|for|on|with|about|of) (?:that|this|it|so|these|those|such)|go (?:into|there)|touch)"
_RULES = r"(?:my|our|the|its|these|those) (?:\w+ )?(?:guidelines?|polic(?:y|ies)|rules?|instructions?|terms|training|programming|settings|permissions?|limits?)"
_TOPIC = r"(?:requests?|questions?|topics?|subjects?|tasks?|prompts?|matters?|that|this|it|such|these)"
GRAMMARS = {
    "en": [
        rf"(?<!\w){_WE}(?:['’](?:m|d|ll|ve))?(?: \w+){{0,3}}? ?{_NOT}\b[^.!?;]*?\b{_ACT}\b",
        rf"(?<!\w){_WE}(?:['’](?:m|d|ll|ve))?(?: \w+){{0,3}}? ?{_REFUSE}\b",
        rf"(?<!\w){_WE}(?:['’](?:m|ve|re))? ?(?:have |am |are |was |were |been )*(?:told|asked|instructed|advised|trained|required|obliged|supposed|meant) to (?:{_REFUSE}|avoid|leave)\b",
        r"\b(?:it|that|this)(?: \w+)? ?(?:is|would|will|isn['’]t|wouldn['’]t|won['’]t)\b(?: not)?(?: \w+)? ?(?:inappropriate|improper|wrong|(?<=not )(?:appropriate|proper|right|possible|wise)|(?:not|n['’]t)(?: be)? (?:appropriate|proper|right|possible|wise|permitted|allowed)) for (?:me|us)\b",
        rf"^\W*(?:(?:sorry|no|apologies|unfortunately|well)\W+)*(?:{_NOT}|declining|refusing|decline|refuse)\b[^.!?;]*?\b{_ACT}\b",
        rf"^\W*(?:(?:sorry|no|apologies|unfortunately|thanks|but)\W+)*(?:i|we) ?{_NOT}\W*$",
        rf"^\W*(?:(?:your|the|this|that|such an?) )?{_TOPIC}\b[^.!?;]{{0,40}}?\b(?:declined|denied|refused|rejected|(?:can(?:no|['’])?t|can ?not|cannot|will not|won['’]?t|may not|must not) be \w+|(?:is|are|be|falls?|lies?|goes|seems?)(?: \w+){{0,2}} (?:outside|beyond|off[- ]limits|out of scope|against|not (?:possible|permitted|allowed|appropriate|something|one)))",
        rf"\b(?:not|nothing|isn['’]t)(?: \w+){{0,3}} (?:that )?(?:i|we) (?:can|could|will|would|may|am able|do|should|['’]ll|['’]d)\b",
        rf"\b(?:outside|beyond|against|not within) (?:{_RULES}|(?:my|our|the) (?:scope|remit|abilities|role)|what (?:i|we))",
        rf"\b{_RULES}\b[^.!?;]{{0,30}}?(?:\bdo(?:es)? not|n['’]t|\b(?:forbids?|prohibits?|prevents?|bars?|rules? (?:\w+ ){{0,2}}out|keeps? (?:me|us)|stops? (?:me|us)|will not let|lacks?))\b",
        r"^\W*(?:sorry\W+)?(?:no can do|no comment|no answer|no reply)\b|\bno (?:answer|comment|help|reply) (?:can|will|may) be\b",
        r"\b(?:let us|let['’]s|could we|can we|shall we|why don['’]t we|perhaps we|maybe we|please|pick|choose|ask|i(?:['’]d| would)? (?:rather|prefer))\b[^.!?;]{0,40}?\b(?:something else|(?:another|a different|other) (?:topic|subject|question|matter)s?|change the (?:topic|subject))",
    ],
    "de": [
        r"\b(?:ich|wir|mir|uns)\b.*\b(?:nicht|keine?[nmrs]?|weder)\b", r"\b(?:leider|bedauerlicherweise)\b.*\b(?:nicht|keine?[nmrs]?)\b", r"\b(?:ich|wir)\b.*\b(?:ablehnen|verweiger\w*|absehen|verzichten|enthalte\w*|passen)\b|\b(?:ablehnen|verweiger\w*|enthalte\w*)\b.*\b(?:ich|wir)\b|\blehne\w*\b.*\bab\b", r"\b(?:über etwas anderes|anderes thema|thema wechseln)\b",
    ],
    "nl": [r"\b(?:ik|wij|we|mij)\b.*\b(?:niet|geen)\b", r"\bhelaas\b.*\b(?:niet|geen)\b", r"\b(?:ik|wij|we)\b.*\b(?:weiger\w*|afwijzen|afslaan|bedank\w*)\b", r"\b(?:iets anders|ander onderwerp)\b"],
    "fr": [r"\b(?:je|j['’]|nous|on|me|m['’])\s?.{0,30}\b(?:ne|n['’])\s?.{0,40}?(?:pas|point|rien|aucune?|jamais|saurais?|puis)\b", r"\b(?:il|cela|ça|ce)\s?\b(?:ne|n['’])\s?.{0,8}\b(?:m['’]|nous|me|est|sera)\s?.{0,12}\bpas\b.{0,20}\b(?:possible|permis|autorisé)", r"\b(?:je|j['’]|nous)\s?.{0,30}\b(?:refus\w*|décline\w*|m['’]absten\w*|abstenir|préf\w+ (?:ne pas|m['’]|éviter))", r"\b(?:autre chose|autre sujet|changer de sujet|changeons de sujet)"],
    "es": [r"\bno (?:me |nos |le |te |lo |la )?(?:puedo|podemos|podré|podría|debo|debemos|quiero|queremos|voy|vamos|es posible|está permitido|están? \w+|estoy|estamos|tengo|tenemos|contestaré|responderé|haré)\b", r"\b(?:debo|debemos|tengo que|tenemos que|prefiero|preferimos|quiero)\b.{0,30}\b(?:rechazar|declinar|negarme|no|abstenerme|evitar)\b", r"\b(?:rechazo|declino|me niego|me abstengo|rechazamos|declinamos)\b", r"\b(?:otra cosa|otro tema|cambiemos de tema|cambiar de tema|fuera de mi)"],
    "pt": [r"\bnão (?:me |nos |lhe |o |a )?(?:posso|podemos|poderei|poderia|devo|devemos|quero|queremos|vou|vamos|é (?:possível|permitido)|consigo|conseguimos|estou|estamos|tenho|temos|responderei)\b", r"\b(?:devo|devemos|tenho de|tenho que|temos de|prefiro|preferimos|quero)\b.{0,30}\b(?:recusar|declinar|negar|não|abster\w*|evitar)\b", r"\b(?:recuso|declino|abstenho|recusamos)\b", r"\b(?:outra coisa|outro assunto|outro tema|mudar de assunto|fora do meu)"],
    "it": [r"\bnon (?:mi |ci |le |ti |lo |la )?(?:posso|possiamo|potrò|potrei|devo|dobbiamo|voglio|vogliamo|è (?:possibile|permesso|consentito)|riesco|sono|siamo|ho|intendo|risponderò)\b", r"\b(?:devo|dobbiamo|preferisco|preferiamo|voglio|vorrei)\b.{0,30}\b(?:rifiutare|declinare|non|astenermi|evitare)\b", r"\b(?:rifiuto|declino|mi astengo|rifiutiamo)\b", r"\b(?:altra cosa|qualcos['’]altro|altro argomento|cambiare argomento|cambiamo argomento|fuori dal mio)"],
    "ru": [r"не (?:могу|можем|буду|будем|стану|хочу|хотим|имею|вправе|смогу|готов\w*|отвечу|разреш\w*|позволен\w*)", r"(?:вынужден\w*|должн?\w*|хочу|предпочит\w*|предпочёл|лучше)\b.{0,30}(?:отказ\w*|не |воздерж\w*|уклон\w*)", r"(?:отказываюсь|отклоняю|воздержусь|отказано)", r"(?:другую тему|другой теме|о чём-нибудь другом|сменим тему|сменить тему)"],
    "pl": [r"\bnie (?:mogę|możemy|będę|wolno mi|chcę|jestem|mam)\b", r"\b(?:muszę|musimy|wolę)\b.{0,30}\b(?:odmówić|odrzucić|nie)\b", r"\b(?:odmawiam|odrzucam)\b"],
    "zh": [r"(?:我|我们|本助手|作为)?.{0,12}(?:不能|无法|不便|不可以|不会|不予|不方便|没有办法|不想|不愿)", r"(?:拒绝|婉拒|恕|无可奉告|谢绝)", r"(?:换个话题|换一个话题|谈别的|聊别的|不在我|超出)"],
    "ja": [r"(?:できません|できかね|いたしかね|致しかね|応じられません|かねます|できない|わけにはいきません|ありません)", r"(?:お断り|控え|遠慮|差し控え|辞退)", r"(?:別の話題|話題を変え|ほかの話|範囲外)"],
}
# What is declined, by language; English has it in its rules.
OBJECTS = {
    "de": r"helfen|hilfe|\w*antwort\w*|äußer\w*|auskunft|anfrage\w*|frage\w*|thema|themen|bitte|wunsch|unterstütz\w*|mitteil\w*|möglich|gestattet|erlaubt|weiterhelfen|eingehen|besprech\w*|stellung|befugt|wechseln|anderes|dazu|darüber|damit|dabei",
    "nl": r"helpen|hulp|\w*antwoord\w*|verzoek\w*|vraag|vragen|onderwerp\w*|bespreken|toegestaan|mogelijk|ingaan|daarover|daarbij|hiermee|daarmee|anders",
    "fr": r"aide\w*|répon\w*|demande\w*|question\w*|sujets?|requête\w*|fourni\w*|permis|possible|autorisé\w*|droit|permission|traiter|discuter|parler|donner|là-dessus|faire (?:cela|ça)|prononcer|refus\w*|décline\w*|absten\w*|autre chose|écrire|commenter",
    "es": r"ayud\w*|respond\w*|respuesta\w*|contest\w*|solicitud\w*|pregunt\w*|temas?|petición\w*|hablar|dar|ofrec\w*|permitid\w*|posible|permiso|autorizad\w*|asunto\w*|sobre (?:eso|esto)|con (?:eso|esto)|hacer(?:lo)? ?(?:eso|esto)?|otra cosa|opinar|comentar|niego|declino|rechazo|abstengo",
    "pt": r"ajud\w*|respo\w*|pedido\w*|pergunt\w*|assuntos?|temas?|falar|dar|oferec\w*|permitid\w*|permissão|possível|autorizad\w*|sobre (?:isso|isto)|com (?:isso|isto)|fazer (?:isso|isto)|outra coisa|opinar|comentar|recuso|declino|solicita\w*|discutir",
    "it": r"aiut\w*|rispo\w*|richiest\w*|domand\w*|argoment\w*|tem[ai]|parl\w*|forni\w*|permess\w*|possibile|consentit\w*|autorizzat\w*|su (?:questo|ciò)|con (?:questo|ciò)|far(?:lo|e questo)|esprim\w*|altra cosa|qualcos['’]altro|rifiuto|declino|discut\w*|comment\w*",
    "ru": r"запрос\w*|вопрос\w*|тем[аеуы]\w*|ответ\w*|отвеч\w*|помо\w*|просьб\w*|обсужд\w*|говорить|сказать|этого|этом|права|отказ\w*|воздерж\w*|дать|совет\w*|комментир\w*",
    "pl": r"pom\w*|odpowi\w*|prośb\w*|pytani\w*|temat\w*|spełni\w*|tego|tym|rozmawia\w*|odmawiam|odrzucam|odmówić",
    "zh": r"请求|问题|话题|回答|协助|帮助|帮忙|讨论|提供|答复|内容|这个|这类|该|奉告|拒绝|谈|聊",
    "ja": r"質問|依頼|話題|回答|お答え|答え|お手伝い|手伝|要望|提供|件|内容|その|この|お断り|対応|話",
}
#: A sentence in none of whose rules a match is possible has none of these words.
_SIGNS = {
    "en": "not cannot cant can t unable no nothing rather prefer decline declined declining refuse refused refusing rejected denied abstain say turn stay steer keep stop pass outside beyond against off lack lacks have told asked instructed advised trained required obliged supposed meant inappropriate improper wrong else different another other change forbid forbids prohibit prohibits prevent prevents bar bars rule rules keeps stops won wont",
    "de": "nicht kein keine keinen keinem keiner keines weder ablehnen verweigere verweigern absehen verzichten passen enthalte enthalten ab anderes thema", "nl": "niet geen weiger weigeren afwijzen afslaan bedank bedanken anders ander",
    "fr": "ne n refuse refuser refusons décline décliner abstenir abstiens préfère préférons préférerais autre changer changeons", "es": "no debo debemos tengo tenemos prefiero preferimos quiero rechazo declino niego abstengo rechazamos declinamos otra otro cambiemos cambiar fuera",
    "pt": "não devo devemos tenho temos prefiro preferimos quero recuso declino abstenho recusamos outra outro mudar fora", "it": "non devo dobbiamo preferisco preferiamo voglio vorrei rifiuto declino astengo rifiutiamo altra altro qualcos cambiare cambiamo fuori", "pl": "nie odmawiam odrzucam",
}
_SIGNS = {k: frozenset(v.split()) for k, v in _SIGNS.items()}
_ALONE = {"zh": 14, "ja": 16}
_RULESETS = {k: [re.compile(r, re.I) for r in v] for k, v in GRAMMARS.items()}
_OBJECT = {k: re.compile(v if k in ("zh", "ja") else rf"(?<![^\W_])(?:{v})", re.I) for k, v in OBJECTS.items()}
_NO_LETTERS = re.compile(r"[\u3040-\u9fff]")

# Openings that give nothing by themselves.
_FILLER = re.compile(r"^\W*(?:(?:hello|hi|hey|hmm+|well|note|sorry|apologies|my apologies|thanks|thank you|okay|ok|good question|unfortunately|i(?:['’]m| am) (?:so |very |really )?(?:sorry|afraid)|i apologi[sz]e|answer|response|hallo|guten tag|tut mir leid|es tut mir leid|entschuldigung|leider|het spijt me|sorry hoor|bonjour|salut|désolée?|je suis désolée?|pardon|hola|lo siento|lo lamento|disculpe\w*|perdón|olá|oi|desculpe\w*|sinto muito|lamento|ciao|buongiorno|mi dispiace|spiacente|scusa\w*|здравствуйте|привет|извините|простите|к сожалению|przepraszam|przykro mi|你好|您好|抱歉|很抱歉|对不起|こんにちは|すみません|申し訳ございません|申し訳ありません|ごめんなさい)\W*)+$", re.I)
# Courtesies that may stand beside a refusal and give nothing.
_COURTESY = re.compile(r"let me know|feel free|please (?:consult|ask|contact|try|see)|you (?:may|might|can|could) (?:try|ask|consult|contact|want to)|search engine|hope (?:you|this|that)|have a (?:nice|good)|(?:any|some)thing else|thank you for|thanks for|(?:see|understand|know) why|great question|happy to help|glad to help|other topics?|ask (?:some|any)(?:body|one) else|melden sie sich|gerne|n['’]hésitez pas|bonne journée|si (?:necesitas|quieres|necesita|quiere)|se precisar|se quiser|se hai bisogno|обращайтесь|хорошего дня|如果(?:您|你)|请随时|お気軽に|graag|laat het me weten", re.I)
_NOT_ALL = re.compile(r"\bbut (?:here|you can|the|(?:i|we) can(?!['’]?t|not)(?! not))\b|\byet the\b|\bhowever\b|so plan\b|sorry to hear|\bsay:|politely(?!,? (?:decline|refuse))", re.I)


def declines(sentence: str) -> bool:
    """Whether a sentence declines, by the grammar of any language."""
    east = _NO_LETTERS.search(sentence)
    words = None if east else set(re.findall(r"[^\W\d_]+", sentence.lower()))
    for code, rules in _RULESETS.items():
        if bool(east) != (code in _ALONE) or code in _SIGNS and words.isdisjoint(_SIGNS[code]):
            continue
        if any(r.search(sentence) for r in rules) and (code == "en" or _OBJECT[code].search(sentence) or (len(sentence) <= _ALONE[code] if code in _ALONE else len(words) <= 5)):
            return True
    return False


_ITEMS = re.compile(r"^[ \t]*(?:[-•–+]|\d{1,3}[.)])[ \t]+", re.M)


def is_refusal(text: str) -> bool:
    """Whether a text declines and gives nothing else: every sentence declines, or is a filler
    or a courtesy, and at least one declines. Sentences end at line breaks at the latest, so a
    first line that gives something decides alone."""
    end = text.find("\n")
    if end > 0 and "<!--" not in text and _declining(text[:end]) is None:
        return False
    return bool(_declining(text))


def _declining(text: str) -> bool | None:
    """Whether some sentence declines; None if one gives something else."""
    t = _TAGS.sub(" ", skeleton(text)) if text.isascii() else _TAGS.sub(" ", text)
    t = _ITEMS.sub("", re.sub(r"[*_#`>~]+", " ", t)).strip()
    declined = False
    for p in re.split(r"(?<=[.!?:])\s+|(?<=[。！？])|\n+", t):
        if not any(c.isalnum() for c in p) or _FILLER.match(p):
            continue
        if not _NOT_ALL.search(p) and declines(p):
            declined = True
        elif not _COURTESY.search(p):
            return None
    return declined


@lru_cache(maxsize=2048)
def _prompt_tokens(prompt: str) -> list[str]:
    return tokens(prompt)


def tokens(text: str) -> list[str]:
    """Words, or single letters in scripts without blanks, without case, accents and marks."""
    text = skeleton(_TAGS.sub(" ", text) if "<" in text else text).casefold()
    found = re.findall(r"[^\W_]+", text)
    return found if text.isascii() else [x for w in found for x in (w if _NO_LETTERS.search(w) else (w,))]


def _longest_common(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Length of the longest common runs of two sequences and (end in ``a``, end in ``b``) of those
    found, one for each end in ``b``: ``b`` is read by the suffix automaton of ``a``."""
    nxt: list[dict] = [{}]
    link, size, end, last = [-1], [0], [0], 0
    for k, x in enumerate(a):
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        end.append(k + 1)
        p = last
        while p >= 0 and x not in nxt[p]:
            nxt[p][x] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][x]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                end.append(end[q])
                while p >= 0 and nxt[p].get(x) == q:
                    nxt[p][x] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    state = run = best = 0
    found: list[tuple[int, int]] = []
    for j, y in enumerate(b):
        while state and y not in nxt[state]:
            state = link[state]
            run = size[state]
        if y in nxt[state]:
            state = nxt[state][y]
            run += 1
        if run > best:
            best, found = run, [(end[state], j + 1)]
        elif run == best and run:
            found.append((end[state], j + 1))
    return best, found


def tiles(a: list[str], b: list[str], least: int = 2) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest common runs of tokens, longest first, each token of
    ``a`` and ``b`` in one tile at most, down to ``least`` tokens. Each round takes time in
    proportion to the two texts; used tokens are replaced by marks that equal nothing."""
    left, right = list(a), list(b)
    found = []
    while True:
        best, at = _longest_common(left, right)
        if best < least:
            return found
        for i, j in at:
            if not any(isinstance(x, int) for x in (*left[i - best : i], *right[j - best : j])):
                found.append((i - best, j - best, best))
                left[i - best : i] = range(-2 * i, -2 * i + 2 * best, 2)
                right[j - best : j] = range(2 * j + 1, 2 * j + 1 + 2 * best, 2)


# Words that introduce a prompt given back.
_LEAD = frozenset("user human question prompt you asked q a answer assistant instruction input frage antwort pregunta respuesta pergunta resposta domanda risposta réponse reponse вопрос ответ the was is".split())


def is_copy(prompt: str, text: str, cover: float = 0.8) -> bool:
    """Whether a text gives the prompt back, whole or nearly, and nothing else: tiles cover
    the prompt, and all of the text but introducing words (a prompt given back twice counts)."""
    p, t = _prompt_tokens(prompt), tokens(text)
    if not p or not t:
        return False
    if len(p) < 3:  # nothing to tile: the same words
        return [w for w in t if w not in _LEAD or w in p] == p
    have = Counter(t)
    if sum(w in have for w in p) < cover * len(p) - 1:  # tiles cannot cover more than the words in common
        return False
    words_of = set(p) | _LEAD
    if sum(n for w, n in have.items() if w not in words_of) > max(1, 0.12 * len(t)):  # nor leave fewer words than those that are new
        return False
    rest = t
    covered = [False] * len(p)
    first = True
    while found := tiles(p, rest):
        used = [False] * len(rest)
        for i, j, k in found:
            if first:
                covered[i : i + k] = [True] * k
            used[j : j + k] = [True] * k
        left = [w for w, u in zip(rest, used, strict=True) if not u]
        if first:
            # single words moved or kept between tiles
            spare = Counter(left)
            for i, w in enumerate(p):
                if not covered[i] and spare[w]:
                    covered[i] = True
                    spare[w] -= 1
            single = {w for w, c in zip(p, covered, strict=True) if c}
            left = [w for w in left if w not in single] if len(left) < len(p) else left
        rest, first = left, False
    rest = [w for w in rest if w not in _LEAD]
    # the head of a prompt that carries a text to work on must be there too, else the answer is that text
    head = tokens(re.split(r"[:：]\s", prompt, maxsplit=1)[0]) if re.search(r"[:：]\s", prompt) else []
    if head and sum(covered[: len(head)]) < 0.7 * len(head):
        return False
    return sum(covered) >= cover * len(p) - (1 if len(p) < 8 else 0) and len(rest) <= max(1, 0.12 * len(t))


_NATIVE = {
    "en": "english|englisch|inglés|anglais|inglese|inglês|английск|英语|英文|英語", "es": "spanish|spanisch|español|espagnol|spagnolo|espanhol|castellano|испанск|西班牙|スペイン", "de": "german|deutsch|alemán|allemand|tedesco|alemão|немецк|德语|德文|ドイツ", "fr": "french|französisch|francés|français|francese|francês|французск|法语|法文|フランス",
    "pt": "portuguese|portugiesisch|portugués|portugais|portoghese|português|португальск|葡萄牙|ポルトガル", "it": "italian|italienisch|italiano|italien|итальянск|意大利|イタリア", "ru": "russian|russisch|ruso|russe|russo|русск|俄语|俄文|ロシア", "zh": "chinese|chinesisch|chino|chinois|cinese|chinês|китайск|中文|汉语|中国語", "ja": "japanese|japanisch|japonés|japonais|giapponese|japonês|японск|日语|日文|日本語",
}
_ASKED = {code: re.compile(rf"(?<![^\W_])(?:{names})", re.I) for code, names in _NATIVE.items()}


def asked_languages(prompt: str) -> set[str]:
    """Languages a prompt names."""
    found = {code for code, r in _ASKED.items() if r.search(prompt)}
    return found | {code for name, code in NAMES.items() if code not in _ASKED and re.search(rf"(?<![^\W_]){name}(?![^\W_])", prompt, re.I)}


def main_language(reader: Reader, text: str, min_letters: int = 12, least: float = 0.2) -> str:
    """Language of most letters of a text; ``und`` where little of it is language."""
    sentences = sentences_of(text)
    reader.prepare(set(sentences))  # those of a whole batch are known already
    _, whole, main = reader.read([sentences])
    if not whole:
        return UNDETERMINED
    best = max(whole, key=lambda c: (whole[c], c))
    return best if whole[best] >= min_letters or best in ("zh", "ja") and whole[best] >= 4 else UNDETERMINED


LOOKED = "what string, answer_id string, question_id bigint, model_id string, choice_index int, turn_index int, judged boolean, found string, other_language boolean, verdict string, kind string, words string, final string, goes_on bigint, ends bigint, closes bigint"


def inspect(slots: DataFrame, model: Model | None, only_cut: bool = False) -> DataFrame:
    """All that is asked of the texts, in one pass and without the texts. Two sorts of rows:

    ``what`` = turn: a slot with its sizes (``MEASURES``), ``found`` (empty, copy, refusal or
    null), ``other_language`` (the answer is in none of the languages its prompt is in or
    asks for; null without ``model``), and verdict, kind, ``words`` and ``final`` of its ending (null without a text).
    ``what`` = use: how often ``words`` go on, end a complete line and close a text
    (see ``count_usage``), counted in each batch first, so only distinct words are shuffled.
    With ``only_cut`` a turn whose ending is whole is not looked at further: ``found`` is null.
    """
    shared = slots.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([LOOKED, *[f"{m} bigint" for m in MEASURES]])
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value) if shared.value is not None else None
        for b in batches:
            prompts, texts = b.column(6).to_pylist(), b.column(7).to_pylist()
            judged = b.column(5).to_pylist()
            if reader:
                reader.prepare({x for t, j in zip(texts, judged, strict=True) if j for x in sentences_of(t)} | {x for t in set(prompts) for x in sentences_of(t)})
            found, other, ends = [], [], []
            uses: list[tuple[str, str, str, int]] = []
            of_prompt: dict[str, tuple[str, set[str]]] = {}
            sizes: list[tuple[int, ...]] = []
            for prompt, text, j in zip(prompts, texts, judged, strict=True):
                verdict = None
                if text is None:
                    ends.append((None, None, None, None))
                    sizes.append((0,) * len(MEASURES))
                else:
                    tail = text.rstrip("\u200b\u200c\u200d\u2060\ufeff\u200e\u200f").rstrip()
                    parsed = parse(tail)
                    verdict, kind, last = ending(text, parsed)
                    line = {"item": "i", "verse": "v"}.get(kind, "p")
                    ends.append((verdict, kind, f"{line} {last}", f"{line}1 {last.rpartition(' ')[2]}"))
                    sizes.append(sizes_of(text))
                    uses.extend(word_uses(parsed[0]))
                what = None
                if j and not (only_cut and verdict == "whole"):
                    what = "empty" if is_empty(text) else "copy" if prompt and is_copy(prompt, text) else "refusal" if is_refusal(text) else None
                found.append(what)
                foreign = None
                if reader and j and what is None and prompt:
                    if prompt not in of_prompt:
                        of_prompt[prompt] = main_language(reader, prompt), asked_languages(prompt)
                    own, asked = of_prompt[prompt]
                    lang = main_language(reader, text) if own != UNDETERMINED else UNDETERMINED
                    foreign = UNDETERMINED not in (lang, own) and lang != own and lang not in asked
                other.append(foreign)
            count = count_usage(uses)
            n, k = b.num_rows, len(count)
            verdicts = list(zip(*ends, strict=True)) if ends else [()] * 4
            nothing = [None] * k
            columns = [["turn"] * n + ["use"] * k, *[b.column(c).to_pylist() + nothing for c in range(5)], judged + nothing, found + nothing, other + nothing, list(verdicts[0]) + nothing, list(verdicts[1]) + nothing, list(verdicts[2]) + list(count), list(verdicts[3]) + nothing]
            columns += [[None] * n + [c[i] for c in count.values()] for i in range(3)]
            columns += [[x[i] for x in sizes] + nothing for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return slots.select("answer_id", "question_id", "model_id", F.col("choice_index").cast("int"), F.col("turn_index").cast("int"), "judged", "prompt", "text").mapInArrow(run, schema)


def defects(answers: DataFrame, questions: DataFrame, model: Model | None, only_cut: bool = False) -> DataFrame:
    """(answer_id, choice_index, turn_index, model_id, defect_type, kind, at_limit) of every answer
    turn, one per prompt of its question; ``defect_type`` is null for sound turns. Without
    ``model`` no language is read and wrong_language is not found; with ``only_cut`` no type but
    truncated is found for certain.

    Order where several would hold: empty, copy, refusal, truncated, wrong_language. A turn
    whose question is unknown is judged without a prompt; a turn beyond the prompts is not
    judged, but counts for the limits and the use of words.
    """
    looked = materialise(inspect(answer_slots(answers, questions), model, only_cut))
    cut = broken_off(looked)
    kind = F.coalesce("found", F.when(F.col("broken"), "truncated"), F.when(F.col("other_language"), "wrong_language"))
    columns = ["answer_id", "choice_index", "turn_index", "model_id"]
    absent = looked.where("what = 'turn' and judged and verdict is null").select(*columns, F.col("found").alias("defect_type"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("at_limit"))
    # rows of one answer id that differ elsewhere may share a slot: one row for each slot
    return cut.where("judged").select(*columns, kind.alias("defect_type"), "kind", "at_limit").unionByName(absent).dropDuplicates(["answer_id", "choice_index", "turn_index"])

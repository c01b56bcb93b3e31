"""Language of documents and of mixed-language segments by cross-parsing entropy.

A suffix automaton of labelled text is kept per language. A text is parsed greedily into
the longest phrases that occur in the labelled text of a language; the language that
needs the fewest phrases per character wins, and the distance to the second gives the
confidence. Automata over small alphabets are dense transition tables, so thousands of
sentences are parsed in step with array operations.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# English names and ISO 639-1 codes of languages.
NAMES = {
    "english": "en", "spanish": "es", "castilian": "es", "german": "de", "french": "fr", "portuguese": "pt", "italian": "it", "russian": "ru", "chinese": "zh", "mandarin": "zh", "japanese": "ja",
    "danish": "da", "dutch": "nl", "flemish": "nl", "scots": "sco", "latin": "la", "catalan": "ca", "galician": "gl", "ukrainian": "uk", "korean": "ko", "polish": "pl", "czech": "cs", "slovak": "sk",
    "swedish": "sv", "norwegian": "no", "finnish": "fi", "hungarian": "hu", "romanian": "ro", "greek": "el", "turkish": "tr", "arabic": "ar", "hebrew": "he", "hindi": "hi", "vietnamese": "vi", "thai": "th",
    "indonesian": "id", "malay": "ms", "bulgarian": "bg", "serbian": "sr", "croatian": "hr", "slovenian": "sl", "persian": "fa", "basque": "eu", "irish": "ga", "welsh": "cy", "afrikaans": "af", "belarusian": "be",
}
PLACEHOLDERS = ("", "und", "unknown", "n/a", "na", "none", "null", "nan", "-", "?", "other", "undefined", "mis", "mul", "zxx", "xx", "unk", "auto")
UNDETERMINED = "und"

SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])|\n+")
CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]+`|https?://\S+|\S+@\S+|</?[A-Za-z][^<>\n]{0,200}>", re.S)


def label_code(c: Column | str) -> Column:
    """ISO code of a label: an English name or a code with or without region, in any case;
    placeholders and blanks are null, an unknown name stays itself."""
    c = F.col(c) if isinstance(c, str) else c
    name = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    base = F.regexp_extract(name, r"^([a-z]{2,3})(?:[-_][a-z0-9]{2,8})*$", 1)
    return F.when(name.isin(*PLACEHOLDERS), F.lit(None)).otherwise(F.coalesce(known[name], F.when((base != "") & ~base.isin(*PLACEHOLDERS), base), F.when(name.isin(*PLACEHOLDERS), None).otherwise(name)))


_SPACES = re.compile(r"[\W\d_]+")


_JOINED = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "þ": "th", "ð": "d"})


def normal(text: str) -> str:
    """Letters without case and accents; everything else is one blank. Latin text becomes ASCII."""
    text = text.casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_JOINED)
    return _SPACES.sub(" ", text).strip()


class Automaton:
    """Suffix automaton of a text (transitions and links only)."""

    def __init__(self, text: str = "") -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0
        for ch in text:
            self.add(ch)

    def add(self, ch: str) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        p = self.last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def phrases(self, text: str) -> int:
        """Number of greedy longest-match phrases of ``text``."""
        nxt, state, n = self.next, 0, 1
        root = nxt[0]
        for ch in text:
            to = nxt[state].get(ch)
            if to is None:
                n += 1
                state = root.get(ch, 0)
            else:
                state = to
        return n


@dataclass
class Language:
    code: str
    #: a dense automaton: [state, symbol] -> next state times width; where a phrase ends,
    #: the state after the first letter of the next one, minus 2^31
    table: np.ndarray | None = None
    #: otherwise the transitions of each state
    sparse: list[dict[str, int]] | None = None
    #: whether the dense alphabet is the ASCII one
    latin: bool = True


ENDS = np.int32(-(2**31))


class Dense:
    """The dense automata over one alphabet."""

    def __init__(self, letters: str) -> None:
        self.letters = letters
        self.width = len(letters) + 1
        self.lookup = np.zeros(0x10000, np.int64)
        for k, ch in enumerate(letters):
            self.lookup[ord(ch)] = k + 1

    def table(self, auto: Automaton) -> np.ndarray:
        t = np.zeros((len(auto.next), self.width), np.int64)
        known = {ch: k + 1 for k, ch in enumerate(self.letters)}
        for state, row in enumerate(auto.next):
            for ch, to in row.items():
                if ch in known:
                    t[state, known[ch]] = to
        restart = np.broadcast_to(t[0] * self.width - 2**31, t.shape)
        return np.where(t > 0, t * self.width, restart).astype(np.int32).ravel()

    def phrases(self, texts: list[str], tables: list[np.ndarray]) -> np.ndarray:
        """[text, table] phrase counts; all texts are parsed in step, longest first."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.lookup[np.minimum(points, 0xFFFF)]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size) - size
        order = np.argsort(-size, kind="stable")
        size, start = size[order], start[order]
        n = np.ones((len(tables), len(texts)), np.int32)
        state = np.zeros((len(tables), len(texts)), np.int32)
        # the number of texts longer than t, for each t
        longer = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        for t, active in enumerate(longer.tolist()):
            c = codes[start[:active] + t]
            for k, table in enumerate(tables):
                now = state[k, :active]
                to = table.take(now + c)
                n[k, :active] -= to >> 31
                np.bitwise_and(to, 0x7FFFFFFF, out=now)
        back = np.empty_like(n)
        back[:, order] = n
        return back.T


LATIN = Dense(" abcdefghijklmnopqrstuvwxyz")


@dataclass
class Model:
    languages: list[Language] = field(default_factory=list)
    other: str = " "

    def __post_init__(self) -> None:
        self.dense = Dense(self.other)

    def phrase_counts(self, texts: list[str]) -> np.ndarray:
        """[text, language]: phrases needed for each normalised text. ASCII texts are parsed
        by the Latin languages only, others by all."""
        out = np.full((len(texts), len(self.languages)), 2**30, np.int32)
        ascii_ = np.fromiter((t.isascii() for t in texts), bool, len(texts))
        latin = [k for k, x in enumerate(self.languages) if x.table is not None and x.latin]
        rest = [k for k, x in enumerate(self.languages) if x.table is not None and not x.latin]
        wide = np.flatnonzero(~ascii_)
        if len(texts) and latin:
            out[:, latin] = LATIN.phrases(texts, [self.languages[k].table for k in latin])
        if len(wide):
            some = [texts[i] for i in wide]
            if rest:
                out[np.ix_(wide, rest)] = self.dense.phrases(some, [self.languages[k].table for k in rest])
            for k, x in enumerate(self.languages):
                if x.sparse is not None:
                    out[wide, k] = [_sparse_phrases(x.sparse, t) for t in some]
        return out

    @property
    def codes(self) -> list[str]:
        return [x.code for x in self.languages] + [UNDETERMINED]

    def costs(self, sentences: list[str]) -> list[tuple[int, int, tuple[int, ...]]]:
        """(letters, words, phrases by each language and by none) of each sentence. In scripts
        without blanks three letters count as a word. Text of no known language costs a
        phrase for every two letters (of scripts without blanks, for every letter)."""
        texts = [normal(s) for s in sentences]
        rows = self.phrase_counts(texts).tolist() if self.languages else [[] for _ in texts]
        out = []
        for t, row in zip(texts, rows, strict=True):
            wide = not t.isascii() and 2 * sum("\u3040" <= c <= "\u9fff" for c in t) > len(t)
            none = max(2, len(t)) if wide else max(3, (len(t) * 2) // 5)
            out.append((len(t), len(t) // 3 if wide else t.count(" ") + 1 if t else 0, (*row, none)))
        return out


def _sparse_phrases(nxt: list[dict[str, int]], text: str) -> int:
    state, n, root = 0, 1, nxt[0]
    for ch in text:
        to = nxt[state].get(ch)
        if to is None:
            n += 1
            state = root.get(ch, 0)
        else:
            state = to
    return n


def build(samples: dict[str, list[str]], chars: int) -> Model:
    """Automata of the normalised ``samples`` per language, ``chars`` characters each at most.

    Languages of up to 60 letters get dense tables, the others (ideographs) sparse ones.
    """
    texts: dict[str, str] = {}
    for code in samples:
        joined, size = [], 0
        for s in samples[code]:
            if size >= chars:
                break
            joined.append(s[: chars - size])
            size += len(joined[-1]) + 1
        if joined:
            texts[code] = "\n".join(joined)
    few = {c for c, t in texts.items() if len(set(t)) <= 60}
    latin = {c for c in few if sum(ch.isascii() for ch in texts[c]) > 0.5 * len(texts[c])}
    other = sorted({ch for c in few - latin for ch in texts[c] if ch != "\n" and ord(ch) < 0x10000} | {" "})
    model = Model(other="".join(other))
    for code, text in texts.items():
        auto = Automaton(text)
        if code in few:
            model.languages.append(Language(code, table=(LATIN if code in latin else model.dense).table(auto), latin=code in latin))
        else:
            model.languages.append(Language(code, sparse=auto.next, latin=False))
    return model


def sentences_of(text: str | None) -> list[str]:
    """Sentences and lines of a text without code, addresses of any kind and mark-up."""
    if not text:
        return []
    if "`" in text or "@" in text or "<" in text or "://" in text:
        text = CODE.sub("\n", text)
    return [s for s in SENTENCE.split(text) if s and not s.isspace()]


def _units(sentence: str) -> list[str]:
    """Words, or letters in scripts without blanks."""
    return [u for w in sentence.split() for u in ([w] if w.isascii() or len(w) < 3 or not any("\u3040" <= c <= "\u9fff" for c in w) else w)]


def clean(half: list[dict[str, list[str]]], frequency: dict[str, int], min_share: float) -> dict[str, list[str]]:
    """The sentences whose label is to be believed.

    A few wrong labels put whole sentences of one language into the text of another, so
    mere occurrence proves little; frequency does. Cross-fitted word counts: the sentences
    of each half are scored by the counts of the other. Labels are taken from the most
    frequent to the least; one is a language of its own only if at least ``min_share`` of
    its sentences are likelier by its own counts than by those of every label accepted
    before. A sentence is kept where its own label is the likeliest.
    """
    codes = sorted((c for c in frequency if len(half[0].get(c, [])) + len(half[1].get(c, [])) >= 6), key=lambda c: (-frequency[c], c))
    score: dict[str, list[tuple[str, np.ndarray]]] = {c: [] for c in codes}
    for k in (0, 1):
        counts = [Counter(u for s in half[1 - k].get(c, []) for u in _units(s)) for c in codes]
        totals = [sum(x.values()) for x in counts]
        for c in codes:
            for s in half[k].get(c, []):
                units = _units(s)
                score[c].append((s, np.array([sum(math.log((x[u] + 0.1) / (n + 1000.0)) for u in units) for x, n in zip(counts, totals, strict=True)])))
    accepted: list[int] = []
    for j, c in enumerate(codes):
        own = np.array([f[j] for _, f in score[c]])
        best = np.array([f[accepted].max() if accepted else -np.inf for _, f in score[c]])
        if (own > best + 0.5).mean() >= min_share:
            accepted.append(j)
    kept: dict[str, list[str]] = {}
    for j in accepted:
        kept[codes[j]] = list(dict.fromkeys(s for s, f in score[codes[j]] if f[j] >= f[accepted].max()))
    return kept


def parse(costs: list[tuple[int, ...]], breaks: list[bool], switch: int = 5, turn: int = 2) -> list[int]:
    """The cheapest language of each sentence in a row: phrases needed plus ``switch`` for each
    change of language, only ``turn`` where a new message begins (``breaks``)."""
    if not costs:
        return []
    best = [min(range(len(c)), key=c.__getitem__) for c in costs]
    if all(b == best[0] for b in best):
        return best
    n = len(costs[0])
    total, back = list(costs[0]), []
    for c, new in zip(costs[1:], breaks[1:], strict=True):
        k = min(range(n), key=total.__getitem__)
        change = total[k] + (turn if new else switch)
        back.append([j if total[j] <= change else k for j in range(n)])
        total = [min(total[j], change) + c[j] for j in range(n)]
    k = min(range(n), key=total.__getitem__)
    path = [k]
    for row in reversed(back):
        k = row[k]
        path.append(k)
    return path[::-1]


class Reader:
    """Reads conversations with a model; remembers the costs of sentences seen before (only
    a saving of time: a bounded memory that is emptied when full)."""

    def __init__(self, model: Model, memory: int = 60_000, min_words: int = 3, margin: float = 0.12) -> None:
        self.model, self.memory, self.min_words, self.margin = model, memory, min_words, margin
        self.known: dict[str, tuple[int, int, tuple[int, ...]]] = {}
        self.codes = model.codes

    def prepare(self, sentences: set[str]) -> None:
        if len(self.known) > self.memory:
            self.known.clear()
        new = [s for s in sentences if s not in self.known]
        for begin in range(0, len(new), 8192):
            part = new[begin : begin + 8192]
            self.known.update(zip(part, self.model.costs(part), strict=True))

    def read(self, messages: list[list[str]]) -> tuple[list[list[tuple[int, int, float]]], dict[str, int], list[str]]:
        """For each message its segments (first sentence, language, confidence); the letters
        of whole sentences of each language; the main language of each message.

        A sentence is evidence for a language if it has ``min_words`` words and the language
        needs ``margin`` fewer phrases than the next one."""
        flat, breaks = [], []
        for m in messages:
            for k, s in enumerate(m):
                flat.append(self.known[s])
                breaks.append(k == 0)
        path = parse([f[2] for f in flat], breaks)
        none = len(self.codes) - 1
        at, found, whole, main = 0, [], {}, []
        for m in messages:
            segments: list[tuple[int, int, float]] = []
            weight: dict[int, int] = {}
            gain: list[list[int]] = []
            for k in range(len(m)):
                letters, words, cost = flat[at]
                lang = path[at]
                at += 1
                own = cost[lang]
                rest = min((c for j, c in enumerate(cost) if j != lang), default=own)
                if not segments or segments[-1][1] != lang:
                    segments.append((k, lang, 0.0))
                    gain.append([0, 0])
                gain[-1][0] += rest - own
                gain[-1][1] += max(rest, 1)
                if lang != none:
                    weight[lang] = weight.get(lang, 0) + letters
                    if words >= self.min_words and rest - own >= max(1, self.margin * rest):
                        code = self.codes[lang]
                        whole[code] = whole.get(code, 0) + letters
            found.append([(k, lang, min(1.0, max(0.0, g[0] / g[1])) if lang != none else 0.0) for (k, lang, _), g in zip(segments, gain, strict=True)])
            main.append(self.codes[max(weight, key=lambda j: (weight[j], -j))] if weight else UNDETERMINED)
        return found, whole, main


SEGMENT = "array<struct<message_no:int,segment_no:int,text:string,language:string,confidence:double>>"


def read_conversations(df: DataFrame, conversation: str, model: Model, keep: list[str], segments: bool = True) -> DataFrame:
    """One row per conversation: the columns ``keep``, ``first_language`` and
    ``first_confidence`` of the first user message, ``languages`` (those of at least one
    whole sentence, in order of letters; the first user message's language is always in),
    and with ``segments`` each stretch of text in one language.

    A null conversation, null or blank messages give ``und`` and no segment; a message
    of code, numbers or addresses only has no language. Messages are read whole.
    """
    known = [c for c in keep if c != conversation]
    schema = df.select(*known, F.lit("").alias("first_language"), F.lit(0.0).alias("first_confidence"), F.lit(None).cast("array<string>").alias("languages"), F.lit(None).cast(SEGMENT).alias("segments")).schema
    out_types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.struct([("message_no", pa.int32()), ("segment_no", pa.int32()), ("text", pa.string()), ("language", pa.string()), ("confidence", pa.float64())]))]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            col = b.column(len(known))
            offsets = col.offsets.to_pylist()
            roles = col.values.field(0).to_pylist()
            texts = col.values.field(1).to_pylist()
            split: list[list[str]] = []
            new: set[str] = set()
            for t in texts:
                s = sentences_of(t)
                new.update(s)
                split.append(s)
            reader.prepare(new)
            rows: list[tuple] = []
            for begin, end in zip(offsets, offsets[1:], strict=False):
                messages = split[begin:end]
                found, whole, main = reader.read(messages)
                first = next((k for k in range(end - begin) if roles[begin + k] == "user" and texts[begin + k]), None)
                code = main[first] if first is not None else UNDETERMINED
                conf = max((c for _, lang, c in found[first] if reader.codes[lang] == code), default=0.0) if first is not None else 0.0
                langs = sorted(whole, key=lambda c: (-whole[c], c))
                if code != UNDETERMINED and code not in whole:
                    langs.append(code)
                parts = []
                if segments:
                    for no, (m, segs) in enumerate(zip(messages, found, strict=True)):
                        for k, (at, lang, c) in enumerate(segs):
                            to = segs[k + 1][0] if k + 1 < len(segs) else len(m)
                            parts.append({"message_no": no, "segment_no": k, "text": " ".join(x.strip() for x in m[at:to]), "language": reader.codes[lang], "confidence": round(c, 6)})
                rows.append((code, round(conf, 6), langs, parts))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*b.columns[: len(known)], *[pa.array(c, t) for c, t in zip(cols, out_types, strict=True)]], names=[*known, "first_language", "first_confidence", "languages", "segments"])

    return df.select(*known, F.transform(F.coalesce(conversation, F.array()), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("c")).mapInArrow(run, schema)


def fit(labelled: DataFrame, text: str, label: str, rows_per_label: int = 400, chars: int = 24_000, min_share: float = 0.7, labels: int = 400) -> Model:
    """Fit the automata on at most ``rows_per_label`` labelled rows for each label, chosen by a
    hash of the text, of the ``labels`` most frequent labels (there are 184 two-letter codes; what
    is beyond is misspelt), and ``chars`` characters for each language. These bounds limit
    the labelled sample only, not the texts that are classified.

    Labels may be wrong; see ``clean``. No labels give an empty model, which finds nothing.
    """
    rows = labelled.select(label_code(label).alias("code"), F.col(text).alias("text")).where("code is not null and text is not null and trim(text) <> ''")
    frequency = {r["code"]: r["count"] for r in rows.groupBy("code").count().orderBy(F.desc("count"), "code").limit(labels).collect()}
    hashed = rows.where(F.col("code").isin(*frequency)).withColumn("h", F.xxhash64("text"))
    top = hashed.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("h", "text"))).where(F.col("n") <= rows_per_label)
    sample = sorted((r["code"], r["h"], r["text"]) for r in top.select("code", "h", "text").collect())
    half: list[dict[str, list[str]]] = [defaultdict(list), defaultdict(list)]
    for k, (code, _, t) in enumerate(sample):
        half[k % 2][code] += [s for s in map(normal, sentences_of(t)) if len(s) >= 6 or (len(s) >= 3 and not s.isascii())]
    return build(clean(half, frequency, min_share), chars)

"""Evaluation texts leaking into training text: a distributed positional inverted index.

1. Documents become index segments, stored once as a table in the shared folder: for each
   term of a segment the list of its places, over all documents of the segment. A document is
   in one segment whole, so all lists that an intersection needs are in one row, and nothing
   is shuffled however many documents there are.
2. Every run of a few test words is looked up in every segment: the list of its rarest term
   gives the places, the lists of its other terms, adjusted by their offsets and taken from
   the rarest on, must hold the neighbouring ones.
3. Runs that follow each other are exact phrases. A pair of document and test text whose
   phrases cannot make up a passage, whatever stands between them, is dropped; the others are
   matched word by word from the lists: runs of equal words in order that may step over
   single altered, inserted or missing words (proximity matches).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.skeleton import skeleton
from palaver.session import materialise

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,300}>|<!--.{0,2000}?-->|&(?:[a-z]{2,8}|#\d{1,6});|\\[nrt\"\\]|\\u[0-9a-fA-F]{4}", re.S)
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[ \t]*(?=[^\W\d_])")


def words(text: str | None) -> list[str]:
    """Words without regard to case, accents, character forms, mark-up and punctuation."""
    if not text:
        return []
    text = _BROKEN.sub("", _TAG.sub(" ", skeleton(text))).lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return _WORD.findall(text)


def term_id(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


SEGMENT = "ids array<bigint>, firsts array<int>, terms array<bigint>, ends array<int>, places array<int>"


def index(df: DataFrame, id_col: str, text: str, tokens: int = 1 << 18) -> DataFrame:
    """Segments of the positional inverted index, of about ``tokens`` words each (a document
    is never split). ``ids`` and ``firsts``: the documents and their first place; ``terms``, in
    order: the terms; ``places``: the lists one after the other, each in order, that of
    term k up to ``ends[k]``. Between two documents one place is free, so no run of places
    crosses them. Null ids and texts without a word are left out."""

    def segment(ids: list[int], lengths: list[int], words_of: list[int]) -> list[np.ndarray]:
        size = np.array(lengths, np.int64)
        firsts = np.cumsum(size + 1) - size - 1
        place = np.arange(int(size.sum()), dtype=np.int64) + np.repeat(np.arange(len(size)), size)
        term = np.array(words_of, np.int64)
        order = np.argsort(term, kind="stable")
        term = term[order]
        begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        return [np.array(ids, np.int64), firsts.astype(np.int32), term[begins], np.r_[begins[1:], len(term)].astype(np.int32), place[order].astype(np.int32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        ids: list[int] = []
        lengths: list[int] = []
        held: list[int] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array([x]) for x in segment(ids, lengths, held)]
            ids.clear(), lengths.clear(), held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["ids", "firsts", "terms", "ends", "places"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words(t) if i is not None else []
                if not ws:
                    continue
                for w in ws:
                    h = known.get(w)
                    if h is None:
                        h = term_id(w)
                        if len(known) < 500_000:  # memory of the cache only; the value is the same without it
                            known[w] = h
                    held.append(h)
                ids.append(i)
                lengths.append(len(ws))
                if len(held) >= tokens:
                    yield out()
        if ids:
            yield out()

    return df.select(F.col(id_col).cast("bigint"), F.col(text)).mapInArrow(run, SEGMENT)


class Lists(NamedTuple):
    """One segment. ``keys`` are number of the list and place in one integer, in order."""

    ids: np.ndarray
    firsts: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, firsts: np.ndarray, terms: np.ndarray, ends: np.ndarray, places: np.ndarray) -> Lists:
        sizes = np.diff(ends, prepend=0)
        return Lists(ids, firsts.astype(np.int64), terms, ends.astype(np.int64), np.repeat(np.arange(len(terms), dtype=np.int64), sizes) << 32 | places.astype(np.int64))

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the list of each term, whether there is one)."""
        at = np.searchsorted(self.terms, wanted)
        at[at == len(self.terms)] = 0
        return at, self.terms[at] == wanted

    def phrases(self, runs: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(run, first place) wherever the words of a run (a row of ``runs``) stand in order: the
        list of the rarest word, intersected with the others from the rarest on. Runs are
        taken in portions of about ``most`` places."""
        at, there = self.find(runs.ravel())
        alive = np.flatnonzero(there.reshape(runs.shape).all(axis=1))
        if not len(alive):
            return
        lists = at.reshape(runs.shape)[alive]
        begins = np.r_[0, self.ends[:-1]]
        sizes = (self.ends - begins)[lists]
        order = np.argsort(sizes, axis=1, kind="stable")
        rarest = np.take_along_axis(sizes, order[:, :1], 1)[:, 0]
        cuts = np.searchsorted(np.cumsum(rarest), np.arange(most, int(rarest.sum()) + most, most))
        for lo, hi in zip([0, *cuts[:-1] + 1], cuts + 1, strict=True):
            hi = min(int(hi), len(alive))
            if lo >= hi:
                continue
            some, n = np.arange(lo, hi), rarest[lo:hi]
            first = lists[some, order[some, 0]]
            row = np.repeat(some, n)
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = (self.keys[np.repeat(begins[first], n) + offset] & 0xFFFFFFFF) - order[row, 0]
            for k in range(1, runs.shape[1]):
                word = order[row, k]
                key = lists[row, word] << 32 | (start + word)
                found = np.searchsorted(self.keys, key)
                found[found == len(self.keys)] = 0
                hit = (self.keys[found] == key) & (start >= 0)
                row, start = row[hit], start[hit]
            yield alive[row], start

    def where(self, doc: int, item: list[int]) -> dict[int, list[int]]:
        """The places of each word of a test text in one document, from its first place on."""
        low = self.firsts[doc]
        high = self.firsts[doc + 1] if doc + 1 < len(self.firsts) else 1 << 31
        wanted = np.array(sorted(set(item)), np.int64)
        at, there = self.find(wanted)
        begin, end = np.searchsorted(self.keys, at << 32 | low), np.searchsorted(self.keys, at << 32 | high)
        return {int(t): ((self.keys[b:e] & 0xFFFFFFFF) - low).tolist() for t, ok, b, e in zip(wanted, there, begin, end, strict=True) if ok and e > b}


class Tests(NamedTuple):
    """Test texts and their different runs of ``clean`` words: ``runs`` has a row for each,
    ``text`` and ``place`` say where run k stands: from ``ends[k - 1]`` up to ``ends[k]``."""

    keys: list[tuple[int, str]]
    tokens: list[list[int]]
    runs: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str, list[int]]], clean: int) -> Tests:
        tokens = [list(r[2]) for r in rows]
        n = np.array([len(t) - clean + 1 for t in tokens], np.int64)
        text = np.repeat(np.arange(len(tokens)), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.array(t, np.int64), clean) for t in tokens])
        runs, back = np.unique(windows, axis=0, return_inverse=True)
        order = np.argsort(back.ravel(), kind="stable")
        return Tests([(r[0], r[1]) for r in rows], tokens, runs, np.cumsum(np.bincount(back.ravel(), minlength=len(runs))), text[order], place[order])


class Rule(NamedTuple):
    """A passage has ``length`` equal words or more and at most one altered word for every
    ``per_altered`` equal ones, or every ``per_altered_long`` where ``long`` or more are equal."""

    length: int
    per_altered: int
    long: int
    per_altered_long: int

    def keeps(self, equal: int, altered: int) -> bool:
        return equal >= self.length and altered * (self.per_altered if equal < self.long else self.per_altered_long) <= equal

    @property
    def clean(self) -> int:
        """Equal words in a row that every passage holds: m equal and a altered words make a run of m / (a + 1)."""
        return min(self.length, self.per_altered // 2, self.long // (self.long // self.per_altered_long + 1))

    def possible(self, runs: list[int]) -> bool:
        """Whether exact runs of these lengths (all of ``clean`` words or more that there are),
        and shorter ones between them, can make up a passage."""
        runs = sorted(runs, reverse=True)
        rate = min(self.per_altered, self.per_altered_long)
        equal, altered = 0, 0
        while True:  # the most equal words with so many altered ones
            equal += runs[altered] if altered < len(runs) else self.clean - 1
            if self.keeps(equal, altered) or self.keeps(min(equal, self.long - 1), altered):
                return True
            altered += 1
            if altered >= len(runs) and rate * altered > equal + self.clean - 1:  # from here on the altered words need more than they bring
                return False


def best_passage(where: dict[int, list[int]], item: list[int]) -> tuple[int, int, int, int]:
    """(equal words, altered words, first place in the document, first place in the item)
    of the best run: equal words count 1, a step over one altered, inserted or missing
    word costs 2. Runs never step over two altered words at once. ``where`` has the places
    of each word of the item in the document."""
    runs: dict[tuple[int, int], tuple] = {}
    best: tuple = (0, 0, 0, 0, 0)
    for i, w in enumerate(item):
        for p in where.get(w, ()):
            run = (1, 1, 0, p, i)
            for di, dp, cost in ((1, 1, 0), (2, 2, 1), (1, 2, 1), (2, 1, 1)):
                old = runs.get((i - di, p - dp))
                if old and old[0] - 2 * cost + 1 > run[0]:
                    run = (old[0] - 2 * cost + 1, old[1] + 1, old[2] + cost, old[3], old[4])
            runs[i, p] = run
            if run > best:
                best = run
    return best[1:]


def runs_by_altered(where: dict[int, list[int]], item: list[int], most: int, per_altered: int) -> dict[int, tuple[int, int, int]]:
    """For each number of altered words up to ``most``: (equal words, first place in the
    document, first place in the item) of the run with the most equal words. Runs that
    cannot reach ``per_altered`` equal words for each altered one any more, and runs with
    no more equal words than another of the same end with fewer altered ones, are left out."""
    runs: dict[tuple[int, int], dict[int, tuple[int, int, int]]] = {}
    best: dict[int, tuple[int, int, int]] = {}
    for i, w in enumerate(item):
        left = len(item) - 1 - i
        for p in where.get(w, ()):
            here = {0: (1, p, i)}
            for di, dp, cost in ((1, 1, 0), (2, 2, 1), (1, 2, 1), (2, 1, 1)):
                for altered, (equal, p0, i0) in runs.get((i - di, p - dp), {}).items():
                    altered += cost
                    if altered <= most and equal + 1 + left >= altered * per_altered and here.get(altered, (0,))[0] < equal + 1:
                        here[altered] = (equal + 1, p0, i0)
            top = 0
            kept = {}
            for altered in sorted(here):
                if here[altered][0] > top:
                    kept[altered], top = here[altered], here[altered][0]
                    if top > best.get(altered, (0,))[0]:
                        best[altered] = here[altered]
            runs[i, p] = kept
    return best


def leak(where: dict[int, list[int]], item: list[int], rule: Rule) -> tuple[int, int, int, int] | None:
    """The best run (as ``best_passage``) of those that keep the rule, None if none does."""
    best = best_passage(where, item)
    if rule.keeps(*best[:2]):
        return best
    rate = min(rule.per_altered, rule.per_altered_long)
    # for one number of altered words more equal words are never worse, as long runs have the lower rate
    found = [(equal, altered, p, i) for altered, (equal, p, i) in runs_by_altered(where, item, len(item) // rate, rate).items() if rule.keeps(equal, altered)]
    return max(found, key=lambda r: (r[0] - 2 * r[1], r)) if found else None


def search(lists: Lists, tests: Tests, rule: Rule) -> Iterator[tuple]:
    """(doc_id, item_id, part, equal, altered, doc_place, item_place) of one segment."""
    clean = tests.runs.shape[1]
    begins = np.r_[0, tests.ends[:-1]]
    hits = []
    for run, start in lists.phrases(tests.runs):
        n = (tests.ends - begins)[run]
        at = np.repeat(begins[run], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(start, n)
        hits.append(np.stack([np.searchsorted(lists.firsts, start, side="right") - 1, tests.text[at], start - tests.place[at], tests.place[at]]))
    if not hits:
        return
    doc, text, diagonal, place = np.concatenate(hits, axis=1)
    order = np.lexsort((place, diagonal, text, doc))
    doc, text, diagonal, place = doc[order], text[order], diagonal[order], place[order]
    pair = np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]
    fresh = np.flatnonzero(pair | np.r_[True, (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)])
    length = np.diff(np.r_[fresh, len(doc)]) + clean - 1
    first = np.flatnonzero(pair[fresh])
    for b, e in zip(first.tolist(), [*first[1:].tolist(), len(fresh)], strict=True):
        if not rule.possible(length[b:e].tolist()):
            continue
        d, k = int(doc[fresh[b]]), int(text[fresh[b]])
        item = tests.tokens[k]
        if found := leak(lists.where(d, item), item, rule):
            yield (int(lists.ids[d]), *tests.keys[k], *found)


def leaked_passages(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", parts: tuple[str, ...] = ("prompt", "reference"), length: int = 12, per_altered: int = 14, long: int = 24, per_altered_long: int = 8, block: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, part, equal, altered, doc_place, item_place): one row for each
    document and test text of which it holds ``length`` or more words in their order,
    with at most one altered word for every ``per_altered`` equal ones, or for every
    ``per_altered_long`` of a passage of ``long`` or more equal words.

    The test material is sent to the executors in blocks of about ``block`` words (16 bytes
    each), however much there is; each block is searched in all segments of the index.
    Null and empty texts hold nothing. A test text shorter than ``length`` words is never
    found. Repeated ids are the caller's concern: their rows are matched one by one.
    """
    spark = documents.sparkSession
    rule = Rule(length, per_altered, long, per_altered_long)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, [term_id(w) for w in words(t)]) for k, n in enumerate(parts) for i, t in zip(b.column(0).to_pylist(), b.column(k + 1).to_pylist(), strict=True) if i is not None and t]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["item", "part", "tokens"])

    texts = materialise(items.select(F.col(item_col).cast("bigint"), *parts).mapInArrow(split, "item bigint, part string, tokens array<bigint>").where(F.size("tokens") >= length))
    blocks = -(-int(texts.agg(F.sum(F.size("tokens"))).first()[0] or 0) // block)
    stored = materialise(index(documents, id_col, text))
    schema = "doc_id bigint, item_id bigint, part string, equal int, altered int, doc_place int, item_place int"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    found = spark.createDataFrame([], schema)
    for k in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("item", "part"), F.lit(blocks)) == k).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(Tests.of([tuple(r) for r in sorted(rows)], rule.clean))

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    out = list(search(Lists.of(*[c[r].values.to_numpy(zero_copy_only=False) for c in b.columns]), shared.value, rule))
                    cols = list(zip(*out, strict=True)) if out else [()] * 7
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "part", "equal", "altered", "doc_place", "item_place"])

        part = stored.mapInArrow(match, schema)
        found = part if blocks == 1 else found.unionByName(materialise(part))
    return found

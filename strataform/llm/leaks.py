"""Problem 7, evaluation texts leaking into training text: pigeonhole edit matching over words.

A passage is a run of ``passage`` consecutive words of an item. Items are cut into pieces short enough that any passage, wherever it
starts, holds one whole piece more than the errors allowed; so at least one piece of a leaked passage stands unchanged in the document.
One automaton finds the pieces exactly, and the words around each hit are verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.operators.skew import spread

_FORMAT = regex.compile(r"\p{Cf}+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Bytes of item text matched in one pass over the corpus (they travel to every executor); more take more passes.
BYTES_PER_PASS = 16 << 20
#: Bit masks of passages kept at a time.
MASKS = 50_000


def words(text: str) -> list[str]:
    """Longest runs of letters and digits in lower case, format characters dropped first."""
    return _WORD.findall(_FORMAT.sub("", text).lower())


def piece_length(passage: int, errors: int) -> int:
    """Words of a piece: any window of ``passage`` words holds at least ``errors + 1`` whole pieces."""
    p = (passage + 1) // (errors + 2)
    if p < 1:
        raise ValueError(f"a passage of {passage} words can't bear {errors} errors")
    return p


def myers(masks: dict[str, int], m: int, text: list[str], limit: int) -> int:
    """Least edit distance (in words) of a pattern to any part of ``text``, or limit + 1 if above it.

    ``masks`` has a bit for every place of a word in the pattern of ``m`` words.
    """
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # A match may start anywhere in the text, so nothing is carried into the lowest bit.
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        best = min(best, score)
        if best == 0:
            break
    return min(best, limit + 1)


class Matcher:
    """The pieces of a set of items, ready to be found in documents."""

    def __init__(self, items: list[tuple[int, str]], passage: int, errors: int) -> None:
        import ahocorasick

        self.passage, self.errors = passage, errors
        self.items = {i: w for i, t in items if len(w := words(t)) >= passage}
        self.piece = p = piece_length(passage, errors)
        places: dict[str, list[tuple[int, int]]] = {}
        for i, w in self.items.items():
            for a in range(0, len(w) - p + 1, p):
                places.setdefault(f" {' '.join(w[a : a + p])} ", []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, at)
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)
        self._masks: dict[tuple[int, int], dict[str, int]] = {}

    def masks(self, item: int, start: int) -> dict[str, int]:
        found = self._masks.get((item, start))
        if found is None:
            if len(self._masks) >= MASKS:
                self._masks.clear()
            found = {}
            for k, w in enumerate(self.items[item][start : start + self.passage]):
                found[w] = found.get(w, 0) | 1 << k
            self._masks[item, start] = found
        return found

    def find(self, text: str) -> dict[int, int]:
        """The items with a passage in the text, with the least distance of any."""
        if not self.any:
            return {}
        w = words(text)
        if len(w) < self.passage - self.errors:
            return {}
        line = f" {' '.join(w)} "
        hits = [(end, at) for end, at in self.automaton.iter(line)]
        if not hits:
            return {}
        out: dict[int, int] = {}
        # The number of words before an offset, for the offsets of hits in order.
        place, before = 0, 0
        n, p, e = self.passage, self.piece, self.errors
        for end, at in hits:
            before += line.count(" ", place, end)
            place = end
            d = before - p  # place of the hit's first word
            for item, a in at:
                if out.get(item) == 0:
                    continue
                for start in range(max(0, a + p - n), min(a, len(self.items[item]) - n) + 1):
                    left = d - (a - start)
                    around = w[max(0, left - e) : left + n + e]
                    if len(around) < n - e:
                        continue
                    distance = myers(self.masks(item, start), n, around, e)
                    if distance <= e and distance < out.get(item, e + 1):
                        out[item] = distance
                        if distance == 0:
                            break
        return out


_MATCHERS: dict[str, Matcher] = {}


def _matcher(name: str, items, passage: int, errors: int) -> Matcher:
    """The automaton of a pass, built once per worker process; ``items`` is the broadcast."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(items.value, passage, errors)
    return _MATCHERS[name]


def find_leaks(docs: DataFrame, items: DataFrame, passage: int = 10, errors: int = 1, per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """doc_id, item_id, distance: documents that hold a passage of an item within ``errors`` word edits, with the least distance.

    Items shorter than a passage can't leak; null and empty texts on either side give no rows; repeated rows count once. Documents are
    read in one pass without a shuffle of their texts; items beyond ``per_pass`` bytes are taken in further passes, so what travels to an
    executor is bounded while every item is searched.
    """
    rows = items.select("item_id", "text").dropna().distinct()
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    passes = max(1, -(-size // per_pass))
    found = None
    for k in range(passes):
        part = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        matched = _pass(docs, [tuple(r) for r in part.collect()], passage, errors)
        found = matched if found is None else found.unionByName(matched)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _pass(docs: DataFrame, items: list[tuple[int, str]], passage: int, errors: int) -> DataFrame:
    shipped, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        matcher = _matcher(name, shipped, passage, errors)
        for pdf in batches:
            rows = [(d, i, n) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, n in matcher.find(t).items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance"]).astype("int64")

    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return spread(texts, "doc_id").mapInPandas(run, "doc_id bigint, item_id bigint, distance bigint")

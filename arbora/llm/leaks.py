"""Evaluation texts leaking into a corpus: pigeonhole edit matching.

A leak is a window of `words` words in a row of an item that a document's spoken text repeats with at most
`errors` letter edits. Each item's canonical letters are cut into pieces so short that every window holds at least
errors + 1 whole pieces; by the pigeonhole principle a leaked window then contains an exact piece hit. One
automaton finds the piece hits of all items in a single pass over a document; windows with too many edited
blocks are dropped by a second pigeonhole test; what is left is verified by Myers' bit-parallel edit distance. Windows of too few
letters to cut (numbers) are compared exactly, word by word.

Letters of every script count; accented Latin letters are left out on both sides, as wrong decodings garble them.

Scale: one scan of the corpus per shard of items, without any shuffle; a shard of checked size is the only thing sent
to the executors, and item sets of any size are split into shards.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.subtitles import MERGED, raw_letters, spoken, spoken_letters
from arbora.session import Scratch


def myers_within(pattern: str, text: str, k: int) -> bool:
    """Whether some substring of text is within k edits of pattern (Myers 1999, one machine word of any length)."""
    m = len(pattern)
    if not m:
        return True
    masks: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        masks[ch] |= 1 << i
    whole, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = whole, 0, m
    if score <= k:
        return True
    for ch in text:
        eq = masks.get(ch, 0)
        diag = ((((eq & plus) + plus) ^ plus) | eq) | minus
        up, down = minus | (whole & ~(diag | plus)), plus & diag
        score += bool(up & top) - bool(down & top)
        if score <= k:
            return True
        up, down = (up << 1) & whole, (down << 1) & whole  # a match may start anywhere, so no carry comes in
        plus = down | (whole & ~((eq | minus) | up))
        minus = up & (eq | minus)
    return False


def spoken_words(text: str) -> list[str]:
    """The spoken words in lower case, in any script, without punctuation, times and markup."""
    return [w for x in spoken(text).casefold().split() if (w := _NO_WORD.sub("", x))]


_NO_WORD = re.compile(r"[^\w]+")
_PAIRS = re.compile("|".join(re.escape(a.decode()) for a, _ in MERGED))
_MERGED = {a.decode(): to.decode() for a, to in MERGED}


def merged_with_places(letters: str) -> tuple[str, list[int], list[int]]:
    """The letters with their pairs merged, and where there every place of letters falls, as a start and as an end.

    A place inside a merged pair starts after it and ends before it, so a window never holds half of a pair."""
    out, places, ends, at, n = [], [], [], 0, 0
    for m in _PAIRS.finditer(letters):
        places.extend(range(n, n + m.start() - at))
        out.append(letters[at : m.start()])
        n += m.start() - at
        to, width = _MERGED[m.group(0)], m.end() - m.start()
        ends.extend(places[len(ends) :])
        places.extend([n] + [n + len(to)] * (width - 1))
        ends.extend([n] * width)
        out.append(to)
        at, n = m.end(), n + len(to)
    places.extend(range(n, n + len(letters) - at + 1))
    ends.extend(places[len(ends) :])
    return "".join(out) + letters[at:], places, ends


class Items:
    """Pieces and windows of all items, and the automaton over the pieces."""

    def __init__(self, items: list[tuple[int, str]], words: int, errors: int):
        self.words, self.errors = words, errors
        self.letters: dict[int, str] = {}
        self.windows: dict[int, tuple[list[int], list[int]]] = {}
        self.pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[str, list[int]] = defaultdict(list)
        for item, text in items:
            said = [x for x in spoken(text).split() if _NO_WORD.sub("", x)]
            parts = [raw_letters(x) for x in said]
            letters, begin, end = merged_with_places("".join(parts))
            starts = [0]
            for x in parts:
                starts.append(starts[-1] + len(x))
            spans = []
            for i in range(len(said) - words + 1):
                a, b = begin[starts[i]], end[starts[i + words]]
                # a window of too few letters to cut (numbers) is compared word by word
                if (b - a + 1) // (errors + 2) >= 4:
                    spans.append((a, b))
                else:
                    self.short[f" {' '.join(spoken_words(' '.join(said[i : i + words])))} "].append(item)
            if not spans:
                continue
            self.letters[item], self.windows[item] = letters, ([a for a, _ in spans], [b for _, b in spans])
            # windows of much fewer letters have pieces of their own, so that they make no short pieces for the others
            alike: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for a, b in spans:
                alike[(((b - a + 1) // (errors + 2)) * 2).bit_length()].append((a, b))
            for some in alike.values():
                size = min((b - a + 1) // (errors + 2) for a, b in some)
                starts, ends = [a for a, _ in some], [b for _, b in some]
                for p in range(0, len(letters) - size + 1, size):
                    if bisect_left(ends, p + size) < bisect_right(starts, p):
                        self.pieces[letters[p : p + size]].append((item, p))

    def state(self) -> tuple:
        """Plain data, for a broadcast."""
        return self.words, self.errors, self.letters, self.windows, dict(self.pieces), dict(self.short)

    @classmethod
    def from_state(cls, state: tuple) -> Items:
        self = cls([], state[0], state[1])
        _, _, self.letters, self.windows, self.pieces, self.short = state
        return self

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for piece, at in self.pieces.items():
            a.add_word(piece, (len(piece), at))
        a.make_automaton()
        return a

    def short_automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for window, items in self.short.items():
            a.add_word(window, items)
        a.make_automaton()
        return a

    def dense(self, window: str, text: str, start: int) -> bool:
        """Second pigeonhole test: of 2 (errors + 1) blocks of a window, at most `errors` can hold an edit."""
        k, n = self.errors, 2 * (self.errors + 1)
        missing, m = 0, len(window)
        for j in range(n):
            a, b = m * j // n, m * (j + 1) // n
            if text.find(window[a:b], max(0, start + a - k), start + b + k) < 0:
                missing += 1
                if missing > k:
                    return False
        return True

    def leaked(self, text: str, automaton) -> list[int]:
        """The items that the canonical letters of a document leak."""
        found: set[int] = set()
        checked: set[tuple[int, int, int]] = set()
        k = self.errors
        for last, (size, places) in automaton.iter(text):
            at = last - size + 1
            for item, p in places:
                if item in found:
                    continue
                letters, (starts, ends) = self.letters[item], self.windows[item]
                for w in range(bisect_left(ends, p + size), bisect_right(starts, p)):
                    a, b = starts[w], ends[w]
                    start = at - p + a
                    if start >= 0 and text.startswith(letters[a:b], start):
                        found.add(item)
                        break
                    key = (item, a, start)
                    if key in checked:
                        continue
                    checked.add(key)
                    if start + k >= 0 and self.dense(letters[a:b], text, start) and myers_within(letters[a:b], text[max(0, start - k) : start + b - a + k], k):
                        found.add(item)
                        break
        return sorted(found)


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 15, errors: int = 3, shard_mb: float = 8.0) -> DataFrame:
    """(doc, item): the documents that repeat at least `words` words in a row of an item.

    Items of more than shard_mb of text are split by the hash of their id, and the corpus is scanned once per shard,
    so that no worker holds more than one shard's automaton.

    Defined results: null ids and texts leak nothing; an item of fewer words than the window can't
    leak; a window too short to cut leaks where it is repeated word by word; a repeated id is one document or item; an empty side gives
    an empty table; other columns are ignored."""
    kept = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").dropDuplicates(["item"])
    volume = kept.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(volume / (shard_mb * 1e6)))
    if shards > 1:
        kept = Scratch(docs.sparkSession, "leaks").write(kept.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards))), "items")
    source = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    found = None
    for shard in range(shards):
        rows = kept.where(F.col("shard") == shard).select("item", "text").collect() if shards > 1 else kept.collect()
        part = _scan(source, Items(sorted((r[0], r[1]) for r in rows), words, errors))
        found = part if found is None else found.union(part)
    return found.distinct()


def _scan(source: DataFrame, items: Items) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(items.state())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Items.from_state(shared.value)
        automaton = index.automaton() if index.pieces else None
        short = index.short_automaton() if index.short else None
        for batch in batches:
            at, hits = [], []
            for i, t in enumerate(batch.column("text").to_pylist() if automaton or short else []):
                found = set(index.leaked(spoken_letters(t), automaton)) if automaton else set()
                if short:
                    found.update(x for _, items in short.iter(f" {' '.join(spoken_words(t))} ") for x in items)
                for item in sorted(found):
                    at.append(i)
                    hits.append(item)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int32())), pa.array(hits, pa.int64())], ["doc", "item"])

    kind = source.schema["doc"].dataType.simpleString()
    return source.mapInArrow(run, f"doc {kind}, item bigint")

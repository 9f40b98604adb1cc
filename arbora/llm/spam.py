"""Keyword-stuffed and link-list pages, by mean pointwise mutual information of neighbouring words.

First pass: every text becomes its canonical cues, and documents with equal cues become one text. Second pass: the
number of different texts with each word and each pair of neighbouring words, over the whole corpus, pre-aggregated
per partition. A pair is known if at least `support` of all texts have it; PMI, rarity and function words leave the
text at hand out, and with it all its copies. Third pass, over the different texts: a cue is spam if it is word salad (low mean PMI) that repeats itself, reads as a list or has no function words, or a
collocation that few documents have but this one repeats over and over, within a cue or across cues, without
function words, or little but links.
A document is spam if more than `share` of its cues are.

Scale: one scan of the documents, one shuffle of their canonical cues (copies meet by a hash, one per partition at
most) and one of pre-aggregated counts. The known pairs and words are broadcast: there are at most (mean different pairs and words
of a text / support) of them, however large the corpus; the rest never leaves the executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.subtitles import CUE, LINK, LISTING, canonical, cut, unmarked
from arbora.session import Scratch

_LINK = re.compile(r"(?:https?://|www\.)[^\s\0]+|<a\s[^>\0]*>|\]\([^)\0]*\)|[^\s\0]+ ?\[dot\] ?[^\s\0]+|[\w-]+\.(?:com|org|net|info|biz|example|test|invalid)\b[^\s\0]*|#\w+", re.I)
_HOST = re.compile(r"\.(?:com|org|net|info|biz|example|test|invalid)\b", re.I)
_SIGNS = ("://", "www.", "[dot]", "](", "<a ", "#")
FLOOR, CEILING = -3.0, 6.0
#: Mean PMI below which a cue is salad.
LOW = -1.35
#: Occurrences, equal cues included, from which a pair is a keyword's; different pairs without which low PMI is chance.
LOUD, EVIDENCE = 6, 8


#: A cue without a word, a link or a separator: sounds, music, punctuation.
SILENT = "\3"


def canonical_cues(text: str) -> str:
    """The cues with a word, a link or a separator, one a line, in canonical words; then a line SILENT for every other cue."""
    pieces = cut(text)
    all_cues = sum(1 for x in pieces.split(CUE) if x and not x.isspace())
    text = unmarked(pieces)
    if any(sign in text for sign in _SIGNS) or _HOST.search(text):
        text = _LINK.sub(f" {LINK} ", text)
    lines = [x for line in canonical(text).split("\n") if (x := " ".join(line.split()))]
    return "\n".join(lines + [SILENT] * (all_cues - len(lines)))


def units_of(cues: str) -> list[tuple[list[str], int, int]]:
    """(words, links, list separators) of every canonical cue with a word or a link."""
    out = []
    for line in cues.split("\n"):
        if line == SILENT:
            continue
        links, listed = line.count(LINK), line.count(LISTING)
        if links or listed:
            line = line.replace(LINK, " ").replace(LISTING, " ")
        words = line.split()
        if words or links:
            out.append((words, links, listed))
    return out


def units(text: str) -> list[tuple[list[str], int, int]]:
    """(words, links, list separators) of every cue with a word or a link."""
    return units_of(canonical_cues(text))


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        cues = [canonical_cues(t) for t in b.column("text").to_pylist()]
        keys = [xxhash.xxh3_128_digest(c.encode()) for c in cues]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), pa.array(cues, pa.string())], ["id", "key", "cues"])


def _count(flush: int):
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for cues in b.column("cues").to_pylist():
                seen: set[str] = set()
                for words, _, _ in units_of(cues):
                    seen.update(words)
                    seen.update(pairs_of(words))
                counts.update(seen)
                counts[""] += 1
                if len(counts) > flush:
                    yield batch(counts)
                    counts = Counter()
        yield batch(counts)

    return run


def spam_cues(cues: str, pmi: dict[str, tuple[float, bool]], common: set[str], known: set[str]) -> tuple[int, int]:
    """(spam cues, all cues, silent ones included). cues: canonical. pmi: of known pairs, with whether few texts have the pair; other pairs are rare.

    known: words that enough texts have for a missing pair of them to say something."""
    found = units_of(cues)
    repeats: Counter = Counter()
    total: Counter = Counter()
    listed, different = [], set()
    for words, _, _ in found:
        pairs = pairs_of(words)
        listed.append(pairs)
        total.update(pairs)
        key = tuple(words)
        if key not in different:  # for PMI, a refrain sung again is no further evidence
            different.add(key)
            repeats.update(set(pairs))

    def rare(p: str) -> bool:
        return (value := pmi.get(p)) is None or value[1]

    often_enough, loud_enough = max(3, 0.12 * len(different)), max(LOUD, 0.12 * len(found))
    again = {p for p, n in repeats.items() if n >= often_enough and rare(p)}
    loud = {p for p, n in total.items() if n >= loud_enough and rare(p)}
    spam, weak, evidence = 0, 0, set()
    for (words, links, separators), pairs in zip(found, listed):
        if links and len(words) <= 4 * links:
            spam += 1
            continue
        often = bool(again) and not again.isdisjoint(pairs)
        listing = separators >= max(2, 0.25 * len(words))
        stuffed = len(words) >= 4 and 2 * len(set(words)) <= len(words)
        few = sum(w in common for w in words) < 0.2 * len(words)
        if often and (listing or stuffed or few):
            spam += 1
            continue
        if few and pairs and (not loud.isdisjoint(pairs) or stuffed and any(n >= 3 and rare(p) for p, n in Counter(pairs).items())):
            if len(set(words)) > 1:  # one word sung over and over is no collocation
                spam += 1
                continue
        if (often or listing) and pairs:
            if sum(value[0] if (value := pmi.get(p)) else FLOOR for p in pairs) < LOW * len(pairs):
                spam += 1
                continue
        if few and pairs:
            judged = [p for p, a, b in zip(pairs, words, words[1:]) if a in known and b in known]
            if 2 * len(judged) >= len(pairs) and sum(value[0] if (value := pmi.get(p)) else FLOOR for p in judged) < LOW * len(judged):
                weak += 1
                evidence.update(judged)
    return spam + (weak if len(evidence) >= EVIDENCE else 0), len(found) + cues.count(SILENT)


def find_spam(docs: DataFrame, id_col: str, text_col: str, share: float = 0.5, support: float = 2e-4, function_share: float = 0.03, rare_share: float = 0.01, flush: int = 400_000) -> DataFrame:
    """(id, spam_share) of the documents where more than `share` of the cues are spam.

    Defined results: a null id, a null or an empty text is no spam; a repeated id is one document; copies of a text count once and are
    judged alike; cues of sounds alone count as cues; a document without words and links is no spam; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "spam")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    kind = texts.schema["id"].dataType.simpleString()
    rows = scratch.write(texts.mapInArrow(_canonical, f"id {kind}, key binary, cues string"), "rows")
    different = scratch.write(rows.select("key", "cues").dropDuplicates(["key"]), "different")
    counts = scratch.write(different.select("cues").mapInArrow(_count(flush), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")), "counts")
    n_texts = (counts.where("term = ''").select("n").first() or [0])[0]
    least = max(3, math.ceil(support * n_texts))
    kept = counts.where((F.col("term") != "") & (F.col("n") >= least)).collect()
    others = n_texts - 1
    single = {r[0]: r[1] - 1 for r in kept if " " not in r[0]}
    pmi = {}
    for term, n in ((r[0], r[1] - 1) for r in kept if " " in r[0]):
        a, b = term.split(" ")
        value = math.log2(n * others / (single[a] * single[b]))
        pmi[term] = (min(max(value, FLOOR), CEILING), n < rare_share * others)
    common = {w for w, n in single.items() if n >= function_share * others}
    shared = docs.sparkSession.sparkContext.broadcast((pmi, common, set(single)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, usual, words = shared.value
        for b in batches:
            at, values = [], []
            for i, cues in enumerate(b.column("cues").to_pylist()):
                spam, cue_count = spam_cues(cues, weights, usual, words)
                if cue_count and spam > share * cue_count:
                    at.append(i)
                    values.append(spam / cue_count)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int32())), pa.array(values, pa.float64())], ["key", "spam_share"])

    judged = scratch.write(different.mapInArrow(judge, "key binary, spam_share double"), "judged")
    return rows.select("id", "key").join(judged, "key").select("id", "spam_share").dropDuplicates(["id"])

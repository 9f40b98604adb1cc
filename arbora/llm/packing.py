"""Filling fixed-capacity containers with items, by optimal length buckets.

The global histogram of item lengths (at most `capacity` rows) goes through a dynamic programme that chooses the
bucket boundaries with the least padding. Inside a bucket all items count as its boundary, so batches within the
token budget follow from counts alone: containers are described by a few patterns ("2 of bucket 30, 1 of bucket
7", so many times), and every item finds its container from its exact rank within its bucket.

Batches of one bucket only, as the method is named, leave more than half-full items alone in a container. With
`mix` (the default) a pattern may draw on several buckets: the largest item left is topped up by the set of
smaller buckets that fills the container best. Both ways use the same buckets and the same assignment.

Scale: one pass over the texts for sizes; ranks by exact offset chunking, so a bucket with a third of all items
is spread evenly; the patterns (at most one per bucket) are all the driver makes and all that is broadcast.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.skew import number_within_keys
from arbora.session import Scratch

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern of the vocabulary's public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_GAP = re.compile(r"\s{2000}")


def load_tokenizer(path: str):
    """A tiktoken encoding from a file of ranks (base64 token, rank)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encoding, text: str) -> int:
    """Tokens of a text of any shape: the library's own splitter overflows its stack on very long runs of white space."""
    if not _LONG_GAP.search(text):
        return len(encoding.encode_ordinary(text))
    import regex

    return sum(len(encoding._encode_single_piece(piece.encode())) for piece in regex.findall(PATTERN, text))


def token_sizes(docs: DataFrame, id_col: str, text_col: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, tokens) of every document with at least one token; a repeated id is one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_tokenizer(tokenizer)
        for b in batches:
            sizes = [count_tokens(encoding, t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64())], ["id", "tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows.mapInArrow(run, "id bigint, tokens bigint").where("tokens > 0").dropDuplicates(["id"])


def _next_layer(prev: np.ndarray, lengths: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first j lengths with one bucket more, and where that bucket starts, for every j.

    The padding of a bucket satisfies the quadrangle inequality, so the best start grows with j: the middle j of a
    range is solved first and bounds the starts of both halves. All ranges of one depth are solved together."""
    m = len(lengths)
    best, came = np.zeros(m + 1), np.zeros(m + 1, dtype=np.int64)
    a, b, low, high = (np.array([x]) for x in (1, m, 0, m - 1))
    while len(a):
        mid = (a + b) // 2
        count = np.minimum(high, mid - 1) - low + 1
        at = np.cumsum(count) - count
        end = np.repeat(mid, count)
        start = np.arange(count.sum()) - np.repeat(at, count) + np.repeat(low, count)
        value = prev[start] + lengths[end - 1] * (n[end] - n[start]) - (w[end] - w[start])
        least = np.minimum.reduceat(value, at)
        first = np.flatnonzero(value == np.repeat(least, count))
        back = start[first[np.searchsorted(first, at)]]
        best[mid], came[mid] = least, back
        a, b, low, high = (np.concatenate(x) for x in ((a, mid + 1), (mid - 1, b), (low, back), (back, high)))
        keep = a <= b
        a, b, low, high = a[keep], b[keep], low[keep], high[keep]
    return best, came


def choose_boundaries(counts: dict[int, int], buckets: int) -> list[int]:
    """Ascending bucket boundaries, the last one the longest length, with the least total padding.

    Exact for any lengths: a best boundary is always a length that occurs. buckets * lengths * log(lengths) steps."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    if buckets >= len(lengths):
        return lengths.tolist()
    per = np.array([counts[x] for x in lengths.tolist()], dtype=np.int64)
    n, w = (np.concatenate([[0], np.cumsum(x)]).astype(np.float64) for x in (per, per * lengths))
    best = np.concatenate([[0.0], lengths * n[1:] - w[1:]])
    layers = []
    for _ in range(buckets - 1):
        best, came = _next_layer(best, lengths, n, w)
        layers.append(came)
    out, at = [int(lengths[-1])], len(lengths)
    for came in reversed(layers):
        at = int(came[at])
        if at <= 0:
            break
        out.append(int(lengths[at - 1]))
    return out[::-1]


def _best_fill(sizes: list[int], left: list[int], room: int, start: int) -> dict[int, int]:
    """Counts per bucket index <= start whose sizes fill `room` best, among the items left."""
    filled = {0}
    via: dict[int, tuple[int, int]] = {}
    for k in range(start, -1, -1):
        s = sizes[k]
        if left[k] <= 0 or s > room:
            continue
        for base in sorted(filled):
            total, used = base + s, 1
            while total <= room and used <= left[k]:
                if total not in filled and total not in via:
                    via[total] = (k, base)
                else:
                    break
                total, used = total + s, used + 1
        filled |= set(via)
        if room in filled:
            break
    at, out = max(filled), {}
    while at:
        k, base = via[at]
        out[k] = out.get(k, 0) + (at - base) // sizes[k]
        at = base
    return out


def make_patterns(sizes: list[int], counts: list[int], capacity: int, mix: bool = True) -> list[tuple[dict[int, int], int]]:
    """[(items per bucket index, number of such containers)]; every item is in exactly one container.

    A pattern is used until one of its buckets runs out, so there are at most two patterns per bucket."""
    left, out = list(counts), []
    for k in range(len(sizes) - 1, -1, -1):
        while left[k] > 0:
            pattern = {k: 1}
            if mix:
                left[k] -= 1
                for b, c in _best_fill(sizes, left, capacity - sizes[k], k).items():
                    pattern[b] = pattern.get(b, 0) + c
                left[k] += 1
            else:
                pattern[k] = min(capacity // sizes[k], left[k])
            times = min(left[b] // c for b, c in pattern.items())
            for b, c in pattern.items():
                left[b] -= c * times
            out.append((pattern, times))
    return out


def pack(sizes: DataFrame, capacity: int = 2048, buckets: int = 256, mix: bool = True) -> DataFrame:
    """(container, id, part, first_token, tokens): where every part of every item goes.

    Defined results: an item longer than the capacity is cut into full parts and one rest, no other item is cut;
    items of no length are left out; an empty table gives an empty table. sizes is (id, tokens), one row per id."""
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    parts = sizes.where("tokens > 0").select("id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / capacity))).alias("part"))
    parts = scratch.write(parts.select("id", "part", (F.col("part") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).cast("bigint").alias("tokens")), "parts")
    counts = {r[0]: r[1] for r in parts.groupBy("tokens").count().collect()}  # at most `capacity` rows
    if not counts:
        return parts.select(F.lit(0).cast("bigint").alias("container"), "id", "part", "first_token", "tokens").where("false")
    bounds = choose_boundaries(counts, buckets)
    per_bucket = [0] * len(bounds)
    for length, c in counts.items():
        per_bucket[int(np.searchsorted(bounds, length))] += c
    runs, used, containers = [], [0] * len(bounds), 0
    for pattern, times in make_patterns(bounds, per_bucket, capacity, mix):
        for b, c in pattern.items():
            runs.append((b, used[b], used[b] + c * times, c, containers))
            used[b] += c * times
        containers += times
    places = F.broadcast(spark.createDataFrame(runs, "bucket int, start bigint, stop bigint, each bigint, base bigint"))
    buckets_of = [(length, int(np.searchsorted(bounds, length))) for length in counts]
    of = F.broadcast(spark.createDataFrame(buckets_of, "tokens bigint, bucket int"))  # at most `capacity` rows
    ranked = number_within_keys(parts.join(of, "tokens").select(*parts.columns, "bucket"), ["bucket"], ["id", "part"], scratch)
    on = (ranked["bucket"] == places["bucket"]) & (ranked["ordinal"] >= places["start"]) & (ranked["ordinal"] < places["stop"])
    return ranked.join(places, on).select((F.col("base") + F.floor((F.col("ordinal") - F.col("start")) / F.col("each"))).alias("container"), "id", "part", "first_token", "tokens")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, items, tokens, the fewest containers possible by volume, and the unused share in percent."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")).select(
        "containers", "items", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("bound"), F.round(100 * (1 - F.col("tokens") / (F.col("containers") * capacity)), 3).alias("unused_percent"))

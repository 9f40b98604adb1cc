"""Generated, minified and vendored source files, by layout statistics with limits per language.

Statistics are taken of a file's code: comments and prose in string literals are set aside first, so files that only
talk about such things count as hand-written. A file was made by a program if a statistic is beyond its language's
limit - mean line length (squeezed code in one line), mean line length with white-space share (squeezed code that was
wrapped), numeric-literal density (tables), longest encoded run with alphanumeric share (blobs) - or if most of its
characters are on lines of a machine's layout: line directives, numeric literals, rows of separated data, numbered
machine identifiers, encoded runs, overlong code.

A file is a copy if its ownership notice names another package of the table than its own; if its path has the folder
of another package that has a file of that name; or if its code equals, or is similar to (five-word shingles, 0.8 or
more, exact), a file of which one of the two is known.

Scale: one Python pass over the texts gives a few numbers, a hash of the code and MinHash bands per file. Equal code
counts once. Bands are matched against one variant per (band, owner) first, which settles the copies of a popular
file at one comparison each; only files that no such variant explains are compared with all variants of their bands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.session import Scratch


@dataclass(frozen=True)
class Layout:
    """Limits of one language."""

    long_line: int = 160
    #: Mean line length beyond which nobody broke the lines.
    mean_line: float = 120.0
    #: Mean line length and white-space share of squeezed code that a tool wrapped.
    wrapped_line: float = 55.0
    space_share: float = 0.11
    #: Numeric literals in 100 characters.
    number_density: float = 9.0
    numeric_share: float = 0.5
    #: Encoded runs, and the alphanumeric share of a file made of them.
    encoded_run: int = 50
    alnum_share: float = 0.8
    share: float = 0.5


#: Interfaces have longer lines than code, scripts shorter ones; an unknown language gets the widest limits.
LAYOUTS = {"ml": Layout(), "mli": Layout(mean_line=150.0, long_line=200), "js": Layout(long_line=140, mean_line=110.0, space_share=0.09), "": Layout(mean_line=150.0, space_share=0.09)}
#: Files of less code than this are judged by their lines alone.
LEAST_CODE = 200

_OPENING = re.compile(r"\(\*|/\*|(?<!:)//")
_CLOSING = {"(*": "*)", "/*": "*/", "//": "\n"}
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"')
_NUMBER = re.compile(r"0x[0-9a-fA-F]+|\\x[0-9A-Fa-f]{2}|\\\d{3}|(?<![\w.])-?\d[\d_.]*(?!\w)")
_DIRECTIVE = re.compile(r"#(?:line)? ?\d+ \"")
_ROW = re.compile(r"[^\s,;]*(?:[,;\t][^\s,;]*){2,}")
#: Names that only programs give; constants such as __LOC__ and numbers such as 1_000 are none.
_MACHINE_NAME = re.compile(r"\b__[a-z]\w*__\b|'tv_\w+|\b_v?\d+\b")
#: A name with a long number; a machine's if the file has it with many numbers.
_NUMBERED = re.compile(r"(?<![\w'])([A-Za-z_]\w*?)_(\d{3,})\b")
_LONG_NUMBER = re.compile(r"_\d{3}")
FAMILY = 5
_DIGIT = re.compile(r"\d")
_RUN = re.compile(r"[A-Za-z0-9+/=_\\-]{40,}")
_WORD = re.compile(r"\w+|[^\w\s]")
_PROJECT = r"([A-Za-z][\w-]*(?:\.[A-Za-z][\w-]*)*)"
_KIND = r"(?:distribution|project|library|package|module|team|developers|authors|contributors|maintainers|licen[cs]e)"
#: What in a comment says whose a file is; a name counts if it is a package's.
_NOTICE = re.compile(
    rf"\b(?:part of|belongs? to|(?:maintained|developed|owned) by|(?:taken|copied|imported|vendored) from|copyright(?: \([cC]\))?(?: [\d, -]+)?|licen[cs]e:? as in|terms:? see)\s+(?:the\s+)?{_PROJECT}"
    rf"|\b(?:project|package|library|upstream|origin|home(?: of this file)?)\s*:\s*(?:\w+://[^/\s]+/)?{_PROJECT}"
    rf"|{_PROJECT}\s+{_KIND}\b", re.I)
#: Folders of a package's own layout, whatever packages are called.
OWN_FOLDERS = ["src", "lib", "bin", "test", "tests", "core", "base", "compat", "doc", "docs", "examples", "utils", "tools", "include", "_build", "default"]


def clean(text: str) -> str:
    return text.replace("\r", "").lstrip("﻿")


def language(source: str | None) -> str:
    ending = (source or "").rpartition(".")[2].lower()
    return ending if ending in LAYOUTS else ""


def split_comments(text: str) -> tuple[str, list[str]]:
    """The code with a space for every comment, and the comments; an opening that is never closed is code."""
    code, comments, at, start = [], [], 0, 0
    open_ended: set[str] = set()
    while m := _OPENING.search(text, at):
        mark = m.group(0)
        end = -1 if mark in open_ended else text.find(_CLOSING[mark], m.end())
        if end < 0 and mark == "//":
            end = len(text)
        if end < 0:
            open_ended.add(mark)
            at = m.end()
            continue
        stop = end if mark == "//" else end + 2
        code.append(text[start : m.start()])
        comments.append(text[m.start() : stop])
        at = start = stop
    code.append(text[start:])
    return " ".join(code), comments


def named_projects(comments: list[str]) -> list[str]:
    """Names that ownership notices in the comments give, each once."""
    return list(dict.fromkeys(g for c in comments for m in _NOTICE.finditer(c) for g in m.groups() if g))


def _set_aside(m: re.Match) -> str:
    s = m.group(0)
    return '""' if len(s) > 40 and s.count(" ") >= len(s) / 12 else s


def line_kind(line: str, layout: Layout, families: set[str] | frozenset = frozenset()) -> str:
    """One of '', directive, numbers, data, machine, encoded, long; line has no outer white space.

    families: the stems of numbered names that the file has with many numbers."""
    n = len(line)
    if line[:1] == "#" and _DIRECTIVE.match(line):
        return "directive"
    if n >= 12 and _DIGIT.search(line) and sum(len(x) + 1 for x in _NUMBER.findall(line)) >= layout.numeric_share * n:
        return "numbers"
    if n >= 8 and " " not in line and _ROW.fullmatch(line):
        return "data"
    if "_" in line and (_MACHINE_NAME.search(line) or families and any(m.group(1) in families for m in _NUMBERED.finditer(line))):
        return "machine"
    if n >= layout.encoded_run and max(map(len, line.split())) >= 30 and _encoded(layout.encoded_run).search(line):
        return "encoded"
    return "long" if n > layout.long_line else ""


@lru_cache
def _encoded(run: int) -> re.Pattern:
    return re.compile(rf"[A-Za-z0-9+/=]{{{run},}}|(?:\\[A-Za-z0-9]+){{15,}}")


def numbered_families(code: str) -> set[str]:
    """Stems that occur with FAMILY different long numbers or more."""
    if not _LONG_NUMBER.search(code):
        return set()
    numbers: dict[str, set[str]] = {}
    for m in _NUMBERED.finditer(code):
        numbers.setdefault(m.group(1), set()).add(m.group(2))
    return {stem for stem, seen in numbers.items() if len(seen) >= FAMILY}


_ALNUM = bytes(x for x in range(256) if x >= 128 or chr(x).isalnum())
_BLANK = b" \t\n\v\f"


def layout_of(code: str, source: str | None) -> dict[str, float]:
    """Statistics of the layout of code without comments, and machine: the share of its characters on lines of a machine's layout."""
    rules = LAYOUTS[language(source)]
    code = _STRING.sub(_set_aside, code)
    lines = [x for line in code.split("\n") if (x := line.strip())]
    raw = code.encode("utf-8", "replace")
    size, total = max(len(raw), 1), sum(map(len, lines))
    families = numbered_families(code)
    machine = sum(len(x) for x in lines if line_kind(x, rules, families))
    return {
        "max_line": float(max(map(len, lines), default=0)),
        "mean_line": total / max(len(lines), 1),
        "space_share": 1 - len(raw.translate(None, _BLANK)) / size,
        "alnum_share": 1 - len(raw.translate(None, _ALNUM)) / size,
        "number_density": 100 * len(_NUMBER.findall(code)) / max(total, 1),
        "longest_run": float(max(map(len, _RUN.findall(code)), default=0)),
        "machine": machine / total if total else 0.0,
        "code": float(total),
    }


def made_by_program(stats: dict[str, float], rules: Layout) -> bool:
    """Whether a statistic of the code is beyond its limit, or most of it is on lines of a machine's layout."""
    squeezed = stats["max_line"] > rules.long_line and stats["mean_line"] > rules.mean_line
    wrapped = stats["mean_line"] > rules.wrapped_line and stats["space_share"] < rules.space_share
    table = stats["number_density"] > rules.number_density
    blob = stats["longest_run"] >= rules.encoded_run and stats["alnum_share"] > rules.alnum_share
    return stats["machine"] > rules.share or stats["code"] >= LEAST_CODE and (squeezed or wrapped or table or blob)


def shingles(code: str) -> np.ndarray:
    """Hashes of the different five-word shingles of code without comments."""
    words = _WORD.findall(code)
    if len(words) < 5:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(_HASH.__getitem__, words), dtype=np.uint64, count=len(words))
    out = np.zeros(len(values) - 4, dtype=np.uint64)
    for j in range(5):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[j : len(values) - 4 + j]
        out ^= out >> np.uint64(29)
    return np.unique(out)


class _Hashes(dict):
    """Hash of every word met, forgotten before it grows large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASH = _Hashes()


_BANDS, _ROWS = 20, 5
_MULT = (np.random.default_rng(5).integers(1, 2**62, size=_BANDS * _ROWS, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)


def bands(values: np.ndarray) -> list[int]:
    """Twenty MinHash bands of five rows."""
    if not len(values):
        return []
    h = values[:, None] * _MULT[None, :]
    h ^= h >> np.uint64(31)
    low = h.min(axis=0).reshape(_BANDS, _ROWS)
    key = np.arange(1, _BANDS + 1, dtype=np.uint64)
    for j in range(_ROWS):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + low[:, j]
        key ^= key >> np.uint64(27)
    return key.view(np.int64).tolist()


_STATS = ["max_line", "mean_line", "space_share", "alnum_share", "number_density", "longest_run", "machine"]


def _profile_one(text: str, source: str | None) -> tuple:
    """(statistics, made by a program, named projects, hash of the shingles, bands) of one file."""
    code, comments = split_comments(clean(text))
    stats = layout_of(code, source)
    by_machine = made_by_program(stats, LAYOUTS[language(source)])
    if by_machine:  # a case whoever owns it
        return stats, True, [], None, []
    values = shingles(code)
    key = int(np.bitwise_xor.reduce(values * np.uint64(0x9E3779B97F4A7C15) ^ (values >> np.uint64(31)))) if len(values) else None
    return stats, False, named_projects(comments), None if key is None else key - (1 << 63), bands(values)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sources = b.column("source").to_pylist()
        rows = [_profile_one(t, s) for t, s in zip(b.column("text").to_pylist(), sources)]
        out = [b.column("id"), b.column("package"), pa.array(sources, pa.string())]
        out += [pa.array([r[0][k] for r in rows], pa.float64()) for k in _STATS]
        out += [pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, ["id", "package", "source", *_STATS, "by_machine", "names", "code", "bands"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist())):
                sx, sy = (shingles(split_comments(clean(t))[0]) for t in (x, y))
                both = len(np.intersect1d(sx, sy, assume_unique=True))
                if both >= threshold * (len(sx) + len(sy) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("code").take(at), b.column("other").take(at)], ["code", "other"])

    return run


def profile_files(units: DataFrame, id_col: str, key_col: str, source_col: str, text_col: str) -> DataFrame:
    """Layout statistics, named projects, hash of the code and bands per file; package is the key up to its first '.' (or ':').

    Files delivered twice are profiled twice and then dropped, as that costs less than shuffling all texts."""
    rows = units.select(
        F.col(id_col).cast("bigint").alias("id"), F.regexp_extract(F.coalesce(F.col(key_col), F.lit("")), r"^[^.:]*", 0).alias("package"),
        F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    stats = ", ".join(f"{k} double" for k in _STATS)
    return rows.mapInArrow(_profile, f"id bigint, package string, source string, {stats}, by_machine boolean, names array<string>, code bigint, bands array<bigint>").dropDuplicates(["id"])


def owners(files: DataFrame) -> DataFrame:
    """(id, owner) of the files whose notice or path says whose they are; several names count as the file's own package, or the smallest.

    A notice goes before a path. Files that a path elsewhere names as a package's are that package's."""
    own = files.where("array_contains(names, package)").select("id", F.col("package").alias("owner"))
    foreign = files.where("not array_contains(names, package) and size(names) > 0").select("id", F.explode("names").alias("owner"))
    packages = files.where("package <> ''").select(F.col("package").alias("owner")).distinct()
    noted = own.union(foreign.join(packages, "owner").groupBy("id").agg(F.min("owner").alias("owner")))
    parts = F.split("source", "/")
    placed = files.where(F.size(parts) > 2).select("id", "package", F.element_at(parts, -1).alias("base"), F.explode(F.array_except(F.slice(parts, 2, F.size(parts) - 2), F.array(*map(F.lit, OWN_FOLDERS)))).alias("owner"))
    has = files.where("package <> '' and source is not null").select(F.col("package").alias("owner"), F.element_at(parts, -1).alias("base"), "id")
    named = placed.where("owner <> package").join(has.select("owner", "base").distinct(), ["owner", "base"])
    by_path = named.groupBy("id").agg(F.min("owner").alias("owner"))
    originals = has.join(named.select("owner", "base").distinct(), ["owner", "base"]).select("id", "owner")
    ranked = noted.withColumn("rank", F.lit(0)).union(by_path.withColumn("rank", F.lit(1))).union(originals.withColumn("rank", F.lit(2)))
    return ranked.groupBy("id").agg(F.min_by("owner", F.struct("rank", "owner")).alias("owner"))


def _similar(pairs: DataFrame, units: DataFrame, scratch: Scratch, threshold: float, name: str) -> DataFrame:
    """(code, other) of the given pairs (code, other, id, head) whose texts, of id and head, are similar."""
    needed = pairs.select(F.explode(F.array("id", "head")).alias("id")).distinct()
    texts = scratch.write(units.join(needed, "id", "left_semi").dropDuplicates(["id"]), f"texts-{name}")
    sides = pairs.join(texts.withColumnRenamed("text", "text_a"), "id").join(texts.select(F.col("id").alias("head"), F.col("text").alias("text_b")), "head")
    return scratch.write(sides.select("code", "other", "text_a", "text_b").mapInArrow(_verify(threshold), "code bigint, other bigint"), f"similar-{name}")


def not_handwritten(units: DataFrame, id_col: str = "unit_id", key_col: str = "unit_key", source_col: str = "source", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, reason, owner) with reason 'machine' or 'copy', and the layout statistics, for files not written by hand for their package.

    Defined results: a null id, a null or an empty text is no case; a null source means the default limits and no path; a null key has
    an empty package, which owns nothing; a notice that names no package of the table says nothing; equal or similar code whose owner no
    notice and no path tells is no case; a repeated id is one file; other columns are ignored."""
    scratch = Scratch(units.sparkSession, "handwritten")
    files = scratch.write(profile_files(units, id_col, key_col, source_col, text_col), "files")
    hand = files.where("not by_machine")
    owned = scratch.write(owners(hand), "owners")
    told = scratch.write(hand.join(owned, "id").where("code is not null").groupBy("code", "owner").agg(F.min("id").alias("head"), F.first("bands").alias("bands")), "told")
    bare = scratch.write(hand.join(owned, "id", "left_anti").where("code is not null").select("id", "package", "code", "bands"), "bare")
    equal = bare.join(told.select("code", "owner"), "code").where("package <> owner").groupBy("id").agg(F.min("owner").alias("copied_from"))
    equal = scratch.write(equal, "equal")

    # one row per code and owner from here on
    texts = units.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    variants = told.select(F.col("code").alias("other"), "owner", "head", F.explode("bands").alias("band"))
    heads = variants.groupBy("band", "owner").agg(F.min(F.struct("other", "head")).alias("h")).select("band", "owner", "h.other", "h.head")
    found, left, tried = equal, bare, None
    for name, side in (("heads", heads), ("variants", variants)):
        left = left.join(found, "id", "left_anti")
        codes = left.groupBy("code").agg(F.min("id").alias("id"), F.first("bands").alias("bands")).select("code", "id", F.explode("bands").alias("band"))
        pairs = codes.join(side.select("band", "other", "head"), "band").where("code <> other").groupBy("code", "other", "id").agg(F.min("head").alias("head"))
        if tried is not None:
            pairs = pairs.join(tried, ["code", "other"], "left_anti")
        pairs = scratch.write(pairs, f"pairs-{name}")
        tried = pairs.select("code", "other")
        if pairs.isEmpty():
            continue
        similar = _similar(pairs, texts, scratch, threshold, name).join(told.select(F.col("code").alias("other"), "owner"), "other").select("code", "owner").distinct()
        copies = left.join(similar, "code").where("package <> owner").groupBy("id").agg(F.min("owner").alias("copied_from"))
        found = found.union(scratch.write(copies, f"copies-{name}"))
    reason = F.when(F.col("by_machine"), "machine").when(F.col("owner") != F.col("package"), "copy").when(F.col("copied_from").isNotNull(), "copy")
    return files.join(owned, "id", "left").join(found, "id", "left").withColumn("reason", reason).where("reason is not null").select("id", "reason", F.coalesce("owner", "copied_from").alias("owner"), *_STATS)

"""Spam, leaks, hand-written source and packing on small cases."""

import itertools
import random

import pytest

from arbora.llm.handwritten import LAYOUTS, Layout, layout_of, line_kind, made_by_program, named_projects, not_handwritten, numbered_families, shingles, split_comments
from arbora.llm.leaks import Items, find_leaks, merged_with_places, myers_within
from arbora.llm.packing import choose_boundaries, count_tokens, fill_report, load_tokenizer, make_patterns, pack, token_sizes
from arbora.llm.spam import find_spam, units
from arbora.llm.subtitles import cues, merged, spoken_letters

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


# ---- subtitles --------------------------------------------------------------------------------------------

def test_spoken_letters_ignore_what_does_not_count():
    clean = spoken_letters("The river was cold, Anna said")
    for text in ("1\n00:00:01,000 --> 00:00:02,000\nThe river was\n\n2\n00:00:03,000 --> 00:00:04,000\n[door] cold, Anna said", "ANNA: <i>THE RIVER</i> was\r\n- cold (sighs) Anna said", "Thc r1ver vvas co1d Anna sa1d", "{10}{20}The river was cold Anna said\n"):
        assert spoken_letters(text) == clean
    assert spoken_letters("Die Brücke") == spoken_letters("Die BrÃ¼cke") == spoken_letters("Die Br�cke") == spoken_letters("Die Br?cke")
    assert spoken_letters("") == "" and spoken_letters("12\n00:00:01.000 --> 00:00:02.000\n") == ""


def test_cues():
    assert [c.strip() for c in cues("1\n00:00:01,000 --> 00:00:02,000\na\nb\n\n2\n00:00:03,000 --> 00:00:04,000\nc\n")] == ["a\nb", "c"]
    assert cues("a\n\nb") == ["a", "b"] and cues("") == []


# ---- leaks ------------------------------------------------------------------------------------------------

def distance_within(p, t, k):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        prev, row[0] = row[0], i + 1
        for j, b in enumerate(t):
            prev, row[j + 1] = row[j + 1], min(prev + (a != b), row[j] + 1, row[j + 1] + 1)
    return min(row) <= k


def test_myers_is_edit_distance():
    rng = random.Random(1)
    for _ in range(600):
        p = "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 10)))
        k = rng.randint(0, 3)
        assert myers_within(p, t, k) == distance_within(p, t, k)
    assert myers_within("a" * 100 + "b", "x" + "a" * 99 + "b" + "y", 1) and not myers_within("abc" * 30, "xyz" * 30, 5)


WORDS = [a + b for a in ("stone", "river", "castle", "market", "window", "candle") for b in ("", "wood", "field", "house", "maker", "ship")]


def item(seed, n=40):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + rng.choice("xyz") for _ in range(n)]


def test_every_window_with_few_edits_is_found():
    words = item(1)
    index = Items([(7, " ".join(words))], 15, 3)
    auto = index.automaton()
    rng = random.Random(2)
    noise = " ".join(item(3, 60))
    for _ in range(150):
        at = rng.randint(0, 25)
        passage = list(" ".join(words[at : at + 15]))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(passage))
            passage[i : i + 1] = rng.choice([[], ["q"], [passage[i], "q"]]) if passage[i] != " " else [" "]
        assert index.leaked(spoken_letters(noise + " " + "".join(passage) + " " + noise), auto) == [7]
    for _ in range(50):
        short = words[rng.randint(0, 25) :][:12]
        assert index.leaked(spoken_letters(noise + " " + " ".join(short) + " " + noise), auto) == []
        mixed = words[:15]
        rng.shuffle(mixed)
        assert index.leaked(spoken_letters(" ".join(mixed)), auto) == []


def test_find_leaks(spark):
    words = item(1)
    body = "\n".join(f"{i}\n00:00:0{i % 10},000 --> 00:00:0{i % 10},900\n{' '.join(words[i * 4 : i * 4 + 4])}\n" for i in range(6))
    docs = spark.createDataFrame([(1, body, 5), (1, body, 5), (2, " ".join(words[:10]), 5), (3, None, 5), (4, "", 5), (None, body, 5), (5, "x " * 200_000 + " ".join(words), 5)], "doc_id bigint, text string, item int")
    items = spark.createDataFrame([(9, " ".join(words)), (9, " ".join(words)), (8, "too short"), (7, None), (None, "x")], "item_id bigint, text string")
    assert {tuple(r) for r in find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(1, 9), (5, 9)}
    assert find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert find_leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    more = spark.createDataFrame([(i, " ".join(item(i))) for i in range(20, 40)] + [(9, " ".join(words))], "item_id bigint, text string")
    got = [{tuple(r) for r in find_leaks(docs, "doc_id", "text", more, "item_id", "text", shard_mb=mb).collect()} for mb in (8.0, 1e-3)]
    assert got[0] == got[1] and (1, 9) in got[0]


def test_leaks_of_short_windows_and_other_scripts(spark):
    numbers = " ".join(f"{i * 37 % 1000}" for i in range(20))
    russian = "однажды вечером старый рыбак сидел у окна и смотрел на тихое море пока дождь стучал по крыше его дома"
    items = spark.createDataFrame([(1, numbers + " " + " ".join(item(1))), (2, "漢字 かな " * 9), (3, russian)], "item_id bigint, text string")
    said = russian.split()
    docs = spark.createDataFrame([(1, "so " + " ".join(item(1)[5:25])), (2, "he said " + ", ".join(numbers.split()[2:17])), (3, "x " + "漢字 かな " * 8), (4, " ".join(numbers.split()[2:16])), (5, "- " + " ".join(said[2:17]).upper().replace("ОКНА", "0КНА") + "!"), (6, " ".join(said[2:15]))], "doc_id bigint, text string")
    assert {tuple(r) for r in find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()} == {(1, 1), (2, 1), (3, 2), (5, 3)}


@pytest.mark.parametrize("shortest, longest", [(3, 5), (4, 4), (6, 12), (3, 12)])
def test_no_window_within_the_edits_is_lost(shortest, longest):
    rng = random.Random(shortest * 31 + longest)
    # no v: a run of three merges by its place, which costs an edit where a leak cuts it
    word = lambda: "".join(rng.choice("aehimnorstuwy") for _ in range(rng.randint(shortest, longest)))
    for k in range(6):
        words = [word() for _ in range(rng.randint(15, 40))]
        index = Items([(7, " ".join(words))], 15, 3)
        auto, short = index.automaton(), index.short
        noise = spoken_letters(" ".join(word() for _ in range(12)))
        for _ in range(700):
            at = rng.randint(0, len(words) - 15)
            leak = list(spoken_letters(" ".join(words[at : at + 15])))
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(leak))
                leak[i : i + 1] = rng.choice([[], ["q"], [leak[i], "q"], ["q", leak[i]]])
            assert not short and index.leaked(noise + "".join(leak) + noise, auto) == [7]


def test_places_of_merged_letters():
    rng = random.Random(3)
    for _ in range(300):
        raw = "".join(rng.choice("urnvwx") for _ in range(rng.randint(0, 12)))
        letters, begin, end = merged_with_places(raw)
        assert letters == merged(raw) and begin[-1] == end[-1] == len(letters)
        for places in (begin, end):
            assert len(places) == len(raw) + 1 and places == sorted(places)
        assert all(e <= b <= e + 2 for b, e in zip(begin, end))


# ---- spam -------------------------------------------------------------------------------------------------

def talk(rng):
    a, b = rng.choice(["door", "river", "letter", "garden", "train"]), rng.choice(["old", "cold", "quiet", "broken"])
    return rng.choice([f"I think the {a} is {b}.", f"Did you see the {b} {a}?", f"We should go to the {a} now.", f"It was {b}, but the {a} is not.", f"Tell me that the {a} is {b}."])


def subtitle(lines):
    return "\n".join(f"{i}\n00:00:{i % 60:02},000 --> 00:00:{i % 60:02},900\n{x}\n" for i, x in enumerate(lines))


def test_find_spam(spark):
    rng = random.Random(1)
    docs = [(i, subtitle([talk(rng) for _ in range(20)])) for i in range(300)]
    pool = ["zorbex", "quilta", "mavron", "tuskel"]
    spam = {
        1001: [", ".join(rng.choice(pool) + " " + rng.choice(["sale", "online", "cheap"]) for _ in range(5)) for _ in range(12)],
        1002: [f"http://{rng.choice(pool)}{i}.example/{rng.choice(pool)}" for i in range(12)],
        1003: [" ".join("#" + rng.choice(pool) for _ in range(5)) for _ in range(12)],
        1004: [f"Item{i} | size: M | colour: {rng.choice(pool)} | sku {i}" for i in range(12)],
    }
    fine = {2001: [talk(rng) for _ in range(10)] + ["http://a.example/x", "Tags: one; two; three"], 2002: ["la la river, the song is old"] * 12, 2003: ["Tithtola, please."] * 3 + ["Yes."]}
    rows = docs + [(k, subtitle(v)) for k, v in {**spam, **fine}.items()] + [(3001, None), (3002, ""), (None, subtitle(spam[1001])), (1001, subtitle(spam[1001]))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, id int")
    assert {r.id for r in find_spam(df, "doc_id", "text").collect()} == set(spam)
    assert find_spam(df.limit(0), "doc_id", "text").count() == 0
    # counts flushed early give the same
    assert {r.id for r in find_spam(df, "doc_id", "text", flush=50).collect()} == set(spam)


def test_spam_copied_into_a_third_of_all_documents(spark):
    rng = random.Random(1)
    docs = [(i, subtitle([talk(rng) for _ in range(20)])) for i in range(200)]
    pool = ["zorbex", "quilta", "mavron", "tuskel"]
    page = subtitle([", ".join(rng.choice(pool) + " " + rng.choice(["sale", "online", "cheap"]) for _ in range(5)) for _ in range(12)])
    copies = [(1000 + i, page if i % 2 else page.upper()) for i in range(100)]
    df = spark.createDataFrame(docs + copies, "doc_id bigint, text string")
    assert {r.id for r in find_spam(df, "doc_id", "text").collect()} == {k for k, _ in copies}


def test_spam_without_lists(spark):
    rng = random.Random(2)
    nouns = [f"{a}{b}{c}" for a in ("door", "river", "letter", "garden", "train") for b in "aeio" for c in ("way", "man", "side", "post", "bell", "yard", "hand", "song", "gate", "mark", "ship", "road", "wind", "pole", "nest")]
    docs = [(i, subtitle([f"I think the {rng.choice(nouns)} is by the {rng.choice(nouns)}." for _ in range(3)])) for i in range(300)]
    spam = {
        1001: subtitle(["buy cheap shoes online"] * 60), 1002: "shoes cheap shoes sale " * 30,
        1003: subtitle([" ".join(rng.sample(nouns, 5)) for _ in range(12)]), 1004: " ".join(rng.sample(nouns, 60)),
    }
    fine = {2001: subtitle(["la la river, the song is old"] * 12), 2002: subtitle(["la la la la la"] * 12), 2003: subtitle(["Tule tänne, rakas ystävä", "Kuka sinä olet", "Minne menet huomenna aamulla"])}
    df = spark.createDataFrame(docs + [*spam.items(), *fine.items()], "doc_id bigint, text string")
    assert {r.id for r in find_spam(df, "doc_id", "text").collect()} == set(spam)


def test_sounds_are_cues_and_other_scripts_have_words(spark):
    rng = random.Random(3)
    docs = [(i, subtitle([talk(rng) for _ in range(20)])) for i in range(200)]
    pool = ["купить", "дешёво", "обувь", "онлайн"]
    spam = {1001: [" • ".join(f"{rng.choice(pool)} {rng.choice(pool)}" for _ in range(5)) for _ in range(12)], 1002: ["http://a.example/x"] * 7 + ["[door creaks]", "♪ ♪"] * 2}
    fine = {2001: ["Get more at http://a.example/x"] + ["[door creaks]", "(sighs)", "♪ ♪"] * 5, 2002: ["Привет, как дела сегодня?", "Хорошо, спасибо, а у тебя?", "Пойдём завтра к морю."]}
    df = spark.createDataFrame(docs + [(k, subtitle(v)) for k, v in {**spam, **fine}.items()], "doc_id bigint, text string")
    assert {r.id for r in find_spam(df, "doc_id", "text").collect()} == set(spam)


def test_units_of_long_text():
    assert len(units("word " * 300_000)) == 1 and units("[x]") == [] and units("#a #b")[0][1] == 2


# ---- hand-written source ------------------------------------------------------------------------------------

HAND = "\n".join(f"let fold_{w} {w} =\n  if {w} <= {i} then {w}\n  else fold_{w} ({w} - {i % 7 + 1})\n" for i, w in enumerate("alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima".split()))


def test_line_kinds():
    kinds = {'# 12 "lexer.mll"': "directive", "12; 13; 14; 15; 16; 200;": "numbers", "0,abcdefg,2.5,definition": "data", "| C0 __a_0__ -> Wire.tag 0 __a_0__": "machine", "A" * 60: "encoded", "let x = f y " * 20: "long", "let x = 12": "", "f (a, b)": ""}
    assert {k: line_kind(k.strip(), Layout()) for k in kinds} == kinds


def test_ordinary_names_are_no_machine_names():
    for line in ("let timeout = 1_000_000", "raise (Failure __LOC__)", "| status_404 -> Not_found", "fail ~pos:__POS__"):
        assert line_kind(line, Layout()) == ""
    assert numbered_families("a_100 a_200 a_300 b_404 b_404") == set()
    assert numbered_families(" ".join(f"state_{i:03}" for i in range(9))) == {"state"}
    assert made_by_program(layout_of("let timeout = 1_000_000\n" * 40, "a.ml"), LAYOUTS["ml"]) is False


def test_statistics_decide():
    made = lambda code, source="a.ml": made_by_program(layout_of(code, source), LAYOUTS[source.rpartition(".")[2]])
    squeezed = "let a=b(c)in " * 60
    wrapped = "\n".join("var a=e[1],b=t[2];if(a===b)for(;a<b;a++)c(a);var d=f(g,h);" for _ in range(12))
    assert made(squeezed) and made(wrapped) and made(wrapped, "a.js")
    assert made("let t = [|\n" + "\n".join("  10; 20; 30; 40; f x; 50;" for _ in range(30)) + "\n|]")
    assert made("let blob =\n" + "\n".join('  "' + "aGVsbG8gd29ybGQgaGVsbG8gd29ybGQgaGVsbG8gd29ybGQgaGVsbG8gd29ybGQg" + '" ^' for _ in range(9)))
    assert not made(HAND) and not made("") and not made('let usage = "' + "words that people read " * 60 + '"\n' + HAND)
    assert not made("let one_long_line = " + "f x " * 60 + "\n" + HAND) and not made("let days = [| 31; 28; 31; 30; 31; 30 |]\n" + HAND)


def test_comments_and_notices():
    assert split_comments("a (* b *) c /* d */ e // f\ng (* open") == ("a   c   e  \ng (* open", ["(* b *)", "/* d */", "// f"])
    names = lambda text: named_projects(split_comments(text)[1])
    assert "foo-bar" in names("(** Part of the foo-bar distribution,\n report bugs *)") and "foo" not in names("let x = \"Part of the foo distribution\"")
    assert "foo_ext" in names("(* $Project: foo_ext $ *)") and "foo-lwt" in names("(* Home of this file: git://code.example/foo-lwt (mirror x) *)")
    assert "foo" in names("(* foo: a library. Terms: see the foo licence. *)") and "foo" in names("(* Copyright (c) 2009-2011 the foo developers *)") and names("(* foo is used here *)") == []
    for t in ("(* " * 50_000, "/*" * 50_000):
        assert names(t) == [] and layout_of(t, None)["machine"] >= 0


def test_not_handwritten(spark):
    note = "(* This module belongs to {}. *)\n"
    table = "let t = [|\n" + "\n".join("  " + "; ".join(str(i * j % 97) for j in range(14)) + ";" for i in range(20)) + "\n|]\n"
    mini = "!function(e,t){" + "var a=e[1],b=t[2];if(a===b)for(;a<b;a++)c(a);" * 12 + "}"
    other = HAND.replace("alpha", "zulu").replace("(", "( ").replace("then", "then begin")
    rows = [
        (1, "own.1.0:A", "own/src/a.ml", note.format("own") + HAND), (2, "other.1:A", "other/lib/a.ml", note.format("own") + HAND), (3, "third.1:A", "third/x/a.ml", HAND + "let patched = 1\n"),
        (4, "own.2.0:A", "own/src/a.ml", HAND), (5, "p.1:T", "p/t.ml", table), (6, "p.1:M", "p/m.min.js", mini), (7, "p.1:H", "p/vendor_invoices/h.ml", "(* Do not edit the generated table. *)\nlet days = [| 31; 28; 31; 30; 31; 30; 31; 31; 30; 31; 30; 31 |]\n" + other),
        (8, "p.1:U", None, 'let usage = "' + "This is a long line of help for people who read it. " * 12 + '"\n' + HAND.replace("if", "while").replace("then", "do ignore")),
        (9, "p.1:N", "p/n.ml", None), (10, "p.1:E", "p/e.ml", ""), (None, "q.1:A", "q/a.ml", table), (5, "p.1:T", "p/t.ml", table), (11, None, None, "﻿" + table.replace("\n", "\r\n")),
        # by path alone, and similar to a file known by its path alone; a folder that is no package, and the package's own folder, say nothing
        (12, "p.1:A", "p/ext/lwt/poll.ml", other.replace("zulu", "yankee").replace("begin", "begin ()")), (13, "lwt.1:P", "lwt/src/poll.ml", "let poll x = x + 1\n"), (14, "q.1:B", "q/b.ml", other.replace("zulu", "yankee").replace("begin", "begin ()") + "let b = 2\n"),
        (15, "p.1:C", "p/ext/nolwt/poll.ml", "let p q r s = q r s\n"), (16, "lwt.1:C", "lwt/ext/lwt/poll.ml", "let z = poll ()\n"), (17, "core.1:C", "core/src/u.ml", "let u a b = a b\n"), (18, "p.1:D", "p/src/core/u.ml", "let u c d = d c c\n"),
        # short code equal to that of a file with a notice; the same notice names no package here; two files that nobody claims
        (19, "own.1.0:S", "own/src/s.ml", note.format("own") + "let s t u = t (u t)\n"), (20, "q.1:S", "q/s.ml", "let s t u =   t (u t)\n"), (21, "q.1:Z", "q/z.ml", note.format("nobody") + "let z y x = y x y\n"),
        (22, "q.1:V", "q/v.ml", "let v w x = w (x w) w\n"), (23, "p.1:V", "p/v.ml", "let v w x = w (x w) w\n"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "unit_id bigint, unit_key string, source string, text string, owner string")
    got = {r.id: (r.reason, r.owner) for r in not_handwritten(df).collect()}
    assert {i: r[0] for i, r in got.items()} == {2: "copy", 3: "copy", 5: "machine", 6: "machine", 11: "machine", 12: "copy", 14: "copy", 20: "copy"}
    assert got[12][1] == got[14][1] == "lwt" and got[3][1] == "own"
    assert not_handwritten(df.limit(0)).count() == 0
    assert len(shingles("a b c")) == 0


def test_copies_of_any_variant_are_found(spark):
    # variants of a popular file, each with its notice, and files near to one variant only
    words = [f"let v{i} = f{i} x{i}" for i in range(60)]
    variant = lambda k: [w if i % 6 != k else w + f" y{k}" for i, w in enumerate(words)]
    rows = [(100 + k, f"pkg{k}.1:A", f"pkg{k}/a.ml", "(* part of lwt *)\n" + "\n".join(variant(k))) for k in range(6)] + [(1, "lwt.1:A", "lwt/a.ml", "(* part of lwt *)\nlet lwt = 1")]
    rows += [(200 + k, f"bare{k}.1:A", f"bare{k}/b.ml", "\n".join(variant(k)[:-2])) for k in range(6)]
    df = spark.createDataFrame(rows, "unit_id bigint, unit_key string, source string, text string")
    assert {r.id for r in not_handwritten(df).collect()} == {*range(100, 106), *range(200, 206)}


# ---- packing --------------------------------------------------------------------------------------------------

def padding(bounds, counts):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in counts.items())


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(40):
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, 15), rng.randint(1, 7))}
        k = rng.randint(1, 5)
        got = choose_boundaries(counts, k)
        top = max(counts)
        best = min(padding((*c, top), counts) for r in range(k) for c in itertools.combinations(range(1, top), r))
        assert len(got) <= k and got[-1] == top and padding(got, counts) == best
    assert choose_boundaries({5000: 2, 10: 1}, 4) == [10, 5000]
    many = {n: rng.randint(1, 50) for n in rng.sample(range(1, 20_000), 3000)}
    cut = choose_boundaries(many, 40)
    # no boundary can be moved to a neighbouring length for less padding
    lengths = sorted(many)
    for i, b in enumerate(cut[:-1]):
        for other in lengths[max(0, lengths.index(b) - 1) : lengths.index(b) + 2]:
            assert padding(sorted({*cut[:i], other, *cut[i + 1 :]}), many) >= padding(cut, many)


@pytest.mark.parametrize("mix", [True, False])
def test_patterns_place_everything(mix):
    rng = random.Random(4)
    for _ in range(60):
        cap = 100
        sizes = sorted(rng.sample(range(1, 101), rng.randint(1, 12)))
        counts = [rng.randint(0, 40) for _ in sizes]
        patterns = make_patterns(sizes, counts, cap, mix)
        assert all(sum(sizes[b] * c for b, c in p.items()) <= cap and n > 0 for p, n in patterns)
        assert [sum(p.get(b, 0) * n for p, n in patterns) for b in range(len(sizes))] == counts


@pytest.mark.parametrize("mix", [True, False])
def test_pack(spark, mix):
    rng = random.Random(5)
    rows = [(i, rng.choice([rng.randint(1, 90), 33, 33, rng.randint(50, 400)])) for i in range(800)] + [(900, 100), (901, 200), (902, 0), (903, 1)]
    packed = pack(spark.createDataFrame(rows, "id bigint, tokens bigint"), 100, 16, mix).collect()
    per, parts = {}, {}
    for r in packed:
        per[r.container] = per.get(r.container, 0) + r.tokens
        parts.setdefault(r.id, []).append((r.part, r.first_token, r.tokens))
    assert max(per.values()) <= 100 and set(per) == set(range(len(per)))
    for i, n in rows:
        p = sorted(parts.get(i, []))
        assert sum(x[2] for x in p) == n and len(p) == -(-n // 100)
        assert [x[1] for x in p] == [100 * x[0] for x in p]
    empty = spark.createDataFrame([], "id bigint, tokens bigint")
    assert pack(empty, 100).count() == 0
    if mix:
        r = fill_report(pack(spark.createDataFrame(rows, "id bigint, tokens bigint"), 100, 64), 100).first()
        assert r.fullest <= 100 and r.unused_percent < 15


def test_token_sizes(spark):
    enc = load_tokenizer(TOKENIZER)
    texts = ["hello world", "", None, "a" + " " * 200_000 + "b", "Größe 漢字"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(0, texts[0], 9), (None, "x", 9)], "doc_id bigint, text string, tokens int")
    got = {r.id: r.tokens for r in token_sizes(df, "doc_id", "text", TOKENIZER).collect()}
    assert got == {0: 2, 3: count_tokens(enc, texts[3]), 4: len(enc.encode_ordinary(texts[4]))}
    assert token_sizes(df.limit(0), "doc_id", "text", TOKENIZER).count() == 0

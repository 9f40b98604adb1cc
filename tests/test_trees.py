"""Golden vectors, properties T1-T7 and quirks of trees, normalisation and hashing."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.functions import hashing
from arbora.functions.hashing import OFTEN, hash_tree, text_hasher
from arbora.functions.irtree import Node, TreeError, parse_tree, print_tree
from arbora.functions.normalise import inline_all, normalise, rename_locals, substitute
from arbora.model import LOOSE, STRICT, hard, percent
from arbora.plans.tree_queries import KINDS
from arbora.sources.nested import html_tree, json_tree, text_tree

OPT = '(Lifthenelse (Lvar "1") (Lprim "Pfield0" (Lvar "1")) (Lconst))'
ADD = '(Lprim "Paddint" (Lvar "2") (Lvar "1"))'
GOLDEN = {
    "add": (f"(Lfunction {ADD})", 6, 5, 11, "04b8de3af1958d87df9861a61e0f97e9", "d27cffb1162aded6c681a532b96b996e"),
    "sub": ('(Lfunction (Lprim "Psubint" (Lvar "2") (Lvar "1")))', 6, 5, 11, "2a49e97419caf58f08fa66611ebd4c25", "529fcef8e790111d1ecb3005e6d9f214"),
    "addswap": ('(Lfunction (Lprim "Paddint" (Lvar "1") (Lvar "2")))', 6, 5, 11, "aa3d98e8a372dd8dd87058fae176b2f8", "d27cffb1162aded6c681a532b96b996e"),
    "id": ('(Lfunction (Lvar "1"))', 2, 1, 1, "d075723e54d61088201139ff170f1e72", "1f4b7104e9bcb43a085670efa0908e16"),
    "const": ("(Lconst)", 1, 0, 0, "78a629e096ab9f02719f0cd9b73a74fc", "78a629e096ab9f02719f0cd9b73a74fc"),
    "opt": (f"(Lfunction {OPT})", 8, 7, 17, "0d3e08c4bd69bf2f1839e898a2faabfc", "b4acacbbce842bca499dfa05c4122490"),
    "optseq": (f"(Lfunction (Lsequence {OPT} {ADD}))", 14, 13, 41, "e268921683939241e86caf9e03e53173", "9cf450f3d502989cf017962e44968537"),
    "sw": ('(Lfunction (Lswitch (Lvar "1") consts[0 -> (Lconst)] blocks[0 -> (Lprim "Pfield0" (Lvar "1"))] default=none))', 13, 10, 34, "02cc190def26f8f43dd3cb9c0ef0ccc9", "da18586872a15af970d454040f1fed7d"),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(name):
    text, weight, size, total, strict, loose = GOLDEN[name]
    tree = parse_tree(text)
    w, d, bag = hash_tree(tree, STRICT, hard(0))
    assert (w, len(bag), sum(x for x, _ in bag), d) == (weight, size, total, strict)
    assert hash_tree(tree, LOOSE, hard(0))[1] == loose
    assert parse_tree(print_tree(tree)) == tree


def test_bag_is_preorder_with_reversed_arguments():
    bag = hash_tree(parse_tree(GOLDEN["add"][0]), STRICT, hard(0))[2]
    assert [(w, d[:8]) for w, d in bag] == [(5, "849a45f6"), (1, "132690d3"), (3, "62be021c"), (1, "c4ca4238"), (1, "c81e728d")]


def test_thresholds_are_strict():
    bag = hash_tree(parse_tree(GOLDEN["optseq"][0]), STRICT, hard(5))[2]
    assert {w for w, _ in bag} == {13, 7}
    assert all(w > 7 for w, _ in hash_tree(parse_tree(GOLDEN["optseq"][0]), STRICT, percent(50))[2])


def _hash(text, **kw):
    return hash_tree(normalise(parse_tree(text), **kw), STRICT, hard(0))


def same(a, b):
    x, y = _hash(a), _hash(b)
    return x[:2] == y[:2] and sorted(x[2]) == sorted(y[2])


def test_properties_of_equivalent_definitions():
    # T1 other parameter names; T2 a local copy; T6 a local constant; T5 after the front end's beta step
    assert same('(Lfunction ["a" "b"] (Lprim "Paddint" (Lvar "a") (Lvar "b")))', '(Lfunction ["x" "y"] (Lprim "Paddint" (Lvar "x") (Lvar "y")))')
    assert same('(Lfunction ["a"] (Llet strict "t" (Lvar "a") (Lprim "Pnot" (Lvar "t"))))', '(Lfunction ["q"] (Llet strict "u" (Lvar "q") (Lprim "Pnot" (Lvar "u"))))')
    assert same('(Lfunction ["a"] (Llet strict "t" (Lvar "a") (Lvar "t")))', '(Lfunction ["a"] (Lvar "a"))')
    assert same('(Llet strict "c" (Lconst) (Lvar "c"))', "(Lconst)")
    assert same('(Lfunction ["a"] (Llet alias "i" (Lfunction ["z"] (Lvar "z")) (Lvar "a")))', '(Lfunction ["a"] (Lvar "a"))')
    # negatives
    assert not same(GOLDEN["add"][0], GOLDEN["sub"][0])
    assert not same(GOLDEN["add"][0], GOLDEN["addswap"][0])


def test_last_parameter_has_the_lowest_number():
    assert print_tree(rename_locals(parse_tree('(Lfunction ["a" "b"] (Lapply (Lvar "a") (Lvar "b") (Lvar "free")))'))) == '(Lfunction ["2" "1"] (Lapply (Lvar "2") (Lvar "1") (Lvar "free")))'


def test_recursive_names_go_down_and_siblings_restart():
    t = '(Lletrec [("f" (Lvar "g")) ("g" (Lfunction ["x"] (Lvar "x")))] (Lsequence (Llet strict "a" (Levent (Lvar "f")) (Lvar "a")) (Llet strict "b" (Levent (Lvar "g")) (Lvar "b"))))'
    out = print_tree(rename_locals(parse_tree(t)))
    assert '("-2" (Lvar "-1"))' in out and '("-1" (Lfunction ["1"] (Lvar "1")))' in out
    assert out.count('strict "1"') == 2


def test_own_name_is_zero():  # Q19
    t = parse_tree('(Lapply (Lvar "f") (Lvar "f"))')
    assert rename_locals(t, "f") == parse_tree('(Lapply (Lvar "0") (Lvar "0"))')
    assert rename_locals(t) == t


def test_default_branch_is_sealed():  # Q5
    t = '(Lfunction ["a"] (Lswitch (Lvar "a") consts[] blocks[] default=(Lvar "a")))'
    assert 'default=(Lvar "a")' in print_tree(normalise(parse_tree(t)))
    assert 'default=(Lvar "1")' in print_tree(normalise(parse_tree(t), strict_fix=True))
    s = '(Lfunction ["a"] (Lstringswitch (Lvar "a") consts["k" -> (Lvar "a")] default=(Lvar "a")))'
    assert 'default=(Lvar "1")' in print_tree(normalise(parse_tree(s)))


def test_assignment_targets_keep_their_names():  # Q6
    t = '(Lfunction ["a"] (Lassign "a" (Lvar "a")))'
    assert print_tree(normalise(parse_tree(t))) == '(Lfunction ["1"] (Lassign "a" (Lvar "1")))'
    assert print_tree(normalise(parse_tree(t), strict_fix=True)) == '(Lfunction ["1"] (Lassign "1" (Lvar "1")))'


def test_mutable_lets_are_inlined_unless_kept():  # Q4
    t = '(Lmutlet "m" (Lconst) (Lmutvar "m"))'
    assert print_tree(inline_all(parse_tree(t))) == "(Lconst)"
    assert print_tree(inline_all(parse_tree(t), keep_mutable=True)) == print_tree(parse_tree(t))


def test_two_passes_differ_where_a_definition_becomes_trivial():  # Q18
    t = '(Llet strict "a" (Llet strict "b" (Lconst) (Lvar "b")) (Levent (Lvar "a")))'
    once, twice = (print_tree(normalise(parse_tree(t), passes=n)) for n in (1, 2))
    assert once.startswith("(Llet strict") and not twice.startswith("(Llet")


@pytest.mark.parametrize("text, normal", [
    ('(Llet strict "x" (Lvar "a") (Llet strict "x" (Lconst) (Lvar "x")))', "(Lconst)"),
    ('(Llet alias "x" (Lvar "y") (Lfunction ["x"] (Lvar "x")))', '(Lfunction ["1"] (Lvar "1"))'),
    ('(Llet alias "x" (Lvar "y") (Lfunction ["y"] (Lapply (Lvar "x") (Lvar "y"))))', '(Lfunction ["1"] (Lapply (Lvar "y") (Lvar "1")))'),
    ('(Llet alias "x" (Lvar "y") (Ltrywith (Lvar "x") "y" (Lapply (Lvar "x") (Lvar "y"))))', '(Ltrywith (Lvar "y") "1" (Lapply (Lvar "y") (Lvar "1")))'),
    ('(Lfunction ["v"] (Lstaticcatch (Lvar "v") ["v"] (Lvar "v")))', '(Lfunction ["1"] (Lstaticcatch (Lvar "1") ["v"] (Lvar "v")))'),
    ('(Lfunction ["a"] (Lfunction ["a"] (Lswitch (Lvar "a") consts[] blocks[] default=(Lassign "a" (Lvar "a")))))', '(Lfunction ["1"] (Lfunction ["2"] (Lswitch (Lvar "2") consts[] blocks[] default=(Lassign "a" (Lvar "a")))))'),
    ('(Lletrec [("f" (Llet alias "f" (Lvar "g") (Lvar "f")))] (Lvar "f"))', '(Lletrec [("-1" (Lvar "g"))] (Lvar "-1"))'),
])
def test_names_that_shadow_each_other(text, normal):
    assert print_tree(normalise(parse_tree(text))) == normal


def test_substitution_replaces_every_occurrence():
    t = substitute(parse_tree('(Lapply (Lvar "x") (Lassign "x" (Lvar "x")))'), "x", parse_tree("(Lconst)"))
    assert print_tree(t) == '(Lapply (Lconst) (Lassign "x" (Lconst)))'


@pytest.mark.parametrize("bad", ["", "(", "(Lvar)", "(Lvar \"a\"))", "x", "(Lunknown)", "(Lletrec (Lconst) (Lconst))", "[]", "(Lapply [(Lconst)])", "((Lconst))"])
def test_malformed_text(bad):
    with pytest.raises(TreeError):
        parse_tree(bad)


def test_depth_is_not_limited():
    n = 30_000
    t = parse_tree("(Levent " * n + "(Lconst)" + ")" * n)
    w, _, bag = hash_tree(normalise(t), STRICT, hard(0))
    assert (w, len(bag)) == (n + 1, n)
    assert print_tree(t).count("Levent") == n


def trees():
    leaf = st.one_of(st.sampled_from(["a", "b", "c"]).map(lambda v: Node("Lvar", v)), st.just(Node("Lconst")))

    def grow(kids):
        return st.one_of(
            st.lists(kids, min_size=1, max_size=3).map(lambda k: Node("Lapply", "", k)),
            st.lists(kids, min_size=0, max_size=3).map(lambda k: Node("Lprim", "P", k, ["arg"] * len(k))),
            st.tuples(kids, kids, kids).map(lambda k: Node("Lifthenelse", "", k)),
            st.tuples(st.sampled_from(["a", "b"]), kids, kids).map(lambda k: Node("Llet", "strict", k[1:], ["def", "body"], [k[0]])),
            st.tuples(st.sampled_from(["a", "c"]), kids).map(lambda k: Node("Lfunction", "", [k[1]], ["body"], [k[0]])),
        )

    return st.recursive(leaf, grow, max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(trees())
def test_print_and_parse_are_inverse(t):
    assert parse_tree(print_tree(t)) == t


def _shuffled(t, rng):
    kids = [_shuffled(k, rng) for k in t.kids]
    if t.kind == "Lprim":
        rng.shuffle(kids)
    return Node(t.kind, t.text, kids, t.roles, t.binders)


@settings(max_examples=80, deadline=None)
@given(trees(), st.integers(0, 9))
def test_commutative_hash_ignores_argument_order(t, seed):
    assert hash_tree(t, LOOSE, hard(0)) == hash_tree(_shuffled(t, random.Random(seed)), LOOSE, hard(0))


def _respelt(t, env, count):
    if t.kind == "Lvar":
        return Node("Lvar", env.get(t.text, t.text))
    inner, binders = env, t.binders
    if t.binders:
        inner, binders = dict(env), []
        for b in t.binders:
            count[0] += 1
            inner[b] = f"v{count[0]}"
            binders.append(inner[b])
    kids = [_respelt(k, inner if r == "body" else env, count) for k, r in zip(t.kids, t.roles)]
    return Node(t.kind, t.text, kids, t.roles, binders)


@settings(max_examples=80, deadline=None)
@given(trees())
def test_renaming_bound_variables_changes_nothing(t):
    assert hash_tree(rename_locals(t), STRICT, hard(0)) == hash_tree(rename_locals(_respelt(t, {}, [0])), STRICT, hard(0))


def test_other_sources():
    t = html_tree("<div><p>a<br>b</p><p>c</div></x>")
    assert print_tree(t) == '(Lprim "document" (Lprim "div" (Lprim "p" (Lvar "a") (Lprim "br") (Lvar "b")) (Lprim "p" (Lvar "c"))))'
    assert json_tree({"b": [1, None], "a": "x"}) == json_tree({"a": "x", "b": [1, None]})
    assert print_tree(text_tree("a b\n\nc")) == '(Lprim "text" (Lprim "line" (Lvar "a") (Lvar "b")) (Lprim "line" (Lvar "c")))'


#: Strings that are marks of the text, directions, escapes or nothing.
ODD = ["a", "", "none", "up", "consts", "->", ") (", "\0", "\0001\0", "\n", "é", '\\"', "\\\\", '\\\\\\"', "\\a"]
#: Texts of the same shape that aren't the same kind of tree, aren't trees, or spell their strings otherwise.
SHAPED = ['(Lfor "i" (Lvar "%n") (Lconst) "%b" (Lvar "%t"))', '(Lstringswitch (Lvar "%n") "%b" ["k" -> (Lvar "%t")])', '(Lsend "%n" (Lvar "%b") (Lvar "%t"))', '(Lconst "%n")', ' (Lvar "%n") ', '(Lvar "%n"', '(Lvar "%n" "%b")', '("Lvar" "%n")', '(Lvar "%n)', '(Lvar %n")', "(Lvar %n)",
          '(Lstaticcatch (Lconst) ["%n" "%b"] (Lvar "%t"))', '(Lswitch (Lvar "x") consts["%n" -> (Lvar "%b"), "%t" -> (Lconst)] blocks["%n" -> (Lconst)] default="%b")', '(Lprim "%n""%b")', '(Lprim\\"%n" (Lvar "%b"))', '(Lletrec [("%n" (Lconst)) ("%b" (Lvar "%t"))] (Lvar "%n"))', '\0(Lvar "%n")']


def _or_error(f):
    try:
        return f()
    except ValueError as e:
        return str(e)


def _same_by_shape(config):
    by_shape, rng = text_hasher(config), random.Random(1)
    for text in [t for t, _ in KINDS.values()] + SHAPED:
        for _ in range(OFTEN + 40):
            filled = text.replace("%n", rng.choice(ODD)).replace("%b", rng.choice(ODD)).replace("%t", rng.choice(ODD))
            assert _or_error(lambda: by_shape(filled)) == _or_error(lambda: hash_tree(parse_tree(filled), config)[:2]), filled


def test_hashes_by_shape_are_those_of_the_trees_strict():
    _same_by_shape(STRICT)


def test_hashes_by_shape_are_those_of_the_trees_loose():
    _same_by_shape(LOOSE)


def test_texts_of_a_shape_are_parsed_a_few_times(monkeypatch):
    parsed = []
    monkeypatch.setattr(hashing, "parse_tree", lambda text: parsed.append(text) or parse_tree(text))
    by_shape = text_hasher(STRICT)
    for i in range(500):
        by_shape(f'(Lapply (Lvar "{i}") (Lvar "x"))')
    assert len(parsed) == OFTEN + 1  # and the shape, for its program


def test_more_shapes_than_are_kept(monkeypatch):
    monkeypatch.setattr(hashing, "SHAPES", 3)
    by_shape = text_hasher(STRICT)
    for i in range(300):
        text = f'(Lprim p{i % (5 if i < 150 else 2)} (Lvar "{i}"))'
        assert by_shape(text) == hash_tree(parse_tree(text), STRICT)[:2]

"""Queries on single trees: normal forms of trees that need them, and every kind of node, built from table columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.model import LOOSE, STRICT, hard
from arbora.operators import fingerprint
from arbora.plans.catalogue import _TREES, query, trees
from arbora.sources.tables import table

#: Trees that hold the tree at <> and are not normal, each with its normal form: shadowing, capture, definitions that stay,
#: mutable names, parameters from the last to the first, recursion, sealed defaults, handlers, loops and assignments.
FORMS = {
    "shadow": ('(Llet strict "k" (Lconst) (Llet alias "k" <> (Lvar "k")))', "<>"),
    "shadowed constant": ('(Llet strict "k" (Lvar "g") (Lsequence <> (Llet strict "k" (Lconst) (Lvar "k"))))', "(Lsequence <> (Lconst))"),
    "capture": ('(Llet alias "w" (Lvar "g") (Lfunction ["g"] (Lsequence <> (Lapply (Lvar "w") (Lvar "g")))))', '(Lfunction ["1"] (Lsequence <> (Lapply (Lvar "g") (Lvar "1"))))'),
    "kept": ('(Llet strict "k" (Levent <>) (Lapply (Lvar "k") (Lvar "k")))', '(Llet strict "1" (Levent <>) (Lapply (Lvar "1") (Lvar "1")))'),
    "mutable": ('(Lmutlet "m" (Lconst) (Lsequence (Lmutvar "m") <>))', "(Lsequence (Lconst) <>)"),
    "parameters": ('(Llet alias "x" (Lvar "y") (Lfunction ["x" "y"] (Lsequence (Lvar "x") <>)))', '(Lfunction ["2" "1"] (Lsequence (Lvar "2") <>))'),
    "recursion": ('(Lletrec [("f" (Lapply (Lvar "f") <>)) ("h" (Lvar "f"))] (Lapply (Lvar "h") (Lvar "f")))', '(Lletrec [("-2" (Lapply (Lvar "-2") <>)) ("-1" (Lvar "-2"))] (Lapply (Lvar "-1") (Lvar "-2")))'),
    "sealed": ('(Lfunction ["a"] (Lswitch (Lvar "a") consts["0" -> <>] blocks[] default=(Lvar "a")))', '(Lfunction ["1"] (Lswitch (Lvar "1") consts["0" -> <>] blocks[] default=(Lvar "a")))'),
    "handler": ('(Ltrywith <> "e" (Lfor "i" (Lvar "e") (Lconst) up (Lassign "i" (Lvar "i"))))', '(Ltrywith <> "1" (Lfor "2" (Lvar "1") (Lconst) up (Lassign "i" (Lvar "2"))))'),
    "caught": ('(Lfunction ["v"] (Lstaticcatch (Lapply (Lvar "v") <>) ["v"] (Lvar "v")))', '(Lfunction ["1"] (Lstaticcatch (Lapply (Lvar "1") <>) ["v"] (Lvar "v")))'),
}


def _forms_sql() -> str:
    rows = ", ".join(f"('{form}', '{normal}')" for form, (_, normal) in FORMS.items())
    return f"WITH {_TREES}, f(form, normal) AS (VALUES {rows}) SELECT tree_id, form, replace(normal, '<>', ir) AS normal FROM t, f WHERE ir IS NOT NULL"


@query(_forms_sql())
def normal_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every tree inside each of FORMS, normalised."""
    forms = F.array(*[F.struct(F.lit(form).alias("form"), F.lit(text).alias("text")) for form, (text, _) in FORMS.items()])
    whole = trees(spark, sf).where("ir is not null").select("tree_id", "ir", F.explode(forms).alias("f"))
    wrapped = whole.select("tree_id", "f.form", F.replace("f.text", F.lit("<>"), "ir").alias("ir"))
    return fingerprint.normalised_text(wrapped, "ir", "normal").select("tree_id", "form", "normal")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey) AS f FROM lineitem),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f, CAST(l_suppkey AS VARCHAR) || '"') AS k FROM s), n AS (SELECT l_orderkey, max(k) AS top FROM r GROUP BY 1)
    SELECT l_orderkey AS orderkey, '(Lfunction [' || (SELECT string_agg('"' || (top - i + 1) || '"', ' ' ORDER BY i) FROM unnest(range(1, top + 1)) u(i)) || '] (Lapply (Lconst) ' ||
        string_agg('(Lvar "' || (top - k + 1) || '")', ' ' ORDER BY l_linenumber, k) || '))' AS normal FROM r JOIN n USING (l_orderkey) GROUP BY l_orderkey, top""")
def alpha_renamed_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as functions of their suppliers, in order of first occurrence, applied to the items' suppliers; renamed by the kernel."""
    first = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("f"), F.collect_list("l_linenumber").alias("at"))
    name = F.concat(F.lit('"s'), F.col("l_suppkey").cast("string"), F.lit('"'))
    per = first.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("f", name.alias("name")))).alias("names"), F.sort_array(F.flatten(F.collect_list(F.transform("at", lambda i: F.struct(i.alias("i"), F.col("f"), name.alias("name")))))).alias("uses"))
    names = F.array_join(F.transform("names", lambda x: x["name"]), " ")
    uses = F.array_join(F.transform("uses", lambda x: F.concat(F.lit("(Lvar "), x["name"], F.lit(")"))), " ")
    text = per.select(F.col("l_orderkey").alias("orderkey"), F.concat(F.lit("(Lfunction ["), names, F.lit("] (Lapply (Lconst) "), uses, F.lit("))")).alias("ir"))
    return fingerprint.normalised_text(text, "ir", "normal").select("orderkey", "normal")


# ---- every kind of node ------------------------------------------------------------------------------------------

class _Sql:
    """Digests of trees as SQL expressions, by the rules of hashing; a tree is (weight, digest)."""

    def __init__(self, sort: bool, names: bool):
        self.sort, self.names = sort, names

    def leaf(self, text: str) -> tuple[str, str]:
        return "1", f"md5({text})"

    def var(self, name: str, kind: str = "Lvar") -> tuple[str, str]:
        return self.leaf(name if self.names else f"'{kind}'")

    def node(self, label: str, *parts: tuple[str, str]) -> tuple[str, str]:
        digests = ([f"md5('{label}')"] if label else []) + [d for _, d in parts]
        listed = f"[{', '.join(digests)}]"
        raw = f"list_sort({listed})" if self.sort else listed
        return " + ".join(["1", *[w for w, _ in parts]]), f"md5(unhex(array_to_string({raw}, '')))" if digests else "md5('')"

    def listed(self, label: str, *parts: tuple[str, str]) -> tuple[str, str]:
        return self.node(label, *parts[::-1])

    def case(self, key: str, body: tuple[str, str]) -> tuple[str, str]:
        return f"1 + {body[0]}", f"md5(encode({key}) || unhex({body[1]}))"


#: One tree per kind over the columns name, brand and kind of a part (as %n, %b and %t), and the same by the rules.
KINDS = {
    "Lvar": ('(Lvar "%n")', lambda s, n, b, t: s.var(n)),
    "Lmutvar": ('(Lmutvar "%n")', lambda s, n, b, t: s.var(n, "Lmutvar")),
    "Lconst": ('(Lconst "%n")', lambda s, n, b, t: s.leaf("'Lconst'")),
    "Lapply": ('(Lapply (Lvar "%n") (Lvar "%b") (Lconst))', lambda s, n, b, t: s.node("Lapply", s.var(n), s.var(b), s.leaf("'Lconst'"))),
    "Lfunction": ('(Lfunction ["x"] (Lvar "%n"))', lambda s, n, b, t: s.node("Lfunction", s.var(n))),
    "Llet": ('(Llet strict "x" (Lvar "%n") (Lvar "%b"))', lambda s, n, b, t: s.node("Llet", s.var(n), s.var(b))),
    "Lmutlet": ('(Lmutlet "x" (Lvar "%n") (Lvar "%b"))', lambda s, n, b, t: s.node("Lmutlet", s.var(n), s.var(b))),
    "Lletrec": ('(Lletrec [("x" (Lvar "%n")) ("y" (Lvar "%b"))] (Lvar "%t"))', lambda s, n, b, t: s.node("Lletrec", s.listed("", s.var(n), s.var(b)), s.var(t))),
    "Lprim": ('(Lprim "%t" (Lvar "%n") (Lvar "%b"))', lambda s, n, b, t: s.node("Lprim", s.leaf(t), s.listed("", s.var(n), s.var(b)))),
    "Lstaticraise": ('(Lstaticraise (Lvar "%n") (Lvar "%b"))', lambda s, n, b, t: s.node("Lstaticraise", s.listed("", s.var(n), s.var(b)))),
    "Lifthenelse": ('(Lifthenelse (Lvar "%n") (Lvar "%b") (Lvar "%t"))', lambda s, n, b, t: s.node("Lifthenelse", s.var(n), s.var(b), s.var(t))),
    "Lsequence": ('(Lsequence (Lvar "%n") (Lvar "%b"))', lambda s, n, b, t: s.node("Lsequence", s.var(n), s.var(b))),
    "Lwhile": ('(Lwhile (Lvar "%n") (Lvar "%b"))', lambda s, n, b, t: s.node("Lwhile", s.var(n), s.var(b))),
    "Lifused": ('(Lifused "x" (Lvar "%n"))', lambda s, n, b, t: s.node("Lifused", s.var(n))),
    "Lswitch": ('(Lswitch (Lvar "%n") consts[0 -> (Lvar "%b"), 7 -> (Lconst)] blocks[1 -> (Lvar "%t")] default=none)',
                lambda s, n, b, t: s.node("Lswitch", s.var(n), s.listed("sw_consts", s.case("'0'", s.var(b)), s.case("'7'", s.leaf("'Lconst'"))), s.listed("sw_blocks", s.case("'1'", s.var(t))), s.leaf("'None'"))),
    "Lswitch default": ('(Lswitch (Lvar "%n") consts[] blocks[] default=(Lmutvar "%b"))',
                        lambda s, n, b, t: s.node("Lswitch", s.var(n), s.listed("sw_consts"), s.listed("sw_blocks"), s.var(b, "Lmutvar"))),
    "Lstringswitch": ('(Lstringswitch (Lvar "%n") consts["%b" -> (Lvar "%t"), "z" -> (Lconst)] default=(Lvar "%n"))',
                      lambda s, n, b, t: s.node("Lstringswitch", s.var(n), s.listed("sw_consts", s.case(b, s.var(t)), s.case("'z'", s.leaf("'Lconst'"))), s.var(n))),
    "Lassign": ('(Lassign "%n" (Lvar "%b"))', lambda s, n, b, t: s.node("Lassign", s.var(n), s.var(b))),
    "Levent": ('(Levent (Lvar "%n"))', lambda s, n, b, t: s.node("Levent", s.var(n))),
    "Lstaticcatch": ('(Lstaticcatch (Lvar "%n") ["v"] (Lvar "%b"))', lambda s, n, b, t: s.node("Lstaticcatch", s.var(n), s.var(b))),
    "Ltrywith": ('(Ltrywith (Lvar "%n") "e" (Lvar "%b"))', lambda s, n, b, t: s.node("Ltrywith", s.var(n), s.var(b))),
    "Lfor": ('(Lfor "i" (Lvar "%n") (Lvar "%b") down (Lvar "%t"))', lambda s, n, b, t: s.node("Lfor", s.var(n), s.var(b), s.leaf("'Downto'"), s.var(t))),
    "Lsend": ('(Lsend Self (Lvar "%n") (Lvar "%b") (Lvar "%t") (Lconst))', lambda s, n, b, t: s.node("Lsend", s.leaf("'Self'"), s.var(n), s.var(b), s.listed("", s.var(t), s.leaf("'Lconst'")))),
}


def _kinds_sql(sort: bool, names: bool) -> str:
    s, parts = _Sql(sort, names), []
    for kind, (_, rule) in KINDS.items():
        weight, digest = rule(s, "p_name", "p_brand", "p_type")
        parts.append(f"SELECT p_partkey AS part, '{kind}' AS kind, CAST({weight} AS BIGINT) AS weight, {digest} AS digest FROM part")
    return " UNION ALL ".join(parts)


def _kinds(spark: SparkSession, sf: str, config) -> DataFrame:
    forms = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(text).alias("ir")) for kind, (text, _) in KINDS.items()])
    quoted = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    parts = table(spark, sf, "part").select("p_partkey", *[quoted(F.col(c)).alias(c) for c in ("p_name", "p_brand", "p_type")])
    # A part becomes a tree per kind, so that a file of one task would hold back all others.
    spread = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = spread.select("p_partkey", "p_name", "p_brand", "p_type", F.explode(forms).alias("f"))
    text = F.col("f.ir")
    for mark, column in (("%n", "p_name"), ("%b", "p_brand"), ("%t", "p_type")):
        text = F.replace(text, F.lit(mark), F.col(column))
    hashed = fingerprint.fingerprint_trees(rows.select(F.col("p_partkey").alias("part"), "f.kind", text.alias("ir")), "ir", config, with_subs=False)
    return hashed.where("error is null").select("part", "kind", "weight", "digest")


@query(_kinds_sql(False, True))
def node_kinds_strict(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of every kind of node per part, order and names kept."""
    return _kinds(spark, sf, STRICT)


@query(_kinds_sql(True, False))
def node_kinds_loose(spark: SparkSession, sf: str) -> DataFrame:
    """The same, commutative and without names."""
    return _kinds(spark, sf, LOOSE)


@query("""SELECT p_partkey AS part, CAST(i AS BIGINT) AS place, CAST(w AS BIGINT) AS weight, d AS digest FROM (SELECT p_partkey, unnest([
    {'i': 1, 'w': 1, 'd': md5(p_name)}, {'i': 2, 'w': 3, 'd': md5(unhex(md5('sw_consts') || md5(encode(p_brand) || unhex(md5(p_type)))))},
    {'i': 3, 'w': 2, 'd': md5(encode(p_brand) || unhex(md5(p_type)))}, {'i': 4, 'w': 1, 'd': md5('None')}], recursive := true) FROM part)""")
def switch_case_bag(spark: SparkSession, sf: str) -> DataFrame:
    """H5, H6, Q3: the bag of a switch has its cases and its missing default, but not the bodies of its cases."""
    text = F.concat(F.lit('(Lstringswitch (Lvar "'), "p_name", F.lit('") consts["'), "p_brand", F.lit('" -> (Lvar "'), "p_type", F.lit('")] default=none)'))
    hashed = fingerprint.fingerprint_trees(table(spark, sf, "part").select(F.col("p_partkey").alias("part"), text.alias("ir")), "ir", STRICT, hard(0))
    return hashed.where("error is null").select("part", F.posexplode("subs").alias("p", "s")).select("part", (F.col("p") + 1).cast("bigint").alias("place"), "s.weight", "s.digest")

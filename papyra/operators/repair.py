"""Text that extraction has cut, doubled or mixed: repairs, and predicates and classes of clauses by ordered rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions import text as tx


# What shows that a clause has been cut, by its beginning without white space.
INCOMPLETE = ("^[》〉】）)\\]」”’]", "^[^，。；;：:]{0,6}》[^，。；;]{0,20}(?:规定|通知|标准|办法|意见)", "^(?:缴纳账|其中|以及|并且|或者)")


def without_repeats(text: Column, rounds: int = 2) -> Column:
    """A short phrase that stands twice or more in a row, blanks between, once: a word doubled where its line was wrapped."""
    out = text
    for _ in range(rounds):
        out = F.regexp_replace(out, r"(?U)(\p{IsHan}{2,8})(?:\s+\1)+", "$1")
    return out


def without_doubling(text: Column, rounds: int = 2) -> Column:
    """A phrase of four characters or more that follows itself without anything between, once."""
    out = text
    for _ in range(rounds):
        out = F.regexp_replace(out, r"(\p{IsHan}{4,24})\1", "$1")
    return out


def without_overlap(current: Column, addition: Column, least: int = 4) -> Column:
    """``addition`` without the longest beginning, of at least ``least`` characters, that ``current`` ends with; empty if ``current`` holds it all. White space doesn't count."""
    a, b = tx.squeezed(current), tx.squeezed(addition)
    n = F.least(F.char_length(a), F.char_length(b))
    sizes = F.when(n >= least, F.sequence(n, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))

    def cut(x: Column) -> Column:
        common = F.coalesce(F.get(F.filter(x["sizes"], lambda k: F.right(x["a"], k) == F.left(x["b"], k)), F.lit(0)), F.lit(0))
        pattern = F.concat(F.lit(r"(?U)^(?:\s*\S){"), common.cast("string"), F.lit(r"}\s*"))
        return F.when((x["b"] != "") & F.contains(x["a"], x["b"]), "").when(common == 0, addition).otherwise(F.regexp_replace(addition, pattern, F.lit("")))

    return tx.let(F.struct(a.alias("a"), b.alias("b"), sizes.alias("sizes")), cut)


def distinct_segments(text: Column) -> Column:
    """The parts between semicolons, without those that another part holds; of equal ones the first stays."""
    parts = F.filter(F.transform(F.split(text, "[；;]"), lambda x: F.trim(x)), lambda x: x != "")

    def kept(p: Column) -> Column:
        flat = F.transform(p, tx.squeezed)
        held = lambda x, i: F.exists(F.transform(flat, lambda y, j: F.contains(y, tx.squeezed(x)) & (i != j) & ((y != tx.squeezed(x)) | (j < i))), lambda t: t)
        return F.array_join(F.filter(p, lambda x, i: ~held(x, i)), "；")

    return tx.let(parts, kept)


def numeric_fragment(text: Column) -> Column:
    """Doubled percent signs once, no blanks before punctuation, and no parts with a bare sign where another has the number, or that only begin another."""
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(tx.collapsed(text), r"\s+([。；;，,、！？!?])", "$1"), r"([（(])\s+", "$1"), "(%|％)\\1+", "$1")
    parts = F.filter(F.transform(F.split(tidy, "[，,；;]"), lambda x: F.trim(x)), lambda x: x != "")

    def kept(p: Column) -> Column:
        real = F.exists(p, lambda x: x.rlike("[0-9]"))
        begins = lambda x, i: F.exists(F.transform(p, lambda y, j: (j != i) & F.startswith(tx.squeezed(y), tx.squeezed(x)) & ((tx.squeezed(y) != tx.squeezed(x)) | (j < i))), lambda t: t)
        return F.array_join(F.filter(p, lambda x, i: ~(real & ~x.rlike("[0-9]") & x.rlike("[%％]")) & ~begins(x, i)), "，")

    return tx.let(parts, kept)


def is_incomplete(text: Column) -> Column:
    """What extraction left of a clause: it begins with a closing bracket, with the end of a cited title, or with a word that joins."""
    own = tx.squeezed(text)
    return reduce(lambda x, y: x | y, (own.rlike(p) for p in INCOMPLETE))


def is_internal(text: Column, subjects: str, themes: str, duties: str) -> Column:
    """A clause on what the buyer's side does by itself (patterns of its subject and its theme), unless it puts a duty on the bidder."""
    return text.rlike(subjects) & text.rlike(themes) & ~text.rlike(duties)


def is_fee(text: Column, words: tuple[str, ...]) -> Column:
    """A clause that only states a fee for documents or a platform; bonds are none."""
    return ~text.contains("保证金") & tx.contains_any(text, words)


def first_of(text: Column, rules: list[tuple[str, str]], default: str = "") -> Column:
    """The name of the first rule (name, pattern) that the text fits."""
    return reduce(lambda out, r: F.when(text.rlike(r[1]), F.lit(r[0])).otherwise(out), reversed(rules), F.lit(default))


def role_of(value: Column, context: Column, by_name: list[tuple[str, str]], by_context: list[tuple[str, str]], unknown: str = "UNKNOWN") -> Column:
    """A name's role by its own words, else by those around it."""
    name, near = tx.squeezed(F.coalesce(value, F.lit(""))), tx.squeezed(F.coalesce(context, F.lit("")))
    own = first_of(name, by_name)
    return F.when(name == "", unknown).when(own != "", own).otherwise(first_of(near, by_context, unknown))


def segments(text: Column) -> Column:
    """A text's parts: cut at numbered items and at the marks that end sentences."""
    cut = F.regexp_replace(text, r"(?:^|(?<=[；;。：:\s]))[（(]?[0-9]{1,2}[）)、](?![0-9])|[。；;！!？?\n]", "\u001e")
    return F.filter(F.transform(F.split(cut, "\u001e"), lambda x: F.btrim(x, F.lit(" \t\r\n；;。，,、"))), lambda x: x != "")


def owned_segments(text: Column, allow: str, deny: str, least: int = 4) -> Column:
    """The parts of a text that a contract (patterns of what it takes and what it refuses) may own, each once.

    Of a part that it refuses, the longest runs of comma clauses that it takes, from the left, if they have ``least`` characters.
    """
    takes = lambda x: x.rlike(allow) & ~x.rlike(deny)

    def runs(part: Column) -> Column:
        clauses = F.filter(F.split(F.regexp_replace(part, "([，,])", "$1\u001e"), "\u001e"), lambda x: x != "")
        bare = F.array().cast("array<string>")

        def step(acc: Column, c: Column) -> Column:
            longer = F.concat(acc["now"], c)
            done = F.when(acc["now"] != "", F.concat(acc["out"], F.array(acc["now"]))).otherwise(acc["out"])
            return F.when(takes(longer), F.struct(acc["out"].alias("out"), longer.alias("now"))).otherwise(F.struct(done.alias("out"), F.when(takes(c), c).otherwise("").alias("now")))

        found = F.aggregate(clauses, F.struct(bare.alias("out"), F.lit("").alias("now")), step, lambda a: F.when(a["now"] != "", F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]))
        return F.filter(F.transform(found, lambda x: F.rtrim(x, F.lit(" 、,，;；"))), lambda x: (F.char_length(x) >= least) & takes(x))

    return F.array_distinct(F.flatten(F.transform(segments(text), lambda s: F.when(takes(s), F.array(s)).otherwise(runs(s)))))


def breaches(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Codes of the rules (code, pattern wanted or empty, pattern refused or empty) that a text breaks."""
    out = [F.when(((~text.rlike(want)) if want else F.lit(False)) | (text.rlike(refuse) if refuse else F.lit(False)), F.lit(code)) for code, want, refuse in rules]
    return F.array_compact(F.array(*out))

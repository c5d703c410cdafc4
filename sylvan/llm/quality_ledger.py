"""Quality rules as a bitmask ledger.

Every rule is evaluated once; its verdict is a bit and its inputs are kept
as measurements. Policies are masks over the bits, so applying another
version, or asking what a rule alone rejects, reads the ledger and no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, WORD_RE

#: Rules in the order of their bits, over the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 40 * n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "shouting": "2 * n_upper > word_chars",
}
#: Versions of the policy: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, window: int = 3) -> Column:
    """Words that lie in windows found twice or more. Hashes of the windows
    are sorted with their places packed into the low bits; equal neighbours
    are sorted again by the words themselves, since hashes cut short may
    agree by chance. What is equal there gives the places of repeats, and
    gaps between those the words covered."""

    def places(w: Column) -> Column:
        n = F.size(w) - window + 1
        return _let(F.length(F.bin(F.size(w).cast("long"))).cast("int"), lambda bits: sorted_places(w, n, bits))

    def sorted_places(w: Column, n: Column, bits: Column) -> Column:
        top = lambda x: F.call_function("shiftright", x, bits)
        packed = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.call_function("shiftleft", top(F.xxhash64(*[F.get(w, i + j) for j in range(window)])), bits).bitwiseOR(i.cast("long")),
        )
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        twice = lambda s: F.filter(
            s, lambda x, i: F.coalesce(top(F.get(s, i - 1)) == top(x), F.lit(False)) | F.coalesce(top(F.get(s, i + 1)) == top(x), F.lit(False))
        )
        exact = lambda x: F.struct(F.slice(w, x.bitwiseAND(low).cast("int") + 1, window).alias("g"), x.bitwiseAND(low).alias("at"))
        same = lambda s, i, x: F.coalesce(F.get(s, i)["g"] == x["g"], F.lit(False))
        found = lambda s: F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x))
        likely = lambda s: F.sort_array(F.transform(twice(s), exact))
        return _let(F.sort_array(packed), lambda s: _let(likely(s), lambda c: F.sort_array(F.transform(found(c), lambda x: x["at"]))))

    covered = lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(window).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    )
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(_let(places(words), covered))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, the measurements and ``failures``: bit i is set if rule i fails.
    With ``carry`` the whole input row stands before them, as ``row``.

    A null text measures as an empty one; a null id stays null; repeated
    rows are judged each. An empty table gives no rows. Only the two named
    columns are read, but for ``carry``.
    """
    first = [F.struct("*").alias("row")] if carry else []
    row = ["row"] * carry
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_RE))
    measured = (
        df.select(*first, F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .select(*row, "doc_id", "text", F.regexp_extract_all("text", F.lit(WORD_RE), F.lit(0)).alias("words"), lines.alias("lines"))
        .select(
            *row,
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            repeat_words(F.col("words")).alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        )
    )
    if carry:  # a generator keeps filters on the ledger from being pushed into, and repeating, the measuring
        measured = measured.select("row", F.explode(F.array(F.struct("doc_id", *MEASURES))).alias("m")).select("row", "m.*")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failures", total.cast("long"))


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def apply_policy(kept: DataFrame, policy: str = "v1") -> DataFrame:
    """A ledger with base_failed, kept under the policy, and ``only_rule``: the
    rule without which a rejected document would be kept, if there is one."""
    fails = lambda p: F.col("failures").bitwiseAND(F.lit(mask(p)).cast("long"))
    names = list(RULES)
    only = None
    for r in POLICIES[policy]:
        hit = fails(policy) == 1 << names.index(r)
        only = F.when(hit, r) if only is None else only.when(hit, r)
    return kept.withColumn("base_failed", fails("base") != 0).withColumn("kept", (fails("base") == 0) & (fails(policy) == 0)).withColumn("only_rule", only)


def ablation(kept: DataFrame, policy: str = "v1") -> DataFrame:
    """rule, fails (documents that fail it), alone (that only it rejects),
    kept_without (documents kept if it were dropped): all from one count of
    the distinct bitmasks."""
    counts = kept.groupBy(F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("f")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    f, bit, n = F.col("f"), F.col("x.bit"), F.col("n")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    return (
        counts.withColumn("x", rules)
        .groupBy(F.col("x.rule").alias("rule"))
        .agg(total(f.bitwiseAND(bit) != 0).alias("fails"), total(f == bit).alias("alone"), total((f == 0) | (f == bit)).alias("kept_without"))
    )


def assess(df: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return apply_policy(ledger(df, id_col, text_col), policy)


def keep(df: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that the policy keeps, with their own columns. A
    null text has no words and so is rejected; ids, null or repeated, don't
    matter; equal rows are judged alike. An empty table gives no rows."""
    return apply_policy(ledger(df, id_col, text_col, carry=True), policy).where("kept").select("row.*")

"""Operator 10, quality rules: a ledger with every measurement and one failure bit a rule, read by versioned policies.

Each rule is evaluated once a document, inside the scan and without a shuffle; a policy is a bit mask over the ledger, so
a new policy or an ablation never reads a text again. DataFrame functions only.

Defined results: a null or empty text has all measurements 0 and fails only `few_words`; texts of any length are
measured whole; repeated rows are judged one by one; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import WORD, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rule name and predicate over the measurements; the position is the bit. Only ever append.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "4 * n_symbols > n_words"),
    ("shouting", "10 * n_exclamations > 3 * n_words"),
    ("repeated_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
]
BASE = ("few_words", "repeated_words")
#: A policy is the rules whose failure drops a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": ("few_words", "repeated_words", "symbols", "shouting", "repeated_lines", "word_length"),
}


def rule_bit(name: str) -> int:
    return 1 << [n for n, _ in RULES].index(name)


def policy_mask(policy: str) -> int:
    return sum(rule_bit(n) for n in POLICIES[policy])


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a five-word window found at least twice in the text, its first place included.

    Windows are compared by a 64-bit hash of their words' hashes. Most texts repeat none, which a hash set tells; in the
    others, sorting (hash, place) brings equal windows together, and the places that have an equal neighbour, in text
    order, cover five words each less their overlap.
    """
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda j: F.xxhash64(*[F.get(h, j + k) for k in range(WINDOW)])))

    def covered(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        hits = let(placed, lambda k: F.filter(F.transform(k, lambda x, j: F.when((F.get(k, j - 1)["h"] == x["h"]) | (F.get(k, j + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()))
        return let(F.sort_array(hits), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    return F.when(F.size(tokens) >= WINDOW, let(windows, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))).otherwise(F.lit(0))


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct of longs."""
    text = F.coalesce(text, F.lit(""))
    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    long = lambda c: c.cast("long")

    def measured(t: Column) -> Column:
        return F.struct(
            let(words(t), lambda w: F.struct(long(F.size(w)).alias("n_words"), long(F.char_length(F.array_join(w, ""))).alias("word_chars"), long(repeated_words(w)).alias("n_repeat_words"))).alias("w"),
            long(F.regexp_count(t, F.lit(f"[{SYMBOLS}]"))).alias("n_symbols"),
            long(F.regexp_count(t, F.lit("!"))).alias("n_exclamations"),
            let(lines(t), lambda x: F.struct(long(F.size(x)).alias("n_lines"), long(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        )

    return let(text, measured)


def quality_ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, the measurements and `fail_bits`, one row a document, measured in one pass."""
    flat = docs.select(*keep, measurements(F.col(text_col)).alias("hf_m")).select(*keep, "hf_m.w.n_words", "hf_m.w.word_chars", "hf_m.n_symbols", "hf_m.l.n_dup_lines", "hf_m.w.n_repeat_words", "hf_m.n_exclamations", "hf_m.l.n_lines")
    bits = " + ".join(f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, (_, rule) in enumerate(RULES))
    return flat.withColumn("fail_bits", F.expr(bits))


def apply_policy(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with `base_failed` and `kept` under a policy; `kept` is never true where the base rules fail."""
    failed = lambda p: F.col("fail_bits").bitwiseAND(F.lit(policy_mask(p))) != 0
    return ledger.withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(policy))


def ablations(ledger: DataFrame, policy: str = "v1") -> DataFrame:
    """One row a rule of the policy: documents that fail it, that only it drops, and that the policy keeps without it.

    Ledger rows are first counted by their failure bits, of which there are at most 2 ** len(RULES); the bit arithmetic
    runs on those counts.
    """
    mask = policy_mask(policy)
    counts = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(rule_bit(n)).alias("bit")) for n in POLICIES[policy]])
    spread = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    count_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return spread.groupBy("rule", "bit").agg(
        count_if(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count_if(F.col("bits") == F.col("bit")).alias("n_only"),
        count_if(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )

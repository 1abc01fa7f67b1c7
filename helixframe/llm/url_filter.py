"""Operator 1, URL filters: host and path rules, then a character language-model ratio for the URLs they leave open.

Two smoothed variable-order Markov models, of the URLs that rules accept and of those that they reject, give each
character's probability from up to three characters before it (Witten-Bell interpolation down to a uniform one). Their
log-likelihood difference, divided by the length, is held against a threshold calibrated on a quarter of the ruled URLs
that the models have not seen. DataFrame functions only; characters are folded to 32 symbols, so the model has at most
32 ** 4 values whatever the corpus, and every URL of it is counted.

Defined results: a null url, or one without `://`, has empty host and path, fits no rule and scores 0; repeated rows
are judged alike; where rules accept nothing or reject nothing there is no ratio, and open URLs are allowed; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import let, materialise

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols are the letters and six signs that follow or precede them in ASCII, so that a symbol's number is its code less 96.
OTHER, DIGIT, DOT, SLASH, DASH, START = "`", "{", "|", "}", "~", "\x7f"
SYMBOLS, ORDER = 32, 3
BINS = 512


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; both null if none does. Of equally long rules the first wins."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit("/" + rest))
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def grams(host: Column, path: Column) -> Column:
    """The numbers of all four-symbol strings of host and path, the first three of which reach back before the start."""
    folded = F.regexp_replace(F.translate(F.concat(host, path), UPPER + "0123456789./-", LOWER + DIGIT * 10 + DOT + SLASH + DASH), r"[^a-z{|}~]", OTHER)
    codes = F.transform(F.split(F.concat(F.lit(START * ORDER), folded), ""), lambda c: F.ascii(c) - 96)
    number = lambda c, i: sum(((F.get(c, i + k) * SYMBOLS ** (ORDER - k)) for k in range(ORDER)), F.get(c, i + ORDER))
    return let(codes, lambda c: F.when(F.size(c) > ORDER, F.transform(F.sequence(F.lit(0), F.size(c) - (ORDER + 1)), lambda i: number(c, i))).otherwise(F.array().cast("array<int>")))


def markov_ratio(counted: DataFrame) -> DataFrame:
    """`gram`, `ratio`: log P(symbol | three before it) of the accepted model less that of the rejected one.

    `counted(gram, yes, no)` has every gram of the corpus, with its counts among accepted and rejected URLs. Lower
    orders are sums of it, so no text is read again.
    """
    level, joined = None, None
    for order in range(ORDER + 1):
        key = f"g{order}"
        own = counted.groupBy((F.col("gram") % SYMBOLS ** (order + 1)).cast("int").alias(key)).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        context = own.groupBy(F.floor(F.col(key) / SYMBOLS).cast("int").alias("hf_context")).agg(
            *[F.sum(c).alias(f"n_{c}") for c in ("yes", "no")], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"t_{c}") for c in ("yes", "no")]
        )
        joined = own.join(context, F.floor(F.col(key) / SYMBOLS).cast("int") == F.col("hf_context"))
        if level is not None:
            joined = joined.join(level, (F.col(key) % SYMBOLS**order).cast("int") == F.col(f"g{order - 1}"))
        lower = lambda c: F.lit(1 / SYMBOLS) if level is None else F.col(f"p_{c}")  # noqa: E731, B023
        smooth = lambda c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * lower(c)) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(lower(c))
        level = joined.select(key, smooth("yes").alias("p_yes"), smooth("no").alias("p_no"))
    return level.select(F.col(f"g{ORDER}").alias("gram"), (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def calibrate(scores: DataFrame) -> DataFrame:
    """One row, `threshold`: where accepted and rejected URLs part best, from a histogram of `BINS` bins over [-4, 4)."""
    bins = scores.select(F.least(F.greatest(F.floor((F.col("score") + 4) * (BINS / 8)), F.lit(0)), F.lit(BINS - 1)).cast("int").alias("bin"), "hf_label")
    counts = bins.groupBy("bin").agg(F.count(F.when(F.col("hf_label") == "allow", 1)).alias("yes"), F.count(F.when(F.col("hf_label") == "block", 1)).alias("no"))
    table = counts.agg(F.sort_array(F.collect_list(F.struct("bin", "yes", "no"))).alias("bins"))
    below = lambda b, c, name: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + F.when(x["bin"] < c, x[name]).otherwise(0))
    total = lambda b, name: below(b, F.lit(BINS), name)
    gain = lambda b, c: below(b, c, "no") / total(b, "no") - below(b, c, "yes") / total(b, "yes")
    options = F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda c: F.struct(gain(F.col("bins"), c).alias("gain"), (-c).alias("cut")))
    best = F.when((total(F.col("bins"), "no") > 0) & (total(F.col("bins"), "yes") > 0), -F.array_max(options)["cut"] * (8 / BINS) - 4)
    return table.select(F.coalesce(best, F.lit(float("-inf"))).alias("threshold"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score, one row a row of `pages`; only the id and url columns are read."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("hf_id"), host.alias("host"), path.alias("path"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = materialise(parts.withColumns({"rule": rule, "hf_label": action, "hf_fold": F.pmod(F.crc32(F.concat("host", "path").cast("binary")), F.lit(4))}))
    learn = lambda label: F.sum(F.when((F.col("hf_label") == label) & (F.col("hf_fold") > 0), 1).otherwise(0))
    exploded = urls.select("hf_label", "hf_fold", F.explode(grams(F.col("host"), F.col("path"))).alias("gram"))
    counted = exploded.groupBy("gram").agg(learn("allow").alias("yes"), learn("block").alias("no"))
    every = pages.sparkSession.range(SYMBOLS ** (ORDER + 1)).select(F.col("id").cast("int").alias("gram"))
    dense = every.join(markov_ratio(materialise(counted)), "gram", "left").agg(F.sort_array(F.collect_list(F.struct("gram", F.coalesce("ratio", F.lit(0.0)).alias("r")))).alias("m"))
    model = dense.select(F.transform("m", lambda x: x["r"])).scalar()
    mean = lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(F.col("hf_model"), x)) / F.size(g)).otherwise(F.lit(0.0))
    scored = materialise(urls.withColumn("hf_model", model).withColumn("score", let(grams(F.col("host"), F.col("path")), mean)).drop("hf_model"))
    threshold = calibrate(scored.where((F.col("hf_fold") == 0) & F.col("hf_label").isNotNull())).scalar()
    return scored.select(F.col("hf_id").alias(id_col), "host", "path", "rule", F.coalesce("hf_label", F.when(F.col("score") < threshold, "block").otherwise("allow")).alias("verdict"), "score")

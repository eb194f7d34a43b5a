"""Quality rules with risk-controlled cutoffs: exact binomial tests on labelled documents, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import SPACES, stored

WINDOW = 5
MIN_WORDS, REPEAT_PERCENT = 10, 20
SYMBOLS = r"[#*$%&|<>]"

# At most this share of a stratum's good documents may be rejected by all rules together, and the chance that any cutoff
# of any stratum breaks its share of that is at most ERROR.
RISK, ERROR = 0.05, 0.05
# Rejected labelled documents of the proposing half have to be bad ones this many times as often as good ones.
LIFT = 4.0

# Each rule rejects what lies above a cutoff; cutoffs are tried from the mildest down.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [3.0 * 0.8**k for k in range(30)]),
    "dup_lines": ("n_dup_lines / n_lines", [0.9 * 0.85**k for k in range(24)]),
    "repeats": ("n_repeat_words / n_words", [0.2 * 0.85**k for k in range(24)]),
    "long_words": ("word_chars / n_words", [30.0 * 0.95**k for k in range(40)]),
    "short_words": ("-word_chars / n_words", [-1.0 - 0.1 * k for k in range(40)]),
}


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) of whole texts.

    A null text has no words, lines or symbols. n_lines counts lines with a word. Windows that may repeat are found by a
    hash and then compared word for word, so n_repeat_words is exact. ``docs`` needs doc_id and text, lang may be missing.
    """
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = docs.select("doc_id", lang.alias("lang"), text.alias("text"), F.btrim(text, F.lit(SPACES)).alias("trimmed"))
    none = F.array().cast("array<string>")
    split = trimmed.select(
        "doc_id", "lang",
        F.when(F.col("trimmed") == "", none).otherwise(F.split("trimmed", r"[\x20\x09-\x0D]+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    hashes = "if(size(words) < {w}, cast(array() as array<bigint>), transform(sequence(0, size(words) - {w}), i -> xxhash64({at})))".format(
        w=WINDOW, at=", ".join(f"words[i + {k}]" for k in range(WINDOW))
    )
    counted = split.select(
        "doc_id", "lang", "n_symbols", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(hashes).alias("hashes"),
    )
    # Most texts repeat no window and skip all that follows.
    maybe = "size(array_distinct(hashes)) < size(hashes)"
    keep = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    ordered = counted.select(*keep, "words", F.expr(f"if({maybe}, array_sort(transform(hashes, (h, i) -> struct(h, i))), null)").alias("by_hash"))
    alike = "filter({a}, (x, k) -> (k > 0 and {a}[k - 1].{f} = x.{f}) or (k < size({a}) - 1 and {a}[k + 1].{f} = x.{f}))"
    candidates = ordered.select(*keep, "words", F.expr(alike.format(a="by_hash", f="h")).alias("candidates"))
    spelled = candidates.select(*keep, F.expr(
        f"array_sort(transform(candidates, x -> struct(slice(words, x.i + 1, {WINDOW}) as t, x.i as i)))"
    ).alias("by_words"))
    places = spelled.select(*keep, F.expr(f"array_sort(transform({alike.format(a='by_words', f='t')}, x -> x.i))").alias("places"))
    covered = F.expr(
        "aggregate(transform(places, (p, k) -> if(k = size(places) - 1, {w}, least({w}, places[k + 1] - p))), 0L, (a, x) -> a + x)".format(w=WINDOW)
    )
    return places.select(*keep, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _values() -> Column:
    return F.array(*[F.coalesce(F.expr(f"try_divide({x.split(' / ')[0]}, {x.split(' / ')[1]})"), F.lit(-1e9)) for x, _ in RULES.values()])


def binomial_tail(n: str, k: str, rate: float) -> Column:
    """P(X <= k) of a binomial X of n trials at ``rate``, exact up to rounding: terms are summed as logarithms."""
    step = (
        f"named_struct('t', acc.t + ln(({n} - j + 1) / j * {rate / (1 - rate)!r}D),"
        f" 's', acc.s + ln(1 + exp(acc.t + ln(({n} - j + 1) / j * {rate / (1 - rate)!r}D) - acc.s)))"
    )
    first = f"{n} * ln({1 - rate!r}D)"
    return F.expr(
        f"exp(aggregate(if({k} > 0, sequence(1L, {k}), cast(array() as array<bigint>)),"
        f" named_struct('t', cast({first} as double), 's', cast({first} as double)), (acc, j) -> {step}, acc -> acc.s))"
    )


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(lang, cutoffs): for each stratum and rule the lowest certified cutoff, null where none is.

    Documents labelled more than once count as bad when any label says so; labels that are null, or of documents not in
    ``stats``, are left out. Documents that fail the base rules are not counted. Half the labelled documents, by hash of
    doc_id, propose: a cutoff has to reject bad ones far more often than good ones there. The other half tests, by
    fixed sequence from the mildest cutoff: each is certified while the chance of so few false rejections, were the true
    rate at its limit, is at most ``error`` over the number of rules and strata (Bonferroni). Limits of the rules add up
    to ``risk``.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = stats.where(~base_failed()).join(marks, "doc_id").select(
        "lang", (F.col("quality") > 0).alias("good"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0).alias("tests"), _values().alias("values")
    )
    grid = F.array(*[F.array(*[F.lit(c) for c in cuts]) for _, cuts in RULES.values()])
    per_rule = marked.select("lang", "good", "tests", F.posexplode(F.arrays_zip("values", grid.alias("grid"))).alias("rule", "z"))
    # How many cutoffs of the rule reject a document: they are the last ones of the falling grid.
    hits = per_rule.select("lang", "good", "tests", "rule", F.expr("size(filter(z.grid, c -> z.values > c))").alias("hits"), F.size("z.grid").alias("steps"))
    # A count for each number of hits: of bounded size per stratum.
    counts = hits.groupBy("lang", "rule", "steps", "hits").agg(*[
        F.count_if(F.col("good") == good).alias(name) if tests is None else F.count_if((F.col("good") == good) & (F.col("tests") == tests)).alias(name)
        for name, good, tests in (("good_test", True, True), ("good_first", True, False), ("bad_first", False, False))
    ])
    stacked = counts.groupBy("lang", "rule", "steps").agg(
        F.collect_list(F.struct("hits", "good_test", "good_first", "bad_first")).alias("c"), F.sum("good_test").alias("n")
    )
    total = lambda f: f"aggregate(filter(c, x -> x.hits >= steps - step), 0L, (a, x) -> a + x.{f})"
    tried = stacked.select("lang", "rule", "n", "steps", "c", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("step")).select(
        "lang", "rule", "step", "n", F.expr(total("good_test")).alias("k"), F.expr(total("good_first")).alias("good_first"), F.expr(total("bad_first")).alias("bad_first")
    )
    limit = risk / len(RULES)
    strata = tried.agg(F.count_distinct("lang").alias("strata"))
    tested = tried.crossJoin(F.broadcast(strata)).withColumn(
        "holds", F.when(F.col("k") > F.col("n") * limit, F.lit(False)).otherwise(binomial_tail("n", "k", limit) <= F.lit(error / len(RULES)) / F.col("strata"))
    )
    so_far = Window.partitionBy("lang", "rule").orderBy("step")
    certified = tested.withColumn("all_hold", F.min("holds").over(so_far)).where("all_hold")
    useful = certified.where((F.col("bad_first") > 0) & (F.col("bad_first") >= LIFT * F.col("good_first")))
    chosen = useful.groupBy("lang", "rule").agg(F.max("step").alias("step"))
    picked = [F.max(F.when(F.col("rule") == r, F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("step") + 1))) for r, (_, cuts) in enumerate(RULES.values())]
    return chosen.groupBy("lang").agg(F.array(*picked).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(doc_id, lang, counts, base_failed, kept) of every row of ``docs`` (doc_id, text, lang).

    A stratum is a language, null being the empty one. Where labels are too few to certify a cutoff, the rule
    rejects nothing. Rows of one doc_id are judged each by its own text; with no labels only the base rules reject.
    """
    stats = stored(statistics(docs.select("doc_id", "text", *(["lang"] if "lang" in docs.columns else []))), "quality")
    found = cutoffs(stats, labels, risk, error)
    judged = stats.join(found, "lang", "left").withColumn("values", _values()).withColumn("base_failed", base_failed())
    broken = F.expr("exists(arrays_zip(values, cutoffs), z -> coalesce(z.values > z.cutoffs, false))")
    kept = ~F.col("base_failed") & ~F.coalesce(F.when(F.col("cutoffs").isNull(), False).otherwise(broken), F.lit(False))
    return judged.select(*stats.columns, "base_failed", kept.alias("kept"))

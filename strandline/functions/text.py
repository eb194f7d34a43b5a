"""Small text helpers built from column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that never become keywords.
STOP_WORDS = """
a an the is are was were be been being
have has had do does did will would could
should may might shall can to of in for
on with at by from and but or if how
what where when who why which this that
i my me we our you it its they there
get let make change work
""".split()

MAX_KEYWORDS = 8


def strip(c: Column) -> Column:
    """Trim any whitespace at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def keywords(question: Column) -> Column:
    """First eight lowercase words longer than one character that are not stop words."""
    kept = F.filter(words(F.lower(question)), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 1))
    return F.slice(kept, 1, MAX_KEYWORDS)


def tokens(c: Column) -> Column:
    """Lowercase alphanumeric index terms."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def token_count(c: Column) -> Column:
    """Number of index terms, without building them."""
    return F.regexp_count(F.lower(c), F.lit("[a-z0-9]+"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, repo, dl, term, tf) of the whole texts of ``docs`` (doc_id, repo, text); rows alike in id, repository and
    length count as one document.

    A document's terms are counted in its own row, as runs of its sorted terms: a task holds texts, and not a table of all
    the terms of all its documents.
    """
    # Splitting texts is the heavy part: deal them out evenly, whatever the files look like.
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "repo", "text", token_count(F.col("text")).alias("dl"))
    rows = rows.repartition("doc_id", "repo", "dl").groupBy("doc_id", "repo", "dl").agg(F.collect_list("text").alias("__x"))
    rows = rows.select("doc_id", "repo", "dl", F.sort_array(F.flatten(F.transform("__x", tokens))).alias("__t")).where(F.size("__t") > 0)
    first = lambda i: (i == 0) | (F.get("__t", i) != F.get("__t", i - 1))
    rows = rows.withColumn("__at", F.filter(F.sequence(F.lit(0), F.size("__t") - 1), first))
    upto = lambda i: F.coalesce(F.get("__at", i + 1), F.size("__t"))
    runs = F.transform("__at", lambda p, i: F.struct(F.get("__t", p).alias("term"), (upto(i) - p).cast("long").alias("tf")))
    return rows.select("doc_id", "repo", "dl", F.inline(runs))


def intent_key(question: Column, repo: Column) -> Column:
    """Cache key of a question in a repository."""
    return F.concat(F.lit("query_intent:"), F.sha2(F.concat(strip(F.lower(question)), F.lit("|"), repo), 256))


def last_segment(c: Column, separator: str = ":") -> Column:
    return F.substring_index(c, separator, -1)


def glob_regex(glob: str, keep_slash: bool = False) -> str:
    """Anchored Java regex of a shell glob; with ``keep_slash`` a star stays within one path part."""
    any_char = "[^/]" if keep_slash else "."
    out = []
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(f"{any_char}*")
        elif c == "?":
            out.append(any_char)
        elif c == "[" and "]" in glob[i + 2:]:
            end = glob.index("]", i + 2)
            body = glob[i + 1:end]
            body = "^" + body[1:] if body[0] in "!^" else body
            out.append(f"[{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def matches_any(c: Column, globs: list[str], keep_slash: bool = False) -> Column:
    matched = F.lit(False)
    for glob in globs:
        matched = matched | c.rlike(glob_regex(glob, keep_slash))
    return matched


def language_of(path: Column) -> Column:
    """Source language by extension, null when unsupported."""
    suffix = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    return (
        F.when(suffix == ".py", "python")
        .when(suffix == ".go", "go")
        .when(suffix.isin(".ts", ".tsx"), "typescript")
    )


def job_language(path: Column) -> Column:
    return F.when(path.endswith(".go"), "go").otherwise("python")


def window_hours(window: Column) -> Column:
    """Hours of a window such as ``7d`` or ``24h``; anything else counts as 24."""
    text = strip(F.lower(window))
    amount = F.regexp_extract(text, r"^(\d+)[dh]$", 1)
    return (
        F.when((amount != "") & text.endswith("d"), amount.try_cast("int") * 24)
        .when((amount != "") & text.endswith("h"), amount.try_cast("int"))
        .otherwise(24)
    )


def entrypoint_kind(name: Column) -> Column:
    return F.when(name.startswith("Test"), "test").otherwise("function")

"""Quality rules judged by host: failure rates with an empirical beta prior, joined back to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.llm.common import SPACES, WORD, counted_broadcast, unused, words, written

SYMBOLS = r"[^#*$%&|<>]+"
LEAST_WORDS = 50
REPEAT_PERCENT = 50
#: A host goes when the shrunken failure rate of any rule is above this.
HOST_RATE = 0.5


def document_rules() -> dict[str, Column]:
    """Rules over the measures of one document; true is a failure. The first two make a base failure."""
    return {
        "short": F.col("n_words") < LEAST_WORDS,
        "repetitive": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
    }


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the text.

    A line counts when it has a word. A word is repeated when it lies in a window of three words found
    twice or more, the first included. Windows are sorted by (hash, place), so equal ones are
    neighbours and a document costs n log n. Null and empty texts measure 0.
    """
    w, h, s, p, t = (unused(docs, n) for n in ("_words", "_windows", "_sorted", "_places", "_text"))
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(w, words(F.col(t)))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(WORD))
    df = df.select(
        *docs.columns,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"CASE WHEN size({w}) < 4 THEN array() ELSE transform(sequence(0, size({w}) - 3), "
            f"i -> xxhash64({w}[i], {w}[i + 1], {w}[i + 2])) END"
        ).alias(h),
    )
    places = f"sort_array(arrays_zip({h}, sequence(0, size({h}) - 1)))"
    some = f"size({h}) > 0 AND size(array_distinct({h})) < size({h})"
    df = df.withColumn(s, F.expr(f"CASE WHEN {some} THEN {places} ELSE array() END")).drop(h)
    equal = f"(i > 0 AND {s}[i - 1].`{h}` = x.`{h}`) OR (i < size({s}) - 1 AND {s}[i + 1].`{h}` = x.`{h}`)"
    df = df.withColumn(p, F.expr(f"sort_array(transform(filter({s}, (x, i) -> {equal}), x -> x.`1`))")).drop(s)
    covered = f"aggregate({p}, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last)).n"
    return df.withColumn("n_repeat_words", F.expr(covered)).drop(p)


def beta_prior(rates: DataFrame, rules: list[str]) -> DataFrame:
    """One row with (alpha, beta) of every rule, by the method of moments over the hosts' rates.

    The spread between hosts, less what their sizes explain, says how much one host tells about
    another. Without any spread the prior is as strong as the largest host; it is never weaker than
    one document.
    """
    columns = []
    for r in rules:
        mean = (F.sum(f"f_{r}") + 0.5) / (F.sum("n") + 1.0)
        rate = F.col(f"f_{r}") / F.col("n")
        spread = F.sum(F.col("n") * rate * rate) / F.sum("n") - (F.sum(f"f_{r}") / F.sum("n")) ** 2
        noise = mean * (1 - mean) * F.count("*") / F.sum("n")
        between = F.greatest(spread - noise, F.lit(0.0))
        strength = F.when(between > 0, mean * (1 - mean) / between - 1).otherwise(F.max("n"))
        strength = F.greatest(F.lit(1.0), F.least(strength, F.max("n").cast("double")))
        columns += [(mean * strength).alias(f"alpha_{r}"), ((1 - mean) * strength).alias(f"beta_{r}")]
    return rates.agg(*columns)


def host_verdicts(measured: DataFrame, host: str) -> DataFrame:
    """host, n, shrunken failure rate of every rule, host_kept. A null host is a host of its own."""
    rules = document_rules()
    counts = written(
        measured.groupBy(F.col(host).alias("host")).agg(
            F.count("*").alias("n"), *[F.count_if(rule).alias(f"f_{name}") for name, rule in rules.items()]
        )
    )
    prior = beta_prior(counts, list(rules))
    rows = counts.crossJoin(F.broadcast(prior))  # the prior is one row
    rates = {
        r: (F.col(f"f_{r}") + F.col(f"alpha_{r}")) / (F.col("n") + F.col(f"alpha_{r}") + F.col(f"beta_{r}")) for r in rules
    }
    rows = rows.select("host", "n", *[c.alias(f"rate_{r}") for r, c in rates.items()])
    return rows.withColumn("host_kept", F.greatest(*[F.col(f"rate_{r}") for r in rules]) <= HOST_RATE)


def judge(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` without its text, with the measures, base_failed, the host's failure rates and kept.

    A document stays when it passes the base rules and its host's shrunken rates are all within
    HOST_RATE. Repeated rows are judged alike; an empty table gives no rows; columns of ``docs`` named
    like a result are replaced.
    """
    results = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    plain = docs.drop(*[c for c in results if c not in (host, text)])
    measured = written(measures(plain, text).drop(text))
    rules = document_rules()
    measured = measured.withColumn("base_failed", rules["short"] | rules["repetitive"])
    verdicts = counted_broadcast(written(host_verdicts(measured, host)).withColumnsRenamed({"host": "_host", "n": "n_host"}))
    rows = measured.join(verdicts, measured[host].eqNullSafe(F.col("_host")), "left").drop("_host")
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)))

"""Validation and freezing of a set of evaluation queries, and differences between tables cell by cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import text as texts
from seekgrain.operators.containment import contained_texts
from seekgrain.operators.lifecycle import formula_like

# The tags of a query, and those of which exactly one says whether it has an answer.
TAGS = (
    "answerable", "no_answer", "direct", "technology", "acronym_heavy", "cross_language_expected", "mixed_script",
    "filter_constrained",
)
ANSWERABILITY = ("answerable", "no_answer")
MIXED_LANGUAGE, MIXED_TAG = "mixed", "mixed_script"


def tags_of(value: Column) -> Column:
    """Distinct, non-empty tags of a ``|``-separated list."""
    listed = F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda tag: texts.strip(tag))
    return F.array_distinct(F.filter(listed, lambda tag: tag != ""))


def bad_tags(tags: Column, language: Column) -> Column:
    """Unknown tags, not exactly one answerability tag, or a mixed language without its tag."""
    unknown = F.size(F.array_except(tags, F.array(*map(F.lit, TAGS)))) > 0
    exclusive = F.size(F.array_intersect(tags, F.array(*map(F.lit, ANSWERABILITY)))) == 1
    untold = (language == MIXED_LANGUAGE) & ~F.array_contains(tags, MIXED_TAG)
    return unknown | ~exclusive | F.coalesce(untold, F.lit(False))


def says_yes(value: Column) -> Column:
    return F.upper(texts.strip(F.coalesce(value, F.lit("")))) == "YES"


def query_set_checks(
    queries: DataFrame, corpus: DataFrame, text_id: str, text: str, languages: Sequence[str], expected_rows: int, id_prefix: str
) -> DataFrame:
    """(check_name, n_issues) of ``queries(query_id, query_text, language, query_type, approved, not_derived, notes)``.

    ``corpus`` has texts that no query may copy, in search form, whole or, from 80 signs on, in part. Ids must
    be ``id_prefix`` with a three-digit number, each number from 1 to ``expected_rows`` once. Any issue fails the set.
    """
    rows = queries.withColumn("_form", texts.fold(F.coalesce("query_text", F.lit(""))))
    free = [c for c in ("query_id", "query_text", "language", "query_type", "approved", "not_derived", "notes") if c in queries.columns]
    tests = {
        "unsupported_language": ~F.coalesce(F.col("language").isin(*languages), F.lit(False)),
        "empty_text": texts.strip(F.coalesce("query_text", F.lit(""))) == "",
        "invalid_tags": bad_tags(tags_of(F.col("query_type")), F.col("language")),
        "not_approved": ~(says_yes(F.col("approved")) & says_yes(F.col("not_derived"))),
        "formula_content": F.greatest(*[F.coalesce(formula_like(F.col(c).cast("string")), F.lit(False)) for c in free]),
    }
    one = rows.agg(
        F.abs(F.count("*") - expected_rows).alias("row_count"), *[F.count_if(test).alias(name) for name, test in tests.items()]
    )
    table = one.unpivot([], ["row_count", *tests], "check_name", "n_issues")

    def counted(name: str, found: DataFrame) -> DataFrame:
        return found.agg(F.lit(name).alias("check_name"), F.count("*").alias("n_issues"))

    wanted = queries.sparkSession.range(1, expected_rows + 1).select(F.format_string(f"{id_prefix}%03d", "id").alias("query_id"))
    given = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    apart = wanted.join(given, "query_id", "full").filter(F.col("n").isNull() | ~F.col("query_id").startswith(id_prefix))
    strange = given.join(wanted, "query_id", "left_anti")
    same = rows.filter("_form <> ''").groupBy("_form").agg(F.count("*").alias("n")).filter("n > 1")
    copies = contained_texts(rows.filter("_form <> ''"), "query_id", "_form", corpus.withColumn("_form", texts.fold(text)), text_id, "_form")
    return (
        table.unionByName(counted("missing_id", apart.join(strange, "query_id", "left_anti")))
        .unionByName(counted("unexpected_id", strange))
        .unionByName(counted("duplicate_id", given.filter("n > 1")))
        .unionByName(same.agg(F.lit("duplicate_text").alias("check_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_issues")))
        .unionByName(counted("direct_copy", copies.select("needle_id").distinct()))
    )


def canonical_row(columns: Sequence[str]) -> Column:
    """A row as JSON with its columns in the order of their names; nulls are kept."""
    return F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def table_digest(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (n_rows, digest): the same for the same rows in any order and partitioning, repeats counted.

    Every row's SHA-256 is read as four numbers; their sums over all rows, with the count, are hashed again, so
    the rows are combined in parts and never sorted or gathered.
    """
    hashed = rows.select(F.sha2(canonical_row(columns or rows.columns), 256).alias("h"))
    parts = [F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = hashed.agg(F.count("*").alias("n_rows"), *[F.coalesce(F.sum(p), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k, p in enumerate(parts)])
    joined = F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)])
    return sums.select("n_rows", F.sha2(joined, 256).alias("digest"))


def changed_cells(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """(key, column_name, old_value, new_value, change) where two tables differ, cell by cell.

    Rows of one side only are ``removed`` or ``added`` cells. Numbers within ``tolerance`` are equal, and so is a
    new text that only has an apostrophe before a sign that would start a formula. Two nulls are equal. Cells
    are shuffled by row and column, so a table of any width is compared in one join. Keys are expected once.
    """

    def cells(table: DataFrame, name: str) -> DataFrame:
        listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias(name)) for c in columns])
        return table.select(F.col(key).alias("key"), F.inline(listed), F.lit(True).alias(f"has_{name}"))

    both = cells(before, "old_value").join(cells(after, "new_value"), ["key", "column_name"], "full")
    old, new = F.col("old_value"), F.col("new_value")
    near = F.abs(old.try_cast("double") - new.try_cast("double")) <= tolerance
    escaped = (new == F.concat(F.lit("'"), old)) & old.rlike("^[-+@=]")
    same = old.eqNullSafe(new) | F.coalesce(near, F.lit(False)) | F.coalesce(escaped, F.lit(False))
    change = (
        F.when(F.col("has_old_value").isNull(), "added").when(F.col("has_new_value").isNull(), "removed").when(~same, "changed")
    )
    found = both.select("key", "column_name", "old_value", "new_value", change.alias("change")).filter("change IS NOT NULL")
    return found.withColumnRenamed("key", key)

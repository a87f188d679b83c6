"""Activity clauses of a description, and how much of them other texts take up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekgrain.functions import text as tx

# Words that open an activity, ends after which a clause goes on, words that do not
# tell clauses apart, and the lengths and shares of the rules.
ACTIONS = (
    "préparation", "formalisation", "appui", "élaboration", "elaboration", "organisation", "cadrage",
    "initialisation", "diagnostic", "proposition", "déclinaison", "definition", "définition",
    r"mise\s+en\s+place", "réalisation", "realisation", "gestion", "pilotage", "coaching", "formation",
    "reporting", "animation", "benchmark(?:ing)?",
)
UNFINISHED = ("et", r"appui\s+à\s+la")
JOINING = ("et", r"à\s+la")
COMMON = (
    "accompagnement assistance projet projets mise place avec dans des les pour une aux ainsi que sur"
).split()
CLAUSE_CHARS, JOINED_CHARS, CLAUSES = 260, 360, 6
TOKENS, TOKEN_SHARE, CLAUSE_SHARE = 2, 0.20, 0.5


def _ends_in(text: Column, words: Sequence[str]) -> Column:
    return F.regexp_like(text, F.lit(rf"(?iU)\b(?:{'|'.join(words)})$"))


def _pieces(text: Column, actions: Sequence[str]) -> Column:
    """Parts between bullets and semicolons and before activity words, tidied; blank parts are dropped."""
    cut = rf"(?iU)\s*[•▪·]\s*|\s*;\s*|\s+(?=(?:{'|'.join(actions)})\b)"
    parts = F.filter(F.transform(F.split(text, cut), lambda p: tx.strip(p)), lambda p: p != "")
    return F.transform(parts, lambda p: tx.strip(F.left(p, F.lit(CLAUSE_CHARS)), "[ \\-:;]"))


def _whole_clauses(pieces: Column, unfinished: Sequence[str]) -> Column:
    """A piece of one word, or with an unfinished end, opens the next; at the end it closes the last."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def take(state: Column, clause: Column) -> Column:
        goes_on = ~F.regexp_like(clause, F.lit(r"\S\s+\S")) | _ends_in(clause, unfinished)
        return F.when(goes_on, F.struct(state["done"].alias("done"), clause.alias("open"))).otherwise(
            F.struct(F.array_append(state["done"], clause).alias("done"), F.lit("").alias("open"))
        )

    def step(state: Column, piece: Column) -> Column:
        return tx.bind(tx.strip(F.concat_ws(" ", state["open"], piece)), lambda clause: take(state, clause))

    def close(state: Column) -> Column:
        done, rest = state["done"], state["open"]
        last = tx.strip(F.concat_ws(" ", F.element_at(done, -1), rest))
        return (
            F.when(rest == "", done)
            .when(F.size(done) == 0, F.array(rest))
            .otherwise(F.array_append(F.slice(done, 1, F.size(done) - 1), last))
        )

    return F.array_distinct(F.aggregate(pieces, start, step, close))


def _fewer(clauses: Column, limit: int, joining: Sequence[str]) -> Column:
    """Join the shortest neighbours, the first of equals, until ``limit`` clauses are left."""

    def join_at(kept: Column, at: Column) -> Column:
        left, right = F.get(kept, at - 1), F.get(kept, at)
        pair = F.concat(left, F.when(_ends_in(left, joining), " ").otherwise("; "), right)
        return F.concat(
            F.slice(kept, F.lit(1), at - 1),
            F.array(F.left(pair, F.lit(JOINED_CHARS))),
            F.slice(kept, at + 2, F.size(kept)),
        )

    def shortest(kept: Column) -> Column:
        sizes = F.transform(
            F.sequence(F.lit(1), F.size(kept) - 1),
            lambda i: F.struct((F.length(F.get(kept, i - 1)) + F.length(F.get(kept, i))).alias("n"), i.alias("at")),
        )
        return F.array_min(sizes)["at"]

    def step(kept: Column, _: Column) -> Column:
        return tx.bind(shortest(kept), lambda at: join_at(kept, at))

    return F.when(F.size(clauses) <= limit, clauses).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.size(clauses) - limit), clauses, step)
    )


def activity_clauses(
    text: Column | str,
    actions: Sequence[str] = ACTIONS,
    unfinished: Sequence[str] = UNFINISHED,
    joining: Sequence[str] = JOINING,
    limit: int = CLAUSES,
) -> Column:
    """At most ``limit`` clauses of a description of plain text (see ``documents.sanitize_html``).

    ``actions``, ``unfinished`` and ``joining`` are patterns. Null and blank texts have none. Repeated
    clauses count once. The limit joins clauses and loses none, but a clause is cut at 260
    characters and a joined one at 360.
    """
    return tx.bind(
        _whole_clauses(_pieces(F.coalesce(tx._col(text), F.lit("")), actions), unfinished),
        lambda found: _fewer(found, limit, joining),
    )


def clause_tokens(text: Column) -> Column:
    """Distinct folded words of three or more characters that tell clauses apart."""
    found = F.regexp_extract_all(tx.fold(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.filter(F.array_distinct(found), lambda w: ~w.isin(*COMMON))


def clause_coverage(clauses: Column, texts: Column) -> Column:
    """``n_clauses`` with two or more telling words, ``n_covered`` of them of which one text holds a fifth
    of the words, and ``sufficient``: half of them are covered, or there are none. Null arrays are empty."""
    none = F.array().cast("array<string>")
    needed = F.filter(F.transform(F.coalesce(clauses, none), clause_tokens), lambda words: F.size(words) >= TOKENS)

    def count(needed: Column, held: Column) -> Column:
        covered = F.filter(
            needed,
            lambda words: F.exists(
                held, lambda text: F.size(F.array_intersect(words, text)) / F.size(words) >= TOKEN_SHARE
            ),
        )
        return F.struct(
            F.size(needed).alias("n_clauses"),
            F.size(covered).alias("n_covered"),
            ((F.size(needed) == 0) | (F.size(covered) >= CLAUSE_SHARE * F.size(needed))).alias("sufficient"),
        )

    return tx.bind(needed, lambda n: tx.bind(F.transform(F.coalesce(texts, none), clause_tokens), lambda h: count(n, h)))

"""Grounding of generated text: supports, field plans, claim rules and target language."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekgrain.functions import text as tx
from seekgrain.functions import vocabulary as vocab
from seekgrain.operators.ranking import top_k

# ---- Fixed values: source types, field policies, claim patterns and words ------------------------
FACT, CATALOG = "FACT", "STRUCTURED_METADATA"
COMPLETED, ATTESTED = "COMPLETED_WORK_EVIDENCE", "CLIENT_ATTESTATION"
PROPOSAL, CONTRACT, UNVERIFIED = "PROPOSAL_SCOPE", "CONTRACTUAL_SCOPE", "UNVERIFIED_METADATA"
CHALLENGE_PATTERN = (
    r"(?iu)(?<![\p{L}\p{N}_])(?:challenge|problem|issue|risk|constraint|enjeu|défi|problème|risque|contrainte|"
    r"تحد|مشكلة|مخاطر)"
)
OUTCOME_PATTERN = (
    r"(?iu)(?<![\p{L}\p{N}_])(?:benefit|outcome|result|gain|improv|reduc|increas|bénéf|résultat|amélior|réduct|"
    r"augment|فائدة|نتيجة|تحسين|خفض|زيادة)"
)


@dataclass(frozen=True)
class FieldPolicy:
    preferred: tuple[str, ...]
    most: int
    facts: tuple[str, ...] = ()
    pattern: str | None = None
    #: Source field whose absence leaves this one empty.
    source: str | None = None


FIELD_POLICIES = {
    "headline": FieldPolicy((FACT, COMPLETED, CATALOG), 2, ("mission_title", "client")),
    "short_description": FieldPolicy((FACT, COMPLETED, CATALOG), 3, ("mission_title", "client")),
    "challenge": FieldPolicy((CONTRACT, PROPOSAL, CATALOG), 1, pattern=CHALLENGE_PATTERN, source="challenge"),
    "contribution": FieldPolicy((COMPLETED, ATTESTED, CONTRACT, CATALOG), 1),
    "realisations": FieldPolicy((COMPLETED, ATTESTED), 1, source="completed_work_details"),
    "benefits": FieldPolicy((COMPLETED, ATTESTED), 1, pattern=OUTCOME_PATTERN, source="benefits"),
    "why_relevant": FieldPolicy((FACT, CATALOG, COMPLETED), 2, ("mission_title", "offering", "sector")),
}
NUMBER_PATTERN = r"(?<![\p{L}\p{N}_])\p{Nd}+(?:[.,]\p{Nd}+)?(?:[\t-\r\x1c-\x20\x85\p{Z}]*%)?"
LEAK_PATTERNS = {
    "INTERNAL_PATH": r"(?i)(?:\b[A-Za-z]:[\\/]|\\\\[^\s\\]+[\\/]|/(?:Users|home|root|tmp|var|opt)/)",
    "RETRIEVAL_SCORE": (
        r"(?i)\b(?:bm25|rrf|dense(?:\s+(?:score|similarity))?|cosine(?:\s+similarity)?|retrieval\s+score|"
        r"hybrid\s+score|embedding\s+score)\b"
    ),
    "INTERNAL_CHUNK_ID": r"(?i)\bchunk(?:[_ -]?id)?\b|\b[0-9a-f]{64}\b",
}
SENSITIVE_PATTERNS = {
    "UNSUPPORTED_ROI": r"(?iU)\b(?:roi|return on investment|retour sur investissement)\b",
    "UNSUPPORTED_FINANCIAL_OUTCOME": (
        r"(?iU)\b(?:cost savings?|financial gains?|revenue increase|profit increase|économies?|gains? financiers?|"
        r"augmentation (?:du chiffre d['’]affaires|des revenus|des bénéfices)|وفورات|أرباح|زيادة الإيرادات)\b"
    ),
    "UNSUPPORTED_AWARD": r"(?iU)\b(?:award(?:ed)?|prize|trophée|distinction|récompense|جائزة|تكريم)\b",
    "UNSUPPORTED_CERTIFICATION": (
        r"(?iU)\b(?:ISO\s*\d{4,5}(?::\d{4})?|PMP|ITIL|certif(?:ied|ication|ié|iée|iés|iées)|معتمد|شهادة)\b"
    ),
    "UNSUPPORTED_SUCCESS_CLAIM": r"(?iU)\b(?:successfully|avec succès|réussi(?:e|es|s)?|réussite|بنجاح)\b",
    "UNSUPPORTED_CLIENT_OUTCOME": (
        r"(?iU)\b(?:the client (?:achieved|obtained|reduced|increased|improved)|enabled the client to|resulted in|"
        r"le client a (?:obtenu|réduit|augmenté|amélioré)|a permis au client de|نتج عن|مكّن العميل من)\b"
    ),
}
SUPERLATIVE_PATTERN = (
    r"(?iU)\b(?:extensive experience|market leader|leading provider|hundreds of projects|dozens of projects|"
    r"unrivalled experience|unmatched experience|vaste exp[ée]rience|leader du march[ée]|des centaines de projets|"
    r"des dizaines de projets|خبرة واسعة|رائد السوق|مئات المشاريع)\b"
)
COMPLETION_PATTERN = (
    r"(?iU)\b(?:completed|implemented|delivered|deployed|achieved|produced|executed|performed|resulted|reduced|"
    r"increased|improved|realised|realized|réalis(?:é|ée|és|ées)|mis(?:e)?\s+en\s+(?:œuvre|oeuvre|place)|"
    r"livr(?:é|ée|és|ées)|déploy(?:é|ée|és|ées)|exécut(?:é|ée|és|ées)|achev(?:é|ée|és|ées)|"
    r"تم\s+(?:تنفيذ|إنجاز|تسليم))\b"
)
NAME_WORD = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’.-]"
#: One or more further words, the last one cut where a word ends. Repeats are possessive, as Java takes a stack frame for
#: every turn of one that can be given back, and a heading may run on for thousands of words.
MORE_NAME_WORDS = (
    rf"(?:\s+{NAME_WORD}++(?=(?:\s+(?!{NAME_WORD}+\b){NAME_WORD}++)*+\s+{NAME_WORD}+\b))*+\s+{NAME_WORD}+\b"
)
NAME_PATTERN = rf"(?U)\b{NAME_WORD}++{MORE_NAME_WORDS}"
PERSON_PATTERN = rf"(?iU)\b(?:Mr|Mrs|Ms|Mme|Mlle|Dr|Prof|Pr)\.?\s+{NAME_WORD}++{MORE_NAME_WORDS}"
EXPANSION_PATTERN = (
    r"(?U)\b((?:[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'’.-]*\s+){1,6}[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ'’.-]*)\s*"
    r"\(([A-Z]{2,8})\)"
)
CAUTIOUS_BENEFIT_PATTERN = (
    r"(?iU)^\s*(?:renforcement|am[ée]lioration|structuration|meilleure\s+visibilit[ée]|clarification|"
    r"s[ée]curisation|mise\s+[àa]\s+disposition|strengthening|structuring|improved\s+ability|greater\s+ability|"
    r"improved\s+visibility|greater\s+visibility|better\s+preparedness|enhanced\s+preparedness|securing|"
    r"availability|تعزيز|هيكلة|تحسين\s+الرؤية|توضيح|تأمين|إتاحة|قدرة\s+أفضل|تحسين\s+القدرة|رفع\s+الجاهزية)\b"
)
#: Words of which every match of a pattern holds at least one; of words of HINT_LENGTH and more only the beginning.
HINT_LENGTH = 5
JOINING_SIGNS = r"[[\p{S}\p{No}％﹪]&&[^\x00-\x7F]]"
HINTS = {
    COMPLETION_PATTERN: (
        "completed implemented delivered deployed achieved produced executed performed resulted reduced increased improved "
        "realised realized réalis place œuvre oeuvre livré déploy exécut achev تم"
    ),
    LEAK_PATTERNS["RETRIEVAL_SCORE"]: "bm25 rrf dense cosine retrieval hybrid embedding",
    SENSITIVE_PATTERNS["UNSUPPORTED_ROI"]: "roi investment investissement",
    SENSITIVE_PATTERNS["UNSUPPORTED_FINANCIAL_OUTCOME"]: (
        "saving financial revenue profit économie financier augmentation وفورات أرباح زيادة"
    ),
    SENSITIVE_PATTERNS["UNSUPPORTED_AWARD"]: "award prize trophée distinction récompense جائزة تكريم",
    SENSITIVE_PATTERNS["UNSUPPORTED_CERTIFICATION"]: "iso iso0 iso1 iso2 iso3 iso4 iso5 iso6 iso7 iso8 iso9 pmp itil certif معتمد شهادة",
    SENSITIVE_PATTERNS["UNSUPPORTED_SUCCESS_CLAIM"]: "successfully succès réussi بنجاح",
    SENSITIVE_PATTERNS["UNSUPPORTED_CLIENT_OUTCOME"]: "client resulted نتج العميل",
}
PATH_HINTS = "users home root tmp var opt"
CHUNK_LENGTH = 64
PERSON_HINTS = "mr mrs ms mme mlle dr prof pr"
EXPANSION_HINT = r"\([A-Z]{2,8}\)"
CLAIM_STOPWORDS = (
    "about after also avec avoir client dans elle elles from have having leur leurs mission pour project projet "
    "reference référence that their this through using with work completed delivered implemented performed réalisé "
    "réalisée réalisés mise place oeuvre œuvre"
).split()
MORE_TECHNOLOGIES = {
    "AWS": ("aws", "amazon web services"),
    "Azure": ("azure", "microsoft azure"),
    "Google Cloud": ("google cloud", "gcp"),
    "Kubernetes": ("kubernetes",),
    "Docker": ("docker",),
    "Oracle": ("oracle",),
    "Salesforce": ("salesforce",),
    "ServiceNow": ("servicenow",),
    "Power BI": ("power bi",),
    "Tableau": ("tableau",),
    "Python": ("python",),
    "Java": ("java",),
}
CLAIM_COUNTRIES = {
    "Tunisie": ("tunisie", "tunisia"),
    "France": ("france",),
    "Maroc": ("maroc", "morocco"),
    "Algérie": ("algérie", "algerie", "algeria"),
    "Côte d'Ivoire": ("côte d'ivoire", "cote d ivoire", "ivory coast"),
    "Sénégal": ("sénégal", "senegal"),
    "Arabie saoudite": ("arabie saoudite", "saudi arabia", "ksa"),
    "Rwanda": ("rwanda",),
    "Mali": ("mali",),
    "Niger": ("niger",),
    "Togo": ("togo",),
    "Bénin": ("bénin", "benin"),
    "Cameroun": ("cameroun", "cameroon"),
    "Mauritanie": ("mauritanie", "mauritania"),
    "Libye": ("libye", "libya"),
    "Burkina Faso": ("burkina faso",),
    "Canada": ("canada",),
    "Germany": ("germany", "allemagne"),
    "United Kingdom": ("united kingdom", "royaume uni", "uk"),
    "United States": ("united states", "etats unis", "usa"),
    "United Arab Emirates": ("united arab emirates", "emirats arabes unis", "uae"),
    "Qatar": ("qatar",),
    "Egypt": ("egypt", "egypte"),
}
# ---- end of fixed values --------------------------------------------------------------------------


# ---- text helpers --------------------------------------------------------------------------------
def phrase_form(text: Column) -> Column:
    """Folded text where everything but letters, digits, _ and % is one space, with outer spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(tx.fold(text), r"[^\p{L}\p{N}_%]+", " ")), F.lit(" "))


def numbers(text: Column) -> Column:
    """Distinct numbers; ``12,5 %`` becomes ``12.5%``."""
    found = F.regexp_extract_all(text, F.lit(r"(?=\p{Nd})" + NUMBER_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(F.replace(n, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))))


def brief(text: Column) -> Column:
    """The distinct pieces between blanks, in order: the same words in phrase form, each folded once."""
    return F.array_join(F.array_distinct(F.split(text, " ")), " ")


def phrase_words(text: Column) -> Column:
    """The distinct words of the phrase form."""
    return F.array_distinct(F.split(F.trim(phrase_form(brief(text))), " "))


def claim_tokens(text: Column) -> Column:
    return F.array_distinct(
        F.filter(
            phrase_words(text),
            lambda w: (F.length(w) >= 4) & ~w.isin(*CLAIM_STOPWORDS) & ~F.regexp_like(w, F.lit(r"^\p{Nd}+$")),
        )
    )


def overlap_share(claim: Column, source: Column) -> Column:
    return F.size(F.array_intersect(claim, source)) / F.greatest(F.size(claim), F.lit(1))


def number_code(number: Column) -> Column:
    plain = F.regexp_replace(number, "%+$", "")
    year = F.regexp_like(plain, F.lit(r"^\p{Nd}{4}$")) & plain.try_cast("int").between(1900, 2099)
    return (
        F.when(F.endswith(number, F.lit("%")), "UNSUPPORTED_PERCENTAGE")
        .when(year, "UNSUPPORTED_YEAR")
        .otherwise("UNSUPPORTED_NUMBER")
    )


def support_types(document_type: Column) -> Column:
    kind = F.regexp_replace(F.lower(F.coalesce(document_type, F.lit(""))), "[- ]", "_")

    def names(*markers: str) -> Column:
        return F.regexp_like(kind, F.lit("|".join(markers)))

    return (
        F.when(names("attestation", "completion", "certificate"), F.array(F.lit(ATTESTED), F.lit(COMPLETED)))
        .when(names("contract", "contrat"), F.array(F.lit(CONTRACT)))
        .when(names("proposal", "technical_offer", "offre_technique", "tender"), F.array(F.lit(PROPOSAL)))
        .otherwise(F.array(F.lit(UNVERIFIED)))
    )


# ---- plans ------------------------------------------------------------------------------------------
def field_plan(supports: DataFrame, unavailable: DataFrame | None = None) -> DataFrame:
    """(reference_id, field, position, support_id): facts first, then records by type preference.

    ``supports`` has reference_id, support_id, support_types, text and fact_field (null for
    records). Each support is matched to the field policies by itself; nothing is paired.
    ``unavailable`` has (reference_id, source_field): what a reference does not tell stays empty.
    """
    entries = []
    for name, policy in FIELD_POLICIES.items():
        types = F.array(*[F.lit(p) for p in policy.preferred])
        best = F.array_min(F.transform(F.array_intersect("support_types", types), lambda s: F.array_position(types, s)))
        usable = best.isNotNull() & ~F.array_contains("support_types", FACT)
        if policy.pattern:
            usable = usable & F.regexp_like("text", F.lit(policy.pattern))
        order = F.when(usable, best + 100)
        if policy.facts:
            facts = F.array(*[F.lit(f) for f in policy.facts])
            order = F.when(F.array_position(facts, F.col("fact_field")) > 0, F.array_position(facts, F.col("fact_field"))).otherwise(order)
        entries.append(
            F.struct(F.lit(name).alias("field"), order.cast("int").alias("order"), F.lit(policy.most).alias("most"))
        )
    matched = supports.select("reference_id", "support_id", F.explode(F.array(*entries)).alias("e")).select(
        "reference_id", "support_id", "e.*"
    )
    if unavailable is not None:
        sources = {p.source: name for name, p in FIELD_POLICIES.items() if p.source}
        named = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair])
        empty = unavailable.select("reference_id", F.try_element_at(named, F.col("source_field")).alias("field"))
        matched = matched.join(empty.distinct(), ["reference_id", "field"], "left_anti")
    most = max(policy.most for policy in FIELD_POLICIES.values())
    ranked = top_k(
        matched.filter(F.col("order").isNotNull()),
        ["reference_id", "field"],
        [F.col("order"), F.col("support_id")],
        most,
        "position",
    )
    return ranked.filter(F.col("position") <= F.col("most")).select("reference_id", "field", "position", "support_id")


def evidence_order(records: DataFrame, catalog_words: DataFrame) -> DataFrame:
    """Strength (attested or completed) and overlap with the catalog words of each record."""
    strong = F.array_contains("support_types", COMPLETED) | F.array_contains("support_types", ATTESTED)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zA-ZÀ-ÖØ-öø-ÿ]{4,}"), F.lit(0)))
    return records.join(catalog_words, "reference_id", "left").select(
        "reference_id",
        "support_id",
        F.when(strong, 1).otherwise(0).alias("strong"),
        F.size(F.array_intersect(words, F.coalesce("catalog_words", F.array().cast("array<string>")))).alias("overlap"),
    )


def richness(n_activities: Column, n_supports: Column, characters: Column) -> Column:
    return (
        F.when((n_activities >= 3) | (n_supports >= 4) | (characters >= 650), "RICH")
        .when((n_activities >= 2) | (n_supports >= 2) | (characters >= 240), "MEDIUM")
        .otherwise("SPARSE")
    )


# ---- claims -----------------------------------------------------------------------------------------
def resolve_supports(claims: DataFrame, supports: DataFrame, selected: DataFrame) -> DataFrame:
    """Claims with what their ids point to: texts, types and id problems."""
    cited = claims.select("claim_id", F.col("reference_id").alias("claim_reference"), F.posexplode("support_ids").alias("n", "support_id"))
    chosen = selected.select("reference_id").distinct().withColumn("_chosen", F.lit(True))
    known = supports.select("support_id", "reference_id", "support_types", F.col("text").alias("support")).join(
        chosen, "reference_id", "left"
    )
    joined = cited.join(known, "support_id", "left")
    found = F.col("reference_id").isNotNull()
    issue = F.when(~found, "UNKNOWN_SUPPORT_ID")
    gathered = joined.groupBy("claim_id").agg(
        F.array_sort(F.collect_list(F.when(found, F.struct("n", "support", "support_types")))).alias("records"),
        F.array_sort(F.collect_set(F.when(issue.isNotNull(), F.struct(issue.alias("code"), F.col("support_id").alias("id"))))).alias("unknown"),
        F.array_sort(
            F.collect_set(
                F.when(found & F.col("_chosen").isNull(), F.struct(F.lit("UNSELECTED_REFERENCE_SUPPORT").alias("code"), F.col("support_id").alias("id")))
            )
        ).alias("unselected"),
        F.array_sort(
            F.collect_set(
                F.when(
                    found & (F.col("claim_reference") != F.col("reference_id")),
                    F.struct(F.lit("WRONG_REFERENCE_SUPPORT").alias("code"), F.col("support_id").alias("id")),
                )
            )
        ).alias("wrong"),
    )
    return claims.join(gathered, "claim_id", "left").withColumns(
        {
            "support_text": F.coalesce(F.array_join(F.transform("records", lambda r: r["support"]), " "), F.lit("")),
            "types": F.coalesce(
                F.array_distinct(F.flatten(F.transform("records", lambda r: r["support_types"]))), F.array().cast("array<string>")
            ),
            "completed_text": F.coalesce(
                F.array_join(
                    F.transform(
                        F.filter("records", lambda r: F.array_contains(r["support_types"], COMPLETED)), lambda r: r["support"]
                    ),
                    " ",
                ),
                F.lit(""),
            ),
            "id_issues": F.coalesce(F.concat("unknown", "unselected", "wrong"), F.array().cast("array<struct<code:string,id:string>>")),
        }
    ).drop("records", "unknown", "unselected", "wrong")


def _invented(groups: Iterable[Sequence[str]], words: Column, said: Column, allowed: Column) -> Column:
    """Some group of equivalent names is mentioned although none of its names is allowed.

    ``words`` are the words of ``said``; it is only searched where they hold the first word of a name.
    """

    def folded(name: str) -> str:
        kept = "".join(c if c.isalnum() or c in "_%" else " " for c in vocab.fold_word(name))
        return " " + " ".join(kept.split()) + " "

    names = [[folded(n) for n in group] for group in groups]
    first = F.array(*[F.lit(w) for w in sorted({n.split()[0] for group in names for n in group})])
    table = F.from_json(F.lit(json.dumps(names)), "array<array<string>>")
    return F.arrays_overlap(words, first) & tx.bind(
        F.struct(said.alias("said"), allowed.alias("allowed")),
        lambda t: F.exists(
            table,
            lambda names: F.exists(names, lambda n: F.contains(t["said"], n))
            & ~F.exists(names, lambda n: F.contains(t["allowed"], n)),
        ),
    )


def _unbacked(matches: Column, padded: Column) -> Column:
    """Some matched wording does not occur in the backing text."""
    return (F.size(matches) > 0) & tx.bind(padded, lambda p: F.exists(matches, lambda m: ~F.contains(p, phrase_form(m))))


def _strange(matches: Column, words: Column) -> Column:
    """Some word of the matches is not among ``words``, so that some match cannot occur there."""
    return F.size(F.array_except(F.split(F.trim(phrase_form(F.array_join(matches, " "))), " "), words)) > 0


def _any(text: Column, needles: Iterable[str]) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | F.contains(text, F.lit(needle))
    return test


def _spoken(words: Column) -> Column:
    """Words and their beginnings, among which hints are looked for; a pattern without case takes the dotless letter for an i."""
    plain = F.transform(words, lambda w: F.replace(w, F.lit("ı"), F.lit("i")))
    return tx.bind(
        plain,
        lambda p: F.array_union(
            F.array_union(p, F.transform(p, lambda w: F.left(w, F.lit(HINT_LENGTH)))), F.transform(p, lambda w: F.left(w, F.lit(4)))
        ),
    )


def _hinted(said: Column, hints: Iterable[str]) -> Column:
    """Some word is a hint, or begins as a long one."""
    return F.arrays_overlap(said, F.array(*[F.lit(vocab.fold_word(hint)[:HINT_LENGTH]) for hint in hints]))


def _all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def hinted_matches(text: Column, pattern: str, hint: Column) -> Column:
    """All matches; only texts with the hint are searched."""
    return F.when(hint, _all_matches(text, pattern)).otherwise(F.array().cast("array<string>"))


def validate_claims(claims: DataFrame, supports: DataFrame, selected: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_id, code, severity, detail) of every rule a claim breaks, once per code.

    claims: claim_id, reference_id (null for the section), field_path, text, support_ids and
    planned_ids (null without a plan). facts: reference_id, fact_text. A section claim may use the
    facts of the references whose records it cites. A number that is not backed counts once per
    code and claim; ``detail`` shows the smallest.
    """
    rows = resolve_supports(claims, supports, selected).join(claim_facts(claims, supports, facts), "claim_id", "left")
    text = F.col("text")
    rows = rows.withColumns(
        {
            "_filled": F.coalesce(F.regexp_like(text, F.lit(f"[^{tx.SPACE[1:-1]}]")), F.lit(False)),
            "_words": phrase_words(text),
            "_numbers": numbers(text),
            "_named": _all_matches(text, NAME_PATTERN),
        }
    )
    words, said = F.col("_words"), F.col("_said")
    rows = rows.withColumns({"_said": _spoken(words), "_ascii": tx.is_ascii(text)})
    # Signs whose search form has letters, digits or % join what a pattern takes for two words.
    joined = F.contains(text, F.lit("%")) | (~F.col("_ascii") & F.regexp_like(text, F.lit(JOINING_SIGNS)))
    rows = rows.withColumn("_joined", joined)
    # Built where a rule asks for them: few claims come that far.
    support = phrase_form(F.col("support_text"))
    backing = F.concat_ws(" ", "support_text", F.coalesce("fact_text", F.lit("")))
    allowed = phrase_form(backing)
    filled = F.col("_filled")
    none = F.lit(None).cast("string")

    def rule(code: str, test: Column, severity: str = "BLOCKING") -> Column:
        return F.when(filled & test, _finding(F.lit(code), severity, none))

    planned = F.col("planned_ids")
    has_types = F.size("types") > 0
    done = F.array_contains("types", COMPLETED)
    promised = F.array_contains("types", PROPOSAL) | F.array_contains("types", CONTRACT)
    says_done = ~F.endswith("field_path", F.lit(".headline")) & (F.col("_joined") | _hinted(said, HINTS[COMPLETION_PATTERN].split())) & F.regexp_like("text", F.lit(COMPLETION_PATTERN))
    new_numbers = F.size(F.array_except("_numbers", numbers(F.col("completed_text")))) > 0
    tokens = claim_tokens(text)
    unlike = tx.bind(
        overlap_share(tokens, claim_tokens(F.col("support_text"))),
        lambda covered: (covered < 0.4) & ~(F.regexp_like("text", F.lit(CAUTIOUS_BENEFIT_PATTERN)) & (covered >= 0.25)),
    )
    technologies = [(label, *names) for label, names in vocab.TECHNOLOGY_LABELS]
    technologies += [(label, *names) for label, names in MORE_TECHNOLOGIES.items()]
    invented = _invented(technologies, words, phrase_form(text), allowed)
    country = _invented(CLAIM_COUNTRIES.values(), words, phrase_form(text), allowed)
    persons = hinted_matches(text, PERSON_PATTERN, F.col("_joined") | _hinted(said, PERSON_HINTS.split()))
    named = F.array_union(F.col("_named"), persons)
    foreign = tx.bind(named, lambda n: (F.size(n) > 0) & (_strange(n, phrase_words(backing)) | _unbacked(n, allowed)))
    expansions = F.zip_with(
        F.regexp_extract_all("text", F.lit(EXPANSION_PATTERN), F.lit(1)),
        F.regexp_extract_all("text", F.lit(EXPANSION_PATTERN), F.lit(2)),
        lambda long, short: F.contains(support, phrase_form(long)) & F.contains(support, phrase_form(short)),
    )
    expanded = F.regexp_like("text", F.lit(EXPANSION_HINT)) & F.exists(expansions, lambda ok: ~ok)

    hints = {pattern: F.col("_joined") | _hinted(said, held.split()) for pattern, held in HINTS.items()}
    hints[LEAK_PATTERNS["INTERNAL_PATH"]] = _any(text, (":/", ":\\", "\\\\")) | _hinted(said, PATH_HINTS.split())
    hints[LEAK_PATTERNS["INTERNAL_CHUNK_ID"]] = _hinted(said, ["chunk"]) | F.exists(words, lambda w: F.length(w) >= CHUNK_LENGTH)
    for code in ("RETRIEVAL_SCORE", "INTERNAL_CHUNK_ID"):
        # These patterns end words at every letter beyond ASCII.
        hints[LEAK_PATTERNS[code]] = ~F.col("_ascii") | F.col("_joined") | hints[LEAK_PATTERNS[code]]

    def unproved(pattern: str) -> Column:
        return tx.bind(hinted_matches(text, pattern, hints[pattern]), lambda found: _unbacked(found, support))

    rules = [
        F.when(~filled & (F.size("support_ids") > 0), _finding(F.lit("EMPTY_TEXT_WITH_SUPPORT"), "BLOCKING", none)),
        rule("MISSING_SUPPORT", F.size("support_ids") == 0),
        rule("EMPTY_SUPPORT_PLAN_VIOLATION", F.coalesce(F.size(planned) == 0, F.lit(False)) & planned.isNotNull()),
        rule("PROVENANCE_PLAN_MISMATCH", planned.isNotNull() & (F.size(planned) > 0) & (planned != F.col("support_ids"))),
        *[rule(code, hints[p] & F.regexp_like("text", F.lit(p))) for code, p in LEAK_PATTERNS.items()],
        rule("UNSUPPORTED_COUNTRY", country),
        rule("FABRICATED_TECHNOLOGY", invented),
        rule("UNSUPPORTED_NAMED_ENTITY", foreign),
        rule("UNSUPPORTED_ACRONYM_EXPANSION", expanded),
        rule("PROPOSAL_SCOPE_AS_COMPLETED", says_done & ~done & promised),
        rule("UNSUPPORTED_COMPLETION_LANGUAGE", says_done & ~done & ~promised),
        rule(
            "COMPLETION_DETAIL_NOT_ATTESTED",
            says_done & done & ((overlap_share(tokens, claim_tokens(F.col("completed_text"))) < 0.5) | new_numbers),
        ),
        rule("UNSUPPORTED_BENEFIT", F.contains("field_path", F.lit(".benefits[")) & unlike),
        *[rule(code, unproved(p)) for code, p in SENSITIVE_PATTERNS.items()],
        rule(
            "UNSUPPORTED_PORTFOLIO_SUPERLATIVE",
            F.col("reference_id").isNull() & _unbacked(_all_matches(text, SUPERLATIVE_PATTERN), support),
        ),
        rule("WEAK_SOURCE_SUPPORT", has_types & ~done & ~F.array_contains("types", ATTESTED), "WARNING"),
    ]
    loose = F.array_sort(F.array_except("_numbers", numbers(F.col("support_text"))))
    per_number = tx.bind(
        F.transform(F.when(filled & (F.size("_numbers") > 0), loose), lambda n: _finding(number_code(n), "BLOCKING", n)),
        lambda each: F.filter(each, lambda f, i: F.array_position(F.transform(each, lambda g: g["code"]), f["code"]) == i + 1),
    )
    per_id = F.transform(F.when(filled, F.col("id_issues")), lambda i: _finding(i["code"], "BLOCKING", i["id"]))
    empty = F.array().cast("array<struct<code:string,severity:string,detail:string>>")
    findings = F.concat(F.array_compact(F.array(*rules)), F.coalesce(per_number, empty), F.coalesce(per_id, empty))
    return rows.select("claim_id", "reference_id", "field_path", F.explode(F.array_distinct(findings)).alias("f")).select(
        "claim_id", "reference_id", "field_path", "f.*"
    )


def _finding(code: Column, severity: str, detail: Column) -> Column:
    return F.struct(code.alias("code"), F.lit(severity).alias("severity"), detail.alias("detail"))


def claim_facts(claims: DataFrame, supports: DataFrame, facts: DataFrame) -> DataFrame:
    """(claim_id, fact_text): the facts of a claim's reference, or of all references it cites."""
    own = claims.filter(F.col("reference_id").isNotNull()).select("claim_id", "reference_id")
    cited = claims.filter(F.col("reference_id").isNull()).select("claim_id", F.explode("support_ids").alias("support_id"))
    cited = cited.join(supports.select("support_id", "reference_id"), "support_id").select("claim_id", "reference_id")
    told = own.unionByName(cited.distinct()).join(facts.select("reference_id", "fact_text"), "reference_id")
    return told.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("fact_text")), " ").alias("fact_text"))


def unknown_facts(
    claims: DataFrame, known: DataFrame, facts: DataFrame, values: str = "value", backing: DataFrame | None = None
) -> DataFrame:
    """Known catalog values (field, value) that a claim names although its own facts do not.

    ``backing`` (claim_id, support_text) allows what the cited records say.
    A claim is cut into word sequences of the lengths the known values have, and sequences meet
    values by equality, so no claim is ever paired with a value it does not contain.
    """
    shaped = known.select("field", values, tx.strip(phrase_form(F.col(values))).alias("phrase")).filter("length(phrase) >= 4")
    shaped = shaped.withColumn("n_words", F.size(F.split("phrase", " ")))
    lengths = F.lit(shaped.agg(F.sort_array(F.collect_set("n_words")).alias("n")).scalar())
    words = F.split(F.trim(phrase_form(F.col("text"))), " ")
    cut = claims.select("claim_id", "reference_id", words.alias("words")).withColumn("n", F.explode(lengths))
    spoken = (
        cut.filter(F.size("words") >= F.col("n"))
        .select(
            "claim_id",
            "reference_id",
            F.explode(
                F.array_distinct(
                    F.transform(
                        F.sequence(F.lit(1), F.size("words") - F.col("n") + 1),
                        lambda i: F.array_join(F.slice("words", i, F.col("n")), " "),
                    )
                )
            ).alias("phrase"),
        )
    )
    hit = spoken.join(shaped, "phrase")
    allowed = facts.select("reference_id", phrase_form(F.col("fact_text")).alias("allowed"))
    padded = F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))
    if backing is not None:
        said = backing.select("claim_id", phrase_form(F.col("support_text")).alias("said"))
        hit = hit.join(said, "claim_id", "left").filter(~F.contains(F.coalesce("said", F.lit("")), padded)).drop("said")
    name = F.when(F.col("field") == "project_year", "YEAR").otherwise(F.upper("field"))
    return (
        hit.join(allowed, "reference_id", "left")
        .filter(~F.contains(F.coalesce("allowed", F.lit("")), padded))
        .select("claim_id", "reference_id", F.concat(F.lit("UNSUPPORTED_"), name).alias("code"), F.col(values).alias("detail"))
        .distinct()
    )


def reference_set_findings(generated: DataFrame, selected: DataFrame) -> DataFrame:
    """Unselected, missing, repeated and reordered references of a draft.

    Both tables have draft_id, reference_id and position.
    """
    got = generated.groupBy("draft_id", "reference_id").agg(F.count("*").alias("n"), F.min("position").alias("at"))
    asked = selected.select("draft_id", "reference_id", F.col("position").alias("wanted"))
    both = got.join(asked, ["draft_id", "reference_id"], "full")
    codes = F.array_compact(
        F.array(
            F.when(F.col("wanted").isNull(), "UNSELECTED_REFERENCE"),
            F.when(F.col("at").isNull(), "MISSING_SELECTED_REFERENCE"),
            F.when(F.col("n") > 1, "DUPLICATE_REFERENCE"),
            F.when(F.col("at") != F.col("wanted"), "REFERENCE_ORDER_CHANGED"),
        )
    )
    flagged = both.select("draft_id", "reference_id", F.explode(codes).alias("code"))
    counted = flagged.groupBy("draft_id", "code").agg(
        F.count("*").alias("n_references"), F.min("reference_id").alias("first_reference")
    )
    changed = counted.filter(F.col("code").isin("UNSELECTED_REFERENCE", "MISSING_SELECTED_REFERENCE")).select("draft_id").distinct()
    order = counted.filter(F.col("code") == "REFERENCE_ORDER_CHANGED").join(changed, "draft_id", "left_anti")
    return counted.filter(F.col("code") != "REFERENCE_ORDER_CHANGED").unionByName(order)


def severity_counts(findings: DataFrame, key: str) -> DataFrame:
    """Findings per severity, zero filled; an unknown severity counts as blocking."""
    known = F.when(F.col("severity").isin("WARNING", "INFO"), F.col("severity")).otherwise("BLOCKING")
    return findings.groupBy(key).agg(
        *[F.count_if(known == s).alias(s.lower()) for s in ("BLOCKING", "WARNING", "INFO")]
    ).withColumn("export_eligible", F.col("blocking") == 0)

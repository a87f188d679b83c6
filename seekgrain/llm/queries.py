"""Registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekgrain.llm import (
    exact_dedup, host_rules, jaccard_join, language_id, licenses, mixing, piece_scan, pii, quality, sharding,
    substring_dedup, token_alignment, whitening,
)
from seekgrain.llm.common import held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = lambda spark, folder: function(spark, folder.rstrip("/"))
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


HOST_RULES_SQL = f"""WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
  listed AS (SELECT doc_id, source, t, regexp_extract_all(t, '{WORD}') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM texts),
  windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM listed),
  grams AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM windows),
  often AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
  covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
  m AS (SELECT l.doc_id, l.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM listed l LEFT JOIN covered c USING (doc_id)),
  r AS (SELECT *, n_words < 50 AS r1, 100 * n_repeat_words > 50 * n_words AS r2, 10 * n_symbols > n_words AS r3,
    100 * n_dup_lines > 30 * n_lines AS r4, word_chars < 2 * n_words OR word_chars > 12 * n_words AS r5 FROM m),
  h AS (SELECT source, count(*) AS n, unnest([1, 2, 3, 4, 5]) AS rule,
    unnest([count_if(r1), count_if(r2), count_if(r3), count_if(r4), count_if(r5)]) AS f FROM r GROUP BY source),
  p AS (SELECT rule, (sum(f) + 0.5) / (sum(n) + 1.0) AS mean, max(n) AS top,
    sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) ** 2 AS spread, count(*) / sum(n) AS per FROM h GROUP BY rule),
  q AS (SELECT rule, mean, greatest(1.0, least(top::DOUBLE, CASE WHEN spread - mean * (1 - mean) * per > 0
    THEN mean * (1 - mean) / (spread - mean * (1 - mean) * per) - 1 ELSE top END)) AS strength FROM p),
  v AS (SELECT source, max((f + mean * strength) / (n + strength)) <= 0.5 AS host_kept
    FROM h JOIN q USING (rule) GROUP BY source)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed,
    NOT (r1 OR r2) AND host_kept AS kept FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source"""


@query("op5_host_rules", HOST_RULES_SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    judged = host_rules.judge(documents(spark, folder).select("doc_id", "source", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _apportioned(parties: str, group: str, key: str, vote: str, seats: str) -> str:
    """SQL of ``mixing.apportion`` over the CTE ``parties``."""
    part = f"PARTITION BY {group}" if group else ""
    return f"""SELECT {group + ', ' if group else ''}{key}, any_value(sure) + sum(won) AS won FROM (
      SELECT *, CASE WHEN {vote} > 0 AND row_number() OVER ({part} ORDER BY {vote} / (2 * k + 1) DESC, {key} NULLS LAST, k)
        <= seats_left THEN 1 ELSE 0 END AS won FROM (
        SELECT *, unnest(range(sure, fair + 4)) AS k FROM (
          SELECT *, {seats} - sum(sure) OVER ({part}) AS seats_left FROM (
            SELECT *, greatest(fair - 3, 0) AS sure FROM (
              SELECT *, coalesce(floor({vote} * {seats} / nullif(sum({vote}) OVER ({part}), 0) + 0.5), 0)::BIGINT AS fair
              FROM {parties})))))
    GROUP BY {group + ', ' if group else ''}{key}"""


MIX_SQL = f"""WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    coalesce(md5(text), '-') AS text_hash FROM documents),
  placed AS (SELECT * EXCLUDE (text_hash), md5('0:' || coalesce(doc_id::VARCHAR, '-') || ':' || size::VARCHAR || ':' || text_hash) AS place
    FROM sizes),
  src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM sizes GROUP BY source),
  weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    2 * source_size AS cap FROM src),
  levels AS (SELECT *, (sum(source_size) OVER () * 150 / 100 - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
  goals AS (SELECT source, source_size, n_rows, least(cap::DOUBLE, water * weight) AS target FROM (
    SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS water FROM levels)),
  blocked AS (SELECT *, greatest(1, least(1024, floor(sum(source_size) OVER () / 100000)))::BIGINT AS block FROM goals),
  numbered AS (SELECT *, floor(sum(target) OVER () / block + 0.5)::BIGINT AS blocks FROM blocked),
  quotas AS ({_apportioned('numbered', '', 'source', 'target', 'blocks')}),
  due AS (SELECT n.*, q.won * block AS due FROM numbered n JOIN quotas q ON n.source IS NOT DISTINCT FROM q.source),
  passed AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(due / source_size)) ELSE 0 END::BIGINT AS passes FROM due),
  ready AS (SELECT source, source_size, target, block, passes,
    floor(CASE WHEN passes < 2 THEN due - passes * source_size ELSE 0 END / block + 0.5)::BIGINT AS rest_blocks,
    ceil(greatest(source_size / 4194304, n_rows / 20000, 1))::BIGINT AS shards FROM passed),
  spread AS (SELECT p.*, r.* EXCLUDE (source), ('0x' || substr(place, 1, 8))::BIGINT % shards AS shard
    FROM placed p JOIN ready r ON p.source IS NOT DISTINCT FROM r.source),
  walked AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop FROM spread),
  parts AS (SELECT source, rest_blocks, block, shard, sum(size)::BIGINT AS shard_size FROM spread GROUP BY ALL),
  shares AS ({_apportioned('parts', 'source, rest_blocks', 'shard', 'shard_size', 'rest_blocks')}),
  runs AS (SELECT p.*, s.won AS shard_blocks,
    ('0x' || substr(md5('0:' || coalesce(p.source, '-') || ':' || p.shard::VARCHAR), 1, 8))::BIGINT
      % greatest(ceil(shard_size / block), 1)::BIGINT * block AS low
    FROM parts p JOIN shares s ON p.source IS NOT DISTINCT FROM s.source AND p.shard = s.shard),
  chosen AS (SELECT w.*, r.low, least(low + shard_blocks * r.block, low + shard_size) AS high, shard_size
    FROM walked w JOIN runs r ON w.source IS NOT DISTINCT FROM r.source AND w.shard = r.shard)
  SELECT doc_id, size, source_size, target, (passes * size + least(size,
    greatest(0, least(stop, high) - greatest(stop - size, low))
    + greatest(0, least(stop, high - shard_size) - greatest(stop - size, 0))))::BIGINT AS taken FROM chosen"""


@query("op6_mix_sources", MIX_SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, folder).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_pii")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(documents(spark, folder).select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id",
        *[
            pii.count_of(F.col("pii"), kind).alias(f"n_{kind}")
            for kind in pii.BASE
        ],
        F.sha2(pii.span_list(F.col("pii"), pii.BASE), 256).alias("base_sha256"),
        pii.span_list(F.col("pii")).alias("spans"),
        F.coalesce(F.array_min(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("least_score"),
    )


@query("op8_uniform_shards")
def _(spark: SparkSession, folder: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, folder).select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    placed = sharding.shuffle_into_shards(rows, ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(
    "op10_exact_dedup",
    f"""SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
    sha256(t) AS text_sha256 FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS t FROM documents)
    WINDOW g AS (PARTITION BY t)""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_dedup.kept_rows(exact_dedup.equal_texts(documents(spark, folder).select("doc_id", "text")))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op2_language_id")
def _(spark: SparkSession, folder: str) -> DataFrame:
    model = language_id.fit(documents(spark, folder).select("doc_id", "lang", "text"))
    texts = documents(spark, folder).select("doc_id", "text", held_out().alias("held_out"))
    told = language_id.with_language(texts, model)
    return told.select("doc_id", "held_out", "lang_pred", "score", "second", "ambiguous")


@query("op4_quality")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    trees = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = quality.with_score(docs.withColumn("held_out", held_out()), trees)
    return scored.select("doc_id", "held_out", "score", quality.predicted(F.col("score")).alias("predicted"))


@query("op9_jaccard_join")
def _(spark: SparkSession, folder: str) -> DataFrame:
    texts = documents(spark, folder).select("doc_id", "text")
    return jaccard_join.similar_components(texts, width=4, percent=85)


@query("op1_substring_dedup")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_passages(documents(spark, folder).select("doc_id", "text"))


@query("op3_piece_encoding")
def _(spark: SparkSession, folder: str) -> DataFrame:
    pieces = piece_scan.load_pieces(piece_scan.default_model(spark))
    texts = documents(spark, folder).select("doc_id", "text")
    coded = piece_scan.encode(texts, pieces, check="round_trip")
    return coded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "ids",
        "round_trip",
    )


@query("op11_embedding_whitening")
def _(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    shares = [float(v) for v in model.explained] if model else []
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened"))
    return rows.select(
        "vec_id",
        (F.col("pos") + 1).alias("component"),
        F.lit(model.centre.n if model else None).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        F.col("col").alias("whitened"),
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("pos")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )


def _licence_sql() -> str:
    """Plain search for every key phrase in the words of every text."""
    templates = licenses.TEMPLATES

    def places(phrase: str) -> str:
        words = phrase.split()
        same = " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words))
        return f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: {same})"

    listed = "[" + ", ".join(f"'{w}'" for w in licenses.vocabulary(templates)) + "]"
    columns, labels, marks = [], [], []
    for t, template in enumerate(templates):
        names = [f"t{t}_{p}" for p in range(len(template.phrases))]
        columns += [f"{places(phrase)} AS {name}" for name, (_, phrase) in zip(names, template.phrases)]
        if len(names) == 1:
            found, part = f"len({names[0]}) > 0", "0"
        else:
            buckets = [
                f"list_transform({name}, lambda s: floor((s - {position}) / {licenses.SLACK}.0)::BIGINT)"
                for name, (position, _) in zip(names, template.phrases)
            ]
            near = buckets[0]
            for b in buckets[1:]:
                near = f"list_intersect({near}, flatten(list_transform({b}, lambda b: [b - 1, b, b + 1])))"
            found = f"len({near}) > 0"
            sums = [
                f"list_sum(list_transform({phrase.split()}, lambda x: element_at(weights, x)[1]))" for _, phrase in template.phrases
            ]
            share = [f"CASE WHEN len({n}) > 0 THEN round(1e6 * {s} / ({' + '.join(sums)})) ELSE 0 END" for n, s in zip(names, sums)]
            part = f"floor(({' + '.join(share)}) / 2)"
        labels.append(f"CASE WHEN {found} THEN '{template.label}' END")
        marks.append(f"CASE WHEN {found} THEN 1000000 ELSE {part} END")
    base = [f"t{t}_0" for t in range(len(licenses.BASE))]
    all_base = " || ".join(base)

    def joined(some: list[str]) -> str:
        return f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(some)}], lambda l: l IS NOT NULL))), ','), '')"

    small = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH listed AS (SELECT doc_id,
      regexp_extract_all({small}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    counts AS (SELECT word, count(*) AS c FROM (
      SELECT unnest(list_distinct(list_filter(w, lambda x: list_contains({listed}, x)))) AS word FROM listed) GROUP BY word),
    weighed AS (SELECT map(list(v.word), list(round(ln(((SELECT count(*) FROM listed) + 1.0) / (coalesce(c, 0) + 1.0)) + 1, 6)))
      AS weights FROM (SELECT unnest({listed}) AS word) v LEFT JOIN counts USING (word)),
    found AS (SELECT doc_id, len(w) AS n, {', '.join(columns)}, weights FROM listed, weighed)
    SELECT doc_id, n::BIGINT AS n_words, len({all_base})::BIGINT AS n_base, list_min({all_base})::BIGINT AS first_word,
      list_max({all_base})::BIGINT AS last_word, {joined(labels[: len(licenses.BASE)])} AS base_labels,
      {joined(labels)} AS labels, greatest({', '.join(marks)})::DOUBLE / 1e6 AS score FROM found"""


@query("op12_license_scan", _licence_sql())
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    scanned = licenses.scan(docs, licenses.word_weights(docs)).drop("text")
    base = F.filter("licences.places", lambda s: s["template"] < len(licenses.BASE))
    labels = [F.lit(t.label) for t in licenses.BASE]
    scanned = scanned.withColumn("base", base)
    named = F.transform("base", lambda s: F.get(F.array(*labels), s["template"]))
    return scanned.select(
        "doc_id",
        "licences.n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join("licences.labels", ",").alias("labels"),
        "licences.score",
    )


@query("op13_token_alignment")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    found = token_alignment.align(docs, token_alignment.default_models(spark)).documents
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return found.select(F.col("payload.doc_id").alias("doc_id"), *names)

"""The operators as checked queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dasyspark.llm import (
    bottomk,
    brown_lm,
    gumbel_pieces,
    langid,
    licenses,
    outliers,
    packing,
    partenum,
    periodic_runs,
    resampling,
    suffix_dedup,
    tokens,
    toxicity,
    url_filter,
)
from dasyspark.llm.common import documents, fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def sql_fold(key: str, modulus: int) -> str:
    """crc32 of a key as text, modulo ``modulus``, bit by bit in SQL."""
    text = f"CAST({key} AS VARCHAR)"
    step = "xor(c, b & 255)"
    return (
        "(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length("
        f"{text})), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr({text}, (i // 8 + 1)::BIGINT, 1)) ELSE 0 END::BIGINT)), "
        f"lambda c, b: CASE WHEN {step} % 2 = 1 THEN xor({step} // 2, 3988292384) ELSE {step} // 2 END), "
        f"4294967295::BIGINT) % {modulus})"
    )


# ---------------------------------------------------------------- packing


@query("op6_sum_of_squares_packing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    # The ranks of byte_bpe_50k.json, in the form that encodes fastest.
    added = tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = tokens.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added)
    return packing.pack_documents(documents(spark, sf), encoder)


# ------------------------------------------------------------- url filter

RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
# Site names of the block list.
SITES = ("spam-farm", "cheap-pills", "adult-x", "casino-win", "free-bets", "ads-track")


def op8_sql() -> str:
    rule = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}:{v}'"
        for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ) + " END"
    return f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (SELECT *, {rule} AS hit FROM parts)
SELECT page_id, host, path, split_part(hit, ':', 1) AS rule,
  coalesce(split_part(hit, ':', 2),
    CASE WHEN regexp_matches(host, '(^|[.])({"|".join(SITES)})[.]') THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""


@query("op8_bloom_cascade", op8_sql())
def op8(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    listed = F.col("host").rlike(f"(^|[.])({'|'.join(SITES)})[.]")
    return url_filter.filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


# ------------------------------------------------------------ language id


def op10_sql() -> str:
    code = (
        "CASE length(g) WHEN 1 THEN unicode(g)::BIGINT "
        "WHEN 2 THEN unicode(g)::BIGINT * 2097152 + unicode(substr(g, 2, 1)) "
        "ELSE (unicode(g)::BIGINT * 2097152 + unicode(substr(g, 2, 1))) * 2097152 + unicode(substr(g, 3, 1)) END"
    )
    return f"""
WITH d AS (SELECT doc_id, text, lang, coalesce({sql_fold("doc_id", 5)}, -1) AS fold FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM d),
wc AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT doc_id, n, unnest(list_concat(
    list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)),
    list_transform(range(1, length(w) + 2), lambda i: substr(chr(1) || w || chr(1), i, 2)),
    list_transform(range(1, length(w) + 1), lambda i: substr(chr(1) || w || chr(1), i, 3)))) AS g FROM wc),
dc AS (SELECT doc_id, {code} AS code, sum(n) AS n FROM g GROUP BY ALL),
pc AS (SELECT lang, code, sum(n) AS n FROM dc JOIN d USING (doc_id) WHERE fold <> 0 AND lang IS NOT NULL GROUP BY ALL),
p AS (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS place FROM pc
  QUALIFY place < {langid.SIZE}),
own AS (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) - 1 AS place FROM dc
  QUALIFY place < {langid.SIZE}),
far AS (SELECT o.doc_id, l.lang,
    sum(CASE WHEN p.place IS NULL THEN {langid.SIZE} ELSE abs(p.place - o.place) END) AS far, count(*) AS m
  FROM own o CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.code = o.code GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) AS r FROM far QUALIFY r = 1)
SELECT d.doc_id, d.fold = 0 AS held_out, coalesce(b.lang, 'und') AS lang_pred,
  coalesce(1.0::DOUBLE - b.far::DOUBLE / ({langid.SIZE} * b.m)::DOUBLE, 0.0::DOUBLE) AS score
FROM d LEFT JOIN best b USING (doc_id)"""


@query("op10_rank_profiles", op10_sql())
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    profiles = langid.fit_profiles(docs.where("NOT held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), profiles).drop("text")


# --------------------------------------------------------------- toxicity


@query("op5_counterfactual_toxicity")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    model = toxicity.fit(docs.where("NOT held_out"), spark.read.parquet(f"{sf}/labels.parquet"))
    return toxicity.score(docs, model).drop("text")


# ------------------------------------------------------ n-gram Jaccard join

SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x20\\x09-\\x0D]+')"
)


def jaccard_sql(source: str, width: int, num: int, den: int) -> str:
    """Common table expressions ending in ``comp`` (doc_id, n_shingles, component_id)."""
    gram = " || ' ' || ".join(f"ws[i + {j}]" for j in range(width))
    return f"""
w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM {source}),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - {width} + 2), lambda i: {gram})) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
  AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
reach AS (SELECT a AS doc_id, a AS root FROM links UNION
  SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.doc_id),
comp AS (SELECT s.doc_id, len(sh) AS n_shingles, coalesce(min(root), s.doc_id) AS component_id
  FROM s LEFT JOIN reach USING (doc_id) GROUP BY s.doc_id, sh)"""


@query(
    "op4_partenum_jaccard",
    f"WITH RECURSIVE {jaccard_sql('documents', 3, 90, 100)} SELECT doc_id, n_shingles, component_id FROM comp",
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return partenum.jaccard_components(documents(spark, sf), width=3, num=90, den=100)


# ------------------------------------------------------ suffix-array dedup

# Windows as hex, so that each engine cuts at byte limits.
OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS h
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM d WHERE length(x) >= 200)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
e AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM r),
runs AS (SELECT doc_id, p, count(*) FILTER (WHERE gap IS NULL OR gap > 100) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM e),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run),
s AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS stop,
  string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM s JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head || substr(x, 2 * stop + 1), x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


@query("op2_suffix_array_dedup", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, sf, "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


# ---------------------------------------------------------- quality rules


@query("op1_robust_outliers")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.judge(documents(spark, sf))


# ------------------------------------------------------------ fingerprints


@query("op9_bottom_k")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    made = bottomk.fingerprints_with_edits(documents(spark, sf))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        bottomk.as_text(F.col("sketch")).alias("fingerprint"),
        bottomk.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
        bottomk.distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
        bottomk.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )


# ------------------------------------------------------------- LM scoring


@query("op3_brown_classes")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    model, counts = brown_lm.fit(docs.where("NOT held_out"))
    return brown_lm.score(docs, model, counts)


# ------------------------------------------------- sampled segmentations


@query("op7_gumbel_segmentations")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return gumbel_pieces.sample_segmentations(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


# ---------------------------------------------------- importance resampling

SQL_TERMS = SQL_WORDS.replace("[^\\x20\\x09-\\x0D]+", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def sql_crc32(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, four bits at a time from their hex digits."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    digits = (
        f"list_transform(range(0, length(hex(encode({text})))), lambda i: "
        f"instr('123456789ABCDEF', substr(hex(encode({text})), (i + 1 - 2 * (i % 2) + 1)::BIGINT, 1))::BIGINT)"
    )
    step = f"xor(c // 16, ({table}::BIGINT[])[xor(c, d) % 16 + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, d: {step}), 4294967295::BIGINT)"


OP11_SQL = f"""
WITH x AS (SELECT doc_id, {SQL_TERMS} AS ws FROM documents), y AS (SELECT {SQL_TERMS} AS ws FROM benchmark),
grams AS (SELECT doc_id, len(ws) AS n_words, list_concat(ws,
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS fs
  FROM (SELECT * FROM x UNION ALL SELECT NULL, ws FROM y)),
f AS (SELECT doc_id, unnest(fs) AS f FROM grams),
fc AS (SELECT doc_id, f, count(*) AS n FROM f GROUP BY ALL),
codes AS (SELECT f, {sql_crc32("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM fc)),
c AS (SELECT doc_id, b, sum(n) AS n FROM fc JOIN codes USING (f) GROUP BY ALL),
st AS (SELECT b, coalesce(sum(n) FILTER (WHERE doc_id IS NOT NULL), 0)::BIGINT AS s,
  coalesce(sum(n) FILTER (WHERE doc_id IS NULL), 0)::BIGINT AS t FROM c GROUP BY b),
gain AS (SELECT b, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM st)::BIGINT + 10000))::DOUBLE
  / ((s + 1) * ((SELECT sum(t) FROM st)::BIGINT + 10000))::DOUBLE))::BIGINT AS g FROM st),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM c JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT x.doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('42:' || x.doc_id), 1, 8))::BIGINT AS h FROM x LEFT JOIN weights USING (doc_id)),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM noisy WHERE n_words >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END::BIGINT AS rank
FROM noisy z LEFT JOIN ranked USING (doc_id)"""


@query("op11_importance_resampling", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    target = spark.read.parquet(f"{sf}/benchmark.parquet").select("text")
    return resampling.resample(documents(spark, sf, "doc_id", "text"), target, carry=["doc_id"]).drop("n_words")


# ---------------------------------------------------- periodic run detection

OP12_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    {sql_fold("doc_id", 2**32)} AS h FROM documents),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
p AS (SELECT *, 1 + (len(ws) - a) // (3 + (h // 10) % 8) AS p FROM a),
m AS (SELECT doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, len(ws)),
    lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) END AS ws FROM p),
u AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM m),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e),
t AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, g
  HAVING count(*) >= q AND count(*) + q >= {periodic_runs.LEAST}),
r AS (SELECT doc_id, start, length, min(q) AS period FROM t GROUP BY ALL),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
  arg_min({{'s': start, 'l': length, 'p': period}}, {{'n': -length, 's': start, 'p': period}}) AS best FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT m.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
  (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM m LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def with_planted_tail(docs: DataFrame) -> DataFrame:
    """Where crc32(doc_id) ends in 0, all words from a place on repeat the first ones of that tail; other texts stay."""
    h = fold(F.col("doc_id"), 2**32)
    planted = h % 10 == 0
    split = F.when(planted, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = docs.withColumns({"_words": split, "_g": F.floor(h / 10)})
    n = F.size("_words")
    a = (F.col("_g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    times = (F.floor((n - a) / p) + 1).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_words", a + 1, p), times))
    changed = F.array_join(F.slice(F.concat(F.slice("_words", F.lit(1), a), tail), F.lit(1), n), " ")
    return cut.withColumn("text", F.when(planted & (n > 0), changed).otherwise(F.col("text"))).drop("_words", "_g")


@query("op12_periodic_runs", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_tail(documents(spark, sf, "doc_id", "text")), carry=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    made = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return made.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.n div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )


# ------------------------------------------------------------ license scans


def op13_sql() -> str:
    rows = [*((*p, "true") for p in licenses.PHRASES), *((*n, "false") for n in licenses.NOTICES)]
    values = ", ".join(f"({i}, '{label}', '{text}', {base})" for i, (label, text, base) in enumerate(rows))
    return f"""
WITH given(template, label, text, base) AS (VALUES {values}),
kinds AS (SELECT template, label, base, {SQL_TERMS} AS ws FROM given),
g AS (SELECT template, len(ws) AS n, least(len(ws), {licenses.WIDTH}) AS k, unnest(list_transform(range(1, len(ws) - k + 2),
  lambda i: {{'at': i - 1, 'g': array_to_string(ws[i:i + k - 1], ' ')}})) AS x FROM kinds),
d AS (SELECT doc_id, {SQL_TERMS} AS ws FROM documents),
o AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) + 1), lambda i: {{'pos': i - 1, 'w': [ws[i],
  ws[i] || ' ' || ws[i + 1], ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]]}})) AS y FROM d),
v AS (SELECT doc_id, template, n, k, y.pos - x.at AS diagonal, list(DISTINCT x.at) AS ats
  FROM (SELECT doc_id, y, unnest(y.w) AS word FROM o) o JOIN g ON word = x.g GROUP BY ALL),
b AS (SELECT *, CASE WHEN {licenses.SLACK} * (diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal)) <= n
  THEN 0 ELSE 1 END AS new FROM v),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS part FROM b),
m AS (SELECT doc_id, template, n, len(list_distinct(flatten(list(flatten(list_transform(ats, lambda a: range(a, a + k))))))) AS covered,
  min(diagonal + list_min(ats)) AS start, max(diagonal + list_max(ats) + k) AS stop FROM c GROUP BY doc_id, template, n, part),
s AS (SELECT doc_id, label, base, start, covered / greatest(n, stop - start) AS cover FROM m JOIN kinds USING (template)
  WHERE cover >= {licenses.LEAST_COVER}),
t AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
  max(start) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM s GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN t USING (doc_id)"""


@query("op13_license_diagonals", op13_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf, "doc_id", "text"))
    base = F.filter("licenses", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])

    def shown(spans):
        return F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), shown(base).alias("base_labels"), shown(F.col("licenses")).alias("labels"), "score",
    )

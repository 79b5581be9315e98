"""Text and manifest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kikitori.functions import text as T
from kikitori.operators import manifest as M
from kikitori.plans.base import Book
from kikitori.plans.tables import table

book = Book()
queries, oracle_sql = book.queries, book.oracle_sql

WS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


DIGITS = "CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT)"

# rows of a source data set: text as stored, decoding and rates derived from the row
SOURCE = """
WITH src AS (SELECT row_id, coalesce(text, '') AS t, num_frames IS NOT NULL AS decodes, (CASE row_id % 3 WHEN 0 THEN 16000 WHEN 1 THEN 24000 ELSE 44100 END) AS rate,
  coalesce(num_frames, 0) AS samples FROM manifest),
norm AS (SELECT *, regexp_replace(regexp_replace(replace(t, chr(9), ''), '\\[n\\]', '', 'g'), '[　;▼♀♂《》≪≫①②③④⑤⑥]', '', 'g') AS u FROM src),
reasons AS (SELECT row_id, CASE WHEN <u> = '' THEN 'empty_text' WHEN NOT decodes THEN 'audio_decode' WHEN rate < 22050 THEN 'low_sample_rate'
  WHEN least(samples, CAST(trunc(0.00001 * rate) AS BIGINT)) = 0 THEN 'trimmed_empty' END AS skip_reason FROM norm)
""".replace("<u>", strip_sql("u"))


def source_rows(spark, d):
    m = table(spark, d, "manifest")
    rate = F.when(F.col("row_id") % 3 == 0, 16000).when(F.col("row_id") % 3 == 1, 24000).otherwise(44100)
    return m.select(
        "row_id",
        T.ustrip(T.before_brackets(T.coerce_text(F.col("text")))).alias("text"),
        F.col("num_frames").isNotNull().alias("decodes"),
        rate.alias("rate"),
        F.coalesce("num_frames", F.lit(0)).cast("bigint").alias("samples"),
    ).withColumn("skip_reason", M.skip_reason(F.col("text"), F.col("decodes"), F.col("rate"), F.col("samples"), 22050, 0.00001))


@book.query("skip_reason", SOURCE + "SELECT row_id, skip_reason FROM reasons")
def q_skip_reason(spark, d):
    return source_rows(spark, d).select("row_id", "skip_reason")


@book.query("skip_counts", SOURCE + "SELECT coalesce(skip_reason, 'unknown') AS reason, count(*) AS n FROM reasons GROUP BY 1")
def q_skip_counts(spark, d):
    return M.skip_counts(source_rows(spark, d))


@book.query(
    "skip_rollup",
    SOURCE
    + "SELECT count(*) FILTER (skip_reason = 'empty_text') AS empty, count(*) FILTER (skip_reason = 'missing_speaker') AS speaker, count(*) FILTER (skip_reason = 'low_sample_rate') AS low_sr, count(*) FILTER (skip_reason = 'max_samples_limit') AS max, count(*) FILTER (skip_reason IN ('audio_decode', 'trimmed_empty', 'prepare_error', 'encode_error', 'dataset_iter_error')) AS audio FROM reasons",
)
def q_skip_rollup(spark, d):
    return M.skip_rollup(source_rows(spark, d))


@book.query("coerce_text", "SELECT row_id, coalesce(array_to_string(list_transform(caption, lambda x: coalesce(x, 'None')), ' '), '') AS coerced FROM manifest")
def q_coerce(spark, d):
    return table(spark, d, "manifest").select("row_id", T.coerce_text(F.col("caption"), True).alias("coerced"))


@book.query("ustrip", f"SELECT row_id, {strip_sql('text')} AS stripped FROM manifest")
def q_ustrip(spark, d):
    return table(spark, d, "manifest").select("row_id", T.ustrip(F.col("text")).alias("stripped"))


@book.query("normalize_text")
def q_normalize(spark, d):
    return table(spark, d, "manifest").select("row_id", T.normalize_text(F.concat(F.lit("「"), F.coalesce("text", F.lit("")), F.lit("」"))).alias("normalized"))


@book.query("nfkc")
def q_nfkc(spark, d):
    return table(spark, d, "manifest").select("row_id", T.nfkc(F.col("text")).alias("composed"))


_PAIRS = ", ".join(f"('{o}', '{c}')" for o, c in T.BRACKETS.items())


@book.query(
    "strip_outer_brackets",
    f"""WITH RECURSIVE b(o, c) AS (VALUES {_PAIRS}), r AS (SELECT row_id, text AS t, 0 AS n FROM manifest UNION ALL
SELECT row_id, substr(t, 2, length(t) - 2), n + 1 FROM r JOIN b ON left(t, 1) = o AND right(t, 1) = c AND length(t) > 1
AND coalesce(list_bool_and(list_transform(range(1, length(t)), lambda i: length(replace(substr(t, 1, i), c, '')) > length(replace(substr(t, 1, i), o, '')))), true))
SELECT row_id, arg_max(t, n) AS peeled FROM r GROUP BY 1""",
)
def q_brackets(spark, d):
    return table(spark, d, "manifest").select("row_id", T.strip_outer_brackets(F.col("text")).alias("peeled"))


@book.query("sanitize_id")
def q_sanitize(spark, d):
    return table(spark, d, "manifest").select("row_id", T.sanitize_id(F.col("speaker_id"), "none").alias("component"))


@book.query("speaker_id")
def q_speaker(spark, d):
    return table(spark, d, "manifest").select("row_id", T.speaker_id("corpus", F.col("source"), F.col("audio_file")).alias("speaker_id"))


COUNTS = {"n_kana": T.KANA, "n_kanji": T.KANJI, "n_alnum": T.ALNUM, "n_emoji": T.emoji_pattern()}
_COUNT_SQL = ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS {n}" for n, p in COUNTS.items())


@book.query("text_counts", f"SELECT row_id, CAST(length(text) AS INTEGER) AS n_chars, {_COUNT_SQL} FROM manifest")
def q_counts(spark, d):
    return table(spark, d, "manifest").select("row_id", F.length("text").alias("n_chars"), *[F.regexp_count("text", F.lit(p)).alias(n) for n, p in COUNTS.items()])


_MARKS = {"n_period": "。.", "n_comma": "、,", "n_long": "ー", "n_ellipsis": "…", "n_exclaim": "！!", "n_question": "？?"}
_MARK_SQL = ", ".join(f"CAST(length(text) - length(translate(text, '{m}', '')) AS INTEGER) AS {n}" for n, m in _MARKS.items())


@book.query("punct_counts", f"SELECT row_id, {_MARK_SQL} FROM manifest")
def q_punct(spark, d):
    return table(spark, d, "manifest").select("row_id", *[T.count_of(F.col("text"), m).alias(n) for n, m in _MARKS.items()])


def _cap(x: str, cap: int) -> str:
    return f"ln(1 + least(greatest(CAST({x} AS DOUBLE), 0), {cap})) / ln(1 + {cap}.0)"


_N = "CAST(greatest(length(text), 1) AS DOUBLE)"
_TOK = "CAST(least(strlen(text) + 1, 256) AS DOUBLE)"
_FEATURES = ", ".join(
    [f"least({_TOK}, 256) / 256.0", _cap(_N, 512), f"{_TOK} / {_N}"]
    + [_cap(f"(length(text) - length(translate(text, '{m}', '')))", 16 if n == "n_comma" else 8) for n, m in _MARKS.items()]
    + [_cap(f"len(regexp_extract_all(text, '{COUNTS['n_emoji']}'))", 8)]
    + [f"len(regexp_extract_all(text, '{COUNTS[c]}')) / {_N}" for c in ("n_kana", "n_kanji", "n_alnum")]
    + ["CASE WHEN speaker_id IS NOT NULL THEN 1.0 ELSE 0.0 END"]
)
_FEATURE_SQL = f"SELECT row_id, list_transform([{_FEATURES}], lambda x: round(CAST(x AS DOUBLE), 9)) AS features FROM manifest WHERE text IS NOT NULL"


def _rounded(features):
    return F.transform(features, lambda x: F.round(x, 9))


@book.query("duration_features", _FEATURE_SQL)
def q_features(spark, d):
    tokens = F.least(F.octet_length("text") + 1, F.lit(256))
    m = table(spark, d, "manifest").where("text IS NOT NULL")
    return m.select("row_id", _rounded(T.duration_features(F.col("text"), tokens, 256, F.col("speaker_id").isNotNull())).alias("features"))


@book.query("set_has_speaker", _FEATURE_SQL.replace("CASE WHEN speaker_id IS NOT NULL THEN 1.0 ELSE 0.0 END", "CASE WHEN row_id % 2 = 0 THEN 1.0 ELSE 0.0 END"))
def q_set_speaker(spark, d):
    f = q_features(spark, d)
    return f.select("row_id", T.set_has_speaker(F.col("features"), F.col("row_id") % 2 == 0).alias("features"))


@book.query("byte_tokenize", "SELECT row_id, CAST(strlen(text) + 1 AS INTEGER) AS n_ids, 0 AS first_id FROM manifest WHERE text IS NOT NULL")
def q_bytes(spark, d):
    ids = T.byte_tokens(F.col("text"))
    return table(spark, d, "manifest").where("text IS NOT NULL").select("row_id", F.size(ids).alias("n_ids"), F.element_at(ids, 1).alias("first_id"))


@book.query("pad_truncate", "SELECT row_id, 64 AS width, CAST(least(strlen(text) + 1, 64) AS INTEGER) AS n_valid FROM manifest WHERE text IS NOT NULL")
def q_pad(spark, d):
    ids = T.byte_tokens(F.col("text"))
    return table(spark, d, "manifest").where("text IS NOT NULL").select(
        "row_id", F.size(T.pad_truncate(ids, 64)).alias("width"), F.size(F.filter(T.pad_mask(ids, 64), lambda x: x)).alias("n_valid")
    )


@book.query("adapter_name", "SELECT row_id, 'runtime_' || substr(sha1(latent_path), 1, 16) AS adapter FROM manifest")
def q_adapter(spark, d):
    return table(spark, d, "manifest").select("row_id", T.adapter_name(F.col("latent_path")).alias("adapter"))


@book.query(
    "parse_optional_float",
    """WITH s AS (SELECT row_id, translate(lower(regexp_replace(speaker_id, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), '０１２３４５６７８９', '0123456789') AS s FROM manifest)
SELECT row_id, CASE WHEN regexp_full_match(s, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?') THEN TRY_CAST(s AS DOUBLE) END AS v FROM s""",
)
def q_float(spark, d):
    return table(spark, d, "manifest").select("row_id", T.parse_optional_float(F.col("speaker_id")).alias("v"))


@book.query("resolve_path", "SELECT row_id, CASE WHEN starts_with(latent_path, '/') THEN latent_path ELSE '/data/manifest/' || latent_path END AS path FROM manifest")
def q_resolve(spark, d):
    p = F.col("latent_path")
    return table(spark, d, "manifest").select("row_id", F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/data/manifest/"), p)).alias("path"))


_CAND = f"list_filter(list_transform(coalesce(caption, []), lambda x: {strip_sql('x')}), lambda x: x IS NOT NULL AND x <> '')"


@book.query("caption_candidates", f"SELECT row_id, {_CAND} AS candidates, len({_CAND}) > 0 AS has_caption FROM manifest")
def q_candidates(spark, d):
    c = T.caption_candidates(F.col("caption"))
    return table(spark, d, "manifest").select("row_id", c.alias("candidates")).withColumn("has_caption", F.size("candidates") > 0)


@book.query("pick_caption", f"WITH c AS (SELECT row_id, {_CAND} AS c FROM manifest) SELECT row_id, CASE WHEN len(c) > 0 THEN c[1 + {DIGITS.format(seed=5, key='row_id')} % len(c)] ELSE '' END AS caption FROM c")
def q_pick(spark, d):
    c = table(spark, d, "manifest").select("row_id", T.caption_candidates(F.col("caption")).alias("c"))
    at = 1 + T.keyed_number(5, F.col("row_id"), F.greatest(F.size("c"), F.lit(1)))
    return c.select("row_id", F.when(F.size("c") > 0, F.element_at("c", at.cast("int"))).otherwise("").alias("caption"))


@book.query("num_frames", "SELECT row_id, least(coalesce(num_frames, length(text) * 10), least(length(text) * 10, 750)) AS n FROM manifest WHERE text IS NOT NULL")
def q_frames(spark, d):
    n = F.length("text") * 10
    return table(spark, d, "manifest").where("text IS NOT NULL").select("row_id", F.least(F.coalesce("num_frames", n), F.least(n, F.lit(750))).cast("bigint").alias("n"))


@book.query("latent_len_filter", "SELECT row_id FROM manifest WHERE num_frames BETWEEN 1 AND 750")
def q_latent_len(spark, d):
    return table(spark, d, "manifest").where(F.col("num_frames").between(1, 750)).select("row_id")


@book.query("min_text_filter", f"WITH n AS (SELECT transcript_id, s.text AS t, i FROM (SELECT transcript_id, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM transcripts)) SELECT transcript_id, CAST(i AS INTEGER) AS no FROM n WHERE length({strip_sql('t')}) >= 3")
def q_min_text(spark, d):
    t = table(spark, d, "transcripts").select("transcript_id", F.posexplode("segments").alias("i", "s"))
    return t.where(F.length(T.ustrip(F.col("s.text"))) >= 3).select("transcript_id", (F.col("i") + 1).alias("no"))


@book.query(
    "manifest_rows",
    f"SELECT row_id, {strip_sql('text')} AS text, latent_path, coalesce(num_frames, 0) AS num_frames, nullif({_CAND}, []) AS caption, speaker_id FROM manifest WHERE {strip_sql("coalesce(text, '')")} <> ''",
)
def q_rows(spark, d):
    m = table(spark, d, "manifest").withColumns({"text": T.ustrip(F.col("text")), "c": T.caption_candidates(F.col("caption"))})
    return m.where(F.coalesce("text", F.lit("")) != "").select(
        "row_id", "text", "latent_path", F.coalesce("num_frames", F.lit(0)).alias("num_frames"), F.when(F.size("c") > 0, F.col("c")).alias("caption"), "speaker_id"
    )


@book.query("rank_stride", "SELECT row_id % 4 AS rank, count(*) AS n FROM manifest WHERE row_id >= 7 GROUP BY 1")
def q_stride(spark, d):
    m = table(spark, d, "manifest").select(M.rank_stride(F.col("row_id"), 7, 4).alias("rank")).where("rank IS NOT NULL")
    return m.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    "rank_contiguous",
    "WITH t AS (SELECT max(row_id) + 1 AS total FROM manifest) SELECT CAST(floor((row_id - 7) / CAST(ceil((total - 7) / 4.0) AS BIGINT)) AS BIGINT) AS rank, count(*) AS n FROM manifest, t WHERE row_id >= 7 GROUP BY 1",
)
def q_contiguous(spark, d):
    m = table(spark, d, "manifest")
    total = m.agg(F.max("row_id")).first()[0] + 1
    return m.select(M.rank_contiguous(F.col("row_id"), 7, total, 4).alias("rank")).where("rank IS NOT NULL").groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    "max_samples",
    "WITH a AS (SELECT row_id, row_id % 4 AS rank, num_frames IS NOT NULL AS ok, sum(CASE WHEN num_frames IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY row_id % 4 ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM manifest) SELECT rank, count(*) AS seen, count(*) FILTER (ok) AS accepted FROM a WHERE coalesce(b, 0) < 500 GROUP BY 1",
)
def q_max_samples(spark, d):
    m = table(spark, d, "manifest").select("row_id", F.pmod("row_id", F.lit(4)).alias("rank"), F.col("num_frames").isNotNull().alias("ok"))
    return M.first_accepted(m, "rank", "row_id", F.col("ok"), 500).groupBy("rank").agg(F.count(F.lit(1)).alias("seen"), F.count_if("ok").alias("accepted"))


@book.query("skip_samples", "SELECT row_id FROM manifest WHERE row_id >= 100")
def q_skip(spark, d):
    return table(spark, d, "manifest").where("row_id >= 100").select("row_id")


_LABELS = f"SELECT count(*) AS n, count(speaker_id) AS with_speaker, count(*) FILTER (len({_CAND}) > 0) AS with_caption"


@book.query("labeled_counts", f"{_LABELS} FROM manifest")
def q_labels(spark, d):
    m = table(spark, d, "manifest")
    return m.agg(F.count(F.lit(1)).alias("n"), F.count("speaker_id").alias("with_speaker"), F.count_if(F.size(T.caption_candidates(F.col("caption"))) > 0).alias("with_caption"))


@book.query("label_coverage", f"WITH c AS ({_LABELS} FROM manifest) SELECT with_speaker < n AS lacks_speaker, with_caption < n AS lacks_caption FROM c")
def q_coverage(spark, d):
    return q_labels(spark, d).select((F.col("with_speaker") < F.col("n")).alias("lacks_speaker"), (F.col("with_caption") < F.col("n")).alias("lacks_caption"))


_LINE = """'{"text":' || CAST(to_json(text) AS VARCHAR) || ',"latent_path":' || CAST(to_json(latent_path) AS VARCHAR) || CASE WHEN num_frames IS NULL THEN '' ELSE ',"num_frames":' || num_frames END
|| CASE WHEN caption IS NULL THEN '' ELSE ',"caption":' || CAST(to_json(caption) AS VARCHAR) END || CASE WHEN speaker_id IS NULL THEN '' ELSE ',"speaker_id":' || CAST(to_json(speaker_id) AS VARCHAR) END || '}'"""


@book.query(
    "manifest_index",
    f"WITH l AS (SELECT row_id, speaker_id, len({_CAND}) > 0 AS has_caption, {_LINE} AS line FROM manifest WHERE text IS NOT NULL) SELECT row_id, speaker_id, has_caption, CAST(coalesce(sum(strlen(line) + 1) OVER (ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM l",
)
def q_index(spark, d):
    """Offsets of the JSON lines as the writer writes them, in order of row_id."""
    m = table(spark, d, "manifest").where("text IS NOT NULL")
    line = F.to_json(F.struct("text", "latent_path", "num_frames", "caption", "speaker_id"), {"ignoreNullFields": "true"})
    rows = m.select("row_id", "speaker_id", (F.size(T.caption_candidates(F.col("caption"))) > 0).alias("has_caption"), line.alias("line"))
    return M.line_offsets(rows, "row_id", F.col("line")).select("row_id", "speaker_id", "has_caption", "byte_offset")


@book.query("seek_read", "SELECT m.row_id, m.text FROM manifest m JOIN (SELECT DISTINCT row_id FROM review_labels) USING (row_id)")
def q_seek(spark, d):
    want = table(spark, d, "review_labels").select("row_id").distinct()
    return table(spark, d, "manifest").select("row_id", "text").join(want, "row_id")


_ORDERED = "row_number() OVER (ORDER BY md5('3|' || CAST(row_id AS VARCHAR)), row_id)"


@book.query("split_train_valid", f"WITH r AS (SELECT row_id, {_ORDERED} AS k, count(*) OVER () AS n FROM manifest) SELECT row_id, CASE WHEN k <= least(greatest(1, CAST(trunc(n * 0.05) AS BIGINT)), n - 1) THEN 'valid' ELSE 'train' END AS split FROM r")
def q_split(spark, d):
    return M.split_train_valid(table(spark, d, "manifest").select("row_id"), "row_id", 0.05, 3)


@book.query("ref_self_join")
def q_refs(spark, d):
    s = M.split_train_valid(table(spark, d, "manifest").select("row_id", "speaker_id"), "row_id", 0.05, 3)
    return M.reference_pairs(s, "row_id", ["split", "speaker_id"], 11).select("row_id", "split", "speaker_id", "ref", "has_ref")


@book.query(
    "ref_self_join_check",
    f"WITH r AS (SELECT row_id, speaker_id, {_ORDERED} AS k, count(*) OVER () AS n FROM manifest), s AS (SELECT speaker_id, CASE WHEN k <= least(greatest(1, CAST(trunc(n * 0.05) AS BIGINT)), n - 1) THEN 'valid' ELSE 'train' END AS split FROM r), g AS (SELECT split, speaker_id, count(*) AS c FROM s WHERE speaker_id IS NOT NULL GROUP BY ALL) SELECT split, CAST(sum(c) FILTER (c > 1) AS BIGINT) AS paired, 0 AS own, 0 AS strangers FROM g GROUP BY 1",
)
def q_refs_check(spark, d):
    r = q_refs(spark, d)
    other = table(spark, d, "manifest").select(F.col("row_id").alias("ref"), F.col("speaker_id").alias("ref_speaker"))
    j = r.where("has_ref").join(other, "ref")
    return j.groupBy("split").agg(F.count(F.lit(1)).alias("paired"), F.count_if(F.col("ref") == F.col("row_id")).cast("int").alias("own"), F.count_if(F.col("ref_speaker") != F.col("speaker_id")).cast("int").alias("strangers"))


@book.query("subset_validate", "SELECT count(DISTINCT row_id) AS inside, (SELECT count(DISTINCT row_id) FROM review_labels WHERE row_id NOT IN (SELECT row_id FROM manifest)) AS outside FROM review_labels WHERE row_id IN (SELECT row_id FROM manifest)")
def q_subset(spark, d):
    want, have = table(spark, d, "review_labels").select("row_id").where("row_id IS NOT NULL").distinct(), table(spark, d, "manifest").select("row_id", F.lit(1).alias("hit"))
    return want.join(have, "row_id", "left").agg(F.count("hit").alias("inside"), F.count_if(F.col("hit").isNull()).alias("outside"))


@book.query("format_names", "SELECT row_id, printf('%08d_%08d', row_id, row_id * 2) AS name FROM manifest")
def q_names(spark, d):
    return table(spark, d, "manifest").select("row_id", F.format_string("%08d_%08d", F.col("row_id"), F.col("row_id") * 2).alias("name"))


_DROPS = {"speaker": (9, 100_000), "caption": (10, 100_000), "duration_speaker": (11, 50_000), "duration_caption": (12, 50_000), "text": (13, 100_000)}


@book.query(
    "condition_dropout",
    "SELECT row_id, " + ", ".join(f"{'TRUE' if k == 'text' else 'speaker_id IS NOT NULL' if 'speaker' in k else f'len({_CAND}) > 0'} AND NOT ({DIGITS.format(seed=s, key='row_id')} % 1000000 < {n}) AS use_{k}" for k, (s, n) in _DROPS.items()) + " FROM manifest",
)
def q_dropout(spark, d):
    """Conditions for the flow loss and for the duration loss are dropped by draws of their own."""
    has = {"speaker": F.col("speaker_id").isNotNull(), "caption": F.size(T.caption_candidates(F.col("caption"))) > 0, "text": F.lit(True)}
    drop = {k: T.keyed_number(seed, F.col("row_id"), F.lit(1000000)) < n for k, (seed, n) in _DROPS.items()}
    return table(spark, d, "manifest").select("row_id", *[(has[k.removeprefix("duration_")] & ~drop[k]).alias(f"use_{k}") for k in _DROPS])

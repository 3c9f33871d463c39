"""Every operator of the engine as a query over whole tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import labels as L
from ..functions import text as X
from ..functions.stopwords import STOP_WORDS
from ..operators import augmentation as A
from ..operators import binning as B
from ..operators import dedup as D
from ..operators import explain as E
from ..operators import inference as N
from ..operators import metrics as M
from ..operators import sampling as G
from ..operators import stats as S
from ..operators import thresholds as T
from ..operators import weights as W
from ..operators import windows as V
from ..schema import CLI_THRESHOLDS, LABELS, LANGS, LOGIT_OFFSETS, SERVING_THRESHOLDS, is_pos
from ..session import ship
from ..sources import files as FS
from ..sources.tables import keep, scratch, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query; its name is the function's, its SQL twin the argument."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- pieces of SQL -----------------------------------------------------------

_VALUES = ", ".join(f"('{x}', {x}::DOUBLE)" for x in LABELS)
_PAIRS = [(a, b) for i, a in enumerate(LABELS) for b in LABELS[i + 1 :]]


def _long(cols: str, frm: str = "split") -> str:
    return f"(SELECT {cols}{', ' if cols else ''}t.label, t.v FROM {frm} s, LATERAL (VALUES {_VALUES}) t(label, v))"


_BITS = " || ".join(f"(CASE WHEN {x} > 0 THEN '1' ELSE '0' END)" for x in LABELS)
_POS = " + ".join(f"(CASE WHEN {x} > 0 THEN 1 ELSE 0 END)" for x in LABELS)
_SQL_SPACE, _SQL_WORD = X.SPACE, X.WORD
_NORM = f"trim(regexp_replace(lower(replace(coalesce(comment_text, ''), 'İ', 'i̇')), '[{_SQL_SPACE}]+', ' ', 'g'))"
_HASH = f"sha256({_NORM})"
_STRATUM = f"coalesce(lang, '') || '_' || {_BITS}"
_DRAW = "md5('42|' || row_id::VARCHAR)"
_PRED = "(SELECT DISTINCT row_id, lang_id, label, y, p FROM predictions WHERE y IS NOT NULL AND p IS NOT NULL AND NOT isnan(p))"


def _split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "split")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comments_raw")


def _wide_split(spark: SparkSession, d: str) -> DataFrame:
    return spread(_split(spark, d))


def _wide_raw(spark: SparkSession, d: str) -> DataFrame:
    return spread(_raw(spark, d))


def _pred(spark: SparkSession, d: str) -> DataFrame:
    return M.usable(table(spark, d, "predictions"))


# --- sources and profiles ----------------------------------------------------

_SPLIT_COLS = ["row_id", "id", "comment_text", *LABELS, "lang", "split", "source", "thread_id", "created_at", "loaded_at"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM split" for c in _SPLIT_COLS))
def null_profile(spark, d):
    return S.null_counts(_split(spark, d)).select("column_name", "nulls")


@query("SELECT count(*) AS n_rows, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT split) AS splits, min(created_at)::DATE AS first_day, max(created_at)::DATE AS last_day FROM split")
def scan_card(spark, d):
    return _split(spark, d).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.count_distinct("split").alias("splits"), F.min("created_at").cast("date").alias("first_day"), F.max("created_at").cast("date").alias("last_day"))


@query("SELECT min(length(comment_text)) AS shortest, max(length(comment_text)) AS longest, count(*) FILTER (WHERE length(trim(comment_text)) = 0) AS blank, count(*) - count(comment_text) AS missing FROM split")
def text_len_stats(spark, d):
    t = F.col("comment_text")
    return _split(spark, d).agg(F.min(F.length(t)).cast("long").alias("shortest"), F.max(F.length(t)).cast("long").alias("longest"), F.sum((F.length(F.trim(t)) == 0).cast("long")).alias("blank"), F.sum(t.isNull().cast("long")).alias("missing"))


@query("SELECT raw_id, comment_text, toxic, lang FROM comments_raw")
def csv_roundtrip(spark, d):
    at = scratch(spark, "csv")
    FS.write_csv(_raw(spark, d).select("raw_id", "comment_text", "toxic", "lang"), at, rows_a_file=10_000)
    return FS.read_csv(spark, at, "raw_id long, comment_text string, toxic double, lang string")


@query("SELECT lang_id, label, threshold FROM thresholds")
def threshold_tree(spark, d):
    return FS.thresholds_of_tree(FS.threshold_tree(table(spark, d, "thresholds")))


@query("SELECT row_id, CASE WHEN length(comment_text) > 100 THEN substring(comment_text, 1, 100) || '...' ELSE comment_text END AS preview FROM split")
def text_preview(spark, d):
    return _split(spark, d).select("row_id", X.preview(F.col("comment_text")).alias("preview"))


# --- labels and languages ----------------------------------------------------


@query("SELECT raw_id, " + ", ".join(f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(1, ceil({x})))::INTEGER END AS {x}" for x in LABELS) + " FROM comments_raw")
def label_binarise(spark, d):
    return L.binarised(_raw(spark, d)).select("raw_id", *LABELS)


@query(f"SELECT label, v, count(*) AS n FROM {_long('', 'comments_raw')} GROUP BY label, v")
def label_hist(spark, d):
    return S.label_histogram(_raw(spark, d))


@query("SELECT row_id, coalesce(CASE lower(lang) " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LANGS)) + " END, 0) AS lang_id FROM split")
def lang_ids(spark, d):
    return _split(spark, d).select("row_id", L.lang_id("lang").alias("lang_id"))


@query(f"SELECT row_id, {_BITS} AS bits, {_POS} AS n_labels, ({_POS}) > 0 AS any_positive, {_STRATUM} AS stratum FROM split")
def label_patterns(spark, d):
    return _split(spark, d).select("row_id", L.bit_pattern().alias("bits"), L.positives().alias("n_labels"), L.any_positive().alias("any_positive"), K.stratum().alias("stratum"))


@query("SELECT label, title, n FROM (SELECT label, CASE label WHEN 'toxic' THEN 'Toxic' WHEN 'severe_toxic' THEN 'Severe Toxic' WHEN 'obscene' THEN 'Obscene' WHEN 'threat' THEN 'Threat' WHEN 'insult' THEN 'Insult' ELSE 'Identity Hate' END AS title, count(*) AS n FROM predictions WHERE label IS NOT NULL GROUP BY label)")
def label_titles(spark, d):
    return table(spark, d, "predictions").where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", L.title("label").alias("title"), "n")


# --- text --------------------------------------------------------------------


def _q(x: str) -> str:
    return x.replace("'", "''")


_SQL_MARKUP = f"regexp_replace(regexp_replace(T, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', '', 'g')"
for _e, _by in X.ENTITIES:
    _SQL_MARKUP = f"replace({_SQL_MARKUP}, '{_q(_e)}', '{_q(_by)}')"
_C = f"regexp_replace(coalesce(comment_text, ''), '{_q(X.URL)}', '', 'g')"
_C = _SQL_MARKUP.replace("(T,", f"({_C},", 1)
_C = f"regexp_replace({_C}, '[^{_SQL_WORD}{_SQL_SPACE}.,!?-]', ' ', 'g')"
_C = f"trim(regexp_replace({_C}, '[{_SQL_SPACE}]+', ' ', 'g'))"
for _m in (r"\.", ",", "!", r"\?"):
    _C = f"regexp_replace({_C}, '{_m}{{2,}}', '{_m[-1]}', 'g')"
_C = f"trim(regexp_replace({_C}, '[{_SQL_SPACE}]+([.,!?])', '\\1', 'g'))"


@query(f"SELECT raw_id, {_C} AS cleaned FROM comments_raw")
def clean_text_v1(spark, d):
    return _wide_raw(spark, d).select("raw_id", X.clean_text(F.col("comment_text")).alias("cleaned"))


_NS = f"[^{_SQL_SPACE}]+"
_P = "trim(lower(coalesce(comment_text, '')))"
_P = f"(CASE WHEN contains({_P}, '<') AND contains({_P}, '>') THEN {_SQL_MARKUP.replace('(T,', f'({_P},', 1)} ELSE {_P} END)"
for _p in (f"http{_NS}|www{_NS}", f"{_NS}@{_NS}", f"@[{_SQL_WORD}]+", f"#[{_SQL_WORD}]+", r"\p{Nd}+"):
    _P = f"regexp_replace({_P}, '{_p}', '', 'g')"
_LETTERS = f"CASE WHEN lang = 'tr' THEN regexp_replace(t, '[^a-zA-ZçğıöşüÇĞİÖŞÜ{_SQL_SPACE}]', '', 'g') WHEN lang = 'ru' THEN regexp_replace(t, '[^а-яА-Я{_SQL_SPACE}]', '', 'g') ELSE regexp_replace(t, '[^{_SQL_WORD}{_SQL_SPACE}]', '', 'g') END"
_TOKENS = f"SELECT raw_id, lang, list_filter(string_split_regex({_LETTERS}, '[{_SQL_SPACE}]+'), lambda w: length(w) > 2) AS ws FROM (SELECT raw_id, lang, {_P} AS t FROM comments_raw)"


@query(f"SELECT raw_id, trim(array_to_string(ws, ' ')) AS processed FROM ({_TOKENS})")
def preprocess_basic(spark, d):
    return _wide_raw(spark, d).select("raw_id", X.preprocess(F.col("comment_text"), F.col("lang"), contractions=False).alias("processed"))


@query()
def clean_text_v2(spark, d):
    c = X.preprocess(F.col("comment_text"), F.col("lang"), stop=X.stop_words(spark), stem=True)
    return _wide_raw(spark, d).select("raw_id", c.alias("processed"))


@query(f"""
WITH t AS ({_TOKENS}), before AS (SELECT count(DISTINCT w) AS n FROM (SELECT unnest(list_filter(string_split_regex(coalesce(comment_text, ''), '[{_SQL_SPACE}]+'), lambda x: x <> '')) AS w FROM comments_raw)),
after AS (SELECT count(DISTINCT w) AS n FROM (SELECT unnest(ws) AS w FROM t))
SELECT b.n AS before, a.n AS after, round((b.n - a.n) * 100.0::DOUBLE / nullif(b.n, 0), 4) AS reduction FROM before b, after a""")
def vocab_stats(spark, d):
    raw = _wide_raw(spark, d)
    words = lambda c: raw.select(F.explode(X.tokens(c)).alias("w")).agg(F.count_distinct("w").alias("n"))
    before = words(F.coalesce("comment_text", F.lit(""))).first()[0]
    a = words(X.preprocess(F.col("comment_text"), F.col("lang"), contractions=False))
    return a.select(F.lit(before).cast("long").alias("before"), F.col("n").alias("after")).withColumn("reduction", F.round(F.try_divide((F.col("before") - F.col("after")) * 100.0, F.col("before")), 4))


@query()
def html_text(spark, d):
    return _wide_raw(spark, d).select("raw_id", X.parsed_markup("comment_text").alias("plain"))


@query()
def accents_removed(spark, d):
    return _raw(spark, d).select("raw_id", X.without_accents("comment_text").alias("plain"))


_LOWERED = "lower(replace(comment_text, 'İ', 'i̇'))"


def _expanded(c: str) -> str:
    """Contractions written out one after the other, longer ones first."""
    for short in sorted(X.CONTRACTIONS, key=len, reverse=True):
        c = f"regexp_replace({c}, '\\b{_q(short)}\\b', '{_q(X.CONTRACTIONS[short])}', 'g')"
    return c


@query(f"SELECT raw_id, {_expanded(_LOWERED)} AS expanded FROM comments_raw WHERE lang = 'en'")
def contractions(spark, d):
    return _raw(spark, d).where("lang = 'en'").select("raw_id", X.expand_contractions(F.lower("comment_text")).alias("expanded"))


def _stop_list(name: str) -> str:
    """A stop list as SQL literals; Spark's file of French words ends in an empty line, which is no word but stands in the SQL."""
    words = {*STOP_WORDS[name], *([""] if name == "french" else [])}
    return ", ".join(f"'{_q(w)}'" for w in sorted(words))


_KEPT = "CASE lang " + " ".join(f"WHEN '{x}' THEN list_filter(ws, lambda w: w NOT IN ({_stop_list(n)}))" for x, n in X.STOP_LISTS.items()) + " ELSE ws END"


@query(f"SELECT raw_id, {_KEPT} AS kept FROM (SELECT raw_id, lang, list_filter(string_split_regex({_LOWERED}, '[{_SQL_SPACE}]+'), lambda x: x <> '') AS ws FROM comments_raw)")
def stopwords_filter(spark, d):
    c = X.without_stop_words(X.tokens(F.lower("comment_text")), F.col("lang"), X.stop_words(spark))
    return _raw(spark, d).select("raw_id", c.alias("kept"))


_SCORE = {x: (f"length(regexp_replace(comment_text, '[^{N.CHARACTERS[x]}]', '', 'g'))" if x in N.CHARACTERS else "0") for x in LANGS}


@query("SELECT row_id, " + ", ".join(f"{_SCORE[x]}::INTEGER AS {x}" for x in LANGS) + " FROM split WHERE comment_text IS NOT NULL")
def unicode_scores(spark, d):
    scores = N.character_scores(F.col("comment_text"))
    return _wide_split(spark, d).where("comment_text is not null").select("row_id", *[scores[x].cast("int").alias(x) for x in LANGS])


_CODE = "CASE " + " ".join(f"WHEN contains(w, '{x}') THEN '{x}'" for x in LANGS) + " END"
_RULE_SCORES = ", ".join(f"2 * {_SCORE[x]} + len(list_filter(codes, lambda c: c = '{x}')) AS {x}" for x in LANGS)
_RULE_BEST = "CASE " + " ".join(f"WHEN {x} = m THEN '{x}'" for x in LANGS) + " END"


@query(f"""
WITH c AS (SELECT row_id, comment_text, list_transform(string_split_regex(lower(comment_text), '[{_SQL_SPACE}]+'), lambda w: {_CODE}) AS codes FROM split WHERE comment_text IS NOT NULL),
s AS (SELECT row_id, comment_text, {_RULE_SCORES} FROM c), b AS (SELECT *, greatest({', '.join(LANGS)}) AS m FROM s)
SELECT row_id, CASE WHEN NOT regexp_matches(comment_text, '[{_SQL_WORD}]') OR regexp_full_match(comment_text, '[\\x00-\\x7F]*') THEN 'en' WHEN m > 0 THEN {_RULE_BEST} ELSE 'en' END AS detected FROM b""")
def ascii_lang_rule(spark, d):
    return _wide_split(spark, d).where("comment_text is not null").select("row_id", N.detect_by_rules(F.col("comment_text")).alias("detected"))


@query(f"SELECT row_id, {_HASH} AS h FROM split")
def text_hash(spark, d):
    return _wide_split(spark, d).select("row_id", K.text_hash(F.col("comment_text")).alias("h"))


_ID = f"coalesce(lang, '') || '_' || {_BITS} || '_' || substring(md5(coalesce(comment_text, '')), 1, 6)"


@query(f"SELECT row_id, {_ID} AS new_id FROM split")
def comment_id(spark, d):
    return _wide_split(spark, d).select("row_id", K.comment_id(F.col("lang"), F.col("comment_text")).alias("new_id"))


@query(f"""
WITH i AS (SELECT row_id, {_ID} AS new_id FROM split), r AS (SELECT count(DISTINCT new_id) < count(new_id) AS repeats FROM i)
SELECT row_id, CASE WHEN repeats THEN (row_number() OVER (PARTITION BY new_id ORDER BY row_id) - 1)::VARCHAR || '_' || new_id ELSE new_id END AS new_id FROM i, r""")
def comment_id_unique(spark, d):
    ids = _wide_split(spark, d).select("row_id", K.comment_id(F.col("lang"), F.col("comment_text")).alias("new_id"))
    return K.unique_ids(ids, "new_id", "row_id")


# --- duplicates and set operations ------------------------------------------

_KEYED = f"(SELECT *, {_HASH} AS h FROM split)"


def _hashed(spark, d):
    return _wide_split(spark, d).withColumn("h", K.text_hash(F.col("comment_text")))


@query("SELECT min(row_id) AS row_id FROM split WHERE comment_text IS NOT NULL GROUP BY comment_text")
def dedup_exact(spark, d):
    return D.keep_first(_split(spark, d).where("comment_text is not null").select("row_id", "comment_text"), "comment_text", "row_id").select("row_id")


@query(f"SELECT min(row_id) AS row_id, h FROM {_KEYED} GROUP BY h")
def dedup_hash(spark, d):
    return D.keep_first(_hashed(spark, d).select("row_id", "h"), "h", "row_id").select("row_id", "h")


@query(f"SELECT h, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM {_KEYED} GROUP BY h HAVING count(*) > 1")
def dup_groups(spark, d):
    return D.duplicate_groups(_hashed(spark, d), "h", "row_id")


@query(f"SELECT k.row_id, k.h, g.n, g.first_row FROM {_KEYED} k JOIN (SELECT h, count(*) AS n, min(row_id) AS first_row FROM {_KEYED} GROUP BY h HAVING count(*) > 1) g ON k.h = g.h")
def dup_members(spark, d):
    return D.duplicate_rows(_hashed(spark, d), "h", "row_id").select("row_id", "h", "n", "first_row")


@query(f"SELECT count(*) AS total, count(DISTINCT h) AS unique_rows, count(*) - count(DISTINCT h) AS removed, round((count(*) - count(DISTINCT h))::DOUBLE / count(*), 6) AS rate FROM {_KEYED}")
def dedup_summary(spark, d):
    return D.summary(_hashed(spark, d), "h")


_AUG = "SELECT text AS comment_text, CASE WHEN label > 0 THEN 1 ELSE 0 END AS toxic, 0 AS severe_toxic, 0 AS obscene, 1 AS threat, 0 AS insult, 0 AS identity_hate, 'en' AS lang, 'augmented' AS origin FROM augmented"


def _augmented(spark, d):
    a = table(spark, d, "augmented").withColumnRenamed("text", "comment_text").withColumns({"toxic": is_pos("label").cast("int"), "threat": F.lit(1), "lang": F.lit("en"), "origin": F.lit("augmented")})
    return a


@query("SELECT comment_text, " + ", ".join(f"greatest(0, least(1, ceil({x})))::INTEGER AS {x}" for x in LABELS) + f", lang, 'raw' AS origin FROM comments_raw WHERE {' AND '.join(f'{x} IS NOT NULL' for x in LABELS)} UNION ALL {_AUG}")
def union_align(spark, d):
    raw = L.binarised(_raw(spark, d).dropna(subset=LABELS)).withColumn("origin", F.lit("raw"))
    return D.aligned_union([raw, _augmented(spark, d)], ["comment_text", *LABELS, "lang", "origin"])


@query("SELECT min(aug_id) AS aug_id, text FROM augmented WHERE text IS NOT NULL AND text NOT IN (SELECT comment_text FROM split WHERE comment_text IS NOT NULL) GROUP BY text UNION ALL SELECT min(aug_id), NULL FROM augmented WHERE text IS NULL AND NOT EXISTS (SELECT 1 FROM split WHERE comment_text IS NULL) HAVING count(*) > 0")
def anti_merge(spark, d):
    main = _split(spark, d).select(F.col("comment_text").alias("text"))
    return D.merge_new(main, table(spark, d, "augmented"), "text", "aug_id").select("aug_id", "text")


_SEEN = f"(SELECT h, bool_or(split = 'train') AS tr, bool_or(split = 'val') AS va FROM {_KEYED} GROUP BY h)"


@query(f"SELECT k.row_id, k.split FROM {_KEYED} k JOIN {_SEEN} s ON k.h = s.h WHERE NOT ((k.split = 'val' AND s.tr) OR (k.split = 'test' AND (s.tr OR s.va)))")
def leakage_remove(spark, d):
    return D.without_leakage(_wide_split(spark, d).select("row_id", "split", "comment_text")).select("row_id", "split")


@query(f"WITH u AS (SELECT DISTINCT split, h FROM {_KEYED}) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM u a JOIN u b ON a.h = b.h AND a.split < b.split GROUP BY a.split, b.split")
def leakage_pairs(spark, d):
    return D.split_overlaps(D.hashes(_wide_split(spark, d)))


_LIGHT = "trim(lower(coalesce(comment_text, '')))"


@query(f"""
WITH k AS (SELECT DISTINCT {_LIGHT} AS k, split FROM split), n AS (SELECT split, count(*) AS n FROM split GROUP BY split), pairs(a, b) AS (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test'))
SELECT a || '_' || b AS pair, (SELECT count(*) FROM k x JOIN k y ON x.k = y.k WHERE x.split = a AND y.split = b) AS shared,
round((SELECT count(*) FROM k x JOIN k y ON x.k = y.k WHERE x.split = a AND y.split = b)::DOUBLE / n.n, 6) AS ratio FROM pairs JOIN n ON n.split = a""")
def contamination(spark, d):
    return D.contamination(_wide_split(spark, d).select("comment_text", "split"))


@query("""
WITH a AS (SELECT lang, count(*) AS n FROM comments_raw WHERE lang IS NOT NULL GROUP BY lang), b AS (SELECT lang, count(*) AS n FROM split WHERE lang IS NOT NULL GROUP BY lang)
SELECT lang, coalesce(a.n, 0) AS old_n, coalesce(b.n, 0) AS new_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS diff,
CASE WHEN coalesce(a.n, 0) > 0 THEN round((coalesce(b.n, 0) - a.n) * 100.0::DOUBLE / a.n, 4) END AS pct FROM a FULL JOIN b USING (lang)""")
def lang_compare_full_outer(spark, d):
    return D.compare_counts(_raw(spark, d), _split(spark, d), "lang")


def _rates_sql(by: str, frm: str = "split", extra: str = "") -> str:
    c = f"{by}, " if by else ""
    return f"SELECT {c}label, count(*) AS n, count(*) FILTER (WHERE v > 0) AS pos, count(*) FILTER (WHERE v <= 0) AS neg, round(count(*) FILTER (WHERE v > 0)::DOUBLE / count(*), 6) AS rate{extra} FROM {_long(by, frm)} WHERE v IS NOT NULL GROUP BY {c}label"


@query(f"SELECT o.lang, o.label, round(abs(o.pos::DOUBLE / o.n - s.pos::DOUBLE / s.n), 6) AS delta FROM ({_rates_sql('lang', 'comments_raw')}) o JOIN ({_rates_sql('lang')}) s ON o.lang = s.lang AND o.label = s.label")
def dist_deltas(spark, d):
    o = S.rates(_raw(spark, d), "lang").select("lang", "label", (F.col("pos") / F.col("n")).alias("_o"))
    s = S.rates(_split(spark, d), "lang").select("lang", "label", (F.col("pos") / F.col("n")).alias("_s"))
    return o.join(s, ["lang", "label"]).select("lang", "label", F.round(F.abs(F.col("_o") - F.col("_s")), 6).alias("delta"))


@query()
def near_dup_leakage(spark, d):
    from ..operators.neardup import leaking

    return leaking(_wide_split(spark, d))


_OK = " AND ".join(f"{x} IS NOT NULL" for x in LABELS)
_CLEAN_AUG = _C.replace("coalesce(comment_text, '')", "coalesce(text, '')")
_CORPUS = f"""
WITH raw AS (SELECT raw_id AS row_id, {_C} AS comment_text, {', '.join(f"greatest(0, least(1, ceil({x})))::INTEGER AS {x}" for x in LABELS)}, lang FROM comments_raw WHERE {_OK}),
kept AS (SELECT * FROM raw WHERE length(trim(comment_text)) > 0),
aug AS (SELECT aug_id + 1099511627776 AS row_id, {_CLEAN_AUG} AS comment_text FROM augmented WHERE length(trim(text)) > 0),
extra AS (SELECT min(row_id) AS row_id, comment_text FROM aug WHERE comment_text NOT IN (SELECT comment_text FROM kept) GROUP BY comment_text),
merged AS (SELECT * FROM kept UNION ALL SELECT row_id, comment_text, 1, 0, 0, 1, 0, 0, 'en' FROM extra),
hashed AS (SELECT *, {_HASH} AS h FROM merged), firsts AS (SELECT min(row_id) AS row_id FROM hashed GROUP BY h),
d AS (SELECT row_id, {_STRATUM} AS stratum, row_number() OVER (ORDER BY {_STRATUM}, {_DRAW}, row_id) - 1 AS i FROM hashed WHERE row_id IN (SELECT row_id FROM firsts))"""


@query(_CORPUS + """ SELECT row_id, 'train' AS split FROM d WHERE i % 5 <> 0 UNION ALL
SELECT row_id, CASE WHEN (row_number() OVER (ORDER BY stratum, md5('42b|' || row_id::VARCHAR), row_id) - 1) % 2 = 0 THEN 'val' ELSE 'test' END FROM d WHERE i % 5 = 0""")
def corpus_build(spark, d):
    from .corpus import build

    return build(_raw(spark, d), table(spark, d, "augmented")).split.select("row_id", "split")


# --- statistics --------------------------------------------------------------


@query(_rates_sql(""))
def label_rate_overall(spark, d):
    return S.rates(_split(spark, d))


@query(_rates_sql("lang"))
def label_rate_by_lang(spark, d):
    return S.rates(_split(spark, d), "lang")


@query(_rates_sql("split, lang"))
def label_rate_by_split(spark, d):
    return S.rates(_split(spark, d), "split", "lang")


@query(f"SELECT lang, label, grouping(lang)::INTEGER AS total, count(*) AS n, count(*) FILTER (WHERE v > 0) AS pos, round(count(*) FILTER (WHERE v > 0)::DOUBLE / count(*), 6) AS rate FROM {_long('lang')} WHERE v IS NOT NULL GROUP BY GROUPING SETS ((lang, label), (label))")
def label_rate_grouping_sets(spark, d):
    return S.rates_grouping_sets(_split(spark, d))


_HALF = f"{S.Z95} * sqrt(pos::DOUBLE / n * (1 - pos::DOUBLE / n) / n)"


@query(f"SELECT *, round(pos::DOUBLE / n - {_HALF}, 6) AS low, round(pos::DOUBLE / n + {_HALF}, 6) AS high FROM ({_rates_sql('lang')})")
def wald_ci(spark, d):
    return S.wald(S.rates(_split(spark, d), "lang"))


@query("SELECT lang, source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM split GROUP BY lang, source")
def lang_share(spark, d):
    return S.value_counts(_split(spark, d), "lang", "source")


@query(" UNION ALL ".join(f"SELECT '{a}' AS label_a, '{b}' AS label_b, count(*) FILTER (WHERE {a} > 0 AND {b} > 0) AS both, round(count(*) FILTER (WHERE {a} > 0 AND {b} > 0)::DOUBLE / count(*), 6) AS share FROM split" for a, b in _PAIRS))
def cooccurrence(spark, d):
    return S.cooccurrence(_split(spark, d))


@query(f"SELECT lang, {_POS} AS n_labels, count(*) AS n FROM split GROUP BY ALL")
def cardinality_hist(spark, d):
    return S.cardinality(_split(spark, d), "lang")


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (WHERE {_POS} > 0) AS any_positive, count(*) FILTER (WHERE {_POS} = 0) AS clean, round(count(*) FILTER (WHERE {_POS} > 0) * 100.0::DOUBLE / count(*), 4) AS pct FROM split GROUP BY lang")
def any_toxic_by_lang(spark, d):
    return S.toxic_or_clean(_split(spark, d), "lang")


_FULL = "(SELECT * FROM split WHERE " + " AND ".join(f"{x} IS NOT NULL" for x in LABELS) + ")"


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS label_a, '{b}' AS label_b, corr({a}, {b}) AS r FROM {_FULL}" for a in LABELS for b in LABELS) + ") SELECT label_a, label_b, round(r, 6) AS r, round(avg(r) OVER (PARTITION BY label_a), 6) AS mean_r FROM c")
def label_corr(spark, d):
    return S.label_correlation(_split(spark, d))


@query("SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE n_labels = {k}) AS n{k}" for k in range(7)) + f" FROM (SELECT lang, {_POS} AS n_labels FROM split WHERE lang IS NOT NULL) GROUP BY lang")
def crosstab_lang_card(spark, d):
    t = S.crosstab(_split(spark, d).where("lang is not null").select("lang", *LABELS), "lang", L.positives(), list(range(7)))
    return t.select("lang", *[F.col(f"`{k}`").alias(f"n{k}") for k in range(7)])


_CELLS = f"(SELECT label, lang, (v > 0)::INTEGER AS pos, count(*) AS n FROM {_long('lang')} WHERE v IS NOT NULL AND lang IS NOT NULL GROUP BY ALL)"


@query(f"""
WITH c AS {_CELLS}, r AS (SELECT label, lang, sum(n) AS r FROM c GROUP BY ALL), k AS (SELECT label, pos, sum(n) AS k FROM c GROUP BY ALL), t AS (SELECT label, sum(n) AS t FROM c GROUP BY label)
SELECT r.label, round(sum(pow(coalesce(c.n, 0) - r.r * k.k::DOUBLE / t.t, 2) / (r.r * k.k::DOUBLE / t.t)), 4) AS chi2, (count(DISTINCT r.lang) - 1) * (count(DISTINCT k.pos) - 1) AS dof
FROM r JOIN k ON r.label = k.label JOIN t ON t.label = r.label LEFT JOIN c ON c.label = r.label AND c.lang = r.lang AND c.pos = k.pos GROUP BY r.label""")
def chi2_label_lang(spark, d):
    long = L.long_labels(_split(spark, d), "lang").where("v is not null and lang is not null")
    cells = long.groupBy("label", "lang", (F.col("v") > 0).cast("int").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    return S.chi_square(cells, "lang", "pos", "n", "label")


@query(f"""
WITH c AS (SELECT lang, {_POS} AS m, count(*) AS n FROM split WHERE lang IS NOT NULL GROUP BY ALL), r AS (SELECT lang, sum(n) AS r FROM c GROUP BY lang), k AS (SELECT m, sum(n) AS k FROM c GROUP BY m), t AS (SELECT sum(n) AS t FROM c)
SELECT round(sum(pow(coalesce(c.n, 0) - r.r * k.k::DOUBLE / t.t, 2) / (r.r * k.k::DOUBLE / t.t)), 4) AS chi2, (count(DISTINCT r.lang) - 1) * (count(DISTINCT k.m) - 1) AS dof
FROM r, k, t LEFT JOIN c ON c.lang = r.lang AND c.m = k.m""")
def chi2_cardinality_lang(spark, d):
    return S.chi_square(S.cardinality(_split(spark, d).where("lang is not null"), "lang"), "lang", "n_labels", "n")


@query("WITH g AS (SELECT lang, count(*) AS n FROM split WHERE lang IS NOT NULL GROUP BY lang) SELECT round(stddev_samp(n) / avg(n), 6) AS cv, round(stddev_samp(n) / avg(n), 6) > 0.15 AS imbalanced FROM g")
def lang_cv(spark, d):
    return S.variation(_split(spark, d), "lang")


@query(f"SELECT least(49, floor(p / (1.0::DOUBLE / 50)))::INTEGER AS bin, count(*) AS n FROM {_PRED} WHERE p BETWEEN 0 AND 1 AND p <> 0 GROUP BY bin")
def score_histogram(spark, d):
    return S.histogram(_pred(spark, d), "p", 0.0, 1.0, 50)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS greatest, arg_min(event_id, (value, event_id)) AS best_epoch, round(regr_slope(value, event_id), 6) AS slope, round(regr_intercept(value, event_id), 6) AS intercept FROM events WHERE value IS NOT NULL GROUP BY event_type")
def loss_trend(spark, d):
    return V.loss_figures(table(spark, d, "events").where("value is not null"), "value", "event_id", "event_type")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 10) AS running_avg, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS step FROM events")
def running_avg(spark, d):
    return V.running_mean(table(spark, d, "events"), "value", ["user_id"], ["event_id"]).select("event_id", "running_avg", "step")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events")
def moving_avg_20(spark, d):
    return V.moving_mean(table(spark, d, "events"), "value", ["user_id"], ["event_id"]).select("event_id", "moving_avg")


@query("SELECT event_id, greatest(value, coalesce(m, value)) AS best, coalesce(value > m, true) AS improved FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events)")
def best_so_far(spark, d):
    return V.best_so_far(table(spark, d, "events"), "value", ["user_id"], ["event_id"]).select("event_id", "best", "improved")


@query("""
WITH r AS (SELECT event_id, user_id, (event_type = 'error')::INTEGER AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT a.event_id, round(sum(0.05::DOUBLE * pow(0.95::DOUBLE, a.i - b.i) * b.x), 6) AS ema FROM r a JOIN r b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.event_id""")
def ema_positive(spark, d):
    e = table(spark, d, "events").withColumn("x", (F.col("event_type") == "error").cast("int"))
    return V.exponential_mean(e, "x", ["user_id"], ["event_id"]).select("event_id", "ema")


@query()
def ordinal_bin(spark, d):
    raw = _raw(spark, d)
    parts = [B.distribution(raw, x, B.fit_edges(raw, x)).withColumn("label", F.lit(x)) for x in LABELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- sampling and splitting --------------------------------------------------

_RANKED = f"(SELECT row_id, {_STRATUM} AS stratum, row_number() OVER (ORDER BY {_STRATUM}, {_DRAW}, row_id) - 1 AS i FROM split)"


def _strata(spark, d):
    return _split(spark, d).select("row_id", K.stratum().alias("stratum"), "lang", "split", *LABELS)


@query(f"SELECT row_id, (i % 10)::INTEGER AS fold FROM {_RANKED}")
def strat_folds(spark, d):
    return G.folds(_strata(spark, d), "stratum", 10).select("row_id", "fold")


_THREE = f"""(SELECT row_id, 'train' AS part FROM {_RANKED} WHERE i % 5 <> 0 UNION ALL
SELECT row_id, CASE WHEN (row_number() OVER (ORDER BY stratum, md5('42b|' || row_id::VARCHAR), row_id) - 1) % 2 = 0 THEN 'val' ELSE 'test' END FROM {_RANKED} WHERE i % 5 = 0)"""


@query(f"SELECT row_id, part FROM {_THREE}")
def split_3way(spark, d):
    return G.three_way(_strata(spark, d), "stratum").select("row_id", "part")


@query(f"SELECT row_id, CASE WHEN i % 10 = 0 THEN 'val' ELSE 'train' END AS part FROM {_RANKED}")
def split_2way(spark, d):
    return G.two_way(_strata(spark, d), "stratum").select("row_id", "part")


@query(f"SELECT part, label, count(*) AS n, count(*) FILTER (WHERE v > 0) AS pos, round(count(*) FILTER (WHERE v > 0)::DOUBLE / count(*), 6) AS rate FROM (SELECT p.part, l.label, l.v FROM {_THREE} p JOIN {_long('row_id')} l ON p.row_id = l.row_id) WHERE v IS NOT NULL GROUP BY part, label")
def split_verify(spark, d):
    return S.rates(G.three_way(_strata(spark, d), "stratum"), "part").drop("neg")


_TOXIC = f"(SELECT row_id, lang, ({_POS}) > 0 AS pos FROM split)"


@query(f"""
WITH c AS (SELECT lang, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q FROM {_TOXIC} GROUP BY lang),
r AS (SELECT row_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW}, row_id) AS r FROM {_TOXIC} WHERE NOT pos)
SELECT row_id, lang, 0 AS copy FROM {_TOXIC} WHERE pos
UNION ALL SELECT r.row_id, r.lang, unnest(generate_series(0, ((c.p - r.r) // c.q)::INTEGER))::INTEGER FROM r JOIN c ON r.lang IS NOT DISTINCT FROM c.lang WHERE r.r <= c.p""")
def balance_1to1(spark, d):
    rows = _split(spark, d).select("row_id", "lang", (L.positives() > 0).alias("pos"))
    return G.balanced(rows, "pos", "lang").select("row_id", "lang", "copy")


@query(f"SELECT row_id FROM split ORDER BY {_DRAW}, row_id LIMIT 51518")
def cap_n(spark, d):
    return G.capped(_split(spark, d).select("row_id"), 51_518)


_PT = "(SELECT row_id, threat > 0 AS pos FROM split WHERE split = 'test' AND lang = 'pt')"


@query(f"""
WITH t AS (SELECT coalesce(avg(CASE WHEN threat > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 0) AS target FROM split WHERE split = 'train' AND lang = 'pt'),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE pos) AS p FROM {_PT}),
o AS (SELECT CASE WHEN s.p::DOUBLE / greatest(s.n, 1) > t.target THEN s.p - floor(s.n * t.target) ELSE 0 END AS out FROM s, t),
g AS (SELECT row_id, row_number() OVER (ORDER BY {_DRAW}, row_id) AS r FROM {_PT} WHERE pos)
SELECT row_id FROM {_PT} WHERE row_id NOT IN (SELECT g.row_id FROM g, o WHERE g.r <= o.out)""")
def downsample_to_ratio(spark, d):
    s = _split(spark, d)
    ratio = s.where("split = 'train' and lang = 'pt'").agg(F.coalesce(F.avg(is_pos("threat").cast("double")), F.lit(0.0)).alias("target"))
    return G.reduced_to_ratio(s.where("split = 'test' and lang = 'pt'").select("row_id", is_pos("threat").alias("pos")), "pos", ratio).select("row_id")


@query(f"SELECT row_id FROM split WHERE split = 'test' AND row_id NOT IN (SELECT row_id FROM split WHERE split = 'test' AND lang = 'tr' AND toxic > 0 ORDER BY {_DRAW}, row_id LIMIT 150)")
def fixed_removal(spark, d):
    s = _split(spark, d).where("split = 'test'").select("row_id", "lang", "toxic")
    return G.removed(s, (F.col("lang") == "tr") & is_pos("toxic"), 150).select("row_id")


_RARE = "(SELECT row_id, lang, t.label FROM split s, LATERAL (VALUES ('threat', threat), ('identity_hate', identity_hate)) t(label, v) WHERE v > 0 AND lang IS NOT NULL)"


@query(f"""
WITH places AS (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY {_DRAW}, row_id) AS place FROM {_RARE}),
n AS (SELECT lang, label, count(*) AS n FROM {_RARE} GROUP BY ALL),
draws AS (SELECT lang, label, n, unnest(generate_series(1, 1000 - n))::INTEGER AS draw FROM n WHERE n < 1000)
SELECT p.row_id, d.lang, d.label, d.draw FROM draws d JOIN places p ON p.lang = d.lang AND p.label = d.label
AND p.place = ('0x' || substring(md5('42draw|' || d.lang || '|' || d.label || '|' || d.draw::VARCHAR), 1, 15))::BIGINT % d.n + 1""")
def oversample_rare(spark, d):
    rare = L.long_labels(_split(spark, d), "row_id", "lang", labels=["threat", "identity_hate"]).where("v > 0 and lang is not null").drop("v")
    need = rare.groupBy("lang", "label").agg((1000 - F.count(F.lit(1))).alias("_need"))
    return G.with_replacement(rare, need, ["lang", "label"]).select("row_id", "lang", "label", "draw")


@query(f"SELECT lang, row_id FROM (SELECT lang, row_id, row_number() OVER (PARTITION BY lang ORDER BY {_DRAW}, row_id) AS r FROM split) WHERE r <= 3")
def preview_k_per_lang(spark, d):
    return G.take(_split(spark, d).select("lang", "row_id"), 3, ["lang"])


@query(f"""
WITH g AS (SELECT lang, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE {x} > 0) AS {x}" for x in LABELS)} FROM split GROUP BY lang), m AS (SELECT max(n) - coalesce(max(n) FILTER (WHERE lang = 'it'), 0) AS need FROM g)
SELECT t.label, m.need, floor(t.v / g.n * m.need)::BIGINT AS target FROM g, m, LATERAL (VALUES {_VALUES}) t(label, v) WHERE g.lang = 'it'""")
def quota_plan(spark, d):
    return G.quota(_split(spark, d), "it", LABELS)


@query("SELECT source, aug_id, running FROM (SELECT source, aug_id, sum(length(text)) OVER (PARTITION BY source ORDER BY aug_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM augmented WHERE text IS NOT NULL) WHERE running <= 20000")
def trim_to_quota(spark, d):
    a = table(spark, d, "augmented").where("text is not null").withColumn("chars", F.length("text").cast("long"))
    return G.trimmed_to_total(a, "chars", 20_000, ["source"], "aug_id").select("source", "aug_id", "running")


def _drawn(frm: str, cols: str) -> str:
    """Rows of a subquery with their number of occurrences in each of 1,000 replicates."""
    times = "CASE " + " ".join(f"WHEN u < {e!r}::DOUBLE THEN {k}" for k, e in enumerate(G.poisson_edges())) + " ELSE 19 END"
    u = "(('0x' || substring(md5('7|' || row_id::VARCHAR || '|' || replicate::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"
    return f"(SELECT * FROM (SELECT {cols}, replicate, {times} AS times FROM (SELECT *, {u} AS u FROM {frm} s, (SELECT unnest(generate_series(1, 1000)) AS replicate) r)) WHERE times > 0)"


@query(f"SELECT replicate::INTEGER AS replicate, lang, sum(times)::BIGINT AS n FROM {_drawn('split', 'lang')} GROUP BY replicate, lang")
def bootstrap_sample(spark, d):
    return G.bootstrap_counts(_split(spark, d).select("row_id", "lang"), 1000).groupBy("replicate", "lang").agg(F.sum("times").alias("n"))


# --- evaluation --------------------------------------------------------------


def _conf(by: str, frm: str = _PRED, t: str = "0.5") -> str:
    return f"SELECT {by}, count(*) FILTER (WHERE y = 1 AND p > {t}) AS tp, count(*) FILTER (WHERE y <> 1 AND p > {t}) AS fp, count(*) FILTER (WHERE y <> 1 AND p <= {t}) AS tn, count(*) FILTER (WHERE y = 1 AND p <= {t}) AS fn FROM {frm} GROUP BY {by}"


def _prf(by: str, frm: str = _PRED, t: str = "0.5") -> str:
    none = "CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""SELECT *, tp + fn AS support, CASE WHEN tp + fn = 0 THEN {none} WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision,
CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall, CASE WHEN tp + fn = 0 THEN {none} ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM ({_conf(by, frm, t)})"""


def _auc(by: str, frm: str = _PRED) -> str:
    return f"""SELECT {by}, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(a * (coalesce(below, 0) + b / 2.0::DOUBLE)) / (sum(a)::DOUBLE * sum(b)) ELSE 0 END AS auc FROM (
SELECT *, sum(b) OVER (PARTITION BY {by} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (
SELECT {by}, p, count(*) FILTER (WHERE y = 1) AS a, count(*) FILTER (WHERE y <> 1) AS b FROM {frm} GROUP BY {by}, p)) GROUP BY {by}"""


def _classes(by: str, frm: str = _PRED, t: str = "0.5") -> str:
    return f"SELECT * FROM ({_prf(by, frm, t)}) JOIN ({_auc(by, frm)}) USING ({by}) JOIN (SELECT {by}, avg(pow(p - y, 2)) AS brier FROM {frm} GROUP BY {by}) USING ({by})"


def _avg(by: str, frm: str = _PRED, t: str = "0.5", keys: str = "label") -> str:
    cols = ", ".join(f"avg({c}) AS {c}_macro, coalesce(sum({c} * support) / nullif(sum(support), 0), 0) AS {c}_weighted" for c in ("precision", "recall", "f1"))
    ok = "bool_and(support > 0 AND fp + tn > 0)"
    sel, grp = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"SELECT {sel}CASE WHEN {ok} THEN avg(auc) ELSE 0 END AS auc_macro, CASE WHEN {ok} THEN sum(auc * support) / sum(support) ELSE 0 END AS auc_weighted, {cols} FROM ({_classes(keys, frm, t)}){grp}"


def _rows(by: str, frm: str = _PRED, t: str = "0.5") -> str:
    sel, grp = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"SELECT {sel}sum(w)::DOUBLE / sum(n) AS hamming, avg(CASE WHEN w = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS exact_match, count(*) AS records FROM (SELECT {sel}row_id, count(*) FILTER (WHERE (y = 1) <> (p > {t})) AS w, count(*) AS n FROM {frm} GROUP BY {sel}row_id){grp}"


_SIX = ["precision", "recall", "f1", "auc", "brier"]


@query(_conf("label"))
def confusion(spark, d):
    return M.confusion(_pred(spark, d), "label")


@query("SELECT label, tp, fp, tn, fn, support, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SIX) + f" FROM ({_classes('label')})")
def prf_per_class(spark, d):
    return M.per_class(_pred(spark, d)).select("label", "tp", "fp", "tn", "fn", "support", *[F.round(c, 6).alias(c) for c in _SIX])


@query(f"SELECT lang_id, label, round(auc, 6) AS auc FROM ({_auc('lang_id, label')})")
def auc_per_class(spark, d):
    return M.auc(_pred(spark, d), "lang_id", "label").withColumn("auc", F.round("auc", 6))


_AVERAGES = [f"{c}_{k}" for c in ("auc", "precision", "recall", "f1") for k in ("macro", "weighted")]


@query("SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in _AVERAGES) + f" FROM ({_avg('')})")
def auc_macro_weighted(spark, d):
    return M.averaged(M.per_class(_pred(spark, d))).select(*[F.round(c, 6).alias(c) for c in _AVERAGES])


@query(f"SELECT lang_id, label, round(avg(pow(p - y, 2)), 6) AS brier FROM {_PRED} GROUP BY lang_id, label")
def brier(spark, d):
    return M.brier(_pred(spark, d), "lang_id", "label").withColumn("brier", F.round("brier", 6))


@query(f"SELECT round(hamming, 6) AS hamming, round(exact_match, 6) AS exact_match, records FROM ({_rows('')})")
def hamming_exact(spark, d):
    return M.row_figures(_pred(spark, d)).select(F.round("hamming", 6).alias("hamming"), F.round("exact_match", 6).alias("exact_match"), "records")


_BLOCK = ", ".join(f"round({c}, 6) AS {c}" for c in [*_AVERAGES, "hamming", "exact_match"])


@query(f"SELECT lang_id, {_BLOCK}, records FROM ({_avg('lang_id', keys='lang_id, label')}) JOIN ({_rows('lang_id')}) USING (lang_id)")
def metrics_by_lang(spark, d):
    p = _pred(spark, d)
    j = M.averaged(M.per_class(p, "lang_id"), "lang_id").join(M.row_figures(p, "lang_id"), "lang_id")
    return j.select("lang_id", *[F.round(c, 6).alias(c) for c in [*_AVERAGES, "hamming", "exact_match"]], "records")


_SETS = "(SELECT 'default' AS threshold_set, lang_id, label, 0.5::DOUBLE AS threshold FROM thresholds UNION ALL SELECT 'stored', lang_id, label, threshold FROM thresholds)"
_PT2 = f"(SELECT s.threshold_set, p.*, s.threshold AS t FROM {_PRED} p JOIN {_SETS} s ON p.lang_id = s.lang_id AND p.label = s.label)"
_CLASS_COLS, _ALL_COLS = ["auc", "precision", "recall", "f1", "brier", "support"], [*_AVERAGES, "hamming", "exact_match", "records"]


def _unpivot(sub: str, scope: str, lang: str, label: str, cols: list[str]) -> str:
    return f"SELECT threshold_set, '{scope}' AS scope, {lang} AS lang_id, {label} AS label, m.metric, round(m.value, 6) AS value FROM ({sub}), LATERAL (VALUES {', '.join(f"('{c}', {c}::DOUBLE)" for c in cols)}) m(metric, value)"


def _sets(spark, d):
    t = table(spark, d, "thresholds")
    return t.select(F.lit("default").alias("threshold_set"), "lang_id", "label", F.lit(0.5).alias("threshold")).unionByName(t.select(F.lit("stored").alias("threshold_set"), "lang_id", "label", "threshold"))


_TREE = " UNION ALL ".join([
    _unpivot(f"SELECT * FROM ({_avg('threshold_set', _PT2, 't', 'threshold_set, label')}) JOIN ({_rows('threshold_set', _PT2, 't')}) USING (threshold_set)", "overall", "NULL::INTEGER", "NULL::VARCHAR", _ALL_COLS),
    _unpivot(f"SELECT * FROM ({_avg('threshold_set, lang_id', _PT2, 't', 'threshold_set, lang_id, label')}) JOIN ({_rows('threshold_set, lang_id', _PT2, 't')}) USING (threshold_set, lang_id)", "per_language", "lang_id", "NULL::VARCHAR", _ALL_COLS),
    _unpivot(_classes("threshold_set, label", _PT2, "t"), "per_class", "NULL::INTEGER", "label", _CLASS_COLS),
])


@query(_TREE)
def metrics_tree(spark, d):
    return M.tree(_pred(spark, d), _sets(spark, d))


@query(f"SELECT metric, max(value) FILTER (WHERE threshold_set = 'default') AS \"default\", max(value) FILTER (WHERE threshold_set = 'stored') AS stored FROM ({_TREE}) WHERE scope = 'overall' AND (metric LIKE 'precision%' OR metric LIKE 'recall%' OR metric LIKE 'f1%') GROUP BY metric")
def threshold_compare(spark, d):
    t = M.tree(_pred(spark, d), _sets(spark, d)).where("scope = 'overall' and (metric like 'precision%' or metric like 'recall%' or metric like 'f1%')")
    return t.groupBy("metric").pivot("threshold_set", ["default", "stored"]).agg(F.max("value"))


@query(f"""
SELECT label, p, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / a, 6) AS tpr FROM (
SELECT label, p, sum(u) OVER w AS tp, sum(v) OVER w AS fp, sum(u) OVER (PARTITION BY label) AS a, sum(v) OVER (PARTITION BY label) AS n FROM (
SELECT label, p, count(*) FILTER (WHERE y = 1) AS u, count(*) FILTER (WHERE y <> 1) AS v FROM {_PRED} GROUP BY label, p) WINDOW w AS (PARTITION BY label ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) WHERE a > 0 AND n > 0""")
def roc_points(spark, d):
    return M.roc(_pred(spark, d), "label")


@query(f"""
SELECT lang_id, p, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / a, 6) AS tpr FROM (
SELECT lang_id, p, sum(u) OVER w AS tp, sum(v) OVER w AS fp, sum(u) OVER (PARTITION BY lang_id) AS a, sum(v) OVER (PARTITION BY lang_id) AS n FROM (
SELECT lang_id, p, count(*) FILTER (WHERE y = 1) AS u, count(*) FILTER (WHERE y <> 1) AS v FROM {_PRED} WHERE label = 'toxic' GROUP BY lang_id, p) WINDOW w AS (PARTITION BY lang_id ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) WHERE a > 0 AND n > 0""")
def roc_by_lang(spark, d):
    return M.roc(_pred(spark, d).where("label = 'toxic'"), "lang_id")


_BOOT = f"(SELECT label, replicate, p, coalesce(sum(times) FILTER (WHERE y = 1), 0) AS a, coalesce(sum(times) FILTER (WHERE y <> 1), 0) AS b FROM {_drawn(_PRED, 'label, y, p')} GROUP BY label, replicate, p)"


@query(f"""
WITH w AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY label, replicate ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {_BOOT}),
o AS (SELECT label, replicate, CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN sum(a * (below + b / 2.0::DOUBLE)) / (sum(a)::DOUBLE * sum(b)) END AS auc FROM w GROUP BY label, replicate)
SELECT label, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std, count(auc) AS replicates FROM o GROUP BY label""")
def bootstrap_auc(spark, d):
    return M.bootstrap_auc(_pred(spark, d), "label")


@query(f"""
WITH c AS (SELECT label, replicate, p, sum(b) OVER w / sum(b) OVER g::DOUBLE AS x1, sum(a) OVER w / sum(a) OVER g::DOUBLE AS y1 FROM {_BOOT}
WINDOW w AS (PARTITION BY label, replicate ORDER BY p DESC ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY label, replicate)),
n AS (SELECT * FROM c WHERE NOT isnan(x1) AND NOT isnan(y1) AND x1 IS NOT NULL AND y1 IS NOT NULL),
l AS (SELECT *, coalesce(lag(x1) OVER o, 0) AS x0, coalesce(lag(y1) OVER o, 0) AS y0 FROM n WINDOW o AS (PARTITION BY label, replicate ORDER BY p DESC)),
k AS (SELECT *, unnest(generate_series(ceil(x0 * 99)::BIGINT, floor(x1 * 99)::BIGINT)) AS k FROM l WHERE ceil(x0 * 99) <= floor(x1 * 99)),
t AS (SELECT label, replicate, k, max(CASE WHEN k = 0 THEN 0 WHEN x1 > x0 THEN y0 + (y1 - y0) * (k / 99.0::DOUBLE - x0) / (x1 - x0) ELSE y1 END) AS tpr FROM k GROUP BY label, replicate, k)
SELECT label, k, round(avg(tpr), 6) AS tpr, round(greatest(0, avg(tpr) - stddev_pop(tpr)), 6) AS low, round(least(1, avg(tpr) + stddev_pop(tpr)), 6) AS high FROM t GROUP BY label, k""")
def roc_band(spark, d):
    return M.roc_band(_pred(spark, d), "label")


_X = "ln(p / (1 - p))"
_BCE = f"(greatest({_X}, 0.0::DOUBLE) - {_X} * y + ln(1 + exp(-abs({_X}))))"


@query(f"SELECT label, count(*) AS n, round(avg(0.25::DOUBLE * pow(1 - exp(-{_BCE}), 2) * {_BCE}), 6) AS focal, round(avg(pow(1 - exp(-{_BCE}), 2) * {_BCE}), 6) AS plain FROM {_PRED} WHERE p > 0 AND p < 1 GROUP BY label")
def focal_loss(spark, d):
    x = F.log(F.col("p") / (1 - F.col("p")))
    p = _pred(spark, d).where("p > 0 and p < 1")
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(M.focal_loss(x, F.col("y"))), 6).alias("focal"), F.round(F.avg(M.focal_loss(x, F.col("y"), None)), 6).alias("plain"))


# --- thresholds --------------------------------------------------------------


def _folded(by: str) -> str:
    edges, edge = [], "0"
    for i in range(4):
        edge += f" + q + ((({i} - shift) % 5 + 5) % 5 < m)::INTEGER"
        edges.append(f"(r >= {edge})::INTEGER")
    return f"""(SELECT {by}, y, p, {' + '.join(edges)} AS fold FROM (SELECT x.*, z.n // 5 AS q, z.n % 5 AS m, CASE WHEN o.first < z.first THEN o.n % 5 ELSE 0 END AS shift FROM
(SELECT *, row_number() OVER (PARTITION BY {by}, y ORDER BY row_id) - 1 AS r FROM {_PRED}) x JOIN (SELECT {by}, y, count(*) AS n, min(row_id) AS first FROM {_PRED} GROUP BY {by}, y) z USING ({by}, y)
LEFT JOIN (SELECT {by}, 1 - y AS y, count(*) AS n, min(row_id) AS first FROM {_PRED} GROUP BY {by}, y) o USING ({by}, y)))"""


def _search(by: str, steps: int) -> str:
    ts = f"(SELECT i, 0.3::DOUBLE + 0.4::DOUBLE * i / {steps - 1} AS threshold FROM generate_series(0, {steps - 1}) t(i))"
    return f"""(SELECT {by}, CASE WHEN max(positives) = 0 THEN 0.5 ELSE round(arg_min(threshold, (-score, i)), 6) END AS threshold, CASE WHEN max(positives) = 0 THEN 1.0 ELSE round(max(score), 6) END AS score, max(positives)::BIGINT AS positives FROM (
SELECT {by}, i, threshold, round(avg(f1), 9) AS score, sum(pos) AS positives FROM (
SELECT {by}, fold, i, threshold, coalesce(2.0::DOUBLE * count(*) FILTER (WHERE y = 1 AND p > threshold) / nullif(count(*) FILTER (WHERE p > threshold) + count(*) FILTER (WHERE y = 1), 0), 1.0) AS f1, count(*) FILTER (WHERE y = 1) AS pos
FROM {_folded(by)}, {ts} GROUP BY {by}, fold, i, threshold) GROUP BY {by}, i, threshold) GROUP BY {by})"""


@query(f"SELECT * FROM {_search('label', T.STEPS)}")
def threshold_grid(spark, d):
    return T.search(_pred(spark, d))


@query(f"SELECT l.lang_id, l.label, CASE WHEN l.positives >= 100 THEN l.threshold ELSE g.threshold END AS threshold, l.positives >= 100 AS own FROM {_search('lang_id, label', T.STEPS_PER_LANGUAGE)} l JOIN {_search('label', T.STEPS)} g ON l.label = g.label")
def threshold_fallback(spark, d):
    p = _pred(spark, d)
    return T.with_fallback(T.search(p, "lang_id", steps=T.STEPS_PER_LANGUAGE), T.search(p))


_FLOORS = "(VALUES " + ", ".join(f"('{x}', {t}::DOUBLE)" for x, t in SERVING_THRESHOLDS.items()) + ") f(label, floor)"


@query(f"SELECT t.lang_id, t.label, greatest(t.threshold, f.floor) AS threshold FROM thresholds t JOIN {_FLOORS} ON t.label = f.label")
def threshold_floor(spark, d):
    return T.raised(table(spark, d, "thresholds"), T.tidy(spark, SERVING_THRESHOLDS)).select("lang_id", "label", "threshold")


@query(f"SELECT p.row_id, p.lang_id, p.label, p.p > t.threshold AS hat FROM {_PRED} p JOIN thresholds t ON p.lang_id = t.lang_id AND p.label = t.label")
def apply_thresholds(spark, d):
    return T.applied(_pred(spark, d), table(spark, d, "thresholds")).select("row_id", "lang_id", "label", "hat")


_ORD = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LABELS)) + " END"


def _verdict_sql(ts: dict, op: str) -> str:
    t = "CASE label " + " ".join(f"WHEN '{x}' THEN {v}::DOUBLE" for x, v in ts.items()) + " END"
    one = "(SELECT row_id, label, p FROM predictions WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY ALL)"
    return f"SELECT row_id, coalesce(string_agg(label, ',' ORDER BY {_ORD}) FILTER (WHERE p {op} {t}), '') AS categories, string_agg(label, ',' ORDER BY p DESC, {_ORD}) AS ranking, count(*) FILTER (WHERE p {op} {t}) > 0 AS is_toxic FROM {one} GROUP BY row_id"


def _verdict(spark, d, ts, inclusive):
    v = T.verdicts(_pred(spark, d).select("row_id", "label", "p").distinct(), ts, inclusive)
    return v.select("row_id", F.array_join("categories", ",").alias("categories"), F.array_join("ranking", ",").alias("ranking"), "is_toxic")


@query(_verdict_sql(SERVING_THRESHOLDS, ">="))
def serving_verdicts(spark, d):
    return _verdict(spark, d, SERVING_THRESHOLDS, True)


@query(_verdict_sql(CLI_THRESHOLDS, ">"))
def cli_verdicts(spark, d):
    return _verdict(spark, d, CLI_THRESHOLDS, False)


_OFF = "CASE WHEN lang_id <> 0 THEN CASE label " + " ".join(f"WHEN '{x}' THEN {v}::DOUBLE" for x, v in LOGIT_OFFSETS.items()) + " END ELSE 0 END"


@query(f"SELECT row_id, lang_id, label, CASE WHEN p <= 0 THEN 0 WHEN p >= 1 THEN 1 ELSE round(1 / (1 + exp(-(ln(p / (1 - p)) + {_OFF}))), 6) END::DOUBLE AS served FROM {_PRED}")
def lang_offset(spark, d):
    return _pred(spark, d).select("row_id", "lang_id", "label", F.round(T.offset_probability(F.col("p"), F.col("label"), F.col("lang_id")), 6).alias("served"))


# --- weights -----------------------------------------------------------------


def _support(by: str) -> str:
    return f"(SELECT {by}, label, count(*) FILTER (WHERE v <= 0) AS support_0, count(*) FILTER (WHERE v > 0) AS support_1 FROM {_long(by)} WHERE v IS NOT NULL AND lang IN ({', '.join(repr(x) for x in LANGS)}) GROUP BY {by}, label)"


def _supports(spark, d):
    return W.supports(_split(spark, d).where(F.col("lang").isin(*LANGS)), "lang")


_N = "(support_0 + support_1)::DOUBLE"
_BAL = f"SELECT *, coalesce({_N} / nullif(2 * support_1, 0), 0) AS weight_1, coalesce({_N} / nullif(2 * support_0, 0), 0) AS weight_0, coalesce(support_1 / nullif({_N}, 0), 0) AS ratio FROM "
_TOTALS = f"(SELECT label, sum(support_0)::BIGINT AS support_0, sum(support_1)::BIGINT AS support_1 FROM {_support('lang')} GROUP BY label)"


@query(f"SELECT label, support_0, support_1, round(weight_1, 6) AS weight_1, round(weight_0, 6) AS weight_0, round(ratio, 6) AS ratio FROM ({_BAL}{_TOTALS})")
def balanced_weights(spark, d):
    s = _supports(spark, d).groupBy("label").agg(F.sum("support_0").alias("support_0"), F.sum("support_1").alias("support_1"))
    return W.balanced(s).select("label", "support_0", "support_1", *[F.round(c, 6).alias(c) for c in ("weight_1", "weight_0", "ratio")])


@query(f"SELECT lang, label, round(weight_1, 6) AS weight_1, round(weight_0, 6) AS weight_0 FROM ({_BAL}{_support('lang')})")
def weights_by_lang(spark, d):
    return W.balanced(_supports(spark, d)).select("lang", "label", *[F.round(c, 6).alias(c) for c in ("weight_1", "weight_0")])


@query(f"SELECT lang, label, round(weight_1 / nullif(max(CASE WHEN label = 'obscene' THEN weight_1 END) OVER (PARTITION BY lang), 0), 6) AS normalised FROM ({_BAL}{_support('lang')})")
def weights_normalised(spark, d):
    return W.normalised(W.balanced(_supports(spark, d))).select("lang", "label", F.round("normalised", 6).alias("normalised"))


_TOP = "CASE WHEN label = 'identity_hate' THEN 10.0::DOUBLE ELSE 15.0::DOUBLE END"
_PTV = "(support_1 / (support_0 + support_1 + 1e-7::DOUBLE) + 1e-7::DOUBLE)"
_RAW = f"0.25::DOUBLE / (0.25::DOUBLE + 0.75::DOUBLE * (1 - {_PTV})) * pow(1 - {_PTV}, 2) / ({_PTV} + 1e-7::DOUBLE) * CASE WHEN label IN ('threat', 'identity_hate') THEN (1 + ln(1 + support_0 + support_1 + 1e-7::DOUBLE) / ln(1 + support_1::DOUBLE)) / 2 ELSE 1 END"
_FOCAL = f"(SELECT lang, label, support_0, support_1, CASE WHEN support_1 = 0 THEN 15.0::DOUBLE ELSE {_RAW} END AS raw_weight_1, CASE WHEN support_1 = 0 THEN 15.0::DOUBLE ELSE round(least({_TOP}, greatest(0.5::DOUBLE, {_RAW})), 3) END AS weight_1, 1.0::DOUBLE AS weight_0 FROM {_support('lang')})"


def _focal(spark, d):
    return W.focal(_supports(spark, d))


@query(f"SELECT lang, label, support_0, support_1, round(raw_weight_1, 6) AS raw_weight_1, weight_1, weight_0 FROM {_FOCAL}")
def focal_weights(spark, d):
    return _focal(spark, d).select("lang", "label", "support_0", "support_1", F.round("raw_weight_1", 6).alias("raw_weight_1"), "weight_1", "weight_0")


@query(f"SELECT lang, label, round(weight_1 / max(weight_1) OVER (PARTITION BY label) * 15, 3) AS scaled_1 FROM {_FOCAL}")
def weights_rescaled(spark, d):
    return W.rescaled(_focal(spark, d)).select("lang", "label", "scaled_1")


@query("SELECT lang, label, 'ratio' AS rule, CASE WHEN raw_weight_1 / weight_0 > 30 THEN 'error' ELSE 'warning' END AS grade FROM class_weights WHERE raw_weight_1 / weight_0 > 20")
def weight_warnings(spark, d):
    w = table(spark, d, "class_weights").select("lang", "label", F.col("raw_weight_1").alias("weight_1"), "weight_0")
    return W.warnings(w)


@query("SELECT w.lang, w.label, w.weight_1, round(w.weight_1 / b.weight_1, 6) AS ratio FROM class_weights w JOIN class_weights b ON b.lang = 'en' AND b.label = w.label WHERE w.lang <> 'en' AND w.label IN ('threat', 'identity_hate') AND (round(w.weight_1 / b.weight_1, 6) < 0.67 OR round(w.weight_1 / b.weight_1, 6) > 1.5)")
def weight_consistency(spark, d):
    return W.inconsistent(table(spark, d, "class_weights"))


@query("SELECT lang, round(avg(weight_1), 6) AS scale FROM class_weights GROUP BY lang")
def lang_scale(spark, d):
    return W.language_scale(table(spark, d, "class_weights"))


@query()
def dynamic_weights(spark, d):
    rows = _split(spark, d).where(F.col("lang").isin(*LANGS) & F.col("created_at").isNotNull()).withColumn("batch", F.date_trunc("week", "created_at"))
    return W.dynamic(rows, "batch", "batch", LABELS, W.language_scale(table(spark, d, "class_weights")))


# --- generated texts, scoring, explanation -----------------------------------

_BANNED = " AND ".join(f"NOT contains(lower(text), '{w}')" for w in A.BANNED)


@query(f"SELECT aug_id, text FROM augmented WHERE len(list_filter(string_split_regex(text, '[{_SQL_SPACE}]+'), lambda w: w <> '')) BETWEEN 3 AND 50 AND {_BANNED} AND length(trim(text)) >= 10")
def gen_filter(spark, d):
    t = F.col("text")
    return table(spark, d, "augmented").where(A.acceptable(t) & A.long_enough(t)).select("aug_id", "text")


@query("SELECT aug_id, 'Rewrite as ' || coalesce(source, '') || ': ' || coalesce(text, '') || ' [/INST] \"' || coalesce(text, '') || '\"' AS prompt FROM augmented")
def prompts(spark, d):
    p = A.prompt('Rewrite as {source}: {text} [/INST] "{text}"', source=F.col("source"), text=F.col("text"))
    return table(spark, d, "augmented").select("aug_id", p.alias("prompt"))


@query("SELECT aug_id, trim(trim(trim(string_split(list_last(string_split('<s>[INST] write [/INST] \"' || text || '\"</s>', '[/INST]')), '</s>')[1]), '\"')) AS response FROM augmented")
def responses(spark, d):
    made = F.concat(F.lit("<s>[INST] write [/INST] \""), "text", F.lit("\"</s>"))
    return table(spark, d, "augmented").select("aug_id", A.response(made).alias("response"))


@query("SELECT generated_at[1:8] AS day, count(*) AS n, max(generated_at) AS latest FROM augmented WHERE generated_at IS NOT NULL GROUP BY day")
def generated_per_day(spark, d):
    return table(spark, d, "augmented").where("generated_at is not null").groupBy(F.substring("generated_at", 1, 8).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("generated_at").alias("latest"))


@query()
def batch_scores(spark, d):
    return N.results(N.scored(_wide_split(spark, d), N.lexicon_scorer), SERVING_THRESHOLDS).select("row_id", *LABELS, "toxic_categories", "is_toxic")


@query()
def text_classifier(spark, d):
    labels = [F.when(F.col(x).isNotNull(), is_pos(x).cast("int")).alias(x) for x in LABELS]
    rows = keep(_wide_split(spark, d).select("row_id", "split", A.unaccented(F.col("comment_text")).alias("text"), *labels))
    fitted = A.fit_classifiers(rows.where("split = 'train'"), "text", LABELS)
    return A.probabilities(*fitted, rows.where("split is null or split <> 'train'"), "text").select("row_id", *[F.round(x, 4).alias(x) for x in LABELS])


@query()
def classifier_results(spark, d):
    scores = text_classifier(spark, d).na.fill(0.0, LABELS)
    return N.results(scores, SERVING_THRESHOLDS).select("row_id", *LABELS, "toxic_categories", "is_toxic")


_HIT = {x: "|".join(p) for x, (_, p) in E.LEXICON.items()}


@query(f"""
WITH w AS (SELECT row_id, list_filter(string_split_regex(comment_text, '[{_SQL_SPACE}]+'), lambda x: x <> '') AS ws FROM split WHERE comment_text IS NOT NULL),
t AS (SELECT row_id, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos FROM w)
SELECT row_id, pos::INTEGER AS pos, token, """ + ", ".join(f"CASE WHEN regexp_matches(lower(token), '{_HIT[x]}') THEN 0.5 ELSE 0 END::DOUBLE AS {x}" for x in LABELS) + " FROM t")
def token_importance(spark, d):
    p = {x: F.lit(0.5) for x in LABELS}
    return E.token_importance(_wide_split(spark, d).where("comment_text is not null"), "comment_text", p)


@query()
def attention_weights(spark, d):
    v = table(spark, d, "embeddings").withColumn("text_no", F.floor(F.col("vec_id") / 16))
    return E.attention(v, "text_no", "embedding", "vec_id").select("text_no", "vec_id", F.transform("attention", lambda x: F.round(x, 5)).alias("attention"))


@query(f"SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def hourly_events(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def streamed_hourly_events(spark, d):
    from ..streaming.events import hourly

    return hourly(spark, f"{d}/events.parquet")


@query()
def streamed_scores(spark, d):
    from ..streaming.scoring import stream_scores

    return stream_scores(spark, f"{d}/split.parquet")

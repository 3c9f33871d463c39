"""More operators as queries, with their SQL twins: files, checks, draws, figures of a run, results for display."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..operators import augmentation as A
from ..operators import explain as E
from ..operators import inference as N
from ..operators import metrics as M
from ..operators import sampling as G
from ..operators import stats as S
from ..operators import weights as W
from ..operators import windows as V
from ..schema import LABELS, LANGS, is_pos
from ..sources import files as FS
from ..sources.tables import scratch, table
from .queries import _DRAW, _PRED, _RARE, _SPLIT_COLS, _SQL_SPACE, _TREE, _VALUES, SQL, _pred, _raw, _sets, _split, _wide_split, query

_LABEL_LIST = ", ".join(f"'{x}'" for x in LABELS)


# --- files -------------------------------------------------------------------


@query("SELECT lang, count(*) AS n FROM split GROUP BY lang")
def json_stats(spark, d):
    at = scratch(spark, "json")
    FS.write_json(_split(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n")), at)
    return FS.read_log(spark, at, "lang string, n long")


@query("SELECT event_id, user_id, event_type, value FROM events")
def metric_log(spark, d):
    at = scratch(spark, "log")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    FS.logged(e.where("event_type <> 'error' or event_type is null"), at, 10_000)
    FS.logged(e.where("event_type = 'error'"), at, 10_000)
    return FS.read_log(spark, at, e.schema)


@query("SELECT lang, label, weight_0, weight_1, support_0, support_1, raw_weight_1 FROM class_weights")
def weights_tree(spark, d):
    return FS.weights_of_tree(FS.weights_tree(table(spark, d, "class_weights"))).select("lang", "label", "weight_0", "weight_1", "support_0", "support_1", "raw_weight_1")


@query(_TREE)
def evaluation_tree(spark, d):
    return FS.evaluation_of_tree(FS.evaluation_tree(M.tree(_pred(spark, d), _sets(spark, d))))


@query(f"SELECT row_id, lang_id, label, y, p FROM {_PRED} WHERE label IN ({_LABEL_LIST})")
def prediction_matrix(spark, d):
    at = scratch(spark, "matrix")
    FS.prediction_matrix(_pred(spark, d), LABELS).write.parquet(at)
    return FS.predictions_of_matrix(spark.read.parquet(at), LABELS)


_CARD = " UNION ALL ".join(
    ["SELECT coalesce(source, '') AS file, 'rows' AS section, 'rows' AS name, count(*) AS value FROM split GROUP BY ALL"]
    + [f"SELECT coalesce(source, ''), 'nulls', '{c}', count(*) - count({c}) FROM split GROUP BY coalesce(source, '')" for c in _SPLIT_COLS]
    + [f"SELECT coalesce(source, ''), 'labels', '{x}', count(*) FILTER (WHERE {x} > 0) FROM split GROUP BY coalesce(source, '')" for x in LABELS]
    + ["SELECT coalesce(source, ''), 'languages', lang, count(*) FROM split WHERE lang IS NOT NULL GROUP BY ALL"]
)


@query(_CARD)
def dataset_cards(spark, d):
    return FS.cards(_split(spark, d), group=F.coalesce("source", F.lit("")), labels=LABELS)


@query("SELECT max('eval_' || generated_at) AS latest FROM augmented WHERE generated_at IS NOT NULL")
def latest_evaluation(spark, d):
    return FS.latest_run(table(spark, d, "augmented").select(F.concat(F.lit("eval_"), "generated_at").alias("name")))


@query("SELECT 'checkpoint_epoch' || max(aug_id) AS checkpoint FROM augmented")
def resolved_checkpoint(spark, d):
    return FS.resolved_checkpoint(table(spark, d, "augmented").select(F.concat(F.lit("checkpoint_epoch"), "aug_id").alias("name")))


@query("SELECT DISTINCT generated_at AS name FROM augmented WHERE generated_at IS NOT NULL ORDER BY name DESC LIMIT 3")
def retained_names(spark, d):
    return FS.retained(table(spark, d, "augmented").where("generated_at is not null").select(F.col("generated_at").alias("name")).distinct())


@query("SELECT t.label AS column_name, count(*) AS n, round(avg(t.v), 6) AS mean, round(stddev_samp(t.v), 6) AS std, min(t.v) AS least, max(t.v) AS greatest FROM comments_raw s, LATERAL (VALUES " + _VALUES + ") t(label, v) WHERE t.v IS NOT NULL GROUP BY t.label")
def numeric_summary(spark, d):
    return S.numeric_summary(_raw(spark, d), LABELS)


# --- labels and checks -------------------------------------------------------


@query("SELECT label, v AS value, count(*) AS n FROM (SELECT t.label, t.v FROM comments_raw s, LATERAL (VALUES " + _VALUES + ") t(label, v)) WHERE v IS NOT NULL AND NOT isnan(v) AND v NOT IN (0, 1) GROUP BY ALL")
def label_violations(spark, d):
    return L.violations(_raw(spark, d))


@query(f"SELECT row_id, lang_id, " + ", ".join(f"(label = '{x}')::INTEGER AS {x}" for x in LABELS) + f" FROM {_PRED}")
def one_hot(spark, d):
    return _pred(spark, d).select("row_id", "lang_id", *L.one_hot(F.col("label")))


@query("WITH b AS (SELECT avg(CASE WHEN lang_id BETWEEN 0 AND 6 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS bad FROM predictions) SELECT row_id, label, CASE WHEN bad > 0.1 THEN 0 ELSE coalesce(greatest(0, least(6, lang_id)), 0) END::INTEGER AS lang_id, p FROM predictions, b")
def lang_id_clamp(spark, d):
    return L.clamped_lang_ids(table(spark, d, "predictions").select("row_id", "label", "lang_id", "p"))


@query("SELECT lang_id, label, CASE lang_id " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(N.NAME_TO_CODE.values())) + " ELSE 'en' END AS code FROM thresholds")
def display_names(spark, d):
    shown = F.concat(F.lit("flag "), F.get(F.array(*[F.lit(x) for x in N.NAME_TO_CODE]), F.col("lang_id")))
    return table(spark, d, "thresholds").select("lang_id", "label", N.code_of_name(shown).alias("code"))


@query(f"SELECT row_id, lang_id, label, floor(p * 1000 + 0.5) / 10 AS pct FROM {_PRED}")
def percents(spark, d):
    return _pred(spark, d).select("row_id", "lang_id", "label", L.as_percent("p").alias("pct"))


@query("SELECT lang, format('{:,}', n) AS n, printf('%.2f%%', floor(n / sum(n) OVER () * 10000 + 0.5) / 100) AS share FROM (SELECT lang, count(*) AS n FROM split GROUP BY lang)")
def formatted_shares(spark, d):
    per = _split(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 1
    return per.select("lang", L.thousands("n").alias("n"), L.percent_text(F.col("n") / total).alias("share"))


@query(f"SELECT row_id, lang_id, label, p >= CASE WHEN label = 'toxic' THEN 0.3 ELSE 0.2 END AS passes FROM {_PRED}")
def classifier_gate(spark, d):
    return _pred(spark, d).select("row_id", "lang_id", "label", A.passes(F.col("p"), F.col("label")).alias("passes"))


@query(f"SELECT row_id, lang_id, label, p >= 0.5 AS detected FROM {_PRED}")
def ui_statuses(spark, d):
    return _pred(spark, d).select("row_id", "lang_id", "label", (F.col("p") >= 0.5).alias("detected"))


_ORDER = "CASE label " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LABELS)) + " END"


@query(f"SELECT row_id, CASE WHEN max(p) > 0.2 THEN arg_max(label, (p, -({_ORDER}))) ELSE 'toxic' END AS category FROM {_PRED} WHERE label IN ({_LABEL_LIST}) GROUP BY row_id")
def top_category(spark, d):
    wide = _pred(spark, d).groupBy("row_id").agg(*[F.max(F.when(F.col("label") == x, F.col("p"))).alias(x) for x in LABELS]).where(F.coalesce(*LABELS).isNotNull())
    return wide.select("row_id", N.top_category({x: F.col(x) for x in LABELS}).alias("category"))


@query()
def valid_english(spark, d):
    return table(spark, d, "augmented").where(A.in_language(F.col("text"), "en", N.detect_by_rules)).select("aug_id", "text")


@query("SELECT DISTINCT w AS word FROM (SELECT unnest(list_filter(string_split_regex(comment_text, '[" + _SQL_SPACE + "]+'), lambda x: x <> '')) AS w FROM split WHERE split = 'val') INTERSECT SELECT w FROM (SELECT unnest(list_filter(string_split_regex(comment_text, '[" + _SQL_SPACE + "]+'), lambda x: x <> '')) AS w FROM split WHERE split = 'test')")
def vocab_common(spark, d):
    words = lambda x: _wide_split(spark, d).where(F.col("split") == x).select(F.explode(X.tokens(F.col("comment_text"))).alias("word"))
    return words("val").intersect(words("test"))


@query()
def detected_language(spark, d):
    t = F.coalesce("comment_text", F.lit(""))
    return _wide_split(spark, d).select("row_id", N.detect_by_rules(t, N.detect_by_stop_words(t, X.stop_words(spark))).alias("detected"))


# --- model inputs and explanation --------------------------------------------

_WORDS = f"list_filter(string_split_regex(comment_text, '[{_SQL_SPACE}]+'), lambda x: x <> '')"
_IDS = f"list_transform({_WORDS}, lambda w: (('0x' || substring(md5(w), 1, 8))::BIGINT % 250000 + 4)::INTEGER)"


@query(f"""
WITH t AS (SELECT row_id, coalesce({_IDS}, []) AS ids FROM split), c AS (SELECT row_id, len(ids) AS n, ids[1:126] AS k FROM t)
SELECT row_id, list_concat([0], k, [2], list_resize([]::INTEGER[], 126 - len(k), 1)) AS input_ids,
list_concat(list_resize([]::INTEGER[], len(k) + 2, 1), list_resize([]::INTEGER[], 126 - len(k), 0)) AS attention_mask, (n - len(k))::INTEGER AS cut FROM c""")
def model_inputs(spark, d):
    s = X.sequence(X.word_ids(X.tokens(F.col("comment_text"))), 128)
    return _wide_split(spark, d).select("row_id", s.alias("s")).select("row_id", "s.*")


@query(f"SELECT row_id, list_transform(list_filter({_WORDS}, lambda w: w NOT IN ('<s>', '</s>', '<pad>', '<unk>', '<mask>')), lambda w: CASE WHEN replace(w, '▁', '') = '' THEN '[SPACE]' ELSE replace(w, '▁', '') END) AS shown FROM split WHERE comment_text IS NOT NULL")
def shown_pieces(spark, d):
    return _wide_split(spark, d).where("comment_text is not null").select("row_id", E.shown_tokens(X.tokens(F.col("comment_text"))).alias("shown"))


@query()
def shown_attention(spark, d):
    v = table(spark, d, "embeddings").withColumn("text_no", F.floor(F.col("vec_id") / 16))
    rows = E.attention(v, "text_no", "embedding", "vec_id")
    texts = rows.groupBy("text_no").agg(F.sort_array(F.collect_list(F.struct("vec_id", "attention"))).alias("m"))  # sixteen rows a text
    pieces = F.transform(F.col("m.vec_id"), lambda i: F.when(i % 16 == 0, "<s>").otherwise("w"))
    return texts.select("text_no", E.shown_matrix(pieces, F.col("m.attention")).alias("matrix")).withColumn("matrix", F.transform("matrix", lambda r: F.transform(r, lambda x: F.round(x, 5))))


# --- draws -------------------------------------------------------------------


def _noise(x: str) -> str:
    u = lambda k: f"((('0x' || substring(md5('42{x}{k}|' || p.row_id::VARCHAR || '|' || p.label || '|' || p.draw::VARCHAR), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"
    return f"CASE WHEN s.{x} IS NOT NULL THEN round(greatest(0, least(1, s.{x}::DOUBLE + 0.1::DOUBLE * sqrt(-2 * ln({u('u')})) * cos(2 * pi() * {u('v')}))), 6) END AS {x}"


_OTHERS = ["toxic", "severe_toxic", "obscene", "insult"]
_RARE_TRAIN = _RARE.replace("FROM split s", "FROM (SELECT * FROM split WHERE split = 'train') s")


@query(f"""
WITH places AS (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY {_DRAW}, row_id) AS place FROM {_RARE_TRAIN}),
n AS (SELECT lang, label, count(*) AS n FROM {_RARE_TRAIN} GROUP BY ALL),
draws AS (SELECT lang, label, n, unnest(generate_series(1, 1000 - n))::INTEGER AS draw FROM n WHERE n < 1000),
p AS (SELECT p.row_id, d.label, d.draw FROM draws d JOIN places p ON p.lang = d.lang AND p.label = d.label
AND p.place = ('0x' || substring(md5('42draw|' || d.lang || '|' || d.label || '|' || d.draw::VARCHAR), 1, 15))::BIGINT % d.n + 1)
SELECT row_id, lang, NULL AS rare, NULL::INTEGER AS draw, threat::DOUBLE AS threat, identity_hate::DOUBLE AS identity_hate, {", ".join(f"{x}::DOUBLE AS {x}" for x in _OTHERS)} FROM split WHERE split = 'train'
UNION ALL SELECT s.row_id, s.lang, p.label, p.draw, s.threat::DOUBLE, s.identity_hate::DOUBLE, {", ".join(_noise(x) for x in _OTHERS)} FROM p JOIN split s ON s.row_id = p.row_id""")
def oversample_appended(spark, d):
    out = G.appended_rare(_split(spark, d).where("split = 'train'"), ["threat", "identity_hate"], _OTHERS, 1000)
    return out.withColumns({x: F.when(F.col("draw").isNull(), F.col(x)).otherwise(F.round(x, 6)) for x in _OTHERS})


_POOL = "(SELECT row_id, comment_text FROM split WHERE split = 'train' AND lang = 'en' AND identity_hate > 0)"


@query(f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY {_DRAW}, row_id) AS place FROM {_POOL}), n AS (SELECT count(*) AS n FROM {_POOL}),
d AS (SELECT draw, ('0x' || substring(md5('42draw|1|' || draw::VARCHAR), 1, 15))::BIGINT % n + 1 AS place FROM n, (SELECT unnest(generate_series(1, 50)) AS draw) WHERE n > 0)
SELECT row_id, comment_text, NULL::INTEGER AS draw FROM split WHERE split = 'val' UNION ALL SELECT r.row_id, r.comment_text, d.draw::INTEGER FROM d JOIN r ON r.place = d.place""")
def sample_to_val(spark, d):
    s = _split(spark, d)
    pool = s.where((F.col("split") == "train") & (F.col("lang") == "en") & is_pos("identity_hate")).select("row_id", "comment_text")
    return G.sample_appended(s.where("split = 'val'").select("row_id", "comment_text"), pool, 50, "comment_text")


@query(f"""
WITH r AS (SELECT row_id, lang, row_number() OVER (ORDER BY coalesce(lang, ''), {_DRAW}, row_id) - 1 AS place FROM split), n AS (SELECT count(*) AS n FROM split),
d AS (SELECT i, n, unnest(generate_series(0, greatest(1, n // 64) * 64 - 1)) AS k FROM (SELECT 1 AS i, n FROM n))
SELECT (d.k // 64)::INTEGER AS batch, (d.k % 64)::INTEGER AS place, r.row_id, r.lang FROM d JOIN r ON r.place = ('0x' || substring(md5('42batch|' || d.k::VARCHAR), 1, 15))::BIGINT % d.n""")
def group_batches(spark, d):
    return G.batches(_split(spark, d).select("row_id", "lang"), 64, "lang")


@query(f"""
WITH g AS (SELECT aug_id, row_number() OVER (ORDER BY md5('42|' || aug_id::VARCHAR), aug_id) AS r FROM augmented WHERE label = 1 AND text IS NOT NULL),
q AS (SELECT max(n) - coalesce(max(n) FILTER (WHERE lang = 'it'), 0) AS need FROM (SELECT lang, count(*) AS n FROM split GROUP BY lang))
SELECT row_id, false AS generated FROM split WHERE lang = 'it' UNION ALL SELECT g.aug_id, true FROM g, q WHERE g.r <= q.need""")
def quota_filled(spark, d):
    s = _split(spark, d)
    need = G.quota(s, "it", LABELS).select("need").first()
    pool = table(spark, d, "augmented").where("label = 1 and text is not null").select(F.col("aug_id").alias("row_id"))
    return G.filled(s.where("lang = 'it'").select("row_id"), pool, need[0] if need else 0, "row_id")


# --- figures of a run --------------------------------------------------------


@query()
def chi2_p_values(spark, d):
    from .queries import chi2_label_lang

    return S.with_p_value(chi2_label_lang(spark, d)).withColumn("p", F.round("p", 6))


_VALID = f"len(list_filter(string_split_regex(text, '[{_SQL_SPACE}]+'), lambda w: w <> '')) BETWEEN 3 AND 50 AND " + " AND ".join(f"NOT contains(lower(text), '{w}')" for w in A.BANNED) + " AND length(trim(text)) >= 10"


@query(f"SELECT source, attempts, valid, round(valid * 100.0::DOUBLE / attempts, 4) AS success_pct FROM (SELECT source, count(*) AS attempts, count(*) FILTER (WHERE {_VALID}) AS valid FROM augmented GROUP BY source)")
def success_rate(spark, d):
    t = F.col("text")
    return S.success(table(spark, d, "augmented"), A.acceptable(t) & A.long_enough(t), "source")


@query("SELECT user_id, max(value) AS largest, min(value) AS least, round(avg(value), 6) AS mean, arg_min(event_type, (-value, event_type)) AS largest_name FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id")
def norm_figures(spark, d):
    return S.norms(table(spark, d, "events").where("value is not null and event_type is not null"), "user_id", "event_type", "value")


@query("WITH n AS (SELECT max(event_id % 1000) + 1 AS steps FROM events) SELECT event_id, (event_id // 1000 * steps + event_id % 1000)::BIGINT AS global_step FROM events, n")
def global_steps(spark, d):
    e = table(spark, d, "events")
    steps = e.agg(F.max(F.col("event_id") % 1000) + 1).first()[0] or 1
    return e.select("event_id", V.global_step(F.floor(F.col("event_id") / 1000), F.col("event_id") % 1000, steps).cast("long").alias("global_step"))


_DAYS = "(SELECT ts::DATE AS epoch, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds FROM events WHERE ts IS NOT NULL GROUP BY ALL)"


@query(f"SELECT epoch, seconds, round(avg(seconds) OVER w, 6) AS mean_seconds, round(avg(seconds) OVER w * greatest(0, 100 - row_number() OVER (ORDER BY epoch)), 4) AS eta_seconds FROM {_DAYS} WINDOW w AS (ORDER BY epoch ROWS UNBOUNDED PRECEDING)")
def remaining_time(spark, d):
    ts = F.col("ts").cast("timestamp")
    days = table(spark, d, "events").where("ts is not null").groupBy(F.to_date(ts).alias("epoch")).agg(((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1_000_000.0).alias("seconds"))
    return V.remaining(days, "seconds", "epoch", 100)


@query("SELECT lang, n, round(none * 100.0::DOUBLE / n, 4) AS non_toxic, " + ", ".join(f"round({x} * 100.0::DOUBLE / n, 4) AS {x}" for x in LABELS) + " FROM (SELECT lang, count(*) AS n, count(*) FILTER (WHERE " + " AND ".join(f"coalesce({x}, 0) <= 0" for x in LABELS) + ") AS none, " + ", ".join(f"count(*) FILTER (WHERE {x} > 0) AS {x}" for x in LABELS) + " FROM split GROUP BY lang)")
def stacked_shares(spark, d):
    return S.stacked_shares(_split(spark, d), "lang", LABELS)


_ROC = f"""
WITH c AS (SELECT label, p, count(*) FILTER (WHERE y = 1) AS u, count(*) FILTER (WHERE y <> 1) AS v FROM {_PRED} GROUP BY label, p),
s AS (SELECT label, p, sum(u) OVER w AS tp, sum(v) OVER w AS fp, sum(u) OVER (PARTITION BY label) AS a, sum(v) OVER (PARTITION BY label) AS n FROM c WINDOW w AS (PARTITION BY label ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT label, p, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / a, 6) AS tpr FROM s WHERE a > 0 AND n > 0),
k AS (SELECT *, coalesce(lag(fpr) OVER o, 0) AS lf, coalesce(lag(tpr) OVER o, 0) AS lt, lead(fpr) OVER o AS rf, lead(tpr) OVER o AS rt FROM r WINDOW o AS (PARTITION BY label ORDER BY p DESC))"""


@query(_ROC + """ SELECT label, p, fpr, tpr FROM k WHERE rf IS NULL OR abs((fpr - lf) * (rt - tpr) - (rf - fpr) * (tpr - lt)) > 1e-12
UNION ALL SELECT DISTINCT label, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM r""")
def roc_corners(spark, d):
    return M.roc_corners(M.roc(_pred(spark, d), "label"), "label")


# --- dynamic weights ---------------------------------------------------------

_RUN = f"""
WITH r AS (SELECT date_trunc('week', created_at)::TIMESTAMP AS batch, s.lang, t.label, t.v FROM split s, LATERAL (VALUES {_VALUES}) t(label, v) WHERE s.lang IN ({", ".join(f"'{x}'" for x in LANGS)}) AND created_at IS NOT NULL),
c AS (SELECT batch, lang, label, count(*) AS n, count(*) FILTER (WHERE v > 0) AS pos, row_number() OVER (PARTITION BY lang, label ORDER BY batch) AS i FROM r GROUP BY batch, lang, label),
h AS (SELECT a.batch, a.lang, a.label, a.n, a.pos, sum(0.05::DOUBLE * pow(0.95::DOUBLE, a.i - b.i) * b.pos) AS hp, sum(0.05::DOUBLE * pow(0.95::DOUBLE, a.i - b.i) * b.n) AS hn
FROM c a JOIN c b ON a.lang = b.lang AND a.label = b.label AND b.i <= a.i GROUP BY ALL),
z AS (SELECT *, 0.7::DOUBLE * hp / (hn + 1e-7) + 0.3::DOUBLE * pos / n + 1e-7 AS share FROM h)"""
_ADJUST = "CASE lang || '|' || label " + " ".join(f"WHEN '{x}|{y}' THEN {v}::DOUBLE" for x, vs in W.ADJUSTMENTS.items() for y, v in zip(LABELS, vs)) + " ELSE 1.0::DOUBLE END"
SQL["dynamic_weights"] = _RUN + f""",
w AS (SELECT z.*, exp(greatest(-2.0::DOUBLE, least(2.0::DOUBLE, ln(1 + 1 / share)))) * {_ADJUST} * coalesce(k.scale, 1.0::DOUBLE) AS w FROM z LEFT JOIN (SELECT lang AS l, round(avg(weight_1), 6) AS scale FROM class_weights GROUP BY lang) k ON k.l = z.lang),
m AS (SELECT batch, sum(w * n) / sum(n) AS mean FROM w GROUP BY batch)
SELECT w.batch, lang, label, n, pos, round(greatest(0.1::DOUBLE, least(10.0::DOUBLE, w.w / m.mean)), 6) AS weight FROM w JOIN m ON w.batch = m.batch"""


@query(_RUN + " SELECT batch, label, round(sum(1 / greatest(0.05::DOUBLE, least(0.95::DOUBLE, share)) * n) / sum(n), 6) AS alpha, round(sum(greatest(1.0::DOUBLE, least(4.0::DOUBLE, ln(1 + 1 / share))) * n) / sum(n), 6) AS gamma FROM z GROUP BY batch, label")
def dynamic_focal(spark, d):
    rows = _split(spark, d).where(F.col("lang").isin(*LANGS) & F.col("created_at").isNotNull()).withColumn("batch", F.date_trunc("week", "created_at"))
    return W.dynamic_focal(rows, "batch", "batch", LABELS)

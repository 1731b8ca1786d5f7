"""The registered queries of the library's own operators, and their SQL.

There are no photographs among the given tables: embeddings stand in for model outputs, line items for measured cues, and
parts seed small rasters that Spark and SQL derive by one integer formula."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared_folder
from ..functions import names, vector
from ..operators import gate, knowledge, ood, raster, scoring
from ..sources.synthetic import dealt
from ..streaming import events as ev

SIDE = 16
_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _logits(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", "label", F.slice(F.col("embedding").cast("array<double>"), 1, 10).alias("logits"))


_L = "l AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS z FROM embeddings), e AS (SELECT *, list_transform(z, lambda x: exp(x / {t} - list_max(z) / {t})) AS e FROM l), p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"
_KB = "k(class_id, class, disease_name, pathogen_type, control_category) AS (VALUES " + ", ".join(f"({i}, " + ", ".join(f"'{v}'" for v in x) + ")" for i, x in enumerate(knowledge.CLASSES)) + ")"
_LEVEL = "CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.6 THEN 'moderate' ELSE 'low' END"


@query(f"WITH {_L.format(t='0.25')}, r AS (SELECT vec_id, i - 1 AS class_id, p[i] AS conf, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS n FROM p, range(1, 11) t(i)), {_KB} SELECT vec_id, class_id::INT AS class_id, class, disease_name, control_category, round(conf, 6) AS confidence, conf >= 0.6 AS confident, contains(lower(class), 'healthy') AS healthy, {_LEVEL} AS advice_level FROM r JOIN k USING (class_id) WHERE n = 1")
def class_advice(spark, d):
    out = knowledge.with_advice(scoring.classify(_logits(spark, d), temperature=0.25))
    return out.select("vec_id", "class_id", "class", "disease_name", "control_category", F.round("confidence", 6).alias("confidence"), "confident", scoring.healthy("class").alias("healthy"), scoring.advice_level("confidence").alias("advice_level"))


@query(f"WITH {_L.format(t='1.5')}, r AS (SELECT vec_id, i - 1 AS class_id, p[i] AS conf, row_number() OVER (PARTITION BY vec_id ORDER BY p[i] DESC, i) AS rank FROM p, range(1, 11) t(i)) SELECT vec_id, rank::INT AS rank, class_id::INT AS class_id, round(conf, 6) AS probability FROM r WHERE rank <= 5")
def softmax_topk(spark, d):
    out = scoring.classify(_logits(spark, d), temperature=1.5).select("vec_id", F.posexplode("top").alias("pos", "x"))
    return out.select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("x.i").alias("class_id"), F.round("x.p", 6).alias("probability"))


@query(f"WITH {_L.format(t='1.0')} SELECT vec_id, round(-(list_max(z) + ln(list_sum(e))), 6) AS energy, round(list_max(p), 6) AS msp FROM p")
def energy_score(spark, d):
    return _logits(spark, d).select("vec_id", F.round(vector.energy("logits"), 6).alias("energy"), F.round(F.array_max(vector.softmax("logits")), 6).alias("msp"))


@query("SELECT label, (i - 1)::INT AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean, count(*) AS n FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def class_means(spark, d):
    return ood.class_means(_t(spark, d, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6))


@query("""WITH x AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)), m AS (SELECT label AS c, i, avg(v) AS m FROM x GROUP BY ALL), o AS (SELECT i, avg(v) AS m FROM x GROUP BY i),
dc AS (SELECT vec_id, c, sum((v - m) * (v - m)) AS d FROM x JOIN m USING (i) GROUP BY ALL), d0 AS (SELECT vec_id, sum((v - m) * (v - m)) AS d0 FROM x JOIN o USING (i) GROUP BY ALL)
SELECT vec_id, arg_min(c, d) AS nearest, round(min(d), 6) AS distance, round(min(d) - any_value(d0), 6) AS rmd FROM dc JOIN d0 USING (vec_id) GROUP BY vec_id""")
def rmd_identity(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    means = ood.mean_table(rows, "label", "embedding")
    overall = ood.mean_table(rows.withColumn("label", F.lit(0)), "label", "embedding")[0][1]
    out = ood.relative_mahalanobis(rows, "embedding", means, overall)
    return out.select("vec_id", "nearest", F.round("distance", 6).alias("distance"), F.round("rmd", 6).alias("rmd"))


@query()
def rmd_ledoit_wolf(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", "label", "embedding")
    means = ood.mean_table(rows, "label", "embedding")
    table = F.create_map(*(x for k, m in means for x in (F.lit(k), F.array(*map(F.lit, m)))))
    _, within, _ = ood.ledoit_wolf(rows.select(F.zip_with(F.col("embedding").cast("array<double>"), table[F.col("label")], lambda a, b: a - b).alias("v")), "v")
    mu0, all_, _ = ood.ledoit_wolf(rows, "embedding")
    out = ood.relative_mahalanobis(rows, "embedding", means, list(map(float, mu0)), within, all_)
    return out.select("vec_id", "nearest", F.round("distance", 6).alias("distance"), F.round("rmd", 6).alias("rmd"))


@query("SELECT event_id, event_type, value, round(1 - (rank() OVER (PARTITION BY event_type ORDER BY value) - 1) / count(*) OVER (PARTITION BY event_type), 9) AS p FROM events")
def ecdf_pvalue(spark, d):
    out = ood.p_values(_t(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "value")
    return out.withColumn("p", F.round("p", 9))


@query("""WITH s AS (SELECT n_chars AS s, quality = 1 AS good FROM labels JOIN documents USING (doc_id)), i AS (SELECT s FROM s WHERE good), o AS (SELECT s FROM s WHERE NOT good)
SELECT round((SELECT avg(CASE WHEN i.s > o.s THEN 1.0 WHEN i.s = o.s THEN 0.5 ELSE 0.0 END) FROM i, o), 9) AS auroc, round((SELECT avg(CASE WHEN s >= (SELECT quantile_cont(s, 0.05) FROM i) THEN 1.0 ELSE 0.0 END) FROM o), 9) AS fpr95, (SELECT count(*) FROM i) AS n_in, (SELECT count(*) FROM o) AS n_out""")
def ood_report(spark, d):
    rows = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("n_chars").alias("s"), (F.col("quality") == 1).alias("good"))
    return ood.separation(rows, "s", "good").withColumn("auroc", F.round("auroc", 9)).withColumn("fpr95", F.round("fpr95", 9))


_CUES = {
    "coverage": "l_discount * 10", "green_frac": "l_tax * 12.5", "leafcolor_frac": "0.5 + l_tax * 6", "solidity": "l_quantity / 50", "elongation": "1 + l_quantity / 8", "convexity_ratio": "1 + l_discount * 9",
    "serration": "l_discount * 10", "vein_ridge": "l_extendedprice / 5000", "texture_energy": "l_extendedprice / 3000", "orientation_coherence": "l_tax * 10", "boundary_contrast": "l_quantity", "texture_contrast": "l_tax * 4",
    "skin_like_frac": "l_tax * 4.5", "n_margin_teeth": "l_linenumber - 1", "green_background": "l_returnflag = 'N'", "segmentation": "CASE WHEN l_linestatus = 'O' AND l_quantity < 2 THEN 'no_leaf_found' ELSE 'ok' END",
    "ood_gate_prob": "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 50 END", "maha_score": "1 - l_tax * 5", "energy_score": "l_discount * 9", "msp": "CASE WHEN l_returnflag = 'A' THEN NULL ELSE 0.5 + l_tax * 4 END",
}
_THRESHOLDS = {"ood_gate_prob": 0.1, "maha_score": 0.7, "energy_score": 0.05}
_C = "c AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{v} AS {k}" for k, v in _CUES.items()) + " FROM lineitem)"


def _cues(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(v).alias(k) for k, v in _CUES.items()))


def _band_sql(k: str) -> str:
    if k == "serration":
        return "(0.4::DOUBLE + 0.6::DOUBLE * coalesce(serration, 0))"
    low, high, soft = gate.BANDS[k]
    return f"greatest(0::DOUBLE, 1 - greatest({low}::DOUBLE - {k}, {k} - {high}::DOUBLE, 0::DOUBLE) / {soft}::DOUBLE)"


@query("WITH " + _C + " SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({_band_sql(k)}, 6) AS s_{k}" for k in gate.WEIGHTS) + ", round(" + " + ".join(f"{w}::DOUBLE * {_band_sql(k)}" for k, w in gate.WEIGHTS.items()) + ", 6) AS heuristic FROM c")
def band_scores(spark, d):
    return _cues(spark, d).select("l_orderkey", "l_linenumber", *(F.round(x, 6).alias(f"s_{k}") for k, x in gate.cue_scores().items()), F.round(gate.heuristic_score(), 6).alias("heuristic"))


_DEEP3 = {k: w for k, w in gate.DEEP.items() if k in _THRESHOLDS}


@query("WITH " + _C + ", h AS (SELECT *, (" + " + ".join(f"{w}::DOUBLE * {_band_sql(k)}" for k, w in gate.WEIGHTS.items()) + ") * CASE WHEN green_background AND boundary_contrast < 11 AND texture_contrast < 0.15 THEN 0.85::DOUBLE ELSE 1 END AS heuristic, ("
    + " + ".join(f"coalesce({k} * {w}::DOUBLE, 0)" for k, w in _DEEP3.items()) + ") / (" + " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w}::DOUBLE END" for k, w in _DEEP3.items()) + ") AS deep FROM c), f AS (SELECT *, heuristic * (1 - 0.6::DOUBLE) + deep * 0.6::DOUBLE AS confidence FROM h) "
    "SELECT l_orderkey, l_linenumber, round(heuristic, 6) AS heuristic, round(deep, 6) AS deep, round(confidence, 6) AS confidence, CASE WHEN segmentation = 'no_leaf_found' OR coverage < 0.04 OR green_frac < 0.12 THEN 'no_leaf' WHEN skin_like_frac > 0.35 THEN 'skin' WHEN solidity < 0.40 THEN 'not_leaf_structure' "
    "WHEN vein_ridge < 1.2 AND texture_energy < 1.0 THEN 'featureless_object' WHEN solidity > 0.975 AND n_margin_teeth <= 1 AND convexity_ratio < 1.06 THEN 'geometric_shape' WHEN " + " OR ".join(f"{k} < {v}" for k, v in _THRESHOLDS.items()) + " THEN 'not_tomato' WHEN confidence < 0.62 THEN 'low_confidence' END AS veto FROM f")  # fmt: skip
def gate_cascade(spark, d):
    out = gate.decide(_cues(spark, d), _THRESHOLDS)
    return out.select("l_orderkey", "l_linenumber", *(F.round(k, 6).alias(k) for k in ("heuristic", "deep", "confidence")), "veto")


_METRICS = "count(*) * 40 AS height, count(*) * 50 AS width, stddev_pop(l_extendedprice) / 2000 AS std, var_pop(l_quantity) AS sharpness, avg(l_extendedprice) / 150 AS mean, avg(CASE WHEN l_discount < 0.02 THEN 1.0 ELSE 0.0 END) AS dark, avg(CASE WHEN l_tax > 0.06 THEN 1.0 ELSE 0.0 END) AS bright"


@query(f"WITH m AS (SELECT l_orderkey, {_METRICS} FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN least(height, width) < 64 THEN 'resolution_too_low' WHEN std < 3 THEN 'blank_or_solid_colour' WHEN sharpness < 12 THEN 'too_blurry' WHEN mean < 18 OR dark > 0.8 THEN 'too_dark' WHEN mean > 245 OR bright > 0.8 THEN 'overexposed' END AS reason, round(std, 9) AS std, round(sharpness, 6) AS sharpness FROM m")
def quality_check(spark, d):
    """Spreads decide at bounds that whole numbers meet exactly, so they are summed in the order of the lines, not in that of partial sums."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_quantity")))
    spread = {"stddev_pop(l_extendedprice) / 2000 AS std": F.sqrt(vector.variance(F.transform(lines, lambda x: x["l_extendedprice"]))) / 2000, "var_pop(l_quantity) AS sharpness": vector.variance(F.transform(lines, lambda x: x["l_quantity"]))}
    m = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(*(spread[x].alias(x.split(" AS ")[1]) if x in spread else F.expr(x) for x in _METRICS.split(", ")))
    return m.select("l_orderkey", gate.quality_reason().alias("reason"), F.round("std", 9).alias("std"), F.round("sharpness", 6).alias("sharpness"))


_V = "v AS (SELECT user_id, event_type AS class, value AS conf, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events)"


@query(f"""WITH {_V}, c AS (SELECT user_id, class, sum(conf) AS weight, count(*) AS agree, min(ord) AS first FROM v GROUP BY ALL),
b AS (SELECT *, sum(agree) OVER (PARTITION BY user_id) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, first) AS r FROM c),
m AS (SELECT v.user_id, v.ord, row_number() OVER (PARTITION BY v.user_id ORDER BY v.ord = 0 DESC, v.conf DESC, v.ord) AS r FROM v JOIN b ON b.r = 1 AND v.user_id = b.user_id AND v.class = b.class)
SELECT b.user_id, b.class AS winner, round(weight, 4) AS weight, agree, votes::BIGINT AS votes, m.ord::BIGINT AS main FROM b JOIN m ON b.user_id = m.user_id AND b.r = 1 AND m.r = 1""")
def consensus_vote(spark, d):
    votes = _t(spark, d, "events").select("user_id", F.col("event_type").alias("class"), F.col("value").alias("conf"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("ord"))
    return scoring.consensus(votes, "user_id", "class", "conf", "ord").withColumn("weight", F.round("weight", 4))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type, r::INT AS place, contains(lower(concat_ws(' ', event_type, props)), 'click') AS found FROM r WHERE r <= 25")
def history_cap(spark, d):
    out = scoring.newest(_t(spark, d, "events"), "user_id", F.desc("ts"), F.desc("event_id"))
    return out.select("user_id", "event_id", "event_type", F.col("r").alias("place"), F.contains(F.lower(F.concat_ws(" ", "event_type", "props")), F.lit("click")).alias("found"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type FROM r WHERE r <= 25")
def history_stream(spark, d):
    root = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    schema = _t(spark, d, "events").schema  # a stream takes a path with a pattern as a file or a folder, one without as a folder
    out = ev.history_stream(spark, d, "events.parque[t]", schema, "user_id", ["ts", "event_id"], f"{root}/out", f"{root}/checkpoint")
    return out.select("user_id", "event_id", "event_type")


@query("WITH m AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, turn, CASE WHEN turn = n - 1 THEN 'result' ELSE 'progress' END AS type, (40 + floor(45 * turn / n))::INT AS pct, length(text) AS chars FROM conversations JOIN m USING (conv_id)")
def event_progress(spark, d):
    rows = _t(spark, d, "conversations")
    n = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    out = rows.join(n, "conv_id")
    return out.select("conv_id", "turn", F.when(F.col("turn") == F.col("n") - 1, "result").otherwise("progress").alias("type"), ev.progress(F.col("turn"), F.col("n")).alias("pct"), F.length("text").cast("long").alias("chars"))


@query("WITH m AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT to_json({'type': CASE WHEN turn = n - 1 THEN 'result' ELSE 'progress' END, 'conv_id': conv_id, 'turn': turn, 'pct': (40 + floor(45 * turn / n))::INT, 'detail': NULL})::VARCHAR AS value FROM conversations JOIN m USING (conv_id)")
def event_ndjson(spark, d):
    out = event_progress(spark, d).withColumn("detail", F.lit(None).cast("string"))
    return ev.lines(out, ["type", "conv_id", "turn", "pct", "detail"])


@query("SELECT page_id, lower(CASE WHEN contains(f, '.') THEN regexp_extract(f, '([^.]*)$', 1) END) AS extension, coalesce(lower(CASE WHEN contains(f, '.') THEN regexp_extract(f, '([^.]*)$', 1) END) IN ('png', 'jpg', 'jpeg', 'webp', 'bmp'), true) AS accepted FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS f FROM pages)")
def ext_filter(spark, d):
    name = F.substring_index("url", "/", -1)
    return _t(spark, d, "pages").select("page_id", names.extension(name).alias("extension"), names.accepted(name).alias("accepted"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes, to_base64(encode(text)) AS content64 FROM documents")
def file_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"\s", "").alias("content64"))


@query(f"WITH {_KB}, e AS (SELECT vec_id, label FROM embeddings), s AS (SELECT vec_id, trim(replace(replace(replace(class, 'Tomato___', ''), '_', ' '), '  ', ' ')) AS s FROM e JOIN k ON label = class_id) SELECT vec_id, upper(left(x, 1)) || substr(x, 2) AS name FROM (SELECT vec_id, replace(s, 'Spider mites Two-spotted spider mite', 'Spider mites (two-spotted)') AS x FROM s)")
def pretty_names(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", F.col("label").alias("class_id"))
    return rows.join(F.broadcast(knowledge.classes(spark)), "class_id").select("vec_id", names.pretty("class").alias("name"))


_M = "k(ord, model, kind) AS (VALUES " + ", ".join(f"({i}, '{m}', '{k}')" for i, (m, k) in enumerate(knowledge.MODELS)) + ")"
_MODEL_OF = "CASE p_size % 11 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (m, _) in enumerate(knowledge.MODELS) if i != 5) + " ELSE 'Extra_' || p_size % 11 END"


@query(f"WITH {_M}, f AS (SELECT {_MODEL_OF} AS model, round(sum(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE 0 END), 4) AS a, round(sum(CASE WHEN p_partkey % 2 = 1 THEN p_retailprice ELSE 0 END), 4) AS b FROM part GROUP BY 1) SELECT coalesce(k.model, f.model) AS model, ord, coalesce(kind, 'other') AS kind, k.model IS NOT NULL AS listed, round(nullif(coalesce(a, 0) + coalesce(b, 0), 0), 3) AS size_mb FROM k FULL JOIN f USING (model)")
def models_registry(spark, d):
    half = lambda n: F.round(F.sum(F.when(F.col("p_partkey") % 2 == n, F.col("p_retailprice")).otherwise(0.0)), 4)
    files = _t(spark, d, "part").groupBy(F.expr(_MODEL_OF).alias("model")).agg(half(0).alias("trunk_mb"), half(1).alias("head_mb"))
    return knowledge.registry(files).withColumn("size_mb", F.round("size_mb", 3))


@query(f"WITH {_KB} SELECT e.label AS class_id, disease_name, pathogen_type, count(*) AS rows, sum(CASE WHEN pathogen_type = 'viral' THEN 1 ELSE 0 END)::BIGINT AS viral FROM embeddings e JOIN k ON label = class_id GROUP BY ALL")
def class_lookup(spark, d):
    rows = knowledge.with_advice(_t(spark, d, "embeddings").select(F.col("label").alias("class_id")))
    return rows.groupBy("class_id", "disease_name", "pathogen_type").agg(F.count("*").alias("rows"), F.sum((F.col("pathogen_type") == "viral").cast("long")).alias("viral"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN contains(c, '.') AND abs(try_cast(c AS DOUBLE)) <= 1 THEN printf('%.2f', try_cast(c AS DOUBLE) * 100) || '%' ELSE c END AS cell FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE l_discount::VARCHAR END AS c FROM lineitem)")
def csv_cells(spark, d):
    cell = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).otherwise(F.col("l_discount").cast("string"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("c")).select("l_orderkey", "l_linenumber", names.percent_cell(F.col("c")).alias("cell"))


# Rasters: an image of SIDE x SIDE pixels for each part.
_PX = f"px AS (SELECT p_partkey AS image_id, (i // {SIDE})::INT AS y, (i % {SIDE})::INT AS x, ((p_partkey * 7 + i * 13 + (i // {SIDE}) * 29) % 256)::INT AS b, ((p_partkey * 11 + i * 17 + (i % {SIDE}) * 31) % 256)::INT AS g, ((p_partkey * 5 + i * 23 + (i // 7) * 3) % 256)::INT AS r, ((p_partkey * 31 + (i // {SIDE}) * (i % {SIDE}) * 7 + i * 3) % 97) / 97.0::DOUBLE AS heat, ((p_partkey + (i // {SIDE} // 2) * 5 + (i % {SIDE} // 3) * 7 + (i // {SIDE}) * (i % {SIDE})) % 10) < 6 AS leaf FROM part, range(0, {SIDE * SIDE}) t(i))"


def _pixels(spark, d) -> DataFrame:
    p, i = F.col("p_partkey"), F.col("i")
    y, x = (i / SIDE).cast("int"), i % SIDE
    rows = dealt(_t(spark, d, "part").select("p_partkey"), "p_partkey", SIDE * SIDE).select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("i"))
    return rows.select(
        p.alias("image_id"), y.alias("y"), x.alias("x"), ((p * 7 + i * 13 + y * 29) % 256).cast("int").alias("b"), ((p * 11 + i * 17 + x * 31) % 256).cast("int").alias("g"), ((p * 5 + i * 23 + (i / 7).cast("int") * 3) % 256).cast("int").alias("r"),
        (((p * 31 + y * x * 7 + i * 3) % 97) / F.lit(97.0)).alias("heat"), ((p + (y / 2).cast("int") * 5 + (x / 3).cast("int") * 7 + y * x) % 10 < 6).alias("leaf"),
    )


def _sized(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})


_LINEAR = "CASE WHEN {0} <= 0.04045::DOUBLE * 255 THEN {0} / 255 / 12.92::DOUBLE ELSE pow(({0} / 255 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
_CURVE = "CASE WHEN {0} > 0.008856::DOUBLE THEN cbrt({0}) ELSE {0} * 7.787::DOUBLE + 16::DOUBLE / 116 END AS f{0}"
_LAB = (
    f"li AS (SELECT *, {_LINEAR.format('r')} AS rl, {_LINEAR.format('g')} AS gl, {_LINEAR.format('b')} AS bl FROM h), xy AS (SELECT *, (rl * 0.412453::DOUBLE + gl * 0.357580::DOUBLE + bl * 0.180423::DOUBLE) / 0.950456::DOUBLE AS xx, rl * 0.212671::DOUBLE + gl * 0.715160::DOUBLE + bl * 0.072169::DOUBLE AS yy, (rl * 0.019334::DOUBLE + gl * 0.119193::DOUBLE + bl * 0.950227::DOUBLE) / 1.088754::DOUBLE AS zz FROM li), "
    f"cu AS (SELECT *, {_CURVE.format('xx')}, {_CURVE.format('yy')}, {_CURVE.format('zz')} FROM xy), lb AS (SELECT *, floor((fyy * 116 - 16) * 2.55::DOUBLE + 0.5::DOUBLE)::INT AS lab_l, floor((fxx - fyy) * 500 + 0.5::DOUBLE)::INT AS lab_a, floor((fyy - fzz) * 200 + 0.5::DOUBLE)::INT AS lab_b FROM cu)"
)
_HSV = f"{_PX}, v AS (SELECT *, greatest(r, g, b)::DOUBLE AS v, greatest(r, g, b)::DOUBLE - least(r, g, b) AS span FROM px), hh AS (SELECT *, CASE WHEN span = 0 THEN 0::DOUBLE WHEN v = r THEN (g - b) * 30 / span WHEN v = g THEN 60 + (b - r) * 30 / span ELSE 120 + (r - g) * 30 / span END AS h0 FROM v), h AS (SELECT *, (floor(CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END + 0.5::DOUBLE) % 180)::INT AS h, floor(CASE WHEN v = 0 THEN 0 ELSE span * 255 / v END + 0.5::DOUBLE)::INT AS s, (2 * (g / (r + g + b + 1e-6::DOUBLE)) - r / (r + g + b + 1e-6::DOUBLE) - b / (r + g + b + 1e-6::DOUBLE)) - (1.4::DOUBLE * (r / (r + g + b + 1e-6::DOUBLE)) - g / (r + g + b + 1e-6::DOUBLE)) AS exgr FROM hh), {_LAB}, m AS (SELECT *, h BETWEEN 22 AND 95 AND s >= 28 AND v >= 28 AND (exgr > -0.03 OR lab_a < -7) AS green, (h < 25 OR h >= 165) AND s >= 25 AND s < 170 AND v >= 30 AND v < 200 AND exgr < -0.05 AS soil, s < 32 AND v >= 45 AS stone, (h >= 14 AND h < 35 AND s >= 55 AND v >= 70) OR ((h < 22 OR h >= 165) AND s >= 45 AND v BETWEEN 25 AND 215) OR (v >= 15 AND v < 90 AND s >= 40 AND lab_b > 2) AS lesion, (h < 20 OR h > 170) AND s > 40 AND s < 170 AND v > 80 AND lab_a > 8 AND lab_b > 8 AS skin FROM lb)"


@query(f"WITH {_HSV} SELECT image_id, sum(green::INT)::BIGINT AS green, sum(soil::INT)::BIGINT AS soil, sum(stone::INT)::BIGINT AS stone, sum(lesion::INT)::BIGINT AS lesion, sum((green OR lesion)::INT)::BIGINT AS leafcolor, sum((leaf AND NOT lesion)::INT)::BIGINT AS clean, round(stddev_pop(h), 6) AS hue_std FROM m GROUP BY image_id")
def pixel_color_masks(spark, d):
    m = raster.with_masks(_pixels(spark, d))
    n = lambda c, a: F.sum(c.cast("long")).alias(a)
    return m.groupBy("image_id").agg(*(n(F.col(k), k) for k in ("green", "soil", "stone", "lesion")), n(F.col("green") | F.col("lesion"), "leafcolor"), n(F.col("leaf") & ~F.col("lesion"), "clean"), F.round(F.stddev_pop("h"), 6).alias("hue_std"))


@query(f"WITH {_HSV}, s AS (SELECT image_id, avg(green::INT) AS green, avg(soil::INT) AS soil, avg((stone AND NOT soil)::INT) AS stone FROM m WHERE NOT leaf GROUP BY image_id) SELECT image_id, round(green, 6) AS green, round(soil, 6) AS soil, round(stone, 6) AS stone, round(greatest(0, 1 - green - soil - stone), 6) AS other FROM s")
def bg_composition(spark, d):
    out = raster.composition(raster.with_masks(_pixels(spark, d).filter(~F.col("leaf"))))
    return out.select("image_id", *(F.round(k, 6).alias(k) for k in ("green", "soil", "stone", "other")))


_CC = "{name}(image_id, y, x, label) AS (SELECT image_id, y, x, y * " + str(SIDE) + " + x + 1 FROM {of} UNION SELECT p.image_id, p.y, p.x, c.label FROM {name} c JOIN {of} p ON p.image_id = c.image_id AND {near} AND p.y * " + str(SIDE) + " + p.x + 1 > c.label)"
_FOUR, _EIGHT = "abs(p.y - c.y) + abs(p.x - c.x) = 1", "abs(p.y - c.y) <= 1 AND abs(p.x - c.x) <= 1"


@query(f"WITH RECURSIVE {_PX}, on_ AS (SELECT image_id, y, x FROM px WHERE leaf), {_CC.format(name='cc', of='on_', near=_FOUR)}, l AS (SELECT image_id, y, x, min(label) AS label FROM cc GROUP BY ALL) SELECT image_id, label, count(*) AS area FROM l GROUP BY image_id, label")
def component_labels(spark, d):
    return raster.components(_pixels(spark, d), "leaf", frame=SIDE).groupBy("image_id", "label").agg(F.count("*").alias("area"))


@query(f"WITH RECURSIVE {_PX}, on_ AS (SELECT image_id, y, x FROM px WHERE leaf), {_CC.format(name='cc', of='on_', near=_EIGHT)}, l AS (SELECT image_id, y, x, min(label) AS label FROM cc GROUP BY ALL) SELECT image_id, label::BIGINT AS label, count(*) AS area, sum(y * {SIDE} + x)::BIGINT AS places FROM l GROUP BY image_id, label")
def tiled_labels(spark, d):
    """Components across tiles of 5 x 5 pixels: labels of each tile, joined along the borders and closed."""
    out = raster.components(_pixels(spark, d), "leaf", eight=True, tile=5)
    return out.groupBy("image_id", "label").agg(F.count("*").alias("area"), F.sum((F.col("y") * SIDE + F.col("x")).cast("long")).alias("places"))


@query(f"WITH RECURSIVE {_PX}, off_ AS (SELECT image_id, y, x FROM px WHERE NOT leaf), {_CC.format(name='cc', of='off_', near=_FOUR)}, l AS (SELECT image_id, y, x, min(label) AS label FROM cc GROUP BY ALL), o AS (SELECT DISTINCT image_id, label FROM l WHERE y IN (0, {SIDE - 1}) OR x IN (0, {SIDE - 1})), f AS (SELECT image_id FROM px WHERE leaf UNION ALL SELECT l.image_id FROM l ANTI JOIN o ON l.image_id = o.image_id AND l.label = o.label) SELECT image_id, count(*) AS filled FROM f GROUP BY 1")
def fill_holes(spark, d):
    return raster.fill_holes(_pixels(spark, d), "leaf", frame=SIDE).groupBy("image_id").agg(F.count("*").alias("filled"))


@query(f"WITH RECURSIVE {_PX}, on_ AS (SELECT image_id, y, x FROM px WHERE leaf), {_CC.format(name='cc', of='on_', near=_EIGHT)}, l AS (SELECT image_id, y, x, min(label) AS label FROM cc GROUP BY ALL), g AS (SELECT l.image_id, label, min(l.x) AS x0, min(l.y) AS y0, max(l.x) AS x1, max(l.y) AS y1, count(*) AS area, sum(heat) AS mass FROM l JOIN px ON l.image_id = px.image_id AND l.y = px.y AND l.x = px.x GROUP BY ALL), s AS (SELECT *, mass / (sum(mass) OVER (PARTITION BY image_id) + 1e-8) AS share, row_number() OVER (PARTITION BY image_id ORDER BY round(mass, 9) DESC, label) AS rank FROM g WHERE area >= 25) SELECT image_id, label, x0, y0, x1, y1, area, round(mass, 6) AS mass, round(share, 6) AS share, rank::INT AS rank FROM s WHERE rank <= 5")
def region_stats(spark, d):
    px = _pixels(spark, d)
    out = raster.regions(raster.components(px, "leaf", eight=True, keep=("heat",), frame=SIDE), "heat")
    return out.withColumn("mass", F.round("mass", 6)).withColumn("share", F.round("share", 6))


_WIDE = "d1 AS (SELECT *, leaf AND lesion AS ill, max((leaf AND lesion)::INT) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS w1 FROM m), d2 AS (SELECT *, max(w1) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) = 1 AS wide FROM d1)"


@query(f"WITH {_HSV}, {_WIDE}, q AS (SELECT image_id, quantile_cont(heat, 0.9) AS cut FROM m GROUP BY 1), a AS (SELECT image_id, sum(CASE WHEN leaf THEN heat ELSE 0 END) / (sum(heat) + 1e-8) AS on_leaf, sum(CASE WHEN ill THEN heat ELSE 0 END) / (sum(heat) + 1e-8) AS ol, first(leaf ORDER BY heat DESC, y, x) AS peak_on_leaf, first(wide ORDER BY heat DESC, y, x) AS pl, avg(leaf::INT) FILTER (WHERE heat >= cut) AS top_on_leaf, avg(wide::INT) FILTER (WHERE heat >= cut) AS tl, sum(ill::INT) AS lesions, sum(leaf::INT) AS leaves FROM d2 JOIN q USING (image_id) GROUP BY image_id), s AS (SELECT *, CASE WHEN lesions > 20 THEN lesions / greatest(leaves, 1) ELSE 0 END AS share FROM a) SELECT image_id, round(on_leaf, 6) AS on_leaf, peak_on_leaf, round(top_on_leaf, 6) AS top_on_leaf, CASE WHEN lesions > 20 THEN round(ol, 6) END AS on_lesion, CASE WHEN lesions > 20 THEN pl END AS peak_on_lesion, CASE WHEN lesions > 20 THEN round(tl, 6) END AS top_on_lesion, round(share, 6) AS lesion_share, CASE WHEN lesions > 20 THEN round((ol / greatest(on_leaf, 1e-6)) / greatest(share, 1e-6), 6) END AS enrichment FROM s")
def focus_metrics(spark, d):
    out = raster.focus(_sized(raster.with_masks(_pixels(spark, d))), "heat", "leaf", "lesion", frame=SIDE)
    for k in ("on_leaf", "top_on_leaf", "on_lesion", "top_on_lesion", "lesion_share", "enrichment"):
        out = out.withColumn(k, F.round(k, 6))
    return out


@query("SELECT vec_id, round((list_reduce(list_transform(embedding, lambda v: v::DOUBLE), lambda a, b: greatest(a, b)) - list_reduce(list_transform(embedding, lambda v: v::DOUBLE), lambda a, b: least(a, b))), 6) AS spread, list_transform(embedding, lambda v: round((v::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE + 1e-8::DOUBLE), 6)) AS shown FROM embeddings")
def lesion_gate_display(spark, d):
    v = F.col("v")
    rows = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    shown = F.transform(v, lambda x: F.round((x - F.array_min(v)) / (F.array_max(v) - F.array_min(v) + 1e-8), 6))
    return rows.select("vec_id", F.round(F.array_max(v) - F.array_min(v), 6).alias("spread"), shown.alias("shown"))


@query(f"WITH {_HSV} SELECT image_id, sum((leaf OR green)::INT)::BIGINT AS either, sum((leaf AND green)::INT)::BIGINT AS both, sum((leaf AND NOT green)::INT)::BIGINT AS alone, round(coalesce(sum((leaf AND green)::INT) / nullif(sum((leaf OR green)::INT), 0), 0), 6)::DOUBLE AS iou FROM m GROUP BY image_id")
def mask_setops(spark, d):
    return raster.overlap(raster.with_masks(_pixels(spark, d)), "leaf", "green").withColumn("iou", F.round("iou", 6))


@query(f"WITH {_HSV} SELECT image_id, round(CASE WHEN image_id % 10 <> 9 THEN sum((leaf AND lesion)::INT) / nullif(sum(leaf::INT), 0) END, 6)::DOUBLE AS affected FROM m GROUP BY image_id")
def affected_area(spark, d):
    return raster.affected(raster.with_masks(_pixels(spark, d)), "leaf", "lesion", F.col("image_id") % 10 == 9).withColumn("affected", F.round("affected", 6))


@query(f"WITH RECURSIVE {_PX}, on_ AS (SELECT image_id, y, x FROM px WHERE leaf), {_CC.format(name='cc', of='on_', near=_FOUR)}, l AS (SELECT image_id, y, x, min(label) AS label FROM cc GROUP BY ALL), g AS (SELECT image_id, label, count(*) AS area, sum(heat) AS mass, sum(y * heat) AS sy, sum(x * heat) AS sx FROM l JOIN px USING (image_id, y, x) GROUP BY image_id, label), k AS (SELECT *, max(area) OVER (PARTITION BY image_id) AS most FROM g) SELECT image_id, label, area, round(mass, 6) AS mass, CASE WHEN mass <> 0 THEN round(sy / mass, 6) ELSE 'nan'::DOUBLE END AS cy, CASE WHEN mass <> 0 THEN round(sx / mass, 6) ELSE 'nan'::DOUBLE END AS cx FROM k WHERE area >= 0.15::DOUBLE * most")
def region_centres(spark, d):
    px = _pixels(spark, d)
    out = raster.centres(raster.components(px, "leaf", keep=("heat",), frame=SIDE), "heat")
    return out.withColumns({k: F.round(k, 6) for k in ("mass", "cy", "cx")})


@query(f"WITH {_PX}, e AS (SELECT image_id, avg(leaf::INT) FILTER (WHERE y = 0) AS a, avg(leaf::INT) FILTER (WHERE y = {SIDE - 1}) AS b, avg(leaf::INT) FILTER (WHERE x = 0) AS c, avg(leaf::INT) FILTER (WHERE x = {SIDE - 1}) AS d FROM px GROUP BY image_id) SELECT image_id, round((a + b + c + d) / 4, 6) AS contact, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0)::INT AS sides FROM e")
def edge_contact(spark, d):
    return raster.edge_contact(_pixels(spark, d), "leaf", SIDE, SIDE).withColumn("contact", F.round("contact", 6))


@query(f"WITH {_HSV}, t AS (SELECT image_id, b, g, r, CASE WHEN lesion THEN [0, 60, 255] WHEN leaf THEN [0, 200, 80] ELSE [0, 0, 0] END AS t FROM m) SELECT image_id, sum(round_even(b * 0.65::DOUBLE + t[1] * (1 - 0.65::DOUBLE), 0)::INT)::BIGINT AS b, sum(round_even(g * 0.65::DOUBLE + t[2] * (1 - 0.65::DOUBLE), 0)::INT)::BIGINT AS g, sum(round_even(r * 0.65::DOUBLE + t[3] * (1 - 0.65::DOUBLE), 0)::INT)::BIGINT AS r FROM t GROUP BY image_id")
def leaf_tint(spark, d):
    return raster.tinted(raster.with_masks(_pixels(spark, d)), "leaf", "lesion").groupBy("image_id").agg(*(F.sum(k).alias(k) for k in "bgr"))


@query(f"WITH {_HSV}, s AS (SELECT image_id, avg(green::INT) AS green, avg(soil::INT) AS soil, avg((stone AND NOT soil)::INT) AS stone FROM m GROUP BY image_id), o AS (SELECT *, greatest(0, 1 - green - soil - stone) AS other FROM s) SELECT image_id, CASE WHEN greatest(green, soil, stone, other) <= 0.55::DOUBLE THEN '{gate.NO_LEAF}' WHEN green >= greatest(soil, stone, other) THEN '{gate.BACKGROUNDS['green']}' WHEN soil >= greatest(stone, other) THEN '{gate.BACKGROUNDS['soil']}' WHEN stone >= other THEN '{gate.BACKGROUNDS['stone']}' ELSE '{gate.NO_LEAF}' END AS background FROM o")
def background_name(spark, d):
    return raster.composition(raster.with_masks(_pixels(spark, d))).select("image_id", gate.background_name().alias("background"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 < 0.03::DOUBLE THEN 'coverage_too_low_likely_failed_segmentation' WHEN l_discount * 10 > 0.97::DOUBLE THEN 'coverage_too_high_likely_no_background_present' WHEN l_quantity / 50 < 0.45::DOUBLE THEN 'low_segmentation_confidence' END AS reason FROM lineitem")
def segmentation_reliability(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("coverage"), (F.col("l_quantity") / 50).alias("confidence"))
    return rows.select("l_orderkey", "l_linenumber", gate.segmentation_reason().alias("reason"))


@query("SELECT event_id, user_id FROM events WHERE contains(lower(concat_ws(' ', event_type, props)), 'a')")
def history_search(spark, d):
    return scoring.search(_t(spark, d, "events"), "A", "event_type", "props").select("event_id", "user_id")


@query("SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_result(spark, d):
    return ev.last_results(_t(spark, d, "conversations"), "conv_id", "turn", "role", "text")


from . import imaging, photos, service, stored  # noqa: E402, F401  they register their queries here


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)




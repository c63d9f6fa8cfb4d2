"""Attribution, votes, text features and classifier metrics."""

from pyspark.sql import functions as F

from portolan.functions.numeric import half_even, lenient_double
from portolan.functions.text import word_tokens
from portolan.operators import attribution as a
from portolan.operators import metrics as m
from portolan.operators import ml
from portolan.operators.topk import top_classes
from portolan.plans.views import event_models, imports, table
from portolan.session import scratch_path, stored
from workload.catalog import IMPORTS, he, query

WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
CNB = f"""{IMPORTS}, items AS (
  SELECT chave_item, cnpj, list_sort({WORDS.format("descricao")}) AS toks FROM imports
), rows_b AS (SELECT chave_item, cnpj, toks, array_to_string(toks, ' ') AS bag FROM items),
bag_class AS (SELECT bag, cnpj, any_value(toks) AS toks, count(*) AS copies FROM rows_b GROUP BY 1, 2),
cnt AS (SELECT token, cnpj, sum(copies)::DOUBLE AS n FROM (SELECT unnest(toks) AS token, cnpj, copies FROM bag_class) GROUP BY 1, 2),
tot AS (SELECT token, sum(n) AS all_t FROM cnt GROUP BY 1),
cls AS (SELECT cnpj, ln((SELECT sum(all_t) + 0.3::DOUBLE * count(*) FROM tot) - sum(n)) AS base FROM cnt GROUP BY 1),
bags AS (SELECT bag, unnest(toks) AS token FROM (SELECT bag, any_value(toks) AS toks FROM rows_b GROUP BY 1)),
bt AS (SELECT bag, token, count(*) AS x FROM bags GROUP BY 1, 2),
len_b AS (SELECT bag, sum(x) AS len, sum(x * ln(all_t + 0.3::DOUBLE)) AS konst FROM bt JOIN tot USING (token) GROUP BY 1),
gain AS (SELECT bag, cnpj, sum(x * (ln(all_t + 0.3::DOUBLE) - ln(all_t + 0.3::DOUBLE - n))) AS g
  FROM bt JOIN tot USING (token) JOIN cnt USING (token) GROUP BY 1, 2),
dense AS (SELECT b.bag, c.cnpj, len * base - konst + coalesce(g, 0) AS s
  FROM len_b b CROSS JOIN cls c LEFT JOIN gain ON gain.bag = b.bag AND gain.cnpj = c.cnpj),
soft AS (SELECT bag, cnpj, s, exp(s - max(s) OVER (PARTITION BY bag)) AS e FROM dense),
prob AS (SELECT bag, cnpj, s, e / sum(e) OVER (PARTITION BY bag) AS p FROM soft),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY round(s, 9) DESC, cnpj) AS rn FROM prob),
wide AS (SELECT bag, {", ".join(f"max(CASE WHEN rn = {r} THEN cnpj END) AS c{r}, max(CASE WHEN rn = {r} THEN p END) AS p{r}" for r in range(1, 6))},
  -sum(p * ln(p + 1e-12::DOUBLE)) AS ent FROM ranked GROUP BY bag)"""


def _bags(spark, d):
    return a.with_bag(imports(spark, d, ("chave_item", "cnpj", "descricao")), word_tokens(F.col("descricao")))


@query(
    "cnb_topk",
    f"""WITH {CNB} SELECT chave_item, cnpj, c1 AS RES_Previsto, {he("p1", 4)} AS RES_Confianca,
    {", ".join(f"c{r} AS RES_Top{r}, {he(f'p{r}', 4)} AS RES_Top{r}_p" for r in range(1, 6))},
    {he("ent", 4)} AS RES_Entropia, {he("p1 - p2", 4)} AS RES_Margem FROM rows_b JOIN wide USING (bag)""",
)
def cnb(spark, d):
    rows = _stored(spark, _bags(spark, d), "bags")  # texts are read and cut into words once
    # The trained counts are stored, as the lots of a stream store theirs: scoring does not train again.
    model = a.complement_model(_stored(spark, a.complement_counts(rows, "cnpj"), "counts"))
    return a.attribute(rows, model).drop("descricao")


@query(
    "point_query",
    f"""WITH {CNB}, asked AS (SELECT bag FROM rows_b ORDER BY chave_item LIMIT 1) SELECT c1 AS RES_Previsto, {he("p1", 4)} AS RES_Confianca,
    {", ".join(f"c{r} AS RES_Top{r}, {he(f'p{r}', 4)} AS RES_Top{r}_p" for r in range(1, 6))},
    {he("ent", 4)} AS RES_Entropia, {he("p1 - p2", 4)} AS RES_Margem FROM asked JOIN wide USING (bag)""",
)
def point_query(spark, d):
    """One description against the model of all rows."""
    rows = _bags(spark, d)
    asked = imports(spark, d, ("chave_item", "descricao")).agg(F.min_by("descricao", "chave_item").alias("descricao"))
    model = a.complement_model(_stored(spark, a.complement_counts(rows, "cnpj"), "counts"))
    return a.attribute(a.with_bag(asked, word_tokens(F.col("descricao"))), model).drop("descricao")


_NUMBERS = ("vmle_dolar", "peso_liquido")


@query(
    "standardised",
    f"""WITH {IMPORTS}, v AS (SELECT chave_item, {", ".join(f"try_cast({n} AS DOUBLE) AS {n}" for n in _NUMBERS)} FROM imports),
    filled AS (SELECT chave_item, {", ".join(f"coalesce({n}, (SELECT median({n}) FROM v)) AS {n}" for n in _NUMBERS)} FROM v)
    SELECT chave_item, {", ".join(f"{he(f'({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER ()', 6)} AS {n}_std" for n in _NUMBERS)} FROM filled""",
)
def standardised(spark, d):
    rows = imports(spark, d, ("chave_item", *_NUMBERS)).withColumns({n: lenient_double(n) for n in _NUMBERS})
    out = ml.standardised(rows, list(_NUMBERS))
    return out.select("chave_item", *[half_even(F.col(f"{n}_std"), 6).alias(f"{n}_std") for n in _NUMBERS])


@query(
    "training_counts",
    f"WITH {CNB} SELECT token, cnpj AS class, n::BIGINT AS n FROM cnt",
)
def training_counts(spark, d):
    rows = _bags(spark, d).withColumn("lote", F.col("cnpj") < "00000000000500")
    early, late = rows.where(F.col("lote")), rows.where(~F.col("lote"))
    return a.add_counts(a.complement_counts(early, "cnpj"), a.complement_counts(late, "cnpj"))


def _model_sql(name: str, group: str) -> str:
    return f"""{name}_r AS (SELECT event_id AS "row", event_type AS y, {group} AS g FROM events),
    {name}_n AS (SELECT g, count(*) AS n_g FROM {name}_r GROUP BY g),
    {name}_c AS (SELECT g, y AS class, count(*) AS n FROM {name}_r GROUP BY ALL),
    {name}_t AS (SELECT g, k.class, (coalesce(n, 0) + 1)::DOUBLE / (n_g + (SELECT count(DISTINCT event_type) FROM events))::DOUBLE AS p
      FROM {name}_n CROSS JOIN (SELECT DISTINCT event_type AS class FROM events) k LEFT JOIN {name}_c USING (g, class)),
    {name}_m AS (SELECT "row", class, p, y FROM {name}_r JOIN {name}_t USING (g))"""


MODELS = f'{_model_sql("usr", "user_id")}, {_model_sql("hr", "hour(ts)")}'
VOTE = f"""{MODELS}, votes AS (SELECT "row", class, p * 0.6::DOUBLE AS p FROM usr_m UNION ALL SELECT "row", class, p * 0.4::DOUBLE AS p FROM hr_m),
vote AS (SELECT "row", class, sum(p) / (sum(sum(p)) OVER (PARTITION BY "row") + 1e-12::DOUBLE) AS p FROM votes GROUP BY "row", class),
truth AS (SELECT event_id AS "row", event_type AS y FROM events),
vrank AS (SELECT "row", class, p, row_number() OVER (PARTITION BY "row" ORDER BY round(p, 12) DESC, class) AS rn FROM vote),
best AS (SELECT v."row", class AS yhat, p, y FROM vrank v JOIN truth t ON v."row" = t."row" WHERE rn = 1)"""


def _vote(spark, d):
    models = event_models(spark, d)
    return a.soft_vote([(models["user"], 0.6), (models["hour"], 0.4)])


def _vote_with_truth(spark, d):
    truth = table(spark, d, "events").select(F.col("event_id").alias("row"), F.col("event_type").alias("y"))
    return _vote(spark, d).join(truth, "row")


def _best(spark, d):
    top = top_classes(_vote(spark, d), ["row"], 1, digits=12).select("row", F.col("Top1").alias("yhat"))
    truth = table(spark, d, "events").select(F.col("event_id").alias("row"), F.col("event_type").alias("y"), "ts")
    return top.join(truth, "row")


@query("soft_vote", f'WITH {VOTE} SELECT "row", class, {he("p", 9)} AS p FROM vote')
def soft_vote(spark, d):
    return _vote(spark, d).withColumn("p", half_even(F.col("p"), 9))


@query(
    "result_columns",
    f"""WITH {VOTE} SELECT "row", max(CASE WHEN rn = 1 THEN class END) AS RES_Previsto, {he("max(CASE WHEN rn = 1 THEN p END)", 4)} AS RES_Confianca,
    {", ".join(f"max(CASE WHEN rn = {r} THEN class END) AS RES_Top{r}, {he(f'max(CASE WHEN rn = {r} THEN p END)', 4)} AS RES_Top{r}_p" for r in range(1, 6))},
    {he("-sum(p * ln(p + 1e-12::DOUBLE))", 4)} AS RES_Entropia,
    {he("max(CASE WHEN rn = 1 THEN p END) - max(CASE WHEN rn = 2 THEN p END)", 4)} AS RES_Margem FROM vrank GROUP BY "row" """,
)
def result_columns(spark, d):
    return a.result_columns(_vote(spark, d))


@query("accuracy", f"WITH {VOTE} SELECT {he('avg((y = yhat)::INTEGER)', 4)} AS accuracy FROM best")
def accuracy(spark, d):
    return m.accuracy(_best(spark, d))


def _macro_sql(by: str = "") -> str:
    b = f"{by}, " if by else ""
    j = f"AND c.{by} = l.{by}" if by else ""
    return f"""labels_b AS (SELECT DISTINCT {b}label FROM (SELECT {b}y AS label FROM pred UNION ALL SELECT {b}yhat FROM pred)),
    per AS (SELECT {f"l.{by}, " if by else ""}l.label, count(*) FILTER (c.y = l.label AND c.yhat = l.label) AS tp,
      count(*) FILTER (c.yhat = l.label) AS guessed, count(*) FILTER (c.y = l.label) AS real
      FROM labels_b l JOIN pred c ON (c.y = l.label OR c.yhat = l.label) {j} GROUP BY ALL),
    macro AS (SELECT {b}{he("avg(CASE WHEN guessed > 0 THEN tp::DOUBLE / guessed ELSE 0 END)", 4)} AS "precision",
      {he("avg(CASE WHEN real > 0 THEN tp::DOUBLE / real ELSE 0 END)", 4)} AS recall,
      {he("avg(2 * tp::DOUBLE / (real + guessed))", 4)} AS f1_macro FROM per {f"GROUP BY {by}" if by else ""})"""


@query("macro_f1", f'WITH {VOTE}, pred AS (SELECT y, yhat FROM best), {_macro_sql()} SELECT "precision", recall, f1_macro FROM macro')
def macro(spark, d):
    return m.macro_scores(_best(spark, d))


@query(
    "topk_accuracy",
    f"""WITH {VOTE}, tr AS (SELECT v."row", rn FROM vrank v JOIN truth t ON v."row" = t."row" AND v.class = t.y)
    SELECT k::INTEGER AS k, {he("avg((rn <= k)::INTEGER)", 4)} AS top_k FROM tr CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k)
    WHERE k < (SELECT count(DISTINCT event_type) FROM events) GROUP BY k""",
)
def topk_accuracy(spark, d):
    return m.topk_accuracy(_vote_with_truth(spark, d))


@query(
    "log_loss",
    f"""WITH {VOTE}, own AS (SELECT t."row", coalesce(max(CASE WHEN v.class = t.y THEN p END), 0) AS p
      FROM truth t JOIN vote v ON v."row" = t."row" GROUP BY t."row")
    SELECT {he("avg(-ln(greatest(2.220446049250313e-16::DOUBLE, least(1 - 2.220446049250313e-16::DOUBLE, p))))", 4)} AS log_loss FROM own""",
)
def log_loss(spark, d):
    return m.log_loss(_vote_with_truth(spark, d), row="row")


@query(
    "batch_history",
    f"""WITH {VOTE}, pred AS (SELECT strftime(ts, '%Y-%m-%d') AS lote, y, yhat FROM best JOIN events ON "row" = event_id), {_macro_sql("lote")}
    SELECT lote, count(*) AS n, {he("avg((y = yhat)::INTEGER)", 4)} AS accuracy, any_value(f1_macro) AS f1_macro
    FROM pred JOIN macro USING (lote) GROUP BY lote""",
)
def history(spark, d):
    return m.batch_history(_best(spark, d).withColumn("lote", F.date_format("ts", "yyyy-MM-dd")), "lote")


_ACC = """acc AS (SELECT model, fold, avg((class = y)::INTEGER) AS accuracy FROM (
  SELECT 'usr' AS model, "row" % 3 AS fold, class, y, row_number() OVER (PARTITION BY "row" ORDER BY round(p, 12) DESC, class) AS rn FROM usr_m
  UNION ALL SELECT 'hr', "row" % 3, class, y, row_number() OVER (PARTITION BY "row" ORDER BY round(p, 12) DESC, class) FROM hr_m) WHERE rn = 1 GROUP BY ALL)"""


def _fold_accuracy(spark, d):
    models = event_models(spark, d)
    parts = None
    for name, key in (("usr", "user"), ("hr", "hour")):
        best = top_classes(models[key], ["row", "y"], 1, digits=12)
        part = best.select(F.lit(name).alias("model"), (F.col("row") % 3).alias("fold"), (F.col("Top1") == F.col("y")).cast("int").alias("hit"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("model", "fold").agg(F.avg("hit").alias("accuracy"))


@query(
    "vote_weights",
    f"""WITH {MODELS}, {_ACC}, raw AS (SELECT model, greatest(0.1::DOUBLE, least(1::DOUBLE, avg(accuracy))) AS w FROM acc GROUP BY model)
    SELECT model, {he("w / (SELECT sum(w) FROM raw)", 9)} AS weight FROM raw""",
)
def weights(spark, d):
    return a.batch_weights(_fold_accuracy(spark, d)).withColumn("weight", half_even(F.col("weight"), 9))


@query(
    "weight_update",
    f"""WITH {MODELS}, {_ACC}, raw AS (SELECT model, greatest(0.1::DOUBLE, least(1::DOUBLE, avg(accuracy))) AS w FROM acc GROUP BY model),
    w0 AS (SELECT model, w / (SELECT sum(w) FROM raw) AS w FROM raw),
    w1 AS (SELECT model, 0.7::DOUBLE * w + (1 - 0.7::DOUBLE) * accuracy AS w FROM w0 JOIN acc USING (model) WHERE fold = 0)
    SELECT model, {he("w / (SELECT sum(w) FROM w1)", 9)} AS weight FROM w1""",
)
def weight_update(spark, d):
    folds = _fold_accuracy(spark, d)
    batch = folds.where(F.col("fold") == 0).select("model", "accuracy")
    return a.updated_weights(a.batch_weights(folds), batch).withColumn("weight", half_even(F.col("weight"), 9))


@query(
    "best_model",
    f"""WITH {MODELS}, {_ACC}, t AS (SELECT model, avg(accuracy) AS accuracy, NULL::DOUBLE AS top_5 FROM acc GROUP BY model)
    SELECT model, {he("accuracy", 9)} AS accuracy FROM t ORDER BY coalesce(top_5, accuracy) DESC, model LIMIT 1""",
)
def best_model(spark, d):
    rows = _fold_accuracy(spark, d).groupBy("model").agg(F.avg("accuracy").alias("accuracy"))
    best = m.best_model(rows.withColumn("top_5", F.lit(None).cast("double")))
    return best.select("model", half_even(F.col("accuracy"), 9).alias("accuracy"))


_TOKENS = "regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}')"
TFIDF = f"""toks AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
grams AS (SELECT doc_id, unnest(t) AS token FROM toks UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks WHERE len(t) >= 2),
tf AS (SELECT doc_id, token, count(*) AS tf FROM grams GROUP BY 1, 2),
voc AS (SELECT token, count(*) AS df FROM tf GROUP BY token ORDER BY sum(tf) DESC, token LIMIT 8000),
raw AS (SELECT doc_id, token, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN voc USING (token)),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM raw GROUP BY doc_id)"""


@query("tfidf", f"WITH {TFIDF} SELECT doc_id, token, {he('w / n', 6)} AS w FROM raw JOIN nrm USING (doc_id)")
def tfidf(spark, d):
    return ml.tfidf(table(spark, d, "documents"), "doc_id", ["text"]).withColumn("w", half_even(F.col("w"), 6))


_PADDED = "' ' || w || ' '"
_CHAR = " UNION ALL ".join(
    f"SELECT conv_id, substring(pw, i::BIGINT, {n}) AS token FROM (SELECT conv_id, pw, unnest(range(1, length(pw) - {n} + 2)) AS i FROM words WHERE length(pw) >= {n})"
    for n in (3, 4, 5)
)


@query(
    "char_counts",
    f"""WITH words AS (SELECT conv_id, ' ' || unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')) || ' ' AS pw FROM conversations),
    g AS ({_CHAR}), tf AS (SELECT conv_id, token, count(*) AS tf FROM g GROUP BY 1, 2),
    voc AS (SELECT token FROM tf GROUP BY token ORDER BY sum(tf) DESC, token LIMIT 3000)
    SELECT conv_id, token, tf FROM tf WHERE token IN (SELECT token FROM voc)""",
)
def char_counts(spark, d):
    return ml.char_counts(table(spark, d, "conversations"), "conv_id", ["text"])


def _stored(spark, df, name):
    """Features written once: iterative fits read them instead of mining the texts again."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


@query("linear_text_model")
def linear_text(spark, d):
    """Log-loss and margin members on hashed text, their vote, and its accuracy."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = ml.hashed_features(docs.select("doc_id", "text", F.col("quality").cast("double").alias("label"), "lang", "n_chars"), ["text"], 2**12, 2**12)
    pre = ml.fit_preprocessor(rows, ["lang"], ["n_chars"], ["hash_word", "hash_char"])
    data = pre.transform(rows).select("doc_id", "label", "features").withColumn("name", F.col("label").cast("int").cast("string"))
    data = stored(data, "text-features", ml.VECTOR_GROUP)
    logistic = ml.class_probabilities(ml.fit_logistic(data).transform(data), "doc_id", ["0", "1"])
    margin = ml.margin_probabilities(ml.fit_margin(data).transform(data), "doc_id", ["0", "1"], "name")
    vote = a.soft_vote([(logistic, 1.0), (margin, 0.8)], "doc_id")
    best = top_classes(vote, ["doc_id"], 1, digits=12).join(data.select("doc_id", "name"), "doc_id")
    return m.accuracy(best, "name", "Top1")


@query("neural_model")
def neural(spark, d):
    """Perceptron on principal components of hashed words."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = ml.hashed_features(docs.select("doc_id", "text", F.col("quality").cast("double").alias("label")), ["text"], 512, 512)
    data = stored(rows.select("doc_id", "label", F.col("hash_word").alias("features")), "neural-features", ml.VECTOR_GROUP)
    model = ml.fit_neural(data, 2, dim=32, hidden=(32, 16))
    return m.accuracy(model.transform(data), "label", "prediction")

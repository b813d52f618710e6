"""Queries over the matrix, the imputers and the evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.eval import (
    Calibration,
    Evaluator,
    FamilyAreaAnalysis,
    FeatureErrorAnalysis,
    ResourceSplitAnalysis,
    Split,
    compute_binary_metrics,
    confidence_label_to_probability,
    expected_calibration_error,
)
from lacuna.eval.metrics import reliability
from lacuna.impute import (
    KNNImputer,
    MeanImputer,
    RandomImputer,
    SoftImputeImputer,
    confidence_to_prob,
)
from lacuna.impute.common import fill
from lacuna.impute.prompting import parse_reply
from lacuna.impute.prompts import ICLPrompt, KGPrompt
from lacuna.impute.prompts.in_context import QUESTION
from lacuna.kb import KnowledgeBase
from lacuna.plans.inputs import (
    knowledge_base,
    labelled_documents,
    parts,
    table,
    vector_facts,
    vector_groups,
)
from lacuna.plans.registry import query

_HASH = "('0x' || substr(md5({key}), 1, 8))::BIGINT"
CELLS = f"""flat AS (SELECT vec_id AS entity_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
cells AS (SELECT entity_id, p::VARCHAR AS feature, (CASE WHEN x > 0 THEN 1 ELSE 0 END)::DOUBLE AS value,
  {_HASH.format(key="entity_id || ':' || p")} % 10 < 2 AS held FROM flat),
train AS (SELECT entity_id, feature, value FROM cells WHERE NOT held),
test AS (SELECT entity_id, feature, value::INTEGER AS gold FROM cells WHERE held)"""
RANDOM = f"""random_pred AS (SELECT entity_id, feature, 'random' AS imputer,
  {_HASH.format(key="'0:' || entity_id || ':' || feature")} / 4294967296.0::DOUBLE AS score, gold FROM test)"""
MEAN = """mean_pred AS (SELECT entity_id, feature, 'mean' AS imputer, m AS score, gold
  FROM test JOIN (SELECT feature, sum(value) / count(*) AS m FROM train GROUP BY feature) USING (feature))"""
KNN = """pairs AS (SELECT a.entity_id AS e, b.entity_id AS o,
    count(*) FILTER (WHERE a.value <> b.value) * 1000000 // count(*) AS d
  FROM train a JOIN train b ON a.feature = b.feature AND a.entity_id <> b.entity_id GROUP BY 1, 2),
ranked AS (SELECT t.entity_id, t.feature, t.gold, d, o, b.value,
    row_number() OVER (PARTITION BY t.entity_id, t.feature ORDER BY d, o) AS rank
  FROM test t JOIN pairs ON e = t.entity_id JOIN train b ON b.entity_id = o AND b.feature = t.feature),
knn_pred AS (SELECT entity_id, feature, 'knn' AS imputer, sum(value) / count(*) AS score, any_value(gold) AS gold
  FROM ranked WHERE rank <= 5 GROUP BY entity_id, feature)"""
ICL = f"""drawn AS (SELECT entity_id AS o, feature, value, row_number() OVER (PARTITION BY feature
    ORDER BY {_HASH.format(key="'0:' || entity_id || ':' || feature")}, entity_id) AS rank FROM train),
shown AS (SELECT feature, sum(value) AS ones, count(*) AS total,
    string_agg('- ' || o || ': ' || value::INTEGER, chr(10) ORDER BY rank) AS lines FROM drawn WHERE rank <= 3 GROUP BY feature)"""
GROUPS = """groups AS (SELECT vec_id AS entity_id, 'family ' || label AS family,
  CASE label % 3 WHEN 0 THEN 'north' WHEN 1 THEN 'south' END AS area FROM embeddings)"""
KG = f"""{GROUPS}, relatives AS (SELECT family, feature, count(*) FILTER (WHERE value = 1) AS ones, count(*) AS total
  FROM train JOIN groups USING (entity_id) GROUP BY 1, 2)"""
LABELLED = f"""labelled AS (SELECT doc_id, lang, source, n_chars, quality AS gold, toxic,
  {_HASH.format(key="doc_id::VARCHAR")} / 4294967296.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"""
COUNTS = """count(*) FILTER (WHERE gold = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE gold = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE gold = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE gold = 0 AND score < 0.5) AS tn"""
RATES = """*, tp + fp + fn + tn AS n, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy,
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"""
_PRED = "SELECT entity_id, feature, imputer, score, (score >= 0.5)::INTEGER AS pred FROM {name}"
PREDICTION = ["entity_id", "feature", "imputer", "score", "pred"]


def _metrics(source: str, by: str) -> str:
    return f"SELECT {RATES} FROM (SELECT {by}, {COUNTS} FROM {source} GROUP BY {by})"


def _evaluated(source: str) -> str:
    """Metrics by imputer, with the cells that have no answer."""
    gold = "(SELECT count(*) FROM test)"
    return f"SELECT *, {gold} AS n_gold, {gold} - n AS n_unanswered FROM ({_metrics(source, 'imputer')})"


def _binned(source: str) -> str:
    """Rows of (bin, n, mean probability, accuracy) of a prediction."""
    return f"""SELECT imputer, least(floor(prob * 10), 9)::INTEGER AS bin, count(*) AS n, avg(prob) AS p, avg(hit) AS a
      FROM (SELECT imputer, CASE WHEN score >= 0.5 THEN score ELSE 1 - score END AS prob,
        ((score >= 0.5)::INTEGER = gold)::INTEGER::DOUBLE AS hit FROM {source}) GROUP BY 1, 2"""


def _metrics_of(spark: SparkSession, sf_dir: str, imputer) -> DataFrame:
    train, targets, gold = parts(spark, sf_dir)
    return Evaluator(gold).metrics(imputer.impute(train, targets))


# Knowledge base


@query(f"WITH {CELLS} SELECT feature, count(*) AS n_known, count(*) FILTER (WHERE value = 1) AS n_positive FROM cells GROUP BY 1")
def kb_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_base(spark, sf_dir).coverage()


@query(f"WITH {CELLS} SELECT entity_id, feature, value FROM cells")
def kb_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_base(spark, sf_dir).known()


@query(
    f"WITH {CELLS} SELECT entity_id, "
    + ", ".join(f"max(value) FILTER (WHERE feature = '{i}') AS \"{i}\"" for i in range(64))
    + " FROM train GROUP BY entity_id"
)
def kb_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training cells, one column per feature; held-out cells are NULL."""
    train, _, _ = parts(spark, sf_dir)
    return KnowledgeBase(train).wide()


@query(f"WITH {CELLS} SELECT entity_id, feature FROM test")
def kb_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells of the training part: the held-out ones."""
    train, _, _ = parts(spark, sf_dir)
    return KnowledgeBase(train).missing()


@query(f"WITH {CELLS} SELECT c.entity_id, c.feature, t.value FROM cells c LEFT JOIN train t USING (entity_id, feature)")
def kb_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = knowledge_base(spark, sf_dir)
    train, _, _ = parts(spark, sf_dir)
    return KnowledgeBase(train).lookup(kb.cells.select("entity_id", "feature"))


def _two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same vectors read by two sources, the second one stricter."""
    vectors = table(spark, sf_dir, "embeddings")
    sources = [
        KnowledgeBase.from_vectors(vectors, "vec_id", "embedding", threshold=t).cells.withColumn("source", F.lit(s))
        for s, t in (("first", 0.0), ("second", 0.1))
    ]
    return sources[0].unionByName(sources[1])


@query("""SELECT vec_id AS entity_id, p::VARCHAR AS feature, (x > 0)::INTEGER::DOUBLE AS value
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)""")
def kb_sources_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KnowledgeBase.from_sources(_two_sources(spark, sf_dir), "union").cells


@query("""SELECT vec_id AS entity_id, p::VARCHAR AS feature, ((x > 0)::INTEGER + (x::DOUBLE > 0.1)::INTEGER) / 2 AS value
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)""")
def kb_sources_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return KnowledgeBase.from_sources(_two_sources(spark, sf_dir), "average").cells


# Splits and gold


@query(f"WITH {CELLS} SELECT CASE WHEN held THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM cells GROUP BY 1")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Split().assign(knowledge_base(spark, sf_dir).cells).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CELLS} SELECT CASE WHEN {_HASH.format(key="'7:' || entity_id")} % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  count(*) AS n, count(DISTINCT entity_id) AS n_entities FROM cells GROUP BY 1""")
def split_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = Split(folds=5, test_folds=(0,), unit=("entity_id",), seed="7")
    return split.assign(knowledge_base(spark, sf_dir).cells).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity_id").alias("n_entities")
    )


@query(f"""WITH {CELLS} SELECT 'cell' AS unit, count(*) AS n_leaks FROM test SEMI JOIN train USING (entity_id, feature)
  UNION ALL SELECT 'entity', count(*) FROM test SEMI JOIN train USING (entity_id)""")
def split_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cells found in training: none by cell, many by entity."""
    train, _, gold = parts(spark, sf_dir)
    return reduce(
        DataFrame.unionByName,
        [
            Split.leaks(train, gold, on).agg(F.lit(unit).alias("unit"), F.count(F.lit(1)).alias("n_leaks"))
            for unit, on in (("cell", ("entity_id", "feature")), ("entity", ("entity_id",)))
        ],
    )


@query(f"WITH {CELLS} SELECT entity_id, feature, gold FROM test")
def gold_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir)[2]


# Imputers


@query(f"WITH {CELLS}, {RANDOM} {_PRED.format(name='random_pred')}")
def random_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, targets, _ = parts(spark, sf_dir)
    return RandomImputer().impute(train, targets).select(PREDICTION)


@query(f"WITH {CELLS}, {RANDOM} {_evaluated('random_pred')}")
def random_impute_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics_of(spark, sf_dir, RandomImputer())


@query(f"WITH {CELLS}, {MEAN} {_PRED.format(name='mean_pred')}")
def mean_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, targets, _ = parts(spark, sf_dir)
    return MeanImputer().impute(train, targets).select(PREDICTION)


@query(f"WITH {CELLS}, {MEAN} {_evaluated('mean_pred')}")
def mean_impute_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics_of(spark, sf_dir, MeanImputer())


@query(f"WITH {CELLS}, {KNN} {_PRED.format(name='knn_pred')}")
def knn_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, targets, _ = parts(spark, sf_dir)
    return KNNImputer().impute(train, targets).select(PREDICTION)


@query(f"WITH {CELLS}, {KNN} {_evaluated('knn_pred')}")
def knn_impute_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics_of(spark, sf_dir, KNNImputer())


@query(f"""WITH {CELLS}, {KNN} SELECT entity_id, feature, rank::INTEGER AS rank, d AS distance, o AS neighbour_id, value
  FROM ranked WHERE rank <= 5""")
def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, targets, _ = parts(spark, sf_dir)
    found = KNNImputer().neighbour_examples(train, targets)
    return found.withColumn("distance", F.col("distance").cast("long"))


# Above every singular value of centred 0/1 matrices of any size that fits a table.
_ABOVE_ALL = 1e12
# Between the first two singular values of the matrix itself, which is then completed by one direction.
_PENALTY = 30.0
# That direction a b' minimises |X - a b'|^2 / 2 over known cells + penalty * (|a|^2 + |b|^2) / 2; each step solves for a and then b.
SOFT = f"""als(step, b) AS (SELECT 0, list_transform(range(64), lambda i: 1.0::DOUBLE) UNION ALL
    SELECT step, list(v ORDER BY p) FROM (
      SELECT step + 1 AS step, p, sum(value * a) / (sum(a * a) + {_PENALTY}) AS v FROM (
        SELECT step, entity_id, sum(value * b[feature::INTEGER + 1]) / (sum(b[feature::INTEGER + 1] ** 2) + {_PENALTY}) AS a
        FROM train, als WHERE step < 60 GROUP BY step, entity_id)
      JOIN (SELECT entity_id, feature::INTEGER AS p, value FROM train) USING (entity_id) GROUP BY step, p) GROUP BY step),
direction AS (SELECT b FROM als ORDER BY step DESC LIMIT 1),
soft_pred AS (SELECT test.entity_id, test.feature, 'softimpute' AS imputer, round(greatest(0, least(1, a * b[test.feature::INTEGER + 1])), 4) AS score, gold
  FROM test, direction JOIN (SELECT entity_id AS e, sum(value * b[feature::INTEGER + 1]) / (sum(b[feature::INTEGER + 1] ** 2) + {_PENALTY}) AS a
    FROM train, direction GROUP BY entity_id) ON true WHERE e = test.entity_id)"""
# Recursion is declared at the head of the statement.
_WITH_SOFT = f"WITH RECURSIVE {CELLS}, {SOFT}"


def _soft_imputed(train: DataFrame, targets: DataFrame) -> DataFrame:
    """To many digits, so that rounding agrees."""
    made = SoftImputeImputer(penalty=_PENALTY, center=False, tolerance=1e-18).impute(train, targets)
    return made.withColumn("score", F.round("score", 4)).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


@query(f"{_WITH_SOFT} {_PRED.format(name='soft_pred')}")
def soft_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft-thresholded SVD to convergence. More directions and centring are tested against a dense iteration."""
    train, targets, _ = parts(spark, sf_dir)
    return _soft_imputed(train, targets).select(PREDICTION)


@query(f"WITH {CELLS}, {MEAN} SELECT entity_id, feature, 'softimpute' AS imputer, score, (score >= 0.5)::INTEGER AS pred FROM mean_pred")
def soft_impute_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a penalty above all singular values nothing but the means is left."""
    train, targets, _ = parts(spark, sf_dir)
    return SoftImputeImputer(penalty=_ABOVE_ALL).impute(train, targets).select(PREDICTION)


@query(f"""WITH {CELLS}, {MEAN} SELECT entity_id, feature, value, FALSE AS imputed FROM train
  UNION ALL SELECT entity_id, feature, (score >= 0.5)::INTEGER::DOUBLE, TRUE FROM mean_pred""")
def fill_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completed matrix: known cells untouched, the missing ones imputed."""
    train, targets, _ = parts(spark, sf_dir)
    return fill(KnowledgeBase(train), MeanImputer().impute(train, targets))


# Prompts


@query(f"""WITH {CELLS}, {ICL} SELECT entity_id, feature, 'Feature: ' || feature || chr(10) || 'Known values:' || chr(10) || lines
  || chr(10) || 'What is the value for ' || entity_id || '?' || chr(10) || '{QUESTION}' AS prompt FROM test JOIN shown USING (feature)""")
def icl_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, targets, _ = parts(spark, sf_dir)
    builder = ICLPrompt()
    return builder.build(targets, builder.feature_examples(train))


@query(f"""WITH {CELLS}, {KNN}, near AS (SELECT entity_id, feature,
    string_agg('- ' || o || ': ' || value::INTEGER, chr(10) ORDER BY rank) AS lines FROM ranked WHERE rank <= 3 GROUP BY 1, 2)
  SELECT entity_id, feature, 'Feature: ' || feature || chr(10) || 'Known values:' || chr(10) || lines
  || chr(10) || 'What is the value for ' || entity_id || '?' || chr(10) || '{QUESTION}' AS prompt FROM near""")
def icl_prompt_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples are the nearest entities of each cell."""
    train, targets, _ = parts(spark, sf_dir)
    return ICLPrompt().build(targets, KNNImputer(k=3).neighbour_examples(train, targets))


@query(f"""WITH {CELLS}, {KG} SELECT entity_id, feature, concat_ws(chr(10), 'Entity: Vector ' || entity_id,
  '- lineage: ' || family || ' > vector ' || entity_id, '- area: ' || area, 'Feature: ' || feature,
  '- relatives with 1: ' || ones, '- relatives with 0: ' || (total - ones), '{QUESTION}') AS prompt
  FROM test JOIN groups USING (entity_id) LEFT JOIN relatives USING (family, feature)""")
def kg_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, targets, _ = parts(spark, sf_dir)
    return KGPrompt().build(targets, train, vector_facts(spark, sf_dir))


# Replies as a model gives them: prose around one JSON object.
_WORDS = "CASE event_type WHEN 'click' THEN 'low' WHEN 'view' THEN 'HIGH' WHEN 'error' THEN 'medium' WHEN 'purchase' THEN 'certain' END"


@query(f"""WITH said AS (SELECT event_id, (user_id % 2)::INTEGER AS value, {_WORDS} AS word FROM events),
    p AS (SELECT *, (CASE lower(word) WHEN 'low' THEN 0.55 WHEN 'medium' THEN 0.75 WHEN 'high' THEN 0.95 END)::DOUBLE AS p FROM said)
  SELECT event_id, CASE WHEN word IS NOT NULL THEN value END AS value, word AS confidence,
    CASE WHEN value = 1 THEN p ELSE 1 - p END AS probability FROM p""")
def reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and confidence out of reply texts made of events; some hold no answer."""
    word = F.expr(_WORDS)
    body = F.concat(F.lit(': {"value": '), F.col("user_id") % 2, F.lit(', "confidence": "'), word, F.lit('"} and more: '), "props")
    reply = F.concat("event_type", F.coalesce(body, F.lit(" has no answer")))
    answer = F.col("answer")
    return table(spark, sf_dir, "events").select("event_id", parse_reply(reply).alias("answer")).select(
        "event_id", answer["value"].alias("value"), answer["confidence"].alias("confidence"),
        confidence_to_prob(answer["value"], answer["confidence"]).alias("probability"),
    )


# Metrics


@query(f"WITH {LABELLED} {_metrics('labelled', 'lang')}")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_binary_metrics(labelled_documents(spark, sf_dir), ["lang"])


@query(f"WITH {LABELLED} SELECT {RATES} FROM (SELECT {COUNTS} FROM labelled)")
def binary_metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compute_binary_metrics(labelled_documents(spark, sf_dir))


@query(f"""WITH {LABELLED}, b AS (SELECT least(floor(score * 10), 9)::INTEGER AS bin, count(*) AS n, avg(score) AS p, avg(gold) AS a
  FROM labelled GROUP BY 1) SELECT bin, n, round(p, 6) AS mean_probability, round(a, 6) AS accuracy FROM b""")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reliability(labelled_documents(spark, sf_dir), 10, "score", "gold").select(
        "bin", "n", F.round("mean_probability", 6).alias("mean_probability"), F.round("accuracy", 6).alias("accuracy")
    )


@query(f"""WITH {LABELLED}, b AS (SELECT lang, least(floor(score * 15), 14)::INTEGER AS bin, count(*) AS n, avg(score) AS p, avg(gold) AS a
  FROM labelled GROUP BY 1, 2) SELECT lang, sum(n)::BIGINT AS n, round(sum(n * abs(a - p)) / sum(n), 6) AS ece FROM b GROUP BY lang""")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = expected_calibration_error(labelled_documents(spark, sf_dir), 15, "score", "gold", ["lang"])
    return error.withColumn("ece", F.round("ece", 6))


@query("""WITH said AS (SELECT event_type, CASE event_type WHEN 'click' THEN 'low' WHEN 'view' THEN ' HIGH ' WHEN 'error' THEN 'Medium'
    WHEN 'purchase' THEN 'certain' END AS label, value FROM events)
  SELECT label, (CASE lower(trim(label)) WHEN 'low' THEN 0.55 WHEN 'medium' THEN 0.75 WHEN 'high' THEN 0.95 END)::DOUBLE AS probability,
  count(*) AS n FROM said GROUP BY 1, 2""")
def confidence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _said(spark, sf_dir)
        .groupBy("label", confidence_label_to_probability(F.col("label")).alias("probability"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    label = F.when(kind == "click", "low").when(kind == "view", " HIGH ").when(kind == "error", "Medium").when(
        kind == "purchase", "certain"
    )
    return table(spark, sf_dir, "events").select("event_id", "user_id", label.alias("label"))


@query("""WITH said AS (SELECT event_id, user_id % 2 AS value, CASE event_type WHEN 'click' THEN 0.55 WHEN 'view' THEN 0.95
    WHEN 'error' THEN 0.75 END::DOUBLE AS p FROM events)
  SELECT event_id, CASE WHEN value = 1 THEN p ELSE 1 - p END AS probability FROM said""")
def confidence_to_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select(
        "event_id", confidence_to_prob(F.col("user_id") % 2, F.col("label")).alias("probability")
    )


# Evaluation of the imputers


def _baselines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predictions of the imputers, and the gold rows."""
    train, targets, gold = parts(spark, sf_dir)
    made = [
        RandomImputer().impute(train, targets),
        MeanImputer().impute(train, targets),
        KNNImputer().impute(train, targets),
        _soft_imputed(train, targets),
    ]
    return reduce(DataFrame.unionByName, made), gold


_EVERY = " UNION ALL ".join(
    f"SELECT imputer, score, gold, entity_id, feature FROM {name}_pred" for name in ("random", "mean", "knn", "soft")
)
_ALL = f"RECURSIVE {CELLS}, {RANDOM}, {MEAN}, {KNN}, {SOFT}, every AS ({_EVERY})"


@query(f"WITH {_ALL} {_evaluated('every')}")
def evaluator_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, gold = _baselines(spark, sf_dir)
    return Evaluator(gold).metrics(predictions)


@query(f"""WITH {CELLS} SELECT entity_id, feature, gold FROM test WHERE feature::INTEGER >= 60""")
def evaluator_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold rows without an answer when an imputer leaves out some features."""
    train, targets, gold = parts(spark, sf_dir)
    answered = MeanImputer().impute(train, targets.where(F.col("feature").cast("int") < 60))
    return Evaluator(gold).unanswered(answered)


@query(f"""WITH {_ALL}, b AS ({_binned('every')})
  SELECT imputer, bin, n, round(p, 6) AS mean_probability, round(a, 6) AS accuracy FROM b""")
def calibration_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, gold = _baselines(spark, sf_dir)
    scored = Evaluator(gold).scored(predictions)
    return Calibration(by=("imputer",)).table(scored).select(
        "imputer", "bin", "n", F.round("mean_probability", 6).alias("mean_probability"),
        F.round("accuracy", 6).alias("accuracy"),
    )


@query(f"""WITH {_ALL}, b AS ({_binned('every')})
  SELECT imputer, sum(n)::BIGINT AS n, round(sum(n * abs(a - p)) / sum(n), 6) AS ece FROM b GROUP BY imputer""")
def evaluator_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    predictions, gold = _baselines(spark, sf_dir)
    return Evaluator(gold).calibration(predictions).withColumn("ece", F.round("ece", 6))


@query(f"""WITH {CELLS}, {MEAN}, res AS (SELECT entity_id, CASE WHEN count(*) >= 52 THEN 'high' ELSE 'low' END AS resource FROM train GROUP BY 1),
  j AS (SELECT * FROM mean_pred LEFT JOIN res USING (entity_id))
  SELECT {RATES} FROM (SELECT coalesce(resource, 'low') AS resource, {COUNTS} FROM j GROUP BY 1 UNION ALL SELECT 'all', {COUNTS} FROM j)""")
def resource_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, targets, gold = parts(spark, sf_dir)
    scored = Evaluator(gold).scored(MeanImputer().impute(train, targets))
    return ResourceSplitAnalysis(threshold=52).run(scored, KnowledgeBase(train).entity_coverage())


@query(f"""WITH {CELLS}, {MEAN}, {GROUPS}, j AS (SELECT * FROM mean_pred LEFT JOIN groups USING (entity_id))
  SELECT {RATES} FROM (SELECT family, area, CASE grouping(family, area) WHEN 0 THEN 'family and area' WHEN 1 THEN 'family'
    WHEN 2 THEN 'area' ELSE 'all' END AS grain, {COUNTS} FROM j GROUP BY CUBE (family, area))""")
def family_area_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, targets, gold = parts(spark, sf_dir)
    scored = Evaluator(gold).scored(MeanImputer().impute(train, targets))
    return FamilyAreaAnalysis().run(scored, vector_groups(spark, sf_dir))


_ERRORS = f"""{CELLS}, {MEAN}, e AS (SELECT feature, {COUNTS} FROM mean_pred GROUP BY 1),
  r AS (SELECT feature, tp + fp + fn + tn AS n, fp + fn AS n_errors, tp, fp, fn, tn, 1 - (tp + tn) / (tp + fp + fn + tn) AS error_rate FROM e)"""


@query(f"WITH {_ERRORS} SELECT * FROM r")
def feature_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, targets, gold = parts(spark, sf_dir)
    scored = Evaluator(gold).scored(MeanImputer().impute(train, targets))
    return FeatureErrorAnalysis().run(scored)


@query(f"WITH {_ERRORS} SELECT * FROM r ORDER BY error_rate DESC, n_errors DESC, feature LIMIT 10")
def feature_errors_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, targets, gold = parts(spark, sf_dir)
    scored = Evaluator(gold).scored(MeanImputer().impute(train, targets))
    return FeatureErrorAnalysis(k=10).run(scored)


@query(f"WITH {LABELLED} {_metrics('labelled', 'source, lang')}")
def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of documents by source and language."""
    return compute_binary_metrics(labelled_documents(spark, sf_dir), ["source", "lang"])

"""Registered queries: text features, metrics, model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidemark.functions.text import bigrams, hash_bucket, words
from tidemark.operators import extract as E
from tidemark.operators import metrics, model, textfeat
from tidemark.plans.inputs import labelled, oracle
from tidemark.plans.q_layouts import dispatch_pages
from tidemark.plans.registry import dealt, query, table
from tidemark.session import work_dir

# The oracle's text steps, as macros over the documents.
_CLEAN = (
    r"regexp_replace(regexp_replace(lower(text), 'http\S+', '', 'g'), '[^a-z0-9\s]', '', 'g')"
)


def _grams_of(tokens: str, source: str, key: str) -> str:
    return f"""select {key}, unnest(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))])) as term
      from (select {key}, {tokens} as t from {source})"""


_TOKENS = f"regexp_extract_all({_CLEAN}, '[a-z0-9_]{{2,}}')"
_GRAMS = _grams_of(_TOKENS, "documents", "doc_id")
_IS_TRAIN = "cast('0x' || substr(md5(concat(cast(doc_id as string), ':42')), 1, 8) as bigint) % 100 < 80"
_TRAIN_GRAMS = _grams_of(_TOKENS, f"(select * from documents where {_IS_TRAIN})", "doc_id")


def _documents(spark, sf_dir):
    """The texts over all tasks: the table is one file, so one task would read it and cut all its n-grams."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(
    "tok_ngrams",
    r"""select doc_id, cast(len(t) as bigint) as tokens,
      md5(array_to_string(list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))]), '|')) as grams
    from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as t from documents)""",
)
def tok_ngrams(spark, sf_dir):
    docs = _documents(spark, sf_dir).withColumn("t", words(F.col("text")))
    return docs.select(
        "doc_id",
        F.size("t").cast("bigint").alias("tokens"),
        F.md5(F.array_join(F.concat("t", bigrams(F.col("t"))), "|")).alias("grams"),
    )


@query(
    "agg_vocab_topk",
    f"select term, count(*) as n from ({_GRAMS}) group by term order by n desc, term limit 60000",
)
def agg_vocab_topk(spark, sf_dir):
    return textfeat.vocabulary(_documents(spark, sf_dir))


@query(
    "agg_doc_freq",
    f"select term, count(distinct doc_id) as df from ({_TRAIN_GRAMS}) group by term",
)
def agg_doc_freq(spark, sf_dir):
    train = textfeat.split(_documents(spark, sf_dir), "doc_id").where("is_train")
    return textfeat.doc_freq(train)


_FEATURES_ORACLE = f"""with tf as (select doc_id, term, count(*) as tf from ({_GRAMS}) group by 1, 2),
      train as (select * from documents where {_IS_TRAIN}),
      traintf as (select * from tf where doc_id in (select doc_id from train)),
      vocab as (select term from traintf group by term order by sum(tf) desc, term limit 60000),
      idf as (select term, ln((1 + (select count(*) from train)) / (1 + count(*))) + 1 as idf
              from traintf where term in (select term from vocab) group by term),
      raw as (select doc_id, tf.term, tf * idf as w from tf join idf on tf.term = idf.term),
      unit as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from raw)
    select doc_id, count(*) as terms, round(sum(w), 6) as total, round(max(w), 6) as top,
      round(sum(w * w), 6) as length from unit group by doc_id"""


@query("tfidf", _FEATURES_ORACLE)
def tfidf(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    train = textfeat.split(docs, "doc_id").where("is_train").select("doc_id", "text")
    weights = textfeat.tfidf(docs, textfeat.inverse_doc_freq(train), "doc_id")
    w = F.col("weight")
    return weights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"),
        F.round(F.sum(w), 6).alias("total"),
        F.round(F.max(w), 6).alias("top"),
        F.round(F.sum(w * w), 6).alias("length"),
    )


@query(
    "sample_shuffle_split",
    f"""select doc_id, cast(cast('0x' || substr(md5(concat(cast(doc_id as string), ':42')), 1, 8) as bigint) % 100 as int) as bucket,
      {_IS_TRAIN} as is_train from documents""",
)
def sample_shuffle_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return textfeat.split(docs, "doc_id").select(
        "doc_id", hash_bucket(F.col("doc_id"), 42).alias("bucket"), "is_train"
    )


def _scored(spark, sf_dir):
    return labelled(spark, sf_dir).select(
        "doc_id", "label", "score", (F.col("score") >= 0.5).cast("int").alias("pred")
    )


_PRED = "select doc_id, label, score, case when score >= 0.5 then 1 else 0 end as pred from labelled"


@query(
    "agg_confusion",
    oracle(
        """select label, count(*) filter (pred = 0) as pred_0, count(*) filter (pred = 1) as pred_1
        from scored group by label""",
        "labelled",
        scored=_PRED,
    ),
)
def agg_confusion(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir))


@query(
    "agg_class_report",
    oracle(
        """select class, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from (
          select * from per_class
          union all select 'accuracy', h / n, h / n, h / n, n from (select sum(hit) as h, cast(sum(support) as bigint) as n from parts)
          union all select 'macro avg', avg(precision), avg(recall), avg(f1), cast(sum(support) as bigint) from per_class
          union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
            sum(f1 * support) / sum(support), cast(sum(support) as bigint) from per_class)""",
        "labelled",
        scored=_PRED,
        parts="""select cast(c as string) as class,
            count(*) filter (label = c and pred = c) as hit, count(*) filter (pred = c) as predicted,
            count(*) filter (label = c) as support
          from scored, (values (0), (1)) v(c) group by c""",
        per_class="""select class, p as precision, r as recall,
            case when p + r = 0 then 0 else 2 * p * r / (p + r) end as f1, support
          from (select *, case when predicted = 0 then 0 else hit / predicted end as p,
            case when support = 0 then 0 else hit / support end as r from parts)""",
    ),
)
def agg_class_report(spark, sf_dir):
    report = metrics.class_report(_scored(spark, sf_dir))
    return report.select(
        "class",
        *[F.round(m, 9).alias(m) for m in ("precision", "recall", "f1")],
        "support",
    )


_CURVE = """select score as threshold, tp / seen as precision, tp / (select sum(label) from labelled) as recall
  from (select score, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as seen
    from (select score, sum(label) as p, count(*) as n from labelled group by score))"""


@query(
    "win_pr_curve",
    oracle(
        """select round(threshold, 9) as threshold, round(precision, 9) as precision,
          round(recall, 9) as recall from curve""",
        "labelled",
        curve=_CURVE,
    ),
)
def win_pr_curve(spark, sf_dir):
    curve = metrics.pr_curve(_scored(spark, sf_dir))
    return curve.select(*[F.round(c, 9).alias(c) for c in ("threshold", "precision", "recall")])


@query(
    "agg_best_threshold",
    oracle(
        """select round(threshold, 9) as threshold, round(f1, 9) as f1 from (
          select threshold, 2 * precision * recall / nullif(precision + recall, 0) as f1 from curve)
        where f1 is not null order by f1 desc, threshold limit 1""",
        "labelled",
        curve=_CURVE,
    ),
)
def agg_best_threshold(spark, sf_dir):
    best = metrics.best_threshold(metrics.pr_curve(_scored(spark, sf_dir)))
    return best.select(F.round("threshold", 9).alias("threshold"), F.round("f1", 9).alias("f1"))


_FITTED: dict[tuple, object] = {}


def _model(spark, sf_dir):
    """All labelled documents and the full model, fitted on the training part once per session."""
    docs = dealt(labelled(spark, sf_dir).select("doc_id", "text", "label"), "doc_id")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _FITTED[key] = model.fit(textfeat.split(docs, "doc_id").where("is_train"))
    return docs, _FITTED[key]


@query(
    "fit_classifier",
    oracle(
        """select cast(c as string) as class, count(*) filter (label = c) as support, true as in_range
        from test, (values (0), (1)) v(c) group by c
        union all select t, count(*), true from test, (values ('accuracy'), ('macro avg'), ('weighted avg')) w(t)
        group by t""",
        "labelled",
        test=f"select * from labelled where not ({_IS_TRAIN})",
    ),
)
def fit_classifier(spark, sf_dir):
    """Classes and supports of the test part; the figures of a trained model have no oracle."""
    docs, fitted = _model(spark, sf_dir)
    test = textfeat.split(docs, "doc_id").where("not is_train")
    figures = [F.col(c).between(0, 1) for c in ("precision", "recall", "f1")]
    return metrics.class_report(model.score(fitted, test)).select(
        "class", "support", (figures[0] & figures[1] & figures[2]).alias("in_range")
    )


@query(
    "score_proba",
    oracle("select doc_id, true as in_range, true as agrees from labelled", "labelled"),
)
def score_proba(spark, sf_dir):
    docs, fitted = _model(spark, sf_dir)
    return model.score(fitted, docs).select(
        "doc_id",
        F.col("score").between(0, 1).alias("in_range"),
        ((F.col("score") > 0.5) == (F.col("pred") == 1)).alias("agrees"),
    )


@query("sink_model", oracle("select doc_id, true as same from labelled", "labelled"))
def sink_model(spark, sf_dir):
    docs, fitted = _model(spark, sf_dir)
    path = work_dir(spark, "model")
    model.save(fitted, path)
    before = model.score(fitted, docs).select("doc_id", F.col("score").alias("before"))
    after = model.score(model.load(path), docs).select("doc_id", F.col("score").alias("after"))
    return before.join(after, "doc_id").select("doc_id", (F.col("before") == F.col("after")).alias("same"))


@query("model_features", _FEATURES_ORACLE)
def model_features(spark, sf_dir):
    """The vectors that the model sees, summed up as those of the relational TF-IDF."""
    docs = _documents(spark, sf_dir)
    train = textfeat.split(docs, "doc_id").where("is_train")
    ready = PipelineModel(model.features(train)[1]).transform(textfeat.with_grams(docs))
    used = F.filter(F.unwrap_udt("features")["values"], lambda x: x != 0)
    zero = F.lit(0.0)
    return ready.select("doc_id", used.alias("w")).where(F.size("w") > 0).select(
        "doc_id",
        F.size("w").cast("bigint").alias("terms"),
        F.round(F.aggregate("w", zero, lambda a, x: a + x), 6).alias("total"),
        F.round(F.array_max("w"), 6).alias("top"),
        F.round(F.aggregate("w", zero, lambda a, x: a + x * x), 6).alias("length"),
    )


@query(
    "extract_with_model",
    "select p_partkey as page_id, true as same from part where p_partkey % 5 not in (0, 4)",
)
def extract_with_model(spark, sf_dir):
    """Extraction with the fitted model gives what filtering the same candidates by its scores gives."""
    _, fitted = _model(spark, sf_dir)
    pages = dispatch_pages(spark, sf_dir)
    dom = E.layout_dom(E.route(pages))
    candidates = E.rule_candidates(E.read_layouts(dom, "page_id").where("page_type <> 'moderators'"), "page_id")
    scored = model.score(fitted, candidates, "score_text")
    kept = scored.where(F.col("score") >= E.RULE_THRESHOLD).groupBy("page_id", "case_no").agg(
        F.count_distinct(F.lower("title"), F.coalesce(F.lower("description"), F.lit(""))).alias("n"),
        F.count(F.lit(1)).alias("rows"),
        F.first("page_type").alias("page_type"),
    )
    first = kept.groupBy("page_id").agg(F.min(F.struct("case_no", "n", "rows", "page_type")).alias("k"))
    want = first.select("page_id", F.when(F.col("k.page_type") == "homepage", F.col("k.rows")).otherwise(F.col("k.n")).alias("want"))
    got = E.extract(pages, "page_id", model.scorer(fitted)).rules.select("page_id", F.size("rules").alias("got"))
    asked = candidates.select("page_id").distinct().join(want, "page_id", "left").join(got, "page_id", "left")
    return asked.select("page_id", F.col("want").eqNullSafe(F.col("got").cast("bigint")).alias("same"))

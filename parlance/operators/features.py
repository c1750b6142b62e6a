"""Fitted text features as Spark ML stages.

A document's terms are counted, weighted and normalised inside its row by JVM
stages, so neither a (document, term) row nor (but for whole training sets,
``stored_features``) a Python worker is involved:
``TermVector`` (tokens, n-grams, counts by vocabulary), ``ElementwiseProduct`` (the
idf), ``Normalizer``. The vocabulary is at most ``max_terms`` rows, the one thing
that comes to the driver. All stages can be saved and loaded, so a pipeline of
them and a classifier is one artifact that scores raw text.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import constants as K
from parlance.operators import tfidf
from parlance.session import scratch_path

_ONE_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


class TermVector(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Counts of a text's vocabulary terms as a sparse vector, each count tf as it is
    or as 1 + ln(tf). A null text is an empty one."""

    ngrams = Param(Params._dummy(), "ngrams", "shortest and longest n-gram (1 or 2)", TypeConverters.toListInt)
    sublinear = Param(Params._dummy(), "sublinear", "1 + ln(tf) in place of tf", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, ngrams=None, sublinear=None, vocabulary=()):
        super().__init__()
        self._setDefault(ngrams=[1, 1], sublinear=False)
        given = {k: v for k, v in self._input_kwargs.items() if k != "vocabulary" and v is not None}
        self.vocabulary = list(vocabulary)
        self._set(**given)

    def _transform(self, df: DataFrame) -> DataFrame:
        text, out = self.getInputCol(), self.getOutputCol()
        kept = df.columns
        d = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
        d = tfidf._with_ngrams(d, "__text", tuple(self.getOrDefault(self.ngrams)), "__terms")
        counter = CountVectorizerModel.from_vocabulary(self.vocabulary, "__terms", "__counts" if self.getOrDefault(self.sublinear) else out)
        d = counter.transform(d)
        if self.getOrDefault(self.sublinear):
            # The JVM builds a vector from a struct only where it reads one: JSON here.
            e = F.unwrap_udt("__counts")
            damped = F.transform(e["values"], lambda tf: 1.0 + F.log(tf))
            v = F.struct(e["type"].alias("type"), e["size"].alias("size"), e["indices"].alias("indices"), damped.alias("values"))
            d = d.withColumn(out, F.from_json(F.to_json(F.struct(v.alias("v"))), _ONE_VECTOR)["v"])
        return d.select(*[F.col(f"`{c}`") for c in kept], out)

    def write(self) -> MLWriter:
        return _TermVectorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TermVectorReader(cls)


class _TermVectorWriter(MLWriter):
    def __init__(self, instance: TermVector):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        rows = list(enumerate(self.instance.vocabulary))  # at most max_terms
        self.sparkSession.createDataFrame(rows, "term_index int, term string").coalesce(1).write.parquet(f"{path}/data")


class _TermVectorReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TermVector:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        rows = self.sparkSession.read.parquet(f"{path}/data").orderBy("term_index").collect()
        stage.vocabulary = [r.term for r in rows]
        return stage


def fit_tfidf(train: DataFrame, id_col: str, text_col: str, ngrams=K.TFIDF_NGRAMS, min_df: int = K.TFIDF_MIN_DF,
              max_terms: int = K.TFIDF_MAX_TERMS, sublinear: bool = True, out: str = "features") -> PipelineModel:
    """TF-IDF stages fitted on ``train``: text column -> L2-normalised sparse vector."""
    totals = tfidf.frequent_totals(train, text_col, ngrams, min_df, max_terms)
    vocabulary = tfidf.vocabulary_of(totals, tfidf.doc_count(train), min_df, max_terms)
    rows = vocabulary.select("term_index", "term", "idf").orderBy("term_index").collect()  # at most max_terms
    stage = TermVector(inputCol=text_col, outputCol="__tf", ngrams=list(ngrams), sublinear=sublinear, vocabulary=[r.term for r in rows])
    idf = ElementwiseProduct(scalingVec=Vectors.dense([r.idf for r in rows]), inputCol="__tf", outputCol="__tfidf")
    return PipelineModel(stages=[stage, idf, Normalizer(p=2.0, inputCol="__tfidf", outputCol=out)])


def vocabulary_of(model: PipelineModel) -> list[str]:
    return model.stages[0].vocabulary


def with_features(model: PipelineModel, df: DataFrame, out: str = "features") -> DataFrame:
    """``df`` with the vector of its text, without the columns in between."""
    return model.transform(df).select(*[F.col(f"`{c}`") for c in df.columns], out)


def stored_features(model: PipelineModel, df: DataFrame, out: str = "features") -> DataFrame:
    """``with_features`` of a whole training set, without its text, stored once. The
    vectors are made in numpy, batch by batch, and written as the struct that a vector
    is in a file, so that reading them back gives vectors."""
    counts, idf, _ = model.stages
    rows = tfidf.weighed(df, counts.getInputCol(), counts.vocabulary, idf.getScalingVec().toArray(), tuple(counts.getOrDefault(counts.ngrams)),
                         counts.getOrDefault(counts.sublinear), out)
    path = scratch_path(df.sparkSession, "features")
    rows.write.parquet(path)
    vectors = T.StructType([T.StructField(f.name, VectorUDT() if f.name == out else f.dataType) for f in rows.schema])
    return df.sparkSession.read.schema(vectors).parquet(path)


def long_weights(model: PipelineModel, df: DataFrame, id_col: str) -> DataFrame:
    """(id, term, term_index, weight) of every document, its terms taken out of its own
    row; the vocabulary (at most max_terms rows) is broadcast."""
    spark = df.sparkSession
    v = with_features(model, df).select(F.col(id_col).alias("id"), F.unwrap_udt("features").alias("v"))
    rows = v.select("id", F.explode(F.arrays_zip(F.col("v.indices").alias("term_index"), F.col("v.values").alias("weight"))).alias("e"))
    names = spark.createDataFrame(list(enumerate(vocabulary_of(model))), "term_index int, term string")
    return rows.select("id", "e.term_index", "e.weight").join(F.broadcast(names), "term_index").select("id", "term", "term_index", "weight")

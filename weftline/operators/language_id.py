"""Statistical language identification: naive Bayes over character trigrams, trained on a labelled table.

The transparent rule in functions.language is the contract; this stands beside it where a corpus has labels, and falls
back to it for texts without letters.
"""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import language

BUCKETS = 4096


def trigrams(c: Column) -> Column:
    """Character trigrams of letters and spaces in lower case."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+", " ")
    return F.filter(F.regexp_extract_all(t, F.lit("(?=(.{3}))"), F.lit(1)), lambda g: F.trim(g) != "")


class LanguageId:
    def __init__(self, model: NaiveBayesModel, codes: list[str]):
        self.model, self.codes = model, codes
        self.tf = HashingTF(inputCol="_g", outputCol="features", numFeatures=BUCKETS)

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", label: str = "lang") -> LanguageId:
        codes = [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # one row a language
        place = F.create_map(*[F.lit(x) for i, c in enumerate(codes) for x in (c, float(i))])
        rows = df.filter(F.col(label).isNotNull()).select(trigrams(F.col(text)).alias("_g"), place[F.col(label)].alias("label"))
        tf = HashingTF(inputCol="_g", outputCol="features", numFeatures=BUCKETS)
        return cls(NaiveBayes(smoothing=1.0).fit(tf.transform(rows)), codes)

    def detect(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with language, language_confidence, language_method ('trigrams', or the rule's where there are no trigrams)."""
        p = self.model.transform(self.tf.transform(df.withColumn("_g", trigrams(F.col(text)))))
        best = F.array_max(F.zip_with(vector_to_array("probability"), F.array(*[F.lit(c) for c in self.codes]), lambda a, b: F.struct(a.alias("p"), b.alias("c"))))
        out = p.withColumns({"_b": best, "_r": language.detect(F.col(text))})
        own = F.size("_g") > 0
        return out.withColumns(
            {
                "language": F.when(own, F.col("_b.c")).otherwise(F.col("_r.code")),
                "language_confidence": F.when(own, F.round("_b.p", 4)).otherwise(F.col("_r.confidence")),
                "language_method": F.when(own, "trigrams").otherwise(F.col("_r.method")),
            }
        ).drop("_g", "features", "rawPrediction", "probability", "prediction", "_b", "_r")


class Registry:
    """Resources by language, made when first asked for; unknown codes raise ValueError."""

    def __init__(self, makers: dict | None = None):
        self.makers = makers or {k: (lambda w=tuple(v): frozenset(w)) for k, v in fixed.LANGUAGE_WORDS.items()}
        self.made: dict = {}

    def get(self, code: str):  # noqa: ANN201
        if code not in self.made:
            if code not in self.makers:
                raise ValueError(f"no resources for language {code!r}; known: {sorted(self.makers)}")
            self.made[code] = self.makers[code]()
        return self.made[code]

    @property
    def loaded(self) -> list[str]:
        return list(self.made)

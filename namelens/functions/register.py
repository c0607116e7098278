"""The functions for SQL: ``register(spark)`` publishes them as temporary functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from namelens.functions import edit
from namelens.functions.folding import fold_text
from namelens.sources.certificates import dns_names, parse_leaf


@F.pandas_udf(T.StringType())
def folded(labels: pd.Series) -> pd.Series:
    return labels.map(lambda x: fold_text(x)["folded"] if x is not None else None)


class CertificateNames:
    """One row for each DNS name of a base64 log leaf."""

    def eval(self, leaf: str):
        found = parse_leaf(leaf) if leaf is not None else None
        for name in dns_names(found[2]) if found else ():
            yield (name,)


def register(spark: SparkSession) -> None:
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION normalize_name(name STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(lower(trim(name)), '^\\*\\.', ''), '\\.$', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tokenize_label(label STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(label), '[^a-z0-9]+'), t -> t <> '')")
    spark.udf.register("fold_label", folded)
    spark.udf.register("osa_within_two", edit.osa_within_two)
    spark.udf.register("name_similarity", edit.similarity)
    spark.udtf.register("certificate_names", udtf(CertificateNames, returnType="name: string"))

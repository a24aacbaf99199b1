"""Column expressions and the one Arrow function (HTML repair)."""

from pyspark.sql import SparkSession


def register_sql(spark: SparkSession) -> None:
    """Make the URL, name and back-off expressions and the HTML repair available to SQL."""
    from gleanery.functions import html, names, urls
    from gleanery.operators import reliability

    html.register(spark)
    urls.register(spark)
    names.register(spark)
    reliability.register(spark)

"""Account rules, and the responses of the service that holds them."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RULES, RULES_RESPONSE


def rules_table(spark: SparkSession, rules: Mapping[str, str]) -> DataFrame:
    """`value -> tag` pairs, such as ``from:<account> -> <tag>``, as a table."""
    text = pa.string()
    return spark.createDataFrame(
        pa.table(
            {
                "value": pa.array(list(rules.keys()), text),
                "tag": pa.array(list(rules.values()), text),
            }
        )
    )


def store_rules(rules: DataFrame, path: str) -> None:
    """Make these the rules in force, in place of the ones stored before."""
    rules.select(RULES.names).write.mode("overwrite").json(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULES).json(path)


def parse_rule_responses(documents: DataFrame, column: str = "value") -> DataFrame:
    parsed = documents.withColumn("_response", F.from_json(column, RULES_RESPONSE))
    return parsed.select(*[c for c in documents.columns if c != column], "_response.*")


def rule_ids(responses: DataFrame) -> DataFrame:
    """The ids of the rules in force. A response without `data` or `meta` names none."""
    whole = F.col("data").isNotNull() & F.col("meta").isNotNull()
    kept = [c for c in responses.columns if c not in ("data", "meta")]
    return responses.filter(whole).select(*kept, F.explode("data.id").alias("id"))

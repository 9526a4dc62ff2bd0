"""Rows of a batch text-rewriting job: request objects out, response objects in."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import text


def request(identifier: Column, background: str, task: Column, model: str = "gpt-4o-mini", max_tokens: int = 400) -> Column:
    """Nested request object of one record."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.struct(
        identifier.alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit("/v1/chat/completions").alias("url"),
        F.struct(
            F.lit(model).alias("model"),
            F.array(message("system", F.lit(background)), message("user", task)).alias("messages"),
            F.lit(max_tokens).alias("max_tokens"),
        ).alias("body"),
    )


def request_lines(df: DataFrame, path: str, city: str, report: str, background: str, task: str, requirements: str) -> DataFrame:
    """One compact JSON object per record: the prompt quotes the report with its city masked."""
    prompt = F.concat(F.lit(task + ' "'), text.mask_city(report, city), F.lit('" ' + requirements))
    return df.select(F.to_json(request(text.file_identifier(path), background, prompt)).alias("value"))


def response_text(response: str | Column = "response") -> Column:
    """Text of the first choice; NULL where the object has none."""
    return F.get(text.col(response)["body"]["choices"], F.lit(0))["message"]["content"]

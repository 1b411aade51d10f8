"""Result sinks of a run: one results text with settings and baselines, and one row per molecule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def results_text(totals: DataFrame, config: dict, baselines: dict | None = None) -> DataFrame:
    """(value): one JSON text with config, baselines and results, the single row of aggregates in totals."""
    named = lambda d: F.create_map(*(F.lit(str(x)) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,string>")
    whole = F.struct(named(config).alias("config"), named(baselines or {}).alias("baselines"), F.struct(*totals.columns).alias("results"))
    return totals.select(F.to_json(whole).alias("value"))


def write_results(path: str, totals: DataFrame, per_row: DataFrame, config: dict, baselines: dict | None = None) -> None:
    """Writes path/results (one JSON text) and path/per_mol (a JSON line for each row); existing ones are an error."""
    results_text(totals, config, baselines).write.mode("errorifexists").text(f"{path}/results")
    per_row.write.mode("errorifexists").json(f"{path}/per_mol")


def read_results(spark: SparkSession, path: str, results: str, per_row: str) -> tuple[DataFrame, DataFrame]:
    """What write_results() wrote: (config, baselines, results) and the rows; results and per_row are schemas."""
    schema = f"config map<string,string>, baselines map<string,string>, results struct<{results}>"
    one = spark.read.schema("value string").text(f"{path}/results").select(F.from_json("value", schema).alias("r")).select("r.*")
    return one, spark.read.schema(per_row).json(f"{path}/per_mol")

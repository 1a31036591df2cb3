"""Row filters and derived columns that turn raw relations into processed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.functions import names as N, values as V


def remove_garbage_rows(df: DataFrame) -> DataFrame:
    return df.where(N.is_garbage("party_name") == 0)


def remove_empty_names(df: DataFrame, least: int = V.MIN_NAME_LENGTH) -> DataFrame:
    return df.withColumn("party_name", N.trimmed(N.text("party_name"))).where(F.length("party_name") >= least)


def add_script(df: DataFrame) -> DataFrame:
    return df.withColumn("script", N.detect_script("party_name"))


def remove_invalid_scripts(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("script").isin(V.VALID_SCRIPTS), F.lit(False)))


def parse_dates(df: DataFrame) -> DataFrame:
    return df.withColumn("snapshot_date", N.parse_date("source_snapshot_date"))


def preprocess_names(df: DataFrame, mode: str = "compat") -> DataFrame:
    return (
        df.withColumn("name_normalized", N.normalize_text("party_name", mode=mode))
        .withColumn("name_no_legal", N.remove_legal_forms("name_normalized"))
        .withColumn("name_latin", N.transliterate("name_no_legal"))
    )


def build_dataset(df: DataFrame) -> DataFrame:
    """Garbage, short names and scripts out, in this order; dates and names in."""
    return preprocess_names(parse_dates(remove_invalid_scripts(add_script(remove_empty_names(remove_garbage_rows(df))))))


def clean_dataset(df: DataFrame) -> DataFrame:
    """Placeholders and unknown scripts out; dates with the Unix-second fallback in."""
    said = F.coalesce(F.contains(F.lower("party_name"), F.lit(V.PLACEHOLDER_TEXT)), F.lit(False))
    return add_script(df.where(~said)).where("script != 'unknown'").withColumn("date", N.parse_snapshot("source_snapshot_date"))


def split_by_label(df: DataFrame, label: str = "party_public_id") -> tuple[DataFrame, DataFrame]:
    """(rows to train on, rows to search)."""
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())

"""The 26 features of a pair. What depends on one record only is computed once a record, before the pair join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.functions import names as N, similarity as S, values as V


def text_features(pairs: DataFrame, a: str = "name_latin_1", b: str = "name_latin_2") -> DataFrame:
    """Text and legal-form features; one trip to Python for all edit ratios."""
    x, y = N.text(a), N.text(b)
    s, t = N.tokens(x), N.tokens(y)
    forms_1, forms_2 = S.legal_forms(s), S.legal_forms(t)
    has_1, has_2 = F.size(forms_1) > 0, F.size(forms_2) > 0
    core_1, core_2 = S.core_name(x), S.core_name(y)
    ready = pairs.withColumn("_r", S.all_ratios(x, y, core_1, core_2))
    plain = {
        "exact_match": (x == y).cast("int"),
        "token_jaccard": S.jaccard(s, t),
        "common_tokens": F.size(F.array_intersect(s, t)),
        "len_1": F.length(x), "len_2": F.length(y), "length_diff": F.abs(F.length(x) - F.length(y)),
        "token_count_1": F.size(s), "token_count_2": F.size(t), "token_count_diff": F.abs(F.size(s) - F.size(t)),
        "has_legal_form_1": has_1.cast("int"), "has_legal_form_2": has_2.cast("int"),
        "same_legal_form": F.when(~has_1 & ~has_2, 1).otherwise(F.arrays_overlap(forms_1, forms_2).cast("int")),
        "core_exact_match": (core_1 == core_2).cast("int"),
    }
    ratios = ["fuzz_ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "core_fuzz_ratio", "core_token_sort_ratio", "core_token_set_ratio"]
    return ready.withColumns(plain | {c: F.col(f"_r.{c}") for c in ratios}).drop("_r")


def metadata_features(pairs: DataFrame) -> DataFrame:
    """Equalities of the columns that are there (0 where one is missing) and garbage flags of the raw names."""
    out = {}
    for c in ("country", "script", "relation_kind", "relation_role", "company_public_id"):
        known = f"{c}_1" in pairs.columns and f"{c}_2" in pairs.columns
        out[f"same_{c}"] = S.same(F.col(f"{c}_1"), F.col(f"{c}_2")) if known else F.lit(0)
    for k in ("1", "2"):
        ready, raw = f"is_garbage_{k}", f"party_name_{k}"
        out[ready] = F.col(ready) if ready in pairs.columns else N.is_garbage(raw) if raw in pairs.columns else F.lit(0)
    return pairs.withColumns(out).withColumn("has_garbage_entity", F.greatest("is_garbage_1", "is_garbage_2"))


def pair_features(pairs: DataFrame) -> DataFrame:
    return metadata_features(text_features(pairs))


def feature_columns() -> list[str]:
    return list(V.FEATURES)


def model_feature_columns() -> list[str]:
    """The columns that models read: country and company equality are computed, but were never among them."""
    return [c for c in V.FEATURES if c not in ("same_country", "same_company_public_id")]


def baseline_scores(pairs: DataFrame, a: str = "name_latin_1", b: str = "name_latin_2") -> DataFrame:
    x, y = N.text(a), N.text(b)
    ready = pairs.withColumn("_r", S.all_ratios(x, y, x, y))
    return ready.withColumns({"baseline_exact": (x == y).cast("int"), "baseline_ratio": F.col("_r.fuzz_ratio"), "baseline_token_sort": F.col("_r.token_sort_ratio"), "baseline_token_set": F.col("_r.token_set_ratio")}).drop("_r")

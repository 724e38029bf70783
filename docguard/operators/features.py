"""Fusion of prompt and vision signals into the feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.fixed_values import FOURTEEN_FEATURES, IMAGE_COLUMNS, NINE_FEATURES, SPLITS
from docguard.functions.numbers import clip, nan_to_null, quote, uniform
from docguard.functions.signals import agreement, has_path, label_code, severity_code

LAYOUTS = {"fourteen": FOURTEEN_FEATURES, "nine": NINE_FEATURES}


def replaced(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """The frame with these columns set to SQL expressions over its own columns."""
    kept = [c for c in df.columns if c not in values]
    return df.selectExpr(*kept, *[f"{value} AS {name}" for name, value in values.items()])


def encode_label(df: DataFrame, strict: bool = True, out: str = "label_int") -> DataFrame:
    return df.withColumn(out, F.expr(label_code("label", strict)))


def join_labels_splits(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Labels with their split; an id that stands in the splits twice, or in two of them, fails the job."""
    joined = labels.join(unique_rows(splits.select("sample_id", "split")), "sample_id")
    return joined.select("sample_id", "label", "split", "attack_family")


def unique_rows(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """The same rows; a key that occurs twice fails the job instead of fanning out a join.

    The check groups by the join key, so the join that follows needs no shuffle of its own.
    It sits in every value, and where no value is read there is still one row per key.
    """
    rest = [c for c in df.columns if c != key]
    grouped = df.groupBy(key).agg(F.expr("count(1) AS _n"), *[F.expr(f"first({c}) AS {c}") for c in rest])
    twice = f"raise_error(concat('duplicate {key}: ', string({key})))"
    return grouped.selectExpr(key, *[f"if(_n = 1, {c}, {twice}) AS {c}" for c in rest])


def fuse_sources(labels: DataFrame, predictions: DataFrame, vision: DataFrame,
                 layout: str = "fourteen") -> DataFrame:
    """labels (the master list) left join predictions left join vision, then defaults."""
    right = unique_rows(predictions.select("sample_id", "malicious_probability"))
    joined = labels.join(right, "sample_id", "left").join(unique_rows(vision), "sample_id", "left")
    return fill_defaults(joined, layout)


def fill_defaults(df: DataFrame, layout: str = "fourteen") -> DataFrame:
    """Missing features become 0.0; the nine-column layout gives the prompt score 0.5."""
    filled = {}
    for name in LAYOUTS[layout]:
        if name == "severity_enc":
            filled[name] = severity_code(_present(df, "severity"))
            continue
        default = "0.5D" if layout == "nine" and name == "malicious_probability" else "0.0D"
        filled[name] = f"coalesce({nan_to_null(f'double({name})')}, {default})" if name in df.columns else default
    return replaced(df, filled)


def engineer_features(df: DataFrame) -> DataFrame:
    """Cross signals of prompt and vision score."""
    prompt, vision = (f"coalesce({nan_to_null(f'double({c})')}, 0.0D)" for c in ("malicious_probability", "vision_score"))
    return replaced(df, {
        "prompt_vision_agreement": agreement(prompt, vision),
        "max_signal": f"greatest({prompt}, {vision})",
        "signal_product": f"{prompt} * {vision}",
        "signal_diff": f"abs({prompt} - {vision})",
    })


def severity_enc(df: DataFrame) -> DataFrame:
    return replaced(df, {"severity_enc": severity_code(_present(df, "severity"))})


def legacy_columns(df: DataFrame) -> DataFrame:
    """Older vision tables call the two scores watermark_detected and hidden_text_detected."""
    for old, new in [("watermark_detected", "watermark_score"), ("hidden_text_detected", "hidden_text_score")]:
        if old in df.columns and new not in df.columns:
            df = df.withColumn(new, F.col(old))
    return df


def family_default(df: DataFrame) -> DataFrame:
    return replaced(df, {"attack_family": f"coalesce({_present(df, 'attack_family')}, 'unknown')"})


def missing_predictions(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    return labels.join(predictions.select("sample_id"), "sample_id", "left_anti")


def proxy_predictions(labels: DataFrame, predictions: DataFrame, seed: str = "42",
                      variant: str = "normal") -> DataFrame:
    """Predictions for all labelled ids, filled up from the label.  Leaks the label.

    Only for feature-engineering trials, never for evaluation; is_proxy marks such rows.
    """
    missing = missing_predictions(labels, predictions)
    u, v = (uniform("sample_id", f"{seed}:{tag}") for tag in ("a", "b"))
    if variant == "normal":
        noise = f"sqrt(-2.0D * ln(1.0D - {u})) * cos(2.0D * pi() * {v}) * 0.25D"
        guess = clip(f"if(label = 1, 0.70D, 0.30D) + {noise}")
    else:
        guess = f"if(label = 1, {clip(f'0.85D + {u} * 0.15D', 0.5, 1.0)}, {clip(f'0.10D + {u} * 0.10D', 0.0, 0.5)})"
    return union_predictions(predictions, missing.selectExpr(
        "sample_id", f"{guess} AS malicious_probability", "true AS is_proxy"))


def union_predictions(real: DataFrame, proxies: DataFrame) -> DataFrame:
    return real.selectExpr("sample_id", "malicious_probability", "false AS is_proxy").unionByName(proxies)


def overlay_image_features(text: DataFrame, image: DataFrame,
                           columns: Sequence[str] = tuple(IMAGE_COLUMNS)) -> DataFrame:
    """Image columns are 0.0 for all documents, except those that have an image row."""
    present = [c for c in columns if c in image.columns]
    right = unique_rows(image.select("sample_id", *present)).selectExpr(
        "sample_id", "1 AS _img", *[f"{c} AS _img_{c}" for c in present])
    joined = text.join(right, "sample_id", "left")
    values = {c: f"coalesce(double(_img_{c}), 0.0D)" if c in present else "0.0D" for c in columns}
    values["has_image"] = "coalesce(_img, 0)"
    return replaced(joined, values).drop("_img", *[f"_img_{c}" for c in present])


def image_backed(df: DataFrame, mode: str = "strict") -> DataFrame:
    """Rows with an image.  Without an image_path column the malicious rows stand in."""
    if "image_path" not in df.columns:
        return df.filter("label = 'malicious'")
    return df.filter("image_path IS NOT NULL" if mode == "loose" else has_path("image_path"))


def join_risk(features: DataFrame, risk: DataFrame) -> DataFrame:
    return features.join(unique_rows(risk.select("sample_id", "risk_score", "risk_level")), "sample_id")


def join_eval(features: DataFrame, risk: DataFrame, decisions: DataFrame) -> DataFrame:
    right = unique_rows(decisions.select("sample_id", "decision", "rule_id"))
    return join_risk(features, risk).join(right, "sample_id")


def features_from_map(values: str, order: Sequence[str]) -> str:
    """Ordered feature array from a map; a missing key counts 0.0."""
    return "array(" + ", ".join(f"coalesce(try_element_at({values}, {quote(n)}), 0.0D)" for n in order) + ")"


def feature_map(order: Sequence[str]) -> str:
    return "map(" + ", ".join(f"{quote(name)}, double({name})" for name in order) + ")"


def get_train_val_test(df: DataFrame, order: Sequence[str], label: str = "label") -> tuple[DataFrame, ...]:
    """Train, val and test with the ordered features as vector X and the label as y."""
    from pyspark.ml.feature import VectorAssembler
    assembled = VectorAssembler(inputCols=list(order), outputCol="X").transform(df)
    return tuple(assembled.filter(f"split = '{s}'").selectExpr("sample_id", "X", f"{label} AS y") for s in SPLITS)


def _present(df: DataFrame, name: str) -> str:
    return name if name in df.columns else "cast(null as string)"

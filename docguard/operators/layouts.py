"""Page-layout operators over OCR boxes, one row per box or one array per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from docguard.fixed_values import INJECTION_PHRASES
from docguard.functions import layout as L
from docguard.functions.numbers import ratio, share
from docguard.functions.text import density_of_lowered, strip, tokens, word_count
from docguard.operators.features import replaced
from docguard.operators.splits import aggregates

ARRAY_TEXT = "array_join(_new, ' ')"

VISION_COLUMNS = [
    "sample_id", "image_path", "ocr_confidence", "tiny_text_count", "footer_text_density",
    "watermark_score", "hidden_text_score", "keyword_density", "total_boxes", "total_words",
    "vision_score", "error",
]


def ocr_aggregate(boxes: DataFrame, id_column: str = "sample_id") -> DataFrame:
    """Boxes (id, pos, text, confidence) to one text, mean confidence and count per document.

    The text of a document is one value of the result; all else is aggregated partially.
    """
    placed = "array_sort(collect_list(named_struct('pos', pos, 'text', text)))"
    return boxes.groupBy(id_column).agg(*aggregates(
        f"{L.boxes_text(placed)} AS text", "coalesce(avg(confidence), 0.0D) AS ocr_confidence",
        "count(1) AS total_boxes"))


def layout_features(boxes: DataFrame, id_column: str = "sample_id", height: str = "height") -> DataFrame:
    """Tiny boxes and share of footer boxes per document; partial aggregation bears hot documents."""
    return boxes.groupBy(id_column).agg(*aggregates(
        f"count_if({L.is_tiny('y0', 'y1', height)}) AS tiny_text_count",
        f"{share(L.is_footer('y0', 'y1', height))} AS footer_text_density", "count(1) AS total_boxes"))


def nest_boxes(boxes: DataFrame, id_column: str = "sample_id") -> DataFrame:
    """Box rows to one array per document in reading order."""
    box = "named_struct('pos', pos, 'text', text, 'confidence', confidence, 'y0', y0, 'y1', y1)"
    return boxes.groupBy(id_column).agg(*aggregates(f"array_sort(collect_list({box})) AS boxes"))


def vision_features(docs: DataFrame, phrases: Sequence[str] = tuple(INJECTION_PHRASES),
                    keep: Sequence[str] = ()) -> DataFrame:
    """The full vision record per document, without any shuffle; keep names columns to carry along.

    docs: sample_id, image_path, boxes (array of text, confidence, y0, y1 in reading order),
    height, high_contrast and near_white (text layers), error (NULL where the image was read).
    """
    kept = ["sample_id", "image_path", "error", *[k for k in keep if k not in ("sample_id", "image_path", "error")]]
    carried = [*kept, *[c for c in ("boxes", "height", "near_white") if c not in kept]]
    # every text is put in lower case and cut into words once, then referred to by name
    staged = docs.selectExpr(*carried, f"lower(coalesce({L.boxes_text('boxes')}, '')) AS _normal",
                             f"{L.word_set('high_contrast')} AS _contrast", f"lower({strip('near_white')}) AS _hidden")
    staged = staged.selectExpr("*", f"{tokens('_normal')} AS _words")
    staged = staged.selectExpr("*", "array_sort(array_except(_contrast, _words)) AS _new")
    staged = staged.selectExpr(
        *carried, f"{L.combine_layers('_normal', ARRAY_TEXT, '_hidden')} AS _text",
        "size(_new) AS _n_new", "size(_contrast) AS _n_contrast",
        f"size(_words) + size(_new) + {word_count('_hidden')} AS _n_words")
    values = {
        "ocr_confidence": L.boxes_confidence("boxes"),
        "tiny_text_count": f"coalesce({L.boxes_tiny('boxes', 'height')}, 0)",
        "footer_text_density": L.boxes_footer_density("boxes", "height"),
        "watermark_score": ratio("_n_new", "_n_contrast"),
        "hidden_text_score": L.hidden_text_score("near_white"),
        "keyword_density": density_of_lowered("_text", phrases),
        "total_boxes": "coalesce(size(boxes), 0)",
        "total_words": "_n_words",
    }
    staged = staged.selectExpr(*kept, *[f"{value} AS {name}" for name, value in values.items()])
    zero = {name: "0" if name.startswith("t") else "0.0D" for name in values}
    staged = replaced(staged, {name: f"if(error IS NOT NULL, {zero[name]}, {name})" for name in values})
    scored = staged.selectExpr("*", f"if(error IS NOT NULL, 0.5D, {L.vision_score()}) AS vision_score")
    return scored.select(*VISION_COLUMNS, *[k for k in keep if k not in VISION_COLUMNS])


def extraction_report(vision: DataFrame) -> DataFrame:
    """Documents read, documents with an error."""
    return vision.agg(*aggregates("count(1) AS total", "count_if(error IS NULL) AS successful",
                                  "count_if(error IS NOT NULL) AS errors"))


def extraction_errors(vision: DataFrame) -> DataFrame:
    return vision.filter("error IS NOT NULL").select("sample_id", "error")

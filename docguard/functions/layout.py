"""Page-layout expressions: text layers, boxes as arrays, the weighted vision score."""

from __future__ import annotations

from docguard.fixed_values import VISION_WEIGHTS
from docguard.functions.numbers import clip, nan_to_null, num, ratio
from docguard.functions.text import strip, tokens


def vision_score(ocr_confidence: str = "ocr_confidence", tiny_text_count: str = "tiny_text_count",
                 footer_density: str = "footer_text_density", watermark_score: str = "watermark_score",
                 hidden_text_score: str = "hidden_text_score", keyword_density: str = "keyword_density") -> str:
    w = {name: num(weight) for name, weight in VISION_WEIGHTS.items()}
    tiny = f"least(1.0D, log1p(double({tiny_text_count})) / log1p(10.0D))"
    return clip(
        f"{w['keyword_density']} * {keyword_density} + {w['hidden_text_score']} * {hidden_text_score}"
        f" + {w['watermark_score']} * {watermark_score} + {w['footer_density']} * {footer_density}"
        f" + {w['tiny_text_count']} * {tiny} + {w['ocr_confidence']} * (1.0D - {ocr_confidence})"
    )


def word_set(text: str) -> str:
    lowered = f"lower(coalesce({text}, ''))"
    return f"array_distinct({tokens(lowered)})"


def new_words(normal: str, high_contrast: str) -> str:
    """Words that appear at high contrast only, sorted."""
    return f"array_sort(array_except({word_set(high_contrast)}, {word_set(normal)}))"


def watermark_score(normal: str, high_contrast: str) -> str:
    """Share of the high-contrast words that the normal layer does not have."""
    return ratio(f"size({new_words(normal, high_contrast)})", f"size({word_set(high_contrast)})")


def hidden_text_score(near_white: str) -> str:
    return f"if(length({strip(near_white)}) > 3, 1.0D, 0.0D)"


def hidden_text_detected(score: str) -> str:
    return f"coalesce({nan_to_null(score)} >= 0.5D, false)"


def combine_layers(normal: str, watermark: str, hidden: str) -> str:
    return f"concat_ws(' ', coalesce({normal}, ''), coalesce({watermark}, ''), coalesce({hidden}, ''))"


def box_from_quad(quad: str) -> str:
    """Four corner points (arrays x, y) to the enclosing upright box."""
    xs, ys = (f"transform({quad}, p -> double(p[{i}]))" for i in (0, 1))
    return (f"named_struct('x0', array_min({xs}), 'y0', array_min({ys}), "
            f"'x1', array_max({xs}), 'y1', array_max({ys}))")


def clamp_confidence(confidence: str) -> str:
    return clip(f"double({confidence})")


def is_tiny(y0: str, y1: str, height: str) -> str:
    return f"({y1} - {y0} < {height} * 0.01D)"


def is_footer(y0: str, y1: str, height: str) -> str:
    return f"(({y0} + {y1}) / 2.0D >= {height} * 0.85D)"


# --- boxes as one array per document: no explode, no shuffle ---------------------------


def boxes_text(boxes: str) -> str:
    return f"array_join(transform({boxes}, b -> b.text), ' ')"


def boxes_confidence(boxes: str) -> str:
    return ratio(f"aggregate({boxes}, 0.0D, (total, b) -> total + b.confidence)", f"size({boxes})")


def boxes_tiny(boxes: str, height: str) -> str:
    return f"size(filter({boxes}, b -> {is_tiny('b.y0', 'b.y1', height)}))"


def boxes_footer_density(boxes: str, height: str) -> str:
    return ratio(f"size(filter({boxes}, b -> {is_footer('b.y0', 'b.y1', height)}))", f"size({boxes})")


def drop_footer(boxes: str, height: str) -> str:
    return f"filter({boxes}, b -> NOT {is_footer('b.y0', 'b.y1', height)})"

"""Text expressions: tokens, truncation, windows, phrase hits, previews, redaction.

All of them see the whole text.  A token is a whitespace-separated word.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from docguard.functions.numbers import clip, listed, num, quote, ratio

# Unicode white space, plus the four separators Python's split() also breaks at.
_SPACE = quote(r"(?U)[\s\x1C-\x1F]+")
_BLANKS = quote(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
                "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_WORD = r"[\p{L}\p{N}_]"


def tokens(text: str) -> str:
    return f"array_remove(split({text}, {_SPACE}), '')"


def strip(text: str) -> str:
    return f"btrim({text}, {_BLANKS})"


def is_blank(text: str) -> str:
    """True for NULL and for text that holds white space only."""
    return f"(coalesce(length({strip(text)}), 0) = 0)"


def word_count(text: str) -> str:
    known = f"coalesce({text}, '')"
    return f"size({tokens(known)})"


def approx_tokens(words: str) -> str:
    return f"int(floor({words} * 1.3D))"


def smart_truncate(text: str, words: str, max_tokens: int = 512, head: int = 128, tail: int = 128) -> str:
    """Keep head, middle and tail of a long text; a short one stays as it is.

    words is a column with the tokens of the text: used often, it must be computed once.
    """
    middle = max_tokens - head - tail
    start = f"greatest({head}, size({words}) div 2 - {middle // 2})"
    kept = f"concat(slice({words}, 1, {head}), slice({words}, int({start}) + 1, {middle}), slice({words}, -{tail}, {tail}))"
    return f"if(size({words}) <= {max_tokens}, {text}, array_join({kept}, ' '))"


def text_windows(text: str, words: str, size: int = 510, stride: int = 256) -> str:
    """array<struct<start, text>>: one window for a text that fits, else overlapping ones.

    words is a column with the tokens of the text.  The window texts are cut here, so that
    an exploded row carries its window only.
    """
    starts = f"sequence(0, greatest(size({words}) - 1, 0), {stride})"
    piece = f"array_join(slice({words}, s + 1, {size}), ' ')"
    cut = f"transform({starts}, s -> named_struct('start', s, 'text', {piece}))"
    return f"if(size({words}) <= {size}, array(named_struct('start', 0, 'text', {text})), {cut})"


def inference_strategy(text: str, limit: int = 510) -> str:
    return f"if({word_count(text)} <= {limit}, 'direct', 'sliding_window')"


def has_phrase(lowered: str, phrase: str) -> str:
    """Phrase at word boundaries; the plain substring test spares most regex runs."""
    pattern = rf"(?<!{_WORD}){_escaped(phrase)}(?!{_WORD})"
    return f"(contains({lowered}, {quote(phrase)}) AND {lowered} rlike {quote(pattern)})"


def keyword_hits(text: str, phrases: Sequence[str]) -> str:
    """Phrases present in the text, each once, overlapping ones all."""
    lowered = f"lower(coalesce({text}, ''))"
    return "array_compact(array(" + ", ".join(f"if({has_phrase(lowered, p)}, {quote(p)}, null)" for p in phrases) + "))"


def keyword_density(text: str, phrases: Sequence[str]) -> str:
    """Half a point per phrase found, at most 1.0; 0.0 for a text without words."""
    return density_of_lowered(f"lower(coalesce({text}, ''))", phrases)


def density_of_lowered(lowered: str, phrases: Sequence[str]) -> str:
    """The keyword density of a text that is in lower case already."""
    hits = " + ".join(f"int({has_phrase(lowered, p)})" for p in phrases)
    return f"least(1.0D, 0.5D * ({hits}))"


def substring_hits(text: str, phrases: Sequence[str]) -> str:
    lowered = f"lower(coalesce({text}, ''))"
    return "(" + " + ".join(f"int(contains({lowered}, {quote(p)}))" for p in phrases) + ")"


def imperative_count(words: str, verbs: Sequence[str], first: int = 20) -> str:
    return f"size(filter(slice({words}, 1, {first}), w -> w IN ({listed(verbs)})))"


def heuristic_density(hits: str, words: str) -> str:
    return clip(ratio(hits, f"greatest(1.0D, {words} / 10.0D)"))


def heuristic_prompt(density: str, imperatives: str) -> str:
    return f"least(1.0D, {density} * {num(0.6)} + ({imperatives} / 5.0D) * {num(0.4)})"


def preview(text: str, length: int = 80) -> str:
    return f"translate(substring({text}, 1, {length}), '\\n', ' ')"


def redact_phrases(text: str, phrases: Sequence[str], mark: str = "[REDACTED]") -> str:
    """Replace every phrase at word boundaries, the longest possible phrase first."""
    choices = "|".join(_escaped(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    pattern = rf"(?iu)(?<!{_WORD})(?:{choices})(?!{_WORD})"
    return f"regexp_replace({text}, {quote(pattern)}, {quote(re.escape(mark))})"


def _escaped(phrase: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", phrase)

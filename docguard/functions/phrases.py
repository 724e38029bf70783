"""Many phrases at once: a text is cut into words and separators, and word runs are looked up in hash sets.

One regex per phrase costs time in proportion to the phrases. Here each word is looked up among the phrases' first words, and
only where one begins, the runs of the phrases' lengths are looked up among the phrases themselves; both are constant hash
tables: an array of buckets, of which a look-up reads one. Every separator but the blank becomes a word of its own, with a blank on either side, which can be undone; so
a run of words is exactly one stretch of text.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from docguard.functions import text as T
from docguard.functions.numbers import quote

_SEPARATOR = r"[^\p{L}\p{N}_ ]"
_MARK = "[REDACTED]"


def _cut(text: str) -> str:
    """SQL: the words and separators of a text."""
    return f"split(regexp_replace({text}, {quote(f'({_SEPARATOR})')}, ' $1 '), ' ', -1)"


def _joined(words: str) -> str:
    """SQL: the text of words and separators."""
    return f"regexp_replace(array_join({words}, ' '), {quote(f' ({_SEPARATOR}) ')}, '$1')"


def _named(value: str, name: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _among(value: str, texts: Sequence[str]) -> str:
    """SQL: whether a text is one of many; the table is one constant, so the plan holds no literal per text."""
    n = 1 << max(1, len(texts) - 1).bit_length()
    buckets: list[list[str]] = [[] for _ in range(n)]
    for t in texts:
        buckets[zlib.crc32(t.encode()) % n].append(t)
    table = f"from_json({quote(json.dumps(buckets))}, 'array<array<string>>')"
    return f"array_contains(get({table}, int(pmod(crc32({value}), {n}))), {value})"


@dataclass
class PhraseIndex:
    """Phrases by first word and number of words. Those that begin or end with a separator, whose borders depend on what
    stands around them, are tested by regexes as before."""
    phrases: Sequence[str]
    runs: list[str] = field(init=False)
    firsts: list[str] = field(init=False)
    lengths: list[int] = field(init=False)
    others: list[str] = field(init=False)

    def __post_init__(self):
        plain = [p for p in dict.fromkeys(self.phrases) if re.search(r"^\w", p) and re.search(r"\w$", p)]
        cut = [re.sub(r"([^\w ])", r" \1 ", p).split(" ") for p in plain]
        self.runs, self.firsts = [" ".join(w) for w in cut], sorted({w[0] for w in cut})
        self.lengths = sorted({len(w) for w in cut}, reverse=True)
        known = set(plain)
        self.others = [p for p in dict.fromkeys(self.phrases) if p not in known]

    def _starts(self, words: str) -> str:
        return f"filter(sequence(0, size({words}) - 1), i -> {_among(f'get({words}, i)', self.firsts)})"

    def hits(self, text: str) -> str:
        """SQL: the phrases in a text, each once, in the order in which they first occur."""
        found = "CAST(array() AS array<string>)"
        if self.runs:
            runs = ", ".join(f"array_join(slice(w, i + 1, {k}), ' ')" for k in self.lengths)
            inner = f"array_distinct(filter(flatten(transform({self._starts('w')}, i -> array({runs}))), g -> {_among('g', self.runs)}))"
            found = _named(_cut(f"lower(coalesce({text}, ''))"), "w", f"transform({inner}, g -> {_joined('array(g)')})")
        return f"concat({found}, {T.keyword_hits(text, self.others)})" if self.others else found

    def density(self, text: str) -> str:
        """SQL: half a point per phrase found, at most 1.0."""
        return f"least(1.0D, 0.5D * size({self.hits(text)}))"

    def redacted(self, text: str, mark: str = _MARK) -> str:
        """SQL: a text with every phrase replaced, from the left, the longest possible one first."""
        if not self.runs:
            return T.redact_phrases(text, self.others, mark) if self.others else text
        # the longest run at each start, then from the left those that overlap no earlier one
        longest = "coalesce(" + ", ".join(
            f"if({_among(f"array_join(slice(v, i + 1, {k}), ' ')", self.runs)}, {k}, null)" for k in self.lengths) + ", 0)"
        spans = f"filter(transform({self._starts('v')}, i -> named_struct('at', i, 'n', {longest})), s -> s.n > 0)"
        start = "named_struct('at', 0, 'out', CAST(array() AS array<string>))"
        step = ("if(s.at < acc.at, acc, named_struct('at', s.at + s.n, 'out', concat(acc.out, slice(w, acc.at + 1, s.at - acc.at), "
                f"array({quote(mark)}))))")
        walk = f"aggregate({spans}, {start}, (acc, s) -> {step}, acc -> concat(acc.out, slice(w, acc.at + 1, size(w))))"
        done = _joined(_named(_cut(text), "w", _named("transform(w, x -> lower(x))", "v", walk)))
        return T.redact_phrases(done, self.others, mark) if self.others else done

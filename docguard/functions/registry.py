"""Named scoring backends as iterator pandas UDFs.

A backend is loaded once per worker process, sees whole Arrow batches, and never fails the job:
each row comes back as struct<score, error>.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT_TYPE = "score double, error string"

#: Texts that a backend sees at once.
TEXTS = 1_000

# load() -> score(series of texts) -> series of floats
Loader = Callable[[], Callable[[pd.Series], pd.Series]]

_BACKENDS: dict[str, tuple[Loader, str]] = {}  # loader and number of its registration
_LOADED: dict[str, tuple[str, object]] = {}  # in a worker process: what load() has returned, by name


def loaded(name: str, registration: str, load: Loader):
    """The scoring function, loaded once per worker process and registration; what it replaces is let go."""
    held = _LOADED.get(name)
    if held is None or held[0] != registration:
        _LOADED.pop(name, None)
        held = _LOADED[name] = (registration, load())
    return held[1]


def register(name: str, load: Loader) -> None:
    """Make a backend known; a name that is registered again stands for the new one from then on."""
    _BACKENDS[name] = (load, uuid.uuid4().hex)


def _found(name: str) -> tuple[Loader, str]:
    if name not in _BACKENDS:
        raise ValueError(f"unknown backend {name!r}; available: {', '.join(available()) or 'none'}")
    return _BACKENDS[name]


def available() -> list[str]:
    return sorted(_BACKENDS)


def _batch_scorer(load: Loader, name: str, registration: str):
    """Scores and errors of a list of texts: as one batch, or one by one where that fails."""
    state = {}

    def run(texts: list[str]) -> list[tuple]:
        if "score" not in state and "broken" not in state:
            try:
                try:
                    from docguard.functions import registry as kept
                except ImportError:
                    state["score"] = load()
                else:
                    state["score"] = kept.loaded(name, registration, load)
            except Exception as problem:
                state["broken"] = str(problem)
        if "broken" in state:
            return [(None, state["broken"])] * len(texts)
        try:
            return [(float(x), None) for x in pd.Series(state["score"](pd.Series(texts, dtype=object)))]
        except Exception:
            found = []
            for text in texts:
                try:
                    found.append((float(pd.Series(state["score"](pd.Series([text], dtype=object))).iloc[0]), None))
                except Exception as problem:
                    found.append((None, str(problem)))
            return found

    return run


@dataclass(frozen=True)
class WindowScorer:
    """A backend for texts cut into windows: a column of arrays to struct<score, error>, inside the row."""
    score: Callable[[str], Column]


def window_scorer(name: str, stop_above: float = 0.99) -> WindowScorer:
    """The registered backend over arrays of windows: the first score above the stop value, else the largest.

    The windows of a batch of rows are scored TEXTS at a time.  A window that fails gives its row the error and no score.
    """
    load, registration = _found(name)
    make, most = _batch_scorer, TEXTS

    def score_rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = make(load, name, registration)
        for arrays in batches:
            # windows are taken from their rows as they are scored, so that few of them are held twice
            windows = (w for a in arrays if a is not None for w in a)
            flat = (s for part in iter(lambda: list(islice(windows, most)), []) for s in run(part))
            rows = []
            for a in arrays:
                found = list(islice(flat, len(a) if a is not None else 0))
                error = next((e for _, e in found if e is not None), None)
                scores = [s for s, _ in found]
                early = None if error else next((s for s in scores if s > stop_above), None)
                rows.append((None if error or not scores else early if early is not None else max(scores), error))
            yield pd.DataFrame(rows, columns=["score", "error"])

    score_rows.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    backend = F.pandas_udf(score_rows, RESULT_TYPE)
    return WindowScorer(lambda windows: backend(F.col(windows)))


def scorer(name: str) -> Callable[[str], Column]:
    """The registered backend as a function from column name to struct<score, error>."""
    load, registration = _found(name)
    most = TEXTS

    def score_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score, broken = None, None
        try:
            try:
                from docguard.functions import registry as kept
            except ImportError:  # the package is not on the workers: load once per task
                score = load()
            else:
                score = kept.loaded(name, registration, load)
        except Exception as problem:  # a backend that cannot load marks its rows
            broken = str(problem)

        def one_by_one(texts):
            # a batch failed: find the rows that cause it, keep the others
            rows = []
            for text in texts:
                try:
                    rows.append((float(score(pd.Series([text])).iloc[0]), None))
                except Exception as problem:
                    rows.append((None, str(problem)))
            return pd.DataFrame(rows, columns=["score", "error"])

        for texts in (batch.iloc[at:at + most] for batch in batches for at in range(0, max(1, len(batch)), most)):
            if broken is not None:
                yield pd.DataFrame({"score": [None] * len(texts), "error": [broken] * len(texts)})
                continue
            try:
                scores = pd.Series(score(texts)).astype(float).to_numpy()
                yield pd.DataFrame({"score": scores, "error": [None] * len(texts)})
            except Exception:
                yield one_by_one(texts)

    score_batches.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    backend = F.pandas_udf(score_batches, RESULT_TYPE)
    return lambda text: backend(F.col(text))

"""Encoding and decoding with a vocabulary of pieces: Viterbi over a double-array trie of pieces with log scores.

The public vocabulary file was made by merging pairs: its scores are the ranks of merges, no log probabilities. A best path
needs the latter, so the pieces are counted in what the file's own encoding makes of all the texts, and a piece scores the
logarithm of its smoothed share. Pieces, their ids and the byte fallback stay those of the file.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.llm.common import released, slabs, small_batches, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the format: an unknown character scores this much below the least piece
KEPT_BYTES = 32 << 20  # of segments and ids in a task's cache; the half that was not seen lately goes
COUNTED_BYTES = 16 << 20  # of segments and their counts that a task holds before it hands them on
SMOOTHING = 0.5  # added to each piece's count
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Pieces:
    """A vocabulary as arrays: the trie's base and check by character code, ids and scores of its nodes."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: np.ndarray, unknown: int, whole: np.ndarray):
        self.pieces, self.unknown, self.byte_ids = pieces, unknown, byte_ids
        self.scores = np.array(scores)
        ids = np.flatnonzero(whole)
        self.floor = float(self.scores[ids].min()) - UNKNOWN_PENALTY if len(ids) else -UNKNOWN_PENALTY
        uses = Counter(c for i in ids for c in pieces[i])
        letters = [c for c, _ in uses.most_common()]  # small codes for frequent characters keep the arrays dense
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.longest = max((len(pieces[i]) for i in ids), default=1)
        of_byte = {int(i): bytes([b]) for b, i in enumerate(byte_ids) if i >= 0}
        self.flat = [of_byte.get(i, p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)]
        self._build({pieces[i]: int(i) for i in ids}, len(letters) + 1)

    def _build(self, words: dict[str, int], width: int) -> None:
        """Place each node's children at base + code, at the first base where all their cells are free."""
        tree: list[dict[int, int]] = [{}]
        ids = [-1]
        for word, piece in words.items():
            node = 0
            for c in word:
                c = int(self.code[ord(c)])
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                    ids.append(-1)
                node = tree[node][c]
            ids[node] = piece
        size = 2 * len(tree) + 2 * width
        base, check, of = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free, cell, pending, lowest = bytearray(b"\1") * size, {0: 0}, [0], 1
        free[0] = 0
        for node in pending:  # grows while it is read: nodes by depth
            of[cell[node]] = ids[node]
            codes = sorted(tree[node])
            if not codes:
                continue
            lowest = free.index(1, lowest)
            at = lowest
            while True:  # the first free cell for the first child at which all others fit too
                chosen = at - codes[0]
                if chosen > 0 and all(free[chosen + c] for c in codes):
                    break
                at = free.index(1, at + 1)
                if at + width >= size:
                    more = size
                    size += more
                    free += b"\1" * more
                    base = np.concatenate([base, np.zeros(more, np.int32)])
                    check, of = (np.concatenate([x, np.full(more, -1, np.int32)]) for x in (check, of))
            base[cell[node]] = chosen
            for c in codes:
                free[chosen + c] = 0
                check[chosen + c] = cell[node]
                cell[tree[node][c]] = chosen + c
                pending.append(tree[node][c])
        last = max(cell.values()) + width + 1
        self.base, self.check, self.piece = (np.concatenate([x, np.full(width, -1, np.int32)])[:last + 1] for x in (base, check, of))

    def best(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over rows of equal length (characters by row): per end position the last piece and where it begins.

        All rows go forward together, from each begin those that still follow the trie. -1 as a piece is an unknown character.
        Of equal sums the earlier begin stays.
        """
        n, length = chars.shape
        codes = np.ascontiguousarray(self.code[chars].T)
        score = np.full((length + 1, n), -np.inf)
        score[0] = 0
        piece, begin = np.full((length + 1, n), -1, np.int32), np.zeros((length + 1, n), np.int32)
        for i in range(length):
            rows, node, single = np.arange(n), np.zeros(n, np.int32), np.zeros(n, bool)
            for j in range(i, min(length, i + self.longest)):
                code = codes[j, rows]
                to = self.base[node] + code
                on = np.flatnonzero((code > 0) & (self.check[to] == node))
                if not len(on):
                    break
                rows, node = rows[on], to[on]
                of = self.piece[node]
                whole = np.flatnonzero(of >= 0)
                found, of = rows[whole], of[whole]
                if j == i:
                    single[found] = True
                total = score[i, found] + self.scores[of]
                better = np.flatnonzero(total > score[j + 1, found])
                where = found[better]
                score[j + 1, where], piece[j + 1, where], begin[j + 1, where] = total[better], of[better], i
            alone = ~single & (score[i] + self.floor > score[i + 1])
            score[i + 1, alone], piece[i + 1, alone], begin[i + 1, alone] = score[i, alone] + self.floor, -1, i
        return piece, begin

    def long_segment(self, text: str) -> list[int]:
        """The same for one long segment, in one pass with a window of the longest piece."""
        base, check, of, scores, code = self.base, self.check, self.piece, self.scores, self.code
        n = len(text)
        score, piece, begin = [0.0] + [float("-inf")] * n, [-1] * (n + 1), [0] * (n + 1)
        codes = [int(code[ord(c)]) for c in text]
        for i in range(n):
            node, single = 0, False
            for j in range(i, min(n, i + self.longest)):
                to = int(base[node]) + codes[j]
                if not codes[j] or check[to] != node:
                    break
                node = to
                if of[node] >= 0:
                    single |= j == i
                    total = score[i] + float(scores[of[node]])
                    if total > score[j + 1]:
                        score[j + 1], piece[j + 1], begin[j + 1] = total, int(of[node]), i
            if not single and score[i] + self.floor > score[i + 1]:
                score[i + 1], piece[i + 1], begin[i + 1] = score[i] + self.floor, -1, i
        return self._back(text, piece, begin)

    def _back(self, text: str, piece, begin) -> list[int]:
        out, at = [], len(text)
        while at:
            p = int(piece[at])
            if p >= 0:
                out.append(p)
            elif self.byte_ids[0] >= 0:
                out += [int(self.byte_ids[b]) for b in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown)
            at = int(begin[at])
        return out[::-1]

    def segments_bytes(self, segments: list[str], widest: int = 48) -> list[bytes]:
        """Ids of each segment as 32-bit integers: short ones in groups of equal length, long ones each by itself."""
        out = [b""] * len(segments)
        by: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            if len(s) > widest:
                out[k] = np.array(self.long_segment(s), np.int32).tobytes()
            elif s:
                by.setdefault(len(s), []).append(k)
        for length, rows in by.items():
            chars = np.frombuffer("".join([segments[k] for k in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
            piece, begin = self.best(chars)
            # all rows go back together, written from their ends
            steps, left, at = np.full((len(rows), length), -2, np.int32), np.arange(len(rows)), np.full(len(rows), length, np.int32)
            for k in range(length - 1, -1, -1):
                steps[left, k], at = piece[at, left], begin[at, left]
                more = np.flatnonzero(at)
                left, at = left[more], at[more]
                if not len(left):
                    break
            used = steps > -2
            data, ends = steps[used].tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
            for k, x, y in zip(rows, [0, *ends], ends):
                out[k] = data[x:y]
            for r in np.flatnonzero((steps == -1).any(axis=1)).tolist():  # unknown characters become bytes
                out[rows[r]] = np.array(self._back(segments[rows[r]], piece[:, r].tolist(), begin[:, r].tolist()), np.int32).tobytes()
        return out

    def segments_ids(self, segments: list[str], widest: int = 48) -> list[list[int]]:
        """As segments_bytes(), as lists."""
        return [np.frombuffer(x, np.int32).tolist() for x in self.segments_bytes(segments, widest)]


def segment_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(segment, n): how often each segment occurs in all texts, as the library takes it: its first marker goes, others are spaces."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held, size = [], 0

        def out():
            found = pa.concat_tables(held).group_by("segment").aggregate([("n", "sum")]).combine_chunks()
            return pa.RecordBatch.from_arrays([found["segment"].combine_chunks(), found["n_sum"].combine_chunks()], ["segment", "n"])

        for part in slabs(batches, 4 << 20):
            texts = part.column(0).filter(pc.fill_null(pc.not_equal(part.column(0), ""), False))
            # where single spaces part words, segments are what lies between them
            odd = pc.or_(pc.match_substring_regex(texts, f"  |{MARK}"), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
            plain = pc.value_counts(pc.list_flatten(pc.split_pattern(texts.filter(pc.invert(odd)), " ")))
            other = Counter(s[1:].replace(MARK, " ") for t in texts.filter(odd).to_pylist() for s in segments_of(t))
            for segment, n in ((plain.field(0), plain.field(1)), (pa.array(list(other), pa.string()), pa.array(list(other.values()), pa.int64()))):
                held.append(pa.table({"segment": segment, "n": n}))
                size += held[-1].nbytes
            if size > COUNTED_BYTES:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return docs.select(F.col(text).alias("text")).mapInArrow(tidy(run), "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def piece_counts(docs: DataFrame, model: bytes, id_column: str = "doc_id", text: str = "text", documents: int | None = None) -> np.ndarray:
    """How often each piece occurs in the library's encoding of all texts.

    No piece holds a marker behind another character, so merges stay within segments and a text's pieces are those of its
    segments: each distinct segment is encoded once and counts as often as it occurs.
    With `documents`, only that many texts are counted, those with the smallest hashes of their ids; no query asks for it.
    """
    own = docs.select(F.xxhash64(F.col(id_column).cast("string")).alias("h"), F.col(text).alias("text"))
    if documents is not None:
        own = own.filter(F.col("h") <= F.lit(own.select("h").orderBy("h").limit(documents).agg(F.max("h")).first()[0]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        counts, lone = np.zeros(library.get_piece_size(), np.int64), [library.piece_to_id(MARK)]
        for batch in batches:
            segments = batch.column(0).to_pylist()
            ids = [x if s else lone for s, x in zip(segments, library.encode(segments, num_threads=1))]
            if ids:
                np.add.at(counts, np.concatenate(ids).astype(np.int64), np.repeat(batch.column(1).to_numpy(), [len(x) for x in ids]))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], ["piece", "n"])

    import sentencepiece

    out = np.zeros(sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size(), np.int64)
    # one row per piece of the vocabulary at most
    for r in segment_counts(own).mapInArrow(tidy(run), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


def load(model: bytes, counts: np.ndarray | None = None) -> Pieces:
    """A vocabulary from a model file's bytes. Control and unused pieces never match text; byte pieces are the fallback.

    With counts, a piece's score is the logarithm of its share of them, SMOOTHING added to each; else that of the file.
    """
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = own.get_piece_size()
    pieces = [own.id_to_piece(i) for i in range(n)]
    byte_ids = np.full(256, -1, np.int32)
    whole = np.ones(n, bool)
    for i in range(n):
        if own.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
        if own.is_byte(i) or own.is_control(i) or own.is_unknown(i) or own.is_unused(i):
            whole[i] = False
    if counts is None:
        scores = [own.get_score(i) for i in range(n)]
    else:
        held = np.where(whole, counts + SMOOTHING, 0.0)
        scores = np.log(np.where(whole, held / held.sum(), 1.0)).tolist()
    return Pieces(pieces, scores, byte_ids, own.unk_id(), whole)


def fitted(docs: DataFrame, model: str, id_column: str, text: str) -> Pieces:
    """The vocabulary of a file with log scores counted on all documents."""
    raw = read_model(model)
    return load(raw, piece_counts(docs, raw, id_column, text))


_CACHE: dict = {"of": None, "known": {}, "older": {}, "bytes": 0}


def with_cache(vocabulary: Pieces) -> Pieces:
    """The vocabulary with this process's ids of segments seen so far; there is one cache, for the last vocabulary, which a task's end empties."""
    key = (len(vocabulary.pieces), vocabulary.floor, hash(tuple(vocabulary.pieces)), hash(vocabulary.scores.tobytes()))
    if _CACHE["of"] != key:
        _CACHE.update(of=key, known={}, older={}, bytes=0)
    return vocabulary


def forget() -> None:
    """Empty the cache of this process and give its memory back; the next task fills one of its own."""
    _CACHE.update(of=None, known={}, older={}, bytes=0)
    released()


def segments_of(text: str) -> list[str]:
    """Markers and what follows up to the next one: a marker goes before a text and takes the place of each space."""
    return _SEGMENT.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_all(vocabulary: Pieces, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text.

    No piece of such a vocabulary holds a marker behind another character, so the best path of a text is that of its
    segments. Those not seen before in this task go through the trie together, all of a length at once.
    """
    split = [segments_of(t) for t in texts]
    if _CACHE["bytes"] > KEPT_BYTES // 2:
        _CACHE.update(known={}, older=_CACHE["known"], bytes=0)
    known, older = _CACHE["known"], _CACHE["older"]
    missing = set().union(*split).difference(known)
    added = {s: older[s] for s in missing if s in older}  # what is seen again stays
    fresh = [s for s in missing if s not in added]
    added.update(zip(fresh, vocabulary.segments_bytes(fresh)))
    known.update(added)
    _CACHE["bytes"] += sum([100 + 2 * len(s) + len(x) for s, x in added.items()])  # with what the objects take themselves
    return [np.frombuffer(b"".join([known[s] for s in segments]), np.int32) for segments in split]


def decoded(vocabulary: Pieces, ids) -> str:
    """Text of ids: bytes of fallback pieces are joined and read as UTF-8, markers become spaces, the first goes."""
    byte_of = {int(i): b for b, i in enumerate(vocabulary.byte_ids) if i >= 0}
    out = bytearray()
    for i in ids:
        i = int(i)
        out += bytes([byte_of[i]]) if i in byte_of else vocabulary.pieces[i].encode()
    text = out.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def fast_decoded(vocabulary: Pieces, ids: np.ndarray) -> str:
    """As decoded(), by a table of the pieces' bytes."""
    data = b"".join([vocabulary.flat[i] for i in ids.tolist()])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, keep: list[str] = ("doc_id",), text: str = "text", model: str = MODEL, decode: bool = True, same: bool = False,
                 vocabulary: Pieces | None = None) -> DataFrame:
    """Encode each whole text and decode it again: the columns to keep, n_tokens, ids (array of int), decoded.

    With `same`, same_text follows: whether the decoded text is the text; it needs `decode`.

    The driver reads the vocabulary file, has its pieces counted on all texts (see the module) and broadcasts its arrays, whose
    size the vocabulary fixes. Null texts count
    as empty: no ids, an empty text. A text that holds the marker character itself decodes with a space in its place.
    Repeated rows give repeated rows; an empty table gives none; other columns are ignored. keep begins with the id.
    """
    small_batches(docs.sparkSession)
    built = docs.sparkSession.sparkContext.broadcast(fitted(docs, model, keep[0], text) if vocabulary is None else vocabulary)
    own = docs.select(*keep, F.col(text).alias("__text"))
    n = len(keep)

    def run(batches):
        import pyarrow as pa

        vocabulary = with_cache(built.value)
        for part in slabs(batches):
            texts = [t or "" for t in part.column(n).to_pylist()]
            all_ids = encode_all(vocabulary, texts)
            sizes = np.array([len(x) for x in all_ids], np.int64)
            values = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)
            columns = [*(part.column(k) for k in range(n)), pa.array(sizes),
                       pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))]
            if decode:
                back = [fast_decoded(vocabulary, x) for x in all_ids]
                columns.append(pa.array(back, pa.string()))
                if same:
                    columns.append(pa.array([x == t for x, t in zip(back, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "ids", "decoded", "same_text"][:len(columns)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return own.mapInArrow(tidy(run, forget), schema + ", n_tokens long, ids array<int>" + ", decoded string" * decode + ", same_text boolean" * (decode and same))


def encoding_digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text", model: str = MODEL,
                     vocabulary: Pieces | None = None) -> DataFrame:
    """Per text: n_tokens, digest of its ids (as 32-bit little-endian integers), digest of the decoded text, and whether it is the text again.

    The digests are formed where the text is encoded, so that ids and texts do not go back to the JVM.
    """
    small_batches(docs.sparkSession)
    built = docs.sparkSession.sparkContext.broadcast(fitted(docs, model, id_column, text) if vocabulary is None else vocabulary)

    def run(batches):
        import hashlib

        import pyarrow as pa

        vocabulary = with_cache(built.value)
        for part in slabs(batches):
            rows, texts = [], [t or "" for t in part.column(1).to_pylist()]
            for t, ids in zip(texts, encode_all(vocabulary, texts)):
                back = fast_decoded(vocabulary, ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), len(back), back == t))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.bool_())))],
                ["id", "n_tokens", "ids_sha256", "decoded_chars", "same_text"])

    own = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(tidy(run, forget), "id long, n_tokens long, ids_sha256 string, decoded_chars long, same_text boolean").withColumnRenamed("id", id_column)

"""Exact similarity join of documents on word shingles by Jaccard, with pairs ruled out by first shingles and derived answers.

A document is the set of its shingles' 64-bit hashes. The shingles that only one document has are found first, by
packed 32-bit keys; they come first in the one order of all shingles, the frequent ones last. Two sets that link share a shingle among
their first (1 - threshold) x size + 1. Lists of the sets by such a shingle are the index. Equal lists are worked off
once, lists that sets chain together as one as long as they are of moderate size, and within a list the overlaps of a set
are derived from those of a similar set that is done: only the shingles in which the two differ are looked up.

Lists are skipped by position. Of two sets that hold the list's shingle, the intersection has at most the lesser number of
shared shingles before it, itself, and the lesser number after it. Short lists skip pairs by that; long ones are cut into
blocks of like size and like place, a directory keeps each block's bounds, and only blocks that its bounds let link meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.llm.common import Handoff, lowered, mixed, slice_hashes, small, tidy, word_spans
from docguard.llm.components import connected_components
from docguard.llm.substring_dedup import (
    LAST, bucketed, chunked, content, dealt, drop_tables, key_buckets, key_rows, known_keys, shared_keys,
)
from docguard.llm.substring_dedup import Settings as Parsing


@dataclass(frozen=True)
class Settings:
    """Shingle length, threshold in percent, from how many chunks' copies on a shingle is ordered last, bytes of a chunk,
    the members of a block of a long list, and up to which members and shingles lists chained together are one."""
    words: int = 4
    percent: int = 85
    hot: int = 64
    chunk: int = 1 << 20
    block: int = 256
    chain: int = 1024
    chain_shingles: int = 2_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int):
    """Sorted distinct shingle hashes of each text, end to end, and the bounds of each text's."""
    data = lowered(data)
    starts, ends, rows = word_spans(data, offsets)
    h = slice_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    factor = np.uint64(0x94D049BB133111EB)
    n_texts = len(offsets) - 1
    first = np.searchsorted(rows, np.arange(n_texts + 1))
    sizes = np.diff(first)
    total = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        total = total * factor + h[k:len(h) - words + 1 + k] if len(total) else total
    own = rows[:len(total)] == rows[words - 1:] if len(total) else np.zeros(0, bool)
    values, owner = mixed(total[own]), rows[:len(total)][own]
    brief = np.flatnonzero((sizes > 0) & (sizes < words))  # the whole sequence is the one shingle
    if len(brief):
        folded = np.zeros(len(brief), np.uint64)
        for k in range(words - 1):
            more = sizes[brief] > k
            folded[more] = folded[more] * factor + h[first[brief][more] + k]
        values = np.concatenate([values, mixed(folded + sizes[brief].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))])
        owner = np.concatenate([owner, brief])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(n_texts + 1))


def prefix_sizes(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set of each size two linked sets must share one of."""
    return np.where(sizes > 0, sizes - (sizes * percent + 99) // 100 + 1, 0)


def ragged(bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the first `counts` of each slice."""
    total = int(counts.sum())
    return np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)


def shingle_keys(chunks: DataFrame, n_buckets: int, settings: Settings) -> DataFrame:
    """(bucket, chunk, keys): each chunk's distinct shingle keys, twice if two of its documents have it."""
    words = settings.words

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                values, bounds = shingle_sets(*content(batch.column(2)[i].as_py(), batch.column(1)[i].values.to_numpy()), words)
                if not len(values):
                    continue
                bucket, key = dealt(values, n_buckets)
                buckets, parts = key_rows(bucket, key, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array([batch.column(0)[i].as_py()] * len(parts), pa.int64()), pa.array(parts, pa.binary())],
                    ["bucket", "chunk", "keys"])

    return chunks.select("chunk", "sizes", "packed").mapInArrow(tidy(run), "bucket int, chunk long, keys binary")


def measured_sets(chunks: DataFrame, side: DataFrame, n_buckets: int, settings: Settings) -> DataFrame:
    """(doc_id, n, print_a, print_b, n_hot, first, shared) of each document.

    The order of all shingles: those of one document, those of several, those of many, each by hash. `first` holds
    the several-document ones among the first that decide; without one the document links with no other set. Only
    then `shared` holds all that other documents have, which is all that any intersection can hold.
    """
    words, percent = settings.words, settings.percent

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(1)[i].values
                values, bounds = shingle_sets(*content(batch.column(3)[i].as_py(), batch.column(2)[i].values.to_numpy()), words)
                sizes = np.diff(bounds)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values ^ np.uint64(salt)))])
                        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                prints = [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]
                known, hot = known_keys(batch.column(4)[i].as_py())
                grade = np.zeros(len(values), np.int8)
                if len(known):
                    bucket, key = dealt(values, n_buckets)
                    both = bucket.astype(np.uint64) << np.uint64(32) | key
                    at = np.minimum(np.searchsorted(known, both), len(known) - 1)
                    grade = np.where(known[at] == both, 1 + hot[at], 0).astype(np.int8)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((values, grade, owner))
                values, grade = values[order], grade[order]
                leading = np.zeros(len(values), bool)
                leading[ragged(bounds, prefix_sizes(sizes, percent))] = True
                leading &= grade > 0
                n_first = np.bincount(owner[leading], minlength=len(sizes))
                kept = (grade > 0) & (n_first > 0)[owner]
                lists = []
                for mask in (leading, kept):
                    counts = np.bincount(owner[mask], minlength=len(sizes))
                    lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                                                          pa.array(values[mask].view(np.int64))))
                n_hot = np.bincount(owner[leading & (grade > 1)], minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(prints[0]), pa.array(prints[1]), pa.array(n_hot), *lists],
                                                 ["doc_id", "n", "print_a", "print_b", "n_hot", "first", "shared"])

    joined = chunks.select("chunk", "ids", "sizes", "packed").join(side, "chunk", "left").select("chunk", "ids", "sizes", "packed", "side")
    return joined.mapInArrow(tidy(run), "doc_id long, n long, print_a long, print_b long, n_hot long, first array<long>, shared array<long>")


def list_links(sets: list[np.ndarray], sizes: np.ndarray, known: np.ndarray, percent: int):
    """Component (number of its first member) of each set of one list; `known` gives those found so far.

    `sets` hold the shingles that other documents have too, `sizes` count all. Sets stand by size. The overlaps of a set with all others come from an index of the list's shingles. They are
    counted anew for the first set and for one unlike all done so far; else they are derived from the most similar one
    done: minus the lists of what only that one holds, plus the lists of what only the new one holds. A set is skipped
    if it is in one component with all sets it could link with by size.
    """
    m, held_sizes = len(sets), np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = known[0] == known[1] or 100 * both >= percent * (sizes.sum() - both)
        return np.array([0, 0 if linked else 1])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    token = token.reshape(-1)
    bounds = np.concatenate([[0], np.cumsum(held_sizes)])
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(m), held_sizes)[order]
    lists = np.searchsorted(token[order], np.arange(token.max() + 2)) if len(token) else np.zeros(1, np.int64)

    def held(tokens):
        counts = lists[tokens + 1] - lists[tokens]
        at = np.repeat(lists[tokens] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return np.bincount(holder[at], minlength=m)

    own = [token[bounds[i]:bounds[i + 1]] for i in range(m)]
    _, label = np.unique(known, return_inverse=True)
    label = label.reshape(-1)
    by_size = np.argsort(sizes, kind="stable")
    done: list[int] = []
    answers: dict[int, np.ndarray] = {}
    for i in by_size[::-1]:
        open_ = (label != label[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if not open_.any():
            continue
        base = max(done, key=lambda d: answers[d][i], default=None)
        if base is not None and 4 * answers[base][i] >= 3 * max(held_sizes[i], held_sizes[base]):
            mine, theirs = own[i], own[base]
            overlap = answers[base] - held(np.setdiff1d(theirs, mine, assume_unique=True)) + held(np.setdiff1d(mine, theirs, assume_unique=True))
        else:
            overlap = held(own[i])
            done.append(int(i))
            answers[int(i)] = overlap
            if len(done) > 8:
                answers.pop(done.pop(0))
        hit = open_ & (100 * overlap >= percent * (sizes + sizes[i] - overlap))
        if hit.any():
            label[np.isin(label, label[hit])] = label[i]
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    return first[back.reshape(-1)]


def by_position(places: np.ndarray, afters: np.ndarray, sizes: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Which sets of a list could link with set i by their sizes and by how many shared shingles stand before and after the list's own."""
    most = np.minimum(places, places[i]) + 1 + np.minimum(afters, afters[i])
    return (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & ((100 + percent) * most >= percent * (sizes + sizes[i]))


def possible_links(firsts: list[np.ndarray], hots: list[int], sizes: np.ndarray, percent: int, shingle: int | None = None):
    """Component (number of its first member) of each set of one list by what the first shingles alone allow.

    `firsts` hold the several-document shingles among the first that decide, in the order (`hots` say how many of
    them, at the end, are frequent ones). Up to the lesser of two sets' last ones, both are known in full: what one has there
    and the other has not is lost for their intersection, single-document shingles too. A pair that has lost more
    than its sizes allow cannot link. Pairs that the place of the list's own `shingle` rules out are skipped before.
    """
    m = len(firsts)
    rank_of = np.concatenate(firsts).astype(np.uint64)
    grade = np.concatenate([np.arange(len(f)) >= len(f) - h for f, h in zip(firsts, hots)])
    order = np.lexsort((rank_of, grade))
    r, g = rank_of[order], grade[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    rank = np.empty(len(r), np.int64)
    rank[order] = np.cumsum(new) - 1
    lengths = np.array([len(f) for f in firsts])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    own = [rank[bounds[i]:bounds[i + 1]] for i in range(m)]
    single = prefix_sizes(sizes, percent) - lengths
    label = np.arange(m)
    places = np.array([np.flatnonzero(f == shingle)[0] for f in firsts]) if shingle is not None else lengths - 1
    afters = sizes - single - places - 1 if shingle is not None else sizes
    for i in range(m):
        for j in i + 1 + np.flatnonzero(by_position(places, afters, sizes, i, percent)[i + 1:]):
            if label[i] == label[j]:
                continue
            least = -(-percent * (sizes[i] + sizes[j]) // (100 + percent))  # the intersection that a link needs
            top = min(own[i][-1], own[j][-1])
            a, b = own[i][:np.searchsorted(own[i], top, side="right")], own[j][:np.searchsorted(own[j], top, side="right")]
            common = len(np.intersect1d(a, b, assume_unique=True))
            if single[i] + len(a) - common <= sizes[i] - least and single[j] + len(b) - common <= sizes[j] - least:
                label[label == label[j]] = label[i]
    _, first, back = np.unique(label, return_index=True, return_inverse=True)
    return first[back.reshape(-1)]


def work_lists(members: DataFrame, keys: list[str], settings: Settings, possible: bool = False) -> DataFrame:
    """(a, b): for each list, links from every member to the first of its component in the list.

    With `possible`, the key is the list's shingle, shingles are the first ones only, `known` counts the frequent ones among them, and links are
    those that cannot be ruled out.
    """
    percent = settings.percent
    n_keys = len(keys)

    def run(batches):
        import pyarrow as pa

        def links(group, key):
            sids, known, sizes, sets = zip(*group)
            if possible:
                first = possible_links(list(sets), list(known), np.array(sizes), percent, key[0])
            else:
                first = list_links(list(sets), np.array(sizes), np.array(known), percent)
            return [(sids[k], sids[f]) for k, f in enumerate(first) if f != k]

        out, group, at = [], [], None
        for batch in batches:
            bounds = batch.column(n_keys + 3).offsets.to_numpy()
            values = batch.column(n_keys + 3).values.to_numpy()
            key_rows = zip(*(batch.column(k).to_pylist() for k in range(n_keys)))
            for k, key in enumerate(key_rows):
                if key != at:
                    if len(group) > 1:
                        out += links(group, at)
                    group, at = [], key
                group.append((batch.column(n_keys)[k].as_py(), batch.column(n_keys + 1)[k].as_py(), batch.column(n_keys + 2)[k].as_py(), values[bounds[k]:bounds[k + 1]].copy()))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                out = []
        if len(group) > 1 and (out := links(group, at)):
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = members.select(*keys, "sid", "known", "n", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(run), "a long, b long")


#: What names a pair of parts of two blocks of one list.
PAIR = ["shingle", "size_a", "depth_a", "size_b", "depth_b", "part_a", "part_b"]


def in_blocks(long: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Members (shingle, sid, known) of long lists with n, before and after (shared shingles around the list's own) and their block.

    A block holds the sets of a list whose sizes, and whose numbers of shingles after the list's own, are within some four percent.
    """
    short = f"n - int(ceil(n * {settings.percent}L / 100D)) + 1 - size(first)"  # shingles of one document, which come first
    own = long.join(sets.select("sid", "n", "first"), "sid").selectExpr(
        "shingle", "sid", "known", "n", "array_position(first, shingle) - 1 AS before", f"{short} AS single")
    return own.selectExpr("*", "n - single - before - 1 AS after").selectExpr(
        "shingle", "sid", "known", "n", "before", "after", "int(floor(ln(n) * 25)) AS size", "int(floor(ln(after + 1) * 25)) AS depth")


def meeting_blocks(located: DataFrame, settings: Settings) -> DataFrame:
    """The directory of blocks joined with itself: (shingle, size_a, depth_a, size_b, depth_b, parts_a, parts_b) of blocks that may link.

    Two blocks are skipped if no two of their sizes allow a link, if the shared shingles before and after the list's own are too
    few for one, or if all their sets are in one component already. Block a is not after block b in the order.
    """
    percent = settings.percent
    blocks = located.groupBy("shingle", "size", "depth").agg(
        F.count(F.lit(1)).alias("members"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("before").alias("before"),
        F.max("after").alias("after"), F.min("known").alias("low"), F.max("known").alias("high")).selectExpr(
        "*", f"int(ceil(members / {settings.block}D)) AS parts")
    reach = int(np.floor(25 * np.log(100 / percent))) + 1
    a = blocks.selectExpr(*(f"{c} AS {c}_a" for c in blocks.columns)).selectExpr("*", "shingle_a AS shingle", f"explode(sequence(size_a, size_a + {reach})) AS size_b")
    b = blocks.selectExpr("shingle", *(f"{c} AS {c}_b" for c in blocks.columns if c != "shingle"))
    return a.join(b, ["shingle", "size_b"]).filter(
        f"""(size_a < size_b OR depth_a <= depth_b)
        AND 100 * least(most_a, most_b) >= {percent} * greatest(least_a, least_b)
        AND {100 + percent} * (least(before_a, before_b) + 1 + least(after_a, after_b)) >= {percent} * (least_a + least_b)
        AND NOT (low_a = high_a AND low_b = high_b AND low_a = low_b)""").select("shingle", "size_a", "depth_a", "size_b", "depth_b", "parts_a", "parts_b")


def block_pairs(located: DataFrame, meets: DataFrame) -> DataFrame:
    """(PAIR, sid, known): each member once for every part of the blocks that its own block meets."""
    at_a = meets.selectExpr("*", "size_a AS size", "depth_a AS depth", "true AS is_a", "size_a = size_b AND depth_a = depth_b AS same")
    at_b = meets.filter("size_a <> size_b OR depth_a <> depth_b").selectExpr("*", "size_b AS size", "depth_b AS depth", "false AS is_a", "false AS same")
    placed = located.select("shingle", "size", "depth", "sid", "known").join(small(at_a.unionByName(at_b)), ["shingle", "size", "depth"]).selectExpr(
        "*", "int(pmod(xxhash64(sid, 7), if(is_a, parts_a, parts_b))) AS part", "explode(sequence(0, if(is_a, parts_b, parts_a) - 1)) AS other")
    return placed.selectExpr(
        "shingle", "size_a", "depth_a", "size_b", "depth_b", "CASE WHEN same THEN least(part, other) WHEN is_a THEN part ELSE other END AS part_a",
        "CASE WHEN same THEN greatest(part, other) WHEN is_a THEN other ELSE part END AS part_b", "sid", "known")


def linked_sets(docs: DataFrame, settings: Settings, hand: Handoff) -> tuple[DataFrame, DataFrame]:
    """Documents as (doc_id, n, print_a, print_b), and sets as (n, print_a, print_b, component) with the component's least doc_id."""
    chunks, name = bucketed(docs.sparkSession, chunked(docs, Parsing(chunk=settings.chunk), "doc_id", "text"), "chunk")
    n_buckets = key_buckets(chunks)
    keys_of = hand.write(shared_keys(shingle_keys(chunks, n_buckets, settings), Parsing(hot=settings.hot)), "keys")
    side = keys_of.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "keys", "hot")).alias("side"))
    by_doc = hand.write(measured_sets(chunks, side, n_buckets, settings).withColumn(
        "doc_id", F.expr(f"nullif(doc_id, {LAST}L)")), "documents")
    drop_tables(docs.sparkSession, name)
    hand.drop("keys")
    keys = ["n", "print_a", "print_b"]
    grouped = by_doc.filter("size(first) > 0").groupBy(*keys).agg(F.first("first").alias("first"), F.first("n_hot").alias("n_hot"), F.first("shared").alias("shingles"))
    sets = hand.write(grouped.selectExpr(*keys, "first", "n_hot", "shingles", "monotonically_increasing_id() AS sid"), "sets")
    postings = sets.selectExpr("sid", "explode(first) AS shingle")
    shared = postings.groupBy("shingle").count().filter("count > 1").select("shingle")
    postings = hand.write(postings.join(shared, "shingle"), "postings")
    # lists with the same members are one list
    lists = postings.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("f"), F.expr("bit_xor(xxhash64(sid))").alias("x"), F.expr("bit_xor(xxhash64(sid, 1))").alias("y"),
        F.min("sid").alias("low"))
    chosen = lists.groupBy("f", "x", "y", "low").agg(F.min("shingle").alias("shingle")).select("shingle", "f", "low")
    members = hand.write(postings.join(chosen, "shingle"), "members")
    hand.drop("postings")
    whole = sets.select("sid", "n", "shingles")
    # sets that may link, as far as their first shingles tell, chain together: a chain of moderate size is worked off as one list, to which each set goes once
    narrow = members.filter(f"f <= {settings.block}").join(sets.select("sid", "n", "n_hot", "first"), "sid").selectExpr(
        "shingle", "sid", "n_hot AS known", "n", "first AS shingles")
    may_link = work_lists(narrow, ["shingle"], settings, possible=True)
    edges = hand.write(may_link.unionByName(members.filter(f"f > {settings.block}").selectExpr("sid AS a", "low AS b")), "edges")
    chains = connected_components(edges, hand, "chains").withColumnRenamed("node", "sid")
    sizes = chains.join(sets.select("sid", "n"), "sid").groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"))
    sizes = sizes.selectExpr("component", f"members <= {settings.chain} AND total <= {settings.chain_shingles} AS moderate")
    chains = hand.write(chains.join(sizes, "component"), "sized")
    together = chains.filter("moderate").join(whole, "sid").selectExpr("component", "sid", "sid AS known", "n", "shingles")
    chained_links = hand.write(work_lists(together, ["component"], settings), "links0")
    # what is left: lists of sets in longer chains, of which only the sets of one chain can link
    members = hand.write(members.drop("low").join(chains.filter("NOT moderate").select("sid"), "sid"), "long")
    # first round: short lists as they are; long ones in blocks that share the list's least set
    block = settings.block
    least = members.filter(f"f > {block}").groupBy("shingle").agg(F.min("sid").alias("sid"), F.first("f").alias("f"))
    parts = f"int(ceil(f / {block}D))"
    blocks = members.selectExpr("shingle", f"int(pmod(xxhash64(sid, 7), {parts})) AS part", "sid").unionByName(
        least.selectExpr("shingle", f"explode(sequence(0, {parts} - 1)) AS part", "sid")).distinct()
    first = blocks.join(whole, "sid").selectExpr("shingle", "part", "sid", "sid AS known", "n", "shingles")
    links = hand.write(work_lists(first, ["shingle", "part"], settings).unionByName(chained_links), "links1")
    found = connected_components(links, hand, "components1")
    # second round: what remains apart in a long list meets by blocks of like size and place that can link
    long = members.filter(f"f > {block}").join(found.withColumnRenamed("node", "sid"), "sid", "left").selectExpr(
        "shingle", "sid", "coalesce(component, sid) AS known")
    apart = hand.write(long.groupBy("shingle").agg(F.min("known").alias("low"), F.max("known").alias("high")).filter("low < high").select("shingle"), "apart")
    if apart.isEmpty():
        more = links.limit(0)
    else:
        located = hand.write(in_blocks(long.join(small(apart), "shingle"), sets, settings), "located")
        meets = hand.write(meeting_blocks(located, settings), "meets")
        second = block_pairs(located, meets).join(whole, "sid").select(*PAIR, "sid", "known", "n", "shingles")
        more = hand.write(work_lists(second, PAIR, settings), "links2")
    hand.drop("members", "long", *(step for step in ("apart", "located", "meets") if step in hand.paths))
    everything = links.unionByName(more)
    groups = found if more.isEmpty() else connected_components(everything, hand, "components2")
    # all documents by their sets; sets in no component are their own
    named = sets.select(*keys, "sid").join(groups.withColumnRenamed("node", "sid"), "sid")
    placed = by_doc.filter("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("least")).join(
        named.select(*keys, "component"), keys, "left")
    placed = hand.write(placed, "placed")
    hand.drop(*(step for step in tuple(hand.paths) if step not in ("documents", "placed")))
    smallest = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    result = placed.join(small(smallest), "component", "left").selectExpr(*keys, "coalesce(component_id, least) AS component_id")
    return by_doc.select("doc_id", *keys), result


def shingle_join(docs: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Words are runs without blanks, A-Z in lower case; a document of fewer words than a shingle is one shingle. Null,
    empty and blank texts have no set and link with nothing. Equal texts link. Rows that share an id are rows of their
    own. An empty table gives no rows; other columns are ignored.
    """
    hand = Handoff(docs.sparkSession, "jaccard")
    own = docs.selectExpr(f"bigint(`{id_column}`) AS doc_id", f"`{text}` AS text")
    rows, sets = linked_sets(own, settings, hand)
    keys = ["n", "print_a", "print_b"]
    return rows.join(sets, keys, "left").selectExpr(
        f"doc_id AS `{id_column}`", "n AS n_shingles", "if(n > 0, component_id, doc_id) AS component_id")


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that have the smallest id of their component, in all columns.

    Rows that share that id all stay, and so do rows without an id: nothing tells them apart.
    """
    joined = shingle_join(docs.select("doc_id", "text"), settings)
    gone = joined.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(small(gone), F.col("doc_id") == F.col("__gone"), "left_anti")


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))) END AS grams FROM w),
n AS (SELECT doc_id, len(grams)::bigint AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b
    WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
"""
ORACLE = "WITH RECURSIVE " + ORACLE.strip().removeprefix("WITH ") + """
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, n_shingles, component_id FROM n JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""

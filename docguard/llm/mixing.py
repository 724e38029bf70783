"""Mixing sources to target weights by budgets over a tree of domain, language and source."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docguard.llm.common import BLANKS, Handoff, small

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Weights by node name at each level (1 where none is named), how much to take, and how often a text may recur."""
    domain_of: dict[str, str] = field(default_factory=dict)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    share: float = 1.0
    budget: int | None = None
    max_epochs: int = 2
    seed: int = 17


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _lookup(column: str, pairs: dict, otherwise: str) -> str:
    """SQL that looks a value up in a configured dictionary."""
    if not pairs:
        return otherwise
    cases = " ".join(f"WHEN {_literal(k)} THEN {_literal(v) if isinstance(v, str) else f'{float(v)!r}D'}" for k, v in pairs.items())
    return f"CASE {column} {cases} ELSE {otherwise} END"


def leaves_of(mix: Mix, lang: str = "lang", source: str = "source") -> list[str]:
    """SQL columns of a text's leaf; a null language or source is the node 'unknown', an unlisted source its own domain's 'other'."""
    src = f"coalesce(`{source}`, 'unknown')"
    return [f"{_lookup(src, mix.domain_of, _literal('other'))} AS domain", f"coalesce(`{lang}`, 'unknown') AS lang", f"{src} AS source"]


def shared_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Give each parent's budget to its children by weight, no child more than its room.

    Children ordered by room per weight: those whose room is below the level at which the rest would be filled take
    all of it, and what they leave goes to their siblings. A parent never has more than the room of its children, so
    a shortage rises to the parent's siblings only when no sibling of the child can take it.
    """
    by = f"PARTITION BY {', '.join(parent)}" if parent else "PARTITION BY 1"
    order = f"{by} ORDER BY room / weight, {level}"
    before = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rest = f"OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    levelled = nodes.selectExpr("*", f"(budget - coalesce(sum(room) {before}, 0D)) / sum(weight) {rest} AS fill",
                                f"coalesce(sum(room) {before}, 0D) AS below")
    # the first child whose room exceeds its share fixes the level of all that follow
    fixed = levelled.selectExpr("*", f"first(if(room / weight > fill, fill, NULL), true) OVER ({order} ROWS UNBOUNDED PRECEDING) AS level")
    return fixed.selectExpr(*[c for c in nodes.columns if c != "budget"], "if(level IS NULL, room, least(room, weight * level)) AS budget")


def leaf_budgets(supply: DataFrame, mix: Mix) -> DataFrame:
    """Budget in tokens of each leaf (domain, lang, source, tokens, n_docs): one row per leaf, from level to level."""
    leaves = supply.selectExpr("*", f"double(tokens) * {mix.max_epochs} AS room").filter("tokens > 0")
    total = leaves.agg(F.sum("tokens").alias("total"), F.sum("room").alias("most"))
    wanted = f"double({mix.budget})" if mix.budget is not None else f"{mix.share}D * total"
    root = total.selectExpr(f"least({wanted}, most) AS budget")
    parents, given = [], None
    for depth, level in enumerate(LEVELS):
        keys = [*LEVELS[:depth], level]
        rooms = leaves.groupBy(*keys).agg(F.sum("room").alias("room"))
        weight = _lookup(level, mix.weights.get(level, {}), "1.0D")
        nodes = rooms.selectExpr("*", f"greatest({weight}, 1e-9D) AS weight")
        nodes = nodes.crossJoin(F.broadcast(root)) if given is None else nodes.join(given, parents)
        given = shared_out(nodes, parents, level).select(*keys, "budget")
        parents = keys
    return leaves.join(given, list(LEVELS)).selectExpr(
        *LEVELS, "tokens", "n_docs", "budget", "least(int(floor(budget / tokens)), " + str(mix.max_epochs) + ") AS full")


def _order(mix: Mix, identity: str) -> str:
    """A text's place in an epoch: a hash of seed, epoch and identity."""
    return f"xxhash64({mix.seed}, full, {identity})"


def plan(docs: DataFrame, mix: Mix, hand: Handoff, id_column: str = "doc_id", text: str = "text",
         lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The texts' sizes, and per leaf the number of whole epochs and the cut of the epoch that is begun.

    An epoch takes all texts of a leaf in the order of a seeded hash; the last one is cut where the tokens so far
    reach the budget. To find the cut, a leaf of n texts is counted in about sqrt(n) ranges of the hash; only the
    range that holds the cut is ordered. So no task holds a leaf, however many rows it has.
    """
    words = f"bigint(size(filter(split(coalesce(`{text}`, ''), '{BLANKS}', -1), w -> w <> '')))"
    sizes = hand.write(docs.selectExpr(f"`{id_column}` AS id", *leaves_of(mix, lang, source), f"{words} AS n_tokens"), "sizes")
    supply = sizes.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    leaves = hand.write(leaf_budgets(supply, mix), "leaves")
    placed = sizes.join(small(leaves.selectExpr(*LEVELS, "full", "budget - full * tokens AS rest", "int(ceil(sqrt(n_docs))) AS n_ranges")),
                        list(LEVELS)).filter("rest > 0").selectExpr(
        *LEVELS, "id", "n_tokens", "rest", f"{_order(mix, 'id')} AS place", "n_ranges").selectExpr(
        "*", "int(floor((double(place) / 18446744073709551616D + 0.5D) * n_ranges)) AS part")
    counted = placed.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    keys = ", ".join(LEVELS)
    running = counted.selectExpr("*", f"sum(n) OVER (PARTITION BY {keys} ORDER BY part) - n AS before")
    at = hand.write(running.filter("before < rest AND before + n >= rest").select(*LEVELS, "part", "before"), "ranges")
    inside = placed.join(small(at), [*LEVELS, "part"]).selectExpr(
        *LEVELS, "place", "id", "rest",
        f"before + coalesce(sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY place, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins")
    cuts = inside.filter("begins < rest").groupBy(*LEVELS).agg(F.max(F.struct("place", "id")).alias("last"))
    chosen = hand.write(leaves.join(cuts, list(LEVELS), "left").select(*LEVELS, "full", "tokens", "budget", "last"), "cuts")
    hand.drop("leaves", "ranges")
    return sizes, chosen


def _epochs(rows: DataFrame, chosen: DataFrame, mix: Mix) -> DataFrame:
    """Each row once per epoch that takes it."""
    taken = f"full + int(last IS NOT NULL AND struct({_order(mix, 'id')} AS place, id) <= last)"
    return rows.join(small(chosen), list(LEVELS)).selectExpr("*", f"{taken} AS n_epochs").filter("n_epochs > 0").selectExpr(
        "*", "explode(sequence(1, n_epochs)) AS epoch")


def mix_sources(docs: DataFrame, mix: Mix, id_column: str = "doc_id", text: str = "text", lang: str = "lang",
                source: str = "source") -> DataFrame:
    """One row per text and epoch that takes it: id, leaf, n_tokens, epoch, and the leaf's supply and budget.

    A leaf overshoots its budget by less than its last text, which is taken whole. Texts without a token take no
    budget and come with any epoch that reaches them. Rows that share an id share its place and are taken together.
    Null languages and sources form the node 'unknown'; an empty table gives no rows; other columns are ignored.
    """
    hand = Handoff(docs.sparkSession, "mixing")
    sizes, chosen = plan(docs, mix, hand, id_column, text, lang, source)
    return _epochs(sizes, chosen, mix).selectExpr(
        f"id AS `{id_column}`", *LEVELS, "n_tokens", "epoch", "tokens AS leaf_tokens", "round(budget, 3) AS leaf_budget")


def mixed_texts(docs: DataFrame, mix: Mix, id_column: str = "doc_id", text: str = "text", lang: str = "lang",
                source: str = "source") -> DataFrame:
    """The input's rows and columns, each row as often as the mix takes it; the texts themselves are not shuffled."""
    hand = Handoff(docs.sparkSession, "mixing")
    _, chosen = plan(docs, mix, hand, id_column, text, lang, source)
    hand.drop("sizes")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), *[F.expr(x) for x in leaves_of(mix, lang, source)])
    return _epochs(rows, chosen, mix).select("row.*")

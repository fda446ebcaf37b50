"""Stage 6: fuzzy duplicates within a page, dropped by priority in order.

A page's blocks are gathered once, as an ordered list (a page is a bounded thing). Candidate pairs are boxes that overlap
enough and whose text lengths allow the similarity; only their texts reach the Python similarity, in Arrow batches. The
order-dependent choice is a native fold over integers.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PRIORITY, PipelineConfig
from ..functions import geometry as G
from ..runtime import ship
from .stages import PAGE


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def similarities(later: pd.Series, earlier: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratios of lower-cased texts, list by list; not symmetric: the later block's text comes first."""
    return pd.Series([[1.0 if x == y else _ratio(x.lower(), y.lower()) for x, y in zip(a, b, strict=True)] for a, b in zip(later, earlier, strict=True)])


#: So that the optimiser neither repeats it nor moves it into a lambda, where Python can't run.
similarities = similarities.asNondeterministic()


def may_be_similar(a: Column, b: Column, threshold: float) -> Column:
    """The ratio is at most twice the shorter length over both lengths; two empty texts have ratio 1."""
    la, lb = F.length(F.lower(a)), F.length(F.lower(b))
    return F.coalesce(F.try_divide(2.0 * F.least(la, lb), la + lb), F.lit(1.0)) > threshold


def ordered(blocks: DataFrame, order: tuple[str, ...] = ("stage_ord", "seq")) -> DataFrame:
    """ord: a block's place in its page's list of all stages."""
    return blocks.withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)) - 1)


def page_lists(blocks: DataFrame, order: tuple[str, ...] = ("stage_ord", "seq")) -> DataFrame:
    """(doc_id, page_number, b): a page's blocks as one ordered list of structs. The only shuffle that merging needs."""
    rest = [c for c in blocks.columns if c not in PAGE]
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("block"))
    listed = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("b"))
    return listed.select(*PAGE, F.col("b.block").alias("b"))


def near_pairs(b: Column, cfg: PipelineConfig, similar: bool) -> Column:
    """array<struct<later, earlier, iou, a, b>> of a page's pairs that overlap (and, if asked, may be similar)."""

    def earlier_of(x: Column, i: Column) -> Column:
        def keep(p: Column) -> Column:
            ok = G.overlaps(x["bbox"], p["block"]["bbox"], cfg.overlap_threshold)
            return ok & may_be_similar(x["text"], p["block"]["text"], cfg.similarity_threshold) if similar else ok

        before = F.transform(F.slice(b, F.lit(1), i), lambda y, j: F.struct(j.alias("j"), y.alias("block")))
        return F.transform(
            F.filter(before, keep),
            lambda p: F.struct(i.alias("later"), p["j"].alias("earlier"), G.iou(x["bbox"], p["block"]["bbox"]).alias("iou"), x["text"].alias("a"), p["block"]["text"].alias("b")),
        )

    return F.flatten(F.transform(b, earlier_of))


def overlapping_pairs(blocks: DataFrame, cfg: PipelineConfig = PipelineConfig(), order: tuple[str, ...] = ("stage_ord", "seq")) -> DataFrame:
    """(doc_id, page_number, later, earlier, iou) of pairs whose boxes overlap."""
    pairs = page_lists(blocks, order).select(*PAGE, F.explode(near_pairs(F.col("b"), cfg, similar=False)).alias("p"))
    return pairs.select(*PAGE, "p.later", "p.earlier", "p.iou")


def page_edges(blocks: DataFrame, cfg: PipelineConfig = PipelineConfig(), order: tuple[str, ...] = ("stage_ord", "seq")) -> DataFrame:
    """(doc_id, page_number, b, edges): the list and its similar pairs, array<struct<later, earlier, similarity>>."""
    ship(blocks.sparkSession)
    near = page_lists(blocks, order).withColumn("near", near_pairs(F.col("b"), cfg, similar=True))
    scored = near.withColumn("ratio", similarities(F.col("near.a"), F.col("near.b")))
    edges = F.zip_with("near", "ratio", lambda n, r: F.struct(n["later"].alias("later"), n["earlier"].alias("earlier"), r.alias("similarity")))
    return scored.select(*PAGE, "b", F.filter(edges, lambda e: e["similarity"] > cfg.similarity_threshold).alias("edges"))


def similar_pairs(blocks: DataFrame, cfg: PipelineConfig = PipelineConfig()) -> DataFrame:
    """(doc_id, page_number, later, earlier, similarity) of pairs that overlap and are similar."""
    return page_edges(blocks, cfg).select(*PAGE, F.explode("edges").alias("e")).select(*PAGE, "e.*")


def priority(stage: Column) -> Column:
    out = F.lit(0)
    for name, p in PRIORITY.items():
        out = F.when(stage == name, p).otherwise(out)
    return out


def fold(members: Column, edges: Column) -> Column:
    """struct<kept array<int>, removed, merged>: goes through a page's blocks in order.

    A block that matches a kept one (the first in list order) is dropped, or takes its place, at the end of the list, if
    its priority is higher. members: array<struct<ord, prio>> in order; edges: array<struct<later, earlier>>.
    """
    start = F.struct(F.array().cast("array<struct<ord:int,prio:int>>").alias("kept"), F.lit(0).alias("removed"), F.lit(0).alias("merged"))

    def step(a: Column, m: Column) -> Column:
        hits = F.transform(F.filter(edges, lambda e: e["later"] == m["ord"]), lambda e: e["earlier"])
        found = F.try_element_at(F.filter(a["kept"], lambda k: F.array_contains(hits, k["ord"])), F.lit(1))
        takes = m["prio"] > found["prio"]
        replaced = F.concat(F.filter(a["kept"], lambda k: k["ord"] != found["ord"]), F.array(m))
        kept = F.when(found.isNull(), F.concat(a["kept"], F.array(m))).when(takes, replaced).otherwise(a["kept"])
        removed = a["removed"] + F.when(found.isNull(), 0).otherwise(1)
        return F.struct(kept.alias("kept"), removed.alias("removed"), (a["merged"] + F.when(found.isNotNull() & takes, 1).otherwise(0)).alias("merged"))

    return F.aggregate(members, start, step)


def solve(blocks: DataFrame, cfg: PipelineConfig = PipelineConfig(), order: tuple[str, ...] = ("stage_ord", "seq")) -> DataFrame:
    """(doc_id, page_number, b, s): a page's blocks in order and what the fold decides; one shuffle, by page."""
    members = F.transform("b", lambda x, i: F.struct(i.alias("ord"), priority(x["source_stage"]).alias("prio")))
    return page_edges(blocks, cfg, order).withColumn("members", members).select(*PAGE, "b", fold(F.col("members"), F.col("edges")).alias("s"))


def kept(solved: DataFrame) -> DataFrame:
    """Blocks that stay, with their place in the output (out_seq)."""
    return solved.select(*PAGE, F.posexplode(F.transform("s.kept", lambda k: F.get("b", k["ord"]))).alias("out_seq", "k")).select(*PAGE, "out_seq", "k.*")


def counters(solved: DataFrame) -> DataFrame:
    return solved.select(*PAGE, F.size("b").alias("total_input_blocks"), F.col("s.removed").alias("duplicates_removed"), F.col("s.merged").alias("blocks_merged"))


def deduplicate(blocks: DataFrame, cfg: PipelineConfig = PipelineConfig(), order: tuple[str, ...] = ("stage_ord", "seq")) -> tuple[DataFrame, DataFrame]:
    """Blocks that stay and counters per page, as two plans: who needs both should write ``solve`` once, as a run does."""
    solved = solve(blocks, cfg, order)
    return kept(solved), counters(solved)
